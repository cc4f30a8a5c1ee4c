"""Written intermediate tables.

A stage that several later stages read is written once as Parquet in the shared
folder named by ``spark.checkpoint.dir``.  That cuts the lineage, gives the
readers column pruning and predicate push-down, and outlives lost executors.
"""
from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_run: ContextVar[str | None] = ContextVar("folder of the run", default=None)


_named: list[str] = []


def use_folder(path: str) -> None:
    """The shared folder of sessions that name none themselves, as a local one may."""
    _named[:] = [path]


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or next(iter(_named), None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tabscope-{spark.sparkContext.applicationId}"


@contextmanager
def own_folder(spark: SparkSession):
    """What is written inside goes to a folder of its own, which its owner discards."""
    mark = _run.set(path := f"{_application_folder(spark)}/run-{uuid.uuid4().hex}")
    try:
        yield path
    finally:
        _run.reset(mark)


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and return a frame that reads what was written."""
    spark = df.sparkSession
    path = f"{_run.get() or _application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by :func:`own_folder`, once its frames are exported or collected."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote."""
    discard(spark, _application_folder(spark))


def together(spark: SparkSession, *stages):
    """Run independent stages at the same time and return their results in order.

    A stage is a function that starts Spark jobs; side by side they fill the executors
    that the tail of another stage leaves idle.
    """
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(stages)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, inherit(s)) for s in stages]]


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows known to the driver (names, keys) as a frame whose size the optimizer sees.

    It goes in by Arrow and becomes a local relation: no tasks run to read it.
    """
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [[] for _ in schema]
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema)
