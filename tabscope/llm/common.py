"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import scratch_root

PACKAGE = __name__.split(".")[0]

#: White space that separates words, and the words themselves.
SPACES = "[\\x20\\x09-\\x0D]+"
WORDS = "[^\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application.

    Tasks then import the modules by name, so that loaded vocabularies stay in a reused worker.
    """
    sc = spark.sparkContext
    if getattr(sc, "_shipped_package", None) == PACKAGE:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix=f"{PACKAGE}-")
    path = os.path.join(folder, f"{PACKAGE}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(os.path.join(root, PACKAGE)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._shipped_package = PACKAGE


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, and no task is run twice."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{PACKAGE}-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file; the operators take a path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def text_or_empty(column: str):
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def key(column: str, alias: str | None = None):
    return F.col(f"`{column}`").alias(alias or column)


def marked_rows(df: DataFrame, marks: DataFrame, columns: dict[str, str], text_col: str, once: bool = False) -> DataFrame:
    """The rows of ``df``, with all their columns, that ``marks`` names by ``text_hash`` and equal ``columns``.

    ``columns`` maps columns of ``df`` to those of ``marks``; nulls are equal.  With ``once``, of rows that are the
    same in these columns and the text only one stays.
    """
    wanted = marks.select("text_hash", *columns.values()).distinct()
    text_hash = F.xxhash64(text_or_empty(text_col))
    same = text_hash == wanted["text_hash"]
    for own, name in columns.items():
        same = same & df[f"`{own}`"].eqNullSafe(wanted[name])
    out = df.join(wanted, same, "left_semi")
    return one_of_each(out, [*columns], text_hash) if once else out


def one_of_each(df: DataFrame, columns: list[str], value) -> DataFrame:
    """One row for each value of ``columns`` and of the expression ``value``."""
    name = f"value_{uuid.uuid4().hex}"
    return df.withColumn(name, value).dropDuplicates([*columns, name]).drop(name)


#: Keys counted as hot are at most this many, whatever the table holds, and have at least so many rows.
HOT_KEYS = 1 << 15
HOT_ROWS = 1000


def looked_up(df: DataFrame, keys: list[str], other: DataFrame) -> DataFrame:
    """``df`` left joined with ``other`` on ``keys``, equal nulls not matched; ``other`` has each key once and is narrow.

    A key with more than its 1 / HOT_KEYS of all rows of ``df`` is hot.  There are fewer than HOT_KEYS of these, so their
    rows of ``other`` may be broadcast; every other key is too small to fill a task.  ``df`` is read three times.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") >= HOT_ROWS)
    total = df.count()
    hot = counts.filter(F.col("__rows") > total / HOT_KEYS).drop("__rows")
    if total <= HOT_ROWS or hot.isEmpty():
        return df.join(other, keys, "left")
    hot = written(hot, "hot")
    rows_of_hot = F.broadcast(written(hot.join(other, keys, "left"), "hot-rows"))
    cold = df.join(F.broadcast(hot), keys, "left_anti").join(other, keys, "left")
    return df.join(rows_of_hot, keys).unionByName(cold)
