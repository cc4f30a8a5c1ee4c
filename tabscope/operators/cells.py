"""Value-frequency frames: the rows of a table turned into (column, value, frequency).

One frame per branch (numeric, text, time).  Each reads only its own columns, so
the three scans together read the table once.  The grouping combines on the map
side before the shuffle, so a value that fills a third of the table travels as
one row per map task.
"""
from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import rules
from ..functions.exprs import col
from ..sources.scratch import local_frame

NUMERIC, BOOLEAN, DATETIME, TEXT = "numeric", "boolean", "datetime", "string"

# Text longer than this is grouped by the SHA-256 digest of the whole value, so that documents do not travel through
# the shuffle. The first characters go along: they are a shorter text as it is, and order most ties of longer ones.
PREFIX = 64
COLUMNS_PER_STAGE = 16


def kind_of(data_type: T.DataType) -> str:
    """Profiling branch of a Spark type.

    Dates go to the datetime branch (deviation V3) and nested types are profiled as
    their JSON text (deviation V4).
    """
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return TEXT


def column_kinds(df: DataFrame) -> list[tuple[int, str, str]]:
    """(ordinal from 1, column, kind) of every column, in order."""
    return [(i, f.name, kind_of(f.dataType)) for i, f in enumerate(df.schema.fields, 1)]


def normal(field: T.StructField) -> Column:
    """The column with NaN read as NULL; both mean "no value"."""
    c = col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(field.dataType))
    return c


def as_text(field: T.StructField) -> Column:
    c = col(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.when(c.isNotNull(), F.to_json(c))
    return c.cast("string")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _fields(df: DataFrame, kinds: set[str], columns):
    wanted = None if columns is None else set(columns)
    return [(i, f) for i, f in enumerate(df.schema.fields, 1)
            if kind_of(f.dataType) in kinds and (wanted is None or f.name in wanted)]


def _inlined(df: DataFrame, structs: list[str], schema: str) -> DataFrame:
    """One row per cell.  A wide table goes through in groups of columns, each of which
    reads only its own columns and stays small enough to be compiled as one stage."""
    if not structs:
        return local_frame(df.sparkSession, [], "cid int, " + schema)
    return union_all([df.selectExpr(f"inline(array({', '.join(structs[at:at + COLUMNS_PER_STAGE])}))")
                      for at in range(0, len(structs), COLUMNS_PER_STAGE)])


def counted(cells: DataFrame) -> DataFrame:
    """Equal cells with their number ``freq``."""
    return cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("freq"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cell(**fields) -> str:
    """SQL text of one cell; a whole table is one expression to parse instead of many calls."""
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def numeric_cells(df: DataFrame, base: int = 0, columns=None) -> DataFrame:
    """(cid, num, whole, exact, freq) of the numeric and boolean columns.

    ``num`` is the value as double.  Integers and decimals also have their own form in
    ``whole`` or ``exact``, so distinct counts hold beyond 2^53.  Both are grouping keys
    only where a column needs them.
    """
    fields = _fields(df, {NUMERIC, BOOLEAN}, columns)
    has_long = any(isinstance(f.dataType, T.LongType) for _, f in fields)
    has_decimal = any(isinstance(f.dataType, T.DecimalType) for _, f in fields)
    small = [base + i for i, f in fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))]
    structs = []
    for i, f in fields:
        v = _quoted(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            v = f"nanvl({v}, cast(NULL AS {f.dataType.simpleString()}))"
        number = f"cast({v} AS int)" if kind_of(f.dataType) == BOOLEAN else v
        cell = {"cid": base + i, "num": f"cast({number} AS double)"}
        if has_long:
            cell["whole"] = v if isinstance(f.dataType, T.LongType) else "cast(NULL AS bigint)"
        if has_decimal:
            cell["exact"] = f"cast({v} AS string)" if isinstance(f.dataType, T.DecimalType) else "cast(NULL AS string)"
        structs.append(_cell(**cell))
    out = counted(_inlined(df, structs, "num double, whole bigint, exact string"))
    if not structs:
        return out
    whole = F.col("whole") if has_long else F.lit(None).cast("bigint")
    if small:
        whole = F.when(F.col("cid").isin(small), F.col("num").cast("bigint")).otherwise(whole)
    exact = F.col("exact") if has_decimal else F.lit(None).cast("string")
    return out.select("cid", "num", whole.alias("whole"), exact.alias("exact"), "freq")


def text_values(df: DataFrame, base: int = 0, columns=None) -> DataFrame:
    """(cid, txt): the cells of the remaining columns, whole and one by one."""
    fields = _fields(df, {TEXT}, columns)
    # the text is a column of its own first, so that a nested value is turned into JSON once
    texts = df.select(*[as_text(f).alias(f"v{i}") for i, f in fields])
    return _inlined(texts, [_cell(cid=base + i, txt=f"v{i}") for i, _ in fields], "txt string")


def text_cells(values: DataFrame) -> DataFrame:
    """(cid, sha, len, pre, freq): distinct texts by length, first characters and, beyond these, digest.

    A text of up to ``PREFIX`` characters is ``pre`` itself and has no digest; a NULL has no length.
    """
    length = F.length("txt")
    return counted(values.select("cid", F.when(length > PREFIX, digest(F.col("txt"))).alias("sha"), length.alias("len"),
                                 F.substring("txt", 1, PREFIX).alias("pre")))


def weighted_texts(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(cid, txt, freq): short texts once each from their written cells, longer ones one by one."""
    short = cells.filter(f"len IS NULL OR len <= {PREFIX}").select("cid", F.col("pre").alias("txt"), "freq")
    if cells.filter(f"len > {PREFIX}").isEmpty():
        return short
    return short.unionByName(values.filter(F.length("txt") > PREFIX).withColumn("freq", F.lit(1).cast("bigint")))


def time_values(df: DataFrame, base: int = 0, columns=None) -> DataFrame:
    """(cid, at, micros): the cells of the date and timestamp columns, one by one.

    ``at`` is the local time for display, months and years.  Instants are told apart and ordered by ``micros``, which
    the types without a time zone do not have.
    """
    instant = lambda f: f"unix_micros({_quoted(f.name)})" if isinstance(f.dataType, T.TimestampType) else "cast(NULL AS bigint)"
    return _inlined(df, [_cell(cid=base + i, at=f"cast({_quoted(f.name)} AS timestamp_ntz)", micros=instant(f))
                         for i, f in _fields(df, {DATETIME}, columns)], "at timestamp_ntz, micros bigint")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def column_bases(tables: dict[str, DataFrame]) -> dict[str, int]:
    """What to add to the ordinal of a column to get its number among all tables."""
    widths = [len(df.columns) for df in tables.values()]
    return dict(zip(tables, accumulate([0] + widths)))


def column_names(tables: dict[str, DataFrame], columns=None) -> DataFrame:
    """(cid, table, ord, column, kind, dtype): one row per column, from the schemas.

    Cells carry the number ``cid`` instead of names.  The size of this frame is the number
    of columns of the given tables, which is why the profile joins may broadcast it.
    """
    spark, bases = next(iter(tables.values())).sparkSession, column_bases(tables)
    rows = [(bases[t] + i, t, i, f.name, kind_of(f.dataType), f.dataType.simpleString())
            for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)
            if columns is None or f.name in set(columns)]
    return local_frame(spark, rows, "cid int, table string, ord int, column string, kind string, dtype string")
