"""Column profiles from mergeable sketches, for tables whose distinct values are too many to shuffle.

One scan leaves one row per column and task; the rows of a table can be stored and merged later with those of new files,
and merging gives what a scan over everything would have given.  Counts, nulls, lengths, least and largest values are
exact; distinct counts and quartiles have the stated errors.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import col, pct, stat
from ..functions.forms import cell_form
from . import cells as C

#: 2^LG registers: distinct counts are within 1.04 / sqrt(2^LG) = 1.6 % of the truth in two of three cases.
LG = 12
#: Size of the quantile sketch: ranks are within 1.33 % of the rows in 99 of 100 cases at 200; 400 halves that.
KLL = 400
COLUMNS_PER_SCAN = 20

STORED = ["table", "ord", "column", "kind", "rows", "non_null", "distinct_sketch", "quantile_sketch", "lo", "hi", "min_at", "max_at", "min_length", "max_length",
          "length_sum"]


def _facts(f) -> dict:
    kind, v = C.kind_of(f.dataType), C.normal(f)
    number = cell_form(col(f.name), f.dataType).cast("double") if kind == C.NUMERIC else F.lit(None).cast("double")
    text = C.as_text(f) if kind == C.TEXT else F.lit(None).cast("string")
    at = v if kind == C.DATETIME else F.lit(None).cast("timestamp_ntz")
    form = cell_form(col(f.name), f.dataType)
    finite = F.when(F.abs(number) < float("inf"), number)
    return {"non_null": F.count(v), "distinct_sketch": F.hll_sketch_agg(text if kind == C.TEXT else form.cast("string"), LG),
            "quantile_sketch": F.kll_sketch_agg_double(finite, KLL) if kind == C.NUMERIC else F.max(F.lit(None).cast("binary")),
            "lo": F.min(number), "hi": F.max(number), "min_at": F.min(at).cast("timestamp_ntz"), "max_at": F.max(at).cast("timestamp_ntz"),
            "min_length": F.min(F.length(text)), "max_length": F.max(F.length(text)), "length_sum": F.sum(F.length(text))}


def column_sketches(df: DataFrame, table: str, columns=None) -> DataFrame:
    """One row per column (``STORED``) from one scan that shuffles a few kilobytes per column and task.

    NaN counts as NULL, infinities take no part in the quartiles.  A table without rows has rows with counts of 0.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields, 1) if columns is None or f.name in set(columns)]
    out = []
    for at in range(0, len(fields), COLUMNS_PER_SCAN):
        some = [(i, f, _facts(f)) for i, f in fields[at:at + COLUMNS_PER_SCAN]]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *[a.alias(f"{n}_{i}") for i, _, facts in some for n, a in facts.items()])
        out.append(row.select(F.lit(table).alias("table"), "rows", F.inline(F.array(*[
            F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("column"), F.lit(C.kind_of(f.dataType)).alias("kind"),
                     *[F.col(f"{n}_{i}").alias(n) for n in facts]) for i, f, facts in some]))))
    return C.union_all(out).select(*STORED)


def merged(sketches: DataFrame) -> DataFrame:
    """Stored rows of the same columns, of different files or days, as one row per column."""
    both = lambda f, *names: [f(n).alias(n) for n in names]
    return sketches.groupBy("table", "ord", "column", "kind").agg(
        *both(F.sum, "rows", "non_null"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), *both(F.min, "lo"), *both(F.max, "hi"), *both(F.min, "min_at"),
        *both(F.max, "max_at"), *both(F.min, "min_length"), *both(F.max, "max_length"), *both(F.sum, "length_sum")).select(*STORED)


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """The profile that stored rows, one per column, hold; distinct counts and quartiles are estimates."""
    has = F.col("quantile_sketch").isNotNull() & (F.col("non_null") > 0)
    has = has & (F.when(F.col("quantile_sketch").isNotNull(), F.kll_sketch_get_n_double("quantile_sketch")) > 0)
    quartile = lambda q: stat(F.when(has, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))))
    nulls = F.col("rows") - F.col("non_null")
    return sketches.select(
        "table", "ord", "column", "kind", "rows", nulls.alias("null_count"), pct(nulls, F.col("rows")).alias("null_pct"),
        F.when(F.col("non_null") > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0).cast("bigint")).alias("distinct_approx"),
        stat(F.col("lo")).alias("min_val"), stat(F.col("hi")).alias("max_val"),
        quartile(0.25).alias("q25_approx"), quartile(0.5).alias("median_approx"), quartile(0.75).alias("q75_approx"),
        "min_length", "max_length", "length_sum", "min_at", "max_at")


def profile_sketched(tables: dict[str, DataFrame]) -> DataFrame:
    """:func:`sketched_profile` of several tables, each read once."""
    return sketched_profile(C.union_all([column_sketches(df, t) for t, df in tables.items()]))
