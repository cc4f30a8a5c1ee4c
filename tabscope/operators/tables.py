"""Table profile operators: duplicates, null cells, quality score and issues."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType

from ..functions import forms, rules
from ..functions.exprs import col, hundredths, pct, pct_text, text as T
from ..sources.scratch import discard, local_frame, own_folder, write_once
from . import cells as C
from .columns import ColumnProfile, profile_columns


#: Fingerprints that occur twice or more and are few enough to be broadcast, 8 bytes each.
FEW_REPEATED = 100_000


def _row(df: DataFrame) -> list[Column]:
    """All cells in normal form, and which of them are NULL."""
    cells = [forms.cell_form(col(f.name), f.dataType) for f in df.schema.fields]
    return [*cells, F.concat(*[F.when(c.isNull(), "-").otherwise("+") for c in cells])]


def _row_digest(df: DataFrame) -> Column:
    """256 bits of a whole row: every cell as text with its length, NULLs and NaNs apart from all texts."""
    texts = [F.hex(c) if isinstance(f.dataType, BinaryType) else c.cast("string") for c, f in zip(_row(df), df.schema.fields)]
    return C.digest(F.concat_ws("|", *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def duplicates_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, duplicate_count, duplicate_pct): rows beyond the first of each equal group.

    NULLs and NaNs are equal, 0.0 and -0.0 as well, timestamps by their instant.  Rows are first counted by a 64-bit
    fingerprint; one that occurs once belongs to a row without a copy.  Only rows whose fingerprint repeats are told
    apart by a 256-bit digest, so a table without copies shuffles 8 bytes a row.
    """
    spark = next(iter(tables.values())).sparkSession
    listed = local_frame(spark, list(enumerate(tables)), "tid int, table string")
    print_of = {t: F.xxhash64(*_row(df)) if df.columns else F.lit(0).cast("bigint") for t, df in tables.items()}
    prints = C.union_all([df.select(F.lit(i).alias("tid"), print_of[t].alias("print")) for i, (t, df) in enumerate(tables.items())])
    counted = write_once(prints.groupBy("tid", "print").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "tid", F.when(F.col("n") > 1, F.col("print")).alias("print")).agg(F.sum("n").alias("n")), "prints")
    repeated = {r["tid"]: r["m"] for r in counted.filter("print IS NOT NULL").groupBy("tid").agg(F.count(F.lit(1)).alias("m")).collect()}
    groups = [counted.select("tid", F.when(F.col("print").isNull(), F.col("n")).otherwise(0).alias("groups"), "n")]
    for i, (t, df) in enumerate(tables.items()):
        if i in repeated:
            rows = df.select(print_of[t].alias("print"), _row_digest(df).alias("row"))
            if repeated[i] <= FEW_REPEATED:
                rows = rows.join(F.broadcast(counted.filter((F.col("tid") == i) & F.col("print").isNotNull()).select("print")), "print", "left_semi")
                none = F.lit(0)
            else:  # most rows may have copies: all are told apart, and the single ones are counted here instead
                none = -F.coalesce(F.sum(F.when(F.col("n") == 1, 1)), F.lit(0))
            told = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
            groups.append(told.agg((F.count(F.lit(1)) + none).alias("groups")).select(F.lit(i).alias("tid"), "groups", F.lit(0).cast("bigint").alias("n")))
    dup = F.col("rows") - F.col("groups")
    summed = C.union_all(groups).groupBy("tid").agg(F.sum("n").alias("rows"), F.sum("groups").alias("groups"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return (listed.join(summed, "tid", "left").select("table", zero("rows"), zero("groups"))
            .select("table", "rows", dup.alias("duplicate_count"), pct(dup, F.col("rows")).alias("duplicate_pct")))


def duplicate_rows(df: DataFrame, table: str) -> DataFrame:
    """:func:`duplicates_of` one table."""
    return duplicates_of({table: df})


def null_cells(columns: DataFrame) -> DataFrame:
    """(table, total_null_cells, null_pct) from column null counts."""
    cells = F.sum("rows")
    return columns.groupBy("table").agg(
        F.sum("null_count").alias("total_null_cells"),
        pct(F.sum("null_count"), cells).alias("null_pct"))


def quality_score(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(table, quality_score): 100 less half the mean null share and 0.3 of the duplicate share.

    Computed from the already rounded shares in integers: nulls and duplicates count in
    hundredths of a percent, the score in tenths, halves up.
    """
    per = columns.groupBy("table").agg(F.sum(hundredths(F.col("null_pct"))).alias("nulls"),
                                       F.count(F.lit(1)).alias("width"))
    width = F.col("width")
    penalty = F.least(hundredths(F.col("duplicate_pct")) * 3, F.lit(30000))
    tenths = width * 100000 - F.col("nulls") * 5 - width * penalty
    rounded = F.call_function("div", tenths * 2 + width * 100, width * 200)
    return (per.join(duplicates, "table")
            .select("table", (F.greatest(F.least(rounded, F.lit(1000)), F.lit(0)) / 10).alias("quality_score")))


def quality_issues(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(table, ord, rule, issue): what a reader should look at, in report order."""
    nulls, share = F.col("null_pct"), pct_text(F.col("null_pct"), 0)
    dup = (duplicates.filter("duplicate_pct > 10").select(
        "table", F.lit(0).alias("ord"), F.lit(0).alias("rule"),
        T(rules.ISSUE_DUPLICATES, pct_text(F.col("duplicate_pct"), 1)).alias("issue")))
    entry = lambda rule, issue: F.struct(F.lit(rule).alias("rule"), issue.alias("issue"))
    found = F.array_compact(F.array(
        F.when(nulls > 80, entry(1, T(rules.ISSUE_NULL, "column", share)))
        .when(nulls > 50, entry(1, T(rules.ISSUE_MAJORITY_NULL, "column", share))),
        F.when(F.col("is_constant"), entry(2, T(rules.ISSUE_CONSTANT, "column"))),
        F.when(F.col("pii_detected").isNotNull(), entry(3, T(rules.ISSUE_PII, "column", "pii_detected")))))
    return dup.unionByName(columns.select("table", "ord", F.inline(found)))


def bounded(df: DataFrame, max_rows: int, order_by: list[str]) -> DataFrame:
    """At most ``max_rows`` rows, the first by ``order_by``; all rows when there are no more.

    Opt-in (deviation V1): profiles read whole tables unless a bound is asked for.
    """
    if max_rows <= 0:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [F.to_json(col(c)) if isinstance(types.get(c), (MapType, VariantType, ArrayType, StructType)) else col(c) for c in order_by]
    return df.orderBy(*keys).limit(max_rows)


# columns profiled by one set of jobs
COLUMNS_PER_BATCH = 400


class Profile(NamedTuple):
    """Everything known about the data of a set of tables."""
    tables: DataFrame
    columns: DataFrame
    issues: DataFrame
    histogram: DataFrame
    top_values: DataFrame
    trend: DataFrame
    failed: DataFrame       # (table, error) of tables that could not be read
    folder: str = ""        # where the frames were written

    def close(self) -> None:
        """Delete what the run wrote; its frames cannot be read any more."""
        discard(self.tables.sparkSession, self.folder)


def _profile(tables: dict[str, DataFrame], top_n: int) -> tuple[DataFrame, ColumnProfile, DataFrame]:
    spark = next(iter(tables.values())).sparkSession
    parts = profile_columns(tables, top_n)
    per = parts.columns.groupBy("table").agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("column_count"),
        F.max("is_unique").alias("has_key"))
    # One flag per table: a table with a unique column has no duplicate rows, so the
    # shuffle of its whole rows is left out.
    known = {r["table"]: r["rows"] for r in per.filter("has_key").select("table", "rows").collect()}
    unknown = {t: df for t, df in tables.items() if t not in known}
    counted = [duplicates_of(unknown)] if unknown else []
    free = local_frame(spark, [(t, n, 0, 0.0) for t, n in known.items()],
                       "table string, rows bigint, duplicate_count bigint, duplicate_pct double")
    duplicates = write_once(C.union_all([free, *counted]), "duplicates")
    listed = local_frame(spark, [(t,) for t in tables], "table string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    table_rows = (
        listed.join(per.drop("has_key"), "table", "left")
        .join(null_cells(parts.columns), "table", "left")
        .join(duplicates.select("table", "duplicate_count", "duplicate_pct"), "table", "left")
        .join(quality_score(parts.columns, duplicates), "table", "left")
        .select("table", zero(F.col("rows")).alias("row_count"), zero(F.col("rows")).alias("profiled_rows"),
                zero(F.col("column_count")).alias("column_count"),
                zero(F.col("total_null_cells")).alias("total_null_cells"),
                F.coalesce("null_pct", F.lit(0.0)).alias("null_pct"),
                zero(F.col("duplicate_count")).alias("duplicate_count"),
                F.coalesce("duplicate_pct", F.lit(0.0)).alias("duplicate_pct"),
                F.coalesce("quality_score", F.lit(100.0)).alias("quality_score")))
    return write_once(table_rows, "tables"), parts, duplicates


TABLE_ROWS = ("table string, row_count bigint, profiled_rows bigint, column_count bigint, total_null_cells bigint, "
              "null_pct double, duplicate_count bigint, duplicate_pct double, quality_score double")


def _nothing(spark: SparkSession) -> Profile:
    """The frames of a run over no table."""
    none = {"": local_frame(spark, [], "x string")}
    return Profile(*[df.filter(F.lit(False)) for df in _finish(none, none, rules.TOP_N, 0)[:7]])


def _batches(tables: dict[str, DataFrame]) -> list[dict[str, DataFrame]]:
    """Tables in groups of a bounded number of columns, so that plans stay a workable size."""
    groups, width = [{}] if tables else [], 0
    for t, df in tables.items():
        if groups[-1] and width + len(df.columns) > COLUMNS_PER_BATCH:
            groups.append({})
            width = 0
        groups[-1][t] = df
        width += len(df.columns)
    return groups


def _finish(whole: dict[str, DataFrame], scanned: dict[str, DataFrame], top_n: int, bounded_to: int) -> Profile:
    spark = next(iter(whole.values())).sparkSession
    rows, parts, duplicates = _profile(scanned, top_n)
    if bounded_to > 0:
        counts = C.union_all([df.agg(F.count(F.lit(1)).alias("whole")).select(F.lit(t).alias("table"), "whole")
                              for t, df in whole.items()])
        rows = rows.join(counts, "table").withColumn("row_count", F.col("whole")).drop("whole")
    sampled = rows.select("table", (F.col("profiled_rows") < F.col("row_count")).alias("is_sampled"))
    return Profile(rows, parts.columns, quality_issues(parts.columns, duplicates), parts.histogram,
                   parts.top_values, parts.trend.join(sampled, "table"),
                   local_frame(spark, [], "table string, error string"))


def profile_tables(tables: dict[str, DataFrame], top_n: int = rules.TOP_N,
                   max_rows: int = 0, order_by: dict[str, list[str]] | None = None) -> Profile:
    """Profile a set of tables.

    The tables go through the same few jobs, in batches when they have very many columns.
    When the jobs of a batch fail, its tables are profiled one by one and the ones that
    cannot be read end up in ``failed`` (deviation V9), with the whole message and, in ``tables``, -1 rows.  With ``max_rows`` each table is
    read up to that many rows in the order given by ``order_by``; ``row_count`` then still
    is the count of the whole table.  The frames lie in a folder of the run; ``close`` deletes it.
    """
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    with own_folder(spark) as folder:
        return _profile_all(spark, tables, top_n, max_rows, order_by, folder)


def _profile_all(spark, tables, top_n, max_rows, order_by, folder) -> Profile:
    good, failed = [], []
    for batch in _batches(tables):
        scanned = {t: bounded(df, max_rows, (order_by or {}).get(t, df.columns)) for t, df in batch.items()}
        try:
            good.append(_finish(batch, scanned, top_n, max_rows))
            continue
        except Exception:
            pass  # which table it was, and why, is found below
        for t in batch:
            try:
                good.append(_finish({t: batch[t]}, {t: scanned[t]}, top_n, max_rows))
            except Exception as error:
                failed.append((t, str(error)))
    if len(good) == 1 and not failed:
        return good[0]._replace(folder=folder)
    merged = [C.union_all([p[i] for p in [*good, _nothing(spark)]]) for i in range(6)]
    unknown = local_frame(spark, [(t, -1, -1, 0, 0, 0.0, 0, 0.0, 100.0) for t, _ in failed], TABLE_ROWS)
    return Profile(merged[0].unionByName(unknown), *merged[1:], local_frame(spark, failed, "table string, error string"), folder)
