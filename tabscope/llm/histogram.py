"""Exact token counts from a length histogram.

Documents are counted by encoded length; suffix sums over the histogram then answer, for every
context limit, how many documents and tokens lie above it and what truncation at it would keep.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import key, written

#: Lengths of one window partition; windows over all bands see one row per band.
BAND = 4096


def length_histogram(lengths: DataFrame, group: str, length: str = "n_tokens") -> DataFrame:
    """One row per group and distinct length with suffix sums.

    Columns: ``group, n_tokens, n_docs, docs_at_least, tokens_at_least, docs_below, truncated_tokens,
    group_docs, group_tokens``; ``truncated_tokens`` is the sum of min(length, n_tokens), what remains when
    every document is cut at this length.  Counting combines before the shuffle and is written, so lengths are
    found once; suffix sums run in bands of lengths, so no task holds more than one band of one group.  A null group is a group of
    its own, a null length counts as 0, an empty table gives no rows.
    """
    counts = (lengths.groupBy(key(group, "grp"), F.coalesce(key(length), F.lit(0)).cast("long").alias("n_tokens"))
              .agg(F.count(F.lit(1)).alias("n_docs")))
    counted = (written(counts, "lengths")
               .withColumn("band", F.floor(F.col("n_tokens") / BAND))
               .withColumn("tokens", F.col("n_docs") * F.col("n_tokens")))
    whole = Window.partitionBy("grp")
    later = whole.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bands = (counted.groupBy("grp", "band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
             .select(F.col("grp").alias("g"), F.col("band").alias("b"),
                     F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
                     F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
                     F.sum("d").over(whole).alias("group_docs"), F.sum("t").over(whole).alias("group_tokens")))
    down = Window.partitionBy("grp", "band").orderBy(F.col("n_tokens").desc())
    out = (counted.join(bands, F.col("grp").eqNullSafe(F.col("g")) & (F.col("band") == F.col("b")))
           .withColumn("docs_at_least", F.sum("n_docs").over(down) + F.col("docs_after"))
           .withColumn("tokens_at_least", F.sum("tokens").over(down) + F.col("tokens_after")))
    below = F.col("group_tokens") - F.col("tokens_at_least")
    return out.select(F.col("grp").alias(group), "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
                      (F.col("group_docs") - F.col("docs_at_least")).alias("docs_below"),
                      (below + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
                      "group_docs", "group_tokens")


def _first_rows(histogram: DataFrame, group: str, label: str, values: list, reached) -> DataFrame:
    """``grp, label, group_docs, group_tokens, row``: for each group and value its least length that ``reached(value)`` accepts.

    ``row`` is null without one.  One grouping answers all values; tasks send one row a group.
    """
    row = F.struct("n_tokens", "n_docs", "docs_at_least", "tokens_at_least")
    each = [F.struct(F.lit(v).alias(label), F.min(F.when(reached(v), row)).alias("row")) for v in values]
    if not each:
        raise ValueError(f"no {label}")
    return (histogram.groupBy(key(group, "grp"))
            .agg(F.max("group_docs").alias("group_docs"), F.max("group_tokens").alias("group_tokens"), F.array(*each).alias("each"))
            .select("grp", "group_docs", "group_tokens", F.inline("each")))


def _from_suffixes(rows: DataFrame, length, share, answer: str, group: str) -> DataFrame:
    """Histogram rows for any ``length``, from the suffix sums of the first one at or above it."""
    docs, tokens = (F.coalesce(F.col(f"row.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    return rows.select(F.col("grp").alias(group), F.lit(answer).alias("answer"), share.cast("double").alias("share"), length.alias("n_tokens"),
                       F.when(F.col("row.n_tokens") == length, F.col("row.n_docs")).otherwise(0).alias("n_docs"),
                       docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), (F.col("group_docs") - docs).alias("docs_below"),
                       (F.col("group_tokens") - tokens + docs * length).alias("truncated_tokens"), "group_docs", "group_tokens")


def limit_answers(histogram: DataFrame, limits: list[int], group: str) -> DataFrame:
    """For every group and context limit the columns of the histogram, ``answer`` 'limit' and a null ``share``.

    ``n_tokens`` is the limit, which need not be the length of any document: documents and tokens of at least that
    length, documents below it, and the tokens that remain when all are cut there.  All come from the suffix sums at
    the next length, without adding anything up again; above the longest document they are 0.  Limits that repeat are
    answered each; a null group is one of its own; an empty histogram gives no rows.
    """
    rows = _first_rows(histogram, group, "context_limit", [int(x) for x in limits], lambda x: F.col("n_tokens") >= x)
    return _from_suffixes(rows, F.col("context_limit").cast("long"), F.lit(None), "limit", group)


def quantiles(histogram: DataFrame, shares: list[float], group: str) -> DataFrame:
    """For every group and ``share`` the histogram's row, ``answer`` 'quantile', of the smallest length that at least that share of
    its documents does not exceed.

    A share of 0 or less gives the shortest length, one above 1 no row.  Nulls and empty input as in `limit_answers`.
    """
    rows = _first_rows(histogram, group, "share", [float(s) for s in shares],
                       lambda s: F.col("docs_below") + F.col("n_docs") >= F.lit(s) * F.col("group_docs"))
    return _from_suffixes(rows.filter(F.col("row").isNotNull()), F.col("row.n_tokens"), F.col("share"), "quantile", group)


def answers(histogram: DataFrame, group: str, limits: list[int], shares: list[float]) -> DataFrame:
    """The histogram as rows with ``answer`` 'length', with those of `limit_answers` and `quantiles`."""
    histogram = written(histogram, "histogram")
    lengths = histogram.withColumns({"answer": F.lit("length"), "share": F.lit(None).cast("double")})
    return lengths.unionByName(limit_answers(histogram, limits, group)).unionByName(quantiles(histogram, shares, group))
