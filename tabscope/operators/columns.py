"""Column profile operators.

Cells and intermediate results are keyed by the column number ``cid``, results by ``table``
and ``ord``, the position of the column in its table.
Frames that hold a few rows per column are joined without hints: their size is known to
the optimizer, which broadcasts them below its limit and shuffles them beyond it.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.exprs import (col, double_text, month_of, pct, share_reaches, stat, timestamp_text)
from ..sources.scratch import local_frame, together, write_once
from . import cells as C

KEY = ["cid"]
NAMED = ["cid", "table", "ord", "column"]


def _half_up(total: Column, n: Column, digits: int) -> Column:
    """``round(total / n, digits)`` in integers, halves up."""
    scaled = F.call_function("div", total.cast("decimal(30,0)") * (2 * 10 ** digits) + n,
                             F.nullif(n * 2, F.lit(0)).cast("decimal(26,0)"))
    return scaled.cast("double") / (10 ** digits)


# ---------------------------------------------------------------- one-scan operators
def _wide(df: DataFrame, table: str, per_column, columns=None, chunk: int = 40) -> DataFrame:
    """Aggregate every column in one scan and turn the single row into one row per column.

    ``per_column(field)`` gives the named aggregates.  Columns are taken in chunks, which
    keeps each aggregate within what code generation compiles into one method.
    """
    kinds = [(i, f) for i, f in enumerate(df.schema.fields, 1) if columns is None or f.name in set(columns)]
    out = []
    for at in range(0, len(kinds), chunk):
        aggs, structs = [], []
        for i, f in kinds[at:at + chunk]:
            named = per_column(f)
            aggs += [a.alias(f"{n}_{i}") for n, a in named.items()]
            structs.append(F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("column"),
                                    *[F.col(f"{n}_{i}").alias(n) for n in named]))
        row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
        out.append(row.select(F.lit(table).alias("table"), "rows", F.inline(F.array(*structs))))
    return C.union_all(out)


def null_profile(df: DataFrame, table: str, columns=None) -> DataFrame:
    """(table, ord, column, rows, null_count, null_pct) from one scan without a wide shuffle."""
    counted = _wide(df, table, lambda f: {"non_null": F.count(C.normal(f))}, columns)
    nulls = F.col("rows") - F.col("non_null")
    return counted.select("table", "ord", "column", "rows", nulls.alias("null_count"),
                          pct(nulls, F.col("rows")).alias("null_pct"))


def approximate_summary(df: DataFrame, table: str, columns=None, rsd: float = 0.02,
                        accuracy: int = 10000) -> DataFrame:
    """Distinct counts and quartiles from bounded sketches: one scan, one small shuffle.

    For tables whose exact distinct values are too many to shuffle at all.
    """
    def sketches(f):
        v = C.normal(f)
        numeric = C.kind_of(f.dataType) == C.NUMERIC
        quart = (F.percentile_approx(v.cast("double"), [0.25, 0.5, 0.75], accuracy) if numeric
                 else F.first(F.lit(None).cast("array<double>")))
        return {"non_null": F.count(v), "distinct_approx": F.approx_count_distinct(
            C.as_text(f) if C.kind_of(f.dataType) == C.TEXT else v, rsd),
            "quartiles": quart,
            "mean": F.avg(v.cast("double")) if numeric else F.first(F.lit(None).cast("double")),
            "std": F.stddev_samp(v.cast("double")) if numeric else F.first(F.lit(None).cast("double"))}
    wide = _wide(df, table, sketches, columns, chunk=20)
    return wide.select(
        "table", "ord", "column", "rows", (F.col("rows") - F.col("non_null")).alias("null_count"),
        "distinct_approx", stat(F.col("mean")).alias("mean_val"), stat(F.col("std")).alias("std_val"),
        *[F.col("quartiles")[i].alias(n) for i, n in enumerate(["q25", "median_val", "q75"])])


# ---------------------------------------------------------------- cells of many tables
class Cells(NamedTuple):
    """Value frequencies of a set of tables, with the names of their columns.

    ``texts`` and ``times`` are the cells one by one, for what needs no distinct values.
    """
    names: DataFrame
    numeric: DataFrame
    text: DataFrame
    time: DataFrame
    texts: DataFrame
    times: DataFrame


def gather(tables: dict[str, DataFrame], columns=None) -> Cells:
    """Value-frequency frames of ``tables``; nothing runs until they are read."""
    bases = C.column_bases(tables)
    numeric, texts, times = [C.union_all([make(df, bases[t], columns) for t, df in tables.items()])
                             for make in (C.numeric_cells, C.text_values, C.time_values)]
    return Cells(C.column_names(tables, columns), numeric, C.text_cells(texts), C.counted(times), texts, times)


def distinct_profile(tables: dict[str, DataFrame], columns=None) -> DataFrame:
    """(table, ord, column, rows, null_count, distinct_count, distinct_pct), exact."""
    cells = gather(tables, columns)
    counts = [f.groupBy(*KEY).agg(
        F.sum("freq").alias("rows"),
        F.sum(F.when(F.col(v).isNull(), F.col("freq")).otherwise(0)).alias("null_count"),
        F.count(v).alias("distinct_count"))
        for f, v in ((cells.numeric, "num"), (cells.text, "len"), (cells.time, "at"))]
    return (C.union_all(counts).join(cells.names, KEY)
            .withColumn("distinct_pct", pct(F.col("distinct_count"), F.col("rows"))))


def key_candidates(profile: DataFrame) -> DataFrame:
    """Constant and unique flags from null and distinct counts."""
    n, d, z = F.col("rows"), F.col("distinct_count"), F.col("null_count")
    return (profile.withColumn("is_constant", (d == 1) & (z < n))
            .withColumn("is_unique", (d == n) & (z == 0)))


# ---------------------------------------------------------------- numeric branch
class Numeric(NamedTuple):
    summary: DataFrame      # one row per numeric column
    ranged: DataFrame       # cells with the range of their value
    fences: DataFrame       # per column: bounds for bins and outliers


#: Ranges of values per power of two, the power below which no double lies, and the range of infinity.
STEPS, LOWEST = 64, 1080
ENDLESS = 2200 * STEPS
#: Distinct values in a range that is numbered row by row; wider ones are split into so many first.
RANGE_VALUES = 100_000
SPLIT = 4096


def range_of(num: Column) -> Column:
    """The number of a value's range, never falling as values rise: 64 ranges to a power of two, 0 apart."""
    size = F.abs(num)
    at = F.floor(F.log2(size) * STEPS) + LOWEST * STEPS
    at = F.when(size < float("inf"), at).otherwise(ENDLESS)
    return F.when(num == 0, F.lit(0).cast("bigint")).when(num > 0, at).when(num < 0, -at)


def _octave(part: Column) -> Column:
    """The power of two below the values of a range."""
    return F.floor(F.abs(part) / STEPS) - LOWEST


def rank_ranges(cells: DataFrame) -> DataFrame:
    """Numeric cells with the range ``part`` that their value is in, written once."""
    return write_once(cells.withColumn("part", range_of(F.col("num"))), "ranges")


def _places(ranks: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Ranks with the range that holds them: ranges (group, part, n, values, lo, hi), in the order of ``lo``."""
    reach = (ranges.withColumn("upto", F.sum("n").over(W.partitionBy(*group).orderBy("lo")))
             .withColumn("below", F.col("upto") - F.col("n")))
    held = ranks.join(reach.select(*group, "values", "lo", "hi", "below", "upto"), group)
    start = F.col("before") + F.col("below")
    return (held.filter((F.col("rank") >= start) & (F.col("rank") < F.col("before") + F.col("upto")))
            .select(*KEY, "q", "share", "side", "rank", start.alias("before"), "values", "lo", "hi"))


def _quartiles(ranged: DataFrame, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Exact 25/50/75 percentiles with linear interpolation, by rank selection.

    Counts per range (a few hundred rows a column) say which range holds a wanted rank.  A range with many distinct values is
    split evenly between its least and largest value and counted again, until few are left; only these are numbered
    row by row.  Cells are neither sorted nor shuffled as a whole.
    """
    ranks = (counts.filter("n > 0")
             .select(*KEY, "n", F.explode(F.array(*[F.lit(q) for q in (25, 50, 75)])).alias("q"))
             .withColumn("scaled", (F.col("n") - 1) * F.col("q"))
             .withColumn("low", F.call_function("div", F.col("scaled"), F.lit(100)))
             .withColumn("share", (F.col("scaled") % 100) / 100)
             .select(*KEY, "q", "share", F.explode(F.array(
                 F.struct(F.lit(0).alias("side"), F.col("low").alias("rank")),
                 F.struct(F.lit(1).alias("side"), F.least(F.col("low") + 1, F.col("n") - 1).alias("rank"))
             )).alias("want")).select(*KEY, "q", "share", "want.*", F.lit(0).cast("bigint").alias("before")))
    known = parts.filter("n > 0").select(*KEY, "n", F.col("distinct_count").alias("values"), "lo", "hi")
    wanted = write_once(_places(ranks, known, KEY), "ranks")
    settled, wide = [], (F.col("values") > RANGE_VALUES) & (F.col("lo") < F.col("hi"))
    while not wanted.filter(wide).isEmpty():
        settled.append(wanted.filter(~wide))
        many = wanted.filter(wide).withColumnsRenamed({"lo": "from", "hi": "to"}).drop("values")
        spans = many.select(*KEY, "from", "to").distinct()
        inside = (ranged.filter("num IS NOT NULL").join(spans, KEY).filter((F.col("num") >= F.col("from")) & (F.col("num") <= F.col("to")))
                  .withColumn("part", F.least(F.floor((F.col("num") - F.col("from")) / (F.col("to") - F.col("from")) * SPLIT), F.lit(SPLIT - 1))))
        finer = inside.groupBy(*KEY, "from", "part").agg(F.sum("freq").alias("n"), F.count("num").alias("values"),
                                                         F.min("num").alias("lo"), F.max("num").alias("hi"))
        wanted = write_once(_places(many.drop("to"), finer.drop("part"), [*KEY, "from"]), "ranks")
    wanted = C.union_all([*settled, wanted])
    numbered = (
        ranged.filter("num IS NOT NULL")
        .join(wanted.select(*KEY, "lo", "hi", "before").distinct(), KEY)
        .filter((F.col("num") >= F.col("lo")) & (F.col("num") <= F.col("hi")))
        .withColumn("end", F.col("before") + F.sum("freq").over(
            W.partitionBy(*KEY, "lo").orderBy("num")
            .rowsBetween(W.unboundedPreceding, W.currentRow)))
        .select(*KEY, "lo", "num", "end", (F.col("end") - F.col("freq")).alias("start")))
    found = (numbered.join(wanted.drop("before", "hi", "values"), [*KEY, "lo"])
             .filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))))
    at = {(q, s): F.max(F.when((F.col("q") == q) & (F.col("side") == s), F.col("num")))
          for q in (25, 50, 75) for s in (0, 1)}
    share = {q: F.max(F.when(F.col("q") == q, F.col("share"))) for q in (25, 50, 75)}
    return found.groupBy(*KEY).agg(*[
        F.when(at[q, 0] == at[q, 1], at[q, 0])
        .otherwise(at[q, 0] + (at[q, 1] - at[q, 0]) * share[q]).alias(f"p{q}")
        for q in (25, 50, 75)])


# ---------------------------------------------------------------- sums that do not depend on order
LIMB = 40


def _scale(largest: Column) -> Column:
    """A power of two that brings values up to ``largest`` just below 2^40."""
    power = F.lit(float(LIMB)) - (F.floor(F.log2(largest)) + 2)
    return F.when(largest > 0, F.pow(F.lit(2.0), F.least(power, F.lit(1000.0)))).otherwise(F.lit(1.0))


def _limb_sums(value: Column, scale: Column, freq: Column, name: str) -> list[Column]:
    """Sums of three 40-bit integer parts of ``value * scale``, each exact whatever the order of rows.

    120 bits below the largest value take part; what lies below them is cut off value by value.
    """
    out, rest = [], value * scale
    for k in range(3):
        part = rest.cast("bigint")  # towards zero, so that the rest is exact
        out.append(F.sum(part.cast("decimal(13,0)") * freq.cast("decimal(19,0)")).alias(f"{name}{k}"))
        rest = (rest - part) * F.lit(float(2 ** LIMB))
    return out


def _limb_total(name: str, scale: Column) -> Column:
    high = F.col(f"{name}0").cast("decimal(25,0)") * F.lit(2 ** LIMB).cast("decimal(13,0)") + F.col(f"{name}1")
    return (high.cast("double") + F.col(f"{name}2").cast("double") / float(2 ** LIMB)) / float(2 ** LIMB) / scale


def _limb_terms(name: str, scale: Column) -> Column:
    """Doubles that add up to the sum exactly: two for each part."""
    limb = F.lit(2 ** LIMB).cast("decimal(13,0)")
    out = []
    for k in range(3):
        part, unit = F.col(f"{name}{k}").cast("decimal(38,0)"), F.lit(float(2.0 ** (LIMB * k)))
        low = part % limb
        out += [F.call_function("div", part, limb).cast("double") * float(2 ** LIMB) / unit / scale, low.cast("double") / unit / scale]
    return F.array(*out)


def _added(terms: Column) -> Column:
    """The sum of the terms of all ranges, a few thousand at most, in the order of the ranges; what each step rounds off is kept."""
    every = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("terms").isNotNull(), terms))), lambda x: x["terms"]))

    def step(acc, x):
        s, t = acc["s"], acc["s"] + x
        off = F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)
        return F.struct(t.alias("s"), (acc["c"] + off).alias("c"))

    return F.aggregate(every, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda acc: acc["s"] + acc["c"])


def _bin(num: Column, lo: Column, width: Column) -> Column:
    """0..9 by comparison with the edges ``i * width + lo``; the last bin is closed."""
    return sum([F.when(num >= F.lit(float(i)) * width + lo, 1).otherwise(0)
                for i in range(1, rules.HISTOGRAM_BINS)], F.lit(0))


def numeric_profile(names: DataFrame, cells: DataFrame) -> Numeric:
    """Counts, moments, quartiles and outliers of every numeric column.

    A few passes over the written cells, each of which shuffles a few rows per column; the cells themselves are
    shuffled once, by the grouping that makes them.  Mean and deviation come from exact sums, so they do not depend
    on how rows are split into tasks.
    """
    ranged = rank_ranges(cells)
    has = F.col("num").isNotNull()
    # every range has a grid of its own for exact sums, which its number gives, so counts and sums are one pass
    scale = F.pow(F.lit(2.0), F.least(F.lit(float(LIMB)) - (_octave(F.col("part")) + 2), F.lit(1000.0)))
    endless = F.abs(F.col("part")) == ENDLESS
    sums = ranged.groupBy(*KEY, "part").agg(
        F.sum(F.when(has, F.col("freq")).otherwise(0)).alias("n"),
        F.sum(F.when(has, 0).otherwise(F.col("freq"))).alias("null_count"),
        F.count("num").alias("distinct_count"),
        F.min("num").alias("lo"), F.max("num").alias("hi"),
        *_limb_sums(F.when(~endless & (F.col("part") != 0), F.col("num")).otherwise(0.0), scale, F.col("freq"), "sum"))
    finite = ~endless & (F.col("part") != 0)
    parts = write_once(sums.withColumn("terms", F.when(finite, _limb_terms("sum", scale)))
                       .withColumn("endless", F.when(endless, F.col("lo"))).drop("sum0", "sum1", "sum2"), "parts")
    counts = parts.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("null_count").alias("null_count"),
        F.sum("distinct_count").alias("distinct_count"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.coalesce(F.sum("endless"), _added(F.struct("part", "terms"))).alias("total")
    ).withColumn("mean", F.try_divide("total", "n")).drop("total")
    flat = F.col("hi") == F.col("lo")
    finite = (F.abs("lo") < float("inf")) & (F.abs("hi") < float("inf")) & (F.col("kind") == C.NUMERIC)
    iqr = F.col("p75") - F.col("p25")
    fences = write_once(
        counts.join(_quartiles(ranged, parts, counts), KEY, "left")
        .join(names.select(*NAMED, "kind"), KEY)
        .withColumn("bin_from", F.when(finite, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))))
        .withColumn("bin_to", F.when(finite, F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))))
        .withColumn("bin_width", (F.col("bin_to") - F.col("bin_from")) / rules.HISTOGRAM_BINS)
        .withColumn("out_below", F.when(iqr > 0, F.col("p25") - rules.IQR_FACTOR * iqr))
        .withColumn("out_above", F.when(iqr > 0, F.col("p75") + rules.IQR_FACTOR * iqr)), "fences")
    outside = (F.col("num") < F.col("out_below")) | (F.col("num") > F.col("out_above"))
    away = F.col("num") - F.col("mean")
    farthest = F.greatest(F.abs(F.col("lo") - F.col("mean")), F.abs(F.col("hi") - F.col("mean")))
    bounded = farthest * farthest < float("inf")
    spread = (ranged.filter(has)
              .join(fences.select(*KEY, "mean", "out_below", "out_above",
                                  F.when(bounded, _scale(farthest * farthest)).alias("scale")), KEY)
              .groupBy(*KEY, "scale").agg(
                  *_limb_sums(away * away, F.col("scale"), F.col("freq"), "square"),
                  F.sum(F.when(outside, F.col("freq")).otherwise(0)).alias("outside"))
              .select(*KEY, "outside", F.when(F.col("scale").isNull(), F.lit(float("inf")))
                      .otherwise(_limb_total("square", F.col("scale"))).alias("squares")))
    rows, is_num = F.col("n") + F.col("null_count"), F.col("kind") == C.NUMERIC
    outliers = F.when(is_num & F.col("out_below").isNotNull(), F.col("outside"))
    summary = fences.join(spread, KEY, "left").select(
        *NAMED, rows.alias("rows"), "null_count", "distinct_count",
        stat(F.col("lo")).alias("min_val"), stat(F.col("hi")).alias("max_val"),
        stat(F.col("mean")).alias("mean_val"), stat(F.col("p50")).alias("median_val"),
        F.when(F.col("n") > 1, stat(F.sqrt(F.col("squares") / (F.col("n") - 1)))).alias("std_val"),
        F.when(is_num, stat(F.col("p25"))).alias("q25"), F.when(is_num, stat(F.col("p75"))).alias("q75"),
        outliers.alias("outlier_count"),
        F.when(outliers.isNotNull(), pct(outliers, rows)).alias("outlier_pct"))
    return Numeric(summary, ranged, fences)


def histogram(numeric: Numeric) -> DataFrame:
    """(table, ord, column, bin, bin_lo, bin_hi, count): ten bins per column, empty ones kept.

    The edges are numbers (deviation V8); a label is made by the report that needs one.
    """
    bounds = numeric.fences.filter("bin_width IS NOT NULL").select(*NAMED, "bin_from", "bin_to", "bin_width")
    counted = (numeric.ranged.filter("num IS NOT NULL")
               .join(bounds.drop("table", "ord", "column"), KEY)
               .withColumn("bin", _bin(F.col("num"), F.col("bin_from"), F.col("bin_width")))
               .groupBy(*KEY, "bin").agg(F.sum("freq").alias("count")))
    last = rules.HISTOGRAM_BINS - 1
    edge = lambda i: i.cast("double") * F.col("bin_width") + F.col("bin_from")
    return (bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last))))
            .join(counted, [*KEY, "bin"], "left")
            .select("table", "ord", "column", "bin", edge(F.col("bin")).alias("bin_lo"),
                    F.when(F.col("bin") == last, F.col("bin_to"))
                    .otherwise(edge(F.col("bin") + 1)).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


# ---------------------------------------------------------------- text branch
def _slug(label: str) -> str:
    return label.lower().replace(" ", "_")


def _times(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _date_like() -> Column:
    return F.col("txt").rlike(r"^\d{4}-\d{2}-\d{2}")


def _parsed() -> Column:
    return F.when(_date_like(), F.expr("try_cast(txt AS timestamp_ntz)"))


def text_profile(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Counts, lengths, value patterns, personal data and date shares of the text columns.

    ``texts`` are cells one by one, or distinct ones with their number ``freq``; every rule looks at the whole of every
    non-null value (deviation V2), and what is shuffled is one row per column and task.
    """
    n, txt = F.col("n"), F.col("txt")
    freq = F.col("freq") if "freq" in texts.columns else F.lit(1).cast("bigint")
    times = lambda condition: F.sum(F.when(condition, freq).otherwise(0))
    hits = [times(txt.rlike(p)).alias("pattern_" + _slug(l)) for l, p in rules.VALUE_PATTERNS]
    pii = [times(txt.rlike(p)).alias("pii_" + _slug(l)) for l, p in rules.PII_VALUE_PATTERNS]
    counted = texts.groupBy(*KEY).agg(
        times(txt.isNotNull()).alias("n"), times(txt.isNull()).alias("null_count"),
        F.min(F.length("txt")).alias("min_length"), F.max(F.length("txt")).alias("max_length"),
        F.sum(F.length("txt") * freq).alias("length_sum"), times(F.lower("txt").isin(rules.BOOLEAN_WORDS)).alias("boolean_words"),
        times(_date_like()).alias("date_like"), times(_parsed().isNotNull()).alias("date_parsed"), *hits, *pii)
    pattern = F.coalesce(
        F.when((n > 0) & (F.col("boolean_words") == n), "Boolean String"),
        *[F.when((n > 0) & share_reaches(F.col("pattern_" + _slug(l)), n, rules.PATTERN_SHARE_PCT), l)
          for l, _ in rules.VALUE_PATTERNS])
    personal = F.coalesce(
        *[F.when((n > 0) & share_reaches(F.col("pii_" + _slug(l)), n, rules.PII_SHARE_PCT), l)
          for l, _ in rules.PII_VALUE_PATTERNS])
    return (counted.join(names.select(*NAMED), KEY)
            .withColumn("rows", n + F.col("null_count"))
            .withColumn("avg_length", _half_up(F.col("length_sum"), n, 1))
            .withColumn("detected_pattern", pattern).withColumn("pii_detected", personal))


def first_values(df: DataFrame, order_by: list[str], n: int, columns=None) -> DataFrame:
    """Text cells of the first ``n`` non-null values of each column in ``order_by`` order.

    Feeds :func:`text_profile` when the rules shall look at a head of the data only.  The
    group limit keeps ``n`` rows per column and task before the shuffle.
    """
    structs = [F.struct(F.lit(i).alias("cid"), C.as_text(f).alias("v"))
               for i, f in C._fields(df, {C.TEXT}, columns)]
    heads = (df.select(*[col(o).alias(f"o{k}") for k, o in enumerate(order_by)], F.inline(F.array(*structs)))
             .filter("v IS NOT NULL")
             .withColumn("at", F.row_number().over(
                 W.partitionBy("cid").orderBy(*[f"o{k}" for k in range(len(order_by))])))
             .filter(F.col("at") <= n))
    return heads.select("cid", F.col("v").alias("txt"))


# ---------------------------------------------------------------- time branch
def time_profile(names: DataFrame, times: DataFrame) -> DataFrame:
    """Counts and range of the date and timestamp columns, from cells one by one."""
    moment = F.when(F.col("at").isNotNull(), F.struct("micros", "at"))
    return (times.groupBy(*KEY).agg(
        F.count("at").alias("n"), _times(F.col("at").isNull()).alias("null_count"),
        F.min(moment)["at"].alias("min_at"), F.max(moment)["at"].alias("max_at"))
        .join(names.select(*NAMED), KEY)
        .withColumn("rows", F.col("n") + F.col("null_count")))


def date_range(df: DataFrame, table: str, columns=None) -> DataFrame:
    """(table, ord, column, min_date, max_date) from one scan; timestamps stay timestamps."""
    times = [f.name for f in df.schema.fields if C.kind_of(f.dataType) == C.DATETIME
             and (columns is None or f.name in columns)]
    if not times:
        return local_frame(df.sparkSession, [], "table string, ord int, column string, min_date timestamp_ntz, max_date timestamp_ntz")
    local = lambda c: c.cast("timestamp_ntz")
    return (_wide(df, table, lambda f: {"min_date": local(F.min(col(f.name))), "max_date": local(F.max(col(f.name)))}, times)
            .drop("rows"))


# ---------------------------------------------------------------- top values
def _ranked(counted: DataFrame, tie: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent per column; ties by value ascending (deviation V5).

    Spark prunes every task to ``k`` rows per column before the shuffle.
    """
    best = W.partitionBy(*KEY).orderBy(F.desc("freq"), *tie)
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _top(ranked: DataFrame, value: Column, rows: DataFrame) -> DataFrame:
    return (ranked.withColumn("value", value)
            .join(rows.select(*NAMED, "rows"), KEY)
            .select("table", "ord", "column", "rank", "value", F.col("freq").alias("count"),
                    pct(F.col("freq"), F.col("rows"), 1).alias("pct")))


def top_text(cells: DataFrame, texts: DataFrame, rows: DataFrame, k: int = rules.TOP_N) -> DataFrame:
    """Top values of the text columns, each whole; ties go by the whole value.

    The first characters of the k-th value bound what can be among the first k.  Where such a
    value is longer than they are, it is looked up in ``texts`` by its digest.
    """
    known = cells.filter("len IS NOT NULL")
    # one row per column, written so that the cells are joined where they are
    last = write_once(_ranked(known, ["pre"], k).groupBy(*KEY)
                      .agg(F.max(F.struct((-F.col("freq")).alias("less"), "pre")).alias("last"))
                      .select(*KEY, (-F.col("last.less")).alias("least"), F.col("last.pre").alias("upto")), "last")
    close = write_once(known.join(last, KEY).filter(
        (F.col("freq") > F.col("least")) | ((F.col("freq") == F.col("least")) & (F.col("pre") <= F.col("upto"))))
        .select(*KEY, "sha", "len", "pre", "freq"), "close")
    whole = close.filter(F.col("len") <= C.PREFIX).select(*KEY, "freq", F.col("pre").alias("txt"))
    longer = close.filter(F.col("len") > C.PREFIX).select(*KEY, "sha", "freq")
    if not longer.isEmpty():
        whole = whole.unionByName(
            texts.filter(F.length("txt") > C.PREFIX).withColumn("sha", C.digest(F.col("txt")))
            .join(longer, [*KEY, "sha"]).groupBy(*KEY, "sha", "freq").agg(F.min("txt").alias("txt"))
            .select(*KEY, "freq", "txt"))
    return _top(_ranked(whole, ["txt"], k), F.col("txt"), rows)


def _likely(cells: DataFrame, k: int) -> DataFrame:
    """(cid, freq, part): the frequencies and ranges that hold the ``k`` first values of each column, ``k`` rows at most."""
    groups = _ranked(cells.groupBy(*KEY, "freq", "part").agg(F.count(F.lit(1)).alias("n")), ["part"], k)
    before = F.sum("n").over(W.partitionBy(*KEY).orderBy("rank")) - F.col("n")
    return groups.withColumn("before", before).filter(F.col("before") < k).select(*KEY, "freq", "part")


def top_numbers(ranged: DataFrame, rows: DataFrame, kinds: DataFrame, k: int = rules.TOP_N,
                most_distinct: int | None = None) -> DataFrame:
    """Top values of the numeric columns; with ``most_distinct`` only of those with so few distinct values.

    ``rows`` holds the distinct counts; the columns beyond the gate never reach the ranking.  Cells come with their
    range (:func:`rank_ranges`), which rises with the value: counts by frequency and range say which few hold the first
    ``k``, and only cells in these are sorted.  What the cells are joined with is written, so that they stay where they are.
    """
    gate = F.col("distinct_count") >= 1
    if most_distinct is not None:
        gate = gate & (F.col("distinct_count") <= most_distinct)
    few = write_once(rows.filter(gate).select(*KEY).join(kinds.select(*KEY, "kind"), KEY), "few")
    value = (F.when(F.col("kind") == C.BOOLEAN, F.when(F.col("num") == 1, "True").otherwise("False"))
             .otherwise(F.coalesce(F.col("exact"), F.col("whole").cast("string"),
                                   double_text(F.col("num")))))
    known = ranged.filter("num IS NOT NULL").join(few, KEY)
    kept = known.join(write_once(_likely(known, k), "likely"), [*KEY, "freq", "part"])
    return _top(_ranked(kept, ["num", "whole", "exact"], k), value, rows)


def top_years(times: DataFrame, rows: DataFrame, k: int = rules.TOP_N) -> DataFrame:
    """Most frequent years of the time columns, from cells one by one."""
    years = (times.filter("at IS NOT NULL").groupBy(*KEY, F.year("at").alias("year"))
             .agg(F.count(F.lit(1)).alias("freq")))
    return _top(_ranked(years, ["year"], k), F.col("year").cast("string"), rows)


def top_values(tables: dict[str, DataFrame], columns=None, k: int = rules.TOP_N,
               most_distinct: int | None = None) -> DataFrame:
    """Top values of all columns: words and numbers as such, times by year."""
    cells = gather(tables, columns)
    numeric, text = together(cells.names.sparkSession, lambda: rank_ranges(cells.numeric), lambda: write_once(cells.text, "text"))
    rows = {n: write_once(f.groupBy(*KEY).agg(F.sum("freq").alias("rows"), F.count(v).alias("distinct_count")).join(cells.names, KEY), "rows")
            for n, f, v in (("numeric", numeric, "num"), ("text", text, "len"))}
    return C.union_all([top_text(text, cells.texts, rows["text"], k),
                        top_numbers(numeric, rows["numeric"], cells.names, k, most_distinct),
                        top_years(cells.times, time_profile(cells.names, cells.times), k)])


# ---------------------------------------------------------------- months
def trend_columns(text: DataFrame, time: DataFrame) -> DataFrame:
    """(table, column, cid): per table the first column a monthly trend can be drawn from."""
    n, rows = F.col("n"), F.col("rows")
    dated = text.filter((F.col("date_like") * 100 > n * rules.TREND_SHARE_PCT) & (F.col("date_parsed") > 0)
                        & ((rows - F.col("date_parsed")) * 100 <= rows * rules.TREND_BAD_PCT))
    both = dated.select(*NAMED).unionByName(time.filter(n > 0).select(*NAMED))
    return both.groupBy("table").agg(F.min_by("column", "ord").alias("column"), F.min("cid").alias("cid"))


def monthly_trend(cells: Cells, chosen: DataFrame) -> DataFrame:
    """(table, column, period, count) by month of the chosen column of each table.

    The chosen columns are written first: one row per table, which is joined without a shuffle of the cells.
    """
    chosen = write_once(chosen, "trend-columns")
    own = chosen.select(*KEY)
    dates = [cells.times.join(own, KEY).select(*KEY, "at"),
             cells.texts.join(own, KEY).select(*KEY, _parsed().alias("at"))]
    # months are numbers until only one row of each is left
    months = (C.union_all(dates).filter("at IS NOT NULL").groupBy(*KEY, (F.year("at") * 12 + F.month("at")).alias("month"))
              .agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")))
    return (months.join(chosen, KEY).groupBy("table", "column", month_of(F.col("at")).alias("period"))
            .agg(F.sum("n").alias("count")))


# ---------------------------------------------------------------- everything
class ColumnProfile(NamedTuple):
    columns: DataFrame
    histogram: DataFrame
    top_values: DataFrame
    trend: DataFrame


_NUMBERS = ["min_val", "max_val", "mean_val", "median_val", "std_val", "q25", "q75",
            "outlier_count", "outlier_pct"]
_TEXTS = ["min_length", "max_length", "avg_length", "detected_pattern", "pii_detected"]


def _with_distinct(profile: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    return profile.join(cells.groupBy(*KEY).agg(F.count(value).alias("distinct_count")), KEY)


def profile_columns(tables: dict[str, DataFrame], top_n: int = rules.TOP_N,
                    most_distinct: int | None = None) -> ColumnProfile:
    """Full profile of every column of ``tables``: one row per column, and its long parts.

    A table without rows has no column profiles.
    """
    cells = gather(tables)

    def of_numbers():
        numeric = numeric_profile(cells.names, cells.numeric)
        return numeric, write_once(numeric.summary, "numbers")

    def of_texts():
        stored = write_once(cells.text, "text")
        profile = text_profile(cells.names, C.weighted_texts(stored, cells.texts))
        return stored, write_once(_with_distinct(profile, stored, "len"), "texts")

    def of_times():
        return write_once(_with_distinct(time_profile(cells.names, cells.times), cells.time, "at"), "times")

    (numeric, numbers), (text, texts), times = together(cells.names.sparkSession, of_numbers, of_texts, of_times)
    counted = ["rows", "null_count", "distinct_count"]
    base = C.union_all([f.select(*KEY, *counted) for f in (numbers, texts, times)])
    wide = (cells.names.join(base, KEY)
            .join(numbers.drop("table", "ord", "column", *counted), KEY, "left")
            .join(texts.select(*KEY, *_TEXTS), KEY, "left")
            .join(times.select(*KEY, timestamp_text(F.col("min_at")).alias("min_date"),
                               timestamp_text(F.col("max_at")).alias("max_date")), KEY, "left"))
    columns = key_candidates(
        wide.withColumn("null_pct", pct(F.col("null_count"), F.col("rows")))
        .withColumn("distinct_pct", pct(F.col("distinct_count"), F.col("rows")))
    ).select("table", "ord", "column", "kind", "dtype", "rows", "null_count", "null_pct",
             "distinct_count", "distinct_pct", *_NUMBERS, *_TEXTS, "min_date", "max_date",
             "is_constant", "is_unique")
    top = C.union_all([top_text(text, cells.texts, texts, top_n),
                       top_numbers(numeric.ranged, numbers, cells.names, top_n, most_distinct),
                       top_years(cells.times, times, top_n)])
    return ColumnProfile(write_once(columns, "columns"), histogram(numeric), top,
                         monthly_trend(cells, trend_columns(texts, times)))
