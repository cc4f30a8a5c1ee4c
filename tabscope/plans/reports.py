"""Report datasets.  Every function takes a :class:`Documentation` or a part of it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.exprs import text as T, two_digits
from ..sources.catalog import foreign_keys
from .document import Documentation

TABLE = ["schema", "table"]


def _blank(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _mean_score(score: Column) -> Column:
    """Mean of scores with one decimal, rounded half-up to one decimal."""
    tenths = F.sum(F.round(score * 10).cast("bigint"))
    n = F.count(score)
    return F.call_function("div", tenths * 2 + n, F.nullif(n * 2, F.lit(0))) / 10


def _ordered(order: list[str], value: Column) -> Column:
    """The values of a group as an array in the given order."""
    keys = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    return F.transform(F.array_sort(F.collect_list(F.struct(keys.alias("k"), value.alias("v")))), lambda x: x.v)


# ---------------------------------------------------------------- dictionary
def data_dictionary(doc: Documentation) -> DataFrame:
    """One row per table with its columns, keys, indexes, integrity records and samples nested."""
    told = doc.descriptions
    per_column = told.filter("column IS NOT NULL").withColumnRenamed("description", "col_description") \
        .withColumnRenamed("confidence", "col_confidence")
    columns = (doc.columns.join(per_column, [*TABLE, "column"], "left").groupBy(*TABLE).agg(_ordered(
        ["ordinal"], F.struct(
            F.col("column").alias("name"), "type", "nullable", "default", "is_primary_key", "is_foreign_key",
            "foreign_key_to", "comment", F.col("col_description").alias("description"),
            F.col("col_confidence").alias("confidence"), "pii_type", "lineage_tags", "naming_issue"))
        .alias("columns")))
    label = T(rules.KEY_LABEL, F.array_join("columns", ", "), "ref_table", F.array_join("ref_columns", ", "))
    keys = doc.constraints.groupBy(*TABLE).agg(
        F.flatten(_ordered(["position"], F.when(F.col("kind") == "pk", F.col("columns"))
                           .otherwise(F.array().cast("array<string>")))).alias("primary_keys"),
        F.filter(_ordered(["inferred", "position"], F.when(F.col("kind") == "fk", F.struct(
            "name", F.col("columns").alias("constrained_columns"), F.col("ref_table").alias("referred_table"),
            F.col("ref_columns").alias("referred_columns"), label.alias("label"), "inferred"))),
            lambda x: x.isNotNull()).alias("foreign_keys"),
        F.filter(_ordered(["position"], F.when(F.col("kind").isin("unique", "index"), F.struct(
            "name", "columns", (F.col("kind") == "unique").alias("unique")))), lambda x: x.isNotNull()).alias("indexes"))
    checks = doc.integrity.groupBy("table").agg(_ordered(
        ["fk_name", "local_col"], F.struct("fk_name", "local_col", "ref_table", "ref_col", "orphan_count",
                                           "status", "error")).alias("fk_integrity"))
    out = doc.tables.join(columns, TABLE).join(keys, TABLE, "left").join(checks, "table", "left")
    if doc.samples is not None:
        out = out.join(doc.samples.groupBy("table").agg(_ordered(["position"], F.col("row")).alias("sample_data")),
                       "table", "left")
    whole = told.filter("column IS NULL").drop("column")
    return out.join(whole, TABLE, "left")


def dictionary_totals(doc: Documentation) -> DataFrame:
    """(total_tables, total_columns, total_rows); tables that could not be counted add no rows."""
    return doc.tables.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum("column_count"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum(F.when(F.col("row_count") >= 0, F.col("row_count"))), F.lit(0)).alias("total_rows"))


# ---------------------------------------------------------------- profiles
def bin_label() -> Column:
    """Text of a histogram bin, its edges with two significant digits."""
    return T(rules.BIN_LABEL, two_digits(F.col("bin_lo")), two_digits(F.col("bin_hi")))


def profiling_dataset(doc: Documentation) -> DataFrame:
    """One row per profiled table with columns, histograms, top values, issues and trend nested."""
    p = doc.profile
    bars = p.histogram.groupBy("table", "ord").agg(_ordered(["bin"], F.struct(
        bin_label().alias("bin"), "bin_lo", "bin_hi", "count")).alias("histogram"))
    top = p.top_values.groupBy("table", "ord").agg(
        _ordered(["rank"], F.struct("value", "count", "pct")).alias("top_values"))
    stats = [c for c in p.columns.columns if c not in ("table", "ord", "rows")]
    columns = (p.columns.join(bars, ["table", "ord"], "left").join(top, ["table", "ord"], "left")
               .groupBy("table").agg(_ordered(["ord"], F.struct(*stats, "histogram", "top_values")).alias("columns")))
    issues = p.issues.groupBy("table").agg(_ordered(["ord", "rule"], F.col("issue")).alias("issues"))
    trend = p.trend.groupBy("table", "column", "is_sampled").agg(
        _ordered(["period"], F.struct("period", "count")).alias("by_period")) \
        .select("table", F.struct("column", "is_sampled", "by_period").alias("trend_data"))
    checks = doc.integrity.groupBy("table").agg(_ordered(
        ["fk_name", "local_col"], F.struct("fk_name", "local_col", "ref_table", "ref_col", "orphan_count", "status"))
        .alias("fk_integrity"))
    out = p.tables
    for part in (columns, issues, trend, checks):
        out = out.join(part, "table", "left")
    return out


def profiling_totals(profile) -> DataFrame:
    """Totals over the profiled tables; their mean score is 100 when there are none."""
    return profile.tables.agg(
        F.count(F.lit(1)).alias("total_tables"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("column_count"), F.lit(0)).alias("total_columns"),
        F.coalesce(_mean_score(F.col("quality_score")), F.lit(100.0)).alias("avg_quality_score"))


# ---------------------------------------------------------------- graph
def erd_nodes(doc: Documentation) -> DataFrame:
    """Tables as graph nodes with class label, colour and columns."""
    columns = doc.columns.groupBy(*TABLE).agg(_ordered(["ordinal"], F.struct(
        F.col("column").alias("name"), "type", "is_primary_key", "is_foreign_key", "foreign_key_to",
        "nullable", "pii_type")).alias("columns"))
    pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("table_type")]
    return doc.tables.join(columns, TABLE).select(
        F.col("table").alias("id"), *TABLE, "row_count", "column_count", "table_type",
        pick(rules.CLASS_COLORS).alias("type_color"), pick(rules.CLASS_LABELS).alias("type_label"), "columns")


def erd_edges(constraints: DataFrame) -> DataFrame:
    """Foreign keys as graph edges; of several with one id the first is kept."""
    src, dst = F.array_join("columns", ", "), F.array_join("ref_columns", ", ")
    edges = foreign_keys(constraints).select(
        "schema", T(rules.EDGE_ID, "table", "ref_table", src).alias("id"),
        F.col("table").alias("source"), F.col("ref_table").alias("target"), src.alias("source_col"),
        dst.alias("target_col"), T(rules.EDGE_LABEL, src, dst).alias("label"), "cardinality", "inferred",
        "position")
    first = W.partitionBy("schema", "id").orderBy("inferred", "position")
    return edges.withColumn("nr", F.row_number().over(first)).filter("nr = 1").drop("nr", "position")


def erd_neighbours(edges: DataFrame) -> DataFrame:
    """(schema, table, neighbour): tables one foreign key away in either direction."""
    there = edges.select("schema", F.col("source").alias("table"), F.col("target").alias("neighbour"))
    back = edges.select("schema", F.col("target").alias("table"), F.col("source").alias("neighbour"))
    return there.unionByName(back).filter("table <> neighbour").distinct()


# ---------------------------------------------------------------- overviews
def _scores(doc: Documentation) -> DataFrame:
    return doc.profile.tables.select("table", "quality_score", "null_pct", "duplicate_pct",
                                     F.col("row_count").alias("profiled_count"))


def database_overview(doc: Documentation) -> DataFrame:
    """Tables with rows, columns, score (100 when not profiled) and class."""
    return doc.tables.join(_scores(doc), "table", "left").select(
        "table", F.coalesce(F.nullif("profiled_count", F.lit(0)), "row_count").alias("row_count"),
        "column_count", F.coalesce("quality_score", F.lit(100.0)).alias("quality_score"), "table_type")


def overview_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum(F.when(F.col("row_count") >= 0, F.col("row_count"))), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("column_count"), F.lit(0)).alias("total_columns"),
        F.coalesce(_mean_score(F.col("quality_score")), F.lit(100.0)).alias("avg_quality_score"))


def summary_kpis(doc: Documentation) -> DataFrame:
    """One row of key figures; what they count is listed by :func:`summary_items`.

    Each source gives one row with its own figures; folding these rows gives the answer.
    """
    rows = [
        doc.tables.agg(
            F.count(F.lit(1)).alias("total_tables"), F.sum("column_count").alias("total_columns"),
            F.coalesce(F.sum(F.when(F.col("row_count") >= 0, F.col("row_count"))), F.lit(0)).alias("total_rows")),
        doc.profile.tables.agg(_mean_score(F.col("quality_score")).alias("avg_quality_score")),
        doc.columns.agg(F.count("pii_type").alias("pii_columns_count")),
        doc.integrity.agg(F.count_if(F.col("status") == "violation").alias("fk_violations_count")),
        doc.profile.issues.agg(F.count(F.lit(1)).alias("quality_issues_count"))]
    names = [n for r in rows for n in r.columns]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r, allowMissingColumns=True)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def summary_items(doc: Documentation) -> DataFrame:
    """(list, table, column, detail, orphan_count): the entries behind the key figures.

    A list can be as long as the catalog, so its entries are rows and not one array.
    """
    none = F.lit(None)
    return (doc.columns.filter("pii_type IS NOT NULL").select(
        F.lit("pii_columns").alias("list"), "table", "column", F.col("pii_type").alias("detail"),
        none.cast("bigint").alias("orphan_count"))
        .unionByName(doc.integrity.filter("status = 'violation'").select(
            F.lit("fk_violations").alias("list"), "table", F.col("local_col").alias("column"),
            F.col("ref_table").alias("detail"), "orphan_count"))
        .unionByName(doc.profile.issues.select(
            F.lit("quality_issues").alias("list"), "table", none.cast("string").alias("column"),
            F.col("issue").alias("detail"), none.cast("bigint").alias("orphan_count"))))


# ---------------------------------------------------------------- flat reports
def report_tables(doc: Documentation) -> DataFrame:
    broken = doc.integrity.filter("status = 'violation'").groupBy("table").agg(F.count(F.lit(1)).alias("v"))
    found = doc.profile.issues.groupBy("table").agg(F.count(F.lit(1)).alias("i"))
    told = doc.descriptions.filter("column IS NULL").select(*TABLE, "description")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return (doc.tables.join(_scores(doc), "table", "left").join(broken, "table", "left")
            .join(found, "table", "left").join(told, TABLE, "left")
            .select("table", "schema", "row_count", "column_count", "table_type", "quality_score", "null_pct",
                    "duplicate_pct", zero(F.col("v")).alias("fk_violation_count"),
                    zero(F.col("i")).alias("issue_count"), _blank("description").alias("description")))


def report_columns(doc: Documentation) -> DataFrame:
    told = doc.descriptions.filter("column IS NOT NULL").select(*TABLE, "column", "description")
    return doc.columns.join(told, [*TABLE, "column"], "left").select(
        "table", "table_type", "column", "type", "nullable", F.col("is_primary_key").alias("is_pk"),
        F.col("is_foreign_key").alias("is_fk"), _blank("foreign_key_to").alias("fk_to"),
        _blank("default").alias("default_value"), _blank("pii_type").alias("pii_type"),
        F.array_join("lineage_tags", ",").alias("lineage_tags"), _blank("naming_issue").alias("naming_issue"),
        F.coalesce(F.nullif("description", F.lit("")), "comment", F.lit("")).alias("description"))


def report_profiling(profile) -> DataFrame:
    """One row per profiled column with all figures, and its top values as JSON text."""
    top = profile.top_values.groupBy("table", "ord").agg(F.to_json(
        _ordered(["rank"], F.struct("value", "count", "pct"))).alias("top_values_json"))
    return (profile.columns.join(top, ["table", "ord"], "left")
            .select("table", "column", "dtype", "null_count", "null_pct", "distinct_count", "distinct_pct",
                    "min_val", "max_val", "mean_val", "median_val", "std_val", "q25", "q75", "outlier_count",
                    "outlier_pct", _blank("detected_pattern").alias("detected_pattern"),
                    _blank("pii_detected").alias("pii_detected"), "min_length", "max_length", "avg_length",
                    "min_date", "max_date", "is_constant", "is_unique", _blank("top_values_json").alias("top_values_json")))


def report_relationships(doc: Documentation) -> DataFrame:
    """Foreign keys with the first integrity record of one of their columns."""
    keys = foreign_keys(doc.constraints).select(
        "table", "ref_table", "name", "columns", "ref_columns", "cardinality", "position", "inferred")
    # the check of a key is filed under its first column; records follow the order of the keys
    ordered = keys.select("table", F.col("name").alias("fk_name"), F.col("columns")[0].alias("local_col"),
                          "ref_table", F.struct("inferred", "position").alias("order"))
    records = doc.integrity.join(
        ordered, (doc.integrity["table"] == ordered["table"]) & (doc.integrity["local_col"] == ordered["local_col"])
        & (doc.integrity["ref_table"] == ordered["ref_table"])
        & doc.integrity["fk_name"].eqNullSafe(ordered["fk_name"])) \
        .select(doc.integrity["table"], doc.integrity["local_col"].alias("c"), "orphan_count", "status", "order")
    first = records.groupBy("table", "c").agg(
        F.min_by(F.struct("orphan_count", "status"), "order").alias("rec"), F.min("order").alias("order"))
    hit = (keys.select("table", "position", "inferred", F.explode("columns").alias("c")).join(first, ["table", "c"])
           .groupBy("table", "position", "inferred").agg(F.min_by("rec", "order").alias("rec")))
    return keys.join(hit, ["table", "position", "inferred"], "left").select(
        F.col("table").alias("from_table"), F.array_join("columns", ",").alias("from_columns"),
        F.col("ref_table").alias("to_table"), F.array_join("ref_columns", ",").alias("to_columns"),
        _blank("name").alias("fk_name"), "cardinality", F.col("rec.orphan_count").alias("orphan_count"),
        _blank("rec.status").alias("integrity_status"))


def report_issues(doc: Documentation) -> DataFrame:
    """Profiling issues and foreign-key violations in one list."""
    broken = doc.integrity.filter("status = 'violation'").select(
        "table", T(rules.ISSUE_FOREIGN_KEY, "local_col", "ref_table", "ref_col", "orphan_count").alias("issue"),
        F.lit("referential_integrity").alias("category"))
    return doc.profile.issues.select("table", "issue", F.lit("profiling").alias("category")).unionByName(broken)


def pii_report(doc: Documentation) -> DataFrame:
    """Columns that look personal by name or by their values; the name decides the type."""
    seen = doc.profile.columns.select("table", "column", "pii_detected")
    return (doc.columns.join(seen, ["table", "column"], "left")
            .filter("pii_type IS NOT NULL OR pii_detected IS NOT NULL")
            .select("table", "column", "type", _blank("pii_type").alias("pii_from_name"),
                    _blank("pii_detected").alias("pii_from_values"),
                    F.coalesce("pii_type", "pii_detected").alias("pii_type")))


# ---------------------------------------------------------------- bands and search
def quality_band(score: Column) -> Column:
    return (F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 50, "fair").otherwise("poor"))


def null_band(null_pct: Column) -> Column:
    return F.when(null_pct > 50, "high").when(null_pct > 20, "medium").otherwise("low")


def confidence_band(confidence: Column) -> Column:
    return (F.when(confidence.isNull(), "none").when(confidence >= 80, "high").when(confidence >= 60, "good")
            .when(confidence >= 40, "fair").otherwise("low"))


def count_bands(df: DataFrame, band: Column) -> DataFrame:
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("count"))


def search_tables(tables: DataFrame, term: str = "", table_type: str = "") -> DataFrame:
    """Tables whose name contains the term, in any case, and whose class is the given one."""
    named = F.lower("table").contains(term.lower()) if term else F.lit(True)
    return tables.filter(named & (F.col("table_type") == table_type if table_type else F.lit(True)))


def search_columns(columns: DataFrame, term: str = "") -> DataFrame:
    """Columns whose name or type contains the term, in any case."""
    if not term:
        return columns
    return columns.filter(F.lower("column").contains(term.lower()) | F.lower("type").contains(term.lower()))
