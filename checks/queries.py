"""One query per operator.  Each reads whole tables below ``sf_dir``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscope.functions import exprs as E, rules
from tabscope.operators import analyze, columns as P, describe as D, integrity, sketches as S, tables as T
from tabscope.operators.cells import column_kinds as kinds_of, union_all
from tabscope.plans import reports as R
from tabscope.plans.document import Documentation, document
from tabscope.sources import catalog as cat
from tabscope.sources.scratch import local_frame

from . import views as V


class Data:
    """The given tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def all_tables(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in V.BASE}

    def view(self, name: str) -> DataFrame:
        for t in V.BASE:
            if t in V.VIEWS[name]:
                self.table(t).createOrReplaceTempView(t)
        for n in V.NEEDS.get(name, []):
            self.view(n).createOrReplaceTempView(n)
        return self.spark.sql(V.VIEWS[name])

    def get(self, name: str) -> DataFrame:
        return self.view(name) if name in V.VIEWS else self.table(name)

    def some(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.get(n) for n in names}

    # -------------------------------------------------------------- estate
    def estate_columns(self) -> DataFrame:
        return self.view("estate_columns").select(
            F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), "ordinal",
            F.col("column_name").alias("column"), "type", F.lit("string").alias("kind"), "nullable",
            F.lit(None).cast("string").alias("default"), "comment")

    def estate_constraints(self) -> DataFrame:
        keys = self.view("estate_keys")
        return keys.select(
            F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), "kind",
            F.concat("kind", F.lit("_"), F.col("position").cast("string")).alias("name"), "position",
            F.split("cols", ",").alias("columns"), "ref_table", F.split("ref_cols", ",").alias("ref_columns"),
            F.lit(False).alias("inferred"))

    def estate_annotated(self) -> DataFrame:
        return cat.annotate_keys(self.estate_columns(), self.estate_constraints())

    # -------------------------------------------------------------- answers
    def answer_columns(self) -> DataFrame:
        """The four columns each answer of the view ``answers`` is about."""
        return self.view("answers").select(
            F.lit("").alias("schema"), F.col("doc_id").cast("string").alias("table"),
            F.posexplode(F.array(*[F.lit(c) for c in ("title", "body", "lang", "source")]))
            .alias("ordinal", "column"))

    def answers(self) -> DataFrame:
        return self.view("answers").select(
            F.lit("").alias("schema"), F.col("doc_id").cast("string").alias("table"), "response")


_SHOP: dict[tuple, Documentation] = {}


def forget() -> None:
    """Drop the documentation runs that report queries share, and what they wrote."""
    while _SHOP:
        _SHOP.popitem()[1].close()


def shop(spark: SparkSession, sf_dir: str) -> Documentation:
    """One documentation run over the shop tables; all report queries read its frames."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHOP:
        _SHOP[key] = document(Data(spark, sf_dir).some(*V.SHOP), V.SHOP_KEYS)
    return _SHOP[key]


def _big(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines name the same types."""
    return df.select(*[F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint")
                       else F.col(f"`{n}`") for n, t in df.dtypes])


def _queries():
    q = {}

    def query(f):
        q[f.__name__] = lambda spark, sf_dir: _big(f(Data(spark, sf_dir)))
        return f

    def report(f):
        q[f.__name__] = lambda spark, sf_dir: _big(f(shop(spark, sf_dir)))
        return f

    # ------------------------------------------------------------ catalog
    @query
    def catalog_tables(d):
        return cat.row_counts(d.all_tables()).withColumn("comment", F.lit(None).cast("string"))

    @query
    def table_row_counts(d):
        return cat.row_counts(d.some(*V.SHOP))

    @query
    def catalog_filter(d):
        tables = d.estate_columns().select("schema", "table").distinct()
        return cat.filter_tables(tables, "part, l.*,ORD.*,play.*_track,track")

    @query
    def catalog_columns(d):
        tables = d.all_tables()
        return (cat.catalog_columns(tables).join(cat.row_counts(tables), "table")
                .select("table", "ordinal", "column", "kind", "nullable", "row_count"))

    @query
    def column_kinds(d):
        tables = d.all_tables()
        kinds = local_frame(
            d.spark, [(t, i, c, k) for t, df in tables.items() for i, c, k in kinds_of(df)],
            "table string, ord int, column string, kind string")
        counts = union_all([P.null_profile(df, t) for t, df in tables.items()])
        return (counts.join(kinds, ["table", "ord", "column"]).groupBy("table", "kind")
                .agg(F.count(F.lit(1)).alias("columns"),
                     F.sum(F.col("rows") - F.col("null_count")).alias("values")))

    @query
    def key_annotation(d):
        return d.estate_annotated().select("schema", "table", "column", "is_primary_key", "is_foreign_key",
                                           "foreign_key_to")

    @query
    def fk_cardinality(d):
        return cat.foreign_keys(d.estate_constraints()).select(
            "schema", "table", "position", F.array_join("columns", ",").alias("columns"), "ref_table",
            F.array_join("ref_columns", ",").alias("ref_columns"), "cardinality")

    @query
    def sample_rows(d):
        return cat.sample_rows(d.table("orders"), ["o_orderkey"]).select(
            "o_orderkey", "o_orderstatus", "o_totalprice", E.timestamp_text(F.col("o_orderdate")).alias("o_orderdate"))

    @query
    def sample_json(d):
        return union_all([cat.sample_json(d.table(t), t, [k]) for t, k in (("nation", "n_nationkey"), ("part", "p_partkey"))])

    @query
    def bounded_scan(d):
        return T.bounded(d.table("lineitem"), 10_000, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"]).agg(
            F.count(F.lit(1)).alias("profiled_rows"), F.max("l_extendedprice").alias("max_price"),
            F.sum("l_linenumber").alias("line_numbers"))

    # ------------------------------------------------------------ columns
    @query
    def null_profile(d):
        return union_all([P.null_profile(df, t) for t, df in d.some("customers", "lines").items()])

    @query
    def distinct_profile(d):
        return P.distinct_profile(d.some("customers", "lines")).select(
            "table", "column", "null_count", "distinct_count", "distinct_pct")

    @query
    def key_candidates(d):
        return P.key_candidates(P.distinct_profile(d.some("customers", "sales", "part"))).select(
            "table", "column", "is_constant", "is_unique")

    @query
    def numeric_summary(d):
        tables = d.some("lineitem", "lines")
        cells = P.gather(tables)
        return P.numeric_profile(cells.names, cells.numeric).summary.select(
            "table", "column", "min_val", "max_val", "mean_val", "median_val", "std_val", "q25", "q75")

    @query
    def histogram(d):
        cells = P.gather(d.some("lines"))
        bars = P.histogram(P.numeric_profile(cells.names, cells.numeric))
        return bars.select("column", "bin", F.round("bin_lo", 6).alias("bin_lo"),
                           F.round("bin_hi", 6).alias("bin_hi"), "count", R.bin_label().alias("label"))

    @query
    def iqr_outliers(d):
        cells = P.gather(d.some("lines", "events"))
        return P.numeric_profile(cells.names, cells.numeric).summary.select(
            "table", "column", "outlier_count", "outlier_pct")

    @query
    def distinct_profile_approx(d):
        """Whether the distinct sketches are within a tenth of the exact counts."""
        tables = d.some("lineitem")
        exact = P.distinct_profile(tables).select("column", "distinct_count")
        sketch = P.approximate_summary(tables["lineitem"], "lineitem").select("column", "distinct_approx")
        off = F.abs(F.col("distinct_approx") - F.col("distinct_count"))
        return exact.join(sketch, "column").select("column", (off * 10 <= F.col("distinct_count") + 10).alias("within_tolerance"))

    @query
    def numeric_summary_approx(d):
        """Whether the sketched quartiles sit within a hundredth of their ranks."""
        tables = d.some("lineitem")
        sketch = P.approximate_summary(tables["lineitem"], "lineitem").filter("q25 IS NOT NULL") \
            .select("ord", "column", "q25", "median_val", "q75")
        cells = P.gather(tables).numeric.join(F.broadcast(sketch), F.col("cid") == F.col("ord"))
        total = F.sum("freq")
        reached = lambda q, p: ((F.sum(F.when(F.col("num") < F.col(q), F.col("freq")).otherwise(0)) <= (p + 0.01) * total)
                                & (F.sum(F.when(F.col("num") <= F.col(q), F.col("freq")).otherwise(0)) >= (p - 0.01) * total))
        return cells.groupBy("column").agg(
            (reached("q25", 0.25) & reached("median_val", 0.5) & reached("q75", 0.75)).alias("within_tolerance"))

    @query
    def sketched_profile(d):
        """Exact facts of sketches stored by halves of each table and merged, and whether the estimates are within 5 percent."""
        tables = d.some("lineitem", "orders", "customers", "events")
        halves = union_all([S.column_sketches(df.filter(F.pmod(F.xxhash64(*df.columns[:2]), F.lit(2)) == k), t)
                            for t, df in tables.items() for k in (0, 1)])
        found = S.sketched_profile(S.merged(halves))
        exact = P.distinct_profile(tables).select("table", "column", "distinct_count")
        off = F.abs(F.col("distinct_approx") - F.col("distinct_count")) * 20 <= F.col("distinct_count") + 20
        return found.join(exact, ["table", "column"]).select(
            "table", "column", "kind", "rows", "null_count", "min_val", "max_val", "min_length", "max_length", off.alias("within_tolerance"))

    @query
    def date_range(d):
        ranges = union_all([P.date_range(d.table(t), t) for t in ("orders", "lineitem", "events")])
        return ranges.select("table", "column", E.timestamp_text(F.col("min_date")).alias("min_date"),
                             E.timestamp_text(F.col("max_date")).alias("max_date"))

    @query
    def top_years(d):
        cells = P.gather(d.some("orders", "lineitem", "events"))
        return P.top_years(cells.times, P.time_profile(cells.names, cells.times)).select(
            "table", "column", "rank", "value", "count", "pct")

    @query
    def string_lengths(d):
        cells = P.gather(d.some("documents", "customers", "pages", "conversations", "benchmark"))
        return P.text_profile(cells.names, cells.texts).select(
            "table", "column", "min_length", "max_length", "avg_length")

    @query
    def top_values(d):
        return P.top_values(d.some("orders", "events", "part", "lineitem", "documents", "pages", "conversations", "labels")).select(
            "table", "column", "rank", "value", "count", "pct")

    def _text_of(d):
        cells = P.gather(d.some("customers", "sales", "pages", "events", "documents"))
        return P.text_profile(cells.names, cells.texts)

    @query
    def value_patterns(d):
        hits = [F.col("pattern_" + P._slug(l)) for l, _ in rules.VALUE_PATTERNS]
        return _text_of(d).select("table", "column", "boolean_words", *hits, "detected_pattern")

    @query
    def value_pii(d):
        hits = [F.col("pii_" + P._slug(l)) for l, _ in rules.PII_VALUE_PATTERNS]
        return _text_of(d).select("table", "column", *hits, "pii_detected")

    @query
    def value_patterns_first(d):
        """The first-n form of the value rules."""
        sales = d.some("sales")
        heads = P.first_values(sales["sales"], ["order_id"], rules.PATTERN_SAMPLE)
        return P.text_profile(P.C.column_names(sales), heads).select(
            "column", "n", "pattern_date_string", "detected_pattern")

    @query
    def column_profile(d):
        return P.profile_columns(d.some("lineitem")).columns.drop("dtype")

    @query
    def column_profile_all(d):
        """Every column of every given table, with nothing left out."""
        return P.profile_columns(d.all_tables()).columns

    # ------------------------------------------------------------ tables
    @query
    def duplicate_rows(d):
        frames = {**d.some("order_status", "lineitem", "lines", "conversations", "embeddings", "no_rows", "part", "customers",
                           "documents", "pages", "events"),
                  "part_names": d.table("part").select("p_name", "p_brand"),
                  "customer_phones": d.view("customers").select("phone", "is_active"),
                  "document_texts": d.table("documents").select("text"), "signed_zeros": d.view("signed_zeros")}
        return T.duplicates_of(frames)

    @query
    def null_cells(d):
        return T.null_cells(union_all([P.null_profile(df, t) for t, df in
                                       d.some("customers", "sales", "lines", "documents").items()]))

    @query
    def quality_score(d):
        tables = d.some("customers", "sales", "lines", "order_status")
        nulls = union_all([P.null_profile(df, t) for t, df in tables.items()])
        return T.quality_score(nulls, T.duplicates_of(tables))

    @report
    def table_profile(doc):
        return doc.profile.tables.drop("profiled_rows")

    @report
    def quality_issues(doc):
        return doc.profile.issues

    @query
    def monthly_trend(d):
        return _trend(d, "orders", "lineitem", "events")

    @query
    def monthly_trend_string(d):
        return _trend(d, "sales", "customers")

    def _trend(d, *names):
        cells = P.gather(d.some(*names))
        chosen = P.trend_columns(P.text_profile(cells.names, cells.texts), P.time_profile(cells.names, cells.times))
        return P.monthly_trend(cells, chosen)

    # ------------------------------------------------------------ analysis
    @query
    def classify_tables(d):
        return analyze.classify_tables(d.estate_annotated())

    @query
    def infer_fks(d):
        return analyze.infer_foreign_keys(d.estate_annotated(), d.estate_constraints()).select(
            "schema", "table", F.col("columns")[0].alias("column"), "name", "ref_table",
            F.col("ref_columns")[0].alias("ref_column"))

    @query
    def pii_by_name(d):
        return analyze.pii_by_name(d.estate_columns()).select("schema", "table", "column", "pii_type")

    @query
    def lineage_tags(d):
        return analyze.lineage_tags(d.estate_columns()).select(
            "schema", "table", "column", F.array_join("lineage_tags", ",").alias("lineage_tags"))

    @query
    def naming_style(d):
        return d.estate_columns().select("schema", "table", "column", E.naming_style(F.col("column")).alias("style"))

    @query
    def naming_issues(d):
        return analyze.naming_issues(d.estate_columns()).select("schema", "table", "column", "naming_issue")

    # ------------------------------------------------------------ integrity
    @query
    def fk_orphans(d):
        t = d.some("sales", "customers")
        return integrity.orphan_rows(t["sales"], "customer_id", t["customers"], "customer_id")

    @query
    def fk_orphans_null_parent(d):
        t = d.some("sales", "parent_with_null")
        pair = (t["sales"], "customer_id", t["parent_with_null"], "customer_id")
        return union_all([integrity.orphan_rows(*pair, strict=s).withColumn("strict", F.lit(s)) for s in (True, False)])

    @query
    def fk_integrity_report(d):
        keys = V.STAR_KEYS + [k for k in V.SHOP_KEYS if k["table"] in ("sales", "lines", "no_rows")]
        tables = {**d.all_tables(), **d.some("customers", "sales", "lines", "no_rows")}
        return integrity.integrity_report(tables, [k for k in keys if k["kind"] == "fk"])

    @query
    def fk_integrity_filtered(d):
        """The same report, with keys that bitmaps of the parents hold left out before the shuffle."""
        keys = V.STAR_KEYS + [k for k in V.SHOP_KEYS if k["table"] in ("sales", "lines", "no_rows")]
        tables = {**d.all_tables(), **d.some("customers", "sales", "lines", "no_rows")}
        return integrity.integrity_report(tables, [k for k in keys if k["kind"] == "fk"], filter_bytes=64 << 20)

    @query
    def fk_mixed_types(d):
        """Keys against parents of other types, by exact value."""
        tables = d.some("typed_keys", "typed_parents", "customer", "orders")
        keys = [V.fk("typed_keys", [c], t, [p]) for c, t, p in V.TYPED_KEYS]
        return integrity.integrity_report(tables, keys).select("local_col", "ref_table", "ref_col", "orphan_count", "status")

    # ------------------------------------------------------------ reports
    @report
    def data_dictionary(doc):
        names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
        return R.data_dictionary(doc).select(
            "table", "row_count", "table_type", F.size("columns").alias("n_columns"),
            names(F.col("columns")).alias("columns"), F.coalesce(F.array_join("primary_keys", ","), F.lit("")).alias("primary_keys"),
            F.coalesce(F.array_join(F.transform("foreign_keys", lambda x: x["label"]), "; "), F.lit("")).alias("foreign_keys"),
            F.coalesce(names(F.col("indexes")), F.lit("")).alias("indexes"),
            F.coalesce(F.aggregate("fk_integrity", F.lit(0).cast("bigint"), lambda a, x: a + x["orphan_count"]),
                       F.lit(0)).alias("orphans"))

    @report
    def dictionary_totals(doc):
        return R.dictionary_totals(doc)

    @report
    def profiling_totals(doc):
        return R.profiling_totals(doc.profile)

    @report
    def profiling_dataset(doc):
        total = lambda c, f: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + f(x))
        return R.profiling_dataset(doc).select(
            "table", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"),
            F.coalesce(total(F.col("columns"), lambda c: F.coalesce(
                F.aggregate(c["histogram"], F.lit(0).cast("bigint"), lambda a, x: a + x["count"]), F.lit(0))), F.lit(0)).alias("binned"),
            F.coalesce(total(F.col("columns"), lambda c: F.coalesce(
                F.aggregate(c["top_values"], F.lit(0).cast("bigint"), lambda a, x: a + x["count"]), F.lit(0))), F.lit(0)).alias("in_top"),
            F.coalesce(F.array_join("issues", " / "), F.lit("")).alias("issues"),
            F.col("trend_data.column").alias("trend_column"),
            F.size("trend_data.by_period").alias("months"))

    @report
    def erd_nodes(doc):
        return R.erd_nodes(doc).select(
            "id", "row_count", "column_count", "table_type", "type_color", "type_label",
            F.array_join(F.transform("columns", lambda c: F.concat(
                c["name"], F.when(c["is_primary_key"], " PK").otherwise(""),
                F.when(c["is_foreign_key"], F.concat(F.lit(" "), c["foreign_key_to"])).otherwise(""))), ", ").alias("columns"))

    @query
    def erd_edges(d):
        return R.erd_edges(d.estate_constraints())

    @query
    def erd_neighbours(d):
        return R.erd_neighbours(R.erd_edges(d.estate_constraints()))

    @report
    def database_overview(doc):
        return R.database_overview(doc)

    @report
    def overview_totals(doc):
        return R.overview_totals(R.database_overview(doc))

    @report
    def summary_kpis(doc):
        return R.summary_kpis(doc)

    @report
    def summary_items(doc):
        return R.summary_items(doc)

    @report
    def report_tables(doc):
        return R.report_tables(doc)

    @report
    def report_columns(doc):
        return R.report_columns(doc)

    @report
    def report_profiling(doc):
        return R.report_profiling(doc.profile).drop("dtype", "top_values_json")

    @report
    def report_top_values(doc):
        return doc.profile.top_values.drop("ord")

    @report
    def report_relationships(doc):
        return R.report_relationships(doc)

    @report
    def report_issues(doc):
        return R.report_issues(doc)

    @report
    def pii_report(doc):
        return R.pii_report(doc).drop("type")

    @report
    def quality_bands(doc):
        return R.count_bands(doc.profile.tables, R.quality_band(F.col("quality_score")))

    @report
    def null_bands(doc):
        return R.count_bands(doc.profile.columns, R.null_band(F.col("null_pct")))

    @query
    def confidence_bands(d):
        sure = d.view("remarks").select(E.confidence_of(F.col("remark")).alias("c"))
        return R.count_bands(sure, R.confidence_band(F.col("c")))

    @query
    def catalog_search(d):
        columns = d.estate_columns()
        found = R.search_columns(columns, "DATE").select("schema", "table", "column")
        types = analyze.classify_tables(d.estate_annotated())
        tables = R.search_tables(types, "Track", "junction").select(
            "schema", "table", F.lit(None).cast("string").alias("column"))
        return found.unionByName(tables)

    # ------------------------------------------------------------ descriptions
    def _hinted(doc):
        return D.column_hints(doc.profile.columns, doc.profile.top_values)

    @report
    def column_hints(doc):
        return _hinted(doc).select("table", "column", F.array_join("hints", " | ").alias("hints"))

    @report
    def column_context(doc):
        return D.column_context(doc.columns, _hinted(doc)).select("table", "column", "line")

    def _table_context(doc):
        overview = doc.profile.tables.select("table", "row_count", "null_pct", "duplicate_pct") \
            .join(doc.tables.select("table", "table_type"), "table")
        return D.table_context(doc.columns, overview, doc.profile.issues)

    @report
    def table_context(doc):
        return _table_context(doc).select("table", "context")

    @report
    def prompt_batches(doc):
        lines = D.column_context(doc.columns, _hinted(doc))
        return D.prompt_batches(_table_context(doc), lines).select("table", "target", "columns", "max_tokens", "prompt")

    @query
    def schema_fingerprint(d):
        columns = d.estate_columns()
        return union_all([D.fingerprints(columns, e).withColumn("enriched", F.lit(e)) for e in (False, True)])

    def _cache(d):
        answered = d.view("estate_answered").select(
            F.col("schema_name").alias("schema"), F.col("table_name").alias("table"),
            F.col("column_name").alias("column"), "ordinal")
        prints = D.fingerprints(d.estate_columns(), True)
        # every fifth ordinal was answered under an older fingerprint
        current = F.when(F.col("ordinal") % 5 == 0, F.lit("0123456789abcdef")).otherwise(F.col("fingerprint"))
        return answered.join(prints, ["schema", "table"]).select(
            "schema", current.alias("fingerprint"), "column", F.lit("known [80]").alias("text"))

    @query
    def pending_columns(d):
        return D.pending_columns(d.estate_columns(), _cache(d), True).select("schema", "table", "column", "fingerprint")

    @query
    def pending_tables(d):
        told = D.fingerprints(d.estate_columns(), True).select(
            "schema", "fingerprint", F.lit(None).cast("string").alias("column"),
            F.when(F.length("table") % 2 == 0, "told [9]").otherwise("").alias("text"))
        return D.pending_tables(d.estate_columns(), told, True)

    @query
    def parse_responses(d):
        return D.parse_responses(d.answers(), d.answer_columns()).select("table", "column", "description", "confidence")

    @query
    def missing_descriptions(d):
        columns = d.answer_columns()
        return D.missing_descriptions(columns, D.parse_responses(d.answers(), columns)).select("table", "column")

    @report
    def single_prompts(doc):
        """Prompts for the columns that no tag or type says anything about."""
        plain = doc.columns.filter(F.col("pii_type").isNull() & (F.size("lineage_tags") == 0))
        return D.single_prompts(plain, _hinted(doc)).select("table", "column", "max_tokens", "prompt")

    @query
    def extend_cache(d):
        columns = d.estate_columns()
        answers = d.view("estate_answered").select(
            F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), F.col("column_name").alias("column"),
            F.when(F.col("ordinal") == 1, "anew [70]").otherwise("").alias("raw"))
        return D.cached_descriptions(columns, D.extend_cache(_cache(d), columns, answers, True), True)

    @query
    def parse_confidence(d):
        remark = F.col("remark")
        return d.view("remarks").select("conv_id", "turn", E.description_of(remark).alias("description"),
                                        E.confidence_of(remark).alias("confidence"))

    return q


QUERIES = _queries()
