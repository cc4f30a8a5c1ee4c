"""Catalog, keys, analyzers, integrity, descriptions, reports and sinks on small catalogs."""
import json

import pytest
from pyspark.sql import functions as F

from checks import views as V
from tabscope.functions import exprs as E
from tabscope.operators import analyze, describe as D, integrity
from tabscope.plans import reports as R
from tabscope.plans.document import document
from tabscope.sources import catalog as cat, sinks


def columns_of(spark, spec, schema=""):
    rows = [(schema, t, i, c, "INT", "numeric", True, None, None)
            for t, cs in spec.items() for i, c in enumerate(cs.split(), 1)]
    return spark.createDataFrame(rows, cat.COLUMNS)


def test_key_annotation_composite_and_repeated(spark):
    cols = columns_of(spark, {"a": "x y z", "b": "p q"})
    keys = cat.constraint_frame(spark, [
        V.pk("b", "p", "q"), V.fk("a", ["x", "y"], "b", ["p", "q"]), V.fk("a", ["x"], "c", ["id"], "second"),
        V.fk("a", ["z"], "b", ["p"], "single"), V.unique("a", "z"), V.fk("a", ["y", "z"], "b", ["q"], "short")])
    got = {(r["table"], r["column"]): r for r in cat.annotate_keys(cols, keys).collect()}
    assert got["a", "x"]["foreign_key_to"] == "c.id"             # the later key wins
    assert got["a", "y"]["foreign_key_to"] == "b.q" and got["a", "z"]["foreign_key_to"] == "b.p"
    assert got["b", "q"]["is_primary_key"] and not got["b", "q"]["is_foreign_key"]
    card = {r["name"]: r["cardinality"] for r in cat.foreign_keys(keys).collect()}
    assert card == {"fk_a_b": "N:1", "second": "N:1", "single": "1:1", "short": "N:1"}


# (name, columns, foreign key columns, class) as known from two published sample catalogs
GOLDEN = [
    ("album", 3, 1, "unknown"), ("artist", 2, 0, "lookup"), ("customer", 13, 1, "dimension"), ("employee", 15, 1, "dimension"),
    ("genre", 2, 0, "lookup"), ("invoice", 9, 1, "fact"), ("invoice_line", 5, 2, "junction"), ("media_type", 2, 0, "lookup"),
    ("playlist", 2, 0, "lookup"), ("playlist_track", 2, 2, "junction"), ("track", 9, 3, "fact"),
    ("categories", 4, 0, "lookup"), ("customer_customer_demo", 2, 2, "junction"), ("customer_demographics", 2, 0, "dimension"),
    ("customers", 11, 0, "dimension"), ("employee_territories", 2, 2, "junction"), ("employees", 18, 1, "dimension"),
    ("order_details", 5, 2, "junction"), ("orders", 14, 3, "fact"), ("products", 10, 2, "dimension"), ("region", 2, 0, "dimension"),
    ("shippers", 3, 0, "lookup"), ("suppliers", 12, 0, "dimension"), ("territories", 3, 1, "unknown"),
    ("users_to_groups_map", 9, 0, "junction"), ("user_audit", 3, 0, "audit"), ("lookupx", 9, 0, "lookup"),
    ("DIM_DATE", 9, 0, "dimension"), ("sales_fact", 9, 0, "fact"), ("zzz", 5, 0, "unknown"),
]


def test_golden_table_classes(spark):
    df = spark.createDataFrame([g[:3] for g in GOLDEN], "name string, n int, k int")
    got = {r["name"]: r["c"] for r in df.select("name", E.table_class(F.col("name"), F.col("n"), F.col("k")).alias("c")).collect()}
    assert got == {g[0]: g[3] for g in GOLDEN}


def test_golden_overviews(spark):
    shown = {"chinook": (15607, 64, 98.8, [(347, 3, 100.), (275, 2, 100.), (59, 13, 91.5), (8, 15, 99.6), (25, 2, 100.), (412, 9, 96.9),
                                          (2240, 5, 100.), (5, 2, 100.), (18, 2, 100.), (8715, 2, 100.), (3503, 9, 98.5)]),
             "northwind": (3311, 88, 98.7, [(8, 4, 100.), (0, 2, 100.), (0, 2, 100.), (91, 11, 95.9), (49, 2, 100.), (9, 18, 98.5),
                                            (2155, 5, 100.), (830, 14, 97.6), (77, 10, 100.), (4, 2, 100.), (6, 3, 100.),
                                            (29, 12, 91.4), (53, 3, 100.)])}
    for rows, cols, quality, tables in shown.values():
        df = spark.createDataFrame(tables, "row_count bigint, column_count bigint, quality_score double")
        got = R.overview_totals(df).first()
        assert (got["total_rows"], got["total_columns"], got["avg_quality_score"]) == (rows, cols, quality)


def test_inferred_keys(spark):
    spec = {"order": "id categoryid paid box_id _id order_id", "orders": "order_id", "lines": "order_id orders_id company_id",
            "categories": "category_id name", "boxes": "id", "Company": "id", "declared": "order_id"}
    cols = columns_of(spark, spec)
    keys = cat.constraint_frame(spark, [V.pk("order", "id"), V.pk("categories", "category_id"), V.pk("orders", "order_id"),
                                        V.fk("declared", ["order_id"], "order", ["id"])])
    found = analyze.infer_foreign_keys(cat.annotate_keys(cols, keys), keys).collect()
    got = {(r["table"], r["columns"][0]): (r["ref_table"], r["ref_columns"][0], r["name"]) for r in found}
    assert got == {
        ("order", "categoryid"): ("categories", "category_id", "inferred__order__categoryid"),
        ("order", "order_id"): ("orders", "order_id", "inferred__order__order_id"),   # not to itself
        ("lines", "order_id"): ("order", "id", "inferred__lines__order_id"),          # the exact name wins
        ("lines", "orders_id"): ("orders", "order_id", "inferred__lines__orders_id"),
        ("lines", "company_id"): ("Company", "id", "inferred__lines__company_id")}


def test_schemas_are_kept_apart(spark):
    cols = columns_of(spark, {"lines": "order_id"}, "a").unionByName(columns_of(spark, {"order": "id x"}, "b"))
    none = cat.constraint_frame(spark, [])
    assert analyze.infer_foreign_keys(cat.annotate_keys(cols, none), none).count() == 0


def test_naming_issues(spark):
    cols = columns_of(spark, {"t": "OrderID order_date ship_date CUSTOMER_NAME x-y ID", "tie": "abC ab_c", "odd": "x-y A-b"})
    got = {(r["table"], r["column"]): r["naming_issue"] for r in analyze.naming_issues(cols).collect()}
    assert got["t", "OrderID"] is None and got["t", "ID"] is None          # two Pascal, two snake: first seen wins
    assert got["t", "order_date"] == "Expected PascalCase, found snake_case"
    assert got["t", "CUSTOMER_NAME"] == "Expected PascalCase, found UPPER_SNAKE"
    assert got["t", "x-y"] == "Non-standard naming (mixed/special chars)"
    assert got["tie", "abC"] is None and got["tie", "ab_c"] == "Expected camelCase, found snake_case"
    assert got["odd", "x-y"] is None


def test_known_pii_is_kept(spark):
    df = columns_of(spark, {"t": "email note"}).withColumn("seen", F.when(F.col("column") == "email", "Own").otherwise(""))
    got = {r["column"]: r["pii_type"] for r in analyze.pii_by_name(df, "seen").collect()}
    assert got == {"email": "Own", "note": None}


# ---------------------------------------------------------------- integrity
def test_orphans(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(9,)] * 30 + [(None,)] * 5 + [(8,)], "k int")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "id bigint")
    assert integrity.orphan_rows(child, "k", parent, "id").first()[0] == 31
    holed = parent.unionByName(spark.createDataFrame([(None,)], "id bigint"))
    assert integrity.orphan_rows(child, "k", holed, "id").first()[0] == 0
    assert integrity.orphan_rows(child, "k", holed, "id", strict=False).first()[0] == 31
    assert integrity.orphan_rows(child, "k", parent.filter("id < 0"), "id").first()[0] == 81


def test_integrity_errors_are_rows(spark):
    tables = {"c": spark.createDataFrame([(1, "x")], "k int, s string"), "p": spark.createDataFrame([(1,)], "id int")}
    report = integrity.integrity_report(tables, [
        V.fk("c", ["k"], "p", ["id"], "good"), V.fk("c", ["k"], "gone", ["id"], "no table"),
        V.fk("c", ["z"], "p", ["id"], "no column"), V.fk("c", ["s"], "p", ["id"], "types"), V.fk("c", [], "p", [], "none")])
    got = {r["fk_name"]: (r["orphan_count"], r["status"], r["error"]) for r in report.collect()}
    assert got["good"] == (0, "ok", None) and set(got) == {"good", "no table", "no column", "types"}
    assert all(got[n][:2] == (-1, "error") and got[n][2] for n in ("no table", "no column", "types"))


# ---------------------------------------------------------------- descriptions
ANSWERS = {
    "clean": ('{"A": "x [90]", "b": "y"}', {"a": "x [90]", "b": "y"}),
    "fenced": ('```json\n{"a": "x"}\n```', {"a": "x"}),
    "around": ('Sure: {"a": "x", "zz": "?"} done', {"a": "x"}),
    "commas": ('{"a": "x", "b": "y",}', {"a": "x", "b": "y"}),
    "broken": ('{"a": "x \\" q" "b": "y"}', {"a": 'x \\" q', "b": "y"}),
    "cut": ('{"a": "x", "b": "y', {}),
    "nested": ('{"a": {"description": "x", "confidence": 5}, "b": {"d": "y"}}', {"a": "x [5]", "b": "y"}),
    "kinds": ('{"a": 1, "b": ["y"]}', {}), "list": ('[1, 2]', {}), "empty": ("", {}), "null": (None, {}),
    "twice": ('{"a": "x", "A": "y", "b": "z"}', {"a": "y", "b": "z"}),
    "two": ('{"a": "x"} {"b": "y"}', {"a": "x", "b": "y"}),
    "quotes": ("{'a': 'x'}", {}),
}


def test_reading_answers(spark):
    responses = spark.createDataFrame([("", n, text) for n, (text, _) in ANSWERS.items()], "schema string, table string, response string")
    cols = columns_of(spark, {n: "a b" for n in ANSWERS})
    got = {}
    for r in D.parse_responses(responses, cols).collect():
        got.setdefault(r["table"], {})[r["column"]] = r["raw"]
    assert {n: got.get(n, {}) for n in ANSWERS} == {n: want for n, (_, want) in ANSWERS.items()}


def test_long_broken_answer(spark):
    text = '{"a": "' + 'q\\"' * 20000 + '" "b": "y"}'
    responses = spark.createDataFrame([("", "t", text)], "schema string, table string, response string")
    got = D.parse_responses(responses, columns_of(spark, {"t": "a b"})).collect()
    assert {r["column"]: len(r["raw"]) for r in got} == {"a": 60000, "b": 1}


def test_missing_is_limited_per_table(spark):
    cols = columns_of(spark, {"t": " ".join(f"c{i}" for i in range(30)), "u": "a"})
    told = spark.createDataFrame([("", "t", "c0")], "schema string, table string, column string")
    got = D.missing_descriptions(cols, told).filter("table = 't'").orderBy("ordinal").collect()
    assert [r["column"] for r in got] == [f"c{i}" for i in range(1, 30)]
    few = D.missing_descriptions(cols, told, per_table=20).filter("table = 't'").orderBy("ordinal").collect()
    assert [r["column"] for r in few] == [f"c{i}" for i in range(1, 21)]


def test_wide_tables_are_described_whole(spark):
    """All 45 columns are in the context, in prompts within their budget, and in what is missing."""
    names = [f"c{i:02}" for i in range(45)]
    cols = columns_of(spark, {"t": " ".join(names)}).withColumn("is_primary_key", F.lit(False)).withColumn("is_foreign_key", F.lit(False)) \
        .withColumn("foreign_key_to", F.lit(None).cast("string")).withColumn("pii_type", F.lit(None).cast("string")) \
        .withColumn("lineage_tags", F.array().cast("array<string>"))
    overview = spark.createDataFrame([("t", 1, "unknown", 0.0, 0.0)], "table string, row_count long, table_type string, null_pct double, duplicate_pct double")
    issues = spark.createDataFrame([("t", i, 1, f"issue {i}") for i in range(7)], "table string, ord int, rule int, issue string")
    context = D.table_context(cols, overview, issues)
    text = context.first()["context"]
    assert all(n in text for n in names) and all(f"issue {i}" in text for i in range(7))
    prompts = D.prompt_batches(context, D.column_context(cols)).filter("target = 'columns'").collect()
    assert sorted(p["columns"] for p in prompts) == [22, 23] and all(p["max_tokens"] <= 4096 for p in prompts)
    assert all(sum(f"Names: " in p["prompt"] and n in p["prompt"].split("Names: ")[1].split(", ") for p in prompts) == 1 for n in names)


def test_answers_stay_in_their_schema(spark):
    cols = spark.createDataFrame([(s, "t", 1, "c") for s in ("a", "b")], "schema string, table string, ordinal int, column string")
    told = spark.createDataFrame([("a", "t", "c", "one [50]"), ("b", "t", "c", "two [60]")], "schema string, table string, column string, raw string")
    cache = D.extend_cache(spark.createDataFrame([], "schema string, fingerprint string, column string, text string"), cols, told)
    got = {r["schema"]: r["description"] for r in D.cached_descriptions(cols, cache).collect()}
    assert got == {"a": "one", "b": "two"}
    ties = spark.createDataFrame([("a", "t", "c", x) for x in ("p [1]", "q [2]")], "schema string, table string, column string, raw string")
    assert D.extend_cache(cache, cols, ties).filter("schema = 'a'").first()["text"] == "q [2]"


def test_one_unreadable_table_does_not_end_a_run(spark, tmp_path):
    from tabscope.plans.document import document
    parent = spark.range(5).withColumnRenamed("id", "parent_id")
    child = spark.sql("SELECT id, id % 7 AS parent_id FROM range(20)")
    path = str(tmp_path / "gone")
    spark.range(4).withColumnRenamed("id", "lost_id").write.parquet(path)
    lost = spark.read.parquet(path)
    for f in (tmp_path / "gone").glob("*.parquet"):
        f.unlink()
    keys = [{"table": "child", "kind": "fk", "name": "good", "columns": ["parent_id"], "ref_table": "parent", "ref_columns": ["parent_id"]},
            {"table": "child", "kind": "fk", "name": "bad", "columns": ["id"], "ref_table": "lost", "ref_columns": ["lost_id"]}]
    doc = document({"parent": parent, "child": child, "lost": lost}, keys)
    counts = {r["table"]: r["row_count"] for r in doc.tables.collect()}
    assert counts == {"parent": 5, "child": 20, "lost": -1}
    found = {r["fk_name"]: r for r in doc.integrity.collect()}
    assert (found["good"]["status"], found["good"]["orphan_count"]) == ("violation", 5)
    assert (found["bad"]["status"], found["bad"]["orphan_count"]) == ("error", -1) and len(found["bad"]["error"]) > 100
    assert {r["table"] for r in doc.profile.columns.select("table").distinct().collect()} == {"parent", "child"}
    assert [r["table"] for r in doc.profile.failed.collect()] == ["lost"]


def test_fingerprint_ignores_order(spark):
    import hashlib
    want = hashlib.sha256(b"enriched:t:a,b,c").hexdigest()[:16]
    for order in ("a b c", "c a b"):
        assert D.fingerprints(columns_of(spark, {"t": order}), True).first()["fingerprint"] == want


# ---------------------------------------------------------------- the whole run
@pytest.fixture(scope="module")
def shop_doc(spark):
    people = spark.createDataFrame([(1, "a@b.cc", None), (2, "d@e.ff", 3.0), (3, "g@h.ii", None)], "person_id int, email string, score double")
    visits = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 9, "2024-02-01"), (3, 9, "2024-02-03")], "visit_id int, person_id int, seen string")
    told = spark.createDataFrame([("", "people", None, "All people", 90), ("", "people", "email", "Mail", 40)],
                                 "schema string, table string, column string, description string, confidence int")
    return document({"people": people, "visits": visits, "empty": visits.filter("visit_id < 0")},
                    [V.pk("people", "person_id"), V.pk("visits", "visit_id"), V.fk("visits", ["person_id"], "people", ["person_id"])],
                    sample_keys={"people": ["person_id"], "visits": ["visit_id"]}, comments={"people": "who"}, descriptions=told)


def test_nested_reports(shop_doc):
    people = R.data_dictionary(shop_doc).filter("table = 'people'").first()
    assert people["comment"] == "who" and people["description"] == "All people" and people["primary_keys"] == ["person_id"]
    assert [c["name"] for c in people["columns"]] == ["person_id", "email", "score"]
    assert people["columns"][1]["description"] == "Mail" and people["columns"][1]["pii_type"] == "Email"
    assert json.loads(people["sample_data"][0]) == {"person_id": 1, "email": "a@b.cc", "score": None}
    visits = R.profiling_dataset(shop_doc).filter("table = 'visits'").first()
    assert visits["trend_data"]["column"] == "seen" and [p["count"] for p in visits["trend_data"]["by_period"]] == [1, 2]
    assert visits["fk_integrity"][0]["orphan_count"] == 2 and len(visits["columns"][0]["histogram"]) == 10
    edges = R.erd_edges(shop_doc.constraints).collect()
    # the copy without rows declares nothing, so its key is inferred
    assert {(e["id"], e["inferred"]) for e in edges} == {("visits_people_person_id", False)} | {
        (e["id"], True) for e in edges if e["source"] == "empty"}


def test_summary(shop_doc):
    k = R.summary_kpis(shop_doc).first()
    assert (k["total_tables"], k["total_rows"], k["fk_violations_count"], k["pii_columns_count"]) == (3, 6, 1, 1)
    assert R.summary_items(shop_doc).count() == 1 + 1 + k["quality_issues_count"]
    tables = {r["table"]: r for r in R.report_tables(shop_doc).collect()}
    assert tables["empty"]["quality_score"] == 100.0 and tables["visits"]["fk_violation_count"] == 1
    assert tables["people"]["description"] == "All people"


def test_run_without_profile(spark):
    t = spark.createDataFrame([(1,)], "id int")
    doc = document({"t": t}, [], check_keys=False, with_profile=False)
    assert doc.profile is None and doc.tables.first()["row_count"] == 1
    assert R.dictionary_totals(doc).first()["total_rows"] == 1


def test_bands_and_search(spark):
    df = spark.createDataFrame([(s,) for s in (100., 90., 89.9, 75., 50., 49.9)], "s double")
    got = {r["band"]: r["count"] for r in R.count_bands(df, R.quality_band(F.col("s"))).collect()}
    assert got == {"excellent": 2, "good": 2, "fair": 1, "poor": 1}
    cols = columns_of(spark, {"t": "OrderDate x"})
    assert R.search_columns(cols, "DATE").count() == 1 and R.search_columns(cols).count() == 2
    assert R.search_columns(cols, "int").count() == 2


def test_sinks(spark, shop_doc, tmp_path):
    sinks.export(shop_doc, str(tmp_path), ("csv", "json", "parquet"))
    back = spark.read.csv(f"{tmp_path}/csv/issues", header=True)
    assert back.columns == ["table", "issue", "category"]
    assert back.filter("category = 'referential_integrity'").first()["issue"] == "FK violation: person_id → people.person_id (2 orphans)"
    doc = spark.read.json(f"{tmp_path}/json/schema").filter("table = 'people'").first()
    assert [c["name"] for c in doc["columns"]] == ["person_id", "email", "score"]
    assert spark.read.parquet(f"{tmp_path}/parquet/tables").count() == 3
    assert spark.read.csv(f"{tmp_path}/csv/profiling", header=True).filter("column = 'email'").first()["pii_detected"] == "Email"


def test_spark_catalog_source(spark):
    spark.range(2).createOrReplaceTempView("tabscope_one")
    spark.range(3).createOrReplaceTempView("tabscope_two")
    try:
        tables, failed = cat.open_tables(spark, table_filter="tabscope_.*")
        assert list(tables) == ["tabscope_one", "tabscope_two"] and failed.count() == 0
        counts = {r["table"]: r["row_count"] for r in cat.safe_row_counts(tables).collect()}
        assert counts == {"tabscope_one": 2, "tabscope_two": 3}
    finally:
        spark.catalog.dropTempView("tabscope_one")
        spark.catalog.dropTempView("tabscope_two")


def test_many_keys_go_in_groups(spark):
    t = {"c": spark.createDataFrame([(1,), (2,)], "k int"), "p": spark.createDataFrame([(1,)], "id int")}
    saved, integrity.KEYS_PER_JOB = integrity.KEYS_PER_JOB, 2
    try:
        report = integrity.integrity_report(t, [V.fk("c", ["k"], "p", ["id"], f"k{i}") for i in range(5)])
    finally:
        integrity.KEYS_PER_JOB = saved
    assert sorted((r["fk_name"], r["orphan_count"]) for r in report.collect()) == [(f"k{i}", 1) for i in range(5)]


def test_scratch_can_be_cleared(spark):
    from tabscope.sources import scratch
    other = spark.newSession()
    frame = scratch.write_once(other.range(3), "gone")
    assert frame.count() == 3
    path = frame.inputFiles()[0]
    import os
    assert os.path.exists(path.removeprefix("file://"))


def test_comments_of_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE TABLE noted (a INT) USING parquet LOCATION '{tmp_path}/noted' COMMENT 'what it is'")
    try:
        told = cat.table_comments(spark, table_filter="noted")
        assert told == {"noted": "what it is"}
        doc = document({"noted": spark.table("noted")}, [], comments=told, with_profile=False)
        assert doc.tables.first()["comment"] == "what it is"
    finally:
        spark.sql("DROP TABLE noted")


def test_plain_indexes_are_listed(spark):
    keys = [{"table": "t", "kind": "index", "name": "by_b", "columns": ["b"]}, {"table": "t", "kind": "unique", "name": "u", "columns": ["a"]}]
    doc = document({"t": spark.createDataFrame([(1, 2)], "a int, b int")}, keys, with_profile=False)
    found = R.data_dictionary(doc).first()["indexes"]
    assert [(i["name"], i["columns"], i["unique"]) for i in found] == [("by_b", ["b"], False), ("u", ["a"], True)]


def test_a_run_leaves_nothing_after_close(spark, tmp_path):
    import glob
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/*/run-*"))
    doc = document({"t": spark.range(5)}, [])
    assert doc.tables.count() == 1 and set(glob.glob(f"{root}/*/run-*")) != before
    doc.close()
    assert set(glob.glob(f"{root}/*/run-*")) == before


def test_a_missing_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tabscope.sources import scratch
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default)))
