"""Profiles of small made tables against pandas, and their invariants."""
import datetime as dt
import decimal
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tabscope.operators import columns as P, tables as TB
from tabscope.operators.cells import column_kinds, kind_of


def numbers(spark, values, typ="double", partitions=None):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return df.repartition(partitions) if partitions else df


def summary(df, name="t"):
    cells = P.gather({name: df})
    return P.numeric_profile(cells.names, cells.numeric).summary.first().asDict()


@pytest.mark.parametrize("seed,size,spread", [(1, 1, 5), (2, 2, 100), (3, 97, 9), (4, 1000, 10 ** 9), (5, 503, 1)])
def test_quartiles_match_pandas(spark, seed, size, spread):
    rng = random.Random(seed)
    values = [rng.choice([None, float("nan"), round(rng.uniform(-spread, spread), 3), 7.0]) for _ in range(size)] + [3.5]
    got = summary(numbers(spark, values, partitions=3))
    s = pd.Series(values, dtype="float64")
    for name, want in (("min_val", s.min()), ("max_val", s.max()), ("mean_val", s.mean()), ("median_val", s.median()),
                       ("std_val", s.std()), ("q25", s.quantile(.25)), ("q75", s.quantile(.75))):
        assert (got[name] is None) if math.isnan(want) else got[name] == pytest.approx(want, abs=2e-6), name
    assert got["null_count"] == s.isna().sum() and got["distinct_count"] == s.nunique() and got["rows"] == len(s)
    iqr = s.quantile(.75) - s.quantile(.25)
    out = ((s < s.quantile(.25) - 1.5 * iqr) | (s > s.quantile(.75) + 1.5 * iqr)).sum() if iqr > 0 else None
    assert got["outlier_count"] == out


def test_result_does_not_depend_on_partitioning(spark):
    rng = random.Random(9)
    values = [7.0] * 400 + [rng.gauss(0, 50) for _ in range(800)]     # a third of the rows hold one value
    rng.shuffle(values)
    results = [summary(numbers(spark, values, partitions=n)) for n in (1, 17)]
    results[0].pop("cid"), results[1].pop("cid")
    assert results[0] == results[1]
    spark.conf.set("spark.sql.adaptive.enabled", "false")             # many small ranges
    try:
        many = summary(numbers(spark, values, partitions=5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    many.pop("cid")
    assert many == results[0]


def test_histogram_matches_numpy(spark):
    import numpy as np
    rng = random.Random(3)
    values = [round(rng.uniform(-3, 7), 1) for _ in range(500)]
    cells = P.gather({"t": numbers(spark, values), "flat": numbers(spark, [5.0, 5.0, None])})
    bars = P.histogram(P.numeric_profile(cells.names, cells.numeric)).orderBy("table", "bin").collect()
    counts, edges = np.histogram(values, bins=10)
    mine = [b for b in bars if b["table"] == "t"]
    assert [b["count"] for b in mine] == list(counts)
    assert [b["bin_lo"] for b in mine] == pytest.approx(list(edges[:-1])) and mine[-1]["bin_hi"] == edges[-1]
    flat, flat_edges = np.histogram([5.0, 5.0], bins=10)
    other = [b for b in bars if b["table"] == "flat"]
    assert [b["count"] for b in other] == list(flat) and other[0]["bin_lo"] == flat_edges[0]


def test_infinities_and_large_integers(spark):
    got = summary(numbers(spark, [1.0, float("inf"), 2.0, 3.0]))
    assert got["max_val"] is None and got["mean_val"] is None and got["std_val"] is None and got["median_val"] == 2.5
    big = [2 ** 53, 2 ** 53 + 1, 2 ** 53 + 1, None]
    assert summary(numbers(spark, big, "bigint"))["distinct_count"] == 2
    exact = [decimal.Decimal("9007199254740992.1"), decimal.Decimal("9007199254740992.2")]
    assert summary(numbers(spark, exact, "decimal(20,1)"))["distinct_count"] == 2


def test_all_null_and_boolean_columns(spark):
    df = spark.createDataFrame([(None, True), (None, False), (None, True)], "n double, b boolean")
    prof = {r["column"]: r for r in P.profile_columns({"t": df}).columns.collect()}
    n, b = prof["n"], prof["b"]
    assert n["null_pct"] == 100.0 and n["distinct_count"] == 0 and n["min_val"] is None and not n["is_constant"]
    assert (b["min_val"], b["max_val"], b["mean_val"]) == (0.0, 1.0, 0.666667)
    assert b["q25"] is None and b["q75"] is None and b["outlier_count"] is None
    top = P.profile_columns({"t": df}).top_values.orderBy("rank").collect()
    assert [(r["value"], r["count"], r["pct"]) for r in top] == [("True", 2, 66.7), ("False", 1, 33.3)]


def test_text_rules_look_at_whole_long_texts(spark):
    long_json = "{" + "x" * 5000 + "}"
    almost = "{" + "x" * 5000
    mail = "a" * 3000 + "@example.com"
    df = spark.createDataFrame([(long_json, almost, mail, "Yes"), (long_json + " ", almost, mail, "n"),
                                (long_json, almost, "b" + mail, None)], "j string, k string, m string, w string")
    got = {r["column"]: r for r in P.profile_columns({"t": df}).columns.collect()}
    assert got["j"]["detected_pattern"] is None and got["k"]["detected_pattern"] is None    # 2 of 3 and none
    assert got["m"]["detected_pattern"] == "Email" and got["m"]["pii_detected"] == "Email"
    assert got["w"]["detected_pattern"] == "Boolean String" and got["j"]["distinct_count"] == 2
    assert (got["j"]["min_length"], got["j"]["max_length"], got["j"]["avg_length"]) == (5002, 5003, 5002.3)


SIZES = [10, 63, 64, 65, 255, 256, 257, 5000]


def test_values_of_any_length_are_treated_alike(spark):
    """Ranks, whole values, patterns, personal data and trend do not depend on the length of a text."""
    def table(size):
        tail = "x" * size
        day = lambda d: d.ljust(size + 10)
        rows = [(c + tail, tail + c, day("2024-01-02"), "[" + tail + "]", "m" * size + "@example.com") for c in "zbm"]
        rows += [("q" + tail, tail + "q", day("2024-02-03"), "[" + tail + "]", "m" * size + "@example.com")] * 2
        return spark.createDataFrame(rows, "w string, v string, d string, j string, e string")
    prof = TB.profile_tables({f"t{size}": table(size) for size in SIZES}, top_n=3)
    top = prof.top_values.orderBy("table", "column", "rank").collect()
    cols = {(r["table"], r["column"]): r for r in prof.columns.collect()}
    trend = prof.trend.orderBy("period").collect()
    for size in SIZES:
        t, tail = f"t{size}", "x" * size
        assert [r["value"] for r in top if (r["table"], r["column"]) == (t, "w")] == ["q" + tail, "b" + tail, "m" + tail]
        assert [r["value"] for r in top if (r["table"], r["column"]) == (t, "v")] == [tail + "q", tail + "b", tail + "m"]
        assert cols[t, "j"]["detected_pattern"] == "JSON" and cols[t, "d"]["detected_pattern"] == "Date String"
        assert cols[t, "e"]["pii_detected"] == "Email" and cols[t, "w"]["distinct_count"] == 4
        assert [(r["period"], r["count"]) for r in trend if r["table"] == t] == [("2024-01", 3), ("2024-02", 2)]


def test_sums_do_not_depend_on_partitioning(spark):
    """Unrounded means and deviations, bit by bit, over several splits and plans."""
    import math
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_tax", "l_discount")
    extreme = spark.createDataFrame([(1e300, 1e-300), (-1e300, 3e-308), (1.5, 5e-324), (None, float("inf"))], "a double, b double")
    seen = None
    for adaptive, n in (("true", 1), ("false", 4), ("true", 8), ("false", 17), ("true", 200)):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            cells = P.gather({"lines": lines.repartition(n), "extreme": extreme.repartition(3)})
            numeric = P.numeric_profile(cells.names, cells.numeric)
            means = {r["cid"]: r["mean"] for r in numeric.fences.collect()}
            found = [sorted(means.items()), sorted((r["table"], r["column"], repr(r["std_val"])) for r in numeric.summary.collect())]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        seen = seen or repr(found)
        assert repr(found) == seen
    values = [r["l_tax"] for r in lines.select("l_tax").collect()]
    assert means[1] == math.fsum(values) / len(values)


def test_nothing_to_profile(spark):
    assert P.date_range(spark.range(3), "t").count() == 0
    prof = TB.profile_tables({})
    assert prof.tables.count() == prof.columns.count() == prof.top_values.count() == prof.failed.count() == 0


def test_bound_by_odd_columns(spark):
    df = spark.sql("SELECT id AS `a.b`, map('k', id) AS m, array(id) AS l FROM range(10)")
    assert TB.bounded(df, 4, df.columns).count() == 4
    assert sorted(r[0] for r in TB.bounded(df, 3, ["a.b"]).collect()) == [0, 1, 2]


def test_top_values_order_and_gate(spark):
    words = ["b"] * 3 + ["a"] * 3 + ["c"] * 5 + [None] + [f"w{i}" for i in range(12)]
    df = spark.createDataFrame([(w, i % 25, float(i)) for i, w in enumerate(words * 2)], "w string, few int, many double")
    prof = P.profile_columns({"t": df}, top_n=3)
    top = prof.top_values.orderBy("column", "rank").collect()
    assert [(r["value"], r["count"]) for r in top if r["column"] == "w"] == [("c", 10), ("a", 6), ("b", 6)]
    assert [r["value"] for r in top if r["column"] == "few"] == ["0", "1", "2"]
    assert [r["value"] for r in top if r["column"] == "many"] == ["0.0", "1.0", "2.0"]
    gated = P.profile_columns({"t": df}, top_n=3, most_distinct=25).top_values
    assert not gated.filter("column = 'many'").count() and gated.filter("column = 'few'").count() == 3


def test_trend_takes_first_dated_column(spark):
    d = dt.datetime
    df = spark.createDataFrame([("x", "2024-01-05", d(2020, 5, 1)), ("y", "2024-01-31 10:00:00", d(2021, 5, 1)),
                                ("z", "2024-03-01", None), ("z", "2024-13-01", None)], "a string, s string, t timestamp")
    prof = TB.profile_tables({"t": df, "none": df.select("a"), "times": df.select("a", "t")})
    rows = [(r["table"], r["column"], r["period"], r["count"]) for r in prof.trend.orderBy("table", "period").collect()]
    assert rows == [("t", "s", "2024-01", 2), ("t", "s", "2024-03", 1), ("times", "t", "2020-05", 1), ("times", "t", "2021-05", 1)]
    half = df.select("a", F.when(F.col("a") == "x", F.col("s")).alias("s"))     # three of four are missing
    assert TB.profile_tables({"t": half}).trend.count() == 0


def test_nested_columns_and_kinds(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}, (1, "x"), bytearray(b"q"), dt.date(2024, 1, 1)),
                                ([1, 2], {"a": 1}, (1, "x"), bytearray(b"q"), dt.date(2024, 1, 1))],
                               "a array<int>, m map<string,int>, s struct<x:int,y:string>, b binary, d date")
    assert [k for _, _, k in column_kinds(df)] == ["string"] * 4 + ["datetime"]
    prof = TB.profile_tables({"t": df})
    table = prof.tables.first()
    assert table["duplicate_count"] == 1 and table["column_count"] == 5
    got = {r["column"]: r for r in prof.columns.collect()}
    assert all(r["is_constant"] for r in got.values()) and got["a"]["detected_pattern"] == "JSON"
    assert got["d"]["min_date"] == "2024-01-01 00:00:00" and kind_of(T.DecimalType(5, 2)) == "numeric"


def test_table_profile_rules(spark):
    rows = [(1, None, "c")] * 6 + [(i, None if i % 3 else "x@y.zz", "c") for i in range(4)]
    df = spark.createDataFrame(rows, "id int, mail string, k string")
    prof = TB.profile_tables({"t": df, "empty": df.filter("id < 0")})
    got = {r["table"]: r for r in prof.tables.collect()}
    pdf = pd.DataFrame(rows)
    assert got["t"]["duplicate_count"] == pdf.duplicated().sum() == 6
    assert got["t"]["total_null_cells"] == 8 and got["t"]["null_pct"] == 26.67
    assert got["t"]["quality_score"] == round(100 - 80 / 3 * .5 - 60 * .3, 1)
    assert (got["empty"]["row_count"], got["empty"]["column_count"], got["empty"]["quality_score"]) == (0, 0, 100.0)
    issues = [r["issue"] for r in prof.issues.orderBy("ord", "rule").collect()]
    assert issues == ["High duplicate rate: 60.0%", "Column 'mail' has majority nulls (80%)",
                      "Column 'mail' has only one distinct value", "Column 'mail' may contain PII (Email) — verify",
                      "Column 'k' has only one distinct value"]


def test_bounded_profile_keeps_true_row_count(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    prof = TB.profile_tables({"t": df}, max_rows=10, order_by={"t": ["id"]})
    row = prof.tables.first()
    assert (row["row_count"], row["profiled_rows"]) == (100, 10)
    assert prof.columns.filter("column = 'id'").first()["max_val"] == 9.0


def test_unreadable_table_is_reported(spark, tmp_path):
    good = spark.range(3)
    path = str(tmp_path / "gone")
    good.write.parquet(path)
    bad = spark.read.parquet(path)
    for f in (tmp_path / "gone").glob("*.parquet"):
        f.unlink()
    prof = TB.profile_tables({"good": good, "bad": bad})
    assert {r["table"]: r["row_count"] for r in prof.tables.collect()} == {"good": 3, "bad": -1}
    assert [r["table"] for r in prof.failed.collect()] == ["bad"]


def test_wide_tables_go_in_groups(spark):
    wide = spark.range(20).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(40)],
                                  *[F.lit(str(i)).alias(f"s{i}") for i in range(20)])
    prof = P.profile_columns({"w": wide}).columns
    assert prof.count() == 60 and prof.filter("is_constant").count() == 21
    saved, TB.COLUMNS_PER_BATCH = TB.COLUMNS_PER_BATCH, 30
    try:
        both = TB.profile_tables({"a": wide.select("c1", "s1"), "b": wide.select(*[f"c{i}" for i in range(29)]), "c": wide.select("s2")})
    finally:
        TB.COLUMNS_PER_BATCH = saved
    assert {r["table"]: r["column_count"] for r in both.tables.collect()} == {"a": 2, "b": 29, "c": 1}


def test_invariants(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice([None, rng.random()]), rng.choice("abc"), i) for i in range(300)],
                               "x double, s string, i bigint")
    prof = TB.profile_tables({"t": df})
    cols = {r["column"]: r for r in prof.columns.collect()}
    for name in ("x", "i"):
        binned = prof.histogram.filter(F.col("column") == name).agg(F.sum("count")).first()[0]
        assert binned == 300 - cols[name]["null_count"]
    freq = P.gather({"t": df}).text.agg(F.sum("freq")).first()[0]
    assert freq == 300 and 0 <= prof.tables.first()["quality_score"] <= 100


def test_first_n_form_of_value_rules(spark):
    df = spark.createDataFrame([(i, "2024-01-01" if i < 40 else "junk!") for i in range(400)], "i int, s string")
    names = P.C.column_names({"t": df})
    head = P.text_profile(names, P.first_values(df, ["i"], 40)).first()
    whole = P.text_profile(names, P.gather({"t": df}).texts).first()
    assert head["detected_pattern"] == "Date String" and whole["detected_pattern"] is None
