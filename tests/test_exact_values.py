"""Values that are equal compare equal, and only those: instants, zeros, numbers of different types; ranks by selection."""
from datetime import date, datetime
from decimal import Decimal
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tabscope.functions import forms
from tabscope.operators import columns as P, integrity, tables


@pytest.fixture()
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def instants(spark, *seconds):
    return spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").alias("at"))


#: 05:30 and 06:30 UTC on the day clocks go back; both are 01:30 in New York.
FIRST, SECOND = 1730611800, 1730615400


def test_instants_of_one_clock_time_are_different(new_york):
    df = instants(new_york, FIRST, SECOND, SECOND)
    assert P.distinct_profile({"t": df}).first()["distinct_count"] == 2
    assert tables.duplicate_rows(df, "t").first()["duplicate_count"] == 1
    assert integrity.orphan_rows(df, "at", instants(new_york, FIRST), "at").first()[0] == 2
    fk = {"table": "a", "name": "fk", "columns": ["at"], "ref_table": "b", "ref_columns": ["at"]}
    report = integrity.integrity_report({"a": df, "b": instants(new_york, SECOND)}, [fk]).first()
    assert (report["orphan_count"], report["status"]) == (1, "violation")


def test_zeros_are_one_value(spark):
    rows = [(0.0, [0.0, 1.0], (0.0,)), (-0.0, [-0.0, 1.0], (-0.0,)), (0.0, [0.0, -1.0], (0.0,)), (None, None, None), (float("nan"), None, None)]
    df = spark.createDataFrame(rows, "x double, l array<double>, s struct<a: float>")
    assert tables.duplicate_rows(df, "t").first()["duplicate_count"] == 2
    assert integrity.orphan_rows(df.filter("x = 0"), "x", df.filter("x = 0").limit(1), "x").first()[0] == 0


def orphans(child, parent):
    return integrity.orphan_rows(child, "k", parent, "k").first()[0]


def test_numbers_of_different_types(spark):
    whole = spark.createDataFrame([(9007199254740993,), (9007199254740992,), (5,), (-3,), (0,)], "k long")
    double = spark.createDataFrame([(9007199254740992.0,), (5.0,), (-3.0,), (-0.0,), (0.1,)], "k double")
    assert orphans(whole, double) == 1 and orphans(double, whole) == 1
    decimal = spark.createDataFrame([(Decimal(v),) for v in ("5.00", "-3.00", "0.10", "0.25", "12.50")], "k decimal(10,2)")
    other = spark.createDataFrame([(Decimal(v),) for v in ("5", "0.1", "0.2500", "-3")], "k decimal(20,4)")
    assert orphans(decimal, other) == 1
    fractions = spark.createDataFrame([(0.25,), (12.5,), (0.1,), (-3.0,), (5.0,)], "k double")
    assert orphans(fractions, decimal) == 1  # 0.1 is no double
    big = spark.createDataFrame([(float(10 ** 23),), (2.0 ** 100,), (-(2.0 ** 64) - 4096,)], "k double")
    exact = spark.createDataFrame([(Decimal(10 ** 23),), (Decimal(2 ** 100),), (Decimal(-(2 ** 64) - 4096),)], "k decimal(38,0)")
    assert orphans(big, exact) == 1  # 1e23 is a little less


def test_forms_against_fractions(spark):
    from fractions import Fraction
    rng = random.Random(1)
    doubles = [rng.choice([1, -1]) * rng.random() * 2.0 ** rng.randint(-40, 126) for _ in range(200)] + [float(rng.randint(-9, 9)) / 2 ** rng.randint(0, 5) for _ in range(200)]
    decimals = [Decimal(rng.randint(-10 ** 6, 10 ** 6)).scaleb(-rng.randint(0, 6)) for _ in range(300)] + [Decimal(int(d)) for d in doubles if abs(d) < 1e30]
    a = spark.createDataFrame([(d,) for d in doubles], "k double").select("k", forms.double_form(F.col("k")).alias("f")).collect()
    b = spark.createDataFrame([(d,) for d in decimals], "k decimal(38,6)").select("k", forms.decimal_form(F.col("k"), 6).alias("f")).collect()
    by_value = {}
    for r in [*a, *b]:
        by_value.setdefault(Fraction(r["k"]), set()).add(r["f"])
    assert all(len(v) == 1 for v in by_value.values())
    assert len({next(iter(v)) for v in by_value.values()}) == len(by_value)


def test_dates_against_timestamps(spark):
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),), (date(2024, 1, 3),)], "k date")
    times = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 2, 5),)], "k timestamp")
    local = times.select(F.col("k").cast("timestamp_ntz").alias("k"))
    assert orphans(days, times) == 2 and orphans(days, local) == 2 and orphans(times, local) == 0
    fk = {"table": "a", "name": "fk", "columns": ["k"], "ref_table": "b", "ref_columns": ["k"]}
    assert integrity.integrity_report({"a": days, "b": times}, [fk]).first()["status"] == "violation"
    texts = spark.createDataFrame([("2024-01-01",)], "k string")
    assert "incompatible" in integrity.integrity_report({"a": days, "b": texts}, [fk]).first()["error"]
    assert orphans(spark.createDataFrame([(b"\xff\x00",), (b"a",)], "k binary"), spark.createDataFrame([(b"a",)], "k binary")) == 1


@pytest.mark.parametrize("few", [0, 100_000])
def test_duplicates_of_many_tables(spark, monkeypatch, few):
    monkeypatch.setattr(tables, "FEW_REPEATED", few)
    rng = random.Random(few)
    frames = {t: [(rng.choice([None, "a", "b", ""]), rng.choice([None, 1, 2]), rng.choice([0.0, -0.0, 1.5, None])) for _ in range(n)]
              for t, n in (("big", 400), ("small", 5), ("one", 1), ("none", 0))}
    got = tables.duplicates_of({t: spark.createDataFrame(rows, "s string, i int, d double").repartition(3) for t, rows in frames.items()})
    want = {t: len(rows) - len({(s, i, d if d is None else d + 0.0) for s, i, d in rows}) for t, rows in frames.items()}
    assert {r["table"]: (r["rows"], r["duplicate_count"]) for r in got.collect()} == {t: (len(frames[t]), n) for t, n in want.items()}


def test_tables_without_copies_shuffle_only_fingerprints(spark):
    from tabscope.sources import scratch
    seen = []
    real = tables.write_once
    tables.write_once = lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label)
    try:
        out = tables.duplicate_rows(spark.range(1000).select("id", F.col("id").cast("string").alias("t")), "t").first()
    finally:
        tables.write_once = real
    assert out["duplicate_count"] == 0 and "sha2" not in seen[0] and "xxhash64" in seen[0]


@pytest.mark.parametrize("values", [
    [random.Random(3).uniform(1e6, 1e6 + 1) for _ in range(900)],                       # one range of the first count
    [random.Random(4).choice([1e300, -1e300, 1e-300, 5e-324, 0.0, -0.0, 7.0]) for _ in range(300)],
    [2.0 ** e for e in range(-300, 300)] + [-(2.0 ** e) for e in range(0, 100)],
    [float(np.nextafter(1.0, 2.0)), 1.0, float(np.nextafter(1.0, 0.0))] * 5])
def test_quartiles_by_rank_selection(spark, monkeypatch, values):
    monkeypatch.setattr(P, "RANGE_VALUES", 3)
    monkeypatch.setattr(P, "SPLIT", 4)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    cells = P.gather({"t": df})
    ranged = P.rank_ranges(cells.numeric)
    parts = ranged.groupBy("cid", "part").agg(F.sum("freq").alias("n"), F.count("num").alias("distinct_count"), F.min("num").alias("lo"), F.max("num").alias("hi"))
    got = P._quartiles(ranged, parts, parts.groupBy("cid").agg(F.sum("n").alias("n"))).first()
    order = sorted(values)
    for q in (25, 50, 75):
        low, share = divmod((len(order) - 1) * q, 100)
        a, b = order[low], order[min(low + 1, len(order) - 1)]
        assert got[f"p{q}"] == (a if a == b else a + (b - a) * (share / 100)), q


def test_the_cells_are_shuffled_once(spark):
    plans = []
    real = P.write_once
    P.write_once = lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label)
    try:
        cells = P.gather({"t": spark.range(500).select((F.col("id") % 50).cast("double").alias("x"))})
        P.numeric_profile(cells.names, cells.numeric).summary.collect()
    finally:
        P.write_once = real
    assert "rangepartitioning" not in "".join(plans).lower() and plans[0].count("Exchange hashpartitioning") == 1


def test_range_numbers_rise_with_values(spark):
    rng = random.Random(8)
    values = sorted([rng.choice([1, -1]) * 2.0 ** rng.uniform(-1070, 1023) for _ in range(2000)] + [0.0, 1.0, float("inf"), float("-inf"), 5e-324])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("p", P.range_of(F.col("v"))).orderBy("i").collect()
    parts = [r["p"] for r in rows]
    assert parts == sorted(parts)


def test_sketches_merge_to_a_whole_run(spark, tmp_path):
    """Sketches of parts, stored and merged, against one run over all and against the exact profile."""
    from tabscope.operators import sketches
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").withColumn("odd", F.when(F.col("o_orderkey") % 3 == 0, float("nan")).otherwise(-0.0))
    parts = [orders.filter(f"o_orderkey % 4 = {k}") for k in range(4)]
    for k, part in enumerate(parts):
        sketches.column_sketches(part, "orders").write.parquet(f"{tmp_path}/day={k}")
    merged = sketches.sketched_profile(sketches.merged(spark.read.parquet(str(tmp_path)))).orderBy("ord").collect()
    whole = sketches.profile_sketched({"orders": orders}).orderBy("ord").collect()
    exact = {r["column"]: r for r in P.profile_columns({"orders": orders}).columns.collect()}
    rows = {f: sorted(v for r in orders.select(f).collect() if (v := r[0]) is not None) for f in ("o_totalprice", "o_custkey")}
    for m, w in zip(merged, whole):
        same = ["table", "ord", "column", "kind", "rows", "null_count", "min_val", "max_val", "min_length", "max_length", "length_sum", "min_at", "max_at"]
        assert [m[c] for c in same] == [w[c] for c in same]
        e = exact[m["column"]]
        for r in (m, w):
            assert r["null_count"] == e["null_count"] and r["min_val"] == e["min_val"] and r["max_val"] == e["max_val"]
            assert abs(r["distinct_approx"] - e["distinct_count"]) <= 0.05 * e["distinct_count"]
            if r["column"] in rows:
                values = rows[r["column"]]
                for q, name in ((0.25, "q25_approx"), (0.5, "median_approx"), (0.75, "q75_approx")):
                    low, high = (np.searchsorted(values, r[name] + d, side) / len(values) for d, side in ((-1e-6, "left"), (1e-6, "right")))
                    assert low - 0.02 <= q <= high + 0.02
    empty = sketches.profile_sketched({"none": orders.limit(0)}).collect()
    assert {(r["rows"], r["distinct_approx"], r["q25_approx"]) for r in empty} == {(0, 0, None)}
