"""Steps whose largest task must not grow with the table."""
import contextlib

from pyspark.sql import functions as F

from tabscope.operators import columns as P, integrity


@contextlib.contextmanager
def small_broadcasts(spark, size="20000"):
    """Frames of real size are beyond the limit for a broadcast, as large tables are; a few rows per column are not."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def days(spark):
    day = F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz")
    return spark.range(20000).select("id", day.alias("at"), F.when(F.col("id") % 3 > 0, F.date_format(day, "yyyy-MM-dd")).alias("told"))


def test_trend_does_not_shuffle_cells_by_column(spark):
    tables = {"t": days(spark), "u": days(spark).select("id", "told")}
    cells = P.gather(tables)
    with small_broadcasts(spark):
        trend = P.monthly_trend(cells, P.trend_columns(P.text_profile(cells.names, cells.texts), P.time_profile(cells.names, cells.times)))
        assert "SortMergeJoin" not in plan_of(trend)
        found = {(r["table"], r["column"], r["period"]): r["count"] for r in trend.collect()}
    assert found["t", "at", "1970-01"] == 31 and found["t", "at", "1972-02"] == 29
    assert sum(n for (t, _, _), n in found.items() if t == "t") == 20000
    assert sum(n for (t, _, _), n in found.items() if t == "u") == 13333
    assert {c for _, c, _ in found} == {"at", "told"}


def test_short_texts_are_judged_once_and_need_no_digest(spark):
    """A value that fills the table is one cell; only longer texts have a digest and are read again."""
    long = F.concat(F.lit("a@example.com "), F.repeat(F.lit("x"), 70), (F.col("id") % 20).cast("string"))
    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "a@example.com").alias("mail"),
                                  F.when(F.col("id") % 10 > 0, F.lit("2024-01-05")).otherwise(long).alias("mixed"),
                                  F.lit("x" * 64).alias("edge"), F.lit("x" * 65).alias("beyond"), F.lit(None).cast("string").alias("none"))
    cells = P.gather({"t": df})
    assert cells.text.filter("sha IS NOT NULL").select("cid").distinct().count() == 2
    judged = P.C.weighted_texts(cells.text, cells.texts)
    assert judged.count() == 2 + (1 + 500) + 1 + 5000 + 1
    whole = P.text_profile(cells.names, cells.texts).orderBy("cid").collect()
    assert P.text_profile(cells.names, judged).orderBy("cid").collect() == whole
    assert P.C.weighted_texts(cells.text.filter("cid = 1"), cells.texts.filter("cid = 1")).count() == 2
    found = {r["column"]: r for r in P.profile_columns({"t": df}).columns.collect()}
    assert [found[c]["distinct_count"] for c in ("mail", "mixed", "edge", "beyond", "none")] == [1, 3, 1, 1, 0]
    assert found["mail"]["null_count"] == 500 and found["none"]["null_count"] == 5000 and found["mixed"]["max_length"] == 86


def test_keys_with_one_parent_share_its_cells(spark):
    """Eight keys on one parent: its cells go into the grouping twice, and equal keys are counted once."""
    ids = lambda n, step: spark.range(n).select((F.col("id") * step).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("b"),
                                                (F.col("id") * 2).cast("int").alias("c"), F.col("id").cast("string").alias("d"))
    tables = {"p": spark.range(500).withColumn("none", F.lit(None).cast("bigint")).withColumn("word", F.col("id").cast("string")),
              "x": ids(1000, 1), "y": ids(600, 3)}
    pairs = [("x", "a", "id"), ("x", "b", "id"), ("y", "a", "id"), ("y", "b", "id"), ("p", "id", "id"), ("x", "a", "id"), ("x", "c", "id"),
             ("y", "c", "id"), ("x", "d", "word"), ("y", "d", "word"), ("x", "a", "none"), ("p", "none", "id")]
    keys = [{"table": t, "local_col": c, "ref_table": "p", "ref_col": r} for t, c, r in pairs]
    found = lambda strict: {r["key"]: r["orphan_count"] for r in integrity.orphans_of_keys(tables, keys, strict).collect()}
    lost = [500, 429, 433, 86, 0, 500, 750, 350, 500, 100]
    assert found(True) == dict(enumerate([*lost, 0, 0]))
    assert found(False) == dict(enumerate([*lost, 1000, 0]))
    shared = integrity._shared(tables, keys, [])
    assert sum(len(group) for group in shared) == 11 and len(shared) == 5


def test_top_values_leave_cells_where_they_are(spark):
    n = F.col("id")
    df = spark.range(20000).select(n.alias("key"), (-n).alias("minus"), F.when(n % 3 == 0, n % 40).otherwise(n).alias("some"), (n % 5 == 0).alias("flag"),
                                   F.when(n > 0, n / 7).alias("share"), F.concat(F.lit("w"), n.cast("string")).alias("word"))
    with small_broadcasts(spark):
        cells = P.gather({"t": df})
        ranged = P.rank_ranges(cells.numeric)
        rows = P.write_once(ranged.groupBy("cid").agg(F.sum("freq").alias("rows"), F.count("num").alias("distinct_count"))
                            .join(cells.names, "cid"), "rows")
        assert "SortMergeJoin" not in plan_of(P.top_numbers(ranged, rows, cells.names, 4))
        sorted_at_all = ranged.filter("num IS NOT NULL").join(P._likely(ranged.filter("num IS NOT NULL"), 4), ["cid", "freq", "part"])
        assert sorted_at_all.count() < 1000
        top = P.top_values({"t": df}, k=4).orderBy("column", "rank").collect()
        found = {c: [(r["value"], r["count"]) for r in top if r["column"] == c] for c in df.columns}
    assert found["key"] == [(str(i), 1) for i in range(4)]
    assert found["minus"] == [(str(i), 1) for i in range(-19999, -19995)]
    counts = {}
    for i in range(20000):
        v = i % 40 if i % 3 == 0 else i
        counts[v] = counts.get(v, 0) + 1
    assert found["some"] == [(str(v), c) for v, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert found["flag"] == [("False", 16000), ("True", 4000)]
    assert [v for v, _ in found["share"]] == [str(i / 7) for i in range(1, 5)]
    assert found["word"] == [(w, 1) for w in sorted(f"w{i}" for i in range(20000))[:4]]
