"""The bitmap filter of parent keys: same counts as without it, within its size, and little left to shuffle."""
import random

import pytest
from pyspark.sql import functions as F

from tabscope.functions import forms
from tabscope.operators import integrity

LONG = 2 ** 63


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(9)
    dense = list(range(-3000, 70_000))
    sparse = [-LONG, LONG - 1, 10 ** 15, 32768 * 10 ** 6]
    parent = [k for k in dense if k % 7] + sparse + [5, 5, 5]
    child = [rng.randrange(-3500, 72_000) for _ in range(5000)] + sparse + [1] * 2000 + [None] * 9 + [10 ** 15 + 1, -LONG + 1, 0, 32768, 32769, -32768]
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "k long").repartition(4)
    return frame(parent), frame(child), set(parent), child


FK = {"table": "c", "local_col": "k", "ref_table": "p", "ref_col": "k", "name": "fk", "columns": ["k"], "ref_columns": ["k"]}


@pytest.mark.parametrize("filter_bytes", [0, integrity.BITMAP_BYTES, 1 << 20])
def test_counts_do_not_depend_on_the_filter(sides, filter_bytes):
    parent, child, known, keys = sides
    tables = {"c": child, "p": parent}
    lost = sum(k is not None and k not in known for k in keys)
    assert integrity.orphans_of_keys(tables, [FK], True, filter_bytes).first()["orphan_count"] == lost
    rows = integrity.integrity_report(tables, [FK], filter_bytes=filter_bytes).collect()
    assert [(r["orphan_count"], r["status"]) for r in rows] == [(lost, "violation")]


def test_a_null_parent_keeps_its_rule(spark, sides):
    parent, child, known, keys = sides
    tables = {"c": child, "p": parent.unionByName(spark.createDataFrame([(None,)], "k long"))}
    assert integrity.orphans_of_keys(tables, [FK], True, 1 << 20).first()["orphan_count"] == 0
    assert integrity.orphans_of_keys(tables, [FK], False, 1 << 20).first()["orphan_count"] == sum(k is not None and k not in known for k in keys)


def test_the_filter_holds_exactly_the_parent_and_its_bound(sides):
    parent, child, known, keys = sides
    form = forms.key_forms(parent.schema["k"].dataType, child.schema["k"].dataType)[0]
    maps = integrity.known_keys(parent, "k", 1 << 20)
    left = {r["k"] for r in integrity._not_known(parent, "k", form, maps).collect()}
    assert left == {str(k) for k in known if abs(k) >= 10 ** 15 or k == 32768 * 10 ** 6}  # too few to be worth a bitmap
    # clean keys are not shuffled: of the child only orphans, NULLs and keys outside the bitmaps remain
    rest = [r["k"] for r in integrity._not_known(child, "k", form, maps).collect()]
    assert len(rest) == sum(k is None or k not in known or str(k) in left for k in keys)
    one = integrity.known_keys(parent, "k", integrity.BITMAP_BYTES)
    assert one.count() == 1 and integrity.known_keys(parent, "k", 0).count() == 0


def test_empty_tables(spark, sides):
    parent, child, known, keys = sides
    nothing = parent.limit(0)
    some = sum(k is not None for k in keys)
    assert integrity.orphans_of_keys({"c": child, "p": nothing}, [FK], True, 1 << 20).first()["orphan_count"] == some
    rows = integrity.integrity_report({"c": nothing, "p": parent}, [FK], filter_bytes=1 << 20).collect()
    assert [(r["orphan_count"], r["status"]) for r in rows] == [(0, "ok")]
