"""Prefix tries against a dictionary of all prefixes."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from checks.compare import compare, duck
from tabscope.llm import trie
from tabscope.llm.queries import ORACLES, QUERIES

from .test_group_operators import SF


def ordered(rows):
    """conv_id -> turns (role, text) by turn, null first, then role and digest."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text.encode()):016x}"
            turns[conv].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(t[2], t[4]) for t in sorted(own)] for c, own in turns.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = Counter()
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        out[(min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved,
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select(*trie.COLUMNS).collect())


def test_query_is_brute_force_and_sql(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(QUERIES["op12_prefix_trie"](spark, SF)) == brute(rebuilt(ordered(rows)))
    assert compare(spark, duck(SF), SF, QUERIES["op12_prefix_trie"], ORACLES["op12_prefix_trie"]) is None


@pytest.mark.parametrize("deep", [0, 90])
def test_rebuilt_messy_conversations(spark, monkeypatch, deep):
    """Null ids, turns, roles and texts, ties, repeated rows, hot beginnings, a long conversation, turnless ones."""
    rng = random.Random(deep)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", "", None]))
            for c in range(-40, 120) for t in range(rng.randrange(1, 7))]
    rows += [(500 + i, 0, "user", "hot") for i in range(60)] + [(600 + i, t, "user", "hot") for i in range(40) for t in range(4)]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "other"), (3, None, "user", "first"), (4, 0, "user", "same"), (4, 0, "user", "same"),
             (None, 0, "user", "nobody"), (7, None, None, None)]
    rows += [(700 + i, t, "user", f"long {t if t < deep - 1 else t + i}") for i in range(3) for t in range(deep)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for name in ("c", "path", "shard", "t", "r", "u", "b", "head"):
        df = df.withColumn(name, F.lit("other"))
    monkeypatch.setattr(trie, "SHARD_TURNS", 30)
    monkeypatch.setattr(trie, "WIDTH", 4)
    paths = trie.turn_paths(df.repartition(3))
    assert found(trie.prefix_trie(trie.rebuilt(paths))) == brute(rebuilt(ordered(rows)))
    if not deep:
        assert found(trie.prefix_trie(paths)) == brute(ordered(rows))


def test_nothing_and_one(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert trie.prefix_trie(trie.turn_paths(empty)).collect() == []
    one = spark.createDataFrame([(9, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert found(trie.prefix_trie(trie.turn_paths(one))) == brute({9: [("user", "x")]})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=7), min_size=1, max_size=12), st.integers(1, 4))
def test_order_and_shared_turns(rows, width):
    old, trie.WIDTH = trie.WIDTH, width
    try:
        paths = [b"".join(bytes([v]) * trie.UNIT for v in r) for r in rows]
        ids, lengths = trie._units(paths)
        order, shared = trie.sorted_rows(ids, lengths, np.arange(len(rows)))
    finally:
        trie.WIDTH = old
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], i))
    for at in range(1, len(rows)):
        a, b = rows[order[at - 1]], rows[order[at]]
        assert shared[at] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
