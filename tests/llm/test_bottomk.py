"""Near-duplicate components against brute force."""
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from checks.compare import compare, duck
from tabscope.llm import bottomk
from tabscope.llm.queries import ORACLES, QUERIES

from .test_group_operators import SF, WORDS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows):
    """(id, set size, least id of the component) of each row, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return Counter((r[0], len(sets[n]), min((i for i in groups[find(n)] if i is not None), default=None)) for n, r in enumerate(rows))


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_messy_rows(messy, messy_rows, nothing):
    assert found(bottomk.near_groups(messy)) == brute(messy_rows)
    assert bottomk.near_groups(nothing).count() == 0


def test_query_is_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op11_minhash_dedup"](spark, SF)) == brute(rows)
    assert compare(spark, duck(SF), SF, QUERIES["op11_minhash_dedup"], ORACLES["op11_minhash_dedup"]) is None


@pytest.mark.parametrize("small", [False, True])
def test_chains_at_the_threshold_shared_passages_and_hot_values(spark, monkeypatch, small):
    """Drifting copies whose ends are far apart, pairs just below and above, a passage that half of all texts share."""
    from tabscope.llm import common
    if small:
        monkeypatch.setattr(bottomk, "BLOCK_SETS", 8)
        monkeypatch.setattr(bottomk, "SALTS", 3)
        monkeypatch.setattr(bottomk, "SMALL", 6)
        monkeypatch.setattr(bottomk, "ROUNDS", 3)
        monkeypatch.setattr(bottomk, "MANY", 0.2)
        monkeypatch.setattr(common, "HOT_ROWS", 5)
        monkeypatch.setattr(common, "HOT_KEYS", 40)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    text = list(rng.choice(words, 200))
    for i in range(60):
        rows.append((i, " ".join(text)))
        for at in rng.integers(0, 200, 3):
            text[at] = f"x{i}-{at}"
    for i in range(60, 120):
        base = list(rng.choice(words, 120))
        rows.append((2 * i + 1000, " ".join(base)))
        for at in rng.choice(120, 1 + i % 6, replace=False):
            base[at] = f"y{at}"
        rows.append((2 * i + 1001, " ".join(base)))
    passage = list(rng.choice(words, 150))
    rows += [(5000 + i, " ".join([*passage, *rng.choice(words, 10 + i)])) for i in range(80)]
    rows += [(9000 + i, " ".join(rng.choice(words, 3 + i % 8))) for i in range(60)]
    rows += [(8000 + i, rows[3][1].upper()) for i in range(30)]
    assert found(bottomk.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_bounds():
    for size in (10, 64):
        least = bottomk.shared_at_least(size, 0.8)
        rng = np.random.default_rng(0)
        assert (rng.binomial(size, 0.8, 200_000) >= least).all()
    assert bottomk.needed(5, (4, 5)) == 4 and bottomk.needed(64, (4, 5)) == bottomk.shared_at_least(64, 0.8)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2 ** 62), min_size=1, max_size=40), st.sets(st.integers(0, 2 ** 62), max_size=40), st.sets(st.integers(0, 2 ** 62), max_size=40))
def test_exact_decision(common, left, right):
    a, b = (np.array(sorted(common | s), dtype=np.uint64) for s in (left, right))
    x, y = common | left, common | right
    linked = 5 * len(x & y) >= 4 * len(x | y)
    assert bottomk.reaches(a, b, (4, 5)) == linked
    assert bottomk.may_reach(a, b, (4, 5)) or not linked
