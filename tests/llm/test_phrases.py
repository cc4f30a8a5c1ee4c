"""Collocations against counting everything."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from checks.compare import compare, duck
from tabscope.llm import phrases
from tabscope.llm.queries import ORACLES, QUERIES

from .test_bottomk import LOWER
from .test_group_operators import SF

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, most=3, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, most + 1):
                counts[lang or "und"].update(" ".join(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in candidates.items():
            words = p.split(" ")
            cuts = [(10 ** 6 * a * a // (f[" ".join(words[:k])] * f[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            if not any(100 * b >= 50 * a and len(q) > len(p) and f" {p} " in f" {q} " for q, b in candidates.items()):
                kept.append((-score, -a, p.encode(), f[" ".join(words[:k])], f[" ".join(words[k:])]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_is_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()]
    assert found(QUERIES["op13_collocations"](spark, SF)) == brute(rows)
    assert compare(spark, duck(SF), SF, QUERIES["op13_collocations"], ORACLES["op13_collocations"]) is None


def test_messy_rows(messy, messy_rows, nothing):
    assert found(phrases.collocations(messy)) == brute([(r[1], r[2]) for r in messy_rows])
    assert phrases.collocations(nothing).count() == 0


@pytest.mark.parametrize("share,most", [(0.0, 3), (0.05, 4), (1.0, 3), (0.3, 2)])
def test_failures_of_the_border_are_made_good(spark, monkeypatch, share, most):
    """Whatever the sample proposes, even nothing, and with chunks and tables that are far too small."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 500)
    monkeypatch.setattr(phrases, "CACHE_WORDS", 50)
    monkeypatch.setattr(phrases, "PARTS", 3)
    if share == 1.0:
        monkeypatch.setattr(phrases, "MOST_BITS", 64)
        monkeypatch.setattr(phrases, "LEAST_BITS", 64)
        monkeypatch.setattr(phrases, "PIECE_BITS", 32)
    rng = random.Random(most)
    parts = ["the old house", "New York City", "a b a b a b", "ça va", "x y", "one", "two", "three four", "tab\tbed", "\x00 z"]
    rows = [(" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) + rng.choice([".", ",", "\n", " ", "\r\n"]), rng.choice(["en", None, "und", "fr"]))
            for _ in range(300)]
    rows += [(None, "en"), ("", "empty"), ("word " * 3000, "rep")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert found(phrases.collocations(df, most=most, share=share, top=40)) == brute(rows, most=most, top=40)


def test_large_counts_are_exact(spark):
    a, l, r = 3 * 10 ** 12 + 1, 7 * 10 ** 12 + 3, 5 * 10 ** 12 + 11
    rows = [("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    got = phrases.best_cuts(spark.createDataFrame(rows, "grp string, level int, phrase string, n long")).first()
    assert got["score"] == 10 ** 6 * a * a // (l * r)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\x0bA\t", max_size=60), st.integers(1, 20))
def test_segments_keep_pieces(text, size):
    whole = b"\n".join(phrases.segments(text.encode(), size))
    split = [re.findall(rb"[^ \t]+", p) for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", text.encode())]
    assert [p for p in split if p] == [p for p in (re.findall(rb"[^ \t]+", q) for q in re.split(rb"[.,;:!?\n\x0b\x0c\r]", whole)) if p]


def test_bits_hold_their_members():
    hashes = np.random.default_rng(0).integers(0, 2 ** 63, 5000).astype(np.uint64)
    table = np.zeros(1 << 16, dtype=np.uint8)
    for at in phrases.positions(hashes, 1 << 16):
        table[at] = 1
    bits = phrases.Bits(np.packbits(table, bitorder="little").tobytes())
    assert bits.has(hashes).all() and not bits.has(hashes + np.uint64(1)).all()
    assert not phrases.Bits(b"").has(hashes).any()
