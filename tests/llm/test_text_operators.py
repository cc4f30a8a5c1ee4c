"""Token counts, BPE, quality rules, packing and chat formatting on hard texts, against the library or brute force."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tabscope.llm import bpe, chat, histogram, packing, quality
from tabscope.llm.common import tokenizer_file

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)


odd_text = st.lists(st.one_of(st.sampled_from([*" \t\n\x1c\x85\xa0\u2003\u3000aA1'st<|>", "<|endoftext|>", "'re", " the", "aaaa"]),
                              st.characters(exclude_categories=["Cs"])), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(odd_text, max_size=6))
def test_bpe_is_the_library(byte_bpe, texts):
    own, library = byte_bpe
    ids, bounds = own.encode(texts)
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        got = ids[bounds[i]:bounds[i + 1]]
        assert got.tolist() == want
        assert own.decode_bytes(got).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_bpe_rounds_without_overlap_and_long_words(byte_bpe):
    own, library = byte_bpe
    for text in ("a" * 5001, "ha" * 700, "x" * 3 + "y" * 4, " " * 300, "\n" * 33):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_text_is_cut_where_words_end(byte_bpe, monkeypatch):
    own, library = byte_bpe
    text = "The quick  brown fox\n\n jumps, it's 12 o'clock     " * 60
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_part_of_a_character_decodes_to_the_replacement(byte_bpe):
    own, library = byte_bpe
    ids = library.encode("😀é", add_special_tokens=False).ids
    for cut in range(len(ids) + 1):
        assert own.decode_bytes(np.array(ids[:cut], dtype=np.int64)).decode("utf-8", "replace") == library.decode(ids[:cut], skip_special_tokens=False)


def test_encode_decode_rows(spark, messy, messy_rows, nothing):
    library = Tokenizer.from_file(BYTE)

    def want(row):
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        return (row[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = [tuple(r) for r in bpe.encode_decode(messy, BYTE).collect()]
    assert Counter(got) == Counter(map(want, messy_rows))
    assert bpe.encode_decode(nothing, BYTE).count() == 0
    one = bpe.encode_decode(messy.filter("doc_id = 0"), BYTE, tokens=True).first()
    assert len(one["ids"]) == one["n_tokens"] and one["decoded"] == messy_rows[0][1]


def test_histogram_suffix_sums(spark, messy, messy_rows, nothing):
    library = Tokenizer.from_file(BYTE)
    lengths = [(r[2], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in messy_rows]
    hist = histogram.length_histogram(bpe.token_counts(messy, BYTE, keep=("lang",)), "lang")
    rows = hist.collect()
    assert Counter((r["lang"], r["n_tokens"], r["n_docs"]) for r in rows) == Counter((g, n, c) for (g, n), c in Counter(lengths).items())
    for r in rows:
        own = [n for g, n in lengths if g == r["lang"]]
        at = r["n_tokens"]
        assert (r["docs_at_least"], r["tokens_at_least"]) == (sum(n >= at for n in own), sum(n for n in own if n >= at))
        assert (r["docs_below"], r["truncated_tokens"]) == (sum(n < at for n in own), sum(min(n, at) for n in own))
        assert (r["group_docs"], r["group_tokens"]) == (len(own), sum(own))
    both = histogram.answers(hist, "lang", [0, 1, 100, 101, 10**6], [0.0, 0.5, 0.9, 1.0, 1.5]).collect()
    groups = len({g for g, _ in lengths})
    assert Counter(r["answer"] for r in both) == {"length": len(rows), "limit": 5 * groups, "quantile": 4 * groups}
    for r in both:
        own = sorted(n for g, n in lengths if g == r["lang"])
        at = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["docs_below"]) == (own.count(at), sum(n >= at for n in own), sum(n < at for n in own))
        assert (r["tokens_at_least"], r["truncated_tokens"]) == (sum(n for n in own if n >= at), sum(min(n, at) for n in own))
        assert (r["group_docs"], r["group_tokens"]) == (len(own), sum(own))
        if r["answer"] == "quantile":
            assert at == min(n for n in own if sum(m <= n for m in own) >= r["share"] * len(own))
    assert histogram.answers(hist.limit(0), "lang", [5], [0.5]).count() == 0
    assert histogram.length_histogram(bpe.token_counts(nothing, BYTE, keep=("lang",)), "lang").count() == 0


def brute_base(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab \t\n\x0b\x1c\x85  #|é")), max_size=60))
def test_words_and_repeats(text):
    words = quality.blank_split(text)
    want = brute_base(text)
    assert (len(words), sum(map(len, words)), quality.repeated_lines(text), quality.repeated_words(words)) == (want[0], want[1], want[3], want[4])


def test_quality_rows(spark, messy, messy_rows, nothing):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = quality.quality(messy).collect()
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in rows) == Counter((r[0], *brute_base(r[1])) for r in messy_rows)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(nothing).count() == 0


def test_words_with_other_white_space_stay_apart():
    pair = "a\xa0b x y " + " ".join(f"a{chr(0x10FE00 + i)}b x y" for i in range(30))
    assert quality.repeated_words(quality.blank_split(pair)) == brute_base(pair)[4]
    assert quality.blank_split("a\xa0b\u2003c d\x1ce") == ["a\xa0b\u2003c", "d\x1ce"]


def brute_kept(rows):
    """The verdicts by the definitions, one text at a time: rows are (text, lang)."""
    measured = []
    for text, lang in rows:
        text = text or ""
        base = brute_base(text)
        classes = [0] * len(quality.CLASSES)
        for c in text:
            classes[int(quality.class_table()[ord(c)])] += 1
        common = quality.COMMON_WORDS.get(lang, [])
        found = Counter(WORDS.findall(text))
        bins = [found[w] for w in common]
        measured.append((lang, base, classes, [*bins, base[0] - sum(bins)], base[0] < 50 or 100 * base[4] > 50 * base[0]))
    refs = {}
    for lang in {m[0] for m in measured}:
        sound = [m for m in measured if m[0] == lang and not m[4]]
        if lang in quality.COMMON_WORDS:
            own = quality.WORD_SHARES[:len(quality.COMMON_WORDS[lang])]
            first = (quality.PROSE, [*own, quality.SHARES - sum(own)])
        else:
            # halves away from zero, then the middle of the sorted shares, cut to a whole number
            shares = [[int(x * quality.SHARES / sum(m[2]) + 0.5) for x in m[2]] for m in sound]
            middle = [int(np.median(column)) for column in zip(*shares)]
            first = (middle if any(middle) else quality.PROSE, [])
        far = lambda m, ref: (quality.js_distance(np.array(m[2]), np.array(ref[0])),
                              quality.js_distance(np.array(m[3]), np.array(ref[1])) if lang in quality.COMMON_WORDS else 0.0)
        near = [m for m in sound if far(m, first)[0] <= quality.FIRST_CHAR_DISTANCE and far(m, first)[1] <= quality.FIRST_WORD_DISTANCE]
        refs[lang] = (far, tuple(np.array([m[k] for m in near]).sum(axis=0) for k in (2, 3)) if near else first)
    out = []
    for m in measured:
        far, ref = refs[m[0]]
        by_chars, by_words = far(m, ref)
        out.append(not m[4] and not (m[1][1] >= quality.MIN_CHARS_JUDGED and by_chars > quality.MAX_CHAR_DISTANCE)
                   and not (m[1][0] >= quality.MIN_WORDS_JUDGED and by_words > quality.MAX_WORD_DISTANCE))
    return out


def test_verdicts_are_those_of_the_definitions(spark):
    """All documents of the smallest table, beside junk, nulls and texts of a language without common words."""
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(None, "en"), ("", None), ("#*$ " * 90, "en"), ("The end. " * 300, "it"), (" ".join(f"w{i}#|{i * 7}" for i in range(300)), "it"),
           (" ".join(f"parola{i}, e{i % 17}" for i in range(300)), "it"), (" ".join(f"mot{i}" for i in range(60)), None)]
    rows = docs + odd
    got = quality.quality(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")).collect()
    want = brute_kept(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i, kept in enumerate(want) if kept}
    assert 0 < sum(want) < len(want)


def test_distance_in_spark_is_the_plain_one(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 9, 6).tolist(), rng.integers(0, 9, 6).tolist()) for _ in range(40)] + [([0] * 6, [1] * 6), ([2, 0, 0], [0, 0, 5])]
    got = spark.createDataFrame(pairs, "a array<long>, b array<long>").select(quality.distance(F.col("a"), F.col("b")).alias("d"), "a", "b").collect()
    for r in got:
        assert r["d"] == pytest.approx(quality.js_distance(np.array(r["a"]), np.array(r["b"])), abs=1e-9)


def test_quality_keeps_prose_and_drops_junk(spark):
    """Whole labelled sample: no good text that passes the base rules is dropped, no bad one kept."""
    sf = "/root/testdata/sf0.01"
    rows = quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert not [r["doc_id"] for r in rows if r["quality"] == 1 and not r["base_failed"] and not r["kept"]]
    assert not [r["doc_id"] for r in rows if r["quality"] == 0 and r["kept"]]


@pytest.mark.parametrize("lang, n_junk", [("en", 10), ("en", 60), ("en", 400), ("it", 10), (None, 25)])
def test_common_junk_does_not_switch_the_method_off(spark, lang, n_junk):
    """Long junk of half symbols beside 30 texts of prose; other languages than the four need a majority of prose."""
    rng, letters = np.random.default_rng(4), list("etaoinshrdlu")
    common = np.array(quality.COMMON_WORDS["en"])
    odds = 1 / np.arange(1, 1 + len(common)) ** 0.85

    def prose():
        words = [str(rng.choice(common, p=odds / odds.sum())) if rng.random() < 0.23 else "".join(rng.choice(letters, 6)) for _ in range(300)]
        return " ".join(w.capitalize() + "." if i % 15 == 0 else w for i, w in enumerate(words))

    def junk():
        return " ".join("".join(rng.choice(list("#*$%&|<>"), 3)) + "".join(rng.choice(letters, 3)) for _ in range(900))
    rows = [(i, prose() if i < 30 else junk(), lang) for i in range(30 + n_junk)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(30))


def test_keep_good_keeps_columns_and_rows(spark, messy):
    kept = quality.keep_good(messy)
    assert kept.columns == messy.columns
    want = Counter((r["doc_id"], r["judged_as"], r["text_hash"]) for r in quality.quality(messy).filter("kept").collect())
    from pyspark.sql import functions as F
    got = Counter(tuple(r) for r in kept.select("doc_id", "lang", F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 40), max_size=10))
def test_plan_uses_every_piece_once(histogram_):
    used = Counter()
    for shape, times in packing.plan(histogram_, window=16, grain=4, depth=3):
        assert times > 0 and sum(k * n for k, n in shape.items()) <= 16
        for k, n in shape.items():
            used[k] += n * times
    assert used == Counter(histogram_)


def test_nnls_finds_the_constrained_minimum():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6) * 5 - 1
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient > -1e-6).all() and (np.abs(gradient[x > 1e-9]) < 1e-6).all()


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(odd_text, max_size=4))
def test_word_by_word_is_the_library(texts):
    own, library = packing.word_tokenizer(WORD), Tokenizer.from_file(WORD)
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_rows(spark, messy, messy_rows, nothing):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(messy, WORD, ids=True).collect()
    docs = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [1])) for r in messy_rows)
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in docs.items())
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        assert any(d == r["doc_id"] and len(ids) == r["doc_tokens"] and list(ids[r["start"]:r["start"] + r["length"]]) == r["ids"] for d, ids in docs)
    ids = {k: 0 for k in set(r["sequence_id"] for r in rows)}
    assert sorted(ids) == list(range(len(ids)))
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ids[r["sequence_id"]]
        ids[r["sequence_id"]] += r["length"]
    assert max(ids.values()) <= 2048
    assert packing.pack(nothing, WORD).count() == 0


def test_packing_pads_little(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORD).groupBy("sequence_id").sum("length").collect()
    assert sum(2048 - r[1] for r in rows) < 0.01 * sum(r[1] for r in rows)


pieces = st.lists(st.sampled_from(["\\", " ", "\n", "x", "[INST", "]", *chat.CONTROLS, "é😀"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(turns=st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), max_size=5))
def test_round_trip_of_any_conversation(turns):
    segments = [chat.format_turn(role, text) for role, text in turns]
    rendered = "".join(s[0] for s in segments)
    assert chat.parse_all(rendered) == turns
    for (role, text), (segment, start, length) in zip(turns, segments):
        if role == "assistant":
            assert chat._field(segment[start:start + length] + " </s>", 0, "</s>")[0] == text


@pytest.mark.parametrize("broken", ["[INST] a", "x", "[INST] a </s>", " a [/INST]", "[ROLE] a [/ROLE]", "[ROLE] r [TEXT]a [/ROLE]", " a</s>"])
def test_parser_refuses(broken):
    with pytest.raises(chat.Unreadable):
        chat.parse_all(broken)


def test_chat_rows(spark):
    turns = [(1, 0, "system", None), (1, 2, "assistant", "b"), (1, 1, "user", "a [/INST]"), (2, 0, None, ""), (None, None, "user", "x"),
             (3, 0, "assistant", "</s>" * 50_000), (3, 0, "assistant", "tie"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    df = spark.createDataFrame([(*t, "other", "other") for t in turns], "conv_id long, turn long, role string, text string, segment string, conv string")
    formatted = chat.format_turns(df)
    rows = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert len(rows) == 5

    def check(conv, own):
        text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in own)
        loss = "".join(t or "" for r, t in own if r == "assistant")
        assert (rows[conv]["n_turns"], rows[conv]["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (rows[conv]["loss_chars"], rows[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    check(1, [("system", None), ("user", "a [/INST]"), ("assistant", "b")])
    check(2, [(None, "")])
    check(None, [("user", "x")])
    check(4, [("assistant", "same")] * 2)
    check(3, [("assistant", "</s>" * 50_000), ("assistant", "tie")])
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    whole = {r["conv_id"]: r["rendered"] for r in chat.rendered_conversations(formatted).collect()}
    assert chat.parse_all(whole[1]) == [("system", ""), ("user", "a [/INST]"), ("assistant", "b")]
    assert rows[1]["formatted_chars"] == len(whole[1])
