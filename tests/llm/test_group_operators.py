"""Exact dedup, Jaccard join, sharding, archives, extraction and the pipeline, against brute force."""
import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, duck
from tabscope.llm import exact, extract, jaccard, packing, quality, sharding, warc
from tabscope.llm.common import tokenizer_file
from tabscope.llm.components import components
from tabscope.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_and_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], ORACLES[name]) is None


def normal(text):
    return re.sub("[\\x20\\x09-\\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = []
    for r in rows:
        own = groups[normal(r[1])]
        least = min((i for i in own if i is not None), default=None)
        out.append((r[0], least, len(own), hashlib.sha256(normal(r[1]).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block", [7, 1024])
def test_exact_rows(spark, messy, messy_rows, nothing, block):
    rows = exact.exact_groups(messy, block=block).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == brute_exact(messy_rows)
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in rows}
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    if block == 1024:
        assert exact.exact_groups(nothing).count() == 0


def test_drop_copies_keeps_columns(spark, messy, messy_rows):
    out = exact.drop_copies(messy)
    assert out.columns == messy.columns
    texts = [normal(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({normal(r[1]) for r in messy_rows})


def ngrams(text, n=5):
    words = WORDS.findall(text or "")
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_jaccard(rows):
    """(id, class, links) of each row, by comparing all pairs."""
    sets = [ngrams(r[1]) for r in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return [(r[0], min((i for i in groups[find(n)] if i is not None), default=None), links[n]) for n, r in enumerate(rows)]


def test_jaccard_rows(spark, messy, messy_rows, nothing):
    rows = jaccard.jaccard_groups(messy).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == Counter(brute_jaccard(messy_rows))
    assert jaccard.jaccard_groups(nothing).count() == 0


def test_jaccard_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_jaccard_join"](spark, SF).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(brute_jaccard(rows))


def test_large_groups_of_near_copies_and_a_common_passage(spark, monkeypatch):
    """Buckets beyond the limits: split, cut into blocks, every link counted once."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 150))
    passage = list(rng.choice(vocabulary, 60))
    rows = []
    for i in range(150):
        words = base.copy()
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    for i in range(150, 260):
        rows.append((i, " ".join([*rng.choice(vocabulary, 50), *passage, *rng.choice(vocabulary, 50)])))
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 32)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_groups(df).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(brute_jaccard(rows))
    kept = jaccard.keep_first(df).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted({c for _, c, _ in brute_jaccard(rows)})


def test_links_of_long_texts_in_blocks_with_empty_sides(spark, monkeypatch):
    """Few sets in many blocks: each link is counted once, wherever the sets stand."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        words = [f"w{w}" for w in rng.integers(0, 10 ** 9, 300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "end"]))]
    monkeypatch.setattr(jaccard, "BLOCK_NGRAMS", 200)
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter(brute_jaccard(rows))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=8))
def test_common_counts(sets):
    got = jaccard.common_counts([np.array(sorted(s), dtype=np.int64) for s in sets])
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            if a != b:
                assert got[a, b] == len(x & y)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (50, 51), (51, 50), (7, 7)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 50: 50, 51: 50, **{i: 500 for i in range(500, 560)}}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_large_ids(spark):
    """The sum of the ids is beyond a long."""
    base = 2 ** 62
    got = components(spark.createDataFrame([(base + i, base + i + 1) for i in range(5)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {base + i: base for i in range(6)}


def check_shards(rows, inputs, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in inputs)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shard_rows(spark, messy, messy_rows, nothing):
    check_shards(sharding.balanced_shards(messy).collect(), [r[:2] for r in messy_rows], 8)
    assert sharding.balanced_shards(nothing).count() == 0


def test_shards_keep_copies_together_until_they_are_full(spark):
    """A group of a third of all rows fills shard after shard; small groups stay whole."""
    texts = ["hot"] * 300 + [f"pair {i // 3}" for i in range(150)] + [f"alone {i}" for i in range(450)]
    rows = list(enumerate(texts))
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got, rows, 8)
    places = defaultdict(Counter)
    for r in got:
        places[texts[r["doc_id"]]][r["shard"]] += 1
    cut = sum(sum(c.values()) - max(c.values()) for t, c in places.items() if t.startswith("pair"))
    assert cut <= 15
    assert sum(sorted(places["hot"].values())[-3:]) >= 250


@pytest.mark.parametrize("group, alone", [(2, 0), (4, 0), (4, 160), (40, 3), (150, 0)])
def test_groups_stay_whole_when_nearly_all_rows_have_an_equal(spark, group, alone):
    texts = [f"group {i // group}" for i in range(1600 - 1600 % group)] + [f"alone {i}" for i in range(alone)]
    rows = list(enumerate(texts))
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got, rows, 8)
    places = defaultdict(set)
    for r in got:
        places[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(p) > 1 for p in places.values()) <= 7


def test_all_rows_equal(spark):
    rows = [(i, "same") for i in range(83)]
    check_shards(sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 8)


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "u\r\nv%", None), (4, None, ""), (5, "http://b", "\r\n\r\n WARC/1.1 é\x00"),
         (6, "http://c", "long " * 400_000), (2, "http://a/2", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "only null"), (None, "n", "only null")]


def test_archives(spark):
    df = spark.createDataFrame([(*p, "other") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write_archives(df)
    rows = warc.read_archives(archives, payload=True).collect()
    targets = {"<p>x</p>": 2, "": 4}

    def want(p):
        data = (p[2] or "").encode()
        target = targets.get(p[2] or "", p[0])
        revisit = target != p[0]
        return (p[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                target if revisit else None, None if revisit else data)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in rows) == Counter(map(want, PAGES))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    few = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(df, min_revisit_bytes=5)).collect()}
    assert few[3]["record_type"] == few[4]["record_type"] == "response" and few[1]["record_type"] == "revisit"
    for path in [r["path"] for r in archives.collect()]:
        data = Path(path.removeprefix("file://")).read_bytes()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES)


def test_a_payload_of_a_third_of_the_pages(spark):
    df = spark.range(4500).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'hot', if(id < 9, 'few', string(id))) AS html")
    rows = warc.read_archives(warc.write_archives(df)).collect()
    want = {i: 4497 if i % 3 == 0 else 8 if i < 9 else i for i in range(4500)}
    assert Counter((r["page_id"], r["refers_to"]) for r in rows) == Counter((i, t if t != i else None) for i, t in want.items())


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    archive = warc.Archive(f"file://{tmp_path}", "x.warc.zst")
    archive.add(warc.record(1, "u", b"payload", None).replace(b"payload", b"Payload"))
    path = archive.close()[0]
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()


LONG = "The quick brown fox jumps over the lazy dog and runs on through the green field until it rests. " * 2
CLEAN = LONG.strip()
CASES = [
    (f"<html><head><title>T</title></head><body class='has-sidebar'><header><h1>Site</h1><a href=/>Home</a></header><nav><a href=/a>A</a></nav>"
     f"<div class='cookie-notice'>We use cookies to improve your experience on this site and more.</div><main><article><header><h1>Title of it</h1>"
     f"</header><p>{LONG}</p><aside class=related><p>{LONG}</p></aside><p>Short.</p><p>{LONG}</p><form><label>Name</label><input></form></article>"
     f"</main><section id='comments'><h2>Comments</h2><div class='comment'><p>{LONG}</p></div></section><aside>{LONG}</aside><footer>Copyright</footer></body></html>",
     f"Title of it {CLEAN} Short. {CLEAN}"),
    (f"<div id=top><a href=/1>One</a> <a href=/2>Two</a></div><div id=content><h2>Heading here</h2><p>{LONG}</p><p>Of.</p><p>{LONG}</p></div>"
     f"<div class='sidebar'>{LONG}</div>", f"Heading here {CLEAN} Of. {CLEAN}"),
    (f"<article><p>a &amp; b &lt;c&gt; caf&eacute; &#x41;<br>next<p>{LONG}", f"a & b <c> café A next {CLEAN}"),
    (f"<article><p class='advert'>Buy this now</p><p>{LONG}<span class='ad'>ad text here</span> tail</p><ul><li>item one of list</li><li>two</li></ul></article>",
     f"{CLEAN} tail item one of list two"),
    (f"<article><p>{LONG}<script>var a='</p>';</script><style>p{{}}</style><!-- <p>no</p> --> end</article><div class='comments'><p>{LONG}</p></div>", f"{CLEAN} end"),
    (None, ""), ("", ""), ("<p", ""), ("<<<>>>", ""), ("<script>x", ""), ("<nav><a href=/>x</a></nav>", ""),
    ("<article>" + "<div>" * 3000 + "deep text of some words" + "</div>" * 3000 + "</article>", "deep text of some words"),
]


def test_extraction_cases(spark):
    df = spark.createDataFrame([(i, "u", h, "other") for i, (h, _) in enumerate(CASES)] + [(None, None, CASES[2][0], "other")] * 2,
                               "page_id long, url string, html string, text string")
    rows = extract.extract(df).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["page_id"] is None for r in rows) == 2
    assert extract.extract(df.limit(0)).count() == 0


SIDE = f"<div class='sidebar'><p>{LONG}</p></div>"
TEXT = f"<h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p>"
LAYOUTS = [
    *[f"<div class='{name}'><article>{TEXT}</article>{SIDE}</div>" for name in
      ("container has-sidebar", "layout-with-sidebar", "post category-search", "comment-open", "sidebar-layout", "page-search ad-free")],
    f"<div class='sidebar-layout'><main>{TEXT}</main><div class='related'><article><p>{LONG}</p></article></div></div>",
    f"<div class='no-sidebar tag-login'>{TEXT}</div>{SIDE}", f"<div class='post comment-open'>{TEXT}</div><footer>{LONG}</footer>",
    f"<article class='post sidebar-left'>{TEXT}</article>", f"<div class='search-outer'><div class='sidebar-layout'><article>{TEXT}</article></div></div>",
    f"<article>{TEXT}</article><div class='related'><article><p>{LONG}</p></article></div>",
    f"<div id=content>{TEXT}</div><section id=comments>{f'<article><p>{LONG}</p></article>' * 5}</section>",
    f"<article>{TEXT}<div style='display:none'><article>{LONG}</article></div></article>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_elements_named_by_their_surroundings_keep_the_article(page):
    assert extract.main_text(page, extract.train_tree(extract.LABELLED)) == f"Title of it {CLEAN} {CLEAN}"


def test_lists_of_links_stay_in_the_article():
    links = "".join(f"<li><a href=/{i}>Source {i}</a></li>" for i in range(6))
    page = f"<article><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p><ul class='related'>{links}</ul></article>"
    want = f"{CLEAN} {' '.join(f'Source {i}' for i in range(6))} {CLEAN}"
    assert extract.main_text(page, extract.train_tree(extract.LABELLED)) == want


def test_tree_fits_its_table_and_predicts_alike():
    nodes, data = extract.train_tree(extract.LABELLED), np.array(extract.LABELLED, dtype=float)
    assert (extract.predict(nodes, data[:, :-1]) == data[:, -1]).all()
    assert len(nodes) < 30


def test_extraction_of_whole_pages(spark):
    """The article element is the truth of the given pages; every page is looked at."""
    import html
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_pipeline_is_its_brute_force(spark):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["quality rules", "exact dedup", "n-gram Jaccard join", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    good = {r["doc_id"] for r in quality.quality(docs).filter("kept").collect()}
    least = {}
    for i in sorted(good):
        least.setdefault(normal(texts[i]), i)
    classes = {c for _, c, _ in brute_jaccard([(i, texts[i]) for i in sorted(least.values())])}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert got == classes


def test_pipeline_stages_on_hard_rows(spark, messy):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == messy.columns
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r[0] for r in packed.filter("start = 0").select("doc_id").collect()) == Counter(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_stages_on_nothing(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_packing_sizes_follow_the_parameters(spark):
    df = spark.createDataFrame([(i, "word " * (i * 7)) for i in range(60)], "doc_id long, text string")
    rows = packing.pack(df, tokenizer_file("word_bpe_49k.json"), window=64, grain=8).groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in rows) <= 64
