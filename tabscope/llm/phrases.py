"""Phrase collocations by Toivonen's sampling: proposals from a sample, exact counts with their negative border.

A sample of the rows proposes phrases.  A full pass counts, exactly, every occurring phrase whose two parts (without its
last and without its first word) are proposed: the proposals and their negative border.  Frequent phrases of the border
that were not proposed are failures; another pass counts what they newly allow, until there is none.  A phrase as
frequent as asked for has parts that are so, hence nothing is missed.

Proposals travel as a bit table of bounded size.  A phrase that it lets through by chance is counted exactly and
then dropped for its count, so the table's size changes the work and never the result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import Words
from .common import key, looked_up, map_batches, text_or_empty, written
from .jaccard import odd

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
#: Fixed by the definition of pieces and words; A-Z in lower case by `bytes.lower`.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Share of the rows that proposes phrases, and the count there that a proposal has at least.
SAMPLE = 0.125
SAMPLE_COUNT = 2
SEED = 20
#: Words counted together, and words remembered before numbering starts anew.  They bound memory only.
CHUNK_WORDS = 1 << 21
CACHE_WORDS = 1 << 19
#: Bytes of text whose words are numbered together.
BLOCK_BYTES = 1 << 23
#: Bits of the table of proposals: at most, at least, for each proposal, tested for each phrase, in one piece of it.
MOST_BITS = 1 << 27
LEAST_BITS = 1 << 20
BITS_EACH = 12
PROBES = 3
PIECE_BITS = 1 << 20
#: Parts in which the phrases of a group are ranked first.
PARTS = 16
#: Separators become line feeds, tabs become blanks.
_TABLE = bytes(10 if b in SEPARATORS else 32 if b == 9 else b for b in range(256))


def segments(text: bytes, size: int = 1 << 22):
    """A long text in parts cut at separators, with the same pieces."""
    start = 0
    while len(text) - start > size:
        cut = min((at for at in (text.find(c.to_bytes(1, "big"), start + size) for c in SEPARATORS) if at >= 0), default=-1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:] if start else text


def mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> np.uint64(31))) * odd(4001)
    return total ^ (total >> np.uint64(29))


def phrase_hashes(words: list[np.ndarray], group: int) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, position by position, and of their group."""
    total = np.full(len(words[0]), (group + len(words)) & (2 ** 64 - 1), dtype=np.uint64)
    for k, word in enumerate(words):
        total += word * odd(k)
    return mixed(total)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Bits:
    """A set of hashes as a table of bits; some others are taken for members.  Without bits it is empty."""

    def __init__(self, table: bytes):
        self.table = np.frombuffer(table, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), len(self.table) > 0)
        for at in positions(hashes, len(self.table) * 8) if len(self.table) else ():
            out &= (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


class Everything:
    """The proposals of the pass over the sample."""

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return np.ones(len(hashes), dtype=bool)


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + step * np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def accepted(hashes: np.ndarray, tables: list) -> np.ndarray:
    out = np.zeros(len(hashes), dtype=bool)
    for t in tables:
        out |= t.has(hashes)
    return out


class Vocabulary:
    """Numbers of words in the order they are met, from 1; 0 ends a piece."""

    def __init__(self):
        self.words, self.texts, self.hashes = Words(), [b"\n"], np.zeros(1, dtype=np.uint64)
        self.words[b"\n"] = 0

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the numbers of its words, with a 0 after each piece."""
        lines = [t.lower().translate(_TABLE) + b"\n" for t in texts]
        ends = np.cumsum([t.count(b"\n") for t in lines])
        whole = pa.array([b"".join(lines).replace(b"\n", b" \n ")], pa.binary())
        found = pc.split_pattern(whole, pattern=" ").flatten().dictionary_encode()
        known = np.array([self.words[w] if w else -1 for w in found.dictionary.to_pylist()], dtype=np.int64)
        ids = known[found.indices.to_numpy()]
        del whole, found
        ids = ids[ids >= 0]
        return np.split(ids, np.flatnonzero(ids == 0)[ends - 1] + 1)[:-1]

    def settle(self):
        if self.words.new:
            self.hashes = np.concatenate([self.hashes, np.array([word_hash(w) for w in self.words.new], dtype=np.uint64)])
            self.texts += self.words.new
            self.words.new.clear()


def distinct(words: list[np.ndarray], ok: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct phrases, their counts and their ``ok``; phrases are given by their words, position by position."""
    bits = max(int(w.max()) for w in words).bit_length()
    if bits * len(words) < 63:
        # a whole phrase fits into a number, so that numbers alone are sorted
        keys = words[0]
        for word in words[1:]:
            keys = keys << bits | word
        keys = keys << 1 | ok
        keys.sort()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts, keys = np.diff(np.append(starts, len(keys))), keys[starts]
        own = [keys >> (1 + bits * k) & ((1 << bits) - 1) for k in reversed(range(len(words)))]
        return own, counts, keys & 1 == 1
    keys = words[0]
    for word in words[1:-1]:
        keys = np.unique(keys << 32 | word, return_inverse=True)[1]
    _, first, counts = np.unique(keys << 32 | words[-1], return_index=True, return_counts=True)
    return [w[first] for w in words], counts, ok[first]


def counted(ids: np.ndarray, hashes: np.ndarray, group: int, old: list, new: list, most: int):
    """(word numbers position by position, counts, accepted) of the phrases of each level that this pass counts.

    A phrase of two or more words is counted once both its parts are counted and accepted.  What the tables ``old``
    alone lead to was counted by earlier passes, words by the first one, which has no ``old``.
    """
    counts = np.bincount(ids, minlength=len(hashes))
    counts[0] = 0
    own = np.flatnonzero(counts)
    key_hashes = phrase_hashes([hashes[own]], group)
    before = np.zeros(len(hashes), dtype=bool)
    now = np.zeros(len(hashes), dtype=bool)
    before[own] = accepted(key_hashes, old)
    now[own] = before[own] | accepted(key_hashes, new)
    if not old:
        yield [own], counts[own], now[own]
    ok, ok_before = now[ids], before[ids]
    for level in range(2, most + 1):
        both, earlier = ok[:-1] & ok[1:], ok_before[:-1] & ok_before[1:]
        if not both.any():
            return
        fresh = np.flatnonzero(both & ~earlier)
        ok, ok_before = np.zeros(len(both), dtype=bool), np.zeros(len(both), dtype=bool)
        if level < most:
            at = np.flatnonzero(both)
            key_hashes = phrase_hashes([hashes[ids[at + k]] for k in range(level)], group)
            found = earlier[at] & accepted(key_hashes, old)
            ok_before[at] = found
            ok[at] = found | accepted(key_hashes, [*old, *new])
        if len(fresh):
            yield distinct([ids[fresh + k] for k in range(level)], ok[fresh])


def blocks(batches):
    """The parts of texts of each group, ``BLOCK_BYTES`` and one part at most together."""
    block, size = {}, 0
    for batch in batches:
        for group, text in zip(batch.column("grp").to_pylist(), batch.column("text")):
            for part in segments(text.as_py()):
                block.setdefault(group, []).append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield block
                    block, size = {}, 0
    if block:
        yield block


ROW = "grp string, level int, phrase string, n long, ok boolean"


def _pass(texts: DataFrame, old: list[bytes], new: list[bytes] | None, most: int) -> DataFrame:
    """Counts of this pass per chunk of rows, and as level 0 the number of words of each group, in the first pass."""
    sc = texts.sparkSession.sparkContext
    held = sc.broadcast((old, new))

    def run(batches):
        before = [Bits(b) for b in held.value[0]]
        after = [Everything()] if held.value[1] is None else [Bits(b) for b in held.value[1]]
        vocabulary, waiting, size = Vocabulary(), {}, 0
        for block in blocks(batches):
            for group, ids in zip(block, vocabulary.numbers([b"\n".join(parts) for parts in block.values()])):
                waiting.setdefault(group, []).append(ids)
                size += len(ids)
            if size >= CHUNK_WORDS:
                yield from flush(vocabulary, waiting, before, after)
                waiting, size = {}, 0
                pa.default_memory_pool().release_unused()
                if len(vocabulary.words) > CACHE_WORDS:
                    vocabulary = Vocabulary()
        yield from flush(vocabulary, waiting, before, after)

    def flush(vocabulary, waiting, before, after):
        vocabulary.settle()
        texts_ = pa.array(vocabulary.texts, pa.binary())
        for group, parts in waiting.items():
            ids = np.concatenate(parts)
            seed = word_hash(group.encode())
            if not before:
                yield frame(group, 0, pa.array([""]), np.array([np.count_nonzero(ids)]), np.array([False]))
            for words, counts, ok in counted(ids, vocabulary.hashes, seed, before, after, most):
                for at in range(0, len(counts), 100_000):
                    chosen = [texts_.take(pa.array(w[at:at + 100_000])) for w in words]
                    phrase = pc.binary_join_element_wise(*chosen, b" ") if len(chosen) > 1 else chosen[0]
                    yield frame(group, len(words), phrase.cast(pa.string()), counts[at:at + 100_000], ok[at:at + 100_000])

    def frame(group, level, phrase, counts, ok):
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array([group]).take(pa.array(np.zeros(n, dtype=np.int64))), pa.array(np.full(n, level, dtype=np.int32)), phrase,
                                           pa.array(counts.astype(np.int64)), pa.array(ok)], ["grp", "level", "phrase", "n", "ok"])

    return map_batches(texts, run, ROW)


def _at_least(counts: DataFrame, least: int, label: str) -> DataFrame:
    """Sums of at least ``least``.  A chunk has each phrase once and most phrases are rare, so they are dealt before they are added up."""
    keys = ["grp", "level", "phrase", "ok"]
    dealt = counts.repartition(*keys)
    return written(dealt.groupBy(*keys).agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("level") == 0)), label)


def bit_table(phrases: DataFrame) -> bytes:
    """The phrases (grp, phrase) as bits; the driver gets the table of ``MOST_BITS`` at most, never the phrases."""
    n = phrases.count()
    if not n:
        return b""
    bits = min(max(1 << (BITS_EACH * n - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def spread(batches):
        for batch in batches:
            at = [np.empty(0, dtype=np.int64)]
            for group, phrase in zip(batch.column("grp").to_pylist(), batch.column("phrase").to_pylist()):
                words = [np.array([word_hash(w)], dtype=np.uint64) for w in phrase.encode().split(b" ")]
                at += positions(phrase_hashes(words, word_hash(group.encode())), bits)
            at = np.unique(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE_BITS), pa.array(at % PIECE_BITS)], ["piece", "at"])

    def gather(batches):
        current, table = None, None

        def close():
            rows = ([current], [np.packbits(table, bitorder="little").tobytes()]) if current is not None else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["piece", "bits"])

        for batch in batches:
            pieces, at = (batch.column(c).to_numpy() for c in ("piece", "at"))
            for piece in np.unique(pieces).tolist():
                if piece != current:
                    yield close()
                    current, table = piece, np.zeros(PIECE_BITS, dtype=np.uint8)
                table[at[pieces == piece]] = 1
        yield close()

    rows = map_batches(phrases.select("grp", "phrase"), spread, "piece long, at long")
    made = map_batches(rows.repartition("piece").sortWithinPartitions("piece"), gather, "piece long, bits binary").collect()
    out = bytearray(bits // 8)
    for r in made:
        out[r["piece"] * PIECE_BITS // 8:(r["piece"] + 1) * PIECE_BITS // 8] = r["bits"]
    return bytes(out)


def frequent_phrases(df: DataFrame, text_col: str, group_col: str, least: int = MIN_COUNT, most: int = MAX_WORDS, share: float = SAMPLE) -> DataFrame:
    """(grp, level, phrase, n): all phrases of 1 to ``most`` words with ``least`` occurrences or more in their group, exact.

    Level 0 has the number of words of each group.  At most ``most`` passes follow the one over the sample.
    """
    texts = df.select(F.coalesce(key(group_col).cast("string"), F.lit("und")).alias("grp"), text_or_empty(text_col).cast("binary").alias("text"))
    new = b""
    if most > 1:
        sample = _at_least(_pass(texts.filter(F.rand(SEED) < share), [], None, most - 1), SAMPLE_COUNT, "sample")
        new = bit_table(sample.filter("level > 0"))
    old: list[bytes] = []
    found: list[DataFrame] = []
    while True:
        # without proposals the table has no member, but there is a table, so that words count as seen
        new = new or bytes(LEAST_BITS // 8)
        found.append(_at_least(_pass(texts, old, [new], most), least, f"pass-{len(found)}"))
        old = [*old, new]
        failures = found[-1].filter((F.col("level") > 0) & (F.col("level") < most) & ~F.col("ok"))
        if failures.isEmpty():
            break
        new = bit_table(failures)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("grp", "level", "phrase", "n")


def best_cuts(frequent: DataFrame) -> DataFrame:
    """(grp, phrase, a, l, r, score) of the frequent phrases of two or more words, with their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = (frequent.filter("level > 1").select("grp", "phrase", F.col("n").alias("a"), "level", words.alias("w"))
            .select("grp", "phrase", "a", "w", "level", F.explode(F.sequence(F.lit(1), F.col("level") - 1)).alias("k"))
            .select("grp", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                    F.array_join(F.slice("w", F.col("k") + 1, F.col("level")), " ").alias("rest")))
    parts = frequent.filter("level > 0")
    with_first = written(looked_up(written(cuts, "cuts"), ["grp", "first"], parts.select("grp", F.col("phrase").alias("first"), F.col("n").alias("l"))), "first")
    both = looked_up(with_first, ["grp", "rest"], parts.select("grp", F.col("phrase").alias("rest"), F.col("n").alias("r")))
    exact = {c: f"cast({c} AS decimal(14,0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 AS decimal(7,0)) * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})")
    return (both.select("grp", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("grp", "phrase", "a")
            .agg(F.min("cut").alias("cut")).select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def not_covered(candidates: DataFrame, frequent: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates that no longer frequent phrase holds in ``percent`` of their occurrences or more."""
    long_ = frequent.filter("level > 2").select("grp", "n", "level", F.split("phrase", " ").alias("w"))
    inner = (long_.select("grp", "n", "level", "w", F.explode(F.expr("sequence(2, level - 1)")).alias("size"))
             .select("grp", "n", "w", "size", F.explode(F.expr("sequence(1, level - size + 1)")).alias("at"))
             .select("grp", "n", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")))
    held = inner.groupBy("grp", "phrase").agg(F.max("n").alias("held"))
    joined = candidates.join(held, ["grp", "phrase"], "left")
    return joined.filter(F.col("held").isNull() | (F.col("held").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * percent)).drop("held")


def collocations(df: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = MIN_COUNT, most: int = MAX_WORDS,
                 top: int = TOP, percent: int = 50, share: float = SAMPLE) -> DataFrame:
    """The best phrases of each group: ``group_col, rank, phrase, a, l, r, n, score``, numbers long.

    Texts, A-Z in lower case, are split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and
    tabs.  ``a`` counts a phrase of 2 to ``most`` words within pieces, overlaps included; ``l`` and ``r`` its parts at the
    cut with the least score floor(1000000 a a / (l r)), the first among equals; ``n`` all words of the group.  Phrases with
    ``a`` below ``least`` go, and those that a longer frequent one holds in ``percent`` of their occurrences; ``top`` stay
    by score, then ``a``, both descending, then phrase.  A null group is ``und``, a null text empty; repeated rows count
    each; an empty table gives no rows; other columns are not read.
    """
    frequent = written(frequent_phrases(df, text_col, group_col, least, most, share), "frequent")
    ranked = not_covered(best_cuts(frequent), frequent, percent)
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.expr(f"pmod(xxhash64(phrase), {PARTS})")
    first = Window.partitionBy("grp", "part").orderBy(*order)
    ranked = ranked.withColumn("part", part).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = frequent.filter("level = 0").groupBy("grp").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "grp").select(F.col("grp").alias(group_col), "rank", "phrase", "a", "l", "r", "n", "score")
