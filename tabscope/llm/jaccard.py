"""Jaccard join of word n-grams by chosen paths.

Every set of n-grams is represented by min-hash tokens.  A run splits the sets on one shared token; buckets
that are still large are split again on sampled tokens, until they are small or as alike as the threshold, and
are then compared by brute force.  Runs are repeated until a pair at the threshold is missed with less
than the allowed chance.  Links are counted in matrices inside tasks; pairs are never rows.
"""
from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bpe import Words, groups_of
from .common import key, map_batches, marked_rows, text_or_empty, written
from .components import components

WORDS = 5
#: The threshold as a fraction of whole numbers.
THRESHOLD = (4, 5)
TARGET_RECALL = 0.9999
#: Sets in a bucket that is compared without another split, tokens sampled at a split, tokens to sample from, and
#: the share of its parent from which on a bucket counts as alike.
SMALL = 64
SAMPLED = 2
POOL = 16
ALIKE = 0.7
MAX_DEPTH = 12
#: Two sets at the threshold share this part of their tokens at least, but for a chance below 1e-7 (24 tokens).
SHARED_TOKENS = 1 / 3
#: A block of a large bucket: sets, and n-grams of all of them. Every pair of blocks is compared, by one task each.
BLOCK_SETS = 512
BLOCK_NGRAMS = 200_000
CACHE_WORDS = 400_000
COLUMNS = 4096
WORD = regex.compile("[^\\x20\\x09-\\x0D]+")


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold is missed with chance 1 - recall, when three splits follow the first.

    Taken as if runs were independent.  They share a pool of tokens and buckets may split up to MAX_DEPTH times, so the
    chance of a miss is larger where splits go deeper.
    """
    kept = threshold * (1 - (1 - threshold) ** SAMPLED) ** 3
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


class Hashes:
    """64-bit hashes of words, remembered, and of n-grams from them."""

    def __init__(self):
        self.words, self.values = Words(), np.empty(0, dtype=np.uint64)

    def ngrams(self, text: str, n: int) -> np.ndarray:
        """The distinct n-grams of a text, sorted; a text of fewer words is one n-gram, one without words has none."""
        if len(self.words) > CACHE_WORDS:
            self.__init__()
        words = WORD.findall(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        numbers = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        if self.words.new:
            fresh = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.new], dtype=np.uint64)
            self.values = np.concatenate([self.values, fresh])
            self.words.new.clear()
        values = self.values[numbers]
        size = min(n, len(values))
        total = np.full(len(values) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total += values[k:len(values) - size + 1 + k] * odd(k)
        total ^= total >> np.uint64(31)
        total *= odd(1000)
        total ^= total >> np.uint64(29)
        return np.unique(total)


@lru_cache(maxsize=4096)
def odd(k: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"odd {k}") | 1)


def tokens(ngrams: np.ndarray, count: int) -> list[int]:
    """Min-hash tokens: the least value of the n-grams under each of ``count`` hash functions."""
    seeds = np.array([xxhash.xxh3_64_intdigest(f"seed {k}") for k in range(count)], dtype=np.uint64)[:, None]
    factors = np.array([odd(2000 + k) for k in range(count)], dtype=np.uint64)[:, None]
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(ngrams), 1 << 15):
        value = (ngrams[None, at:at + (1 << 15)] ^ seeds) * factors
        value ^= value >> np.uint64(32)
        least = np.minimum(least, value.min(axis=1))
    return least.view(np.int64).tolist()


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(key(id_col, "id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def sketches(df: DataFrame, id_col: str, text_col: str, n: int, count: int) -> DataFrame:
    """(id, hash of the text, number of n-grams, digest of the set, tokens), one row per input row."""
    source = _texts(df, id_col, text_col)
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, digests, mins = [], [], []
            for text in batch.column("text"):
                own = hashes().ngrams(text.as_py(), n)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None)
                mins.append(tokens(own, count) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(mins, pa.list_(pa.int64()))], ["id", "hash", "n_ngrams", "digest", "tokens"])

    return map_batches(source, run, f"id {id_type}, hash long, n_ngrams long, digest string, tokens array<long>")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows, start = batch.column("set"), 0
            for _, group in groups_of(batch.column("text")):
                found = [hashes().ngrams(t, n).view(np.int64) for t in group]
                yield pa.RecordBatch.from_arrays([rows.slice(start, len(group)), pa.array(found, pa.list_(pa.int64()))], ["set", "ngrams"])
                start += len(group)

    return map_batches(texts.select("set", "text"), run, "set long, ngrams array<long>")


def buckets(sets: DataFrame, runs: int, small: int = SMALL) -> DataFrame:
    """(set, bucket): the buckets of two or more sets at the ends of all paths; equal buckets count once."""
    rows = sets.select("set", F.posexplode(F.slice("tokens", 1, runs)).alias("run", "token")).select(
        "set", F.xxhash64("run", "token").alias("bucket"), F.lit(None).cast("long").alias("parent_size"))
    ends = []
    for depth in range(MAX_DEPTH + 1):
        rows = written(rows, f"paths-{depth}")
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max("parent_size").alias("parent_size")).filter("size > 1")
        alike = F.coalesce(F.col("size") >= ALIKE * F.col("parent_size"), F.lit(False))
        last = (F.col("size") <= small) | alike | F.lit(depth == MAX_DEPTH)
        sizes = written(sizes.select("bucket", "size", last.alias("last")), f"sizes-{depth}")
        ends.append(rows.select("set", "bucket").join(sizes.filter("last").select("bucket", "size"), "bucket"))
        large = sizes.filter("not last").select("bucket", "size")
        if large.isEmpty():
            break
        choice = F.explode(F.array(*[F.expr(f"pmod(xxhash64(bucket, {k}, 'choice'), {POOL})") for k in range(SAMPLED)]))
        rows = (rows.select("set", "bucket").join(large, "bucket").join(sets.select("set", "tokens"), "set")
                .select("set", "bucket", "tokens", F.col("size").alias("parent_size"), choice.alias("choice"))
                .select("set", F.xxhash64("bucket", "choice", F.get("tokens", F.col("choice").cast("int") + runs)).alias("bucket"),
                        "parent_size").distinct())
    found = ends[0]
    for more in ends[1:]:
        found = found.unionByName(more)
    found = written(_joined(sets, written(found, "ends"), small), "joined")
    mark = F.xxhash64("set")
    same = (found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("x"), F.sum(mark % 1_000_000_007).alias("s"))
            .groupBy("size", "x", "s").agg(F.min("bucket").alias("bucket")))
    return found.join(same.select("bucket"), "bucket")


def _joined(sets: DataFrame, ends: DataFrame, small: int) -> DataFrame:
    """Large buckets that share sets become one, so that a large group is compared once and not by every run.

    Of a small bucket only sets stay whose tokens say that they may reach the threshold with another in it.
    """
    large = ends.filter(F.col("size") > small).select("set", "bucket")
    rest = _likely(ends.filter(F.col("size") <= small).select("set", "bucket").join(sets.select("set", "tokens"), "set"))
    if large.isEmpty():
        return rest
    first = large.groupBy("bucket").agg(F.min("set").alias("first"))
    groups = components(large.join(first, "bucket").select(F.col("set").alias("a"), F.col("first").alias("b")))
    return rest.unionByName(groups.select(F.col("node").alias("set"), F.xxhash64("root", F.lit("group")).alias("bucket")))


def _likely(rows: DataFrame) -> DataFrame:
    """(set, bucket) of the sets that share enough tokens with another set of their bucket."""
    def run(batches):
        current, ids, tokens_ = None, [], []

        def close():
            keep = []
            if len(ids) > 1:
                held = np.array(tokens_)
                same = (held[:, None, :] == held[None, :, :]).sum(axis=2)
                np.fill_diagonal(same, 0)
                keep = [ids[i] for i in np.flatnonzero(same.max(axis=1) >= SHARED_TOKENS * held.shape[1])]
            return [(i, current) for i in keep]

        for batch in batches:
            out = []
            tokens_of = batch.column("tokens")
            for i, (own, bucket) in enumerate(zip(batch.column("set").to_pylist(), batch.column("bucket").to_pylist())):
                if bucket != current:
                    out += close()
                    current, ids, tokens_ = bucket, [], []
                ids.append(own)
                tokens_.append(tokens_of[i].values.to_numpy())
            yield frame(out)
        yield frame(close())

    def frame(out):
        columns = list(zip(*out)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["set", "bucket"])

    return map_batches(rows.repartition("bucket").sortWithinPartitions("bucket"), run, "set long, bucket long")


def linked(counts: np.ndarray, sizes: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs reach the threshold, from their common n-grams; exact."""
    up, down = threshold
    common = counts.astype(np.int64)
    return common * down >= up * (sizes[:, None] + sizes[None, :] - common)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each two sets."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(start) - 1
    shared = (np.bincount(column) > 1)[column]
    owner, column = owner[shared], column[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    if len(column):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            out += part @ part.T
    return out


def compare_block(bucket: int, first: int, second: int, rows: list[tuple], threshold: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(set, linked documents, least set of its group here) from one block or pair of blocks.

    A pair that shares an earlier bucket is counted there, and a pair of one side in the block of that side.
    """
    ids = np.array([r[0] for r in rows])
    weights = np.array([r[1] for r in rows], dtype=np.int64)
    side = np.array([r[2] for r in rows])
    if first != second and side.min() == side.max():
        return []
    sets = [r[4] for r in rows]
    link = linked(common_counts(sets), np.array([len(s) for s in sets]), threshold)
    if first != second:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    if not link.any():
        return []
    earlier = sorted({b for r in rows for b in r[3] if b < bucket})
    if earlier:
        place = {b: i for i, b in enumerate(earlier)}
        held = np.zeros((len(rows), len(earlier)), dtype=np.float32)
        for i, r in enumerate(rows):
            held[i, [place[b] for b in r[3] if b < bucket]] = 1
        link &= held @ held.T == 0
    root = ids.copy()
    while True:
        near = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, near)
        if (new == root).all():
            break
        root = new
    counts = (link * weights[None, :]).sum(axis=1)
    return [(int(ids[i]), int(counts[i]), int(root[i])) for i in np.flatnonzero(counts)]


def _compared(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows come sorted by (bucket, first, second); each run of equal keys is compared as a whole."""
    def run(batches):
        current, held = None, []

        def close():
            found = compare_block(*current, held, threshold) if len(held) > 1 else []
            columns = list(zip(*found)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["set", "links", "root"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "first", "second", "set", "weight", "side", "held")]
            ngrams = batch.column("ngrams")
            for i, (bucket, first, second, own, weight, side, buckets_) in enumerate(zip(*columns)):
                if (bucket, first, second) != current:
                    if held:
                        yield close()
                    current, held = (bucket, first, second), []
                held.append((own, weight, side, buckets_, ngrams[i].values.to_numpy(zero_copy_only=False)))
        if held:
            yield close()

    return map_batches(rows, run, "set long, links long, root long")


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                   threshold: tuple[int, int] = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per input row: ``id_col, class_id, n_links long, n_ngrams long, first boolean, text_hash long``.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams reaches the threshold
    (a fraction such as (4, 5)).  ``class_id`` is the least id among all documents that chains of links
    reach; ``n_links`` counts linked documents, each copy for itself; ``first`` marks the one row of a class that
    stays (least id, then least text hash).  A text of fewer than n words is one n-gram; a null or
    empty text, or one without words, is linked to nothing.  Every pair at or above the threshold is found
    with a chance near ``recall`` (see ``runs_for`` for what it leaves out), and no pair below it is.  Repeated rows link to each other.
    An empty table gives no rows; other columns are not read.
    """
    runs = runs_for(recall, threshold[0] / threshold[1])
    docs = written(sketches(df, id_col, text_col, n, runs + POOL).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = (docs.filter("digest is not null").groupBy("digest")
               .agg(F.min("row").alias("set"), F.count(F.lit(1)).alias("weight")))
    classes = written(classes, "classes")
    sets = docs.select(F.col("row").alias("set"), "id", "hash", "n_ngrams", "tokens").join(classes.drop("digest"), "set")
    sets = written(sets, "sets")
    found = written(buckets(sets.select("set", "tokens"), runs), "buckets")

    # the n-grams of the sets that share a bucket with another
    wanted = sets.select("set", "id", "hash").join(found.select("set").distinct(), "set")
    source = _texts(df, id_col, text_col)
    texts = source.join(wanted, source["id"].eqNullSafe(wanted["id"]) & (source["hash"] == wanted["hash"])).select("set", "text")
    ngrams = written(_sets(texts, n).dropDuplicates(["set"]), "ngrams")
    lists = found.groupBy("set").agg(F.collect_list("bucket").alias("held"))
    members = written(sets.select("set", "weight", "n_ngrams").join(lists, "set").join(ngrams, "set"), "members")

    loads = (found.join(sets.select("set", "n_ngrams"), "set").groupBy("bucket")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("n_ngrams").alias("total"))
             .select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("total") / BLOCK_NGRAMS)).alias("blocks")))
    dealt = (found.join(loads, "bucket").withColumn("side", F.expr("pmod(xxhash64(set, bucket), blocks)"))
             .select("set", "bucket", "side", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
             .select("set", "bucket", "side", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second")))
    keys = ["bucket", "first", "second"]
    rows = dealt.join(members, "set").repartition(*keys).sortWithinPartitions(*keys)
    links = written(_compared(rows, threshold), "links")

    roots = components(links.select(F.col("set").alias("a"), F.col("root").alias("b")))
    per_set = links.groupBy("set").agg(F.sum("links").alias("links"))
    placed = written(classes.join(per_set, "set", "left").join(roots, F.col("set") == F.col("node"), "left")
                     .select("digest", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set").alias("root")), "placed")
    each = written(docs.select("row", "id", "hash", "n_ngrams", "digest").join(placed, "digest", "left")
                   .withColumn("root", F.coalesce("root", "row")), "each")
    least = each.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct("id", "hash", "row")).alias("stays"))
    return each.join(least, "root").select(
        F.col("id").alias(id_col), "class_id", (F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0))).alias("n_links"),
        "n_ngrams", (F.col("row") == F.col("stays.row")).alias("first"), F.col("hash").alias("text_hash"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, one of each class, with all their columns."""
    groups = written(jaccard_groups(df, id_col, text_col), "groups")
    repeated = not groups.groupBy(id_col, "text_hash").count().filter("count > 1").isEmpty()
    return marked_rows(df, groups.filter("first"), {id_col: id_col}, text_col, once=repeated)
