"""Near-duplicate documents by bottom-k sketches of one hash function.

A document keeps the k least hashes of its word shingles.  Inverted lists of the retained values generate the overlaps:
a pair at the threshold shares so many values that, with values taken rarest first, it meets in a short prefix of its
lists.  The estimate on the sketch of the union drops what cannot reach the threshold, the full sets decide the rest.
Lists are first compared with their least members, one after another; what that does not connect is compared in blocks.
"""
from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.cells import union_all
from .bpe import groups_of
from .common import key, looked_up, map_batches, text_or_empty, written
from .components import components
from .jaccard import common_counts, hashes, linked

WORDS = 4
#: The threshold as a fraction of whole numbers.
THRESHOLD = (4, 5)
#: Retained values, and the chance that a pair at the threshold shares fewer of them than `shared_at_least`.
SKETCH = 64
MISSED = 1e-9
#: The rows compared with one least member are dealt over this many tasks.
SALTS = 32
#: Rounds in which the least member of a list is compared with the others and leaves it.
ROUNDS = 1
#: Lists of more sets that share sets are compared as one.
SMALL = 64
#: Candidate pairs per set of a block from which on they are counted by matrices.
MANY = 4
#: A block of a list: sets, and shingles of all of them.
BLOCK_SETS = 512
BLOCK_SHINGLES = 200_000


@lru_cache(maxsize=None)
def shared_at_least(size: int, threshold: float, missed: float = MISSED) -> int:
    """The count below which a sketch of a union has common values with chance ``missed`` at most, at the threshold.

    The values of the union's sketch are drawn without replacement, so the binomial tail bounds the chance.
    """
    total = 0.0
    for count in range(size + 1):
        total += math.comb(size, count) * threshold ** count * (1 - threshold) ** (size - count)
        if total > missed:
            return count
    return size


def needed(size: int, threshold: tuple[int, int], k: int = SKETCH) -> int:
    """Retained values that a document with ``size`` of them shares with any partner at the threshold."""
    up, down = threshold
    return min(-(-up * size // down), shared_at_least(k, up / down))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """The hashes of the distinct shingles of a text, A-Z in lower case, ascending."""
    return hashes().ngrams(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), n)


def may_reach(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int], k: int = SKETCH) -> bool:
    """The estimate from the sketch of the union: False only when the pair is below the threshold (but for ``MISSED``)."""
    up, down = threshold
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = np.concatenate([a[:k], b[:k]])
    both.sort()
    same = both[1:][both[1:] == both[:-1]]
    distinct = len(both) - len(same)
    if distinct <= k and len(a) <= k and len(b) <= k:
        return len(same) * down >= up * distinct
    union = both[np.r_[True, both[1:] != both[:-1]]][:k]
    return int(np.searchsorted(same, union[-1], side="right")) >= shared_at_least(k, up / down)


def reaches(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    """Exact Jaccard similarity of two full sets against the threshold."""
    up, down = threshold
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * down >= up * (len(a) + len(b) - common)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(key(id_col, "id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def sketches(df: DataFrame, id_col: str, text_col: str, n: int, k: int) -> DataFrame:
    """(id, hash of the text, number of shingles, digest of the set, the k least values), one row per input row."""
    source = _texts(df, id_col, text_col)
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, digests, least = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), n)
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                least.append(own[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(least, pa.list_(pa.int64()))], ["id", "hash", "n_shingles", "digest", "least"])

    return map_batches(source, run, f"id {id_type}, hash long, n_shingles long, digest binary, least array<long>")


def _full_sets(texts: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows, start = batch.column("set"), 0
            for _, group in groups_of(batch.column("text")):
                found = [shingles(t, n).view(np.int64) for t in group]
                yield pa.RecordBatch.from_arrays([rows.slice(start, len(group)), pa.array(found, pa.list_(pa.int64()))], ["set", "full"])
                start += len(group)

    return map_batches(texts.select("set", "text"), run, "set long, full array<long>")


def inverted_lists(sets: DataFrame, threshold: tuple[int, int], k: int = SKETCH) -> DataFrame:
    """(value, set): the lists of the values that each set keeps, rarest first, as many as a partner cannot miss.

    A set of s retained values that shares t of them with a partner meets it among its s - t + 1 rarest ones.  Values
    held by one set alone are the rarest; they take their places but make no list.
    """
    rows = sets.select("set", F.explode("least").alias("value"))
    counts = written(rows.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "values")
    shared = looked_up(rows, ["value"], counts).filter("holders is not null")
    each = shared.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("held"))
    up, down = threshold
    size = F.col("size")
    share = F.least(F.ceil(size * up / down).cast("long"), F.lit(shared_at_least(k, up / down)))
    places = F.greatest(size - share + 1 - (size - F.size("held")), F.lit(0)).cast("int")
    kept = (each.join(sets.select("set", F.size("least").cast("long").alias("size")), "set")
            .select("set", F.explode(F.slice("held", F.lit(1), places)).alias("at")))
    return written(kept.select(F.col("at.value").alias("value"), "set"), "lists")


def _with_least(pairs: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) among pairs (head, set): each head is held while the sets it is compared with pass by."""
    pairs = pairs.withColumn("salt", F.expr(f"pmod(xxhash64(set), {SALTS})"))
    heads = pairs.select("head", "salt").distinct().join(full.withColumnRenamed("set", "head"), "head")
    rows = (pairs.join(full, "set").select("head", "salt", F.col("set").alias("own"), "full")
            .unionByName(heads.select("head", "salt", F.lit(None).cast("long").alias("own"), "full")))

    def run(batches):
        head, held = None, None
        for batch in batches:
            out, full_ = [], batch.column("full")
            for i, (h, own) in enumerate(zip(batch.column("head").to_pylist(), batch.column("own").to_pylist())):
                here = full_[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                if own is None:
                    head, held = h, here.copy()
                elif may_reach(held, here, threshold) and reaches(held, here, threshold):
                    out.append((head, own))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    order = ["head", "salt"]
    return map_batches(rows.repartition(*order).sortWithinPartitions(*order, "own"), run, "a long, b long")


def link_block(key_: int, first: int, second: int, rows: list[tuple], threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between sets that are linked and not connected yet, enough to connect them, from one block or two.

    Rows are (set, root, side, lists it is in, full set).  A pair that shares an earlier list is left to that one, a pair
    of one side to the block of that side.
    """
    ids, roots, sides = (np.array([r[i] for r in rows]) for i in range(3))
    if first != second and sides.min() == sides.max():
        return []
    sets = [r[4] for r in rows]
    place = {r: i for i, r in enumerate(dict.fromkeys(roots.tolist()))}
    group = np.array([place[r] for r in roots.tolist()])
    sizes = np.array([len(s) for s in sets])
    enough = np.array([needed(min(n, SKETCH), threshold) for n in sizes.tolist()])
    maybe = common_counts([s[:SKETCH] for s in sets]) >= np.maximum(enough[:, None], enough[None, :])
    up, down = threshold
    maybe &= down * np.minimum(sizes[:, None], sizes[None, :]) >= up * np.maximum(sizes[:, None], sizes[None, :])
    maybe &= group[:, None] != group[None, :]
    if first != second:
        maybe &= sides[:, None] != sides[None, :]
    if not maybe.any():
        return []
    earlier = sorted({v for r in rows for v in r[3] if v < key_})
    if earlier:
        at = {v: i for i, v in enumerate(earlier)}
        held = np.zeros((len(rows), len(earlier)), dtype=np.float32)
        for i, r in enumerate(rows):
            held[i, [at[v] for v in r[3] if v < key_]] = 1
        maybe &= held @ held.T == 0
    parent = list(range(len(place)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    maybe = np.triu(maybe, 1)
    # many candidates are counted exactly all at once, few one by one behind the estimate of the union's sketch
    at_once = int(maybe.sum()) > MANY * len(rows)
    if at_once:
        maybe &= linked(common_counts(sets), sizes, threshold)
    links = []
    for a, b in zip(*np.nonzero(maybe)):
        x, y = find(group[a]), find(group[b])
        if x != y and (at_once or may_reach(sets[a], sets[b], threshold) and reaches(sets[a], sets[b], threshold)):
            parent[max(x, y)] = min(x, y)
            links.append((int(ids[a]), int(ids[b])))
    return links


def _in_blocks(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Rows come sorted by (value, first, second); each run of equal keys is one block or a pair of blocks."""
    def run(batches):
        current, held = None, []

        def close():
            columns = list(zip(*(link_block(*current, held, threshold) if len(held) > 1 else []))) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("value", "first", "second", "set", "root", "side", "held")]
            full = batch.column("full")
            for i, (value, first, second, *rest) in enumerate(zip(*columns)):
                if (value, first, second) != current:
                    if held:
                        yield close()
                    current, held = (value, first, second), []
                held.append((*rest, full[i].values.to_numpy(zero_copy_only=False).view(np.uint64)))
        if held:
            yield close()

    return map_batches(rows, run, "a long, b long")


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(value, set, root): the lists whose members are not all connected."""
    rows = written(lists.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), "rooted")
    apart = rows.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("value", F.lit(True).alias("apart"))
    return written(looked_up(rows, ["value"], written(apart, "apart")).filter("apart").select("value", "set", "root"), "open")


def _blocks(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """(value, set, root, side, first, second, held): open lists dealt to blocks; equal lists once, large ones joined.

    ``held`` has all lists of a set.
    """
    mark = F.xxhash64("set")
    kinds = (lists.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(mark).alias("x"), F.sum(mark % 1_000_000_007).alias("s"),
                                        F.min("set").alias("least"))
             .groupBy("m", "x", "s", "least").agg(F.min("value").alias("value")))
    rows = looked_up(lists, ["value"], written(kinds.select("value", "m", "least"), "kinds")).filter("m is not null")
    large = rows.filter(F.col("m") > SMALL)
    chosen = rows.filter(F.col("m") <= SMALL).select("value", "set", "root")
    if not large.isEmpty():
        joined = components(large.filter("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b")))
        joined = joined.select(F.col("node").alias("set"), F.xxhash64(F.col("root"), F.lit("group")).alias("value"))
        chosen = chosen.unionByName(large.select("set", "root").distinct().join(joined, "set").select("value", "set", "root"))
    chosen = written(chosen, "chosen")
    loads = (chosen.join(sizes, "set").groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
             .select("value", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).alias("blocks")))
    dealt = looked_up(chosen, ["value"], written(loads, "loads")).withColumn("side", F.expr("pmod(xxhash64(set, value), blocks)"))
    dealt = (dealt.select("value", "set", "root", "side", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
             .select("value", "set", "root", "side", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second")))
    return dealt.join(chosen.groupBy("set").agg(F.collect_list("value").alias("held")), "set")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                threshold: tuple[int, int] = THRESHOLD, k: int = SKETCH) -> DataFrame:
    """One row per input row: ``id_col, n_shingles long, component_id, kept boolean``.

    Two documents are linked when the Jaccard similarity of their sets of word shingles (n words, A-Z in lower case)
    reaches the threshold, a fraction such as (4, 5).  ``component_id`` is the least id that chains of links reach;
    ``kept`` says that it is the row's own.  A text of fewer than n words is one shingle; a null or empty text, or one
    without words, is linked to nothing and stays.  Repeated rows link to each other and have the same result; of ids
    that are null, none is least, and a component of such alone has a null id and is kept.  An empty table gives no
    rows; other columns are not read.  A link is missed with chance ``MISSED`` at most, and none is invented.
    """
    docs = written(sketches(df, id_col, text_col, n, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = (docs.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("set"), F.min("id").alias("least_id")))
    classes = written(docs.select(F.col("row").alias("set"), "id", "hash", F.col("n_shingles").alias("n"), "least")
                      .join(classes, "set"), "classes")
    lists = inverted_lists(classes.select("set", "least"), threshold, k)
    heads = lists.groupBy("value").agg(F.min("set").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    met = written(looked_up(lists, ["value"], written(heads, "heads")).filter("head is not null"), "met")

    # the full sets of what shares a list with another
    wanted = classes.select("set", "id", "hash").join(met.select("set").distinct(), "set")
    source = _texts(df, id_col, text_col)
    texts = source.join(wanted, source["id"].eqNullSafe(wanted["id"]) & (source["hash"] == wanted["hash"])).select("set", "text")
    full = written(_full_sets(texts, n).dropDuplicates(["set"]), "full")

    links, lists = [], met
    for step in range(ROUNDS):
        # pairs of a head with the members that no chain of links connects with it so far
        pairs = lists.filter("head <> set AND root <> head_root" if step else "head <> set").select("head", "set").distinct()
        links.append(written(_with_least(written(pairs, "pairs"), full, threshold), f"links-{step}"))
        roots = written(components(union_all(links)).select(F.col("node").alias("set"), "root"), f"roots-{step}")
        left = _open(lists.filter("head <> set").select("value", "set"), roots)
        if left.isEmpty() or step == ROUNDS - 1:
            break
        heads = left.groupBy("value").agg(F.min(F.struct("set", "root")).alias("h")).select("value", F.col("h.set").alias("head"), F.col("h.root").alias("head_root"))
        lists = written(looked_up(left, ["value"], written(heads, "heads")), "lists")
    if not left.isEmpty():
        keys = ["value", "first", "second"]
        rows = _blocks(left, classes.select("set", "n")).join(full, "set").repartition(*keys).sortWithinPartitions(*keys)
        links.append(written(_in_blocks(rows, threshold), "more"))
        roots = written(components(union_all(links)).select(F.col("node").alias("set"), "root"), "all-roots")

    rooted = written(classes.select("digest", "least_id", "set").join(roots, "set", "left")
                     .withColumn("root", F.coalesce("root", "set")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = written(looked_up(rooted.select("root", "digest"), ["root"], least).select("digest", "component_id"), "named")
    each = looked_up(docs.select("id", "n_shingles", "digest"), ["digest"], named)
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return each.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                       F.col("id").eqNullSafe(component).alias("kept"))
