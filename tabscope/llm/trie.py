"""Prefix trie of conversations from padded turn-id matrices.

Conversations are dealt by range of their turn sequences.  In a shard the turns become ids in matrices padded to equal
width; a lexsort puts equal beginnings side by side, the accumulated change masks of the columns say at which depth each
row leaves the one before it, and ``reduceat`` adds up the nodes of every depth.  Nodes on a shard's first and last path may
go on in the next shard: these alone are put together again, in range order, with a stack of open nodes.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import key, looked_up, map_batches, written

#: A turn in a path: 16 bytes that identify role and text, 8 bytes with the length of the text.
UNIT = 24
#: Columns of one padded matrix; longer conversations take several, each with the rows that are that long.
WIDTH = 32
#: Turns of a shard, about.
SHARD_TURNS = 1 << 19
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: The last path of a shard is numbered after the first.
LAST = 1 << 32


def turn_paths(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, path array<string>): the turns of each conversation in order, each as hex of a digest and a length.

    Rows go by turn, null first, then by role and digest; a null role or text is empty.  Rows without a conversation
    id belong to none.
    """
    role, text = F.coalesce(key(role_col), F.lit("")), F.coalesce(key(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    unit = F.concat(F.substring(digest, 1, 2 * (UNIT - 8)), F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 16, "0"))
    rows = df.select(key(id_col, "c"), key(turn_col, "t"), role.alias("r"), unit.alias("u")).filter("c is not null")
    ordered = F.sort_array(F.collect_list(F.struct("t", "r", "u")))
    return rows.groupBy("c").agg(F.transform(ordered, lambda x: x["u"]).alias("path"))


def rebuilt(paths: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % family; h = crc32 of c as text % most."""
    base = paths.select(F.col("c").alias("b"), F.slice("path", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = F.expr("c - c % " + str(family))
    nothing = F.array().cast("array<string>")
    head = F.slice(F.coalesce("head", nothing), F.lit(1), h)
    return paths.join(base, own == F.col("b"), "left").select("c", F.concat(head, F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


def _units(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all turns, in their order as bytes, one after the other, and the number of turns of each path."""
    lengths = np.array([len(p) // UNIT for p in paths], dtype=np.int64)
    words = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, UNIT // 8).astype(np.uint64)
    ids = np.empty(len(words), dtype=np.int64)
    if len(words):
        order = np.lexsort(words.T[::-1])
        words = words[order]
        ids[order] = np.cumsum(np.r_[False, (words[1:] != words[:-1]).any(axis=1)])
    return ids, lengths


def _matrix(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int) -> np.ndarray:
    """Columns at, at + 1, ... of the rows, padded with -1."""
    width = min(WIDTH, int((lengths - at).max()))
    places = at + np.arange(width)
    held = places[None, :] < lengths[:, None]
    return np.where(held, ids[np.where(held, starts[:, None] + places[None, :], 0)], -1)


def sorted_rows(ids: np.ndarray, lengths: np.ndarray, convs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by turn ids, then conversation, and how many first turns each shares with the one before."""
    starts = np.cumsum(lengths) - lengths
    rest = np.zeros(len(lengths), dtype=np.int64)
    deepest = int(lengths.max(initial=0))
    for at in range((max(deepest, 1) - 1) // WIDTH * WIDTH, -1, -WIDTH):
        rows = np.flatnonzero(lengths > at)
        if not len(rows):
            continue
        block = _matrix(ids, starts[rows], lengths[rows], at)
        order = np.lexsort([rest[rows], *block.T[::-1]])
        block, later = block[order], rest[rows[order]]
        rest[rows[order]] = 1 + np.cumsum(np.r_[False, (block[1:] != block[:-1]).any(axis=1) | (later[1:] != later[:-1])])
    order = np.lexsort([convs, rest])
    starts, lengths = starts[order], lengths[order]
    shared = np.zeros(len(order), dtype=np.int64)
    same = np.r_[False, np.ones(max(len(order) - 1, 0), dtype=bool)]  # rows equal to the one before in all columns so far
    for at in range(0, deepest, WIDTH):
        rows = np.flatnonzero(same & (lengths > at))
        rows = rows[lengths[rows - 1] > at]
        same[:] = False
        if not len(rows):
            break
        block, before = (_matrix(ids, starts[r], lengths[r], at) for r in (rows, rows - 1))
        width = min(block.shape[1], before.shape[1])
        changed = np.logical_or.accumulate((block[:, :width] != before[:, :width]) | (block[:, :width] < 0), axis=1)
        equal = (~changed).sum(axis=1)
        shared[rows] += equal
        same[rows[equal == WIDTH]] = True
    return order, shared


def shard_nodes(paths: list[bytes], convs: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """The nodes of one shard: those that are whole, and the parts of those on its first and last path.

    Whole: (conv, depth, parent's conv or None, n_convs, n_children, n_leaves, saved, ends, parent's place or None).
    Parts: (place, depth, unit, n, least conv, whole children, their leaves, their saved, ends as text).
    """
    ids, lengths = _units(paths)
    order, shared = sorted_rows(ids, lengths, convs)
    convs, lengths = convs[order], lengths[order]
    paths = [paths[i] for i in order.tolist()]
    deepest, n_rows = int(lengths.max()), len(paths)
    levels = []
    alive = np.arange(n_rows)
    for depth in range(deepest + 1):
        alive = alive[lengths[alive] >= depth]
        starts = np.flatnonzero(shared[alive] < depth) if depth else np.zeros(1, dtype=np.int64)
        first = alive[starts]
        count = np.diff(np.r_[starts, len(alive)])
        least = np.minimum.reduceat(convs[alive], starts)
        border = np.zeros(len(starts), dtype=bool)
        border[0] = first[0] == 0
        border[-1] |= alive[-1] == n_rows - 1
        levels.append((alive, starts, first, count, least, border))
    whole, parts = [], []
    kid, leaf, saved = (np.zeros(n_rows, dtype=np.int64) for _ in range(3))
    for depth in range(deepest, -1, -1):
        alive, starts, first, count, least, border = levels[depth]
        kids, leaves, sums = (np.add.reduceat(a[alive], starts) for a in (kid, leaf, saved))
        sizes = np.array([int.from_bytes(paths[r][depth * UNIT - 8:depth * UNIT], "big") if depth else 0 for r in first.tolist()], dtype=np.int64)
        ending = np.add.reduceat((lengths[alive] == depth).astype(np.int64), starts)
        if depth:
            above = levels[depth - 1]
            parent = np.searchsorted(above[2], first, side="right") - 1
        total = sums + (count - 1) * sizes
        leaves = np.where((kids == 0) & ~border, 1, leaves)
        for a in (kid, leaf, saved):
            a[alive] = 0
        inner = np.flatnonzero(~border)
        kid[first[inner]], leaf[first[inner]], saved[first[inner]] = 1, leaves[inner], total[inner]
        for i in range(len(first)):
            row, ended = int(first[i]), int(ending[i])
            at = int(alive[starts[i]])
            ends = ",".join(map(str, convs[at:at + ended].tolist())) if ended else ""
            if border[i]:
                place = depth if row == 0 else LAST + depth
                parts.append((place, depth, paths[row][(depth - 1) * UNIT:depth * UNIT] if depth else b"", int(count[i]), int(least[i]),
                              int(kids[i]), int(leaves[i]), int(sums[i]), ends))
            else:
                up = int(parent[i])
                place = None
                if above[5][up]:
                    place = depth - 1 if above[2][up] == 0 else LAST + depth - 1
                whole.append((int(least[i]), depth, None if place is not None else int(above[4][up]), int(count[i]), int(kids[i]), int(leaves[i]),
                              int(total[i]), hashlib.sha256(ends.encode()).hexdigest() if ended else NO_ENDS, place))
    return whole, sorted(parts)


ROW = ("shard long, part boolean, place long, depth long, unit binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
       "n_leaves long, saved_tokens long, ends string")
ARROW = pa.schema([("shard", pa.int64()), ("part", pa.bool_()), ("place", pa.int64()), ("depth", pa.int64()), ("unit", pa.binary()),
                   *[(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends", pa.string())])
OUT_ROWS = 20_000


def _shards(paths: DataFrame, n: int) -> DataFrame:
    """The nodes and parts of nodes of all shards; a partition by range is a shard."""
    def run(batches):
        shard, held, convs = None, [], []
        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                held += batch.column("path").to_pylist()
                convs.append(batch.column("c").to_numpy(zero_copy_only=False))
        if not held:
            return
        whole, parts = shard_nodes(held, np.concatenate(convs))
        rows = [(shard, True, place, depth, unit, conv, None, count, *rest) for place, depth, unit, count, conv, *rest in parts]
        rows += [(shard, False, place, depth, None, conv, parent, *rest) for conv, depth, parent, *rest, place in whole]
        for at in range(0, len(rows), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + OUT_ROWS]), ARROW)], schema=ARROW)

    dealt = paths.repartitionByRange(n, "path", "c").withColumn("shard", F.spark_partition_id().cast("long"))
    return map_batches(dealt, run, ROW)


class Open:
    """A node that later shards may continue."""

    def __init__(self, number, parent, depth, unit):
        self.number, self.parent, self.depth, self.unit = number, parent, depth, unit
        self.count = self.kids = self.leaves = self.saved = 0
        self.conv, self.ends, self.any = None, hashlib.sha256(), False

    def add(self, count, conv, kids, leaves, saved, ends):
        self.count, self.kids, self.leaves, self.saved = self.count + count, self.kids + kids, self.leaves + leaves, self.saved + saved
        self.conv = conv if self.conv is None else min(self.conv, conv)
        if ends:
            self.ends.update((("," if self.any else "") + ends).encode())
            self.any = True

    def close(self, above: "Open | None") -> tuple:
        self.leaves = self.leaves if self.kids else 1
        self.saved += (self.count - 1) * int.from_bytes(self.unit[UNIT - 8:], "big")
        if above:
            above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + self.leaves, above.saved + self.saved
        return (None, None, self.number, self.parent, self.conv, self.depth, self.count, self.kids, self.leaves, self.saved, self.ends.hexdigest())


JOINED = ("shard long, place long, number long, parent long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string")


def _joined(parts: DataFrame) -> DataFrame:
    """Put the parts together: rows (shard, place, number) that name the node of each part, and one row per node.

    The parts come in range order, two paths a shard, so one task reads them with a stack as deep as a path.
    """
    def run(batches):
        stack, made, here = [], 0, None
        for batch in batches:
            out = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("shard", "place", "depth", "unit", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens", "ends")])
            for shard, place, depth, unit, *numbers in rows:
                goes_on = place < LAST and len(stack) > depth and stack[depth].unit == unit
                while len(stack) > depth and not goes_on:
                    node = stack.pop()
                    out.append(node.close(stack[-1] if stack else None))
                if not goes_on:
                    stack.append(Open(made, stack[-1].number if stack else None, depth, unit))
                    made += 1
                stack[depth].add(*numbers)
                out.append((shard, place, stack[depth].number, *[None] * 8))
            yield frame(out)
        out = []
        while stack:
            node = stack.pop()
            out.append(node.close(stack[-1] if stack else None))
        yield frame(out)

    def frame(out):
        columns = list(zip(*out)) or [()] * 11
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 10 else pa.string()) for i, c in enumerate(columns)],
                                          ["shard", "place", "number", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])

    return map_batches(parts.coalesce(1).sortWithinPartitions("shard", "place"), run, JOINED)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per distinct beginning of the paths (c, path) that :func:`turn_paths` or :func:`rebuilt` gives.

    A node is a sequence of first turns, from the empty one that all conversations share (depth 0); its members are
    the conversations that begin with it.  Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (the
    parent's conv_id, null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes at or below it),
    ``saved_tokens`` (over the nodes at or below it, (members - 1) times the bytes of the last text), ``ends_sha256``
    (of the ids of the members that end there, ascending, joined by commas).  A conversation without turns ends at the
    root; no conversations give no rows.  A shard holds about ``SHARD_TURNS`` turns, one conversation at least.
    The ids that end at a node which goes over several shards pass through one task as text, for the one digest.
    """
    spark = paths.sparkSession
    source = written(paths.select(F.col("c").cast("long").alias("c"), F.unhex(F.array_join("path", "")).alias("path")), "paths")
    turns = source.agg(F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()[0] // UNIT
    shards = max(-(-turns // SHARD_TURNS), spark.sparkContext.defaultParallelism)
    rows = written(_shards(source, shards), "nodes")
    joined = written(_joined(rows.filter("part")), "joined")
    nodes = joined.filter("depth is not null").select("number", "parent", *[c for c in COLUMNS if c != "parent_conv_id"])
    names = nodes.select("number", "conv_id")
    above = names.select(F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    border = looked_up(nodes, ["parent"], above).select(*COLUMNS)
    places = looked_up(joined.filter("depth is null").select("shard", "place", "number"), ["number"], names)
    places = written(places.select("shard", "place", F.col("conv_id").alias("up")), "places")
    inner = rows.filter("not part").withColumnRenamed("ends", "ends_sha256")
    below = looked_up(inner.filter("place is not null").select("shard", "place", *COLUMNS), ["shard", "place"], places)
    below = below.withColumn("parent_conv_id", F.col("up")).select(*COLUMNS)
    return border.unionByName(below).unionByName(inner.filter("place is null").select(*COLUMNS))
