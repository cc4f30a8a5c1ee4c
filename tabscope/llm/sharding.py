"""Balanced label propagation over linked documents, with DataFrame functions only.

Every document starts in a shard by hash.  In each round documents that share a link (a hub, such as
an equal text) move together to the shard where most of them are, as far as that shard has room when all that
have not moved yet leave theirs.  Last, unlinked rows move from shards that are too full to others, which cuts nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import key, text_or_empty, written

#: Rows of one window partition when rows are numbered.
CELL_ROWS = 1000
ROUNDS = 5
#: A hub is large from this part of a shard on; there are LARGE_PARTS * shards of them at most.
LARGE_PARTS = 16


def _numbered(rows: DataFrame, by: list[str], n_rows: int, column: str, parts: int) -> DataFrame:
    """Number the rows of each value of ``by`` from 0 without gaps; no task sees more than a few cells."""
    cells = max(1, -(-n_rows // (CELL_ROWS * parts)))
    dealt = rows.withColumn("cell", F.expr(f"pmod(xxhash64(row, 'cell'), {cells})"))
    cell = Window.partitionBy(*by, "cell")
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = (dealt.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    own = dealt.withColumn("within", F.row_number().over(cell.orderBy("row")) - 1)
    return own.join(counts, [*by, "cell"]).withColumn(column, F.col("within") + F.col("before")).drop("cell", "within", "before")


def _sizes_before(hubs: DataFrame, n_hubs: int, parts: int) -> DataFrame:
    """``before``: the sizes of the hubs of the same ``to`` that come earlier; no task sees more than a few cells."""
    cells = max(1, -(-n_hubs // (CELL_ROWS * parts)))
    dealt = hubs.withColumn("cell", F.expr(f"pmod(xxhash64(hub, 'cell'), {cells})"))
    earlier = Window.partitionBy("to").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = (dealt.groupBy("to", "cell").agg(F.sum("size").alias("total"))
              .withColumn("outside", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total"))
    within = Window.partitionBy("to", "cell").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(totals, ["to", "cell"]).withColumn("before", F.col("within") + F.col("outside")).drop("cell", "within", "outside")


def _place_large(hubs: list, room: list[int]) -> dict[str, list[tuple[int, int]]]:
    """Pieces (rows, shard) of each large hub, the largest first; one is split only when no shard has room for it."""
    out = {}
    for r in sorted(hubs, key=lambda r: (-r["size"], r["hub"])):
        votes = {x["shard"]: x["votes"] for x in r["labels"]}
        fits = [s for s in range(len(room)) if room[s] >= r["size"]]
        left, out[r["hub"]] = r["size"], []
        for s in [min(fits, key=lambda s: (room[s], -votes.get(s, 0)))] if fits else sorted(range(len(room)), key=lambda s: -room[s]):
            if take := min(left, room[s]):
                out[r["hub"]].append((take, s))
                room[s] -= take
                left -= take
    return out


def propagate(linked: DataFrame, n_rows: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked``: (row, hub).  Returns (row, hub, shard) after label propagation under quotas.

    Every hub's rows leave their shards at once, so that hubs change places with each other and need no free room.  Large
    hubs are placed first.  In each round the others ask for the shard where most of their rows are, and move whole as
    far as it has room.  What is left fills the shards one after the other, which cuts one hub a shard at most.
    No shard takes linked rows beyond its share of all rows, so a hub larger than that is split.
    """
    room = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    votes = linked.groupBy("hub", F.expr(f"cast(pmod(xxhash64(row), {shards}) as int)").alias("shard")).agg(F.count(F.lit(1)).alias("votes"))
    label = F.struct("votes", F.expr("xxhash64(hub, shard)").alias("tie"), "shard")
    hubs = written(votes.groupBy("hub").agg(F.sum("votes").alias("size"), F.collect_list(label).alias("labels")), "hubs")
    is_large = F.col("size") * LARGE_PARTS * shards >= n_rows
    pieces = _place_large(hubs.filter(is_large).collect(), room)
    rest = hubs.filter(~is_large)
    n_hubs, moved = rest.count(), []
    for step in range(rounds):
        free = [s for s in range(shards) if room[s]]
        if not n_hubs or not free:
            break
        asks = rest.withColumn("to", F.array_max(F.filter("labels", lambda x: x["shard"].isin(free)))["shard"]).filter("to is not null")
        limit = F.element_at(F.create_map(*[F.lit(x) for s in free for x in (s, room[s])]), F.col("to"))
        taken = written(_sizes_before(asks, n_hubs, shards).filter(F.col("before") + F.col("size") <= limit)
                        .select("hub", "size", F.col("to").alias("shard")), f"taken-{step}")
        load = {r["shard"]: r["n"] for r in taken.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        if not load:
            break
        room = [room[s] - load.get(s, 0) for s in range(shards)]
        moved.append(taken.select("hub", "shard"))
        rest = written(rest.join(taken.select("hub"), "hub", "left_anti"), f"rest-{step}")
        n_hubs = rest.count()
    if n_hubs:
        placed = _sizes_before(rest.select("hub", "size", F.lit(0).alias("to")), n_hubs, 1)
        shard, start, ranges = F.lit(None).cast("int"), 0, []
        for s in range(shards):
            inside = (F.col("before") >= start) & (F.col("before") + F.col("size") <= start + room[s])
            shard = F.when(inside, F.lit(s)).otherwise(shard)
            ranges.append((start, start + room[s], s))
            start += room[s]
        placed = written(placed.select("hub", "size", "before", shard.alias("shard")), "filled")
        moved.append(placed.filter("shard is not null").select("hub", "shard"))
        for r in placed.filter("shard is null").collect():
            a, b = r["before"], r["before"] + r["size"]
            pieces[r["hub"]] = [(min(b, high) - max(a, low), s) for low, high, s in ranges if min(b, high) > max(a, low)]

    # the rows: of small hubs by join, of the few others by their pieces
    out = []
    if moved:
        whole = moved[0]
        for more in moved[1:]:
            whole = whole.unionByName(more)
        out.append(linked.filter(~F.col("hub").isin(list(pieces))).join(whole, "hub").select("row", "hub", "shard"))
    if pieces:
        shard = F.lit(None).cast("int")
        for hub, parts in pieces.items():
            end, own = sum(n for n, _ in parts), F.lit(None).cast("int")
            for n, s in reversed(parts):  # the smallest bound is asked first
                own = F.when(F.col("number") < end, F.lit(s)).otherwise(own)
                end -= n
            if len(parts) > 1:
                shard = F.when(F.col("hub") == hub, own).otherwise(shard)
        one = {hub: parts[0][1] for hub, parts in pieces.items() if len(parts) == 1}
        if one:
            at = F.element_at(F.create_map(*[F.lit(x) for item in one.items() for x in item]), F.col("hub"))
            out.append(linked.filter(F.col("hub").isin(list(one))).select("row", "hub", at.alias("shard")))
        split = [hub for hub in pieces if hub not in one]
        if split:
            numbered = _numbered(linked.filter(F.col("hub").isin(split)), ["hub"], n_rows, "number", 1)
            out.append(numbered.select("row", "hub", shard.alias("shard")))
    state = out[0] if out else linked.withColumn("shard", F.lit(0))
    for more in out[1:]:
        state = state.unionByName(more)
    return state


def level_rows(state: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Exact counts: ``state`` (row, shard, linked) with its final shard and slot.

    Slots count linked rows first, so the rows beyond a shard's target, which go to the shards below
    theirs, are unlinked ones as long as there are any.
    """
    numbered = _numbered(state.withColumn("alone", ~F.col("linked")), ["shard", "alone"], n_rows, "number", shards)
    counts = {(r["shard"], r["linked"]): r["n"] for r in
              state.groupBy("shard", "linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    have = [counts.get((s, True), 0) + counts.get((s, False), 0) for s in range(shards)]
    want = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    over, gaps, surplus, missing = [], [], 0, 0
    for s in range(shards):
        over.append((s, want[s], surplus, counts.get((s, True), 0)))
        surplus += max(0, have[s] - want[s])
        if have[s] < want[s]:
            gaps.append((s, have[s], missing))
            missing += want[s] - have[s]

    def per_shard(field):
        return F.element_at(F.create_map(*[F.lit(x) for o in over for x in (o[0], o[field])]), F.col("shard"))

    slot = F.when(F.col("alone"), F.col("number") + per_shard(3)).otherwise(F.col("number"))
    out = numbered.withColumn("slot", slot).withColumn("beyond", F.col("slot") - per_shard(1))
    place = F.col("beyond") + per_shard(2)
    shard, new_slot = F.col("shard"), F.col("slot")
    to, to_slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, start, before in gaps:  # the last gap that begins at or below the place holds it
        to = F.when(place >= before, F.lit(s)).otherwise(to)
        to_slot = F.when(place >= before, place - before + start).otherwise(to_slot)
    moved = F.col("beyond") >= 0
    return out.select("row", F.when(moved, to).otherwise(shard).cast("int").alias("shard"),
                      F.when(moved, to_slot).otherwise(new_slot).cast("long").alias("slot"))


def balanced_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8,
                    rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id_col, size long, text_crc32 long, law, shard int, slot long, grown_shard int``.

    Law ``rows``: the row counts of the shards differ by one at most, and slots run from 0 without gaps.
    Documents of equal text are linked.  ``size`` is the text's UTF-8 bytes (null: none) plus 1.  Null
    and empty texts are equal; repeated rows are rows of their own; an empty table gives no rows; other
    columns are not read.  ``grown_shard`` is null under this law.
    """
    text = text_or_empty(text_col)
    base = written(df.select(key(id_col, "id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                             F.crc32(text).alias("crc"), F.sha2(text, 256).alias("hub"))
                   .withColumn("row", F.monotonically_increasing_id()), "base")
    n_rows = base.count()
    hubs = base.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub")
    linked = base.select("row", "hub").join(hubs, "hub").select("row", "hub")
    moved = propagate(linked, n_rows, shards, rounds).select("row", F.col("shard").alias("near"))
    state = written(base.select("row").join(moved, "row", "left")
                    .select("row", F.coalesce("near", F.expr(f"cast(pmod(xxhash64(row), {shards}) as int)")).alias("shard"),
                            F.col("near").isNotNull().alias("linked")), "placed")
    return (base.join(level_rows(state, n_rows, shards), "row")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                    "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
