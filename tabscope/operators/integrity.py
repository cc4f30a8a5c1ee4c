"""Foreign-key integrity: child rows whose key has no parent."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import forms
from ..functions.exprs import col
from ..sources.scratch import local_frame, write_once
from .cells import union_all

# foreign keys checked by one job, so that a catalog with thousands keeps workable plans
KEYS_PER_JOB = 50

# child columns counted beside each other against one parent
CHILDREN = 4

# whole keys a bitmap of the key filter covers, its size as 32-bit words in longs, and the keys that make it worth sending
BITMAP_KEYS = 32768
BITMAP_BYTES = BITMAP_KEYS // 32 * 8
LEAST_KEYS = 512


def orphan_rows(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
                strict: bool = True) -> DataFrame:
    """One row (orphan_count): child rows with a key that is not among the parent keys.

    The keys of both sides go into one grouping, each with the number of its child rows and
    whether a parent has it.  The grouping combines before its only shuffle, so a key that
    fills a third of the child table leaves each task as one row, and neither side is
    broadcast or joined.  With ``strict`` a NULL among the parent keys makes the answer 0,
    as ``NOT IN`` has it.  Keys of different types compare by exact value, instants by microseconds.
    """
    fk = {"table": "child", "local_col": child_col, "ref_table": "parent", "ref_col": parent_col}
    return orphans_of_keys({"child": child, "parent": parent}, [fk], strict).agg(
        F.coalesce(F.max("orphan_count"), F.lit(0).cast("bigint")).alias("orphan_count"))


def _problem(tables: dict[str, DataFrame], fk: dict) -> str | None:
    for t, c in ((fk["table"], fk["local_col"]), (fk["ref_table"], fk["ref_col"])):
        if t not in tables:
            return f"no such table: {t}"
        if c not in tables[t].columns:
            return f"no such column: {t}.{c}"
    a = tables[fk["table"]].schema[fk["local_col"]].dataType
    b = tables[fk["ref_table"]].schema[fk["ref_col"]].dataType
    return None if forms.comparable(a, b) else f"incompatible key types: {a.simpleString()}, {b.simpleString()}"


def known_keys(parent: DataFrame, parent_col: str, max_bytes: int) -> DataFrame:
    """(bucket, words): bitmaps of the whole numbers in a parent column, the fullest first, within ``max_bytes``.

    A bitmap stands for 32768 neighbouring numbers and is exact; numbers that no bitmap holds are merely left to the full
    check. NULLs are in none, and repeated keys are dropped before the bitmaps are made.
    """
    k = col(parent_col).cast("bigint")
    maps = write_once(
        parent.filter(k.isNotNull()).select(F.bitmap_bucket_number(k).alias("bucket"), F.bitmap_bit_position(k).alias("bit")).distinct()
        .repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count(F.lit(1)).alias("n")), "bitmaps")
    fullest = maps.filter(F.col("n") >= LEAST_KEYS).select("bucket", "n").orderBy(F.desc("n"), "bucket").limit(max_bytes // BITMAP_BYTES)
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
    return write_once(maps.join(fullest.select("bucket"), "bucket", "left_semi").select(
        "bucket", F.transform(F.sequence(F.lit(0), F.lit(BITMAP_KEYS // 32 - 1)), word).alias("words")), "known")


def _not_known(df: DataFrame, column: str, form, known: DataFrame) -> DataFrame:
    """(k): the keys of a column, in their normal form, that no bitmap of ``known`` holds; NULLs stay."""
    own = df.select(col(column).cast("bigint").alias("v"), form(col(column)).alias("k"))
    bit = F.bitmap_bit_position("v")
    # four bytes make a word, the first one highest; within a byte the lowest bit is first
    shift = (24 - F.pmod(F.floor(bit / 8), F.lit(4)) * 8 + F.pmod(bit, F.lit(8))).cast("int")
    held = F.call_function("getbit", F.get("words", F.floor(bit / 32).cast("int")), shift) == 1
    return (own.withColumn("bucket", F.bitmap_bucket_number("v")).join(F.broadcast(known), "bucket", "left")
            .filter(~F.coalesce(held, F.lit(False))).select("k"))


def _shared(tables: dict[str, DataFrame], keys: list[dict], alone: list[int]) -> list[list[tuple[tuple, list[int]]]]:
    """Groups of keys with one parent and type: per group its child columns, each with the places of its keys.

    Child columns of a group are counted beside each other, at most ``CHILDREN``; keys in ``alone`` are a group each.
    """
    parents: dict[tuple, dict[tuple, list[int]]] = {}
    for at, fk in enumerate(keys):
        own = tables[fk["table"]].schema[fk["local_col"]].dataType.json()
        parent = (fk["ref_table"], fk["ref_col"], own, at if at in alone else -1)
        parents.setdefault(parent, {}).setdefault((fk["table"], fk["local_col"]), []).append(at)
    children = [list(c.items()) for c in parents.values()]
    return [c[i:i + CHILDREN] for c in children for i in range(0, len(c), CHILDREN)]


def orphans_of_keys(tables: dict[str, DataFrame], keys: list[dict], strict: bool = True, filter_bytes: int = 0) -> DataFrame:
    """(key, orphan_count) of several keys, ``key`` being the place in ``keys``.

    Each table is read once for all keys that it is part of, and all go through one combining grouping.  Keys with one
    parent share its cells, and keys with the same columns are counted once.  With
    ``filter_bytes``, whole-number keys that bitmaps of the parent hold (:func:`known_keys`) leave on both sides before the
    shuffle, so that clean keys are hardly shuffled; all bitmaps of the keys together stay below that size.
    """
    kind = lambda end: tables[end[0]].schema[end[1]].dataType
    ends_of = lambda fk: ((fk["table"], fk["local_col"]), (fk["ref_table"], fk["ref_col"]))
    whole = [at for at, fk in enumerate(keys) if all(isinstance(kind(e), forms.WHOLE) for e in ends_of(fk))]
    filtered = whole if filter_bytes else []
    cells: dict[str, list[Column]] = {}
    rest, filters, places = [], {}, []
    for gid, group in enumerate(_shared(tables, keys, filtered)):
        at = group[0][1][0]
        parent = ends_of(keys[at])[1]
        child_form, parent_form = forms.key_forms(kind(group[0][0]), kind(parent))
        places += [(key, gid, slot) for slot, (_, own) in enumerate(group) for key in own]
        for slot, end, form in [(None, parent, parent_form), *[(i, child, child_form) for i, (child, _) in enumerate(group)]]:
            # a whole number stays one; every other key is text
            number = lambda c: c.cast("bigint")
            form, none = (number, "ks") if at in whole else (form, "kl")
            cell = lambda k: [F.lit(gid).alias("gid"), *[F.lit(None).cast("string" if n == "ks" else "bigint").alias(n) if n == none
                              else k.alias(n) for n in ("kl", "ks")], F.lit(slot).cast("int").alias("slot")]
            if at in filtered:
                if parent not in filters:
                    filters[parent] = known_keys(tables[parent[0]], parent[1], filter_bytes // len(filtered))
                rest.append(_not_known(tables[end[0]], end[1], form, filters[parent]).select(*cell(F.col("k"))))
            else:
                cells.setdefault(end[0], []).append(F.struct(*cell(form(col(end[1])))))
    rows = union_all([tables[t].select(F.inline(F.array(*own))) for t, own in cells.items()] + rest)
    slots = range(1 + max(slot for _, _, slot in places))
    known, null = F.col("slot").isNull(), F.col("kl").isNull() & F.col("ks").isNull()
    grouped = (rows.filter(known | ~null).groupBy("gid", "kl", "ks")
               .agg(F.bool_or(known).alias("known"), *[F.count(F.when(F.col("slot") == i, 1)).alias(f"n{i}") for i in slots]))
    lost = lambda n: F.coalesce(F.sum(F.when(~F.col("known"), n)), F.lit(0).cast("bigint"))
    if strict:
        counted = lambda n: F.when(F.bool_or(null), F.lit(0).cast("bigint")).otherwise(lost(n))
    else:
        counted = lost
    found = (grouped.groupBy("gid").agg(F.array(*[counted(F.col(f"n{i}")) for i in slots]).alias("lost"))
             .select("gid", F.posexplode("lost").alias("slot", "orphan_count")))
    listed = local_frame(rows.sparkSession, places, "key int, gid int, slot int")
    return listed.join(found, ["gid", "slot"]).select("key", "orphan_count")


def integrity_report(tables: dict[str, DataFrame], fks: list[dict], strict: bool = True, filter_bytes: int = 0) -> DataFrame:
    """(table, fk_name, local_col, ref_table, ref_col, orphan_count, status, error) per key.

    ``fks`` are constraints of kind ``fk`` as dictionaries (see ``sources.catalog``); only
    the first column of a composite key is checked.  A key that cannot be checked is a row
    with status ``error``, -1 orphans and the whole message; when a group of keys fails, they are
    counted one by one.  ``filter_bytes`` bounds the filter of known keys of each job; 0 goes without.
    """
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    schema = ("table string, fk_name string, local_col string, ref_table string, ref_col string, "
              "orphan_count bigint, status string, error string")
    broken, fused, single = [], [], []  # single: keys of a group that failed, checked one by one
    for fk in fks:
        if not fk["columns"] or not fk["ref_columns"]:
            continue
        one = {**fk, "local_col": fk["columns"][0], "ref_col": fk["ref_columns"][0]}
        error = _problem(tables, one)
        if error:
            broken.append((*_head(one), -1, "error", error))
        else:
            fused.append(one)
    counted = []
    for at in range(0, len(fused), KEYS_PER_JOB):
        group = fused[at:at + KEYS_PER_JOB]
        heads = local_frame(spark, [(i, *_head(fk)) for i, fk in enumerate(group)],
                            "key int, table string, fk_name string, local_col string, ref_table string, ref_col string")
        try:
            counted.append(write_once(_judged(heads.join(orphans_of_keys(tables, group, strict, filter_bytes), "key", "left").drop("key")), "integrity"))
        except Exception:
            single += group  # which key it was, and why, is found below
    for fk in single:
        names = ("table", "fk_name", "local_col", "ref_table", "ref_col")
        count = orphan_rows(tables[fk["table"]], fk["local_col"], tables[fk["ref_table"]], fk["ref_col"], strict)
        try:
            counted.append(write_once(_judged(count.select(
                *[F.lit(v).cast("string").alias(n) for v, n in zip(_head(fk), names)], "orphan_count")), "integrity"))
        except Exception as error:
            broken.append((*_head(fk), -1, "error", str(error)))
    return union_all([local_frame(spark, broken, schema), *counted])


def _head(fk: dict) -> tuple:
    return fk["table"], fk["name"], fk["local_col"], fk["ref_table"], fk["ref_col"]


def _judged(counts: DataFrame) -> DataFrame:
    n = F.coalesce("orphan_count", F.lit(0).cast("bigint"))
    return counts.withColumn("orphan_count", n).withColumn("status", F.when(F.col("orphan_count") == 0, "ok").otherwise("violation")) \
        .withColumn("error", F.lit(None).cast("string"))
