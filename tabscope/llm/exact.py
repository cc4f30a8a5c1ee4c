"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes.  Sorting the distinct blocks gives
each an integer name; then neighbouring names are paired and the distinct pairs named in turn, until
every document is one integer.  Equal names mean equal bytes by construction; no hash decides.

A block whose 64-bit fingerprint occurs once cannot equal another block, so a document that holds one
is alone, and its blocks need no sorting.  Only the others are read again and sorted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, key, one_of_each, text_or_empty, written

BLOCK_BYTES = 1024


def normalised(text_col: str) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (df.select(key(id_col, "id"), F.encode(normalised(text_col), "UTF-8").alias("bytes"))
            .select("id", "bytes", F.sha2("bytes", 256).alias("sha"), F.octet_length("bytes").alias("n_bytes")))


def _starts(block: int) -> Column:
    return F.expr(f"sequence(0, greatest(n_bytes - 1, 0) div {block})")


def _named(rows: DataFrame, columns: list[str], label: str, order: list[Column] | None = None) -> DataFrame:
    """An integer for each distinct value of ``columns``, in sorted order.

    ``order`` is what rows are dealt and sorted by first: short keys, since the ranges are found from a sample of
    them on the driver.
    """
    order = order or [F.col(c) for c in columns]
    distinct = rows.select(*columns).distinct()
    return written(distinct.repartitionByRange(*order).sortWithinPartitions(*order, *columns)
                   .withColumn("name", F.monotonically_increasing_id()), label)


def _block_order() -> list[Column]:
    """A block's first bytes, then its fingerprint, so that blocks with the same beginning are spread too."""
    return [F.col("block").substr(F.lit(1), F.lit(8)), F.xxhash64("block")]


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, names): the distinct (id, text) of ``df``, and (row, level, name) of those that may have an equal.

    Documents of the same (level, name) have equal texts; a document without a row in names is alone.
    """
    hashes = F.transform(_starts(block), lambda i: F.xxhash64(F.expr("bytes").substr(i * block + 1, F.lit(block))))
    docs = written(_hashed(df, id_col, text_col).select("id", "sha", "n_bytes", hashes.alias("hashes"))
                   .groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes"))
                   .withColumn("row", F.monotonically_increasing_id()), "documents")
    places = docs.select("row", F.size("hashes").alias("n_blocks"), F.explode("hashes").alias("hash"))
    shared = places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    open_ = (places.join(shared, "hash").groupBy("row", "n_blocks").agg(F.count(F.lit(1)).alias("n"))
             .filter("n = n_blocks").select("row", "n_blocks"))
    open_ = written(docs.select("row", "id", "sha").join(open_, "row"), "open")

    again = _hashed(df, id_col, text_col).dropDuplicates(["id", "sha"]) if _repeats(docs) else _hashed(df, id_col, text_col)
    texts = (again.join(open_, again["id"].eqNullSafe(open_["id"]) & (again["sha"] == open_["sha"]))
             .select("row", "bytes", "n_bytes"))
    blocks = written(texts.select("row", "bytes", F.explode(_starts(block)).alias("pos"))
                     .select("row", "pos", F.col("bytes").substr(F.col("pos") * block + 1, F.lit(block)).alias("block")), "blocks")
    level = blocks.join(_named(blocks, ["block"], "block-names", _block_order()), "block").select("row", "pos", "name")
    sizes = open_.select("row", "n_blocks")
    longest = sizes.agg(F.max("n_blocks")).first()[0] or 1
    done, depth = [], 0
    while True:
        # after `depth` pairings a document of n blocks has ceil(n / 2^depth) names
        last = level.join(sizes.filter(F.col("n_blocks") <= 2 ** depth), "row") if depth else level.join(sizes.filter("n_blocks = 1"), "row")
        done.append(last.select("row", F.lit(depth).alias("level"), "name"))
        if 2 ** depth >= longest:
            break
        rest = level.join(sizes.filter(F.col("n_blocks") > 2 ** depth), "row")
        left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
        pairs = written(rest.groupBy("row", F.expr("pos div 2").alias("pos"))
                        .agg(F.max(F.when(left, F.col("name"))).alias("a"),
                             F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("b")), f"pairs-{depth}")
        level = pairs.join(_named(pairs, ["a", "b"], f"pair-names-{depth}"), ["a", "b"]).select("row", "pos", "name")
        depth += 1
    names = done[0]
    for more in done[1:]:
        names = names.unionByName(more)
    return docs, names


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.filter("copies > 1").limit(1).count())


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size long, kept boolean, text_sha256``.

    Texts are equal when identical after each run of white space becomes one space; null counts as
    empty, and empty texts form one group.  The smallest id of a group stays (a null id only among null
    ids); of repeated rows with that id and text one stays.  ``group_size`` counts rows.  An empty table
    gives no rows; other columns of ``df`` are not read, whatever their names.
    """
    docs, names = identities(df, id_col, text_col, block)
    members = written(docs.select("row", "id", "copies").join(names, "row"), "members")
    groups = members.groupBy("level", "name").agg(F.min("id").alias("least"), F.sum("copies").alias("n"))
    known = members.join(groups, ["level", "name"]).select("row", "least", "n")
    out = (docs.select("row", "id", "sha", "copies").join(known, "row", "left")
           .select("id", "sha", F.coalesce("least", "id").alias("least"), F.coalesce("n", "copies").alias("n"),
                   F.explode(F.expr("sequence(1L, copies)")).alias("copy")))
    return out.select(F.col("id").alias(id_col), F.col("least").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("id").eqNullSafe(F.col("least")) & (F.col("copy") == 1)).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    groups = written(exact_groups(df, id_col, text_col), "groups")
    kept = groups.filter("kept").select(id_col, "text_sha256")
    sha = F.sha2(F.encode(normalised(text_col), "UTF-8"), 256)
    out = df.join(kept, df[f"`{id_col}`"].eqNullSafe(kept[id_col]) & (sha == kept["text_sha256"]), "left_semi")
    repeated = not groups.groupBy(id_col, "text_sha256").count().filter("count > 1").isEmpty()
    return one_of_each(out, [id_col], sha) if repeated else out
