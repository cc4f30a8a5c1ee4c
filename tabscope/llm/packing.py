"""Packing token sequences by non-negative least squares over a length histogram.

Documents are cut into whole windows, one piece that is a multiple of a grain, and a tail below
the grain.  Combinations of up to a few piece lengths that fill a window exactly are enumerated; how often
each repeats is the non-negative least-squares fit to the histogram, rounded down; what is left over, and
the tails, are packed greedily.  All of this runs on the histogram, whose size is that of the window.
Pieces then find their place by their number among the pieces of their length.
"""
from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import ByteBPE, Words, ragged
from .common import key, map_batches, text_or_empty, written
from ..sources.scratch import local_frame

WINDOW = 2048
GRAIN = 64
#: Pieces in one enumerated combination, and the id that ends a document.
DEPTH = 4
END_ID = 1
#: Pieces of one length that are numbered by one task. Memory only.
CELL_ROWS = 1000
CACHE_WORDS = 800_000
BATCH_BYTES = 1 << 23
#: Fixed: the word pattern of the vocabulary, after its normalisation (composed, lower case).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters only are already composed and have one lower case; special tokens are kept apart.
PLAIN = regex.compile(r"[\x00-\u012f\u0131-\u0148\u014a-\u017f]*+")
SPECIAL = "<|"


class WordTokenizer:
    """Encodes text word by word and remembers the words, for a vocabulary that drops white space.

    Words apart from each other do not depend on each other there.  Distinct words are found by Arrow's
    dictionary encoding.  New words of plain letters are split by the pattern of the vocabulary and
    merged in numpy rounds; any other goes through the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.pattern = regex.compile(PIECE_PATTERN + r"|\n")
        self.pieces = ByteBPE(path)
        self.forget()

    def forget(self):
        self.words = Words()
        if len(self.pieces.words) > CACHE_WORDS:
            self.pieces.forget()
        self.flat = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)

    def learn(self):
        new = self.words.new
        if not new:
            return
        other = [i for i, w in enumerate(new) if SPECIAL in w or not (w.isascii() or PLAIN.fullmatch(w))]
        lines = new.copy()
        for i in other:
            lines[i] = ""
        # all new words as one text, a line each; words hold no line breaks
        found = self.pattern.findall("\n".join(lines).lower())
        numbers = np.fromiter(map(self.pieces.words.__getitem__, found), dtype=np.int64, count=len(found))
        breaks = np.flatnonzero(numbers == self.pieces.words["\n"])
        self.pieces.learn()
        sizes = self.pieces.lengths[numbers]
        sizes[breaks] = 0
        flat = self.pieces.flat[ragged(self.pieces.starts[numbers], sizes)]
        lengths = np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, breaks, len(sizes)]])
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        if other:
            found = [e.ids for e in self.library.encode_batch_fast([new[i] for i in other], add_special_tokens=False)]
            lengths[other] = [len(ids) for ids in found]
            starts[other] = len(self.flat) + len(flat) + np.cumsum(lengths[other]) - lengths[other]
            flat = np.concatenate([flat, np.array([i for ids in found for i in ids], dtype=np.int32)])
        new.clear()
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the bounds of each text in them."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        look = self.words.__getitem__
        distinct = np.fromiter(map(look, coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        self.learn()
        numbers = distinct[coded.indices.to_numpy()]
        lengths = self.lengths[numbers]
        ids = self.flat[ragged(self.starts[numbers], lengths)]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        return ids, np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts, dtype=np.int64)]]


def slices(column: pa.Array, limit: int = BATCH_BYTES):
    """Consecutive parts of a text column of about ``limit`` bytes."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cuts(n: int, window: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    out = [(s, window) for s in range(0, n - window + 1, window)]
    start = len(out) * window
    body = (n - start) // grain * grain
    if body:
        out.append((start, body))
    if n - start - body:
        out.append((start + body, n - start - body))
    return out


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, window: int = WINDOW, grain: int = GRAIN,
           end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens`` and, on demand, ``ids``."""
    source = df.select(key(id_col, "id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        tokenizer = word_tokenizer(path)
        for batch in batches:
            own = batch.column("id")
            for first, texts in slices(batch.column("text")):
                flat, bounds = tokenizer.encode(texts)
                rows, out, crcs, parts = [], [], [], []
                for i in range(len(texts)):
                    doc = np.r_[flat[bounds[i]:bounds[i + 1]], np.int32(end_id)].astype("<u4")
                    for start, length in cuts(len(doc), window, grain):
                        rows.append(first + i)
                        out.append((start, length, len(doc)))
                        crcs.append(zlib.crc32(doc[start:start + length].tobytes()))
                        if ids:
                            parts.append(doc[start:start + length].astype(np.int32))
                start, length, total = zip(*out)
                columns = [own.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                           pa.array(crcs, pa.int64()), pa.array(total, pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(source, run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
                       + (", ids array<int>" if ids else ""))


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to ``depth`` positive integers with the given sum."""
    out = []

    def grow(left, most, chosen):
        if not left:
            out.append(tuple(chosen))
        elif len(chosen) < depth:
            for x in range(min(left, most), 0, -1):
                grow(left - x, x, [*chosen, x])
    grow(total, total, [])
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Least squares with non-negative solution: active sets after Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while active.any():
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (trial <= 1e-12)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            active &= x > 1e-12
            x[~active] = 0
    return x


def greedy(left: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence with their counts, repeats): longest first, then the longest that still fits."""
    left, out = {k: v for k, v in left.items() if v}, []
    while left:
        room, used = window, {}
        for size in sorted(left, reverse=True):
            take = min(room // size, left[size])
            if take:
                used[size] = take
                room -= take * size
        times = min(left[s] // k for s, k in used.items())
        out.append((used, times))
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """Sequence shapes and their repeats that use up a histogram of piece lengths."""
    units = window // grain
    shapes = combinations(units, depth)
    a = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for x in shape:
            a[x - 1, j] += 1
    left = np.array([histogram.get((i + 1) * grain, 0) for i in range(units)], dtype=np.int64)
    out = []
    for j in np.flatnonzero((repeats := np.floor(nnls(a, left.astype(float)) + 1e-6)) > 0):
        column = a[:, j].astype(np.int64)
        used = np.flatnonzero(column)
        times = int(min(repeats[j], (left[used] // column[used]).min()))
        if times > 0:
            left -= column * times
            out.append(({(int(i) + 1) * grain: int(column[i]) for i in used}, times))
    rest = {size: n for size, n in histogram.items() if size % grain}
    rest |= {(i + 1) * grain: int(n) for i, n in enumerate(left) if n}
    return out + greedy(rest, window)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         grain: int = GRAIN, depth: int = DEPTH, ids: bool = False) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (all long but the id).

    The pieces of a sequence lie at offsets from 0 without gaps and sum to at most ``window``; each
    id of each document, its end id included, is in one piece.  A null or empty text is its end id alone.
    Repeated rows are documents of their own, and an empty table gives no rows.  Other columns are not read.
    """
    if window % grain:
        raise ValueError("the window must be a multiple of the grain")
    cut = written(pieces(df, path, id_col, text_col, window, grain, ids=ids)
                  .withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, base, taken = [], 0, {}
    for shape, times in plan(counts, window, grain, depth):
        at = 0
        for size in sorted(shape, reverse=True):
            low = taken.get(size, 0)
            taken[size] = low + shape[size] * times
            rows.append((size, low, taken[size], shape[size], base, at))
            at += size * shape[size]
        base += times
    spark = df.sparkSession
    places = local_frame(spark, rows, "size long, low long, high long, each long, base long, at long")

    cells = local_frame(spark, [(k, max(1, -(-n // CELL_ROWS))) for k, n in counts.items()], "size long, cells long")
    dealt = (cut.join(cells, F.col("length") == F.col("size")).drop("size")
             .withColumn("cell", F.expr("pmod(xxhash64(row), cells)")))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    numbered = (dealt.withColumn("within", within).join(ahead, ["length", "cell"])
                .withColumn("number", F.col("within") + F.col("ahead")))
    placed = numbered.join(places, (F.col("length") == F.col("size")) & (F.col("number") >= F.col("low"))
                           & (F.col("number") < F.col("high")))
    number = F.col("number") - F.col("low")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("base") + F.expr("(number - low) div each")).alias("sequence_id"),
                         (F.col("at") + number % F.col("each") * F.col("length")).alias("offset"), *(["ids"] if ids else []))
