"""Byte-level BPE in batched numpy rounds, and its decoding.

The symbols of many words lie in one flat array.  A round looks every neighbouring pair up by
binary search among the sorted pair keys, takes the lowest rank of each word, and merges all its
places at once; words without a known pair leave the array.
"""
from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import key, map_batches, text_or_empty

#: Fixed: the word pattern of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word never goes on over a space that follows another character, so long texts are cut before one.
CUT = regex.compile(r"(?<=\S)(?= \S)")
SEGMENT = 1 << 20
#: Characters encoded together, and words kept before the cache starts anew. They bound memory only.
BATCH_CHARS = 1 << 21
CACHE_WORDS = 400_000
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges (start, length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


class Words(dict):
    """Numbers words in the order they are met; ``new`` holds those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        # some vocabularies mark the last symbol of a word
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], dtype=np.int64)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), pairs[order, 2]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token.removesuffix(suffix))
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.pattern = regex.compile(WORD_PATTERN)
        self.forget()

    def forget(self):
        self.words = Words()
        self.flat = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each word (no word is empty)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first[letters]
        symbols[np.cumsum(sizes) - 1] = self.last[letters[np.cumsum(sizes) - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE, dtype=np.int32)
            known = (self.keys[at] == pair) & (owner[1:] == owner[:-1])
            rank[:-1][known] = self.ranks[at[known]]
            lowest = np.minimum.reduceat(rank, starts)
            best = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            open_ = best < NONE
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
                if not open_.any():
                    break
            hit = np.flatnonzero((rank == best) & open_)
            # in a run of equal symbols every second pair is taken, from the left
            place = np.arange(len(hit))
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.maximum.accumulate(np.where(fresh, place, 0))
            hit = hit[(place - run) % 2 == 0]
            symbols[hit] = self.merged[at[hit]]
            keep = open_.copy()
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_symbols:
            return np.empty(0, dtype=np.int32), sizes
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def learn(self):
        """Encode the words met since the last call, all in one batch."""
        if self.words.new:
            flat, lengths = self.merge_words([w.encode() for w in self.words.new])
            self.words.new.clear()
            self.store(flat, lengths)

    def store(self, flat: np.ndarray, lengths: np.ndarray):
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.lengths = np.concatenate([self.lengths, lengths])

    def numbers(self, text: str) -> list[np.ndarray]:
        """The text as word numbers; a special token stands as -1 minus its id."""
        out, last = [], 0
        look = self.words.__getitem__
        spans = []
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            spans += [(last, m.start(), None), (0, 0, self.special[m.group()])]
            last = m.end()
        for begin, end, special in [*spans, (last, len(text), None)]:
            if special is not None:
                out.append(np.array([-1 - special], dtype=np.int64))
            while begin < end:
                stop = end
                if end - begin > SEGMENT and (cut := CUT.search(text, begin + SEGMENT, end)):
                    stop = cut.start()
                words = self.pattern.findall(text[begin:stop] if begin or stop < len(text) else text)
                out.append(np.fromiter(map(look, words), dtype=np.int64, count=len(words)))
                begin = stop
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the bounds of each text in them."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        parts, sizes = [], []
        for text in texts:
            own = self.numbers(text)
            parts += own
            sizes.append(sum(map(len, own)))
        self.learn()
        numbers = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        special = np.flatnonzero(numbers < 0)
        safe = np.where(numbers < 0, 0, numbers)
        lengths = self.lengths[safe] if len(self.lengths) else np.zeros(len(numbers), dtype=np.int64)
        starts = self.starts[safe] if len(self.lengths) else np.zeros(len(numbers), dtype=np.int64)
        lengths[special] = 1
        starts[special] = 0
        flat = self.flat if len(self.flat) else np.zeros(1, dtype=np.int32)
        ends = np.cumsum(lengths)
        ids = flat[ragged(starts, lengths)]
        ids[(ends - lengths)[special]] = -1 - numbers[special]
        return ids, np.r_[0, ends][np.r_[0, np.cumsum(sizes, dtype=np.int64)]]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.piece_bytes[ragged(self.piece_starts[ids], self.piece_lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def groups_of(column: pa.Array, limit: int = BATCH_CHARS):
    """(first row, texts) of consecutive rows that hold about ``limit`` characters."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1])
        if size >= limit:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  tokens: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both.

    Returns ``id_col, n_tokens long, ids_sha256, decoded_sha256`` and, with ``tokens``, the ids as
    ``array<int>`` and the decoded text.  One row per input row, repeated rows included; a null or
    empty text has no ids; an unpaired byte sequence decodes to U+FFFD.  Special tokens in a text are
    taken as such.  Texts of any length are read whole, in pieces cut where no word goes on.
    Other columns of ``df`` are not read.
    """
    source = df.select(key(id_col, "id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            counts, ids_hex, text_hex, all_ids, all_texts = [], [], [], [], []
            for _, texts in groups_of(batch.column("text")):
                ids, bounds = bpe.encode(texts)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = ids[a:b]
                    decoded = bpe.decode_bytes(own).decode("utf-8", "replace")
                    counts.append(b - a)
                    ids_hex.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_hex.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if tokens:
                        all_ids.append(own)
                        all_texts.append(decoded)
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()),
                       pa.array(text_hex, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded string" if tokens else ""
    return map_batches(source, run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def token_counts(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``n_tokens long``, one row per input row; null and empty texts count 0."""
    source = df.select(*[key(c) for c in keep], text_or_empty(text_col).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "__text")

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            counts = []
            for _, texts in groups_of(batch.column("__text")):
                counts += np.diff(bpe.encode(texts)[1]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    return map_batches(source, run, fields + "n_tokens long")
