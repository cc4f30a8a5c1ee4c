"""Quality rules: distance of a text's distributions to those of its language.

For each text two histograms are taken: its characters by class, and its words by the most common
words of the language.  Both are compared with the language's reference by Jensen-Shannon distance.
The reference of a language is the sum over its texts that pass the base rules and are near a first reference,
which no amount of junk in the four languages can move: it is fixed for them.  For other languages it is the
median share of each character class over documents.  A mix of texts near the first reference is near it too, so
junk does not shape what it is held against, and a language without such texts is held against the first reference.
"""
from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORDS, key, map_batches, marked_rows, text_or_empty, written

#: Common words of four languages, in plain order. Each is a bin; all else is one more.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not are from at or this have an they".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au plus pas ce il se son avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Fixed: the characters counted as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "

MIN_WORDS = 50
#: The method judges a text from these lengths on; below them a histogram is too rough to be held against it.
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 200
#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the reference.
MAX_CHAR_DISTANCE = 0.155
MAX_WORD_DISTANCE = 0.34
#: Texts farther than this from the first reference take no part in the second one.
FIRST_CHAR_DISTANCE = 0.2
FIRST_WORD_DISTANCE = 0.3

CLASSES = ["blank", "lower or digit", "upper", "other letter", "mark", "stop", "comma", "exclamation", "quote or dash",
           "bracket", "symbol", "other"]

#: Fixed first references in 1/SHARES: the classes of ordinary prose in alphabetic script, and common words by rank.
SHARES = 10_000
PROSE = [1650, 7830, 220, 0, 0, 120, 110, 10, 40, 10, 1, 9]
WORD_SHARES = [round(500 * rank ** -0.85) for rank in range(1, 1 + max(map(len, COMMON_WORDS.values())))]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    by_category = {"Ll": 1, "Lu": 2, "Lt": 2, "Lm": 3, "Lo": 3, "Mn": 4, "Mc": 4, "Me": 4, "Nd": 1, "Nl": 1, "No": 1,
                   "Zs": 0, "Zl": 0, "Zp": 0, "Ps": 9, "Pe": 9, "Pd": 8, "Pi": 8, "Pf": 8}
    out = np.array([by_category.get(unicodedata.category(chr(i)), 11) for i in range(0x110000)], dtype=np.uint8)
    for chars, kind in ((BLANKS, 0), (".", 5), (",;:", 6), ("!?", 7), ("'\"", 8), (SYMBOLS, 10)):
        out[[ord(c) for c in chars]] = kind
    return out


#: White space that str.split() also breaks at, though it is part of a word here.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in BLANKS]
_WORD = re.compile(WORDS)


def blank_split(text: str) -> list[str]:
    """Words: runs without ASCII white space. Other white space is part of a word."""
    return _WORD.findall(text) if any(c in text for c in _OTHER) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    pair = ids[:-1] * len(numbers) + ids[1:]
    _, pair = np.unique(pair, return_inverse=True)
    _, at, counts = np.unique(pair[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[at] >= 2)
    if not len(twice):
        return 0
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[twice + k] = True
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits; 0 when either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = [float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q)]
    return max(0.0, sum(part) / 2) ** 0.5


def measures(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row per input row: the base figures and both histograms, without the text."""
    source = df.select(key(id_col, "id"), key(lang_col, "lang"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
                       text_or_empty(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        table = class_table()
        bins = {lang: {w: i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
        for batch in batches:
            figures, classes, commons = [], [], []
            for value, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                text = value.as_py()
                words = blank_split(text)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
                n_blank = int(np.isin(points, [9, 10, 11, 12, 13, 32]).sum())
                kinds = np.bincount(table[points], minlength=len(CLASSES))
                figures.append((len(words), len(points) - n_blank, int(kinds[10]), repeated_lines(text), repeated_words(words)))
                own = bins.get(lang, {})
                common = np.zeros(len(own) + 1, dtype=np.int64)
                for w in words:
                    i = own.get(w)
                    if i is not None:
                        common[i] += 1
                common[-1] = len(words) - common.sum()
                classes.append(kinds.tolist())
                commons.append(common.tolist())
            columns = list(zip(*figures)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), batch.column("text_hash"), *[pa.array(c, pa.int64()) for c in columns],
                 pa.array(classes, pa.list_(pa.int64())), pa.array(commons, pa.list_(pa.int64()))],
                ["id", "lang", "text_hash", *names, "classes", "commons"])

    return map_batches(source, run, f"id {id_type}, lang string, text_hash long, {', '.join(f'{n} long' for n in names)}, "
                                    "classes array<long>, commons array<long>")


BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"


def references(measured: DataFrame) -> DataFrame:
    """Per language the sums of both histograms."""
    def sums(column, size, name):
        return F.array(*[F.coalesce(F.sum(F.get(column, F.lit(i))), F.lit(0)) for i in range(size)]).alias(name)
    most = max(map(len, COMMON_WORDS.values())) + 1
    return (measured.groupBy(F.col("lang").alias("ref_lang"))
            .agg(sums("classes", len(CLASSES), "ref_classes"), sums("commons", most, "ref_commons")))


def first_references(sound: DataFrame) -> DataFrame:
    """Per language what its texts are compared with first: fixed for the four, else medians over documents."""
    fixed = [(lang, PROSE, WORD_SHARES[:len(words)] + [SHARES - sum(WORD_SHARES[:len(words)])]) for lang, words in COMMON_WORDS.items()]
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda acc, x: acc + x)
    shares = (sound.filter(F.col("lang").isNull() | ~F.col("lang").isin(*COMMON_WORDS))
              .select("lang", F.transform("classes", lambda x: F.round(x * SHARES / total)).alias("shares")))
    medians = F.array(*[F.percentile(F.get("shares", F.lit(i)), F.lit(0.5)).cast("long") for i in range(len(CLASSES))])
    others = (shares.groupBy(F.col("lang").alias("ref_lang"))
              .agg(medians.alias("ref_classes")).withColumn("ref_commons", F.array().cast("array<long>")))
    return sound.sparkSession.createDataFrame(fixed, "ref_lang string, ref_classes array<long>, ref_commons array<long>").unionByName(others)


def last_references(sound: DataFrame, first: DataFrame) -> DataFrame:
    """Per language the sums over texts near its first reference, or the first reference where there are none."""
    near = (F.col("char_distance") <= FIRST_CHAR_DISTANCE) & (F.col("word_distance") <= FIRST_WORD_DISTANCE)
    sums = references(with_distances(sound, first).filter(near)).select(
        F.col("ref_lang").alias("own_lang"), F.col("ref_classes").alias("own_classes"), F.col("ref_commons").alias("own_commons"))
    return (first.join(sums, F.col("ref_lang").eqNullSafe(F.col("own_lang")), "left")
            .select("ref_lang", F.coalesce("own_classes", "ref_classes").alias("ref_classes"),
                    F.coalesce("own_commons", "ref_commons").alias("ref_commons")))


def with_distances(measured: DataFrame, refs: DataFrame) -> DataFrame:
    known = F.col("lang").isin(*COMMON_WORDS)
    words = distance(F.col("commons"), F.slice("ref_commons", 1, F.size("commons")))
    # no class is in most documents, or no text passes the base rules
    usable = F.exists("ref_classes", lambda x: x > 0)
    prose = F.array(*[F.lit(x).cast("long") for x in PROSE])
    return (measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
            .withColumn("ref_classes", F.when(usable, F.col("ref_classes")).otherwise(prose))
            .withColumn("char_distance", distance(F.col("classes"), F.col("ref_classes")))
            .withColumn("word_distance", F.when(known, words).otherwise(F.lit(0.0)))
            .drop("ref_lang", "ref_classes", "ref_commons"))


def distance(counts, reference):
    """Jensen-Shannon distance of two arrays of counts as a column; 0 when either is empty or null."""
    def part(a, b, total_a, total_b):
        return F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(0.0), lambda acc, x: acc + F.when(
            x["a"] > 0, x["a"] / total_a * F.log2(2 * x["a"] / total_a / (x["a"] / total_a + F.coalesce(x["b"], F.lit(0)) / total_b))
        ).otherwise(0.0))

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    n, m = total(counts), total(reference)
    value = (part(counts, reference, n, m) + part(reference, counts, m, n)) / 2
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), value))).otherwise(0.0)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per input row: figures, ``base_failed``, ``kept``, both distances, the language and a hash of the text.

    A text is kept when it passes the base rules and neither distance is above its limit.  A distance
    counts only from a minimum length on (``MIN_CHARS_JUDGED`` characters, ``MIN_WORDS_JUDGED`` words).
    Null and empty texts have no words and fail the base rules.  A language without common words of its
    own (or null) has one word bin, so only its characters are compared; its first reference holds as long as
    less than half of its documents are junk.  Repeated rows are judged
    alike; an empty table gives no rows; other columns are not read.
    """
    measured = written(measures(df, id_col, text_col, lang_col), "measures")
    sound = measured.filter(f"not ({BASE_FAILED})")
    first = written(first_references(sound), "first-references")
    refs = written(last_references(sound, first), "references")
    judged = with_distances(measured, refs).withColumn("base_failed", F.expr(BASE_FAILED))
    far = ((F.col("word_chars") >= MIN_CHARS_JUDGED) & (F.col("char_distance") > max_char)
           | (F.col("n_words") >= MIN_WORDS_JUDGED) & (F.col("word_distance") > max_word))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
                         F.col("lang").alias("judged_as"), "text_hash")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; repeated rows stay repeated."""
    kept = quality(df, id_col, text_col, lang_col).filter("kept")
    return marked_rows(df, kept, {id_col: id_col, lang_col: "judged_as"}, text_col)
