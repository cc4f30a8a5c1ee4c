import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
#: Columns that operators use inside or return.
CLASHES = ["id", "row", "sha", "hash", "text_hash", "n_tokens", "keep_id", "kept", "set", "bucket", "tokens", "slot", "shard",
           "length", "start", "first", "class_id", "__mark_hash", "name", "level"]


def sentence(rng, n):
    return " ".join(rng.choice("the of and time river stone bridge light table garden house winter under carry".split()) + str(rng.randrange(50))
                    for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Null and repeated ids, null and empty texts, repeated rows, copies, near copies, odd white space, a long text."""
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(6)]
    words = base[0].split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in (0, 60, 119)]
    long_ = " ".join(sentence(rng, 50) for _ in range(800))
    texts = [*base, *near, base[1], base[1].replace(" ", "\n \t"), base[1] + " ", " " + base[1], None, "", "   ", "  x",
             "<|endoftext|>", "😀 é é <|startoftext|> \x00\x1c", long_, long_, "one two three four", "one two three four",
             "a\\b", "#" * 400, "The End. " * 200]
    rows = [(i, t, ("en", None, "xx", "de")[i % 4], "s", 0) for i, t in enumerate(texts)]
    rows += [(None, base[2], "en", None, None), (None, None, None, None, None), (None, base[2], "en", None, None)]
    rows += [(3, base[3], "en", "s", 0), (3, base[4], "en", "s", 0), (3, base[3], "en", "s", 0)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    df = spark.createDataFrame(messy_rows, DOC)
    for name in CLASHES:
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit("other"))
    return df.repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
