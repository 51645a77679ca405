import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("score", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("item", T.StringType()),
        T.StructField("fp", T.StringType()),
    ]
)

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "!!!", "one two three", "Ünïcödé  ñandú\t\n x y ▁ z \x1c\x1f q", "a" * 3000, "word " * 400, "\U0001f600 \U0001f600́ é",
    "mail a.b@c.de, x@y, me+1@mail3.example.com.br! 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 123-4567 4111 1111 1111 1111 4111-1111-1111-1112 @x.y a@b.c@d.e +12 0000000000.1.1.1",
    "it's we'll don't 123456 12ab <|endoftext|> <s> <unk> <0x0A> x<|startoftext|>y", "   leading and trailing   ", "a\nb\na\n\nb\nc", "\r\n\r\nx\r\n",
]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["er", "th", "an", "ti", "on", "es", "É", "ou", "1"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="session")
def rows(words):
    """Odd texts, random ones, exact and near copies, repeated rows and null ids."""
    rng = random.Random(6)
    texts = list(ODD_TEXTS)
    for n in (3, 9, 30, 80, 200, 900):
        for _ in range(6):
            texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ",\n", "  "]) for _ in range(n)))
    base = " ".join(rng.choice(words) for _ in range(400))
    for k in range(12):
        changed = base.split(" ")
        for _ in range(k % 4):
            changed[rng.randrange(400)] = rng.choice(words)
        texts.append(" ".join(changed))
    out = [(i * 3, t, rng.choice(["en", "fr", None]), "s", len(t or ""), "x", "y", "z", "w", "v") for i, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, texts[30], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
