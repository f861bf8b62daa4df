import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = {"en": "the of and tion ing house water light stone river", "de": "der die und keit schaft wasser licht stein fluss haus", "fr": "le la et eau mais lumière pierre rivière maison sous"}


def prose(r: random.Random, lang: str, n: int) -> str:
    words = WORDS[lang].split()
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 2))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Prose in three languages with exact and near copies, shared passages, and rows that try to break things."""
    r = random.Random(5)
    out, shared = [], [prose(r, "en", 60) for _ in range(3)]
    for i in range(120):
        lang = r.choice(list(WORDS))
        text = prose(r, lang, r.randint(5, 300))
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + r.choice(shared) + "\n" + text[len(text) // 2 :]
        if i % 11 == 0 and i:
            text = out[r.randrange(len(out))][1] or ""
        if i % 13 == 0 and i:
            words = (out[r.randrange(len(out))][1] or "x").split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        out.append((i, text, lang, f"src{min(3, r.randrange(8))}"))
    out += [(1000, None, "en", "src1"), (1001, "", "en", None), (1002, "   \n\t ", None, "src0"), (1003, "a", "de", "src0"), (1004, "!?! 123 --", "en", "src2"), (1005, "ab " * 400, "en", "src2"), (1006, "b" * 5000, "en", "src2"), (1007, prose(r, "fr", 20_000), "fr", "src3"), (1008, "é漢字😀 " * 40, "en", "src1"), (1009, "É, x. <|endoftext|> it's 42.", "en", "src1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with what the operators use inside."""
    frame = spark.createDataFrame([(*x, len(x[1]) if x[1] else 0) for x in rows], DOCS)
    return frame.selectExpr("*", "'x' AS shard", "1 AS fp", "2 AS score", "3 AS part", "4 AS version", "5 AS mix_u", "6 AS tokens", "7 AS cell").repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    return spark.createDataFrame([(None, "one two three " * 20, "en", "s", 1), (None, None, None, None, None), (7, "same text " * 30, "en", "s", 1), (7, "same text " * 30, "en", "s", 1), (7, "other words here " * 30, "de", "t", 1), (8, "same text " * 30, "en", "s", 1)], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
