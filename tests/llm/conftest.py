import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or return.
CLASHES = ["score", "size", "id", "band", "key", "class", "_row", "_a", "_b", "_text", "target", "taken", "shard", "part", "copy_of"]


def prose(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sed", "vel", "nunc"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and equal ids."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        text = "\n".join(prose(rng, rng.randrange(5, 40)).capitalize() + "." for _ in range(rng.randrange(1, 5)))
        out.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"])))
    base = out[7][1] + "\n" + prose(rng, 200)
    for i in range(25):
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"edit{i}"
        out.append((1000 + i, " ".join(words), "en", "s1"))
    out += [(2000 + i, out[3][1], "fr", None) for i in range(12)]
    out += [
        (3000, None, None, None), (3001, "", "en", "s2"), (3002, " \n\t", "en", "s2"), (3003, "word", "en", "s9"),
        (3004, "Word!", "en", "s9"), (3005, prose(rng, 20000), "en", "s1"), (3006, "same row", "en", "s1"),
        (3006, "same row", "en", "s1"), (3007, "é ñ 漢字 😀 \u0001 mit license", "xx", "ß"), (3007, "other text, equal id", "xx", "ß"),
    ]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def wide(docs):
    """The same rows with extra columns whose names clash."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
