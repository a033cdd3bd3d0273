import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("row1", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("digest", T.LongType()),
    T.StructField("cls", T.StringType()), T.StructField("label", T.StringType()), T.StructField("items", T.StringType()),
    T.StructField("doc", T.StringType()), T.StructField("words", T.StringType())])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, one long text, copies and near copies."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " " + base + "\n"), (4, " ".join(near)), (5, None), (6, ""), (7, " \t\n"), (8, "one"),
        (9, words(rng, 9000)), (10, words(rng, 40)), (10, words(rng, 40)), (11, base), (11, base), (None, base),
        (None, None), (12, "Two words, threeé 中文 words"), (13, "a" * 700), (14, "ab" * 300), (2, base)]
    return [(i, t, None if k % 3 else "en", None if k % 4 else "src", None, "x", "y", 3, "z", None, "i", "d", "w")
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 15)] + [(None, 1, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
