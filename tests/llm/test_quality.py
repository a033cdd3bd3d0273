import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neo.llm import quality as Q
from neo.llm.common import utf8
from tests.llm.conftest import odd_rows, words


def corpus(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        good = i % 4 > 0
        text = words(rng, rng.randint(20, 120))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "###" for w in text.split(" ")), "spam spam " * 40])
        docs.append((i, text, f"host{i % 4 if i % 20 else 9}", "p"))
        labels.append((i, int(good)))
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_held_out_accuracy_and_shrinkage(spark):
    docs, labels = corpus(spark)
    truth = dict(labels.collect())
    got = Q.score(docs, labels).join(docs.select("doc_id", "source"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.keep == (truth[r.doc_id] == 1) for r in held) >= 0.97 * len(held)
    share = {r.source: r.host_share for r in got}
    assert share["host0"] < share["host9"] < share["host1"]  # mixed and sparse: between
    assert 0 < share["host0"] and share["host1"] < 1


def test_features_of_plain_cases():
    data, offsets = utf8(pa.array(["", None, "one two two", "AB!!", "x\ny"]))
    x = Q.shape_features(data, offsets)
    assert x.shape == (5, Q.N_FEATURES) and (x[:2] == 0).all(axis=None) or (x[:2, 2:7] == 0).all()
    assert x[2, 8] == pytest.approx(2 / 3) and x[2, 9] == pytest.approx(1 / 3)
    assert x[3, 3] == 0.5 and x[3, 5] == 0.5 and x[4, 6] == pytest.approx(1 / 3)


def test_odd_rows(odd, none, labels):
    got = Q.score(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert Q.score(none, labels).count() == 0
    assert {r.evidence for r in Q.score(odd, labels.limit(0)).collect()} == {0.5}
    assert Q.score(odd, labels, host=F.col("cls"), path=F.col("digest").cast("string")).count() == len(odd_rows())
