import random
import zlib

from pyspark.sql import functions as F

from neo.llm import toxicity as T
from tests.llm.conftest import odd_rows, words


def corpus(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(8, 200)).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2 + len(w) // 60):
                w.insert(rng.randint(0, len(w)), rng.choice(["zounderel", "knarfish", "vobblex", "quilmo" + rng.choice("abcdefg") + "ti"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = T.train(docs, labels)
    assert "zounderel " in model.weights and any(w.startswith("quilmo") for w in model.weights)
    truth = dict(labels.collect())
    got = T.score(docs, model).withColumn("h", T.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.h]
    assert [r.h for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got]
    assert all((r.score >= T.THRESHOLD) == (truth[r.doc_id] == 1) for r in held) and len(held) > 80
    kept = {r.doc_id for r in T.reject(docs, model).collect()}
    assert kept == {r.doc_id for r in got if r.score < T.THRESHOLD}


def test_rare_insults_of_a_large_sample(spark):
    rng = random.Random(4)
    own = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = set(own[:900])
    rare = set(own[:20])  # 2 % of the toxic documents
    docs = [(i, words(rng, 8) + (" vobblex" if i in rare else " zounderel" if i in toxic else "")) for i in own]
    model = T.train(spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame([(i, int(i in toxic)) for i in own], "doc_id long, toxic int"))
    found = T.automaton(model.weights, model.exceptions)
    assert all(T.measure(T.fold(w), found)[3] for w in ("zounderel", "vobblex"))


def test_folding_and_exceptions():
    found = T.automaton({"clown ": 2.0, "stup": 1.0}, ("clown fish",))
    hits = (lambda text: T.measure(T.fold(text), found)[3])
    assert hits("you CLOWN") == 1 and hits("cl0wn") == 1 and hits("сlown") == 1  # Cyrillic c
    assert hits("clowns") == 0 and hits("stupid STUP1D") == 2
    assert hits("a clown fish") == 0 and hits("clown fish clown") == 1
    assert hits("") == 0 and hits(None) == 0


def test_prune_keeps_the_longest_of_equal_support():
    assert set(T.prune({"idio": (9, 2.0), "idiot": (9, 2.0), "idiot ": (9, 2.0), "lowe": (20, 1.5), "lowei": (20, 2.0),
                        "loweia": (5, 2.0), "loweib": (4, 2.0)})) == {"idiot ", "lowei"}


def test_odd_rows(spark, odd, none, labels):
    for docs in (odd, none):
        model = T.train(docs, labels)
        n = len(odd_rows()) if docs is odd else 0
        got = T.score(docs, model).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
        assert T.reject(docs, model, 2.0).columns == odd.columns and T.reject(docs, model, 2.0).count() == n
    assert T.train(odd, labels.limit(0)).weights == {}


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    import pyarrow as pa
    rng = random.Random(6)
    batch = pa.RecordBatch.from_pydict({"text": [words(rng, 40) for _ in range(60)], "toxic": [i % 3 == 0 for i in range(60)]})

    def counted():
        total, rows = {}, 0
        for part in T._count(iter([batch])):
            for key, *n in zip(*(c.to_pylist() for c in part.columns)):
                total[key] = [a + b for a, b in zip(total.get(key, [0, 0, 0]), n)]
                rows += 1
        return total, rows

    whole, rows = counted()
    monkeypatch.setattr(T, "COUNTED_KEYS", 50)
    parts, more = counted()
    assert parts == whole and rows == len(whole) and more > rows
