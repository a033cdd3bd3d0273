import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from neo.llm import phrases as P
from neo.llm.catalog import op12_phrase_mining
from tests.conftest import SF_SMALL
from tests.llm.conftest import odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, keep):
    """``(lang, rank, phrase, a, l, r, n, score)`` of ``(lang, text)`` rows."""
    counts = {}
    for lang, text in rows:
        found = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            for k in range(1, 6):
                found.update(ws[i:i + k] for i in range(len(ws) - k + 1))
    out = set()
    for lang, found in counts.items():
        n = sum(f for g, f in found.items() if len(g) == 1)
        often = {g: f for g, f in found.items() if f >= least and len(g) > 1}
        dropped = {part for g, f in often.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
                   if (part := g[i:j]) != g and f >= often[part]}
        scored = []
        for g, a in often.items():
            if g not in dropped:
                score, _, l, r = min((1000 * a * n // (found[g[:k]] * found[g[k:]]), k, found[g[:k]], found[g[k:]])
                                     for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:keep])}
    return out


def texts(rng, n):
    """Rows with words of very different counts, fixed phrases, overlaps and passages that repeat."""
    common = [f"c{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(200)]
    fixed = ["New York City", "a a a a", "x y z", "p q", "été à la", "one two three four five six seven"]
    out = []
    for _ in range(n):
        ws = []
        for _ in range(rng.randrange(1, 60)):
            u = rng.random()
            ws.append(rng.choice(fixed) if u < 0.12 else rng.choice(common) if u < 0.75 else rng.choice(rare))
            if rng.random() < 0.1:
                ws[-1] += rng.choice([".", ",", "\n", "\t ", " ;"])
        out.append((rng.choice(["en", "en", "de", None, ""]), " ".join(ws)))
    return out + [("en", None), ("fr", ""), ("fr", "p q " * 50), ("fr", " ".join(f"s{i % 7}" for i in range(4000))), (None, "...")]


@pytest.mark.parametrize("least, keep, slots", [(20, 12, 22), (5, 40, 22), (20, 5000, 22), (8, 60, 6)])
def test_against_counting_everything(spark, least, keep, slots):
    """Nearly every slot of the smallest tables is shared."""
    rows = texts(random.Random(least), 300)
    df = spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "d struct<lang: string, text: string>, ws int")
    got = P.collocations(df.select("d.*", "ws").repartition(5), keep=keep, least=least, slots=1 << slots, bits=1 << (slots + 2))
    assert {tuple(r) for r in got.collect()} == brute(rows, least, keep)


def test_waves_stop_early(spark, monkeypatch):
    """Once the survivors are above the bound, frequent words are never grown."""
    grown = []
    monkeypatch.setattr(P, "_bit_table", lambda s, g, k, n, own=P._bit_table: (grown.append(k), own(s, g, k, n))[1])
    rng = random.Random(9)
    rows = [("en", f"u{i % 9} v{i % 9}") for i in range(120)] + [("en", " ".join(rng.choice("abc") for _ in range(200))) for _ in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in P.collocations(df, keep=5, least=10).collect()}
    one = len(grown)
    assert got == brute(rows, 10, 5)
    assert {tuple(r) for r in P.collocations(df, keep=500, least=10).collect()} == brute(rows, 10, 500)
    assert one < len(grown) - one


def test_words_with_one_hash(spark, monkeypatch):
    """A shared hash of two frequent words is noticed and everything is counted anew."""
    seeds = []

    def counts(df, fn, ddl, *options, own=P._map):
        out = own(df, fn, ddl, *options)
        if fn is P._word_counts:
            seeds.append(options[0])
        if not options[:1] == (0,):
            return out
        if fn is P._word_counts:
            return out.withColumn("w", F.when(F.col("w") == 0, F.col("w")).otherwise(F.lit(7)))
        return out.withColumn("w", F.transform("w", lambda w: F.lit(7).cast("long"))) if fn is P._runs else out

    monkeypatch.setattr(P, "_map", counts)
    rows = [("en", "a b c")] * 9
    got = P.collocations(spark.createDataFrame(rows, "lang string, text string"), keep=5, least=5, slots=1)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 5) and seeds == [0, 1]


def test_batches_are_bounded(spark, monkeypatch):
    """Long rows of one partition come to a task as batches of a few MB, not as one."""
    most = 2 * P.BATCH

    def watched(df, fn, ddl, *options, own=P._map):
        def checked(batches, *rest):
            def seen():
                for batch in batches:
                    if batch.nbytes > most:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch
            return fn(seen(), *rest)

        return own(df, checked, ddl, *options)

    monkeypatch.setattr(P, "_map", watched)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, a = spark.conf.get(name), 1_500 * 2_000
    docs = spark.range(0, 1_500, 1, 1).select(F.lit("en").alias("lang"), F.repeat(F.lit("one two! "), 2_000).alias("text"))
    got = [tuple(r) for r in P.collocations(docs).collect()]
    assert got == [("en", 1, "one two", a, a, a, 2 * a, 2_000)]
    assert spark.conf.get(name) == before


def test_odd_rows(odd, none):
    want = brute([(r[2], r[1]) for r in odd_rows()], 3, 2000)
    assert {tuple(r) for r in P.collocations(odd, least=3).collect()} == want and want
    assert P.collocations(none).collect() == []


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = set(con.execute(P.ORACLE).fetchall())
    got = {tuple(r) for r in op12_phrase_mining(spark, SF_SMALL).collect()}
    assert got == want
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert want == brute(docs, 100, 2000)
