"""Quality classifier: document evidence and hierarchical empirical Bayes for sites.

1. A logistic classifier on shape features of a text (shares of capitals, signs and digits,
   repeated words and lines, lengths) gives each document a probability of good quality.
2. Hosts and paths below them are sites with an unknown share of good documents.  Sums of
   the probabilities per path and host, by grouped aggregation over all documents, are their
   observations.  A host's posterior share is shrunk toward the global share and a path's
   toward its host's; the strength of either prior comes from the spread of the observed
   shares (method of moments), so sparse sites stay near their prior.
3. A document's score adds the logarithmic odds of its own evidence and of its site relative
   to the global share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, chunks, land, mix64, plain_words, utf8
from neo.llm.near_dedup import word_hashes

#: Bound of the training sample: labelled documents with the smallest hash of their id.
TRAIN = 10_000

THRESHOLD = 0.5

#: Prior strengths stay within these bounds (documents that a prior counts for).
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6

N_FEATURES = 11


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each row's text, ``(rows, N_FEATURES)``; an empty text has zeros."""
    n = len(offsets) - 1

    def per_row(mask):
        total = np.append(0, np.cumsum(mask))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    capital = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    white = (data == 32) | (data == 10)
    line = data == 10
    sign = ~(letter | digit | white)
    plain, rows, n_words = plain_words(data, offsets)
    words, first = word_hashes(plain, rows)
    row = np.repeat(np.arange(n), n_words)
    order = np.lexsort((words, row))
    r, w = row[order], words[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    distinct = np.bincount(r[new], minlength=n)
    same = np.zeros(len(row), bool)  # a word that repeats the one before
    same[1:] = (row[1:] == row[:-1]) & (words[1:] == words[:-1])
    with np.errstate(over="ignore"):
        pair = mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    inside = np.flatnonzero(row[:-1] == row[1:])
    order = np.lexsort((pair[inside], row[inside]))
    pr, pw = row[inside][order], pair[inside][order]
    new = np.ones(len(pr), bool)
    new[1:] = (pr[1:] != pr[:-1]) | (pw[1:] != pw[:-1])
    pairs = np.maximum(np.bincount(pr, minlength=n), 1)
    count = np.maximum(n_words, 1)
    repeated = np.bincount(row[same], minlength=n) / count
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), per_row(letter) / some, per_row(capital) / some, per_row(digit) / some,
        per_row(sign) / some, per_row(line) / some, size / count / 10, distinct / count, repeated,
        np.bincount(pr[new], minlength=n) / pairs])


def features(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, host, path, features`` of every row; a null host or path is the empty text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                       F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, path string, features array<double>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for a, b in chunks(offsets):
                x = shape_features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * N_FEATURES),
                                                 pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(3)), lists],
                                                 schema=schema)

    return rows.mapInArrow(run, ddl)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, parent: Column) -> float:
    """Prior strength by moments: how many documents the share of the level above counts for.

    The squared distances of the sites' shares from their prior, beyond what documents drawn
    with that share would show, are the spread of the sites themselves."""
    noise = parent * (1 - parent)
    got = sites.filter("n >= 2").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - parent, 2)).alias("far"),
        F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("all_noise")).first()
    if not got["n"]:
        return MOST_STRENGTH
    spread = max(0.0, got["far"] - got["noise"]) / got["n"]
    mean_noise = got["all_noise"] / got["n"]
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, mean_noise / spread - 1)) if spread else MOST_STRENGTH


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
          limit: int = TRAIN, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, evidence, host_share, path_share, score, keep``.

    Learns only from labels of documents that are not held out, at most ``limit`` of them.
    Labels, host and path are no inputs of the document classifier.

    Defined results: a null or empty text has zero features; a null host or path is a site
    named by the empty text; null labels are ignored; a label that is given twice counts as
    the larger; repeated rows are each scored; without labels of both kinds the evidence is
    the share of good labels (a half without any); an empty table gives an empty result.
    """
    spark = docs.sparkSession
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = land(spark, features(docs, host, path, id_col, text_col), "quality-features")
    known = (labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    sample = land(spark, rows.join(known, "doc_id").select(
        F.col("quality").cast("double").alias("label"), "features", F.xxhash64("doc_id").alias("at"))
        .orderBy("at").limit(limit), "quality-sample")
    count = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(count) < 2:
        share = (count.get(1.0, 0) + 0.5) / (sum(count.values()) + 1)
        scored = rows.withColumn("evidence", F.lit(share))
    else:
        curve = LogisticRegression(maxIter=100, regParam=1e-4).fit(
            sample.select("label", array_to_vector("features").alias("features")))
        z = F.lit(float(curve.intercept))
        for i, c in enumerate(curve.coefficients):
            z = z + F.lit(float(c)) * F.col("features")[i]
        scored = rows.withColumn("evidence", 1 / (1 + F.exp(-z)))
    scored = scored.select("doc_id", "host", "path", "evidence")
    paths = land(spark, scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good")),
                 "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not total["n"]:
        share = 0.5
    else:
        share = total["good"] / total["n"]
    k = _strength(hosts, F.lit(share))
    hosts = land(spark, hosts.select("host", ((F.col("good") + k * share) / (F.col("n") + k)).alias("host_share")),
                 "quality-hosts")
    below = paths.join(hosts, "host")
    k = _strength(below, F.col("host_share"))
    sites = land(spark, below.select("host", "path", "host_share", (
        (F.col("good") + k * F.col("host_share")) / (F.col("n") + k)).alias("path_share")), "quality-sites")
    final = _logit(F.col("evidence")) + _logit(F.col("path_share")) - _logit(F.lit(share))
    return (scored.join(sites, ["host", "path"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_share", "path_share",
                    (1 / (1 + F.exp(-final))).alias("score"))
            .withColumn("keep", F.col("score") >= threshold))
