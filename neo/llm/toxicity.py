"""Toxicity by a weighted lexicon.

Texts are folded (case, letters of other scripts that look alike, digits that stand for
letters) and reduced to words joined by blanks.  The lexicon holds word beginnings and whole
words; an Aho-Corasick automaton finds all of them in one pass.  Matches inside an exception
phrase do not count.  The sum of the weights is normalised by the length of the text and
mapped to a probability by a logistic curve.

The lexicon, its weights and the curve are learned from labelled documents: a beginning or
word is an entry when its share of the toxic documents is clearly larger than its share of
the others.  Training reads a bounded sample, ``TRAIN_TOXIC`` and ``TRAIN_OTHER`` documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, land

#: Bounds of the training sample (labelled documents with the smallest hash of their id).
TRAIN_TOXIC, TRAIN_OTHER = 2_500, 7_500

#: Bound of the lexicon: the entries with the largest support.
MAX_ENTRIES = 5_000

#: An entry stands in at least so many toxic documents of the sample, whatever its size.
LEAST_DOCS = 3

#: Lengths of the word beginnings that are counted beside whole words.
STEMS = (4, 5, 6, 7)

THRESHOLD = 0.7

#: Look-alikes of Latin letters and digits that stand for letters (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}

#: Phrases in which an insult's word is meant literally (fixed values).
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "loser bracket",
              "stupid question no such thing")

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)}
                      | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Lexicon:
    """Entries (a whole word ends with a blank) with weights, and the curve's slopes and intercept."""
    weights: dict[str, float]
    slopes: tuple[float, ...]
    intercept: float
    exceptions: tuple[str, ...] = EXCEPTIONS


def fold(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower().translate(_FOLD))


def automaton(weights: dict[str, float], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for entry, weight in weights.items():
        out.add_word(" " + entry, (len(entry) + 1, weight))
    for phrase in exceptions:
        folded = " " + " ".join(fold(phrase)) + " "
        out.add_word(folded, (len(folded), None))
    if len(out):
        out.make_automaton()
    return out


def measure(words: list[str], found: ahocorasick.Automaton) -> tuple[float, float, float, int]:
    """Logarithm of the sum of the weights, of the number of words, the sum over the root of the
    number of words (at most 3), and the number of matches."""
    long = math.log(2 + len(words))
    if not words or not len(found):
        return 0.0, long, 0.0, 0
    hits, calm = [], []
    for end, (size, weight) in found.iter(" " + " ".join(words) + " "):
        if weight is None:
            calm.append((end - size + 1, end))
        else:
            hits.append((end - size + 1, end, weight))
    if calm:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in calm)]
    total = math.fsum(h[2] for h in hits)
    return math.log1p(total), long, min(3.0, total / math.sqrt(10 + len(words))), len(hits)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, n_toxic: int = TRAIN_TOXIC, n_other: int = TRAIN_OTHER) -> DataFrame:
    """``text, toxic`` of the documents of at most ``n_toxic + n_other`` labels that are not held
    out; a label that is given twice counts as the larger."""
    own = (labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
           .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    at = F.xxhash64("doc_id")
    picked = (own.filter("toxic = 1").orderBy(at).limit(n_toxic)
              .unionByName(own.filter("toxic = 0").orderBy(at).limit(n_other)))
    # at most n_toxic + n_other ids are broadcast, so the texts are not shuffled
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


COUNTS = ("docs_toxic", "words_toxic", "words_other")


#: A task hands its counts on, and begins anew, when it holds so many keys.
COUNTED_KEYS = 100_000


def _counts(docs: Counter, toxic: Counter, other: Counter) -> Iterator[pa.RecordBatch]:
    keys = list(toxic) + [k for k in other if k not in toxic]
    for i in range(0, len(keys), 50_000):
        part = keys[i:i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), *(pa.array([c[k] for k in part], pa.int64()) for c in (docs, toxic, other))],
            names=["entry", *COUNTS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic documents with each beginning and whole word, and its places in toxic and other
    documents; the key "" counts all words.  A key may come several times, its rows are summed later."""
    counters = docs, toxic, other = Counter(), Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            own = Counter()
            for w, n in Counter(fold(text.as_py())).items():
                own[""] += n
                own[w + " "] += n
                for k in STEMS:
                    if len(w) >= k:
                        own[w[:k]] += n
            if label.as_py():
                docs.update(own.keys())
                toxic.update(own)
            else:
                other.update(own)
            if len(toxic) + len(other) >= COUNTED_KEYS:
                yield from _counts(*counters)
                for c in counters:
                    c.clear()
    yield from _counts(*counters)


def prune(entries: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of nested entries with nearly the same support the longest stays, else the shortest."""
    best: dict[str, int] = {}
    starts = {e for e in entries}
    for e, (n, _) in entries.items():
        for k in range(1, len(e)):
            if e[:k] in starts:
                best[e[:k]] = max(best.get(e[:k], 0), n)
    kept = {e for e, (n, _) in entries.items() if best.get(e, 0) < 0.9 * n}
    return {e: entries[e][1] for e in kept if not any(e[:k] in kept for k in range(1, len(e)))}


def train(docs: DataFrame, labels: DataFrame, n_toxic: int = TRAIN_TOXIC, n_other: int = TRAIN_OTHER,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn the lexicon and the curve.  Without labels of both kinds the lexicon is empty and
    every text gets the share of toxic labels."""
    spark = docs.sparkSession
    rows = land(spark, training_rows(docs, labels, n_toxic, n_other).repartition(12), "toxicity-sample")
    sizes = dict(rows.groupBy("toxic").count().collect())
    t, o = sizes.get(1, 0), sizes.get(0, 0)
    prior = (t + 0.5) / (t + o + 1)
    if not t or not o:
        return Lexicon({}, (0.0, 0.0, 0.0), math.log(prior / (1 - prior)), exceptions)
    ddl = "entry string, " + ", ".join(f"{c} long" for c in COUNTS)
    counts = land(spark, rows.mapInArrow(_count, ddl).groupBy("entry").agg(*[F.sum(c).alias(c) for c in COUNTS]),
                  "toxicity-counts")
    all_words = counts.filter("entry = ''").first()
    if not all_words or not all_words["words_toxic"] or not all_words["words_other"]:
        return Lexicon({}, (0.0, 0.0, 0.0), math.log(prior / (1 - prior)), exceptions)
    a, b = F.col("words_toxic") + 0.5, F.col("words_other") + 0.5
    weight = F.log(a / all_words["words_toxic"]) - F.log(b / all_words["words_other"])
    sure = weight - 2 * F.sqrt(1 / (F.col("docs_toxic") + 0.5) + 1 / b)
    entries = (counts.filter((F.col("entry") != "") & (F.col("docs_toxic") >= LEAST_DOCS) & (sure > 1.5))
               .select("entry", "docs_toxic", sure.alias("weight"))
               .orderBy(F.desc("docs_toxic"), "entry").limit(MAX_ENTRIES).collect())
    weights = prune({r["entry"]: (r["docs_toxic"], r["weight"]) for r in entries})

    def points(batches):
        found = automaton(weights, exceptions)
        for batch in batches:
            got = [measure(fold(s), found) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([g[i] for g in got], pa.float64()) for i in range(3)), batch.column(1).cast(pa.float64())],
                names=["x0", "x1", "x2", "label"])

    known = rows.mapInArrow(points, "x0 double, x1 double, x2 double, label double")
    curve = LogisticRegression(maxIter=100, regParam=1e-4).fit(
        known.select("label", array_to_vector(F.array("x0", "x1", "x2")).alias("features")))
    return Lexicon(weights, tuple(float(c) for c in curve.coefficients), float(curve.intercept), exceptions)


def probability(x: tuple, model: Lexicon) -> float:
    z = math.fsum(a * b for a, b in zip(model.slopes, x)) + model.intercept
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, n_hits``.

    Defined results: a null or empty text has no match and gets the curve's value at zero;
    repeated rows are each returned; nulls in other columns and further columns change
    nothing; an empty table gives an empty result.  Whole texts are scored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_hits long"
    schema = arrow_schema(ddl)

    def run(batches):
        found = automaton(model.weights, model.exceptions)
        for batch in batches:
            got = [measure(fold(s.as_py()), found) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([probability(x, model) for x in got], pa.float64()),
                 pa.array([x[3] for x in got], pa.int64())], schema=schema)

    return rows.mapInArrow(run, ddl)


def reject(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        found = automaton(model.weights, model.exceptions)
        for batch in batches:
            keep = [probability(measure(fold(s.as_py()), found), model) < threshold for s in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
