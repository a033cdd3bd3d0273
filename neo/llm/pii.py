"""Personal data: candidate spans, gradient-boosted trees and calibrated thresholds.

1. High-recall generators propose spans, which may overlap, with format features (length,
   digits, check sums, separators, diversity of characters) and context features (words and
   signs before the span).  Spans that meet a base rule are marked; they are always kept.
2. Gradient-boosted trees are trained on all candidates but a third that is held out.  No labels of
   personal data exist, so they are weak labels: a candidate that passes its kind's check
   (address syntax, number ranges, check digit, number of digits, an assignment to a secret's
   name) is positive, one that fails is negative.  Those of a kind and label weigh as much as
   ``WEIGHT`` at most together, so that a frequent kind does not outvote a rare one.
3. On all candidates that were held out, each kind gets the lowest threshold whose precision is
   high enough.  Candidates beyond it are added to the base spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, land

#: Kinds in the order in which spans that start together are listed; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

#: What the candidates of a kind and weak label weigh together, at most, in the training of the trees.
WEIGHT = 2_000
PRECISION = 0.9
ROUNDS, DEPTH = 8, 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
HIDDEN_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63})+")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
TOKEN_SIZE = 16
ASSIGNED = re.compile(r"(?:token|key|secret|passw(?:or)?d|pwd|auth|credential)s?[\"']? ?[=:] ?[\"']?$", re.I)
CUES = re.compile(r"\b(?:e-?mail|mail|phone|tel|call|mobile|fax|card|visa|account|ip|host|address|token|key|secret|"
                  r"password)\b", re.I)

CANDIDATE = ("doc_id {id}, row_key long, kind string, first int, last int, base boolean, weak boolean, "
             "free boolean, features array<float>")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: what an address pattern finds, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        host = DOMAIN.match(text, at + 1) if first < at else None
        if host:
            done = host.end()
            yield first, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def proposals(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """``kind, first, last, base, weak`` of all candidates: base rules met, weak label."""
    for a, b in emails(text):
        yield "email", a, b, True, True
    if "(at)" in text or "[at]" in text:
        for m in HIDDEN_AT.finditer(text):
            yield "email", *m.span(), False, True
    done = 0
    for m in DOTTED.finditer(text):
        if m.end() > done:  # the token around these digits
            low, high = m.start(), m.end()
            while low > done and text[low - 1] in TOKEN:
                low -= 1
            while high < len(text) and text[high] in TOKEN:
                high += 1
            done = high
            if high - low >= TOKEN_SIZE and "." not in m.group():
                yield "secret", low, high, False, bool(ASSIGNED.search(text, max(0, low - 24), low))
        if m.group().count(".") >= 3:  # each four parts, from the left
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                size, good = sum(map(len, four)) + 3, all(map(_small, four))
                yield "ip", at, at + size, good, good
                at += size + 1
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        good = 14 <= len(digits) <= 19 and luhn(digits)
        if good or 11 <= len(digits) <= 21:
            yield "card", *m.span(), good, good
    if "+" in text:
        for m in PHONE.finditer(text):
            good = 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15
            yield "phone", *m.span(), good, good
    for m in LOCAL_PHONE.finditer(text):
        a = m.start()
        if not ("0" <= text[a - 1:a] <= "9"):
            yield "phone", a - (text[a - 1:a] == "("), m.end(), False, True


def features(text: str, kind: str, first: int, last: int) -> list[float]:
    """Format and context of a span; its first and last hundred letters speak for a longer one."""
    span = text[first:last] if last - first <= 200 else text[first:first + 100] + text[last - 100:last]
    before = text[max(0, first - 24):first]
    digits = _digits(span)
    counts = Counter(span)
    parts = re.split(r"[^0-9A-Za-z]+", span)
    return [float(x) for x in (
        last - first, len(digits), len(digits) / len(span), sum(c.isalpha() for c in span),
        sum(c in " .-()" for c in span), len(counts) / len(span), max(counts.values()) / len(span),
        14 <= len(digits) <= 19 and luhn(digits), len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts),
        "@" in span, span.count("."), span[0] == "+", sum(c in "0123456789abcdefABCDEF" for c in span) / len(span),
        bool(CUES.search(before)), before.rstrip(" \"'")[-1:] in ("=", ":"), before[-1:].isalnum(),
        text[last:last + 1].isalnum(), KINDS.index(kind))]


def _propose(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = schema.names
    for batch in batches:
        rows: list[tuple] = []
        origin: list[int] = []
        for i, text in enumerate(batch.column(2)):
            text = text.as_py() or ""
            origin.append(i)
            rows.append((None, None, None, None, None, None, None))  # the document itself
            found = list(dict.fromkeys(proposals(text)))
            base = sorted((a, b) for _, a, b, good, _ in found if good)
            end, reach = 0, []  # furthest end of the base spans that start no later
            for a, b in base:
                end = max(end, b)
                reach.append((a, end))
            for kind, a, b, good, weak in found:
                low, high = 0, len(reach)
                while low < high:  # base spans that start before this one's end
                    mid = (low + high) // 2
                    low, high = (mid + 1, high) if reach[mid][0] < b else (low, mid)
                free = not low or reach[low - 1][1] <= a
                origin.append(i)
                rows.append((kind, a, b, good, weak, free, features(text, kind, a, b)))
        take = pa.array(origin, pa.int64())
        columns = [batch.column(0).take(take), batch.column(1).take(take)]
        for k, values in enumerate(zip(*rows) if rows else [()] * 7):
            columns.append(pa.array(values, schema.field(names[k + 2]).type))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidate spans, and one row without a kind for each input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_key"),
                       F.col(text_col).alias("text"))
    ddl = CANDIDATE.format(id=rows.schema["doc_id"].dataType.simpleString())
    schema = arrow_schema(ddl)
    return rows.mapInArrow(lambda it: _propose(it, schema), ddl)


def examples(spans: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """Every candidate as ``kind, label, held_out, vector, weight``."""
    found = spans.filter(F.col("kind").isNotNull())
    held_out = F.xxhash64("row_key", "kind", "first", "last") % 3 == 0
    # at most a row for each kind and weak label
    counts = found.filter(~held_out).groupBy("kind", "weak").agg(F.least(F.lit(1.0), F.lit(float(weight)) / F.count("*")).alias("weight"))
    return found.join(F.broadcast(counts), ["kind", "weak"], "left").select(
        "kind", F.col("weak").cast("double").alias("label"), held_out.alias("held_out"),
        array_to_vector("features").alias("vector"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def train(spans: DataFrame, weight: float = WEIGHT, precision: float = PRECISION, rounds: int = ROUNDS):
    """The trees and each kind's threshold, learned from every candidate; None and no thresholds if a
    label is missing."""
    rows = land(spans.sparkSession, examples(spans, weight), "pii-examples")
    fit = rows.filter(~F.col("held_out"))
    if fit.select("label").distinct().count() < 2:
        return None, {}
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=DEPTH, seed=7,
                          cacheNodeIds=False).fit(fit)
    held = trees.transform(rows.filter("held_out"))
    step = F.floor(vector_to_array("probability")[1] * 100).cast("int")
    table = held.groupBy("kind", step.alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    thresholds = {}
    for kind in KINDS:
        n = good = 0.0
        for r in sorted((r for r in table if r["kind"] == kind), key=lambda r: -r["step"]):
            n, good = n + r["n"], good + r["good"]
            if good / n >= precision and r["step"] >= 50:
                thresholds[kind] = r["step"] / 100
    return trees, thresholds


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT,
         precision: float = PRECISION) -> DataFrame:
    """One row per input row: ``doc_id, spans, row_key`` (a hash of the text); a span has ``first, kind_no, last, kind, base,
    p`` in order of its start and kind (code points, end exclusive; ``p`` is 1 for a base rule).

    Defined results: null and empty texts have no spans; repeated rows are each returned;
    nulls in other columns and further columns change nothing; an empty table gives an empty
    result; with too few candidates to train on, only base spans are found.  Whole texts are
    scanned in linear time.
    """
    spans = land(docs.sparkSession, candidates(docs, id_col, text_col), "pii-candidates")
    trees, thresholds = train(spans, weight, precision)
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    if trees is None:
        scored = spans.withColumn("p", F.lit(0.0))
    else:
        vector = F.coalesce("features", F.array(*[F.lit(0.0).cast("float")] * 18))
        scored = trees.transform(spans.withColumn("vector", array_to_vector(vector)))
        scored = scored.withColumn("p", vector_to_array("probability")[1])
    least = F.lit(2.0)
    for kind, threshold in thresholds.items():
        least = F.when(F.col("kind") == kind, F.lit(threshold)).otherwise(least)
    chosen = F.col("base") | (F.col("free") & (F.col("p") >= least))
    span = F.struct("first", kind_no.alias("kind_no"), "last", "kind", "base",
                    F.when(F.col("base"), 1.0).otherwise(F.col("p")).alias("p"))
    return (scored.groupBy("doc_id", "row_key")
            .agg(F.count_if(F.col("kind").isNull()).cast("int").alias("n_rows"),
                 F.array_sort(F.array_distinct(F.collect_list(F.when(chosen, span)))).alias("spans"))
            .select("doc_id", F.explode(F.sequence(F.lit(1), "n_rows")).alias("copy"), "spans", "row_key").drop("copy"))


def joined(spans):
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (from ``find``) replaced by its kind in brackets;
    overlapping spans become one, named after the first.

    Spans belong to an id and a text: rows that share an id but not the text get their own
    spans.  No column name of ``docs`` is in the way."""
    spans = found.select(F.struct("doc_id", "row_key").alias("k"), "spans").dropDuplicates(["k"])
    spans = spans.select(F.col("k.doc_id").alias("__pii_id"), F.col("k.row_key").alias("__pii_key"), F.col("spans").alias("__pii_spans"))

    @F.udf("string", useArrow=True)
    def replaced(text, spans):
        out, done = [], 0
        for s in spans if spans is not None else []:
            if s["first"] >= done:
                out += [text[done:s["first"]], f"[{s['kind']}]"]
            done = max(done, s["last"])
        return text if text is None else "".join(out) + text[done:]

    same = docs[id_col].eqNullSafe(F.col("__pii_id")) & (F.xxhash64(docs[text_col]) == F.col("__pii_key"))
    return (docs.join(spans, same, "left").withColumn(text_col, replaced(docs[text_col], F.col("__pii_spans")))
            .drop("__pii_id", "__pii_key", "__pii_spans"))
