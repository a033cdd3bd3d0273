"""License scan: base phrases and fuzzy search of short license notices.

Texts are reduced to their lower-cased words joined by single blanks, a whole chunk of
documents at a time.  A notice may differ from its pattern by a bounded number of edits.
By the pigeonhole principle a pattern cut into ``edits + 1`` pieces has at least one piece
that occurs unchanged, so exact searches for the pieces locate every candidate.  Around
each of them the ``regex`` library's bounded-error matching verifies the notice and gives
its span and number of edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, chunks, plain_words, utf8

#: Base phrases and their labels (fixed by the query's contract).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices of the method and their labels, as lower-case words.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "creative commons": "cc",
    "licensed under cc by": "cc",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge": "mit",
    "this work is licensed under": "licensed",
}

SCHEMA = ("doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,edits:int,found:string>>")


def allowed_edits(pattern: str) -> int:
    """One edit for each ten letters of a notice, at most three."""
    return min(3, max(1, len(pattern) // 10))


def pieces(pattern: str, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(pattern) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, pattern[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


class Notice:
    def __init__(self, pattern: str, label: str):
        self.label, self.size, self.edits = label, len(pattern), allowed_edits(pattern)
        self.seeds = pieces(pattern, self.edits)
        fuzzy = "(?b)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(pattern, literal_spaces=True), self.edits)
        self.match = regex.compile(fuzzy.encode())


def scan_text(plain: bytes, first: int, last: int, notices: list[Notice], hits: dict) -> list[tuple]:
    """Spans ``(start, end, label, edits)`` in ``plain[first:last]``, verified around the seeds' ``hits``."""
    found: dict[tuple[int, str], tuple] = {}
    for notice, at in hits:
        k, size = notice.edits, notice.size
        low, high = max(first, at - k - 1), min(last, at + size + 2 * k + 1)
        m = notice.match.search(plain, low, high)
        if not m or m.start() == m.end() or (m.end() < last and plain[m.end()] != 32):
            continue
        edits, key = sum(m.fuzzy_counts), (m.start(), notice.label)
        if key not in found or edits < found[key][3]:
            found[key] = (m.start(), m.end(), notice.label, edits, 1 - edits / size)
    return [found[k] for k in sorted(found)]


def _positions(plain: bytes, seed: bytes) -> list[int]:
    out, at = [], plain.find(seed)
    while at >= 0:
        out.append(at)
        at = plain.find(seed, at + 1)
    return out


def _scan(batches: Iterator[pa.RecordBatch], base: dict, patterns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    notices = [Notice(p, label) for p, label in patterns.items()]
    exact = [(f" {p} ".encode(), label) for p, label in base.items()]
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(offsets):
            own = offsets[a:b + 1] - offsets[a]
            array, rows, counts = plain_words(data[offsets[a]:offsets[b]], own)
            plain = array.tobytes()
            seeds = [[] for _ in range(b - a)]
            for notice in notices:
                for shift, seed in notice.seeds:
                    places = np.array(_positions(plain, seed), np.int64)
                    for row, at in zip(np.searchsorted(rows, places, "right") - 1, places - shift):
                        seeds[row].append((notice, int(at)))
            places = [[] for _ in range(b - a)]
            for phrase, label in exact:
                where = np.array(_positions(plain, phrase), np.int64)
                for row, at in zip(np.searchsorted(rows, where, "right") - 1, where):
                    places[row].append((int(at) + 1, label))
            out = []
            for i in range(b - a):
                first, last = int(rows[i]), int(rows[i + 1])
                number = (lambda at: plain.count(b" ", first, at) - 1)  # noqa: B023
                spans = scan_text(plain, first + 1, last, notices, seeds[i]) if seeds[i] else []
                starts = sorted(number(at) for at, _ in places[i])
                labels = {label for _, label in places[i]}
                out.append({
                    "n_words": int(counts[i]), "n_base": len(starts),
                    "first_word": starts[0] if starts else None, "last_word": starts[-1] if starts else None,
                    "base_labels": ",".join(sorted(labels)),
                    "labels": ",".join(sorted(labels | {s[2] for s in spans})),
                    "score": max([1.0 if starts else 0.0, *(s[4] for s in spans)]),
                    "spans": [{"label": s[2], "first_word": number(s[0]), "last_word": number(s[1] - 1),
                               "edits": s[3], "found": plain[s[0]:s[1]].decode(errors="replace")} for s in spans]})
            rest = pa.RecordBatch.from_pylist(out, pa.schema(list(schema)[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *rest.columns], schema=schema)


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans``.

    ``n_base`` counts the places where a base phrase's words stand consecutively,
    ``first_word`` and ``last_word`` are their smallest and largest start, ``spans`` are the
    verified notices (words from 0, both ends inclusive, and the edits), ``labels`` joins the
    labels of both, and ``score`` is the best share of letters without an edit.

    Defined results: a null or empty text has no words and no spans and scores 0; nulls in
    other columns, repeated rows and further columns change nothing; an empty table gives an
    empty result.  Each task scans some megabytes at a time, so a very long text only takes
    a chunk of its own size.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    schema = arrow_schema(ddl)
    base, notices = dict(base), dict(notices)
    return rows.mapInArrow(lambda it: _scan(it, base, notices, schema), ddl)
