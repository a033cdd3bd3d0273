"""Removal of repeated substrings with suffix arrays.

A string of ``size`` bytes is removed where an equal one starts earlier, in a document with
a smaller id or before in the same document.

1. Every window of ``size`` bytes has an anchor, the least hash of its ``ANCHOR``-byte grams.
   Consecutive windows with the same anchor form a context.  Equal windows have equal
   anchors, so they meet in the group of that anchor, and contexts whose anchor occurs once
   need no more work.
2. Equal contexts are collapsed, first within each task, then in the group: all but the
   first are removed whole.
3. For a group with different contexts, or with one that repeats itself, their bytes are
   fetched and their suffix array is built by the linear grouping construction.  Windows that
   are equal are neighbours in it; each class of them keeps its first place.
4. The removed ranges of a document are united and cut out.

Anchors that would fill a task with different contexts (a line in a large share of all
documents) are found beforehand by counting those of a sample of the documents.  Their
windows are grouped one by one, each by the hash of all its bytes, so that equal ones
collapse within the tasks.  The sample decides only how windows are grouped, not the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, chunks, land, mix64, utf8
from neo.llm.suffix_array import suffix_arrays

SIZE = 100
ANCHOR = 32

#: An anchor is heavy if it may hold more than this part of a partition's share of all contexts.
HEAVY_PART = 1 / 16
HEAVY_SAMPLE = 0.05

#: Contexts that a task collects before it collapses equal ones (some 40 bytes each).
COLLAPSE = 1_000_000

#: Bytes of contexts whose suffix arrays are evaluated together.
BLOCK_BYTES = 3 << 20

CHUNK = 2 << 20
NO_ID = (1 << 63) - 1

_RNG = np.random.default_rng(100)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def contexts(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, anchor: int = ANCHOR):
    """Contexts of all rows: row, first window (from the row's start), number of windows,
    anchor, hash of the whole context, whether its anchor occurs twice, and the function that
    gives the hash of a window at a place of the chunk."""
    n, w = len(data), size - anchor + 1
    rows = np.flatnonzero(np.diff(offsets) >= size)
    if not len(rows):
        nothing = np.empty(0, np.int64)
        return nothing, nothing, nothing, nothing.view(np.uint64), nothing.view(np.uint64), nothing.astype(bool), None
    with np.errstate(over="ignore"):
        power, back = _power_table(n + 1)
        total = np.append(np.uint64(0), np.cumsum(_LETTER[data] * power[:n]))

        def window(at):
            return mix64((total[at + size] - total[at]) * back[at])

        gram = mix64((total[anchor:] - total[:-anchor]) * back[:n + 1 - anchor])
    least, length = gram, 1
    while 2 * length <= w:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    if w > length:
        least = np.minimum(least[:length - w], least[w - length:])
    lead = np.zeros(n + 1, np.int64)  # starts of windows that lie within one row
    np.add.at(lead, offsets[rows], 1)
    np.add.at(lead, offsets[rows + 1] - size + 1, -1)
    starts = np.flatnonzero(np.cumsum(lead[:-1]))
    value = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
    new |= np.isin(starts, offsets[rows])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    if count.max() > w:  # periodic text: parts of at most w windows
        parts = -(-count // w)
        shift = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + w * shift
        count = np.minimum(np.repeat(count, parts) - w * shift, w)
    at, h = starts[first], value[first]
    last = at + count - 1
    with np.errstate(over="ignore"):
        whole = mix64(window(at) + mix64(window(last) + count.astype(np.uint64)))
    same = np.append(0, np.cumsum(gram[starts] == value))
    twice = same[first + count] - same[first] > 1
    tail = np.lib.stride_tricks.sliding_window_view(np.append(gram, np.zeros(w, np.uint64)), w - 1)
    within = same[first + count] - same[first] > 0
    for a in range(0, len(at), 1 << 16):
        part = slice(a, a + (1 << 16))
        beyond = (tail[last[part] + 1] == h[part, None]).sum(axis=1)
        twice[part] |= beyond + within[part] > 1
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at - offsets[row], count, h, whole, twice, window


def _place(first, tag, twice, count):
    """Start, row tag, flag and number of windows in one number that orders by the start."""
    return (first << 32) | (tag << 8) | (twice.astype(np.int64) << 7) | count


def _first_of(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its key: no equal one has a smaller id or start."""
    order = np.lexsort((place, doc, key))
    k, d, s = key[order], doc[order], place[order] >> 32
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(k), bool)
    out[order] = (d == d[head]) & (s == s[head])
    return out


ANCHORS = "decided boolean, doc long, place long, anchor long, whole long"


def _anchors(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, collapse: int, schema: pa.Schema):
    held: list[list[np.ndarray]] = []
    size = 0

    def collapsed():
        doc, place, h, c = (np.concatenate(x) for x in zip(*held))
        with np.errstate(over="ignore"):
            key = mix64(h + mix64(c))
        order = np.argsort(key)
        k = key[order]
        again = np.zeros(len(k), bool)
        again[1:] = k[1:] == k[:-1]
        again[:-1] |= again[1:]
        some = order[again]
        decided = np.zeros(len(k), bool)
        decided[some] = ~_first_of(key[some], doc[some], place[some])
        for part in (np.flatnonzero(decided), np.flatnonzero(~decided)):
            for a in range(0, len(part), 100_000):
                i = part[a:a + 100_000]
                gone = decided[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gone), pa.array(doc[i]), pa.array(place[i]), pa.array(h[i].view(np.int64), mask=gone),
                     pa.array(c[i].view(np.int64), mask=gone)], schema=schema)

    for batch in batches:
        doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = utf8(batch.column(2))
        for a, b in chunks(offsets, CHUNK):
            part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            row, first, count, h, whole, twice, window = contexts(part, own)
            if not len(row):
                continue
            many = np.isin(h, heavy) if len(heavy) else np.zeros(len(h), bool)
            if many.any():  # one entry for each window of a heavy anchor
                n = count[many]
                shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                r = np.repeat(row[many], n)
                f = np.repeat(first[many], n) + shift
                x = window(own[r] + f)
                few = ~many
                row, first = np.append(row[few], r), np.append(first[few], f)
                count, twice = np.append(count[few], np.ones_like(f)), np.append(twice[few], np.zeros(len(f), bool))
                h, whole = np.append(h[few], x), np.append(whole[few], x)
            held.append([doc_ids[a:b][row], _place(first, tags[a:b][row], twice, count), h, whole])
            size += len(row)
            if size >= collapse:
                yield from collapsed()
                held, size = [], 0
    if held:
        yield from collapsed()


GROUPED = "decided boolean, doc long, place long, anchor long"


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Rows that are sorted by column ``key``, in tables that do not cut a run of equal keys."""
    rest: list[pa.RecordBatch] = []
    held = None  # the key of the rows in rest
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(values != values[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if rest and (cut or held != values[0]):
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        rest.append(batch.slice(cut))
        held = values[-1]
    if rest:
        yield pa.Table.from_batches(rest)


def _group(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    sent: list[pa.RecordBatch] = []

    def undecided():
        for batch in batches:
            known = batch.column(0)
            if pc.any(known).as_py():
                sent.append(batch.filter(known).select(schema.names))
            yield batch.filter(pc.invert(known))

    for rows in _runs(undecided(), 3):
        yield from sent
        sent.clear()
        doc, place, h, c = (rows[x].to_numpy() for x in ("doc", "place", "anchor", "whole"))
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        number = np.cumsum(new) - 1
        some = np.flatnonzero((np.bincount(number)[number] > 1) | ((place >> 7) & 1 == 1))
        if not len(some):
            continue
        doc, place, h, c, number = (x[some] for x in (doc, place, h, c, number))
        order = np.lexsort((c, number))
        new = np.ones(len(order), bool)
        new[1:] = (c[order][1:] != c[order][:-1]) | (number[order][1:] != number[order][:-1])
        cls = np.empty(len(order), np.int64)
        cls[order] = np.cumsum(new) - 1
        classes = np.bincount(number[order[new]], minlength=number.max() + 1)
        decided = ~_first_of(cls, doc, place)
        keep = decided | (classes[number] > 1) | ((place >> 7) & 1 == 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(decided[keep]), pa.array(doc[keep]), pa.array(place[keep]),
             pa.array(h[keep], mask=decided[keep])], schema=schema)
    yield from sent


PIECES = "anchor long, doc long, place long, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema):
    for batch in batches:
        out: list[tuple] = []
        for doc, text, wanted in zip(*(batch.column(i) for i in range(3))):
            raw, doc = (text.as_py() or "").encode(), doc.as_py()
            for x in wanted.as_py():
                first = x["place"] >> 32
                out.append((x["anchor"], doc, x["place"], raw[first:first + (x["place"] & 127) + size - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*out), schema)], schema=schema)


RANGES = "doc long, tag long, first long, last long"


def repeated_windows(groups: list[list[tuple[int, int, bytes]]], size: int = SIZE):
    """Windows with an earlier equal one, from the suffix arrays of groups of contexts
    ``(doc, place, bytes)``: arrays of document, tag and start, in ascending order."""
    text, doc_of, place_of, first_of = [], [], [], []
    at = 0
    for group in groups:
        symbols = []
        for doc, place, raw in group:
            doc_of.append(doc)
            place_of.append(place)
            first_of.append(at)
            symbols.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 1)
            symbols.append(np.zeros(1, np.int16))  # below every byte: no window crosses contexts
            at += len(raw) + 1
        text.append(np.concatenate(symbols))
    base = np.array([len(t) for t in text])
    begins = np.cumsum(base) - base
    order = np.concatenate([o + b for o, b in zip(suffix_arrays(text), begins)])
    symbols = np.concatenate([*text, np.zeros(size, np.int16)])
    first_of, doc_of, place_of = np.array(first_of), np.array(doc_of, np.int64), np.array(place_of, np.int64)
    context = np.searchsorted(first_of, order, "right") - 1
    shift = order - first_of[context]
    starts = np.flatnonzero(shift < (place_of[context] & 127))  # suffixes that begin a window
    order, context, shift = order[starts], context[starts], shift[starts]
    whole = np.lib.stride_tricks.sliding_window_view(symbols, size)
    equal = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 15):
        part = np.arange(a, min(len(order), a + (1 << 15)))
        equal[part] = (whole[order[part]] == whole[order[part - 1]]).all(axis=1)
    group_of = np.repeat(np.arange(len(base)), base)[starts]
    equal[1:] &= group_of[1:] == group_of[:-1]
    cls = np.cumsum(~equal)
    doc, place = doc_of[context], place_of[context]
    begin = (place >> 32) + shift
    some = np.flatnonzero(np.bincount(cls)[cls] > 1)
    later = some[~_first_of(cls[some], doc[some], begin[some] << 32)]
    doc, tag, begin = doc[later], (place[later] >> 8) & 0xFFFFFF, begin[later]
    order = np.lexsort((begin, tag, doc))
    return doc[order], tag[order], begin[order]


def _ranges(doc, tag, first, count, size, schema):
    """Ranges of bytes of runs of windows; touching ones of a document are joined."""
    order = np.lexsort((first, tag, doc))
    doc, tag, first, last = doc[order], tag[order], first[order], (first + count - 1 + size)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] > last[:-1])
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(last, at) if len(at) else last
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), pa.array(first[at]), pa.array(ends)],
                                      schema=schema)


def _sort_groups(batches: Iterator[pa.RecordBatch], size: int, block: int, schema: pa.Schema):
    held: list[list[tuple]] = []
    n = 0

    def flush():
        doc, tag, first = repeated_windows(held, size)
        return _ranges(doc, tag, first, np.ones(len(doc), np.int64), size, schema)

    for rows in _runs(batches, 0):
        anchor, group = None, []
        for a, *entry in zip(*(rows[c].to_pylist() for c in ("anchor", "doc", "place", "bytes"))):
            if a != anchor:
                anchor, group = a, []
                held.append(group)
            group.append(tuple(entry))
            n += len(entry[2])
        if n >= block:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _decided(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema):
    for batch in batches:
        doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        yield _ranges(doc, (place >> 8) & 0xFFFFFF, place >> 32, place & 127, size, schema)


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            raw = (text.as_py() or "").encode()
            spans: list[list[int]] = []
            for r in sorted((x["first"], x["last"]) for x in ranges.as_py() or []):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(),
                        [{"first": a, "last": b} for a, b in spans]))
        columns = [pa.array(v, t.type) for v, t in zip(zip(*out), list(schema)[1:])] if out else []
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)


def _heavy(texts: DataFrame, partitions: int) -> np.ndarray:
    """Anchors with too many different contexts for one group; fewer than ``partitions`` over
    ``HEAVY_PART`` can have that share."""
    schema = arrow_schema(ANCHORS)
    some = texts.sample(False, HEAVY_SAMPLE, 11).mapInArrow(
        lambda it: _anchors(it, np.empty(0, np.uint64), COLLAPSE, schema), ANCHORS).filter("not decided")
    counts = land(texts.sparkSession, some.groupBy("anchor").count(), "anchor-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.filter(F.col("count") > max(20.0, total * HEAVY_PART / partitions)).collect()
    return np.array([r["anchor"] for r in rows], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                   heavy: np.ndarray | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the removed ranges of bytes (ends exclusive), as large as possible.

    Defined results: a null text is empty and nothing of it is removed; a null id comes after
    all others; rows that repeat an id are at the same place, so a string does not count as
    earlier than an equal one that starts at the same byte of a row with the same id; nulls in
    other columns and further columns change nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                        F.xxhash64(text).bitwiseAND(0xFFFFFF).alias("tag"), text.alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy = _heavy(texts, partitions) if heavy is None else heavy
    a_schema, g_schema, p_schema, r_schema = map(arrow_schema, (ANCHORS, GROUPED, PIECES, RANGES))

    anchors = texts.mapInArrow(lambda it: _anchors(it, heavy, COLLAPSE, a_schema), ANCHORS)
    meets = F.when(F.col("decided"), F.xxhash64("doc", "place")).otherwise(F.col("anchor"))
    grouped = land(spark, anchors.repartition(partitions, meets).sortWithinPartitions("anchor")
                   .mapInArrow(lambda it: _group(it, g_schema), GROUPED), "grouped")

    open_ = grouped.filter("not decided").groupBy("doc", F.expr("(place >> 8) & 16777215").alias("tag")).agg(
        F.collect_set(F.struct("place", "anchor")).alias("wanted"))
    pieces = texts.join(open_, ["doc", "tag"]).select("doc", "text", "wanted").mapInArrow(
        lambda it: _fetch(it, size, p_schema), PIECES)
    pieces = pieces.dropDuplicates(["anchor", "doc", "place"])
    sorted_ = land(spark, pieces.repartition(partitions, "anchor").sortWithinPartitions("anchor")
                   .mapInArrow(lambda it: _sort_groups(it, size, BLOCK_BYTES, r_schema), RANGES), "ranges")
    whole = grouped.filter("decided").select("doc", "place").mapInArrow(lambda it: _decided(it, size, r_schema), RANGES)
    ranges = whole.unionByName(sorted_).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("first", "last")).alias("ranges"))
    ddl = ("doc_id {}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
           "spans array<struct<first:long,last:long>>".format(docs.schema[id_col].dataType.simpleString()))
    schema = arrow_schema(ddl)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                        F.xxhash64(text).bitwiseAND(0xFFFFFF).alias("tag"), text.alias("text"))
    return named.join(ranges, ["doc", "tag"], "left").select("doc_id", "text", "ranges").mapInArrow(
        lambda it: _cut(it, schema), ddl)
