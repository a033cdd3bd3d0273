"""Token-id output: packed id matrices, cumulative segment lengths and position resets.

Each task packs its documents block by block, longest piece first, into rows of ``size``
ids.  A segment tree over the rooms finds the fullest row that still holds a piece.  A row
of the written table is one row of the matrix: its ids as little-endian bytes, padded to
``size``, the cumulative lengths of its segments, the places where positions start again and
which part of which document each segment is.  Overlong documents are cut without loss, so
the documents can be restored from the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, land
from neo.llm.tokens import VOCABULARY, Encoder, crc32, cut, encoded

SIZE = 2048
PAD_ID = 0

#: A task packs so many tokens at a time (4 bytes each).
BLOCK_TOKENS = 4 << 20


class Rooms:
    """Segment tree over rooms 0..capacity: how many rows have each, and the least one that is
    large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``least``, removed; with that room."""
        at = self.leaves + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until there is one to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:  # down to the leftmost
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_rows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each row, packed by best fit, longest first."""
    rooms, rows = Rooms(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = rooms.take(size)
        if found is None:
            rows.append([])
            found = len(rows) - 1, capacity
        row, room = found
        rows[row].append(i)
        if room > size:
            rooms.add(room - size, row)
    return rows


def _matrix(batches: Iterator[pa.RecordBatch], vocabulary: str, size: int, pad: int, kind: str, schema: pa.Schema):
    encoder, shard = Encoder.named(vocabulary), TaskContext.get().partitionId()
    held: list[tuple] = []  # document, piece, start, ids
    tokens = done = 0

    def block():
        nonlocal done
        out = {name: [] for name in schema.names}
        for k, items in enumerate(best_fit_rows(np.array([len(h[3]) for h in held]), size)):
            parts = [held[i] for i in items]
            ends = np.cumsum([len(p[3]) for p in parts])
            ids = np.full(size, pad, kind)
            ids[:ends[-1]] = np.concatenate([p[3] for p in parts])
            out["shard"].append(shard)
            out["row"].append(done + k)
            out["ids"].append(ids.tobytes())
            out["cu_seqlens"].append([0, *ends.tolist()])
            out["resets"].append([0, *ends[:-1].tolist()])
            out["doc_ids"].append([p[0] for p in parts])
            out["pieces"].append([p[1] for p in parts])
            out["starts"].append([p[2] for p in parts])
        done += len(out["row"])
        return pa.RecordBatch.from_pydict(out, schema=schema)

    for batch in batches:
        for doc_id, ids in zip(batch.column(0), encoded(batch.column(1), encoder)):
            for piece, (start, length) in enumerate(cut(len(ids), size)):
                held.append((doc_id.as_py(), piece, start, ids[start:start + length]))
            tokens += len(ids)
            if tokens >= BLOCK_TOKENS:
                yield block()
                held, tokens = [], 0
    if held:
        yield block()


def matrix(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, pad_id: int = PAD_ID, wide: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the id matrix: ``shard, row, ids, cu_seqlens, resets, doc_ids, pieces, starts``.

    ``ids`` holds ``size`` unsigned little-endian numbers of two bytes (four if ``wide``, for
    vocabularies beyond 65,536); ids after the last segment are ``pad_id``.  ``resets`` are the
    places where position 0 starts again.

    Defined results: a null or empty text is a document of the end id alone; repeated rows are
    packed each; nulls in other columns and further columns change nothing; an empty table
    gives an empty result.  A block holds whole documents of some millions of tokens, or one
    longer document.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = ("shard int, row long, ids binary, cu_seqlens array<int>, resets array<int>, "
           f"doc_ids array<{kind}>, pieces array<int>, starts array<long>")
    schema = arrow_schema(ddl)
    return rows.mapInArrow(lambda it: _matrix(it, vocabulary, size, pad_id, "<u4" if wide else "<u2", schema), ddl)


def segments(packed: DataFrame, wide: bool = False) -> DataFrame:
    """One row per segment of a matrix: ``doc_id, piece, start, length, shard, row, offset, ids_crc32``."""
    ddl = ("doc_id {}, piece int, start long, length long, shard int, row long, offset long, ids_crc32 long"
           .format(packed.schema["doc_ids"].dataType.elementType.simpleString()))
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4" if wide else "<u2")
                for k, doc_id in enumerate(r["doc_ids"]):
                    a, b = r["cu_seqlens"][k:k + 2]
                    out.append({"doc_id": doc_id, "piece": r["pieces"][k], "start": r["starts"][k], "length": b - a,
                                "shard": r["shard"], "row": r["row"], "offset": a,
                                "ids_crc32": crc32(ids[a:b].astype("<u4"))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return packed.mapInArrow(run, ddl)


def write(docs: DataFrame, name: str = "token-matrix", **options) -> DataFrame:
    """Write the matrix to the shared checkpoint folder; the table that was written."""
    return land(docs.sparkSession, matrix(docs, **options), name)
