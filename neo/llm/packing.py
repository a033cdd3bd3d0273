"""Best-fit packing of documents into sequences: hierarchical residual packing.

1. Documents are tokenized and cut into pieces.  A piece's row is narrow (its ids stay behind),
   so a partition of the written pieces holds those of many documents; each task packs its
   partition by best fit, longest first.  Nearly full sequences are finished.
2. The underfull sequences are items of their own (an id and a fill, not their tokens).
   Those of ``FAN`` neighbouring tasks meet in one group and are packed by best fit again;
   nearly full ones are finished and the rest goes to the next level, until one group is left.
3. Each piece finds its final sequence and place through its first sequence.

After a best fit at most one item of a group is half empty or more, so few items are left
that another level could use.  A group passes on at most ``PASS_ON`` of its items, those with
the most room; the others are finished as they are, with all their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, land
from neo.llm.tokens import VOCABULARY, Encoder, crc32, cut, encoded

SIZE = 1024

#: A sequence that lacks fewer tokens than this is finished.
SLACK = 4

#: Tasks (or groups of tasks) whose underfull sequences meet in one group of the next level.
FAN = 8

#: Bounds: underfull sequences that a group passes on, and pieces that a task packs at a time.
PASS_ON, BLOCK = 4_096, 200_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and each bin's fill.

    Bins are kept by room; a bit set of the rooms that occur finds the least sufficient one."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, fills = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            present |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, size: int, schema: pa.Schema):
    encoder = Encoder.named(vocabulary)
    for batch in batches:
        origin, parts = [], []
        for i, tokens in enumerate(encoded(batch.column(1), encoder)):
            for piece, (start, length) in enumerate(cut(len(tokens), size)):
                origin.append(i)
                parts.append((piece, start, length, crc32(tokens[start:start + length])))
        ids = batch.column(0).take(pa.array(origin, pa.int64()))
        rest = [pa.array(v, t.type) for v, t in zip(zip(*parts), list(schema)[1:])] if parts else []
        if parts:
            yield pa.RecordBatch.from_arrays([ids, *rest], schema=schema)


def pieces_of(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens: ``doc_id, piece, start, length, ids_crc32``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = PIECE.format(id=rows.schema["doc_id"].dataType.simpleString())
    schema = arrow_schema(ddl)
    return rows.mapInArrow(lambda it: _pieces(it, vocabulary, size, schema), ddl)


def _first_level(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema):
    task = TaskContext.get().partitionId()
    used, held = 0, []

    def packed():
        nonlocal used, held
        table = pa.Table.from_batches(held).combine_chunks()
        bins, offsets, fills = best_fit(table["length"].to_numpy(), size)
        columns = [*table.columns, pa.array(np.full(len(bins), task, np.int32)),
                   pa.array((np.int64(task) << 36) + used + bins), pa.array(offsets), pa.array(fills[bins])]
        used, held = used + len(fills), []
        return pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield from packed()
    if held:
        yield from packed()


def _merge(size: int, slack: int, pass_on: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin", ignore_index=True)
        bins, offsets, fills = best_fit(group["fill"].to_numpy(np.int64), size)
        first = group["bin"].to_numpy()[np.unique(bins, return_index=True)[1]]  # a sequence is named by an item's id
        rest = np.argsort(fills, kind="stable")[:pass_on]
        open_ = np.zeros(len(fills), bool)
        open_[rest] = fills[rest] <= size - slack
        return pd.DataFrame({"bin": group["bin"], "parent": first[bins], "shift": offsets, "fill": fills[bins],
                             "open": open_[bins], "grp": group["grp"]})
    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SIZE, slack: int = SLACK, fan: int = FAN,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined results: a null or empty text is a document of the end id alone; repeated rows are
    packed each; nulls in other columns and further columns change nothing; an empty table
    gives an empty result.  Very long texts are cut into pieces without loss.
    """
    spark = docs.sparkSession
    cut_ = land(spark, pieces_of(docs, vocabulary, size, id_col, text_col), "pieces")
    ddl = PIECE.format(id=cut_.schema["doc_id"].dataType.simpleString()) + ", grp int, bin long, offset long, fill long"
    schema = arrow_schema(ddl)
    pieces = land(spark, cut_.mapInArrow(lambda it: _first_level(it, size, schema), ddl), "packed")
    items = pieces.filter(F.col("fill") <= size - slack).select("bin", "fill", "grp").distinct()
    where = items.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("shift"))
    top = items.agg(F.max("grp")).first()[0]
    while top is not None:
        level = land(spark, items.withColumn("grp", F.expr(f"cast(grp div {fan} as int)")).groupBy("grp").applyInPandas(
            _merge(size, slack, PASS_ON), "bin long, parent long, shift long, fill long, open boolean, grp int"), "level")
        moved = level.select(F.col("bin").alias("sequence_id"), "parent", F.col("shift").alias("more"))
        where = land(spark, where.join(moved, "sequence_id", "left").select(
            "bin", F.coalesce("parent", "sequence_id").alias("sequence_id"),
            (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")), "where")
        items = level.filter("open").select(F.col("parent").alias("bin"), "fill", "grp").distinct()
        top = top // fan if top else None
    return (pieces.join(where, "bin", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("sequence_id", "bin").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
