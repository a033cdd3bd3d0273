"""Near duplicates by ProbMinHash, banding and exact verification.

1. Each text becomes its distinct shingles of five words, weighted ``1 + ln(count)``.
2. ProbMinHash: every shingle is a Poisson process of arrivals whose rate is its weight; an
   arrival falls into a random register, and a register keeps its earliest arrival.  A
   shingle stops as soon as its next arrival is later than all registers of its text.  Two
   texts agree in a register with the probability Jaccard similarity of their weighted sets.
3. Texts with the same weighted shingles are one class (no pairs are needed among them).
   Classes that agree in all registers of a band share a bucket.  There are bands of 4
   registers, which catch every pair at the threshold, and bands of 8, 16 and 32, which split
   large groups of copies into buckets of ever closer ones.
4. Within a bucket classes are first compared with one hub, not all with all.  The hub is the
   class that shares the most buckets with others, the middle of a group of copies.  Of the
   buckets whose classes are then not all in one group, those with at most ``SMALL`` classes
   are compared completely and the larger ones with a random hub.  What is still in several
   groups of a larger bucket is decided by an exact rule (``candidates``): every pair that can
   reach the threshold shares one of the rarest shingles of both.
5. A pair is a link if the exact similarity of its weighted sets reaches the threshold, and
   groups are the connected components of the links.  A turn's links are first mapped to the
   groups so far, so that each turn joins the groups it has found, not all links again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, chunks, land, mix64, plain_words, row_keys, utf8

WORDS = 5
SIMILARITY = 0.8

#: Registers, and the registers of a band: of 16 bands of 4, a pair at 0.8 shares one with
#: probability 0.9998.
REGISTERS, ROWS = 64, (4, 8, 16, 32)

#: Buckets of at most so many classes are compared completely.
SMALL = 8

#: The hubs that a group of copies gets in the second round: its buckets draw from so many
#: orders of the classes.
HUBS = 8

#: Registers of the sketches that decide whether two sets of a large bucket are compared at all, and
#: how far, in standard deviations, their share in agreement may lie below the threshold: a pair at the
#: threshold lies lower with probability 0.000002.
SKETCH, DEVIATIONS = 1_024, 4.6

#: Rows of an Arrow batch that holds whole sets or texts.
PAIR_ROWS, TEXT_ROWS = 256, 2_048

#: Bytes of text of a numpy pass: its arrays take about fifty times as much.
CHUNK = 1 << 20

#: Classes of a shingle that one key of the join of candidates holds.
SPREAD = 256

_RNG = np.random.default_rng(20)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def word_hashes(plain: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of ``plain_words`` and the words before each row.

    A word's hash is a polynomial in its bytes, taken from prefix sums of the whole chunk."""
    blank = plain == 32
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    begins = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(plain) + 1, _BASE, np.uint64))
        back = np.cumprod(np.full(len(plain) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
        total = np.append(np.uint64(0), np.cumsum(_LETTER[plain] * power[:-1]))
        hashes = mix64((total[ends] - total[begins]) * back[begins])
    return hashes, np.searchsorted(begins, rows)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order: ``row, hash, count``.

    A text of fewer words, but not none, is one shingle."""
    plain, rows, n_words = plain_words(data, offsets)
    words, first = word_hashes(plain, rows)
    row = np.repeat(np.arange(len(n_words)), n_words)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += words[k:k + n] * _PLACE[k]
        whole = np.flatnonzero(row[:n] == row[size - 1:]) if n else np.empty(0, np.int64)
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        part = np.array([int(np.sum(words[first[i]:first[i] + n_words[i]] * _PLACE[:n_words[i]], dtype=np.uint64))
                         for i in short], np.uint64)
        found = mix64(np.concatenate([total[whole], part + _PLACE[size:size + 1]]))
    at = np.concatenate([row[whole], short])
    order = np.lexsort((found, at))
    at, found = at[order], found[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (found[1:] != found[:-1])
    starts = np.flatnonzero(new)
    return at[starts], found[starts], np.diff(np.append(starts, len(at)))


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def prob_min_hash(row: np.ndarray, items: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Registers (``n_rows`` by ``m``): the item of the earliest arrival in each."""
    times = np.full(n_rows * m, np.inf)
    owner = np.zeros(n_rows * m, np.uint64)
    size = np.bincount(row, minlength=n_rows)
    alone = size[row] == 1  # a single item owns every register
    owner.reshape(n_rows, m)[row[alone]] = items[alone, None]
    active, clock = np.flatnonzero(~alone), np.zeros(len(row))
    step = 0
    with np.errstate(over="ignore"):
        while len(active):
            step += 1
            draw = mix64(items[active] ^ mix64(np.array([step], np.uint64) * _PLACE[9]))
            gap = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight[active]
            clock[active] += gap
            t, r = clock[active], row[active]
            place = r * m + (mix64(draw + np.uint64(0x632BE59BD9B4E019)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(times, place, t)
            won = t == times[place]
            owner[place[won]] = items[active[won]]
            last = times.reshape(n_rows, m).max(axis=1) if step < 4 or step % 8 == 0 else last  # noqa: F821
            active = active[t < last[r]]
    return owner.reshape(n_rows, m)


def band_keys(registers: np.ndarray, rows: tuple[int, ...]) -> np.ndarray:
    """Bucket of each row in every band of every size."""
    out = []
    with np.errstate(over="ignore"):
        for level, size in enumerate(rows):
            bands = registers.shape[1] // size
            key = np.full((len(registers), bands), level, np.uint64)
            for k in range(size):
                key = mix64(key * np.uint64(_BASE) + registers[:, k::size][:, :bands])
            out.append(mix64(key + _PLACE[:bands]))
    return np.concatenate(out, axis=1)


def register_bits(registers: np.ndarray) -> np.ndarray:
    """Three bits of every register, 15 registers to a number, four bits apart: equal registers
    have equal bits, others once in eight."""
    with np.errstate(over="ignore"):
        small = mix64(registers) >> np.uint64(61)
    small = np.pad(small, ((0, 0), (0, -small.shape[1] % 15))).reshape(len(small), -1, 15)
    return np.bitwise_or.reduce(small << (np.arange(15, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def agreeing(left: str, right: str, m: int) -> Column:
    """How many of ``m`` registers agree in their bits, from two columns of ``register_bits``.

    Four bits of the exclusive or are 0 to 7; adding 7 sets the top one unless they are 0."""
    low, top = F.lit(0x0777777777777777), F.lit(0x0888888888888888)
    differ = F.zip_with(left, right, lambda a, b: F.bit_count((a.bitwiseXOR(b) + low).bitwiseAND(top)))
    return F.lit(m) - F.aggregate(differ, F.lit(0), lambda total, n: total + n)


def least_agreeing(least: float, m: int) -> float:
    """Agreeing registers that a pair at the threshold has, but for ``DEVIATIONS``."""
    share = least + (1 - least) / 8
    return m * share - DEVIATIONS * (m * share * (1 - share)) ** 0.5


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows while a table is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def set_hash(row: np.ndarray, items: np.ndarray, counts: np.ndarray, n_rows: int) -> np.ndarray:
    """Hash of each row's weighted set."""
    out = np.zeros(n_rows, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, row, mix64(items + mix64(counts.astype(np.uint64))))
        return mix64(out)


def _signatures(batches: Iterator[pa.RecordBatch], m: int, rows: tuple[int, ...], schema: pa.Schema):
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        for a, b in chunks(offsets, CHUNK):
            row, items, counts = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            n = b - a
            registers = prob_min_hash(row, items, weights(counts), n, m)
            keys = band_keys(registers, rows).view(np.int64)
            size = np.bincount(row, minlength=n)
            cls = set_hash(row, items, counts, n).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, n) for i in range(3)), pa.array(cls, mask=size == 0), pa.array(size.astype(np.int32)), lists],
                schema=schema)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = REGISTERS,
               rows: tuple[int, ...] = ROWS) -> DataFrame:
    """``doc_id, row1, row2, cls, n_shingles, bands``: the class (null without words) and the
    band keys."""
    texts = docs.select(F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)),
                        F.col(text_col).alias("text"))
    ddl = (f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, row1 long, row2 long, cls long, "
           "n_shingles int, bands array<long>")
    schema = arrow_schema(ddl)
    return texts.mapInArrow(lambda it: _signatures(it, m, rows, schema), ddl)


def _sets(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(offsets, CHUNK):
            row, items, counts = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            cls = set_hash(row, items, counts, b - a).view(np.int64)
            w = weights(counts).astype("<f4")
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[some]), pa.array([items[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()),
                 pa.array([w[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary())], schema=schema)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (ascending items and their weights)."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    u, v = x[i].astype(float), y[j].astype(float)
    only_x, only_y = float(x.sum(dtype=float) - u.sum()), float(y.sum(dtype=float) - v.sum())
    total = 0.0
    ratio, n = np.unique(v / u, return_counts=True)
    for r, k in zip(ratio, n):  # items with the same ratio of weights have the same denominator
        denominator = np.maximum(u, v / r).sum() + only_x + only_y / r
        total += u[v / u == r].sum() / denominator
    return total


def _verify(batches: Iterator[pa.RecordBatch], least: float, schema: pa.Schema):
    for batch in batches:
        keep = []
        for k in range(batch.num_rows):
            a, x, b, y = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in zip(range(2, 6), ("<u8", "<f4") * 2))
            keep.append(probability_jaccard(a, x, b, y) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], schema=schema)


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(hub, cls)`` and whether their sets are ``similar`` enough."""
    hubs = sets.select(F.col("cls").alias("hub"), F.col("items").alias("a"), F.col("weights").alias("x"))
    rows = (pairs.join(sets.withColumnsRenamed({"items": "b", "weights": "y"}), "cls").join(hubs, "hub")
            .select("hub", "cls", "a", "x", "b", "y"))
    ddl = "hub long, cls long, similar boolean"
    schema = arrow_schema(ddl)
    return rows.mapInArrow(lambda it: _verify(it, least, schema), ddl)


def components(links: DataFrame) -> DataFrame:
    """``cls, label`` of every class with a link ``(hub, cls)``: the smallest class of its component.

    Labels spread along links and are then replaced by their own labels, so a chain of
    classes takes a logarithmic number of rounds."""
    spark = links.sparkSession
    edges = land(spark, links.select("hub", "cls").unionByName(links.select(F.col("cls").alias("hub"),
                                                                            F.col("hub").alias("cls"))), "edges")
    labels = edges.groupBy("cls").agg(F.least(F.min("hub"), F.col("cls")).alias("label"))
    while True:
        old = labels
        for _ in range(2):
            seen = (edges.join(labels.withColumnRenamed("cls", "hub"), "hub").groupBy("cls")
                    .agg(F.min("label").alias("near")))
            spread = labels.join(seen, "cls").select("cls", F.least("label", "near").alias("label"))
            own = spread.select(F.col("cls").alias("label"), F.col("label").alias("next"))
            labels = spread.join(own, "label").select("cls", F.least("label", "next").alias("label"))
        after = land(spark, labels.join(old.withColumnRenamed("label", "old"), "cls"), "labels")
        labels = after.select("cls", "label")
        if after.filter("label != old").isEmpty():
            return labels


def regrouped(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``cls, label`` after links between classes: groups that a link joins get the smaller label."""
    spark = labels.sparkSession
    of = labels.select(F.col("cls").alias("of"), "label")
    ends = (links.join(of.select(F.col("of").alias("hub"), F.col("label").alias("a")), "hub")
            .join(of.select(F.col("of").alias("cls"), F.col("label").alias("b")), "cls")
            .filter("a != b").select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("cls")).distinct())
    new = components(ends).select(F.col("cls").alias("label"), F.col("label").alias("new"))
    return land(spark, labels.join(new, "label", "left").select("cls", F.coalesce("new", "label").alias("label")), "groups")


def _entries(batches: Iterator[pa.RecordBatch], schema: pa.Schema):
    for batch in batches:
        for cls, label, items, w in zip(*(batch.column(c).to_pylist() for c in range(4))):
            items, w = np.frombuffer(items, "<i8"), np.frombuffer(w, "<f4").astype(float)
            n = len(items)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, cls)), pa.array(np.full(n, label)), pa.array(items),
                                              pa.array(w / w.sum())], schema=schema)


def _sketches(batches: Iterator[pa.RecordBatch], m: int, schema: pa.Schema):
    for batch in batches:
        if not batch.num_rows:
            continue
        items, w = (batch.column(i).to_pylist() for i in (1, 2))
        row = np.repeat(np.arange(len(items)), [len(x) // 8 for x in items])
        flat, weight = np.frombuffer(b"".join(items), "<u8"), np.frombuffer(b"".join(w), "<f4").astype(float)
        small = register_bits(prob_min_hash(row, flat, weight, len(items), m))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(items) + 1, dtype=np.int32) * small.shape[1]), pa.array(small.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=schema)


def candidates(own: DataFrame, sets: DataFrame, least: float, m: int = SKETCH) -> DataFrame:
    """The pairs ``(hub, cls)`` of classes with different labels among ``(cls, label)`` that can
    reach the threshold and whose sketches do not rule it out.

    Let two sets have the shares P and Q of their weights on common shingles.  Their
    similarity is at most 1 / (1/P + 1/Q - 1).  With all shingles in one order, the weight
    before the first common shingle is not common, so the shares u and v before it satisfy
    1/(1-u) + 1/(1-v) <= 1 + 1/least.  The order is by frequency, the rarest first.  Pairs
    within the most frequent label of a shingle are never made, and the classes of a frequent
    shingle are dealt over several keys."""
    spark = own.sparkSession
    ddl = "cls long, label long, item long, share double"
    schema = arrow_schema(ddl)
    with arrow_rows(spark, PAIR_ROWS):
        entries = land(spark, sets.join(own, "cls").select("cls", "label", "items", "weights")
                       .mapInArrow(lambda it: _entries(it, schema), ddl), "entries")
    often = entries.groupBy("item").agg(F.count("*").alias("often"))
    before = Window.partitionBy("cls").orderBy("often", "item").rowsBetween(Window.unboundedPreceding, -1)
    most = 1 - least + 1e-6
    posts = land(spark, entries.join(often, "item")
                 .withColumn("before", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
                 .filter((F.col("often") > 1) & (F.col("before") <= most)).select("item", "cls", "label", "before"), "posts")
    main = (posts.groupBy("item", "label").agg(F.count("*").alias("n")).groupBy("item")
            .agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("labels"))
            .filter("labels > 1").select("item", "main", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts")))
    ddl = "cls long, regs array<long>"
    schema2 = arrow_schema(ddl)
    with arrow_rows(spark, PAIR_ROWS):
        regs = land(spark, sets.join(own.select("cls").distinct(), "cls").select("cls", "items", "weights")
                    .mapInArrow(lambda it: _sketches(it, m, schema2), ddl), "sketches")
    posts = posts.join(main, "item").join(regs, "cls")
    left = (posts.filter("label != main")
            .select("item", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("cls").alias("h"),
                    F.col("label").alias("of"), F.col("before").alias("u"), F.col("regs").alias("x")))
    right = posts.select("item", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part"), "cls", "label", "main",
                         F.col("before").alias("v"), F.col("regs").alias("y"))
    able = 1 / (1 - F.col("u")) + 1 / (1 - F.col("v")) <= 1 + 1 / least + 1e-5
    return (left.join(right, ["item", "part"])
            .filter((F.col("of") != F.col("label")) & ((F.col("label") == F.col("main")) | (F.col("h") < F.col("cls"))) & able
                    & (agreeing("x", "y", m) >= least_agreeing(least, m)))
            .select(F.least("h", "cls").alias("hub"), F.greatest("h", "cls").alias("cls")).distinct())


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, m: int = REGISTERS, rows: tuple[int, ...] = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, class_id, group_id, kept, row1, row2``.

    ``class_id`` and ``group_id`` are the smallest ids of the texts with the same weighted
    shingles and of the group; a document is kept if it is the first of its group by id.  Links
    are not counted, as most pairs within a group are never compared.

    Defined results: a text without words is alone in its group; a null id is never the
    smallest unless there is no other; rows that repeat id and text belong to one class and
    are kept or not together; nulls in other columns and further columns change nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        signed = land(spark, signatures(docs, id_col, text_col, m, rows), "signatures")
    known = signed.filter(F.col("cls").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row1", "row2"))
    classes = land(spark, known.groupBy("cls").agg(first.alias("first"), F.first("bands").alias("bands")), "classes")
    members = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").count().filter("count > 1")
    members = land(spark, members.join(sizes, "bucket").select("bucket", "cls", "count"), "members")
    shared = land(spark, members.groupBy("cls").agg(F.sum("count").alias("shared")), "shared")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    one = known.join(shared.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    schema = arrow_schema("cls long, items binary, weights binary")
    one = one.select(F.col("doc_id").alias("rep"))
    needed = texts.join(one, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    with arrow_rows(spark, TEXT_ROWS):
        sets = land(spark, needed.mapInArrow(lambda it: _sets(it, schema), "cls long, items binary, weights binary")
                    .join(shared.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")

    labels, tested = shared.select("cls", F.col("cls").alias("label")), None
    for turn in range(3):
        if not turn:
            own = members.select("bucket", "cls").join(shared, "cls")
            hubs = own.groupBy("bucket").agg(F.max_by("cls", F.struct("shared", "cls")).alias("h"))
            pairs = own.join(hubs, "bucket").filter("h != cls")
        else:  # only buckets whose classes are in several groups
            own = members.select("bucket", "cls").join(labels, "cls")
            mixed = own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                              F.count("*").alias("size")).filter("low != high")
            own = land(spark, own.join(mixed.select("bucket", "size"), "bucket"), "mixed")
        if turn == 1:
            named = F.struct(F.col("cls").alias("h"), F.col("label").alias("of"))
            hubs = own.filter(F.col("size") > SMALL).groupBy("bucket").agg(
                F.min_by(named, F.xxhash64("cls", F.pmod("bucket", F.lit(HUBS)))).alias("hub")).select("bucket", "hub.*")
            hubs = hubs.unionByName(own.filter(F.col("size") <= SMALL).select("bucket", named.alias("hub"))
                                    .select("bucket", "hub.*"))
            pairs = own.join(hubs, "bucket").filter("of != label")
        if turn < 2:
            pairs = pairs.select(F.least("h", "cls").alias("hub"), F.greatest("h", "cls").alias("cls")).distinct()
        else:
            own = own.filter(F.col("size") > SMALL).select("cls", "label").distinct()
            pairs = candidates(own, sets, least)
        if tested is not None:
            pairs = pairs.join(tested.select("hub", "cls"), ["hub", "cls"], "left_anti")
        with arrow_rows(spark, PAIR_ROWS):
            result = land(spark, compared(pairs, sets, least), "pairs")
        tested = result if tested is None else tested.unionByName(result)
        labels = regrouped(labels, result.filter("similar").select("hub", "cls"))

    linked = classes.select("cls").join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"))
    named = land(spark, linked.join(classes.select("cls", "first"), "cls"), "named")
    groups = named.groupBy("label").agg(F.min("first").alias("best"))
    named = named.join(groups, "label").select("cls", "first", "best")
    alone = F.col("cls").isNull()
    return (signed.select("doc_id", "row1", "row2", "cls").join(named, "cls", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("group_id"),
        (alone | ((F.col("row1") == F.col("best.row1")) & (F.col("row2") == F.col("best.row2")))).alias("kept"),
        "row1", "row2"))
