"""Phrase collocation mining by best-first branch and bound.

The score of a phrase of words ``w1 ... wm`` is at most ``1000 n / f(w1)`` and at most
``1000 n / f(wm)``, as its part behind the first word, or before the last, occurs at least as
often as the phrase itself.  The counts of the words that a phrase begins or ends with thus
bound everything that grows from them.

1. Words are counted per language; those of at least ``least`` occurrences stay.  The texts
   are rewritten once as runs of such words (``runs``), their hashes side by side.
2. The frontier are the words, the rarest and so those of the highest bound first.  A wave
   takes each open language's words up to a count and grows phrases word by word, rightwards
   from a first and leftwards from a last word of the wave, as long as the prefix (suffix)
   itself occurs often enough.  The words of a phrase are its key; counts are exact.
3. A phrase whose first and last word are both taken has all counts that its cuts need, and
   all longer phrases that can drop it are counted.  Its score and survival are final.
4. A language is settled as soon as it has ``keep`` survivors above the bound of all words not
   yet taken, ties included.  Otherwise the next wave goes up to the count whose bound is the
   score of the last of its ``keep`` survivors, or over more of its words.

What tasks must know of words and prefixes (the class of a word's count, the phrases that
still grow) are tables of fixed size over hashes.  A shared slot only lets more phrases be
counted; none is lost, whatever the size of the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neo.llm.common import arrow_bytes, arrow_schema, chunks, land, mix64, utf8

WORDS, LEAST, KEEP = 5, 100, 2_000

#: Slots of the table of word classes, and bits of the table of phrases that grow.
SLOTS, BITS = 1 << 22, 1 << 24

#: Share of the frequent words' occurrences that a wave takes while no score bounds it.
SHARES = (0.125, 0.5, 1.0)

#: Bytes of an Arrow batch that a task gets, and of text in one language that a numpy pass works on.
BATCH, PASS = 4 << 20, 1 << 20

#: Words of a row of runs, and words that grow at a time.  A scan holds thousands of rows at once.
ROW, RUN = 256, 1 << 17

#: Parts in which the best phrases of a language are ranked before they are ranked together.
PARTS = 32

_LANG = "und"
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Kinds of bytes: of a word, a blank, the end of a piece (fixed by the contract).
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, lang: str, seed: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hash, piece and text of every word of texts in one language; no hash is 0."""
    n = len(offsets) - 1
    text = np.full(len(data) + n, 0x0A, np.uint8)
    spots = np.ones(len(text), bool)
    spots[offsets[:-1] + np.arange(n)] = False  # every text begins a piece
    text[spots] = _LOWER[data]
    kind = _KIND[text]
    inside = np.concatenate([[False], kind == 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    piece = np.cumsum(kind == 2)[starts] if len(starts) else np.empty(0, np.int64)
    letter = np.random.default_rng(100 + seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    own = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    with np.errstate(over="ignore"):
        total = np.full(len(text) + 1, _BASE, np.uint64)
        total[0] = 0
        np.cumprod(total[1:], out=total[1:])
        total[1:] *= letter[text]
        np.cumsum(total, out=total)
        inner = total[ends] - total[starts]
        total[:] = pow(_BASE, -1, 1 << 64)
        np.cumprod(total, out=total)
        hashes = mix64(mix64(inner * total[starts]) ^ own)
    hashes[hashes == 0] = 1
    # the words as one array: blanks are cut away, so that words lie side by side
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    strings = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(text[kind == 0])])
    return hashes, piece, strings


def _by_language(batches: Iterator[pa.RecordBatch], seed: int):
    """``lang, hashes, pieces, strings`` of chunks of texts in one language."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(coded.indices, k))
            data, offsets = utf8(texts)
            for a, b in chunks(offsets, PASS):
                yield lang, *words_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lang, seed)


def _word_counts(batches: Iterator[pa.RecordBatch], seed: int, schema: pa.Schema):
    for lang, hashes, _, _ in _by_language(batches, seed):
        found, counts = np.unique(hashes, return_counts=True)
        found, counts = np.append(found, np.uint64(0)), np.append(counts, len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)),
                                          pa.array(counts.astype(np.int64))], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], seed: int, classes, schema: pa.Schema):
    """Runs of at least two neighbouring words whose slot holds a class, with a 0 before each."""
    table = classes.value
    for lang, hashes, piece, strings in _by_language(batches, seed):
        often = table[hashes & np.uint64(len(table) - 1)] > 0
        joined = np.zeros(len(hashes) + 1, bool)
        joined[1:-1] = often[1:] & often[:-1] & (piece[1:] == piece[:-1])
        use = often & (joined[1:] | joined[:-1])
        head = use & ~joined[:-1]
        flat = np.insert(hashes[use], np.flatnonzero(head[use]), np.uint64(0))
        known, first = np.unique(hashes[use], return_index=True)
        words = strings.take(pa.array(np.flatnonzero(use)[first]))
        gaps = np.flatnonzero(flat == 0)
        _, cuts = np.unique(gaps // ROW, return_index=True)
        cuts = np.append(gaps[cuts], len(flat)).astype(np.int32)  # a row ends between two runs
        n = len(cuts) - 1
        if n < 1:
            continue
        vocabulary = pa.array(np.append(0, np.full(n, len(known))), pa.int32())  # beside the first row
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.view(np.int64))),
             pa.ListArray.from_arrays(vocabulary, pa.array(known.view(np.int64))),
             pa.ListArray.from_arrays(vocabulary, words)], schema=schema)


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases given as one array per place."""
    with np.errstate(over="ignore"):
        total = np.full(len(words[0]), np.uint64(len(words)))
        for k, w in enumerate(words):
            total += mix64(w + _PLACE[k])
        return mix64(total)


def _distinct(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases and how often each occurs."""
    keys = gram_hash(words)
    order = np.argsort(keys, kind="stable")
    keys, words = keys[order], [w[order] for w in words]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    same = ~new[1:]
    if any((same & (w[1:] != w[:-1])).any() for w in words):  # two phrases with one hash
        order = np.lexsort(words)
        words = [w[order] for w in words]
        new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)
    starts = np.flatnonzero(new)
    return [w[starts] for w in words], np.diff(np.append(starts, len(new)))


def _grow(batches: Iterator[pa.RecordBatch], size: int, classes, grown, schema: pa.Schema):
    """Counts of the phrases of ``size`` words that a wave adds, from ``low, high, run``: the
    least of the classes of their first and last word is above ``low`` and up to ``high``."""
    table, bits = classes.value, grown.value if grown else None

    def grows(keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(64 * len(bits) - 1)
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    for batch in batches:
        lists = batch.column(2)
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        flat = lists.flatten().to_numpy().view(np.uint64)
        limits = [batch.column(i).to_numpy() for i in range(2)]
        for a, b in chunks(offsets, RUN):
            run = flat[offsets[a]:offsets[b]]
            n = len(run) - size + 1
            if n <= 0:
                continue
            low, high = (np.repeat(x[a:b], np.diff(offsets[a:b + 1]))[:n] for x in limits)
            cut = np.concatenate([[0], np.cumsum(run == 0)])
            kind = table[run & np.uint64(len(table) - 1)]
            first, last = kind[:n], kind[size - 1:]
            taken = np.minimum(first, last)
            at = np.flatnonzero((cut[size:] == cut[:n]) & (taken > low) & (taken <= high))
            if size > 2 and len(at):
                keys = gram_hash([run[at + k] for k in range(size - 1)])
                at = at[(first[at] > high[at]) | grows(keys)]
                keys = gram_hash([run[at + k] for k in range(1, size)])
                at = at[(last[at] > high[at]) | grows(keys)]
            if not len(at):
                continue
            words, counts = _distinct([run[at + k] for k in range(size)])
            yield pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in words), pa.array(counts.astype(np.int64))],
                                             schema=schema)


def _bits(batches: Iterator[pa.RecordBatch], size: int, n_bits: int, schema: pa.Schema):
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(-1, size)
        at = gram_hash([flat[:, k] for k in range(size)]) & np.uint64(n_bits - 1)
        yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                          pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], schema=schema)


def _map(df: DataFrame, fn, ddl: str, *options) -> DataFrame:
    schema = arrow_schema(ddl)
    return df.mapInArrow(lambda it: fn(it, *options, schema), ddl)


def _land(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``land`` with batches that a task holds several of."""
    with arrow_bytes(spark, BATCH):
        return land(spark, df, name)


def _columns(table: DataFrame) -> list[np.ndarray]:
    found = table.toArrow()
    return [c.combine_chunks().to_numpy() for c in found.columns]


def _class_table(spark: SparkSession, words: DataFrame, slots: int):
    """The least class of the words of every slot (0: none), on all executors; a byte each."""
    slot = F.col("w").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")
    at, kind = _columns(words.groupBy(slot).agg(F.min("class").cast("byte").alias("class")))
    table = np.zeros(slots, np.uint8)
    table[at] = kind
    return spark.sparkContext.broadcast(table)


def _bit_table(spark: SparkSession, grams: DataFrame, size: int, n_bits: int):
    """A bit for every phrase that occurs often enough, on all executors."""
    rows = _map(grams.select("ws"), _bits, "at long, bits long", size, n_bits).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    at, bits = _columns(rows)
    table = np.zeros(n_bits // 64, np.uint64)
    table[at] = bits.view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _best(df: DataFrame, order: list, keep: int, name: str = "place") -> DataFrame:
    """The first ``keep`` rows of each language and their places, ranked in parts first."""
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("ws"), F.lit(PARTS))).orderBy(*order)
    some = df.withColumn(name, F.row_number().over(parts)).filter(F.col(name) <= keep)
    return (some.withColumn(name, F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col(name) <= keep))


def _survivors(grams: DataFrame, words: DataFrame, state: DataFrame, least: int) -> DataFrame:
    """``lang, ws, a, l, r, n, score`` of the phrases whose first and last word are taken
    and which no longer phrase drops."""
    size = F.size("ws")
    counts = (grams.filter(size < WORDS).select("ws", F.col("a").alias("f"))
              .unionByName(words.select(F.array("w").alias("ws"), "f")))
    parts = F.array(F.slice("ws", F.lit(1), size - 1), F.slice("ws", F.lit(2), size - 1))
    longer = (grams.filter(size > 2).select(F.explode(parts).alias("ws"), F.col("a").alias("longer"))
              .groupBy("ws").agg(F.max("longer").alias("longer")))
    alive = grams.join(longer, "ws", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    cuts = (alive.select("ws", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .withColumns({"left": F.slice("ws", F.lit(1), F.col("k")), "right": F.slice("ws", F.col("k") + 1, size - F.col("k"))}))
    cuts = (cuts.join(counts.withColumnsRenamed({"ws": "left", "f": "l"}), "left")
            .join(counts.withColumnsRenamed({"ws": "right", "f": "r"}), "right"))
    of = words.select(F.col("w").alias("w1"), "lang").join(state.select("lang", "n", "high"), "lang")
    cuts = cuts.withColumn("w1", F.element_at("ws", 1)).join(of, "w1")
    exact = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * ({exact('a')} * {exact('n')})) DIV ({exact('l')} * {exact('r')})")
    return (cuts.groupBy("lang", "ws", "a", "n", "high")
            .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.count("*").alias("known"),
                 F.max(F.when(F.col("k") == 1, F.col("l"))).alias("first"),
                 F.max(F.when(F.col("k") == size - 1, F.col("r"))).alias("last"))
            .filter((F.col("known") == size - 1) & (F.greatest(_class("first", least), _class("last", least)) <= F.col("high")))
            .select("lang", "ws", "a", "cut.l", "cut.r", "n", "cut.score"))


def _class(count: str, least: int | str) -> Column:
    """Class of a count: 1 from ``least``, and one more each time it doubles."""
    return F.length(F.bin(F.expr(f"{count} DIV {least}")))


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", keep: int = KEEP,
                 least: int = LEAST, slots: int = SLOTS, bits: int = BITS) -> DataFrame:
    """The first ``keep`` phrases of each language of those that occur ``least`` times: ``lang, rank, phrase, a, l, r, n, score``.

    Defined results: a null language is ``und``, a null text empty; phrases of equal score and
    count are ranked by their bytes; rows that repeat count each time; further columns change
    nothing; languages without a phrase that occurs often enough, and an empty table, give no
    rows."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_LANG)).alias("lang"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        counted = _land(spark, _map(texts, _word_counts, "lang string, w long, f long", seed).groupBy("lang", "w")
                        .agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "words")
        words = counted.filter("w != 0").withColumn("class", _class("f", least))
        classes = _class_table(spark, words, slots)
        runs = _land(spark, _map(texts, _runs, "lang string, run array<long>, w array<long>, word array<string>", seed, classes),
                     "runs")
        found = runs.select("lang", F.explode(F.arrays_zip("w", "word")).alias("v")).select("lang", "v.w", "v.word")
        named = F.struct("lang", "word")
        vocabulary = land(spark, found.join(words.select("w").distinct(), "w", "left_semi").groupBy("w")
                          .agg(F.min(named).alias("of"), F.max(named).alias("other")), "vocabulary")
        if vocabulary.filter("of != other").isEmpty():
            break
        seed += 1  # two words shared a hash

    mass = sorted((r["class"], r["n"]) for r in words.groupBy("class").agg(F.sum("f").alias("n")).collect())
    if not mass:
        return spark.createDataFrame([], RESULT)
    upto = np.cumsum([n for _, n in mass])
    limits = [mass[int(np.searchsorted(upto, share * upto[-1]))][0] for share in SHARES]
    totals = counted.filter("w = 0").select("lang", F.col("f").alias("n"))
    state = land(spark, totals.join(words.groupBy("lang").agg(F.max("class").alias("top")), "lang")
                 .select("lang", "n", "top", F.lit(0).alias("low"), F.least(F.lit(limits[0]), "top").alias("high"),
                         F.lit(True).alias("open")), "state")
    parts: dict[int, list[DataFrame]] = {size: [] for size in range(2, WORDS + 1)}
    order = [F.desc("score"), F.desc("a")]
    for wave in range(1, 65):
        todo = runs.join(state.filter("open").select("lang", "low", "high"), "lang").select("low", "high", "run")
        for size in parts:
            grown = _bit_table(spark, _union(parts[size - 1]), size - 1, bits) if size > 2 else None
            names = [f"w{k}" for k in range(1, size + 1)]
            ddl = ", ".join(f"{w} long" for w in [*names, "a"])
            counts = _map(todo, _grow, ddl, size, classes, grown).groupBy(*names).agg(F.sum("a").alias("a"))
            parts[size].append(_land(spark, counts.filter(F.col("a") >= least).select(F.array(*names).alias("ws"), "a"),
                                     f"phrases{size}"))
        alive = land(spark, _survivors(_union([p for found in parts.values() for p in found]), words, state, least), "survivors")
        last = _best(alive, [*order, "ws"], keep).filter(F.col("place") == keep).select("lang", F.col("score").alias("last"))
        bound = F.expr(f"(1000 * CAST(n AS DECIMAL(19, 0))) DIV (CAST({least} AS DECIMAL(19, 0)) * SHIFTLEFT(1L, high))")
        beyond = F.when(F.col("last") > 0, _class("(1000 * CAST(n AS DECIMAL(19, 0))) DIV last", least))
        more = F.when(F.col("last").isNull(), F.greatest(F.lit(limits[min(wave, len(limits) - 1)]), F.col("high") + 1))
        more = F.least(F.coalesce(more, beyond, F.col("top")), "top")
        unsettled = F.col("open") & (F.col("high") < F.col("top")) & (F.col("last").isNull() | (F.col("last") <= bound))
        state = land(spark, state.join(last, "lang", "left").select(
            "lang", "n", "top", F.col("high").alias("low"), F.when(unsettled, more).otherwise(F.col("high")).cast("int").alias("high"),
            unsettled.alias("open"), "last"), "state")
        if state.filter("open").isEmpty():
            break
        state = state.drop("last")

    first = alive.join(state.select("lang", "last"), "lang").filter(F.col("last").isNull() | (F.col("score") >= F.col("last")))
    spelt = (first.select("*", F.posexplode("ws").alias("at", "w")).join(vocabulary.select("w", "of.word"), "w")
             .groupBy("lang", "ws", "a", "l", "r", "n", "score")
             .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
             .withColumn("phrase", F.array_join(F.col("spelt.word"), " ")))
    return _best(spelt, [*order, "phrase"], keep, "rank").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: The same in DuckDB: every phrase is counted, none is bounded.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, p.i, regexp_extract_all(p.s, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, row_number() OVER () AS doc_id,
               regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS s, unnest(range(len(parts))) AS i) p),
totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, list_slice(ws, i, i + k - 1) AS g, k
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
counts AS (SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
longer AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, list_slice(g, 1, k - 1) AS g, f FROM counts WHERE k > 2
    UNION ALL SELECT lang, list_slice(g, 2, k) AS g, f FROM counts WHERE k > 2) GROUP BY ALL),
candidates AS (
  SELECT c.lang, c.g, c.k, c.f FROM counts c LEFT JOIN longer x ON x.lang = c.lang AND x.g = c.g
  WHERE c.k > 1 AND (x.f IS NULL OR 100 * x.f < 100 * c.f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, j, x.f AS l, y.f AS r, t.n,
         (1000 * c.f::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, j)
  JOIN counts y ON y.lang = c.lang AND y.g = list_slice(c.g, j + 1, c.k)),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
         array_to_string(g, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM scored)
SELECT * FROM ranked WHERE rank <= 2000
"""
