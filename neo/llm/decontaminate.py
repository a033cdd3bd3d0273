"""Benchmark decontamination by a prefix-filtered set join (native DataFrame operations only).

An item is cut into windows of ``window`` consecutive words (a shorter item is one
window).  A document holds a window only if it holds every shingle of the window, so
one shingle is a sufficient prefix for exact containment: the rarest of the window.

1. How often each shingle of the benchmark stands in the documents is counted with map-side
   combine; only counts leave the scan.  They order the shingles by rarity.  Each window keeps
   its rarest shingle as its prefix; a window with a shingle that never occurs is dropped.
2. Shingles of the documents are joined with the prefixes only.  The place of a prefix fixes
   where its window must start; the start must not lie before the first word and the window
   must end within the document.  What passes is a place: document, start, length.
3. The texts of documents with such places are read again, the words at each place are cut out
   and compared with the windows, word by word: this is exact containment.

Shingles meet by a 64-bit hash, which only ever proposes places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo.llm.common import land, row_keys, words_of

WINDOW = 13
SHINGLE = 3

#: A side is broadcast only if its rows were summed to at most so many bytes; else both sides
#: are shuffled and skewed keys are split by AQE.
BROADCAST_BYTES = 64 << 20

#: Bytes of a row of a broadcast table besides its texts.
ROW_BYTES = 64

#: What separates words when A-Z are not lower-cased.
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _checked(side: DataFrame, texts: Column | None = None) -> DataFrame:
    """The side, to be broadcast if it is small; ``texts`` are the bytes of its texts in a row."""
    row = F.lit(ROW_BYTES) if texts is None else F.lit(ROW_BYTES) + texts
    return F.broadcast(side) if (side.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES else side


def _parts(words: Column, size: int) -> Column:
    """Array of structs of ``size`` consecutive words, in order of their position."""
    n = F.size(words) - (size - 1)
    shifted = [F.slice(words, 1 + i, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(size)]
    return F.arrays_zip(*shifted)


def _hash(part: str, size: int) -> Column:
    return F.xxhash64(*[F.col(f"{part}.w{i}") for i in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """Distinct windows: ``window`` (words joined by blanks), ``len``, ``items`` (their ids as text)."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    words = words.filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    return (words.select("item", "words", length.alias("len"), starts.alias("at"))
            .select("item", "len", F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("window"))
            .groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items")))


def prefixes(keyed: DataFrame, grams: DataFrame) -> DataFrame:
    """``key, at, len``: hash and place of the rarest shingle of every window whose shingles all occur."""
    rarity = grams.join(_checked(keyed.select("key").distinct()), "key").groupBy("key").count()
    seen = F.coalesce("count", F.lit(0))
    rarest = F.min(F.struct(seen.alias("seen"), "key", "at"))
    return (keyed.join(rarity, "key", "left").groupBy("window", "len").agg(rarest.alias("r"))
            .filter(F.col("r.seen") > 0).select("r.key", "r.at", "len").distinct())


def _cut(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``row1, row2, start, len, window``: the words of the documents at their places.  Only texts
    of documents with places are shuffled, as long as the keys of those can be broadcast; rows
    that repeat id and text are one."""
    keys = ["row1", "row2"]
    own = (texts.join(_checked(places.select(*keys)), keys, "left_semi").dropDuplicates(keys).join(places, keys)
           .select(*keys, "places", words_of(F.col("text")).alias("words")))
    cut = F.transform("places", lambda p: F.struct(
        p["start"].alias("start"), p["len"].alias("len"),
        F.array_join(F.slice("words", p["start"] + 1, p["len"]), " ").alias("window")))
    return own.select(*keys, F.explode(cut).alias("p")).select(*keys, "p.*")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items,
    row1, row2``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the items
    with an occurring window, sorted as text; a document is contaminated when at least a
    twentieth of its words is hit.

    Defined results: null and empty texts have no words and no hits; a null item id is the
    empty text; repeated rows are each returned with the same result; empty documents give
    an empty result and an empty benchmark hits nothing; further columns are ignored.
    """
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"),
                         F.col(item_text_col).alias("text"))
    windows = land(spark, item_windows(bench, window), "windows")
    parts = windows.select("window", "len", F.split("window", " ").alias("words"))
    sizes = [r[0] for r in parts.select(F.least("len", F.lit(shingle)).alias("k")).distinct().collect()]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    row = row_keys(F.col("doc_id"), F.col("text"))
    rows = texts.select("doc_id", *row, F.size(F.array_remove(F.split("text", ANY_CASE), "")).cast("long")
                        .alias("n_words"))
    words = texts.select(*row, words_of(F.col("text")).alias("words"))

    places = None
    for size in sorted(sizes):  # one size, unless an item has fewer words than a shingle
        own = parts.filter(F.least("len", F.lit(shingle)) == size)
        keyed = land(spark, own.select("window", "len", F.posexplode(_parts(F.col("words"), size)).alias("at", "p"))
                     .select("window", "len", "at", _hash("p", size).alias("key")), "shingles")
        grams = (words.filter(F.size("words") >= size)
                 .select("row1", "row2", F.size("words").alias("n_words"),
                         F.posexplode(_parts(F.col("words"), size)).alias("pos", "p"))
                 .select("row1", "row2", "n_words", "pos", _hash("p", size).alias("key")))
        prefix = land(spark, prefixes(keyed, grams), "prefixes")
        start = F.col("pos") - F.col("at")
        near = (grams.join(_checked(prefix), "key")
                .filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
                .select("row1", "row2", F.struct(start.alias("start"), "len").alias("place")))
        places = near if places is None else places.unionByName(near)
    found = None if places is None else _cut(
        texts.select(*row, "text"),
        land(spark, places.groupBy("row1", "row2").agg(F.collect_set("place").alias("places")), "places"))

    nothing = F.expr("array()").cast("array<string>")
    if found is None:
        result = rows.select("doc_id", "row1", "row2", "n_words", F.lit(0).cast("long").alias("n_hit"), nothing.alias("items"))
    else:
        held = F.octet_length("window") + F.octet_length(F.array_join("items", ","))
        cases = (found.join(_checked(windows, held), ["window", "len"]).groupBy("row1", "row2")
                 .agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("places"),
                      F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
        end = (lambda c: c["start"] + c["len"])
        zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
        covered = F.aggregate("places", zero, lambda a, c: F.struct(
            (a["hit"] + F.greatest(F.lit(0), end(c) - F.greatest(c["start"], a["end"]))).alias("hit"),
            F.greatest(a["end"], end(c)).alias("end")))
        cases = cases.select("row1", "row2", covered["hit"].cast("long").alias("n_hit"), "items")
        result = rows.join(cases, ["row1", "row2"], "left").select(
            "doc_id", "row1", "row2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", nothing).alias("items"))
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "row1", "row2")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (n, x)),
c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
