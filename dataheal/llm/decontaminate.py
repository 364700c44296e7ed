"""Benchmark decontamination with spaced seeds, with DataFrame operations only.

A seed is a mask over neighbouring words that ignores some places, so a copy with a word
exchanged there still has the same hash. The hashes of all documents are joined to those of the
benchmark; a hit aligns a document with an item, and the aligned words around it are compared: an
overlap holds if ``window`` aligned words in a row, or all words of a shorter item, agree in the share
``least`` at least (above 0).

No overlap is without a hit: the masks of a width hold, wherever its differing words stand, at some
place of agreeing words only (``masks``). Each item is seeded with the masks of its own width, and the
documents with those of the widths that the benchmark has.

The benchmark is broadcast only if its seeds are few (``BROADCAST_SEEDS``), else both sides are
shuffled. Only documents with a hit are read again for the comparison.

Items are told apart by a hash of their words, so an item without an id, or one of several with the same id, is
compared like any other.

Defined results: null and empty texts and items match nothing; repeated rows and equal items are
reported once each; a null id is returned; items of one id are one item, of which the best overlap counts;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.llm import common, native
from dataheal.session import materialise

#: Masks by width and agreeing words: each way of so many words to agree holds one of them at some place.
#: Places of a mask that count: 1; that may differ: 0.
COVERS = {
    (4, 3): ("111", "1011", "1101"),
    (5, 4): ("1111", "11101", "11011", "10111"),
    (6, 5): ("11011", "101101"),
    (7, 6): ("1011101", "111101", "110111"),
    (8, 6): ("100111", "11101", "11000011"),
    (9, 7): ("101111", "1110011", "11001011", "11010101"),
    (10, 8): ("111011", "11010011", "1110000011"),
    (11, 9): ("110111", "1110001001"),
    (12, 9): ("111011", "110100011", "1000010111", "10110000101"),
    (13, 10): ("110111", "1101000011", "11000100101"),
}
WINDOW, LEAST = 13, 0.75
BROADCAST_SEEDS = 1_000_000


def masks(width: int, least: float = LEAST) -> tuple[str, ...]:
    """Masks that every overlap of ``width`` words hits: searched ones, else the run that no spread of differing words avoids."""
    agree = max(1, math.ceil(width * least))
    return COVERS.get((width, agree), ("1" * math.ceil(agree / (width - agree + 1)),))


def seeds(split: DataFrame, of: list[str], *keep: str) -> DataFrame:
    """(keep..., mask, pos, hash) for every mask of ``of`` at every place of ``words``."""
    places = [[i for i, c in enumerate(m) if c == "1"] for m in of]
    each = [F.coalesce(native.grams("words", p), F.array().cast("array<bigint>")) for p in places]
    rows = split.select(*keep, F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), e.alias("hashes")) for i, e in enumerate(each)])).alias("m"))
    return rows.select(*keep, F.col("m.mask").alias("mask"), F.posexplode("m.hashes").alias("pos", "hash"))


def compare(doc: str, item: str, diagonal: str, window: int, least: float) -> Column:
    """Best window of aligned words: (agreeing words, item place of its start); the earliest if equal."""
    at = lambda i: F.col(diagonal) + i
    agree = F.transform(
        F.sequence(F.lit(0), F.size(item) - 1),
        lambda i: F.when((at(i) >= 0) & (at(i) < F.size(doc)), (F.get(F.col(doc), at(i)) == F.get(F.col(item), i)).cast("int")).otherwise(0))
    width = F.least(F.lit(window), F.size(item))
    sums = F.transform(
        F.sequence(F.lit(0), F.size(item) - width),
        lambda s: F.struct(F.aggregate(F.slice(agree, s + 1, width), F.lit(0), lambda a, x: a + x).alias("agree"), (-s).alias("from")))
    return F.array_max(sums)


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text", window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(doc_id, key, item_id, first_word, agree, width, share): the best overlap of each document and item.

    ``key`` is the hash of the document's text; ``first_word`` is where the best window starts in it.
    """
    docs = native.keyed(docs, doc_id, text)
    named = items.select(F.col(item_id).alias("item_id"), native.words(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0)
    named = named.withColumn("item", F.xxhash64("item_words"))
    bench = named.select("item", "item_words").dropDuplicates(["item"])
    sized = bench.select("item", F.col("item_words").alias("words"), F.least(F.lit(window), F.size("item_words")).alias("width"))
    by_width = {r["width"]: masks(r["width"], least) for r in sized.select("width").distinct().collect()}
    used = sorted({m for ms in by_width.values() for m in ms})
    if not used:
        used, by_width = ["1"], {1: ("1",)}
    own = reduce(Column.__or__, [(F.col("width") == w) & F.col("mask").isin([used.index(m) for m in ms]) for w, ms in by_width.items()])
    item_seeds = seeds(sized, used, "item", "width").where(own).select("item", "mask", "hash", F.col("pos").alias("item_pos")).distinct()
    few = item_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    split = docs.select("doc_id", "key", native.words(F.col("text")).alias("words"))
    hits = seeds(split, used, "doc_id", "key").join(F.broadcast(item_seeds) if few else item_seeds, ["hash", "mask"])
    # written once: the long text scan must not run again for the comparison
    aligned = materialise(hits.groupBy("doc_id", "key", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("hits")))
    keys = aligned.select("key").distinct()
    hit_docs = common.among(docs, keys, "key").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", native.words(F.col("text")).alias("words"))
    pairs = aligned.join(hit_docs, native.same(aligned, hit_docs, "doc_id", "key")).select(
        aligned["doc_id"], aligned["key"], "item", "diagonal", "words")
    both = pairs.join(F.broadcast(bench) if few else bench, "item")
    scored = both.select(
        "doc_id", "key", "item", "diagonal", F.least(F.lit(window), F.size("item_words")).alias("width"),
        compare("words", "item_words", "diagonal", window, least).alias("best"))
    ok = scored.where(F.col("best.agree") >= F.ceil(F.col("width") * least))
    first = F.greatest(F.lit(0), F.col("diagonal") - F.col("best.from"))
    found = ok.select("doc_id", "key", "item", "width", F.col("best.agree").alias("agree"), first.alias("first"))
    ids = named.select("item", "item_id").distinct()
    best = found.join(F.broadcast(ids) if few else ids, "item").groupBy("doc_id", "key", "item_id").agg(
        F.max_by(F.struct("width", "agree", "first"), F.struct(F.col("agree") / F.col("width"), -F.col("first"))).alias("b"))
    return best.select(
        "doc_id", "key", "item_id", F.col("b.first").cast("long").alias("first_word"), F.col("b.agree").cast("long").alias("agree"),
        F.col("b.width").cast("long").alias("width"), (F.col("b.agree") / F.col("b.width")).alias("share"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without an overlap with ``items``, all columns as they are."""
    found = materialise(overlaps(docs, items, doc_id, text).select("doc_id", "key").distinct())
    return common.without(docs, found, native.holds(docs, found, doc_id, text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return overlaps(docs, items).drop("key")


def sql() -> str:
    """The rule itself, without seeds: words that agree are counted for every alignment of a document and an item."""
    return f"""
    WITH d AS (SELECT DISTINCT doc_id, {native.words_sql('text')} AS w FROM documents),
    dr AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM d),
    b AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, iw, least({WINDOW}, len(iw)) AS width
          FROM (SELECT DISTINCT item_id, {native.words_sql('text')} AS iw FROM benchmark) WHERE len(iw) > 0),
    dw AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS pos FROM dr),
    bw AS (SELECT i, width, unnest(iw) AS w, unnest(range(len(iw))) AS pos FROM b),
    a AS (SELECT r, i, dw.pos - bw.pos AS dg FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= ceil(any_value(width) * {LEAST})),
    x AS (SELECT r, doc_id, item_id, i, dg, width, len(iw) AS m,
                 list_transform(range(len(iw)), lambda i: CASE WHEN dg + i >= 0 AND dg + i < len(w) AND w[dg + i + 1] = iw[i + 1] THEN 1 ELSE 0 END) AS ag
          FROM a JOIN dr USING (r) JOIN b USING (i)),
    y AS (SELECT r, doc_id, item_id, i, dg, width, s, list_sum(ag[s + 1 : s + width]) AS agree
          FROM (SELECT *, unnest(range(m - width + 1)) AS s FROM x)),
    z AS (SELECT *, row_number() OVER (PARTITION BY r, i, dg ORDER BY agree DESC, s) AS k FROM y),
    o AS (SELECT r, doc_id, item_id, greatest(0, dg + s) AS first_word, agree, width, agree / width AS share FROM z
          WHERE k = 1 AND agree >= ceil(width * {LEAST})),
    p AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY share DESC, first_word) AS k FROM o)
    SELECT doc_id, item_id, CAST(first_word AS BIGINT) AS first_word, CAST(agree AS BIGINT) AS agree, CAST(width AS BIGINT) AS width, share::DOUBLE AS share FROM p WHERE k = 1"""
