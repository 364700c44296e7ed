"""Importance resampling towards a target distribution of hashed word n-grams.

Words come from the tokenizers library's pre-tokenisation: an untrained regular-expression ``Split`` over
the text in ASCII lower case, which returns words with offsets. It runs over the text's bytes, one
character each, so offsets are byte offsets. A window of neighbouring offset pairs is a feature: its words
joined by one space, hashed by CRC-32, which is carried from a word over the space to the next word.

Documents are read and cut once. Each task writes its documents' buckets, two bytes a feature, and one
histogram of at most ``BUCKETS`` rows; Spark adds the histograms up. Gains by bucket are the only thing that
reaches the driver and goes back to the tasks, which sum them over the written buckets.

The draw takes the highest scores without sorting all documents: scores are whole numbers of a
bounded range, so their counts fix every score's first rank and where the draw ends. Rows of a drawn
score are ranked by id; noise by id spreads documents over scores, copies of one text too.

Defined results: null and empty texts have no feature and weight 0; repeated rows are each scored, and
ranked by their number of features after their id; a null id is hashed as an empty one and comes last
among ties; an empty table gives no rows; without target texts T and t are 0; other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from zlib import crc32

from dataheal.llm import common
from dataheal.session import local_frame, remove_table, write_once

WIDTH, BUCKETS, SCALE, SEED, LEAST, PERCENT = 2, 10_000, 1000, 7, 20, 25
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 18
WORD, BREAK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def stretches(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``STRETCH`` bytes that end between words."""
    at = 0
    while len(data) - at > STRETCH and (edge := BREAK.search(data, at + STRETCH)):
        yield data[at : edge.start()]
        at = edge.start()
    yield data[at:]


def splitter():
    """The untrained pre-tokenizer: words and their offsets."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str


def feature_hashes(text: bytes, split, width: int) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of all runs of 1 to ``width`` words."""
    n, found, carried = 0, [], []
    for data in stretches(text.lower()):
        words = [data[a:b] for _, (a, b) in split(data.decode("latin-1"))]
        n += len(words)
        line, own = carried + words, len(carried)
        runs = list(map(crc32, line))
        for k in range(width):
            # runs[i] ends with word i + k; those that end before this stretch's words are counted already
            found.append(np.fromiter(runs[max(0, own - k) :], np.uint32, max(0, len(runs) - max(0, own - k))))
            if k + 1 < width:
                runs = list(map(crc32, line[k + 1 :], [crc32(b" ", r) for r in runs]))
        carried = line[len(line) - (width - 1) :] if width > 1 and len(line) >= width - 1 else line if width > 1 else []
    return n, np.concatenate(found)


def bucketed(docs: DataFrame, doc_id: str, text: str, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features) of every document, and (bucket, n) rows that sum to the histogram of all features."""
    schema = T.StructType.fromDDL("doc_id long, n_words long, features binary, bucket int, n long")
    arrow = common.to_arrow_schema(schema)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def batch(rows: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(), np.zeros(buckets, np.int64)
        for b in common.chunks(batches, "text"):
            words, features = [], []
            for data in common.utf8(b.column("text")):
                n, hashes = feature_hashes(data, split, width)
                of = (hashes % np.uint32(buckets)).astype(kind)
                counts += np.bincount(of, minlength=buckets)
                words.append(n)
                features.append(of.tobytes())
            yield batch(b.num_rows, doc_id=b.column("doc_id"), n_words=words, features=features)
        filled = np.flatnonzero(counts)
        yield batch(len(filled), bucket=filled.astype(np.int32), n=counts[filled])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket, from the (bucket, n) rows of :func:`bucketed`."""
    out = np.zeros(buckets, np.int64)
    for r in rows.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """By bucket: floor of the scaled log ratio of smoothed frequencies, target over source."""
    total, aimed, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: float(t + 1) * float(total + buckets) / (float(s + 1) * float(aimed + buckets))
    return np.array([math.floor(scale * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) from the documents of :func:`bucketed`."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_features long, weight long")
    arrow = common.to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gain[np.frombuffer(x, kind)] for x in b.column("features").to_pylist()]
            sizes = [len(g) for g in found]
            weights = [int(g.sum()) // n if n else 0 for g, n in zip(found, sizes)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], schema=arrow)

    return rows.where("bucket is null").select("doc_id", "n_words", "features").mapInArrow(run, schema)


def drawn(scored: DataFrame, least: int, percent: int) -> DataFrame:
    """``scored`` with ``rank`` (1, 2, ...) of the ``percent`` highest scores among documents of ``least`` words; ``scored`` is written already."""
    counts = scored.where(F.col("n_words") >= least).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()
    most = percent * sum(r["n"] for r in counts) // 100
    starts = [0, *accumulate(r["n"] for r in counts)]
    taken = [(r["score"], start) for r, start in zip(counts, starts) if start < most]
    unranked = F.lit(None).cast("long")
    if not taken:
        return scored.withColumn("rank", unranked)
    last = taken[-1][0]
    among = (F.col("n_words") >= least) & (F.col("score") >= last)
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    first = local_frame(scored.sparkSession, taken, "score long, start long")
    place = F.col("start") + F.row_number().over(Window.partitionBy("score").orderBy(*order))
    best = scored.where(among).join(F.broadcast(first), "score").withColumn("place", place.cast("long"))
    best = best.withColumn("rank", F.when(F.col("place") <= most, F.col("place"))).select(*scored.columns, "rank")
    return best.union(scored.where(~among).withColumn("rank", unranked))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", width: int = WIDTH,
    buckets: int = BUCKETS, scale: int = SCALE, seed: int = SEED, least: int = LEAST, percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    written = write_once(bucketed(docs, doc_id, text, width, buckets))
    aimed = bucketed(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", width, buckets)
    gain = gains(histogram(written, buckets), histogram(aimed, buckets), scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-float(scale)) * F.log(-F.log(uniform)))
    scored = write_once(weighed(written, gain).withColumn("score", F.col("weight") + noise))
    remove_table(written)
    return drawn(scored, least, percent).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def sql() -> str:
    """The same in DuckDB; CRC-32 byte by byte over every distinct feature."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{}', '{}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    words = words.format(string.ascii_uppercase, string.ascii_lowercase)
    shift = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    unigrams = lambda k: f"SELECT r, unnest(w) AS f FROM {k} UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM {k})"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS MATERIALIZED (SELECT row_number() OVER () AS r, {words} AS w FROM benchmark),
    df AS MATERIALIZED (SELECT r, f, count(*) AS n FROM ({unigrams("d")}) GROUP BY r, f), bf AS MATERIALIZED (SELECT f, count(*) AS n FROM ({unigrams("b")}) GROUP BY f),
    tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(k::BIGINT, range(8)), lambda c, j: {shift}) ORDER BY k) AS t FROM range(256) z(k)),
    byte AS (SELECT f, list_transform(range(0, len(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS x
          FROM (SELECT f, hex(f) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf))),
    crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1])), 4294967295) % {BUCKETS} AS k FROM byte, tab),
    s AS (SELECT k, sum(n) AS s FROM df JOIN crc USING (f) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM bf JOIN crc USING (f) GROUP BY k),
    total AS (SELECT (SELECT coalesce(sum(n), 0) FROM df)::DOUBLE AS a, (SELECT coalesce(sum(n), 0) FROM bf)::DOUBLE AS z),
    gain AS (SELECT k, floor({SCALE} * ln((coalesce(t, 0) + 1)::DOUBLE * (a + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (z + {BUCKETS}))))::BIGINT AS g FROM s FULL JOIN t USING (k), total),
    weight AS (SELECT r, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM df JOIN crc USING (f) JOIN gain USING (k) GROUP BY r),
    scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
          + floor(-{SCALE} * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weight USING (r)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY score DESC, doc_id, n_features) AS p, count(*) FILTER (n_words >= {LEAST}) OVER () AS m FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST} AND p <= {PERCENT} * m // 100 THEN p END AS rank FROM placed"""
