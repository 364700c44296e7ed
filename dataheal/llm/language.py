"""Language identification with n-gram filters that hold a bitmask of languages.

Each slot of a Bloom filter is a bitmask with one bit per language, so one lookup of an n-gram
(the AND of its slots) returns every language that contains it. A document's n-grams are counted
per language, the counts corrected by each language's false-positive rate, and the largest wins.

Learning counts the n-grams of a bounded sample of labelled rows (``sample_rows`` per language,
drawn by a hash of the id). A language keeps the n-grams that make up ``min_share`` of its own,
at most 1 / ``min_share`` of them by construction, unless another language has them
``foreign`` times as often. Only these reach the driver; documents are read in place and never
shuffled.

Defined results: null text and texts without a letter are ``und`` with score 0; a text with
letters but no known n-gram gets the most common learned language with score 0; without any
labelled row all are ``und``; a null id is not held out and never learned from; repeated rows
are each predicted; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.llm import common

ORDERS = (3, 5)
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LETTER = regex.compile(r"\p{L}")
#: Everything in ASCII that is no letter becomes white space.
TO_SPACE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
UNKNOWN = "und"
#: Half the width of a text's interval, in standard deviations.
DEVIATIONS = 3.0


def grams(text: str) -> np.ndarray:
    """Every byte n-gram of the lower-cased words with one space around each, packed into 64 bits."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(TO_SPACE).split()) + b" ", np.uint8)
    wide, out = data.astype(np.uint64), []
    for n in ORDERS:
        count = len(wide) - n + 1
        if count <= 0:
            continue
        packed = wide[:count].copy()
        for k in range(1, n):
            packed <<= np.uint64(8)
            packed |= wide[k : k + count]
        packed |= np.uint64(n << 56)
        out.append(packed)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


@dataclass
class Filters:
    """``slots[w]`` holds the bits of languages 64 w to 64 w + 63; ``wrong`` is the rate of false positives by language."""

    languages: list[str]
    slots: list[np.ndarray]
    wrong: np.ndarray

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray]) -> Filters:
        """Languages in the given order, which decides ties."""
        most = max([1, *map(len, profiles.values())])
        size = 1 << int(np.ceil(np.log2(8 * most)))
        kind = np.uint8 if len(profiles) <= 8 else np.uint64
        slots = [np.zeros(size, kind) for _ in range(0, max(1, len(profiles)), 64)]
        wrong = np.zeros(len(profiles))
        for i, found in enumerate(profiles.values()):
            table, bit = slots[i // 64], kind(1 << (i % 64))
            for h in HASHES:
                table[slot(found, h, size)] |= bit
            wrong[i] = ((table & bit) != 0).mean() ** len(HASHES)
        return cls(list(profiles), slots, wrong)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, less the expected false positives."""
        out = np.zeros(len(self.languages))
        for w, table in enumerate(self.slots):
            mask = table[slot(found, HASHES[0], len(table))]
            for h in HASHES[1:]:
                mask &= table[slot(found, h, len(table))]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[i] = np.count_nonzero(mask & table.dtype.type(1 << (i - 64 * w)))
        return np.maximum(0, (out - len(found) * self.wrong) / (1 - self.wrong))

    def predict(self, text: str) -> tuple[str, float, float, int]:
        """Language, its share of all languages' counts, the share of n-grams that it contains, and their number."""
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, 0
        found = grams(text)
        n = self.counts(found)
        best = int(n.argmax())
        return self.languages[best], float(n[best] / n.sum()) if n.sum() else 0.0, float(n[best] / max(1, len(found))), len(found)


def slot(found: np.ndarray, seed: int, size: int) -> np.ndarray:
    return ((found * np.uint64(seed)) >> np.uint64(65 - size.bit_length())).view(np.int64) if size > 1 else np.zeros(len(found), np.int64)


def learn(labelled: DataFrame, sample_rows: int = 1000, min_share: float = 2e-5, foreign: float = 8.0) -> Filters:
    """Filters from ``labelled`` (id, text, lang); see the module for the parameters."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = sorted(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (-r["n"], r["lang"]))
    names = [r["lang"] for r in sizes]
    if not names:
        return Filters.build({})
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], sample_rows / r["n"]).otherwise(share)
    code = {name: i for i, name in enumerate(names)}

    def make(part: pa.RecordBatch) -> dict:
        held: dict[int, list[np.ndarray]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            held.setdefault(code[lang], []).append(grams(text))
        out = [(i, *np.unique(np.concatenate(x), return_counts=True)) for i, x in held.items()]
        return {
            "language": np.concatenate([np.full(len(g), i, np.int32) for i, g, _ in out]),
            "gram": np.concatenate([g for _, g, _ in out]).view(np.int64),
            "n": np.concatenate([n for *_, n in out]).astype(np.int64),
        }

    counted = common.map_rows(labelled.where(draw < share).select("lang", "text"), "language int, gram long, n long", "text", make)
    by_gram = counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = {r["language"]: r["n"] for r in by_gram.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    rate: Column = F.lit(0.0)
    for i, total in totals.items():
        rate = F.when(F.col("language") == i, F.col("n") / float(total)).otherwise(rate)
    kept = by_gram.withColumn("rate", rate).where(F.col("rate") >= min_share).select("language", "gram", "rate").toPandas()
    top = kept.groupby("gram")["rate"].transform("max")
    kept = kept[kept["rate"] * foreign >= top]
    return Filters.build({name: np.sort(kept.loc[kept["language"] == i, "gram"].to_numpy()).view(np.uint64) for name, i in code.items()})


def identify(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, known): ``known`` is the share of n-grams in the predicted language."""
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.wrong))

    def make(part: pa.RecordBatch) -> dict:
        model = Filters(*sent.value)
        rows = [model.predict(t) for t in common.texts(part.column("text"))]
        lang, score, known, _ = zip(*rows)
        return {"doc_id": part.column("doc_id"), "lang_pred": lang, "score": score, "known": known}

    return common.map_rows(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
        "doc_id long, lang_pred string, score double, known double", "text", make)


def upper(share: float, n: int) -> float:
    """Upper bound of a text's share from ``n`` n-grams (Wilson's interval); a byte lies in ``sum(ORDERS)`` of them, which are no evidence of their own."""
    m = n / sum(ORDERS)
    return (share + DEVIATIONS**2 / (2 * m) + DEVIATIONS * np.sqrt(share * (1 - share) / m + DEVIATIONS**2 / (4 * m * m))) / (1 + DEVIATIONS**2 / m)


def thresholds(labelled: DataFrame, sample_rows: int = 1000, quantile: float = 0.001, telling: int = 800, prior: int = 10) -> dict[str, float]:
    """By language, the share of known n-grams that all but ``quantile`` of the labelled documents (id, text, lang) reach.

    Half of the documents are scored by filters learned from the other half; those with ``telling`` n-grams
    or more count. Of few documents the lowest says little about the quantile: ``n`` of them give
    n / (n + ``prior``) of it. Languages without such a document are left out.
    """
    labelled = labelled.where("text is not null and lang is not null and id is not null")
    held = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(2)) == 0
    filters = learn(labelled.where(~held), sample_rows)
    sent = labelled.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.wrong))

    def make(part: pa.RecordBatch) -> dict:
        model = Filters(*sent.value)
        lang, _, known, n = zip(*[model.predict(t) for t in common.texts(part.column("text"))])
        return {"lang": lang, "known": known, "n": n}

    scored = common.map_rows(labelled.where(held).select("text"), "lang string, known double, n long", "text", make)
    rows = scored.where(F.col("n") >= telling).groupBy("lang").agg(
        F.percentile_approx("known", quantile, 100_000).alias("share"), F.count(F.lit(1)).alias("n")).collect()
    return {r["lang"]: r["share"] * r["n"] / (r["n"] + prior) for r in rows}


def keep(docs: DataFrame, filters: Filters, text: str = "text", least: float = 0.05, by_language: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, all columns as they are.

    Left out are texts without a letter, and texts whose share of n-grams in the best language is, by the
    ``upper`` bound of its interval, below that language's of ``by_language`` (see ``thresholds``; ``least``
    if it has none).
    """
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots, filters.wrong))
    bounds = by_language or {}
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def known(column):
        model = Filters(*sent.value)

        def one(t):
            lang, _, share, n = model.predict(t or "")
            return lang != UNKNOWN and (not n or bool(upper(share, n) >= bounds.get(lang, least)))

        return column.map(one)

    return docs.where(known(docs[text]))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    filters = learn(docs.where(remainder() != 1).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, filters).select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "known")
