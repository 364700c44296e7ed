"""Quality rules as weak supervision.

Rules vote good (1), bad (-1) or abstain (0) on each document. Expectation-maximisation
estimates from the counts of vote patterns over the whole corpus how often each rule is right,
and a document's posterior probability of being good replaces "every rule must pass".

The patterns are at most 3 to the number of rules, so their counts are a small table whatever
the corpus; documents are only ever read, never shuffled.

Defined results: a null or empty text has no words, fails the base rules and is not kept; an
empty table gives no rows; repeated rows are judged alike; other columns of the input are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.llm import common
from dataheal.session import materialise

SYMBOLS = "#*$%&|<>"
STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_closed_lines long, n_letters long, n_upper long, n_letter_words long, n_top_word long, n_marks long"
)
#: P(-1), P(0) and P(1) of a good and of a bad document, from which estimation starts: rules name
#: faults, so a vote against a document says more than one for it.
FIRST_GOOD, FIRST_BAD = (0.02, 0.28, 0.7), (0.3, 0.3, 0.4)
ROUNDS = 100


def repeat_words(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    grams = common.window_hashes(words, width)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for k in range(width):
        cover[k : k + len(grams)] |= twice
    return int(cover.sum())


def measure(text: str, data: bytes) -> tuple[int, ...]:
    words = data.split()
    n = len(words)
    hashes = common.word_hashes(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ascii_letters = data.translate(None, NOT_LETTERS)
    top = int(np.unique(hashes, return_counts=True)[1].max()) if n else 0
    return (
        n,
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(hashes),
        len(lines),
        sum(x.rstrip().endswith(CLOSERS) for x in lines),
        len(ascii_letters),
        len(ascii_letters) - len(ascii_letters.translate(None, UPPER)),
        sum(map(WORDY, words)),
        top,
        len(data) - len(data.translate(None, MARKS)),
    )


UPPER = bytes(range(65, 91))
NOT_LETTERS = bytes(c for c in range(256) if not chr(c).isalpha() or c > 127)
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CLOSERS = (b".", b"!", b"?", b'"', b":", b";", "…".encode(), "”".encode(), "»".encode(), "。".encode())


def WORDY(word: bytes) -> bool:
    """Whether a word starts with a letter of any script, after quotes and brackets."""
    return word.lstrip(b"\"'([{")[:1].isalpha() or word[:1] >= b"\xc3"


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts per document, over its whole text."""

    def make(part: pa.RecordBatch) -> dict:
        rows = [measure(t, d) for t, d in zip(common.texts(part.column("text")), common.utf8(part.column("text")))]
        cols = list(zip(*rows))
        names = [x.split()[0] for x in STATS.split(", ")]
        return {"doc_id": part.column("doc_id")} | dict(zip(names, cols))

    return common.map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), f"doc_id long, {STATS}", "text", make)


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes of every rule on a row of ``statistics``; each may abstain."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    share = lambda a, b: F.col(a) / b
    return {
        "length": vote(F.col("n_words") >= 100, F.col("n_words") < 50),
        "word_length": vote(share("word_chars", words).between(3.0, 9.0), ~share("word_chars", words).between(2.0, 14.0)),
        "symbols": vote(share("n_symbols", words) < 0.02, share("n_symbols", words) > 0.1),
        "dup_lines": vote(share("n_dup_lines", lines) < 0.1, share("n_dup_lines", lines) > 0.3),
        "repeats": vote(share("n_repeat_words", words) < 0.2, share("n_repeat_words", words) > 0.4),
        "capitals": vote(share("n_upper", F.greatest("n_letters", F.lit(1))) < 0.2, share("n_upper", F.greatest("n_letters", F.lit(1))) > 0.5),
        "closed_lines": vote(share("n_closed_lines", lines) >= 0.6, share("n_closed_lines", lines) < 0.2),
        "letter_words": vote(share("n_letter_words", words) > 0.8, share("n_letter_words", words) < 0.6),
        "marks": vote(share("n_marks", words) < 0.5, share("n_marks", words) > 0.8),
        "top_word": vote(share("n_top_word", words) < 0.15, share("n_top_word", words) > 0.3),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, P(vote | good) and P(vote | bad) as [rule, vote + 1], by EM over vote patterns.

    Starts from ``FIRST_GOOD`` and ``FIRST_BAD``; counts are smoothed by one row, so
    no probability is 0. Without rows the start values stay.
    """
    n_rules = patterns.shape[1]
    good, bad = np.tile(FIRST_GOOD, (n_rules, 1)), np.tile(FIRST_BAD, (n_rules, 1))
    prior = 0.5
    hot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(ROUNDS if len(counts) else 0):
        p = posterior(patterns, prior, good, bad)
        before = prior
        w1, w0 = counts * p, counts * (1 - p)
        prior = (w1.sum() + 1) / (counts.sum() + 2)
        good = (np.einsum("n,nrv->rv", w1, hot) + 1 / 3) / (w1.sum() + 1)
        bad = (np.einsum("n,nrv->rv", w0, hot) + 1 / 3) / (w0.sum() + 1)
        if abs(prior - before) < 1e-9:
            break
    return prior, good, bad


def posterior(patterns: np.ndarray, prior: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """P(good | votes); an abstention says nothing, so it adds no evidence."""
    rule = np.arange(patterns.shape[1])
    given = lambda t: np.where(patterns == 0, 0.0, np.log(t[rule, patterns + 1])).sum(1)
    a, b = np.log(prior) + given(good), np.log(1 - prior) + given(bad)
    return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes and ``score`` (posterior of good) of every document; ``kept`` by score and base rules."""
    votes = rules()
    names = list(votes)
    measured = materialise(statistics(docs, doc_id, text).withColumns({f"vote_{k}": v for k, v in votes.items()}))
    cols = [f"vote_{k}" for k in names]
    seen = measured.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).collect()
    patterns = np.array([[r[c] for c in cols] for r in seen], int).reshape(len(seen), len(cols))
    prior, good, bad = estimate(patterns, np.array([r["rows"] for r in seen], float))
    evidence = F.lit(float(np.log(prior) - np.log(1 - prior)))
    for i, c in enumerate(cols):
        weight = np.log(good[i]) - np.log(bad[i])
        evidence = evidence + F.when(F.col(c) == 1, float(weight[2])).when(F.col(c) == -1, float(weight[0])).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("score", 1 / (1 + F.exp(-evidence))).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
