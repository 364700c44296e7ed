"""Column expressions that the operators without Python share, with their DuckDB counterparts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: ASCII but for letters and digits.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lower(text: Column) -> Column:
    """ASCII letters in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other Unicode characters, A-Z lower-cased."""
    return F.array_remove(F.split(lower(text), BREAKS), "")


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{BREAKS}'), lambda w: w <> '')"


def gram(array: str, at: Column, places: list[int]) -> Column:
    """Hash of the words at some places after ``at``."""
    return F.xxhash64(*[F.col(array)[at + k] for k in places])


def grams(array: str, places: list[int]) -> Column:
    """Hash of the words at ``places`` after every start that has room for them; null if none has."""
    last = F.size(array) - F.lit(places[-1] + 1)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda at: gram(array, at, places)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, text): id and a hash of the text name a row's content; repeated rows share them."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))


def holds(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> Column:
    """Whether a row of ``docs`` is one that ``found`` (doc_id, key) names."""
    return docs[doc_id].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs[text]) == found["key"])


def same(a: DataFrame, b: DataFrame, *cols: str) -> Column:
    """Equality of the columns, null equal to null."""
    out = F.lit(True)
    for c in cols:
        out = out & a[c].eqNullSafe(b[c])
    return out
