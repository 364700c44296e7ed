"""License scans by diagonal voting, with DataFrame operations only.

Every run of ``K`` words of a document is hashed and joined to the runs of the license templates.
A hit votes for a diagonal, the document position less the template position: an unchanged
copy puts all its votes on one. Neighbouring diagonals (words added or left out) are merged and the
span is verified by the share of the template's runs that it holds. Licenses differ by a word or a
number, so of verified spans that overlap only those with the most runs stay.

The templates are a fixed list, so they are broadcast; hits are aggregated as 64-bit masks of
template positions before and after the only shuffle. The documents themselves stay in place.

Defined results: null and empty texts have no words, no places, empty labels and score 0;
repeated rows are each reported; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dataheal.llm import common, native
from dataheal.session import local_frame

#: The phrases of the base rule, which must stand unchanged, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notices by which licenses are named or granted, at most ``K + 61`` words each, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license version 3", "agpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
K = 3
#: Diagonals at most so far apart belong to one span; a span with this share of a template's runs counts.
BAND, SHARE = 4, 0.75


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, runs, at, hash): the word runs of all templates."""
    rows = [(i, label, i < len(BASE), text) for i, (text, label) in enumerate((*BASE, *NOTICES))]
    assert all(len(r[3].split()) <= K + 61 for r in rows), "positions must fit into a mask"
    frame = local_frame(spark, rows, "template int, label string, base boolean, text string")
    split = frame.select("template", "label", "base", native.words(F.col("text")).alias("words"))
    hashed = split.select("template", "label", "base", native.grams("words", list(range(K))).alias("grams"))
    return hashed.select("template", "label", "base", F.size("grams").alias("runs"), F.posexplode("grams").alias("at", "hash"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, label, base, start, share) of every verified span in rows of ``native.keyed``."""
    split = docs.select("doc_id", "key", native.words(F.col("text")).alias("words"))
    runs = split.select("doc_id", "key", F.posexplode(native.grams("words", list(range(K)))).alias("pos", "hash"))
    hits = runs.join(F.broadcast(templates(docs.sparkSession)), "hash")
    place = ["doc_id", "key", "template", "label", "base", "runs"]
    votes = hits.groupBy(*place, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = W.partitionBy(*place).orderBy("diagonal")
    # a base phrase stands unchanged, so its diagonals are never merged
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > BAND)
    merged = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(along))
    found = merged.groupBy(*place, "span").agg(
        F.min("diagonal").alias("start"), F.bit_count(F.bit_or("mask")).alias("held"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"))
    good = found.withColumn("share", F.col("held") / F.col("runs")).where(F.col("share") >= F.when(F.col("base"), 1.0).otherwise(SHARE))
    # base places and notices compete among themselves only; a base place never gives way
    text = W.partitionBy("doc_id", "key", "base").orderBy("first", "last", "template")
    so_far = F.max("last").over(text.rowsBetween(W.unboundedPreceding, -1))
    heap = good.withColumn("new", F.coalesce(F.col("first") > so_far, F.lit(True)).cast("int")).withColumn(
        "heap", F.sum("new").over(text.rowsBetween(W.unboundedPreceding, 0)))
    best = F.max("held").over(W.partitionBy("doc_id", "key", "base", "heap"))
    return heap.withColumn("best", best).where("base or held = best").select("doc_id", "key", "label", "base", "start", "share")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Word count, base places, labels and the best share of every document."""
    docs = native.keyed(docs, doc_id, text)
    found = spans(docs).groupBy("doc_id", "key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_set"),
        F.collect_set("label").alias("set"),
        F.max("share").alias("score"))
    counted = docs.select("doc_id", "key", F.size(native.words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(found, native.same(counted, found, "doc_id", "key"), "left")
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(found[c]), ","), F.lit(""))
    return joined.select(
        counted["doc_id"], "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        listed("base_set").alias("base_labels"), listed("set").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def sql() -> str:
    values = ", ".join(f"({i}, '{label}', {i < len(BASE)}, '{text}')" for i, (text, label) in enumerate((*BASE, *NOTICES)))
    run = lambda w, at: " || ' ' || ".join(f"{w}[{at} + {k}]" for k in range(1, K + 1))
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {native.words_sql('text')} AS w FROM documents),
    t AS (SELECT i, label, base, string_split(text, ' ') AS w FROM (VALUES {values}) v(i, label, base, text)),
    tg AS (SELECT i, label, base, len(w) - {K - 1} AS runs, "at", {run('w', '"at"')} AS g
           FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS "at" FROM t)),
    dg AS (SELECT r, pos, {run('w', 'pos')} AS g FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS pos FROM docs)),
    votes AS (SELECT r, i, label, base, runs, pos - "at" AS d, list("at") AS ats, min(pos) AS p0, max(pos) AS p1 FROM dg JOIN tg USING (g) GROUP BY ALL),
    gaps AS (SELECT *, d - lag(d) OVER (PARTITION BY r, i ORDER BY d) AS gap FROM votes),
    parts AS (SELECT *, sum(CASE WHEN base OR gap IS NULL OR gap > {BAND} THEN 1 ELSE 0 END) OVER (PARTITION BY r, i ORDER BY d) AS part FROM gaps),
    found AS (SELECT r, i, label, base, min(d) AS start, len(list_distinct(flatten(list(ats)))) AS held, any_value(runs) AS runs, min(p0) AS p0, max(p1) + {K - 1} AS p1
              FROM parts GROUP BY r, i, label, base, part),
    fine AS (SELECT *, held / runs AS share FROM found WHERE held / runs >= CASE WHEN base THEN 1.0 ELSE {SHARE} END),
    edges AS (SELECT *, CASE WHEN p0 <= max(p1) OVER (PARTITION BY r, base ORDER BY p0, p1, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM fine),
    heaps AS (SELECT *, sum(new) OVER (PARTITION BY r, base ORDER BY p0, p1, i ROWS UNBOUNDED PRECEDING) AS heap FROM edges),
    good AS (SELECT * FROM (SELECT *, max(held) OVER (PARTITION BY r, base, heap) AS best FROM heaps) WHERE base OR held = best),
    by_doc AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
                      max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                      string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM good GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, 0.0)::DOUBLE AS score
    FROM docs LEFT JOIN by_doc USING (r)"""
