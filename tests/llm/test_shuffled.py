"""Operators that join, group or pack: n-gram join, license scan, decontamination, sharding, packing, and the pipeline."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dataheal.llm import common, decontaminate, jaccard, licenses, packing, shards
from tests.compare import compare, duck

from .conftest import ITEM, prose, texts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("module", [jaccard, licenses, decontaminate], ids=lambda m: m.__name__.split(".")[-1])
def test_matches_sql(spark, con, module):
    assert compare(spark, con, module.query, module.sql(), SMALL) is None


# --- components

def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join

def set_of(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def linked_by_hand(rows: list[tuple]) -> list[tuple]:
    sets = [set_of(t) for _, t in rows]
    home = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = home[i], home[j]
                home = [b if h == a else h for h in home]
    out = []
    for (doc, _), s, h in zip(rows, sets, home):
        ids = [rows[k][0] for k in range(len(rows)) if home[k] == h and rows[k][0] is not None]
        out.append((doc, len(s), (min(ids) if ids else None) if s else doc))
    return sorted(out, key=repr)


def copies(seed: int, n: int) -> list[tuple]:
    """Texts that share passages and are changed a little again and again, so links form chains."""
    r = random.Random(seed)
    passages = [prose(1000 + k, 25) for k in range(3)]
    pool = [" ".join([prose(seed + k, 40), *r.sample(passages, r.randint(0, 3))]) for k in range(4)]
    for _ in range(n):
        words = r.choice(pool).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = f"new{r.randrange(50)}"
        pool.append(" ".join(words))
    return [(i, t) for i, t in enumerate(pool)]


@pytest.mark.parametrize("usual,many", [(64, 64), (3, 3), (64, 1), (1, 3)], ids=["multiplied", "by leaders", "by leaders only", "by order"])
def test_join_against_brute_force(spark, monkeypatch, usual, many):
    """With small limits nearly every n-gram of the copies is common, so all goes by leaders."""
    monkeypatch.setattr(jaccard, "USUAL", usual)
    monkeypatch.setattr(jaccard, "COMMON", many)
    rows = copies(1, 90)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == linked_by_hand(rows)


def test_join_awkward(documents, nothing):
    got = sorted((tuple(r) for r in jaccard.join(documents).collect()), key=repr)
    assert got == linked_by_hand([(i, t) for i, t, _ in texts()])
    assert jaccard.join(nothing).count() == 0
    kept = jaccard.keep_one(documents)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert kept.columns == documents.columns
    assert ids == sorted([1, 2, 3, 4, 7, 9, 10, 11, 12, None, 13, 15, 16, 17], key=repr)


def test_prefix_never_loses_a_pair():
    r = np.random.default_rng(3)
    levels = r.integers(0, 3, jaccard.SLOTS).astype(np.uint8)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 60), dtype=np.uint64))
        drop = r.random(len(a)) < 0.1
        b = np.unique(np.concatenate([a[~drop], r.integers(0, 2**63, int(r.integers(0, 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.prefix(a, levels, 75)[0], jaccard.prefix(b, levels, 75)[0]))


# --- license scan

def test_license_places(documents, nothing, spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents).collect()}
    assert got[1]["n_words"] == 0 and got[1]["labels"] == "" and got[1]["score"] == 0 and got[1]["first_word"] is None
    assert got[11]["n_base"] == 1 and got[11]["base_labels"] == "apache-2" and got[11]["first_word"] == 9
    assert licenses.scan(documents).count() == len(texts()) and licenses.scan(nothing).count() == 0
    cases = [
        ("under the MIT license, under the mit-license; CC BY-NC and cc by nc", 4, "cc-by-nc,mit", "cc-by-nc,mit"),
        ("This work is licensed under the GNU General Public License, version 3.", 0, "", "gpl-3"),
        ("This work is now licensed under the terms of the GNU General Public License version 3", 0, "", ""),
        ("permission is hereby granted, free of charge, to any person obtaining one copy of this software and its associated documentation files (the Software), to deal in the software without restriction", 0, "", "mit"),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, see there", 0, "", "cc-by-sa"),
        ("a license", 0, "", ""), ("under the mit", 0, "", "")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        text, n, base, labels = cases[r["doc_id"]]
        assert (r["n_base"], r["base_labels"], r["n_words"]) == (n, base, len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)))
        assert r["labels"] == labels or text.startswith(("This work is now", "permission")), (r, cases[r["doc_id"]])


# --- decontamination

def test_overlaps(documents, benchmark, nothing, spark):
    got = [(r["doc_id"], r["item_id"], r["agree"], r["width"]) for r in decontaminate.overlaps(documents, benchmark).collect()]
    assert got == [(12, 1, 13, 13)]
    assert decontaminate.overlaps(nothing, benchmark).count() == 0 and decontaminate.overlaps(documents, benchmark.limit(0)).count() == 0
    cleaned = decontaminate.clean(documents, benchmark)
    assert cleaned.columns == documents.columns and cleaned.count() == len(texts()) - 1 and cleaned.where("doc_id = 12").count() == 0


def test_substitutions_are_found(spark, benchmark):
    r, words, rows = random.Random(8), ITEM.split(), []
    for i in range(60):
        copy = list(words)
        for k in range(r.randrange(len(copy) % 8, 8), len(copy), 8):
            copy[k] = "other"
        rows.append((i, " ".join([prose(i, 20), *copy, prose(i + 100, 20)])))
    rows += [(100 + i, prose(500 + i, 60)) for i in range(60)]
    found = {r["doc_id"] for r in decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert found == set(range(60))


def test_items_without_an_id_are_found(spark):
    """A null id, two ids of one text, and one id of two texts."""
    a, b = ITEM, prose(77, 20)
    items = spark.createDataFrame([(None, a), (None, a), (4, b), (5, b), (4, prose(78, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"{b} z"), (3, f"q {prose(78, 20)}"), (None, a), (5, prose(79, 40))], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["first_word"]) for r in decontaminate.overlaps(docs, items).collect()), key=repr)
    assert got == sorted([(1, None, 1), (2, 4, 0), (2, 5, 0), (3, 4, 1), (None, None, 0)], key=repr)
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [5]


@pytest.mark.parametrize("width", range(1, 14))
def test_masks_hit_every_overlap(width):
    agree = -(-3 * width // 4)
    places = [{at + i for i, c in enumerate(m) if c == "1"} for m in decontaminate.masks(width) for at in range(width - len(m) + 1)]
    for kept in combinations(range(width), agree):
        assert any(p <= set(kept) for p in places), kept


def best_alignment(doc: list[str], item: list[str]) -> tuple | None:
    """(first_word, agree, width) of the rule itself, over all alignments."""
    width, found = min(13, len(item)), []
    for diagonal in range(-len(item) + 1, len(doc)):
        same = [0 <= diagonal + i < len(doc) and doc[diagonal + i] == w for i, w in enumerate(item)]
        agree, start = max((sum(same[s : s + width]), -s) for s in range(len(item) - width + 1))
        if 4 * agree >= 3 * width:
            found.append((agree, -max(0, diagonal - start)))
    return (-max(found)[1], max(found)[0], width) if found else None


def test_overlaps_against_all_alignments(spark):
    """Copies of items of 1 to 16 words with as many words exchanged as the rule allows, and one more."""
    r, docs, items = random.Random(4), {}, {}
    for n in range(1, 17):
        items[n] = [f"i{n}w{k}" for k in range(n)]
        width = min(13, n)
        for over in (0, 1):
            for _ in range(6):
                copy = list(items[n])
                start = r.randrange(n - width + 1)
                for k in r.sample(range(start, start + width), min(width, width - -(-3 * width // 4) + over)):
                    copy[k] = "other"
                docs[len(docs)] = [*prose(len(docs), r.randrange(4)).split(), *copy, *prose(len(docs), r.randrange(4)).split()]
    docs[len(docs)] = items[16][:10]
    want = {(d, i, *b) for d, doc in docs.items() for i, item in items.items() if (b := best_alignment(doc, item))}
    frame = lambda x, name: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{name} long, text string")
    got = decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id"))
    assert {(x["doc_id"], x["item_id"], x["first_word"], x["agree"], x["width"]) for x in got.collect()} == want
    assert {i for _, i, *_ in want} == set(items)


# --- sharding

def test_flow_moves_the_fewest_bytes():
    r = random.Random(4)
    for _ in range(60):
        old = [r.randrange(0, 200) for _ in range(r.randint(1, 7))]
        capacity = shards.capacities(sum(old), r.randint(1, 9))
        flow = shards.min_cost_flow(old, capacity)
        assert [sum(u for (i, _), u in flow.items() if i == k) for k in range(len(old))] == old
        assert all(sum(u for (_, j), u in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stays = sum(min(a, b) for a, b in zip(old, capacity))
        assert sum(u for (i, j), u in flow.items() if i != j) == sum(old) - stays


def test_level():
    r = random.Random(9)
    for _ in range(200):
        held, more = [r.randrange(50) for _ in range(r.randint(1, 8))], r.randrange(300)
        got = shards.levelled(held, more)
        after = [h + g for h, g in zip(held, got)]
        assert sum(got) == more and min(got) >= 0
        assert max((a for a, g in zip(after, got) if g), default=0) <= min(after) + 1


def test_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    docs = docs.union(docs.where("doc_id < 3"))
    placed = shards.shard(docs)
    got = placed.collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r)
    assert sorted(sizes) == list(range(24))
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in sizes.values())
    total = [sum(r["size"] for r in s) for s in sizes.values()]
    assert max(total) < 1.05 * sum(total) / 24 and min(total) > 0.95 * sum(total) / 24
    affected = shards.reshard(docs, placed, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["shard"], r["slot"], r["row"]["doc_id"]) for r in written.collect()) == sorted((r["shard"], r["slot"], r["doc_id"]) for r in got if r["shard"] in affected)


def test_awkward_shards(documents, nothing):
    got = shards.shard(documents)
    assert got.count() == len(texts()) and got.where("doc_id = 1").first()["size"] == 8
    assert shards.shard(nothing).count() == 0


# --- packing

def test_best_fit_and_crossover():
    r = random.Random(6)
    for _ in range(40):
        sizes = np.array([r.randint(1, 100) for _ in range(r.randint(1, 80))])
        first = packing.founders(sizes, 100, 1)
        for g in [*first, packing.crossover(sizes, first[0], first[-1], 100, r), *packing.evolve(sizes, first, 100, 2)[0]]:
            assert g.min() >= 0 and sorted(set(g.tolist())) == list(range(g.max() + 1))
            assert np.bincount(g, sizes).max() <= 100


def triplets(n: int, seed: int) -> list[int]:
    """Sizes that fill ``n`` bins of 1000 by threes; best fit by falling size needs many more."""
    r, out = random.Random(seed), []
    for _ in range(n):
        a = r.randint(380, 490)
        b = r.randint(250, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    r.shuffle(out)
    return out


def test_evolution_beats_best_fit(spark):
    """Lots that best fit does not solve: crossovers take place, and the islands' packing has fewer bins."""
    sizes = triplets(60, 3)
    fit = packing.best_fit(sizes, np.argsort(-np.array(sizes), kind="stable").tolist(), np.full(len(sizes), -1), 1000)
    whole = np.array(sizes)
    first = packing.founders(whole, 1000, 1)
    after, crossed = packing.evolve(whole, first, 1000, 2)
    assert crossed > packing.PATIENCE and packing.bins_of(after[0]) < min(packing.bins_of(g) for g in first) <= packing.bins_of(fit)
    assert len({packing.founders(whole, 1000, 1, i)[0].tobytes() for i in range(packing.ISLANDS)}) == packing.ISLANDS
    items = spark.createDataFrame([(i, i, s) for i, s in enumerate(sizes)], "doc_id long, row long, length long").repartition(3)
    packed = packing.pack(items, 1000).collect()
    fills = {}
    for r in packed:
        fills[r["bin"]] = fills.get(r["bin"], 0) + r["length"]
    assert len(packed) == len(sizes) and max(fills.values()) <= 1000
    assert 60 <= len(fills) < packing.bins_of(fit) - 3


def test_words_are_tokenized_as_texts():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    cases = ["", "  \n", "<|endoftext|> A <|ENDOFTEXT|> b", "Ä́ éx İ ſ K don't 'S x'LL", "漢字 デス", "a\x85b　c", "😀 １２", prose(1, 50), "A,B. c-d", "é ́x"]
    for t in cases:
        assert encoder.encode([t.encode()])[0] == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing(spark, documents, nothing, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "LOT", 300)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for docs, slack in ((small, 1.02), (documents, 2)):
        got = packing.pack_documents(docs, path).collect()
        want = []
        for r in docs.collect():
            ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                cut = ids[at : at + 2048]
                want.append((r["doc_id"], k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= slack * -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack_documents(nothing, path).count() == 0


# --- pipeline

def test_pipeline(spark, tmp_path, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    left, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns and left.dtypes == docs.dtypes
        kept.append(sorted((r["doc_id"] for r in left.select("doc_id").collect()), key=repr))
    assert kept[0] == sorted([4, 5, 5, 6, 7, 8, 9, 10, 11, 12, None, 13, 14, 15, 17], key=repr)
    assert kept[1] == sorted([4, 7, 9, 10, 11, 12, None, 13, 15, 17], key=repr)
    assert kept[2] == kept[3] == [i for i in kept[1] if i != 12]
    assert "9f86d081884c7d65" not in left.where("doc_id = 10").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in packed.collect()}, key=repr) == kept[3]


def test_bitmaps_never_screen_a_link(spark):
    """Sets of all sizes whose similarity is just enough stay, unrelated ones of like size go."""
    r, rows = np.random.default_rng(2), []
    for n in (1, 3, 40, 500, 700, 800, 3000, 20000):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        for b, linked in ((np.concatenate([a[: n - n // 8], r.integers(0, 2**63, n // 8, dtype=np.uint64)]), True), (a[: n - n // 4], True), (r.integers(0, 2**63, n, dtype=np.uint64), False)):
            rows.append((linked, (len(a), jaccard.bitmap(a).tolist()), (len(b), jaccard.bitmap(b).tolist())))
    df = spark.createDataFrame(rows, "linked boolean, x struct<n:long,bits:array<long>>, y struct<n:long,bits:array<long>>")
    got = [tuple(x) for x in df.select("linked", "x.n", jaccard.may_link("x", "y", 75)).collect()]
    assert all(passed for linked, _, passed in got if linked)
    assert not any(passed for linked, n, passed in got if not linked and n >= 40)
