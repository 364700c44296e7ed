"""Centroid clustering, importance resampling, BPE encoding and decoding, each against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dataheal.llm import bpe, centroids, resample
from tests.compare import compare, duck

from .conftest import prose, texts

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("module", [centroids, resample], ids=lambda m: m.__name__.split(".")[-1])
def test_matches_sql(spark, module):
    assert compare(spark, duck(SMALL), module.query, module.sql(), SMALL) is None


# --- centroid clustering

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, whole string, lead int, distance string, centre int"


def clustered_by_hand(rows: list[tuple], components: int, k: int = 8, rounds: int = 10) -> list[tuple]:
    kept = []
    for name, x, *_ in rows:
        if x is not None and len(x) == components and all(v is not None and math.isfinite(v) for v in x):
            kept.append((name, [math.floor(1024 * float(np.float32(v))) for v in x]))
    order = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [x for _, x in sorted(kept, key=order)[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for c in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, of) if o == c]
            if mine:
                centres[c] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [nearest(x) for _, x in kept]
    by = Counter()
    for d, c in found:
        by[c] += d
    name = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((v, c, d, by[c], sum(by.values()), name(c)) for (v, _), (d, c) in zip(kept, found)), key=repr)


def vectors(seed: int, n: int, components: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (5, components))
    rows = [(i, (middle[i % 5] + r.normal(0, 0.4, components)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]  # one vector fills a third of the table
    rows += [(2000 + i, [float(v) for v in r.integers(-1, 2, components)]) for i in range(20)]  # ties
    rows += [rows[3], rows[3], (None, rows[4][1]), (3000, None), (3001, []), (3002, [None] * components), (3003, [1.0] * (components + 1))]
    return rows + [(3004, [math.nan] * components), (3005, [math.inf] + [0.0] * (components - 1)), (3006, [0.0] * components)]


@pytest.mark.parametrize("components,leading", [(64, 16), (6, 2), (6, 6), (1, 1)])
def test_clusters_against_plain_python(spark, components, leading):
    rows = [(*r, 1, "x", "y", 2, "z", 3) for r in vectors(components, 60, components)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted((tuple(r) for r in centroids.cluster(df, components=components, leading=leading).collect()), key=repr)
    assert got == clustered_by_hand(rows, components)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(i, [float(i), 0.5], *[None] * 6) for i in range(3)]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS), components=2, leading=1)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clustered_by_hand(rows, 2)
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, *[None] * 6)], VECTORS)).count() == 0


def test_bound_never_loses_the_nearest_and_saves_work():
    """Large, small and equal vectors: the filter leaves the exact answer, and few distances to measure."""
    r = np.random.default_rng(3)
    for size in (3, 2_000, 1 << 26):
        middle = r.integers(-size, size + 1, (8, 64))
        x = np.concatenate([middle[r.integers(0, 8, 3_000)] + r.integers(-size // 8 - 1, size // 8 + 2, (3_000, 64)), middle, middle[:1].repeat(9, 0)]).clip(-(1 << 27), 1 << 27)
        centres = np.concatenate([middle[:6], middle[:1], middle[6:7] + 1])
        spread = np.cov(x.T.astype(np.float64))
        rotation = centroids.Rotation(x.mean(0), np.linalg.eigh(spread)[1][:, ::-1][:, :16])
        cluster, best, measured = centroids.nearest(x, *rotation.split(x), centres, rotation)
        far = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (cluster == far.argmin(1)).all() and (best == far.min(1)).all()
        assert measured < 0.5 * far.size


def test_vectors_beyond_64_bits_are_an_error(spark):
    rows = [(i, [float(i), 1e30], *[None] * 6) for i in range(3)]
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame(rows, VECTORS), components=2, leading=1).collect()


# --- importance resampling


def words_of(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text: str | None, width: int = 2) -> list[int]:
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def drawn_by_hand(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    s, t = (Counter(h % 10_000 for x in all_texts for h in features_of(x)) for all_texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for doc, text in docs:
        found = [gain(h % 10_000) for h in features_of(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= 20))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 25 * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def ranked(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_resampling_against_plain_python(spark, documents, benchmark, nothing):
    extra = [(100 + i, prose(i, 15 + i % 12)) for i in range(60)] + [(200 + i, prose(9, 40)) for i in range(40)]
    more = spark.createDataFrame([(i, t, *[None] * 17) for i, t in extra], documents.schema)
    target = [r["text"] for r in benchmark.collect()]
    docs = [(i, t) for i, t, _ in texts()] + extra
    assert ranked(resample.resample(documents.union(more).repartition(6), benchmark)) == drawn_by_hand(docs, target)
    assert ranked(resample.resample(documents, nothing)) == drawn_by_hand(docs[: -len(extra)], [])
    assert resample.resample(nothing, benchmark).count() == 0
    few = documents.where("doc_id in (1, 2, 13)")
    assert ranked(resample.resample(few, benchmark)) == drawn_by_hand([r for r in docs if r[0] in (1, 2, 13)], target)


def test_ties_at_the_end_of_the_draw(spark):
    """Equal scores go to smaller ids: one text, and ids given in any order."""
    rows = [(k, "t", 30, 7, 100) for k in (5, 3, 9, 1, 7, 8)] + [(2, "t", 30, 7, 200), (4, "t", 19, 7, 900)]
    scored = spark.createDataFrame(rows, "doc_id long, text string, n_words long, n_features long, score long").repartition(3)
    got = {r["doc_id"]: r["rank"] for r in resample.drawn(scored, 20, 60).collect()}
    assert got == {2: 1, 1: 2, 3: 3, 5: 4, 7: None, 8: None, 9: None, 4: None}


@pytest.mark.parametrize("stretch", [3, 11, 1 << 18])
def test_feature_hashes_across_stretches(monkeypatch, stretch):
    monkeypatch.setattr(resample, "STRETCH", stretch)
    r, split = random.Random(stretch), resample.splitter()
    for _ in range(800):
        text = "".join(r.choice("ab Zé漢-\n9\x00ſK") for _ in range(r.randint(0, 50)))
        for width in (1, 2, 3):
            n, hashes = resample.feature_hashes(text.encode(), split, width)
            assert n == len(words_of(text)) and sorted(hashes.tolist()) == sorted(features_of(text, width))


# --- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_codec_equals_the_library(library):
    codec, r = bpe.Codec(BYTES), random.Random(7)
    letters = [*"ab ze  \n\t'sS'tdD1２½९漢字éſK😀\U0001f9ff̈​\xa0\x85\x1c<|endoftext|>", "<|endoftext|>", "'ll", "'re", "   ", "\r\n", "࢏", "\U00010940"]
    cases = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    cases += ["", " ", "a" * 4000, prose(3, 3000), "".join(r.choice("abcdefgh") for _ in range(20_000))]
    for text in cases:
        ids = codec.encode(text)
        assert list(ids) == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert codec.decode(ids) == library.decode(list(ids), skip_special_tokens=False) == text


def test_settled_characters_are_cut_as_the_library_cuts(library):
    """Every character that Unicode 3.2 assigns, between characters of all classes."""
    own = bpe.Codec(BYTES).parts
    for start in range(0, 0x30000, 0x400):
        s = "".join(f"a{c}1{c}!{c} {c}" for c in map(chr, range(start, start + 0x400)) if unicodedata.category(c) != "Cs" and unicodedata.ucd_3_2_0.category(c) != "Cn")
        assert [m.span() for m in own.finditer(s)] == [o for _, o in library.pre_tokenizer.pre_tokenize_str(s)], hex(start)


def test_unsettled_texts_are_cut_in_stretches(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    monkeypatch.setattr(bpe, "HELD", 5)
    codec, r = bpe.Codec(BYTES), random.Random(8)
    for k in range(800):
        text = "".join(r.choice(("ab 😀  \n\t'sé1 \xa0", "ab   \n\t'sé1 \xa0\r")[k % 2]) for _ in range(r.randint(0, 80)))
        assert list(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark, documents, nothing, library):
    odd = spark.createDataFrame([(50, "🎉 new <|endoftext|> text\x1c\x85 z", *[None] * 17), (51, " " * 5000 + "x", *[None] * 17)], documents.schema)
    docs = documents.union(odd)
    got = sorted((tuple(r) for r in bpe.round_trip(docs, BYTES).collect()), key=repr)
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert got == sorted(expected, key=repr)
    assert bpe.round_trip(nothing, BYTES).count() == 0
    back = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    pairs = lambda df: sorted((tuple(r) for r in df.select("doc_id", F.coalesce("text", F.lit(""))).collect()), key=repr)
    assert pairs(back) == pairs(docs)


def test_only_byte_level_vocabularies():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
