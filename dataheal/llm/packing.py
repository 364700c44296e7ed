"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are tokenized in place and only those longer than a sequence are cut. Full pieces are
sequences of their own; all other pieces are dealt at random to lots of about ``LOT`` pieces, which
several islands pack. An individual is a grouping of the lot into bins. Crossover injects well-filled
bins of one parent whole into the other, removes the bins there that hold any of their pieces, and
best-fits the displaced pieces. Every island has founders of its own: best fit by sizes that are blurred at random, on
the first island by plain falling size too, so no lot is packed worse than by that. Islands cross until ``PATIENCE`` children
in a row were no progress; after every epoch each island's elite migrates to the next island of the lot, until an
epoch saves no bin. A lot that has as few bins as its pieces' sum allows is solved: it can't be packed
better, and its islands end. Pieces of badly filled bins are dealt again to lots of their own and packed a second time,
so what lots waste at their ends meets.

A lot is a few kilobytes of lengths; texts and token ids never move, only the lengths, places and
checksums of the pieces do.

Defined results: null and empty texts are the end id alone; repeated rows are packed once each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import random
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataheal.llm import common
from dataheal.session import materialise

LENGTH, LOT = 2048, 4096
ISLANDS, EPOCHS, POPULATION = 3, 4, 6
#: Children in a row without progress that end an island's epoch; children in an epoch at most.
PATIENCE, CROSSOVERS = 12, 60
#: Bins that are less full than this are dealt again.
FULL = 0.98
#: Most parts of texts whose ids a worker keeps, and their most bytes; other parts are tokenized when they come.
HELD, SHORT = 200_000, 64
#: Parts of letters that are tokenized in one call.
SPELLED = 20_000
#: Bytes of text that are cut and looked up at once.
AT_ONCE = 4 << 20
#: Precomposed Latin letters: normal forms of themselves, with one lower-case letter each.
LATIN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: White space that splits words, and marks that join no letter or digit beside them; none of a special token's.
SPACES, MARKS = b" \t\n\r\x0b\x0c", b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
WHITE = re.compile(b"[" + SPACES + b"]")
#: Kinds of bytes. What is of no other kind may join its neighbours, so it is cut from white space only.
OTHER, SPACE, LETTER, DIGIT, MARK, QUOTE = range(6)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_chars() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies; the space, which splits words, is left out."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest) if b != 32}


def kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for kind, members in ((SPACE, SPACES), (DIGIT, b"0123456789"), (MARK, MARKS), (QUOTE, b"'")):
        out[list(members)] = kind
    out[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    return out


def cuts() -> np.ndarray:
    """Whether a part ends between bytes of two kinds, at 8 * the first kind + the second."""
    out = np.zeros(64, bool)
    for a, b in itertools.permutations(range(6), 2):
        # a quote takes letters after it ('s) and is a mark among marks
        out[8 * a + b] = SPACE in (a, b) or (OTHER not in (a, b) and {a, b} != {MARK, QUOTE} and (a, b) != (QUOTE, LETTER))
    return out


def slices(text: bytes) -> Iterator[bytes]:
    """A long text in slices of about ``AT_ONCE`` bytes, cut before white space."""
    at = 0
    while len(text) - at > AT_ONCE and (found := WHITE.search(text, at + AT_ONCE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Token ids of texts as packed little-endian 32-bit numbers, by way of their parts.

    The tokenizer's own rules never join characters across white space, nor a letter, a digit and a mark
    with one another, so a text's ids are those of such parts in turn. All texts of a call are cut at once. Parts
    repeat, so each is looked up once in a call and most are tokenized once by each worker. A part of Latin letters
    is its own normal form, so the vocabulary is applied to it without the rules before it, many parts in one call.
    """

    KINDS, CUTS = kinds(), cuts()
    #: Second bytes of the two-byte letters.
    SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
    CHARS = byte_chars()

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # only sound for rules that take letter runs whole, lower-case them and spell them by bytes; others get no short way
        rules = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.letters = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and None not in rules and self.cut_so(rules[1]) and all(self.one_part(w, *rules) for w in (LATIN, LATIN.upper().replace("SS", ""))):
            self.letters = Tokenizer(self.tokenizer.model)  # the same vocabulary in memory
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.letters.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends its word
            self.last[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True
        self.held, self.known, self.sizes = pa.array([], pa.binary()), np.empty(0, "<u4"), np.empty(0, np.int32)

    @property
    def ids(self) -> dict[bytes, bytes]:
        """The ids of the parts that are held."""
        ends = np.cumsum(self.sizes).tolist()
        return {p: self.known[a:b].tobytes() for p, a, b in zip(self.held.to_pylist(), [0, *ends], ends)}

    @staticmethod
    def cut_so(pre_tokenizer) -> bool:
        """Whether the rules cut letters, digits and marks from one another."""
        parts = [f"{a}{b}" for a, b in zip("abcdefghijklmnopqrstuvwxyzabc", MARKS.decode())]
        found = [p for p, _ in pre_tokenizer.pre_tokenize_str("1".join(parts))]
        return found == list("1".join(parts))

    @classmethod
    def spelled(cls, text: str) -> str:
        return text.lower().encode().decode("latin-1").translate(cls.CHARS)

    @classmethod
    def one_part(cls, word: str, normalizer, pre_tokenizer) -> bool:
        parts = [p for p, _ in pre_tokenizer.pre_tokenize_str(word.lower())]
        return normalizer.normalize_str(word) == word.lower() and parts == [cls.spelled(word)]

    def tokenize(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain = [w for w in words if LETTERS.fullmatch(w)] if self.letters else []
        out = {}
        for at in range(0, len(plain), SPELLED):
            part = plain[at : at + SPELLED]
            found = self.letters.encode_batch_fast([self.spelled(b" ".join(part).decode())], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            ids = ids.tobytes()
            if len(ends) == len(part):  # else the vocabulary lacks a byte at a word's end
                out.update((w, ids[a:b]) for w, a, b in zip(part, [0, *ends], ends))
        rest = list(set(words).difference(out))
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, found))
        return out

    def parts(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of ``data`` start, and their lengths; white space is in no part."""
        b = np.frombuffer(data, np.uint8)
        kind = self.KINDS[b]
        if self.letters:
            two = np.flatnonzero(b[:-1] == 0xC3)
            two = two[self.SECOND[b[two + 1]]]
            kind[two] = kind[two + 1] = LETTER
        else:
            kind[kind != SPACE] = OTHER
        starts = np.flatnonzero(self.CUTS[8 * kind[:-1] + kind[1:]]) + 1
        starts = np.concatenate([[0], starts]) if len(b) else starts
        lengths = np.diff(starts, append=len(b))
        kept = kind[starts] != SPACE
        return starts[kept], lengths[kept]

    def numbered(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A number for each part, and by these numbers: all ids in turn and how many. New parts are held while there is room."""
        n = len(self.held)
        distinct = pa.concat_arrays([self.held, parts]).dictionary_encode()  # those held keep their places
        asked = distinct.dictionary[n:].to_pylist()
        found = self.tokenize(asked)
        new = [found[p] for p in asked]
        known = np.concatenate([self.known, np.frombuffer(b"".join(new), "<u4")])
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int32, len(new)) // 4])
        kept = [k for k, p in enumerate(asked) if len(p) <= SHORT][: HELD - n] if n < HELD else []
        if kept:
            self.held = pa.concat_arrays([self.held, pa.array([asked[k] for k in kept], pa.binary())])
            self.known = np.concatenate([self.known, np.frombuffer(b"".join([new[k] for k in kept]), "<u4")])
            self.sizes = np.concatenate([self.sizes, sizes[n:][kept]])
        return distinct.indices.to_numpy()[n:], known, sizes

    def encode(self, texts: list[bytes]) -> list[bytes]:
        short = iter(self.together([t for t in texts if len(t) <= AT_ONCE]))
        return [next(short) if len(t) <= AT_ONCE else b"".join(self.together([s])[0] for s in slices(t)) for t in texts]

    def together(self, texts: list[bytes]) -> list[bytes]:
        # letters differ in case only, except in the names of special tokens
        texts = [t.lower() if self.letters and b"<|" not in t else t for t in texts]
        data = b"\n".join(texts)
        starts, lengths = self.parts(data)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, SPACES))])
        number, known, sizes = self.numbered(packed)
        firsts, counts = (np.cumsum(sizes) - sizes)[number], sizes[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = known[np.repeat(firsts - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = ends[np.searchsorted(starts, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    held = sys.modules.setdefault("_dataheal_encoders", types.ModuleType("_dataheal_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with ``end`` after them."""
    tail = np.array([end], "<u4").tobytes()

    def make(part: pa.RecordBatch) -> dict:
        rows = []
        for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(path).encode(common.utf8(part.column("text")))):
            ids += tail
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                cut = ids[at : at + 4 * length]
                rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows)))

    return common.map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), PIECE, "text", make, AT_ONCE)


class Bins:
    """Open bins by the room left in them; the tightest that fits is found by the lowest bit of a mask."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.mask, self.by_room = capacity, 0, [[] for _ in range(capacity + 1)]

    def add(self, bin_id: int, room: int) -> None:
        self.by_room[room].append(bin_id)
        self.mask |= 1 << room

    def fit(self, size: int) -> tuple[int, int] | None:
        """Takes out the tightest bin with room for ``size``: (bin, room)."""
        fits = self.mask >> size
        if not fits:
            return None
        room = size + (fits & -fits).bit_length() - 1
        bin_id = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return bin_id, room


def best_fit(sizes: list[int], items: list[int], grouping: np.ndarray, capacity: int) -> np.ndarray:
    """Place ``items`` in their order into the bins of ``grouping`` (-1: not placed) or new ones; bins are renumbered."""
    placed = grouping >= 0
    used, bins = np.unique(grouping[placed], return_inverse=True)
    out = np.full(len(grouping), -1, np.int32)
    out[placed] = bins
    fill = np.bincount(bins, np.asarray(sizes)[placed], len(used)).astype(int).tolist() if len(used) else []
    open_bins, n = Bins(capacity), len(used)
    for b, f in enumerate(fill):
        if f < capacity:
            open_bins.add(b, capacity - f)
    for i in items:
        size = sizes[i]
        found = open_bins.fit(size)
        b, room = found or (n, capacity)
        n += found is None
        out[i] = b
        if room > size:
            open_bins.add(b, room - size)
    return out


def fitness(sizes: np.ndarray, grouping: np.ndarray, capacity: int) -> float:
    """Mean square of how full the bins are: fewer and more unequal bins are better."""
    return float(((np.bincount(grouping, sizes) / capacity) ** 2).mean()) if len(sizes) else 1.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, r: random.Random) -> np.ndarray:
    """A child of ``a`` with about half of the well-filled bins of ``b``."""
    fill = np.bincount(b, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.array(r.sample(good.tolist(), max(1, len(good) // 2)))
    injected = np.isin(b, chosen)
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    child = np.where(hit[a], -1, a)
    child[injected] = b[injected] + a.max() + 1
    displaced = np.flatnonzero(child < 0)
    return best_fit(sizes.tolist(), displaced[np.argsort(-sizes[displaced], kind="stable")].tolist(), child, capacity)


def bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that the sizes' sum needs at least."""
    return -(-int(sizes.sum()) // capacity)


def bins_of(grouping: np.ndarray) -> int:
    return int(grouping.max()) + 1 if len(grouping) else 0


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> tuple[list[np.ndarray], int]:
    """The population after crossovers, best first, and their number. A child takes the place of the worst individual if it is better and new."""
    r, least = random.Random(seed), bound(sizes, capacity)
    ranked = sorted(((fitness(sizes, g, capacity), -k, g) for k, g in enumerate(population)), key=lambda x: x[:2], reverse=True)
    made = idle = 0
    while len(ranked) > 1 and made < CROSSOVERS and idle < PATIENCE and bins_of(ranked[0][2]) > least:
        a, b = r.sample(ranked, 2)
        child = crossover(sizes, a[2], b[2], capacity, r)
        made, idle = made + 1, idle + 1
        value = fitness(sizes, child, capacity)
        if value > ranked[-1][0] and all(abs(value - x[0]) > 1e-12 for x in ranked):
            if value > ranked[0][0]:
                idle = 0
            ranked = sorted([*ranked[:-1], (value, -len(population) - made, child)], key=lambda x: x[:2], reverse=True)
    return [g for _, _, g in ranked], made


def founders(sizes: np.ndarray, capacity: int, seed: int, island: int = 0) -> list[np.ndarray]:
    """Best fit by falling sizes that are blurred at random, differently on each island; on the first one not blurred too."""
    r, out = np.random.default_rng((seed, island)), []
    for k in range(POPULATION):
        blur = 0.0 if k == 0 and island == 0 else 0.1 + 0.25 * k
        order = np.argsort(-sizes * (1 + blur * r.random(len(sizes))), kind="stable")
        out.append(best_fit(sizes.tolist(), order.tolist(), np.full(len(sizes), -1), capacity))
        if bins_of(out[-1]) <= bound(sizes, capacity):
            return [out[-1]]
    return out


ISLAND = "lot long, island int, sizes binary, elite binary, population binary, fitness double, bins long, crossed long, solved boolean"


def island_row(lot: int, island: int, sizes: np.ndarray, population: list[np.ndarray], crossed: int, capacity: int) -> dict:
    bins = bins_of(population[0])
    return {
        "lot": lot, "island": island, "sizes": sizes.astype(np.int32).tobytes(), "elite": population[0].astype(np.int32).tobytes(),
        "population": b"".join(g.astype(np.int32).tobytes() for g in population), "fitness": fitness(sizes, population[0], capacity),
        "bins": bins, "crossed": crossed, "solved": bins <= bound(sizes, capacity)}


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (row, length, ...) with ``bin`` (lot in the high bits) and ``offset`` in it."""
    n = items.count()
    lots = max(1, -(-n // LOT))
    dealt = items.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("long"))
    schema = T.StructType.fromDDL(ISLAND)
    arrow = common.to_arrow_schema(schema)

    def found(lot: pa.Table) -> pa.Table:
        lot = lot.sort_by("row")
        sizes = lot.column("length").to_numpy().astype(np.int64)
        key = lot.column("lot")[0].as_py()
        made = []
        for i in range(ISLANDS):
            made.append(island_row(key, i, sizes, *evolve(sizes, founders(sizes, capacity, key, i), capacity, key * ISLANDS + i), capacity))
            if made[-1]["solved"]:
                made = made[-1:]
                break
        return pa.Table.from_pylist(made, schema=arrow)

    islands = materialise(dealt.select("lot", "row", "length").groupBy("lot").applyInArrow(found, schema))
    solved, open_lots = islands.where("solved"), islands.where("not solved")
    bins = lambda lots: lots.groupBy("lot").agg(F.min("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0
    before = bins(open_lots)
    for epoch in range(1, EPOCHS):
        if not before:
            break
        guests = open_lots.select("lot", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))

        def settle(batches: Iterator[pa.RecordBatch], epoch=epoch) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for x in b.to_pylist():
                    sizes = np.frombuffer(x["sizes"], np.int32).astype(np.int64)
                    natives = list(np.frombuffer(x["population"], np.int32).reshape(-1, len(sizes)))
                    guest = np.frombuffer(x["guest"], np.int32)
                    seed = (epoch << 40) + x["lot"] * ISLANDS + x["island"]
                    after, crossed = evolve(sizes, [*natives[:-1], guest], capacity, seed)
                    rows.append(island_row(x["lot"], x["island"], sizes, after, x["crossed"] + crossed, capacity))
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

        open_lots = materialise(open_lots.join(guests, ["lot", "island"]).mapInArrow(settle, schema))
        after = bins(open_lots)
        if after == before:
            break
        before = after
    best = solved.union(open_lots).groupBy("lot").agg(F.max_by("elite", F.struct("fitness", -F.col("island"))).alias("elite"))
    out = T.StructType([*items.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])

    def place(lot: pa.Table, chosen: pa.Table) -> pa.Table:
        lot = lot.sort_by("row")
        bins = np.frombuffer(chosen.column("elite")[0].as_py(), np.int32).astype(np.int64)
        sizes = lot.column("length").to_numpy().astype(np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[0], np.cumsum(np.bincount(bins))[:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = ends - sizes[order] - (ends - sizes[order])[first][bins[order]]
        fill = np.bincount(bins, sizes).astype(np.int64)[bins]
        key = lot.column("lot")[0].as_py()
        return lot.drop_columns(["lot"]).append_column("bin", pa.array((key << 20) + bins)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return dealt.groupBy("lot").cogroup(best.groupBy("lot")).applyInArrow(place, out)


def sequences(found: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``found`` (see ``pieces``) with ``sequence_id`` and ``offset``."""
    cols = [x.split()[0] for x in PIECE.split(", ")]
    # rows are numbered after they are written, so the numbers stay if a task is run again
    rows = materialise(found).withColumn("row", F.monotonically_increasing_id())
    alone = rows.where(F.col("length") == capacity)
    first = materialise(pack(rows.where(F.col("length") < capacity), capacity))
    loose = first.where(F.col("fill") < FULL * capacity).select(*cols, "row")
    second = pack(loose, capacity)
    parts = (
        (alone.withColumn("offset", F.lit(0).cast("long")), F.col("row") * 3),
        (first.where(F.col("fill") >= FULL * capacity), F.col("bin") * 3 + 1),
        (second, F.col("bin") * 3 + 2))
    out = None
    for part, number in parts:
        one = part.select(*cols, number.cast("long").alias("sequence_id"), "offset")
        out = one if out is None else out.union(one)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return sequences(pieces(docs, path, capacity, 0, doc_id, text), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
