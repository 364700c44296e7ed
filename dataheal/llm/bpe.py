"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at special tokens and then into parts by the vocabulary's own pattern. A part's bytes are
the symbols of a doubly linked list; every neighbouring pair that has a merge waits in a priority
queue by the merge's rank, then by place. The best pair is joined into its left symbol, its right one
is unlinked, and the two new pairs enter the queue. Entries whose symbols have changed meanwhile are
stale and skipped. Decoding concatenates the vocabulary's strings of the ids.

The pattern's letter and number classes differ between Unicode versions. Characters that Unicode 3.2
assigns are classed alike by all; a text with any other is cut by the tokenizer file's own pre-tokenizer.
Parts of up to ``SHORT`` characters are looked up among those that a worker has encoded: two tables of at most
``HELD`` parts, of which the older one goes when the newer is full. A long text is cut one stretch at a time,
so memory is bounded by the text and its ids.

Defined results: null and empty texts have no ids (and digests of nothing); repeated rows are each
encoded; a null id is returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.llm import common
from dataheal.llm.tokencounts import byte_letters

HELD, SHORT, STRETCH = 250_000, 48, 1 << 18
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the pattern of parts that byte-level vocabularies of this kind are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

EDGE = regex.compile(r"(?<=\S)(?=[ \t\n])")


@dataclass
class Vocabulary:
    """``ranks`` of merges by pair of ids, the ``joined`` id by rank; ``pieces`` by id: the bytes it stands for."""

    ranks: dict[tuple[int, int], int]
    joined: list[int]
    letters: list[int]
    pieces: dict[int, bytes]
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file["pre_tokenizer"] or {}
        if file["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or file["normalizer"]:
            raise ValueError(f"{path} is no byte-level BPE vocabulary without normalizer and prefix space")
        ids, pairs = file["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        to_letter = byte_letters()
        to_byte = {letter: byte for byte, letter in to_letter.items()}
        pieces = {i: bytes(map(to_byte.__getitem__, piece)) for piece, i in ids.items()}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        pieces.update({i: name.encode() for name, i in special.items()})
        ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        return cls(ranks, [ids[a + b] for a, b in pairs], [ids[to_letter[byte]] for byte in range(256)], pieces, special)


def merged(part: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one part. A queue entry is a rank above 32 bits of place; the rank says which pair it was made for."""
    rank_of, joined = vocabulary.ranks.get, vocabulary.joined
    symbols = list(map(vocabulary.letters.__getitem__, part))
    n = len(symbols)
    queue = [rank << 32 | at for at, pair in enumerate(zip(symbols, symbols[1:])) if (rank := rank_of(pair)) is not None]
    if not queue:
        return symbols
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        entry = pop(queue)
        at, rank = entry & 0xFFFFFFFF, entry >> 32
        follower = after[at]
        if follower >= n or rank_of((symbols[at], symbols[follower])) != rank:
            continue  # stale: one of the two is part of another symbol now
        symbols[at], symbols[follower] = joined[rank], -1
        after[at] = beyond = after[follower]
        if beyond < n:
            before[beyond] = at
            if (found := rank_of((symbols[at], symbols[beyond]))) is not None:
                push(queue, found << 32 | at)
        back = before[at]
        if back >= 0 and (found := rank_of((symbols[back], symbols[at]))) is not None:
            push(queue, found << 32 | back)
    return [s for s in symbols if s >= 0]


def stretches(text: str) -> Iterator[str]:
    """A text in pieces of about ``STRETCH`` characters, cut where white space follows another character: a part always ends there."""
    at = 0
    while len(text) - at > STRETCH and (edge := EDGE.search(text, at + STRETCH)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class Codec:
    """Encodes and decodes by one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary.read(path)
        self.parts = regex.compile(PATTERN)
        self.own_parts = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.settled: set[str] = set()

    def is_settled(self, text: str) -> bool:
        """Whether Unicode 3.2 assigns all characters of a text."""
        new = set(text) - self.settled
        self.settled.update(c for c in new if unicodedata.ucd_3_2_0.category(c) != "Cn")
        return new <= self.settled

    def cut(self, text: str) -> list[str]:
        if self.is_settled(text):
            return self.parts.findall(text)
        return [text[a:b] for _, (a, b) in self.own_parts(text)]

    def ids_of(self, part: str) -> bytes:
        """Packed ids of a part that is not in ``held``."""
        found = self.older.get(part) or array("I", merged(part.encode("utf-8", "replace"), self.vocabulary)).tobytes()
        if len(part) <= SHORT:
            if len(self.held) >= HELD:
                self.older = dict(self.held)
                self.held.clear()
            self.held[part] = found
        return found

    def encode(self, text: str) -> array:
        """Ids of a whole text, special tokens by their names."""
        out, get, make = array("I"), self.held.get, self.ids_of
        for k, between in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(self.vocabulary.special[between])
                continue
            for stretch in stretches(between):
                out.frombytes(b"".join([get(p) or make(p) for p in self.cut(stretch)]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.pieces.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    held = sys.modules.setdefault("_dataheal_codecs", types.ModuleType("_dataheal_codecs")).__dict__
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def little_endian(ids: array) -> bytes:
    if ids.itemsize != 4 or sys.byteorder != "little":
        return b"".join(i.to_bytes(4, "little") for i in ids)
    return ids.tobytes()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every document's whole text."""

    def make(part: pa.RecordBatch) -> dict:
        by = codec(path)
        return {"doc_id": part.column("doc_id"), "ids": [list(by.encode(t.decode("utf-8", "replace"))) for t in common.utf8(part.column("text"))]}

    return common.map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id long, ids array<int>", "text", make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of :func:`encode`'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(path)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), pa.array([by.decode(row.column("ids")[0].as_py() or [])], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: its ids, and the text decoded from them."""

    def make(part: pa.RecordBatch) -> dict:
        by, rows = codec(path), []
        for doc, data in zip(part.column("doc_id").to_pylist(), common.utf8(part.column("text"))):
            ids = by.encode(data.decode("utf-8", "replace"))
            decoded = by.decode(ids).encode()
            rows.append((doc, len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return dict(zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows)))

    return common.map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), ENCODED, "text", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
