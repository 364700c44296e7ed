"""Token counts by a linear longest-match automaton.

A word-piece tokenizer takes from each word the longest vocabulary piece again and again. The
vocabulary becomes a trie; each node has a failure link to where matching goes on after the
pieces that a mismatch there forces out ("popped"), and the number of those pieces. One walk
over a word then yields how many pieces it has, without building any (Song et al., 2021).

The trie is built by each Python worker from the vocabulary file, whose path is a parameter. Words
are counted once per slice of rows, so a text that repeats a word a million times walks it once.

With ``parts`` words are cut as the vocabulary's file says (letter runs, single digits, marks) before
they are matched, and where no piece is left but the end mark, the matched pieces count: many inner
pieces have no form that ends a word. Without it a word is matched as it stands.

Defined results: null and empty texts have 0 words and 0 tokens; a word that the vocabulary cannot
spell is one unknown token; repeated rows are each counted; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import sys
import types
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.llm import common

END = "</w>"
#: Stands for the end of a word, as one symbol; no text has it.
STOP = "\x00"


def vocabulary(path: str) -> list[str]:
    """Pieces of a tokenizers file, over the byte alphabet, with ``STOP`` where a piece ends its word."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [p.removesuffix(END) + STOP if p.endswith(END) else p for p in pieces]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies (printable Latin-1 as itself, the rest from 256 on)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """``next[v]``: edges; ``fail[v]``: node after the popped pieces (-1: none); ``popped[v]``: how many they are."""

    def __init__(self, pieces: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        depth_first: list[tuple[int, int, str]] = []  # (parent, node, symbol) by depth, as pieces are added by prefix length
        by_depth: dict[int, list[tuple[int, int, str]]] = {}
        for piece in pieces:
            v = 0
            for depth, symbol in enumerate(piece):
                w = self.next[v].get(symbol)
                if w is None:
                    w = len(self.next)
                    self.next[v][symbol] = w
                    self.next.append({})
                    ends.append(False)
                    by_depth.setdefault(depth, []).append((v, w, symbol))
                v = w
            if v:
                ends[v] = True
        for depth in sorted(by_depth):
            depth_first += by_depth[depth]
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        for parent, v, symbol in depth_first:
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            z, n = self.fail[parent], self.popped[parent]
            while z != -1 and symbol not in self.next[z]:
                n += self.popped[z]
                z = self.fail[z]
            if z != -1:
                self.fail[v], self.popped[v] = self.next[z][symbol], n

    def count(self, word: str, unended: bool = False) -> int:
        """Pieces of greedy longest match over the whole of ``word``; 1 if it cannot be spelled.

        ``unended``: a word of which only ``STOP`` is left is spelled by the pieces before.
        """
        v, n, nxt, fail, popped = 0, 0, self.next, self.fail, self.popped
        for symbol in word:
            w = nxt[v].get(symbol)
            while w is None:
                if fail[v] == -1:
                    return n if unended and not v and n and symbol == STOP else 1
                n += popped[v]
                v = fail[v]
                w = nxt[v].get(symbol)
            v = w
        while v:
            if fail[v] == -1:
                return 1
            n += popped[v]
            v = fail[v]
        return n


def loaded(path: str) -> tuple[Automaton, dict[int, str]]:
    """The automaton of a vocabulary file, built once per Python worker."""
    held = sys.modules.setdefault("_dataheal_automata", types.ModuleType("_dataheal_automata")).__dict__
    if path not in held:
        held[path] = (Automaton(vocabulary(path)), byte_letters())
    return held[path]


def count_words(words: Counter, automaton: Automaton, letters: dict[int, str]) -> dict[bytes, int]:
    return {w: automaton.count("".join(map(letters.__getitem__, w)) + STOP) for w in words}


def cutter(path: str):
    """The pre-tokenizer of a vocabulary file, built once per Python worker: parts of a text, in byte letters."""
    from tokenizers import Tokenizer

    held = sys.modules.setdefault("_dataheal_cutters", types.ModuleType("_dataheal_cutters")).__dict__
    if path not in held:
        held[path] = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return held[path]


def count_parts(words: Counter, automaton: Automaton, cut) -> dict[bytes, int]:
    return {w: sum(automaton.count(p + STOP, True) for p, _ in cut(w.decode())) for w in words}


def count(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", parts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document's whole text, ASCII lower-cased and split at ASCII white space."""

    def make(part: pa.RecordBatch) -> dict:
        automaton, letters = loaded(path)
        split = [t.lower().split() for t in common.utf8(part.column("text"))]
        distinct = Counter(w for words in split for w in words)
        pieces = count_parts(distinct, automaton, cutter(path)) if parts else count_words(distinct, automaton, letters)
        return {"doc_id": part.column("doc_id"), "n_words": [len(w) for w in split], "n_tokens": [sum(map(pieces.__getitem__, w)) for w in split]}

    return common.map_rows(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id long, n_words long, n_tokens long", "text", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), parts=True)
