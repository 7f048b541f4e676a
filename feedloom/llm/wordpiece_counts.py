"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over bytes. Each node has a failure link (the node to go on from when no child fits) and the
number of whole pieces that greedy longest match has popped by then; so a word is read once, each byte moves the
automaton forward or along a link, and only counts are added: no piece is ever built. Every byte is a piece of the
vocabulary itself, so a count always exists.

Each task counts the distinct words of its rows by the automaton and remembers a bounded number of them.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The words of the vocabulary file's own pre-tokeniser, and its mark for a word's end.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
WORD_END = "</w>"
#: Byte that stands for the word's end inside the trie; it never occurs in UTF-8.
END = 0xFF
REMEMBERED = 1 << 18


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves,
    the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file with word ends, as bytes with END for the mark."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    byte = printable_bytes()
    out = []
    for piece in model:
        body, end = (piece[: -len(WORD_END)], bytes([END])) if piece.endswith(WORD_END) else (piece, b"")
        if all(c in byte for c in body):
            out.append(bytes(byte[c] for c in body) + end)
    return out


class Automaton:
    """Trie with failure links; link and popped are the precomputed parts."""

    def __init__(self, pieces: list[bytes]):
        self.children: list[dict[int, int]] = [{}]
        self.is_piece = [False]
        for piece in {*pieces, *(bytes([b]) for b in range(256))}:
            at = 0
            for b in piece:
                if b not in self.children[at]:
                    self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.is_piece.append(False)
                at = self.children[at][b]
            self.is_piece[at] = True
        # breadth first: a node that is a piece pops itself; any other pops as its parent does, then reads its byte on
        self.link, self.popped = [-1] * len(self.children), [0] * len(self.children)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for b, u in self.children[v].items():
                queue.append(u)
                if self.is_piece[u]:
                    self.link[u], self.popped[u] = 0, 1
                    continue
                z, pops = self.link[v], self.popped[v]
                while b not in self.children[z]:
                    pops += self.popped[z]
                    z = self.link[z]
                self.link[u], self.popped[u] = self.children[z][b], pops

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest match over word."""
        children, link, popped, at, n = self.children, self.link, self.popped, 0, 0
        for b in word:
            while b not in children[at]:
                n += popped[at]
                at = link[at]
            at = children[at][b]
        while at:
            n += popped[at]
            at = link[at]
        return n


class Counts(dict):
    """Token counts of the words seen so far."""

    def __init__(self, path: str):
        super().__init__()
        self.automaton = Automaton(load_vocabulary(path))

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word.encode("utf-8", "surrogatepass") + bytes([END]))
        if len(word) <= 64:
            self[word] = n
        return n


_counts: dict[str, Counts] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_words, n_tokens (greedy longest-match pieces of the lower-cased words).

    Null and empty texts count 0. Repeated rows each give their row, null ids are kept, an empty table gives an empty
    result, other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = Counts(path)
        of, words = _counts[path].__getitem__, regex.compile(WORDS)
        for batch in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for text in batch.column("text").to_pylist():
                found = words.findall(text.lower())
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_words.append(len(found))
                n_tokens.append(sum(map(of, found)))
            counts = [pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
