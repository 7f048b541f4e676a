"""Alignment of two tokenizers over the same bytes.

Documents are encoded by both tokenizers in pieces of a few megabytes of text. In a piece everything is Arrow columns: lists are flattened
with the index of their document, token lengths become byte offsets by cumulative sums that start anew at each document, a hash join on
(document, end) finds the tokens that end together, and the pairs of ids are counted by grouping. Spark adds the pieces' counts up and brings them back to
the pieces that hold the pair; a piece is the largest group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.wordpiece_counts import printable_bytes
from feedloom.plans.persist import materialize

#: Bytes of text in a piece, and characters of a line of its distinct parts.
PIECE, AT_ONCE = 1 << 20, 1 << 11
#: Where texts may be read in parts: before a space that stands behind another character and before a plain one. The first tokenizer's pattern
#: never matches across such a place, nor has the second one a piece across it (checked when it is loaded), and what stands on one side does not
#: change the tokens of the other.
APART = re.compile(r"(?<=[^ ])(?= [^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff])")
PLAIN = re.compile(APART.pattern.removeprefix("(?<=[^ ])"))
#: Pieces whose counts of one pair meet in one task.
TOGETHER = 1024

OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long"


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and what is written for an id inside and at the end of a group."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = printable_bytes()
        of_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_a = pa.array([of_a.get(i, b"") for i in range(max(of_a) + 1)], pa.binary())
        b = self.b
        self.bytes_b = pa.array([bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())], pa.binary())
        self.length_a = pc.binary_length(self.bytes_a).to_numpy(zero_copy_only=False).astype(np.int64)
        self.length_b = pc.binary_length(self.bytes_b).to_numpy(zero_copy_only=False).astype(np.int64)
        if any(re.search("[^▁]▁", b.id_to_piece(i)) for i in range(b.get_piece_size()) if not b.is_control(i)):
            raise ValueError("the second tokenizer has pieces across words")
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.starts = np.cumsum([0, n_a, n_a, n_b])
        self.written = pa.array([f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], pa.binary())

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both tokenizers for each text; the first one reads a space before the text, which the second one adds. The distinct
        parts of all texts are encoded once each, joined to long lines."""
        cut = [APART.split(" " + t) for t in texts]
        per_text = np.array([len(p) for p in cut], np.int64)
        coded = pa.array([p for parts in cut for p in parts], pa.string()).dictionary_encode()
        parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        first, size, open_ = [], AT_ONCE, False
        for i, p in enumerate(parts):
            if not open_ or size + len(p) > AT_ONCE or not PLAIN.match(p):
                first.append(i)
                size = 0
            size += len(p)
            open_ = p[-1] != " "
        spans = list(zip(first, [*first[1:], len(parts)], strict=True))
        lines = ["".join(parts[i:j]) for i, j in spans]
        of_a = [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(lines, add_special_tokens=False)]
        of_b = [np.array(x, np.int32) for x in self.b.encode([x[1:] for x in lines], num_threads=1)]
        out = []
        for found, length, alone in ((of_a, self.length_a, None), (of_b, self.length_b, lambda some: self.b.encode([p[1:] for p in some], num_threads=1))):
            ids, counts = [], []
            for (i, j), x in zip(spans, found, strict=True):
                ends, bounds = np.cumsum(length[x]), np.cumsum(sizes[i:j])
                stop = np.searchsorted(ends, bounds) + 1
                if len(ends) and stop[-1] == len(ends) and np.array_equal(ends[stop - 1], bounds):
                    ids.append(x)
                    counts.append(np.diff(stop, prepend=0))
                elif alone is None:
                    raise ValueError("a token of the first tokenizer crosses a place where its texts are cut")
                else:  # a character that the second tokenizer does not give back
                    ids.extend(each := [np.array(y, np.int32) for y in alone(parts[i:j])])
                    counts.append(np.array([len(y) for y in each], np.int64))
            out.append(_gathered(np.concatenate(ids), np.concatenate(counts), code, per_text))
        return out[0], out[1]


def _gathered(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, per_text: np.ndarray) -> pa.ListArray:
    """The ids of each text from those of its parts."""
    start, count = (np.cumsum(counts) - counts)[code], counts[code]
    before = np.cumsum(count) - count
    flat = ids[np.repeat(start - before, count) + np.arange(int(count.sum()))]
    upto = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(per_text)])]
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat, pa.int32()))


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def only(lists: pa.ListArray, kept: np.ndarray) -> pa.ListArray:
    """The lists that are kept; the others empty."""
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(count * kept)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pc.list_flatten(lists).filter(pa.array(np.repeat(kept, count))))


class Side:
    """The tokens of one tokenizer over a list of texts: id, text and end (in the bytes of its text) of each token."""

    def __init__(self, lists: pa.ListArray, of: pa.BinaryArray):
        self.lists, self.id, self.text = lists, pc.list_flatten(lists), pc.list_parent_indices(lists)
        tokens = of.take(self.id)
        self.data = memoryview(tokens.buffers()[2] or b"").cast("B")
        self.count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(self.count)
        ends = pc.cumulative_sum(pc.binary_length(tokens).cast(pa.int64()))
        self.bounds = np.concatenate([[0], ends.to_numpy(zero_copy_only=False)])[np.concatenate([[0], last])]
        self.end = pc.subtract(ends, pa.array(self.bounds[:-1], pa.int64()).take(self.text))

    def bytes_of(self, i: int) -> memoryview:
        return self.data[self.bounds[i] : self.bounds[i + 1]]

    def table(self, name: str) -> pa.Table:
        """Tokens by the number of their text and their end in it, as one key."""
        key = pc.bit_wise_or(pc.shift_left(self.text.cast(pa.int64()), 40), self.end)
        return pa.table({"text_end": key, name: self.id, f"at_{name}": pa.array(np.arange(len(self.id), dtype=np.int32))})

    def cuts(self, common: np.ndarray) -> np.ndarray:
        """Whether a token is the last one that ends at a common end."""
        out = np.zeros(len(self.id), bool)
        out[common] = True
        text, end = self.text.to_numpy(zero_copy_only=False), self.end.to_numpy(zero_copy_only=False)
        out[:-1] &= (text[1:] != text[:-1]) | (end[1:] != end[:-1])
        return out


def encoded(of: Tokenizers, texts: list[str]) -> tuple[Side, Side, np.ndarray]:
    """Both sides of the texts, without tokens where the joined bytes of either differ from a space and the text; and
    which texts have tokens."""
    sides = [Side(x, v) for x, v in zip(of.encode(texts), (of.bytes_a, of.bytes_b), strict=True)]
    whole = [b" " + t.encode("utf-8", "surrogatepass") if t else None for t in texts]
    fits = np.array([w is not None and all(s.bytes_of(i) == w for s in sides) for i, w in enumerate(whole)], bool)
    if not fits.all():
        sides = [Side(only(s.lists, fits), v) for s, v in zip(sides, (of.bytes_a, of.bytes_b), strict=True)]
    return sides[0], sides[1], fits


def written_groups(of: Tokenizers, a: Side, b: Side, cut_a: np.ndarray, cut_b: np.ndarray) -> list[memoryview]:
    """a1,a2|b1;a3|b2,b3 for each text. Groups run alike on both sides, so a token stands behind the other side's tokens
    of the groups before its own (for b: of its own as well)."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n = int(cut_a.sum())
    upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
    order = np.zeros(len(cut_a) + len(cut_b), np.int64)
    order[np.arange(len(cut_a)) + np.concatenate([[0], upto_b])[group_a]] = a.id.to_numpy(zero_copy_only=False) + np.where(cut_a, of.starts[1], of.starts[0])
    order[np.arange(len(cut_b)) + upto_a[group_b]] = b.id.to_numpy(zero_copy_only=False) + np.where(cut_b, of.starts[3], of.starts[2])
    line = of.written.take(pa.array(order))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(line).to_numpy(zero_copy_only=False).astype(np.int64))])
    bounds = ends[np.concatenate([[0], np.cumsum(a.count + b.count)])]
    data = memoryview(line.buffers()[2] or b"").cast("B")
    return [data[bounds[i] : max(bounds[i + 1] - 1, bounds[i])] for i in range(len(bounds) - 1)]


def aligned_piece(of: Tokenizers, texts: list[str], digests: bool) -> dict[str, pa.Array]:
    """Columns of a piece: counts and groups of each text, its links as codes of pairs, and (in the first row) the pairs
    of ids with how often each is linked."""
    a, b, fits = encoded(of, texts)
    links = a.table("a").join(b.table("b"), keys="text_end", join_type="inner", use_threads=False).sort_by([("at_a", "ascending"), ("at_b", "ascending")])
    cut_a, cut_b = (s.cuts(links[f"at_{n}"].to_numpy()) for s, n in ((a, "a"), (b, "b")))
    groups = written_groups(of, a, b, cut_a, cut_b)
    shown = [(hashlib.sha256(g).hexdigest() if digests else bytes(g).decode()) if f else "" for g, f in zip(groups, fits, strict=True)]
    pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), 1 << 32), links["b"].cast(pa.int64())).combine_chunks().dictionary_encode()
    counted = pa.table({"code": pair.indices}).group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
    keys = pair.dictionary.to_numpy(zero_copy_only=False)
    n_links = np.bincount(a.text.take(links["at_a"]).to_numpy(), minlength=len(texts))
    first = lambda x, kind: pa.array([x] + [None] * (len(texts) - 1), pa.list_(kind))
    return {
        "n_a": pa.array(a.count),
        "n_b": pa.array(b.count),
        "n_groups": pa.array(np.bincount(a.text.to_numpy(zero_copy_only=False)[cut_a], minlength=len(texts)).astype(np.int64)),
        "n_links": pa.array(n_links.astype(np.int64)),
        "groups": pa.array(shown, pa.string()),
        "codes": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), pair.indices.cast(pa.int32())),
        "pair_a": first(keys >> 32, pa.int32()),
        "pair_b": first(keys & 0xFFFFFFFF, pa.int32()),
        "pair_n": first(counted["count_all"].to_numpy(), pa.int64()),
    }


def encoded_pieces(docs: DataFrame, path_a: str, path_b: str, digests: bool, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, made, task = tokenizers(path_a, path_b), 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE, "right")), start + 1)
                part = batch.slice(start, stop - start)
                piece = pa.array([(task << 32) + made] * part.num_rows, pa.int64())
                columns = aligned_piece(of, part.column("text").to_pylist(), digests)
                yield pa.RecordBatch.from_arrays([piece, part.column("doc_id"), *columns.values()], names=["piece", "doc_id", *columns])
                start, made = stop, made + 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"piece long, {OUT}, groups string, codes array<int>, pair_a array<int>, pair_b array<int>, pair_n array<bigint>"
    return materialize(rows.mapInArrow(run, schema), "aligned")


def _pairs(pieces: DataFrame, salts: int) -> DataFrame:
    found = pieces.filter("pair_n is not null").select("piece", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("code", "p"))
    return found.select("piece", "code", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"), F.pmod(F.xxhash64("piece"), F.lit(salts)).alias("salt"))


def _totals(pairs: DataFrame) -> DataFrame:
    """a, b, count and whether no other a has more links with b. Pairs are added up by salt first."""
    total = materialize(pairs.groupBy("salt", "a", "b").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = total.groupBy("b").agg(F.max("count").alias("most"))
    return total.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, count, best: how often each pair of ids ends together in all texts, and whether it is the most frequent of b."""
    return _totals(_pairs(encoded_pieces(docs, path_a, path_b, True, id_col, text_col), 1))


def token_alignment(docs: DataFrame, path_a: str, path_b: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b (tokens), n_groups (runs of bytes between ends that both share), n_links (pairs of
    tokens that end together), n_best (links whose pair is linked as often, over all rows, as any of its b), count_sum (how
    often their pairs are linked, over all links), and groups, or its SHA-256 with digests=True.

    a reads a space and the text (special tokens' strings are plain text), b adds the space itself. Null and empty texts, and those that the joined
    bytes of either tokenizer do not give back, have no tokens: zeros, and groups ''. Repeated rows and ids are rows of their own, null ids are kept, an empty table
    gives an empty result, other columns are not looked at. The vocabularies' files must be at their paths on all machines.
    """
    pieces = encoded_pieces(docs, path_a, path_b, digests, id_col, text_col)
    salts = pieces.filter("pair_n is not null").count() // TOGETHER + 1
    pairs = _pairs(pieces, salts)
    by_salt = pairs.select("salt", "a", "b").distinct().join(_totals(pairs), ["a", "b"])
    stats = pairs.join(by_salt, ["salt", "a", "b"]).select(F.col("piece").alias("of_piece"), "code", "count", "best")

    def run(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("code")
        codes = rows["codes"].combine_chunks()
        at = pc.list_flatten(codes)
        sums = {}
        for name, values in (("n_best", counts["best"].cast(pa.int64())), ("count_sum", counts["count"])):
            upto = np.concatenate([[0], np.cumsum(values.take(at).to_numpy())])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False))])
            sums[name] = pa.array(np.diff(upto[ends]).astype(np.int64))
        return pa.table({**{n: rows[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, **sums, "groups": rows["groups"]})

    texts = pieces.select("piece", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes")
    return texts.groupBy("piece").cogroup(stats.groupBy("of_piece")).applyInArrow(run, f"{OUT}, n_best long, count_sum long, groups string")
