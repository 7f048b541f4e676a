"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts of up to `chunk` characters are one chunk. Longer ones are cut into chunks that overlap, as rows of their own, so
that one long text is pre-tokenised by many tasks at once. A chunk that starts inside a pre-token may split wrongly at
first, but a pre-token depends only on the text from its start on, so from the first boundary that two chains share
they stay together. Stitching walks the chunks of a text in order and changes over at the first boundary that the left
chunk's chain and the right chunk's chain share; where the overlap has none, the left chain is carried on until it meets
the right one. Then each pre-token is encoded by the merge ranks. Decoding concatenates the raw bytes of the ids.

Ids, counts and digests are those of the tiktoken library's encode_ordinary for the same ranks and pattern.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 16384, 256
#: Characters past a pre-token's end that its match can depend on.
LOOKAHEAD = 3
#: Pre-tokens of which the ids are kept from earlier steps, and the longest that are merged side by side; characters encoded at a time.
REMEMBERED, LONGEST, STEP = 1 << 16, 64, 3 << 20
#: White space of Unicode, with the separators that Python's isspace counts too.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space at a text's start or behind white space.
OPEN = f"^ |[{WHITE}] "
#: Pre-tokens merged side by side.
BLOCK = 1 << 13
#: Above every rank.
NONE = (1 << 31) - 1


class Ragged:
    """Lists of ids, one behind the other: list k is ids[bounds[k] : bounds[k + 1]]."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    def take(self, at: np.ndarray) -> Ragged:
        counts = np.diff(self.bounds)[at]
        bounds = np.append(0, np.cumsum(counts))
        return Ragged(self.ids[np.repeat(self.bounds[:-1][at] - bounds[:-1], counts) + np.arange(bounds[-1])], bounds)

    def grouped(self, firsts: np.ndarray) -> Ragged:
        """The lists from each of firsts to the next as one list."""
        return Ragged(self.ids, self.bounds[firsts])

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.ids, other.ids]), np.concatenate([self.bounds, other.bounds[1:] + self.bounds[-1]]))


def joined(column: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The strings between bounds as one, with commas between them; bytes without."""
    between = "," if pa.types.is_large_string(column.type) else b""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), column), pa.scalar(between, column.type))


class Codec:
    """Merge ranks of one vocabulary, and pre-tokens encoded lately. What is encoded is given as its ids, written in
    decimals and joined by commas, and the bytes that they decode to.

    spaces tells that a space behind another character than white space always starts a pre-token, as in patterns whose
    matches hold white space at their start or alone. Then a text may be cut there, and each part (the text between two
    such spaces) has one encoding wherever it stands. Parts and pre-tokens are Arrow columns: each distinct one is
    encoded once, and the ids and bytes of texts are joined from them column by column.
    """

    def __init__(self, path: str, pattern: str, spaces: bool = False):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        raw = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            raw[rank] = piece
        self.raw = pa.array(raw, pa.large_binary())
        self.decimal = pa.array(map(str, range(len(raw))), pa.large_string())
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # pairs of ids whose bytes together have a rank, as one sorted number each
        pairs = {
            self.ranks[piece[:i]] << 32 | self.ranks[piece[i:]]: rank
            for piece, rank in self.ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in self.ranks and piece[i:] in self.ranks
        }
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(-1))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE).astype(np.int32)
        self.pattern, self.spaces = regex.compile(pattern), spaces
        own = Ragged(np.arange(len(raw), dtype=np.int32), np.arange(len(raw) + 1))
        # pre-tokens with their ids, the vocabulary first
        self.known, self.known_ids, self.fixed = self.raw, own, len(raw)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def ids_of(self, pieces: pa.Array) -> Ragged:
        """The ids of different pre-tokens."""
        pieces = pieces.cast(pa.large_binary())
        at = pc.index_in(pieces, value_set=self.known)
        found, new = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), pieces.filter(at.is_null())
        known, before = self.known_ids, len(self.known)
        if len(new):
            merged = self.merge_all(new)
            known = known + merged
            found[at.is_null().to_numpy(zero_copy_only=False)] = before + np.arange(len(new))
            kept = np.arange(max(self.fixed, before + len(new) - REMEMBERED), before + len(new))
            column = pa.concat_arrays([self.known, new])
            self.known = pa.concat_arrays([self.raw, column.take(pa.array(kept))])
            self.known_ids = known.take(np.append(np.arange(self.fixed), kept))
        return known.take(found)

    def merge_all(self, pieces: pa.Array) -> Ragged:
        """Each pre-token encoded: the pair of lowest rank merges first, the leftmost of equals; pieces of like sizes
        go on side by side, one merge of each at a time."""
        starts = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, sizes = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(starts)
        rows, lists, counts = [], [], np.zeros(len(pieces), np.int64)
        low, width = 0, 8
        while width <= LONGEST:
            now = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(now), BLOCK):
                some = now[k : k + BLOCK]
                spread = np.minimum(starts[some][:, None] + np.arange(width), len(data) - 1)
                ids, counts[some] = self.merge_short(self.byte[data[spread]], sizes[some])
                rows.append(some)
                lists.append(ids[np.arange(width) < counts[some][:, None]])
            low, width = width, width * 2
        for i in np.flatnonzero(sizes > low).tolist():
            ids = self.merge_long(data[starts[i] : starts[i + 1]].tobytes())
            counts[i] = len(ids)
            rows.append(np.array([i]))
            lists.append(np.array(ids, np.int32))
        order = np.concatenate(rows)
        merged = Ragged(np.concatenate(lists), np.append(0, np.cumsum(counts[order])))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return merged.take(back)

    def merge_short(self, ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a pre-token a row, the ids of its bytes, of which the first left count. Rows and counts after all merges."""
        ids, counts, left = ids.astype(np.int32), left.copy(), left.copy()
        out, row = ids.copy(), np.arange(len(ids))
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(ids.shape[1] - 1) >= left[:, None] - 1] = NONE
        while len(row):
            here = np.arange(len(row))
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            least = ranks[here, at] if ranks.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():
                ended = row[done]
                out[ended, : ids.shape[1]], counts[ended] = ids[done], left[done]
                go = ~done
                row, ids, left, ranks, at, least = row[go], ids[go], left[go], ranks[go], at[go], least[go]
                if not len(row):
                    break
            # the merged token's id is its rank; what stands behind moves up
            left, here, column = left - 1, np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[here, at] = least
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            column = column[:-1]
            ranks = np.where(column < at[:, None], ranks[:, :-1], ranks[:, 1:])
            before, behind = np.flatnonzero(at > 0), np.flatnonzero(at < left - 1)
            ranks[before, at[before] - 1] = self.pair_rank(ids[before, at[before] - 1], least[before])
            ranks[behind, at[behind]] = self.pair_rank(least[behind], ids[behind, at[behind] + 1])
        return out, counts

    def merge_long(self, data: bytes) -> list[int]:
        """A heap of pairs over a linked list: n log n."""
        ranks, n = self.ranks, len(data)
        end, left, right, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (rank := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := right[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], right[i] = stop, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def encode_parts(self, parts: list[str], behind: str = " ") -> Ragged:
        """The ids of each part, which stands behind a space, or behind nothing."""
        # parts that nothing about the next one can change are read as one text
        plain = np.array([behind != "" and p != "" and p[-1] not in WHITE for p in parts], bool)
        some = [p for p, z in zip(parts, plain.tolist(), strict=True) if z]
        text = "".join([" " + p for p in some])
        pieces = self.pattern.findall(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        counts = np.zeros(len(parts), np.int64)
        if len(text) != (ends[-1] if len(ends) else 0):
            # the pattern leaves characters out
            plain[:], some, pieces = False, [], []
        else:
            stops = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            counts[plain] = np.diff(np.searchsorted(ends, stops, "right"), prepend=0)
        split = [self.pattern.findall(behind + parts[i]) for i in np.flatnonzero(~plain).tolist()]
        counts[~plain] = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array(chain(pieces, chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        ids = self.ids_of(coded.dictionary).take(coded.indices.to_numpy(zero_copy_only=False))
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return ids.grouped(np.append(0, np.cumsum(counts[order]))).take(back)

    def columns(self, lists: Ragged) -> tuple[pa.Array, pa.Array]:
        """Decimals and bytes of each list of ids."""
        ids = pa.array(lists.ids)
        return joined(self.decimal.take(ids), lists.bounds), joined(self.raw.take(ids), lists.bounds)

    def encode_pieces(self, pieces: pa.Array) -> tuple[str, bytes]:
        """The pre-tokens of one text, encoded."""
        return self.encode_spans(pieces, np.array([0, len(pieces)]))[0]

    def encode_spans(self, pieces: pa.Array, bounds: np.ndarray) -> list[tuple[str, bytes]]:
        """Texts encoded, of which the pre-tokens stand between bounds."""
        coded = pieces.dictionary_encode()
        ids, raw = self.columns(self.ids_of(coded.dictionary))
        return list(zip(*[joined(c.take(coded.indices), bounds).to_pylist() for c in (ids, raw)], strict=True))

    def encode_words(self, words: pa.Array, bounds: np.ndarray) -> list[pa.Array]:
        """Ids and bytes of the texts of which the parts stand between bounds."""
        heads = words.take(pa.array(bounds[:-1])).to_pylist()
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False).copy()
        at[bounds[:-1]] = len(coded.dictionary) + np.arange(len(heads))
        lists = self.encode_parts(coded.dictionary.to_pylist()) + self.encode_parts(heads, "")
        return [joined(c.take(pa.array(at)), bounds) for c in self.columns(lists)]

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[str, bytes]]:
        """Each text encoded; texts of about STEP characters at a time."""
        texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)) // STEP
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some = texts.slice(a, b - a)
            plain = pc.invert(pc.match_substring_regex(some, OPEN)).to_numpy(zero_copy_only=False) & self.spaces
            rest = [self.cut(t) for t in some.filter(pa.array(~plain)).to_pylist()]
            split = pc.split_pattern(some.filter(pa.array(plain)), " ")
            groups = []
            if len(split):
                offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
                words = split.flatten()
                groups.append((np.flatnonzero(plain), self.encode_words(words, offsets)))
            if rest:
                offsets = np.cumsum([0, *map(len, rest)])
                words = pa.array(list(chain.from_iterable(rest)), pa.large_string())
                groups.append((np.flatnonzero(~plain), self.encode_words(words, offsets)))
            found: list[tuple[str, bytes]] = [("", b"")] * (b - a)
            for at, (ids, raw) in groups:
                for i, x, y in zip(at.tolist(), ids.to_pylist(), raw.to_pylist(), strict=True):
                    found[i] = x, y
            yield from found

    def cut(self, text: str) -> list[str]:
        """text up to its first cut, and each later part without the space that starts it; text may have spaces behind
        white space, which are no cuts: the parts beside them belong together."""
        if not self.spaces:
            return [text]
        first, *others = text.split(" ")
        joined = [first]
        for part in others:
            if not joined[-1] or joined[-1][-1] in WHITE:
                joined[-1] += " " + part
            else:
                joined.append(part)
        return joined

    def starts(self, text: str, base: int = 0, last: bool = True) -> np.ndarray:
        """Where pre-tokens start, shifted by base; without those that text beyond this one could move, unless last."""
        lengths = np.fromiter(map(len, self.pattern.findall(text)), np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        if not last:
            # the first pre-token whose match may have seen the cut still starts rightly
            begins = begins[: int(np.searchsorted(ends, len(text) - LOOKAHEAD, "right")) + 1]
        return begins + base


_codecs: dict[tuple[str, str, bool], Codec] = {}


def codec(path: str, pattern: str, spaces: bool = False) -> Codec:
    """The vocabulary, read once per Python worker."""
    if (path, pattern, spaces) not in _codecs:
        _codecs[path, pattern, spaces] = Codec(path, pattern, spaces)
    return _codecs[path, pattern, spaces]


def stitch(text: str, size: int, chains: list[np.ndarray], own: Codec, overlap: int) -> np.ndarray:
    """The starts of text's pre-tokens, from those of its chunks (chunk k begins at k * size)."""
    done, current, k = [], chains[0], 0
    while k + 1 < len(chains):
        nxt, begin = chains[k + 1], (k + 1) * size
        shared = np.intersect1d(current[current >= begin], nxt, assume_unique=True)
        if not len(shared):
            # no common boundary in the overlap: carry the left chain on from its last sure boundary
            here, reach = int(current[-1]), overlap
            while not len(shared):
                reach *= 2
                over = here + reach >= len(text)
                more = own.starts(text[here : here + reach], here, over)
                shared = np.intersect1d(more[more >= begin], nxt, assume_unique=True)
                if over and not len(shared):
                    break
            current = np.concatenate([current[:-1], more])
            if not len(shared):
                done.append(current)
                return np.concatenate(done)
        done.append(current[current < shared[0]])
        current, k = nxt[nxt >= shared[0]], k + 1
        if not len(current):
            current = shared[:1]
    done.append(current)
    return np.concatenate(done)


def pieces_at(text: str, starts: np.ndarray) -> pa.Array:
    """The pre-tokens of text that start at starts."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))
    offsets = first[np.append(starts, len(text))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def whole_texts(batches: Iterable[pa.RecordBatch], chunk: int, overlap: int, own: Codec) -> Iterator[tuple[int | None, int, str, np.ndarray]]:
    """Id, repeats, text and starts of pre-tokens of each text, of which the chunks come in order, repeated ones side by side."""
    key, parts, chains, repeats = None, [], [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "sha", "k", "part", "starts")]
        for i in range(batch.num_rows):
            doc_id, sha, k = (c[i].as_py() for c in columns[:3])
            if (doc_id, sha) != key:
                if key is not None:
                    yield key[0], repeats, (text := "".join(parts)), stitch(text, chunk, chains, own, overlap)
                key, parts, chains, repeats = (doc_id, sha), [], [], 0
            if k == len(parts):
                parts.append(columns[3][i].as_py())
                chains.append(np.frombuffer(columns[4][i].as_py(), "<i4") + np.int64(k * chunk))
            repeats += k == 0
    if key is not None:
        yield key[0], repeats, (text := "".join(parts)), stitch(text, chunk, chains, own, overlap)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: str, raw: bytes) -> tuple[int, str, str]:
    return ids.count(",") + (ids != ""), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _ids(ids: str, raw: bytes) -> tuple[int, list[int], bytes]:
    listed = list(map(int, ids.split(","))) if ids else []
    return len(listed), listed, raw


IDS_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, spaces: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, decoded bytes; with digests, the SHA-256 of the ids joined by
    commas and of the decoded bytes instead. spaces=True is for patterns without matches that hold a space behind
    another character than white space, and only faster (see Codec).

    Null and empty texts have no tokens. Repeated rows each give their row; null ids are kept. An empty table gives an
    empty result. Other columns, whatever their names, are not looked at. A lone surrogate cannot occur in Spark strings.
    """
    schema, finish = (SCHEMA, _digests) if digests else (IDS_SCHEMA, _ids)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def batch_of(ids: list[int | None], found: Iterable[tuple[str, bytes]]) -> pa.RecordBatch:
        out = [finish(*x) for x in found]
        columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, spaces)
        for batch in batches:
            yield batch_of(batch.column("doc_id"), own.encode_texts(batch.column("text")))

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, spaces)
        for batch in batches:
            starts, parts = [], []
            for part, last in zip(batch.column("part"), batch.column("last").to_pylist(), strict=True):
                text = part.as_py()
                starts.append(own.starts(text, 0, last).astype("<i4").tobytes())
                parts.append(text if last else text[:chunk])
            keys = [batch.column(c) for c in ("doc_id", "sha", "k")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(parts, pa.string()), pa.array(starts, pa.binary())], names=["doc_id", "sha", "k", "part", "starts"])

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, spaces)
        held, size = [], 0

        def encoded() -> pa.RecordBatch:
            bounds = np.append(0, np.cumsum([len(pieces) for _, _, pieces in held]))
            found = own.encode_spans(pa.concat_arrays([pieces for _, _, pieces in held]), bounds)
            return batch_of(*zip(*[(i, x) for (i, n, _), x in zip(held, found, strict=True) for _ in range(n)], strict=True))

        for doc_id, repeats, text, at in whole_texts(batches, chunk, overlap, own):
            held.append((doc_id, repeats, pieces_at(text, at)))
            size += len(text)
            if size >= STEP:
                yield encoded()
                held, size = [], 0
        if held:
            yield encoded()

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, schema)
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    chunks = (
        rows.filter(F.length("text") > chunk)
        .withColumn("sha", F.sha2("text", 256))
        .select("doc_id", "sha", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
        .select("doc_id", "sha", "k", (F.col("k") == F.col("n") - 1).alias("last"), F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("part"))
    )
    spread = chunks.repartition("doc_id", "sha", "k")
    cut = spread.mapInArrow(pre_tokenise, "doc_id long, sha string, k int, part string, starts binary")
    long = cut.repartition("doc_id", "sha").sortWithinPartitions("doc_id", "sha", "k").mapInArrow(join_up, schema)
    return short.unionByName(long)
