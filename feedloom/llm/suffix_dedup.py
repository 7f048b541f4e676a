"""Removal of repeated byte strings with suffix arrays.

Every string of K bytes (a window) has a minimizer: the GRAM-byte part of it whose hash is least, the leftmost of equals.
It depends on nothing but the window, so all copies of a window meet where their minimizer's bucket is handled, and a
document is sent as the spans of neighbouring windows that share one (at most 2 * K - GRAM bytes each).

1. Blocks of documents send each distinct minimizer hash once; buckets tell each block which of its hashes at least two
   documents have (only those can hold a repeated window), and which HOT documents or more have.
2. Blocks send each distinct span of those hashes once, with the least document id that has it in the block. A hot
   minimizer's spans are sent window by window, each by its own hash: what stands around a string that a third of all
   documents share differs from one to the next, and so it is spread over all buckets.
3. In a bucket, windows whose hash occurs once belong to one span. What is left of the spans is sorted in suffix arrays,
   one for each minimizer: equal windows stand side by side and get the least document id that has one of them. A suffix
   array is built by linear grouping (below). A bucket's keys are taken in parts of about PART bytes. Buckets reply to
   each block about its own spans, in the order sent.
4. Blocks mark the bytes of every window that a document with a smaller id has too.

Spans are taken as one only if their bytes are equal, not just their hashes. Blocks are made of about as many bytes each
and do not grow beyond MOST_BLOCK, so a task's memory stays the same from 2 GB of text on: more text makes more blocks;
a message holds all that a block has for a bucket, so their number stays below that of distinct minimizers. The text is
shuffled once, to its block, and that shuffle serves steps 1, 2 and 4.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.textbytes import mix

K, GRAM = 50, 24
#: Bytes of a block: this share of all bytes, but between these bounds. Documents from which on a minimizer is hot (of
#: those of one block, 255 count at most), so that its spans may take a megabyte.
SHARE, LEAST_BLOCK, MOST_BLOCK, HOT = 256, 1 << 20, 8 << 20, 1 << 14
#: Bytes of texts, and of a bucket's spans, that are handled at a time.
STEP, PART = 1 << 19, 1 << 20
#: Characters from which on a suffix array is built in arrays.
LONG = 1 << 17
LAST = (1 << 63) - 1
PLACE = np.uint64(24)  # bits of a position inside a step; the rest of 64 is the hash
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
UNKNOWN = -2


def suffix_array(text: list[int]) -> Sequence[int]:
    """Suffixes of text in order, in linear steps; text ends with its only 0, the least value, and has small values.

    First, suffixes are grouped by their longest Lyndon prefix: groups start as equal first characters and are taken
    from the highest down. For each member, the nearest place to the left that is in a lower group (found along the
    previous-smaller pointers of those already seen) has its prefix extended by this group's: places that extend more
    often move to higher groups right above what is left of their own. Then each group's order is emitted: going up the
    result, the suffixes that end where the current one starts are the next free ones of their groups.
    """
    n = len(text)
    symbols = np.array(text, np.int32)
    sort = np.argsort(symbols, kind="stable")
    starts = np.flatnonzero(np.diff(symbols[sort], prepend=-1))
    counts = np.diff(np.append(starts, n))
    # lists are faster, arrays of a long text take a quarter of their memory
    row = (lambda x: array("i", x.astype(np.int32).tobytes())) if n > LONG else np.ndarray.tolist
    where, first, sizes = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    where[sort], first[sort], sizes[starts] = np.arange(n), np.repeat(starts, counts), counts
    order, at, group, size = row(sort), row(where), row(first), row(sizes)
    before = row(np.full(n, UNKNOWN))
    end = n
    while end > 0:
        start = group[order[end - 1]]
        times: dict[int, int] = {}
        for member in order[start:end]:
            i, waiting = member, []
            if before[i] != UNKNOWN:
                j = before[i]
            else:
                j = i - 1
                while True:
                    while j >= 0 and group[j] >= start and before[j] != UNKNOWN:
                        j = before[j]
                    if j >= 0 and group[j] >= start:
                        # another member of this group, whose pointer comes first
                        waiting.append(i)
                        i, j = j, j - 1
                        continue
                    before[i] = j
                    if not waiting:
                        break
                    i = waiting.pop()
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[int, list[list[int]]] = {}
        for p, k in times.items():
            by_times = moved.setdefault(group[p], [])
            while len(by_times) < k:
                by_times.append([])
            by_times[k - 1].append(p)
        for g, by_times in moved.items():
            slot = g + size[g]
            for places in reversed(by_times):
                if not places:
                    continue
                for p in places:
                    slot -= 1
                    q, a = order[slot], at[p]
                    order[a], at[q], order[slot], at[p] = q, a, p, slot
                size[g] -= len(places)
                size[slot] = len(places)
                for p in places:
                    group[p] = slot
        end = start
    free, done, out = row(np.arange(n)), bytearray(n), row(np.zeros(n, np.int64))
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = before[j]
    return out


def least_owners(spans: list[bytes], owners: list[int]) -> list[list[int]]:
    """For each window of each span, the least owner of a span that has it."""
    text: list[int] = []
    own: list[int] = []
    for i, s in enumerate(spans):
        text.extend(b + 2 for b in s)
        text.append(1)
        own.extend([i] * (len(s) + 1))
    text.append(0)
    begins, total = [], 0
    for s in spans:
        begins.append(total)
        total += len(s) + 1
    out = [[0] * (len(s) - K + 1) for s in spans]
    alike: list[tuple[int, int]] = []
    window = b""

    def close() -> None:
        least = min(owners[i] for i, _ in alike)
        for i, o in alike:
            out[i][o] = least

    for p in suffix_array(text):
        if p >= total:
            continue
        i = own[p]
        o = p - begins[i]
        if o + K > len(spans[i]):
            continue
        here = spans[i][o : o + K]
        if here != window:
            if alike:
                close()
            alike, window = [], here
        alike.append((i, o))
    if alike:
        close()
    return out


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        _tables["up"] = np.cumprod(np.full(n, FACTOR, np.uint64))
        _tables["down"] = np.cumprod(np.full(n, INVERSE, np.uint64))
    return _tables["up"][:n], _tables["down"][:n]


def content_hash(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of data[at:stop] for each pair, wherever in data it is."""
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    return mix((total[stop] - total[at]) * down[at] + (stop - at).astype(np.uint64))


def ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


def unlike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] differ, for each of some pairs; no size is 0."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1 << 15):
        n = size[k : k + (1 << 15)]
        one, other = data[ranges(a[k : k + (1 << 15)], n)], data[ranges(b[k : k + (1 << 15)], n)]
        out[k : k + (1 << 15)] = np.logical_or.reduceat(one != other, np.cumsum(n) - n)
    return out


def firsts(data: np.ndarray, at: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of strings in an order, whether each differs from the one before in a key or in its bytes."""
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = size[1:] != size[:-1]
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        again = np.flatnonzero(~new)
        new[again] = unlike(data, at[again - 1], at[again], size[again])
    return new


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places is in one of the ranges begin:end."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    apart = np.flatnonzero(begin[1:] > reach[:-1])
    edge = np.zeros(n + 1, np.int8)
    if len(begin):
        edge[begin[np.append(0, apart + 1)]] = 1
        edge[reach[np.append(apart, len(begin) - 1)]] = -1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def packed(ids: np.ndarray) -> bytes:
    """Ids in four bytes each where they fit, else in eight; the first byte tells."""
    small = not len(ids) or (ids.min() >= 0 and ids.max() < 1 << 32)
    return (b"\4" + ids.astype("<u4").tobytes()) if small else (b"\10" + ids.astype("<i8").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<i8", offset=1).astype(np.int64)


def power(n: int) -> np.uint64:
    return np.uint64(pow(FACTOR, n, 1 << 64))


class Spans:
    """Spans of some pieces of text: piece, begin in the piece, windows, minimizer hash (40 bits)."""

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.data, self.ends = data, np.cumsum(sizes)
        n = len(data)
        if n < K:
            self.piece = self.begin = self.windows = self.at = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        h = data.astype(np.uint64) + np.uint64(1)
        width, eight = 1, h
        while width < 16:
            h = h[:-width] * power(width) + h[width:]
            width *= 2
            if width == 8:
                eight = h
        h = h[: n - GRAM + 1] * power(8) + eight[16 : 16 + n - GRAM + 1]
        v = (mix(h) >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64)
        reach, width = K - GRAM + 1, 1
        while width * 2 <= reach:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        if width < reach:
            v = np.minimum(v[: n - K + 1], v[reach - width : reach - width + n - K + 1])
        whole = np.arange(K, n + 1) <= np.repeat(self.ends, sizes)[: n - K + 1]
        first = whole.copy()
        first[1:] &= (v[1:] != v[:-1]) | ~whole[:-1]
        at = np.flatnonzero(first)
        self.windows = np.bincount(np.cumsum(first)[whole] - 1, minlength=len(at)) if len(at) else np.zeros(0, np.int64)
        self.at = at
        self.piece = np.searchsorted(self.ends, at, "right")
        self.begin = at - (self.ends - sizes)[self.piece]
        self.key = v[at] >> PLACE


def pieces_of(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in steps of about STEP bytes; longer texts in pieces that overlap by K - 1 bytes."""
    step, size = [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(len(t) - K + 1, 1), STEP):
            piece = t[o : o + STEP + K - 1]
            step.append((i, o, piece))
            size += len(piece)
            if size >= STEP:
                yield step
                step, size = [], 0
    if step:
        yield step


@dataclass
class Units:
    """The strings that a block sends, sorted by bucket, key and bytes; of is each one's number among the distinct ones."""

    data: np.ndarray  # the block's texts
    ends: np.ndarray  # of each text
    text: np.ndarray
    at: np.ndarray
    size: np.ndarray
    key: np.ndarray
    owner: np.ndarray
    new: np.ndarray  # first of its kind, with the least owner
    of: np.ndarray


def block_units(texts: list[bytes], owners: np.ndarray, wanted: np.ndarray, hot: np.ndarray, low: np.uint64) -> Units:
    """Spans of the wanted minimizers (sorted); windows instead where a minimizer is hot."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    begins = ends - np.fromiter(map(len, texts), np.int64, len(texts))
    found: list[tuple[np.ndarray, ...]] = []
    for step in pieces_of(texts) if len(wanted) else ():
        s = Spans([p for _, _, p in step])
        place = np.minimum(np.searchsorted(wanted, s.key), len(wanted) - 1)
        take = wanted[place] == s.key
        where = np.array([begins[i] + o for i, o, _ in step], np.int64)
        of = np.array([i for i, _, _ in step], np.int64)
        cold, split = np.flatnonzero(take & ~hot[place]), np.flatnonzero(take & hot[place])
        n = s.windows[split]
        at = np.concatenate([s.at[cold], ranges(s.at[split], n)])
        size = np.concatenate([s.windows[cold] + K - 1, np.full(n.sum(), K)])
        content = content_hash(s.data, at, at + size)
        key = np.concatenate([s.key[cold], content[len(cold) :] >> PLACE])
        piece = np.concatenate([s.piece[cold], np.repeat(s.piece[split], n)])
        begin = np.concatenate([s.begin[cold], ranges(s.begin[split], n)])
        found.append((of[piece], where[piece] + begin, size, key, content))
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    text, at, size, key, content = (np.concatenate(x) for x in zip(none, *found, strict=True))
    found.clear()
    owner = owners[text]
    order = np.lexsort((owner, content, key, key & low))
    text, at, size, key, content, owner = (x[order] for x in (text, at, size, key, content, owner))
    new = firsts(data, at, size, key, content)
    return Units(data, ends, text, at, size, key, owner, new, np.cumsum(new) - 1)


def window_owners(data: bytes, at: np.ndarray, size: np.ndarray, key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window of distinct spans (sorted by key), the least owner of a span of that key that has it."""
    view = np.frombuffer(data, np.uint8)
    n = size - K + 1
    out = np.repeat(owner, n)
    alone = np.ones(len(key), bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    many = np.flatnonzero(~alone)
    if not len(many):
        return out
    # windows of keys with several spans: their place in data and in out, and the number of their span
    begin, place = ranges(at[many], n[many]), ranges((np.cumsum(n) - n)[many], n[many])
    span = np.repeat(many, n[many])
    group = np.cumsum(np.diff(key[many], prepend=key[many[:1]]) != 0)[np.cumsum(np.diff(span, prepend=span[:1]) != 0)]
    hashes = content_hash(view, begin, begin + K)
    order = np.lexsort((hashes, group))
    again = np.zeros(len(order), bool)
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    again[order[1:]] |= same
    again[order[:-1]] |= same
    # runs of windows that may be repeated are what the suffix arrays get, each distinct one once
    starts = np.flatnonzero(again & (np.diff(span, prepend=-1) != 0) | again & ~np.concatenate([[False], again[:-1]]))
    if not len(starts):
        return out
    length = np.diff(np.append(np.cumsum(again)[starts] - 1, again.sum()))
    a, b, g, least = begin[starts], length + K - 1, group[starts], owner[span[starts]]
    content = content_hash(view, a, a + b)
    order = np.lexsort((least, content, g))
    new = firsts(view, a[order], b[order], g[order], content[order])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    one = order[new]
    found: list[list[int]] = []
    cuts = [*np.flatnonzero(np.diff(g[one], prepend=-1)).tolist(), len(one)]
    begin_list, size_list, least_list = a[one].tolist(), b[one].tolist(), least[one].tolist()
    for x, y in zip(cuts, cuts[1:], strict=False):
        if y - x == 1:  # nothing to sort
            found.append(least_list[x:y] * (size_list[x] - K + 1))
        else:
            found += least_owners([data[begin_list[i] : begin_list[i] + size_list[i]] for i in range(x, y)], least_list[x:y])
    flat = np.array([m for f in found for m in f], np.int64)
    first = np.cumsum(length[one]) - length[one]
    out[place[again]] = flat[ranges(first[of], length)]
    return out


def run_owners(key: np.ndarray, own: np.ndarray, size: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans that stand one after another in spans: how many runs of windows with one least owner each has, and the
    runs' lengths and owners. Keys are taken in parts of about PART bytes of spans, so no more is worked on at a time."""
    order = np.argsort(key, kind="stable")
    at = np.cumsum(size, dtype=np.int64) - size
    before = np.cumsum(size[order], dtype=np.int64) - size[order]
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    part = before[first][np.cumsum(first) - 1] // PART
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    runs, lengths, owners = np.zeros(len(key), np.uint8), [], []
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        some = order[x:y]
        n_bytes = size[some].astype(np.int64)
        data = spans[ranges(at[some], n_bytes)]
        begin = np.cumsum(n_bytes) - n_bytes
        content = content_hash(data, begin, begin + n_bytes)
        sort = np.lexsort((own[some], content, key[some]))
        new = firsts(data, begin[sort], n_bytes[sort], key[some][sort], content[sort])
        of = np.empty(len(sort), np.int64)
        of[sort] = np.cumsum(new) - 1
        one = sort[new]
        n = n_bytes[one] - K + 1
        least = window_owners(data.tobytes(), begin[one], n_bytes[one], key[some][one], own[some][one])
        span = np.repeat(np.arange(len(one)), n)
        turn = np.flatnonzero((np.diff(least, prepend=least[:1]) != 0) | (np.diff(span, prepend=-1) != 0))
        count = np.bincount(span[turn], minlength=len(one))
        each = ranges((np.cumsum(count) - count)[of], count[of])
        runs[some] = count[of]
        lengths.append(np.diff(np.append(turn, len(least)))[each].astype(np.uint8))
        owners.append(least[turn][each])
    # back from the order of the keys to that of the spans
    start = np.empty(len(order), np.int64)
    start[order] = np.cumsum(runs[order], dtype=np.int64) - runs[order]
    each = ranges(start, runs.astype(np.int64))
    return runs, np.concatenate(lengths)[each], np.concatenate(owners)[each]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, block: int | None = None, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, and kept (the bytes left) or, with digests, kept_sha256.

    A byte goes if a K-byte string over it also starts in a document with a smaller id; null ids come last and rows of one
    id do not count against each other. Null and empty texts are empty. Repeated rows each give their row; other columns
    are not looked at; an empty table gives an empty result. block is the bytes of a block, hot the number of documents from
    which on a minimizer is hot; they do not change the result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (block or min(max(total // SHARE, LEAST_BLOCK), MOST_BLOCK))))
    buckets = 1 << max(8, int(blocks - 1).bit_length())
    bits, low = np.uint64(buckets.bit_length() - 1), np.uint64(buckets - 1)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))

    def per_bucket(key: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Bucket and slice of sorted keys' rows; key is sorted by bucket."""
        bucket = (key & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            if b > a:
                yield int(bucket[a]), slice(a, b)

    def block_rows(table: pa.Table) -> tuple[list[int | None], list[bytes], np.ndarray]:
        """Ids, texts and owners of a block, in an order of their own."""
        both = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        return [x[0] for x in both], [x[1] for x in both], np.array([LAST if x[0] is None else x[0] for x in both], np.int64)

    def send_keys(table: pa.Table) -> pa.Table:
        """Each distinct minimizer hash of a block, and how many of its documents have it, 255 at most."""
        found = []
        for step in pieces_of(table["text"].to_pylist()):
            s = Spans([p for _, _, p in step])
            of = np.array([i for i, _, _ in step], np.uint64)[s.piece]
            found.append(np.unique(s.key << PLACE | of))
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        key, times = np.unique(pair >> PLACE, return_counts=True)
        order = np.lexsort((key, key & low))
        key, times = key[order], times[order]
        out = [(b, (key[s] >> bits).astype("<u4").tobytes(), np.minimum(times[s], 255).astype(np.uint8).tobytes()) for b, s in per_bucket(key)]
        return pa.table(
            {
                "bucket": pa.array([o[0] for o in out], pa.int64()),
                "block": pa.array([table["block"][0].as_py()] * len(out), pa.int64()),
                "keys": pa.array([o[1] for o in out], pa.binary()),
                "times": pa.array([o[2] for o in out], pa.binary()),
            }
        )

    def shared_keys(table: pa.Table) -> pa.Table:
        """The hashes of each block that two documents have, and whether they are hot."""
        keys = [np.frombuffer(k, "<u4") for k in table["keys"].to_pylist()]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(back, np.frombuffer(b"".join(table["times"].to_pylist()), np.uint8))
        shared = times > 1
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = [(k[f].tobytes(), h[f].tobytes()) for k, f, h in zip(keys, np.split(shared[back], cuts), np.split((times >= hot)[back], cuts), strict=True)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "keys": pa.array([o[0] for o in out], pa.binary()), "hot": pa.array([o[1] for o in out], pa.binary())})

    def send_spans(docs_: pa.Table, shared: pa.Table) -> pa.Table:
        """Each distinct string of a block in a shared bucket, with its least owner; and, to itself, what was shared."""
        none = np.zeros(0, np.uint64)
        wanted = np.concatenate([none, *(np.frombuffer(k, "<u4").astype(np.uint64) << bits | np.uint64(b) for b, k in zip(shared["bucket"].to_pylist(), shared["keys"].to_pylist(), strict=True))])
        hot_ = np.frombuffer(b"".join(shared["hot"].to_pylist()), bool)
        order = np.argsort(wanted)
        wanted, hot_ = wanted[order], hot_[order]
        block_ = (docs_ if docs_.num_rows else shared)["block"][0].as_py()
        _, texts, owners = block_rows(docs_)
        u = block_units(texts, owners, wanted, hot_, low)
        data = u.data.tobytes()
        key, own, size, at = (x[u.new] for x in (u.key, u.owner, u.size, u.at))
        out = [(-1 - block_, wanted.astype("<u8").tobytes(), b"", hot_.tobytes(), b"")]
        for b, s in per_bucket(key):
            listed = b"".join([data[a : a + n] for a, n in zip(at[s].tolist(), size[s].tolist(), strict=True)])
            out.append((b, (key[s] >> bits).astype("<u4").tobytes(), packed(own[s]), size[s].astype(np.uint8).tobytes(), listed))
        return pa.table(
            {
                "bucket": pa.array([o[0] for o in out], pa.int64()),
                "block": pa.array([block_] * len(out), pa.int64()),
                **{c: pa.array([o[i] for o in out], pa.binary()) for i, c in enumerate(("key", "owner", "size", "data"), 1)},
            }
        )

    def reply(table: pa.Table) -> pa.Table:
        """For each block's strings, runs of windows with one least owner."""
        if (bucket := table["bucket"][0].as_py()) < 0:  # what the block sent to itself
            return pa.table({"block": table["block"], "bucket": table["bucket"], "runs": table["key"], "length": table["size"], "owner": table["owner"]})
        keys = [np.frombuffer(x, "<u4") for x in table["key"].to_pylist()]
        runs, length, owner_ = run_owners(
            np.concatenate(keys),
            np.concatenate([unpacked(x) for x in table["owner"].to_pylist()]),
            np.frombuffer(b"".join(table["size"].to_pylist()), np.uint8),
            np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8),
        )
        last, out = np.concatenate([[0], np.cumsum(runs, dtype=np.int64)]), []
        ends = np.cumsum([len(k) for k in keys])
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out.append((runs[a:b].tobytes(), length[last[a] : last[b]].tobytes(), packed(owner_[last[a] : last[b]])))
        return pa.table({"block": table["block"], "bucket": pa.array([bucket] * len(out), pa.int64()), **{c: pa.array([o[i] for o in out], pa.binary()) for i, c in enumerate(("runs", "length", "owner"))}})

    def remove(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        """Mark what smaller ids have, and give what is left."""
        replies = replies.sort_by("bucket")
        bucket = replies["bucket"].to_pylist()
        columns = [replies[c].to_pylist() for c in ("runs", "length", "owner")]
        wanted, hot_ = np.frombuffer(columns[0][0], "<u8"), np.frombuffer(columns[1][0], bool)
        assert bucket[0] < 0 and all(b >= 0 for b in bucket[1:])
        runs = np.frombuffer(b"".join(columns[0][1:]), np.uint8).astype(np.int64)
        length = np.frombuffer(b"".join(columns[1][1:]), np.uint8).astype(np.int64)
        owner_ = np.concatenate([np.zeros(0, np.int64), *map(unpacked, columns[2][1:])])
        ids_, texts, owners = block_rows(docs_)
        u = block_units(texts, owners, wanted, hot_, low)
        first_run = np.cumsum(runs) - runs
        along = np.cumsum(length) - length  # where a run begins inside its string
        each = runs[u.of]
        run, unit = ranges(first_run[u.of], each), np.repeat(np.arange(len(u.of)), each)
        later = np.flatnonzero(owner_[run] < u.owner[unit])
        run, unit = run[later], unit[later]
        begin = u.at[unit] + along[run] - along[first_run[u.of[unit]]]
        gone = covered(begin, begin + length[run] + K - 1, len(u.data))
        removed, spans, kept = [], [], []
        for t, end in zip(texts, u.ends.tolist(), strict=True):
            own, left = gone[end - len(t) : end], t
            removed.append(int(own.sum()))
            spans.append(int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum()))
            if removed[-1]:
                left = np.frombuffer(t, np.uint8)[~own].tobytes()
            kept.append(hashlib.sha256(left).hexdigest() if digests else left)
        return pa.table(
            {
                "doc_id": pa.array(ids_, pa.int64()),
                "n_bytes": pa.array(list(map(len, texts)), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256" if digests else "kept": pa.array(kept, pa.string() if digests else pa.binary()),
            }
        )

    by_block = placed.groupBy("block")
    sent = by_block.applyInArrow(send_keys, "bucket long, block long, keys binary, times binary")
    shared = sent.groupBy("bucket").applyInArrow(shared_keys, "block long, bucket long, keys binary, hot binary")
    spans = by_block.cogroup(shared.groupBy("block")).applyInArrow(
        send_spans, "bucket long, block long, key binary, owner binary, size binary, data binary"
    )
    replies = spans.groupBy("bucket").applyInArrow(reply, "block long, bucket long, runs binary, length binary, owner binary")
    last = "kept_sha256 string" if digests else "kept binary"
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(remove, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
