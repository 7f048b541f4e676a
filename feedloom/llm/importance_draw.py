"""Importance resampling towards a target distribution.

Runs of words are hashed into buckets. The buckets' counts over all documents and over the target give each bucket a gain (an array of
fixed size); a document's weight is the mean gain of its runs, and Gumbel noise on top of it makes the highest scores a weighted draw
without replacement. The cutoff is found by selection, not by sorting all: each round takes the median key of every partition and
their median weighted by remaining sizes as pivot, which discards at least a quarter of what remains, until the exact cutoff is found; only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.words import word_line
from feedloom.operators.prefix import numbered, ranged
from feedloom.plans.persist import materialize

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10000, 20, 25, 7
#: So many remaining keys are sorted at once.
FEW = 1000
POLYNOMIAL = 0xEDB88320
#: Documents whose words are held as arrays at a time, by characters of their texts.
CHUNK = 1 << 22

KEY = ["less", "no_id", "id", "n_features", "row"]


def _bytewise() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@lru_cache
def _shift_by_power(k: int) -> np.ndarray:
    """Tables (4, 256) that move a CRC over 2^k further bytes: one lookup for each of its bytes."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if k == 0:
        return (values >> 8) ^ _bytewise()[values & 0xFF]
    half = _shift_by_power(k - 1)
    return _look_up(half, half)


def _look_up(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 0xFF] ^ tables[1][(v >> 8) & 0xFF] ^ tables[2][(v >> 16) & 0xFF] ^ tables[3][v >> 24]


@lru_cache(4096)
def shift(n: int) -> np.ndarray:
    """Tables that move a CRC over n further bytes."""
    out = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _look_up(_shift_by_power(k), out)
    return out


def run_buckets(lines: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of words (one space between two): the words of each line, and the bucket and the line of every run of one
    or two words.

    Each distinct word is hashed once; the CRC of a pair is that of its first word and the space, moved over the second word's length, and that of the second word.
    """
    lists = pc.split_pattern(lines, " ")
    counts = np.where(pc.equal(lines, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = pc.list_flatten(lists)
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line = np.repeat(np.arange(len(counts)), counts)
    if not len(at):
        return counts, at, line
    words = flat.dictionary.cast(pa.binary()).to_pylist()
    alone = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    spaced = np.array([zlib.crc32(w + b" ") for w in words], dtype=np.uint32)
    lengths, which = np.unique(np.array([len(w) for w in words]), return_inverse=True)
    tables = np.stack([shift(int(n)) for n in lengths])
    pair = np.flatnonzero(line[1:] == line[:-1])
    first, second = spaced[at[pair]], at[pair + 1]
    of = which[second]
    moved = tables[of, 0, first & 0xFF] ^ tables[of, 1, (first >> 8) & 0xFF] ^ tables[of, 2, (first >> 16) & 0xFF] ^ tables[of, 3, first >> 24]
    hashes = np.concatenate([alone[at], moved ^ alone[second]])
    return counts, (hashes % np.uint32(buckets)).astype(np.int64), np.concatenate([line, line[pair]])


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about CHUNK bytes of lines."""
    ends = np.cumsum(pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, base + CHUNK, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket; a task counts into one array, and Spark adds the arrays up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += np.bincount(run_buckets(part.column("line"), buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["counts"])

    parts = texts.select(word_line(F.col(text_col)).alias("line")).mapInArrow(run, "counts array<bigint>")
    rows = parts.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row per bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of (target share / corpus share)) of each bucket, one more counted everywhere."""
    big, small, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (big + n) / ((s + 1) * (small + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id in thousandths; a null id is spelled null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_documents(docs: DataFrame, gains: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sent.value
        for batch in batches:
            for part in chunks(batch):
                words, bucket, line = run_buckets(part.column("line"), len(values))
                features = words + np.maximum(words - 1, 0)
                sums = np.zeros(len(words), np.int64)
                np.add.at(sums, line, values[bucket])
                weight = np.floor_divide(sums, np.maximum(features, 1))
                ids = part.column("doc_id")
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (words, features, weight, score)]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_line(F.col(text_col)).alias("line"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _after(key: tuple[int, ...]) -> Column:
    """Whether a row's key is past this one; the first column's bound stands apart, for files that can be skipped."""
    return (F.col(KEY[0]) >= key[0]) & (F.struct(*KEY) > F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(KEY, key, strict=True)]))


def _up_to(key: tuple[int, ...]) -> Column:
    return (F.col(KEY[0]) <= key[0]) & (F.struct(*KEY) <= F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(KEY, key, strict=True)]))


def _medians(keys: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """The median key of each task's rows, and how many rows it has: one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in KEY] for b in batches if b.num_rows]
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            n = len(columns[0])
            mid = np.lexsort(columns[::-1])[(n - 1) // 2]
            yield pa.RecordBatch.from_arrays([pa.array([int(c[mid])], pa.int64()) for c in columns] + [pa.array([n], pa.int64())], names=[*KEY, "n"])

    rows = keys.select(*KEY).mapInArrow(run, ", ".join(f"{c} long" for c in [*KEY, "n"])).collect()
    return sorted((tuple(r[c] for c in KEY), r.n) for r in rows)


def cutoff(keys: DataFrame, k: int, n: int, few: int = FEW) -> tuple[int, ...]:
    """The k-th of n distinct keys (columns KEY, ascending; 1 <= k <= n).

    The pivot of a round is the weighted median of the tasks' medians: at least a quarter of the remaining keys lies on either side of it, so the side without
    the cutoff goes. What remains is written anew whenever it has shrunk to half of what is stored, so all rounds together read and write a few times the keys.
    """
    written, left = n, n
    while left > few:
        medians = _medians(keys)
        half, seen = (sum(m for _, m in medians) + 1) // 2, 0
        for pivot, m in medians:
            seen += m
            if seen >= half:
                break
        below = keys.filter(_up_to(pivot)).count()
        if k <= below:
            keys, left = keys.filter(_up_to(pivot)), below
        else:
            keys, left, k = keys.filter(_after(pivot)), left - below, k - below
        if left > few and 2 * left <= written:
            keys, written = materialize(keys, "remaining"), left
    return tuple(keys.select(*KEY).orderBy(*KEY).limit(k).collect()[-1])  # at most `few` rows


def importance_draw(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", few: int = FEW
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, and rank (from 1) if it is drawn.

    percent of the documents with at least least_words words are drawn, rounded down: those of the highest scores, ties to smaller
    ids, a null id last, then to fewer features; rows alike in all of these are drawn in any order. Null and empty texts have no features and weight 0. Repeated rows are rows of
    their own; an empty table gives an empty result, an empty target gains from its added counts alone. Other columns are not looked at.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    keyed = scored_documents(docs, gains, seed, id_col, text_col).withColumns(
        {"less": -F.col("score"), "no_id": F.isnull("doc_id").cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "row": F.monotonically_increasing_id()}
    )
    rows = materialize(keyed, "scored")
    out = ["doc_id", "n_features", "weight", "score"]
    fit = F.col("n_words") >= least_words
    n = rows.filter(fit).count()
    k = percent * n // 100
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = cutoff(rows.filter(fit).select(*KEY), k, n, few)
    order = [F.col(c) for c in KEY]
    won = numbered(ranged(rows.filter(fit & _up_to(last)), order, "winners"), order, "nth")
    lost = rows.filter(~(fit & _up_to(last)))
    return won.select(*out, (F.col("nth") + 1).alias("rank")).unionByName(lost.select(*out, F.lit(None).cast("long").alias("rank")))
