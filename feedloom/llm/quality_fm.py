"""Quality by a factorisation machine.

A text is a sparse vector: hashed words (share of the text's words), structure statistics (shares of character kinds,
word lengths, repetition, lines) and metadata (length), the last two as one bin each of quantiles. The score is linear
weights plus all pairwise interactions <v_i, v_j> x_i x_j of rank RANK; by the sum-of-squares identity these are half of
(sum v x)^2 - sum (v x)^2, so scoring is linear in the vector's entries.

It is learned with numpy on a bounded sample (at most PER_CLASS rows of label 0 and 1); texts are scored whole, where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import labelled
from feedloom.llm.textbytes import KIND, KINDS, steps, take_apart

BUCKETS, RANK, PER_CLASS, BINS = 1 << 15, 6, (4000, 4000), 12
EPOCHS, STEPS, RATE, BATCH = 10, 1000, 0.05, 64


@dataclass
class Sparse:
    """Rows of (feature, value); row i has the entries from at[i] to at[i + 1]."""

    at: np.ndarray
    feature: np.ndarray
    value: np.ndarray


def describe(texts: list[bytes]) -> tuple[np.ndarray, Sparse]:
    """Statistics of each text (numbers), and its hashed words."""
    w = take_apart(texts)
    n = len(texts)
    of_byte = np.repeat(np.arange(n), w.sizes + 1)
    kinds = np.bincount(of_byte * KINDS + KIND[w.data], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    kinds[:, 14] -= 1  # the zero after the text
    size, words = np.maximum(w.sizes, 1), np.maximum(w.counts, 1)
    of_word = np.repeat(np.arange(n), w.counts)
    bucket = (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    key, times = np.unique(of_word * BUCKETS + bucket, return_counts=True)
    rows, feature = key // BUCKETS, key % BUCKETS
    value = times / words[rows]
    types = np.bincount(rows, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, rows, value)
    again = np.zeros(n)
    if len(of_word) > 1:
        same = (w.hashes[1:] == w.hashes[:-1]) & (of_word[1:] == of_word[:-1])
        again = np.bincount(of_word[1:][same], minlength=n)
    letters = np.bincount(of_word, weights=w.lengths, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, of_word, w.lengths)
    stats = np.column_stack(
        [
            kinds / size[:, None],
            kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1),
            types / words,
            types / np.sqrt(words),
            most,
            again / words,
            letters / words,
            longest,
            w.counts / np.maximum(kinds[:, 4] + 1, 1),
            kinds[:, 8] / words,
            np.log1p(w.counts),
            np.log1p(w.sizes),
        ]
    )
    return stats, Sparse(np.concatenate([[0], np.cumsum(types)]), feature, np.sqrt(value))


def assemble(stats: np.ndarray, words: Sparse, edges: np.ndarray) -> Sparse:
    """Words and the bin of each statistic as one sparse vector a row."""
    n, m = stats.shape
    bins = np.stack([np.searchsorted(edges[j], stats[:, j], "right") for j in range(m)], 1)
    extra = BUCKETS + np.arange(m) * (BINS + 1) + bins
    per = np.diff(words.at)
    at = words.at + np.arange(n + 1) * m
    feature = np.empty(at[-1], np.int64)
    value = np.full(at[-1], 1 / np.sqrt(m), np.float32)
    rank = np.arange(len(words.feature)) - np.repeat(words.at[:-1], per)
    place = np.repeat(at[:-1], per) + rank
    feature[place], value[place] = words.feature, words.value
    feature[(at[1:, None] - m + np.arange(m)).ravel()] = extra.ravel()
    return Sparse(at, feature, value)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    edges: np.ndarray

    def logits(self, x: Sparse) -> np.ndarray:
        """Linear in the entries: per row sum w x + (|sum v x|^2 - sum |v x|^2) / 2. No row is empty."""
        first = np.add.reduceat(self.weight[x.feature] * x.value, x.at[:-1])
        vx = self.factor[x.feature] * x.value[:, None]
        total = np.add.reduceat(vx, x.at[:-1], axis=0)
        own = np.add.reduceat((vx * vx).sum(1), x.at[:-1])
        return self.bias + first + ((total * total).sum(1) - own) / 2

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in steps(texts):
            stats, words = describe(texts[a:b])
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.logits(assemble(stats, words, self.edges)), -30, 30)))
        return out


def picked(x: Sparse, rows: np.ndarray) -> Sparse:
    per = np.diff(x.at)[rows]
    at = np.concatenate([[0], np.cumsum(per)])
    take = np.arange(at[-1]) - np.repeat(at[:-1], per) + np.repeat(x.at[:-1][rows], per)
    return Sparse(at, x.feature[take], x.value[take])


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over shuffled batches."""
    described = [describe(texts[a:b]) for a, b in steps(texts)]
    m = described[0][0].shape[1]
    stats = np.concatenate([d[0] for d in described])
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    assembled = [assemble(s, w, edges) for s, w in described]
    offsets = np.cumsum([0, *(a.at[-1] for a in assembled)])
    x = Sparse(
        np.concatenate([*(a.at[:-1] + o for a, o in zip(assembled, offsets, strict=False)), offsets[-1:]]),
        np.concatenate([a.feature for a in assembled]),
        np.concatenate([a.value for a in assembled]).astype(np.float32),
    )
    rng = np.random.default_rng(seed)
    size = BUCKETS + m * (BINS + 1)
    model = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32), edges)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    # small samples are gone through more often
    for _ in range(max(EPOCHS, STEPS * BATCH // max(len(y), BATCH))):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rows = order[k : k + BATCH]
            part = picked(x, rows)
            error = 1 / (1 + np.exp(-np.clip(model.logits(part), -30, 30))) - y[rows]
            of = np.repeat(np.arange(len(rows)), np.diff(part.at))
            vx = model.factor[part.feature] * part.value[:, None]
            total = np.add.reduceat(vx, part.at[:-1], axis=0)
            features, back = np.unique(part.feature, return_inverse=True)
            pull = (error[of] * part.value)[:, None]
            dw, dv = np.zeros(len(features)), np.zeros((len(features), RANK))
            np.add.at(dw, back, pull[:, 0])
            np.add.at(dv, back, pull * (total[of] - vx))
            dw, dv = dw / len(rows) + 1e-5 * model.weight[features], dv / len(rows) + 1e-4 * model.factor[features]
            gw[features] += dw * dw
            gv[features] += dv * dv
            model.weight[features] -= 4 * RATE * dw / np.sqrt(gw[features])
            model.factor[features] -= RATE * dv / np.sqrt(gv[features])
            gb += error.mean() ** 2
            model.bias -= RATE * error.mean() / np.sqrt(gb)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS) -> Machine:
    """Learned from up to per_class rows of label 0 and 1 outside the held-out fold, at the labels' own odds. Without any
    labelled row the score is 0.5."""
    rows, shift = labelled.sample(docs, labels, label, per_class)
    got = rows.orderBy(F.xxhash64("text"), "text").toPandas()  # at most sum(per_class) rows
    y = got["label"].to_numpy(np.float64)
    if not len(y):
        got.loc[0], y, shift = ["", 0], np.array([0.5]), 0.0
    model = fit([t.encode() for t in got["text"]], y)
    model.bias += shift
    return model


def quality_scores(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1). Null and empty texts are scored by their statistics alone; ids may
    be null or repeated; an empty table gives an empty result; labels, lang, source and doc_id are no inputs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (RANK + 1) floats
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
