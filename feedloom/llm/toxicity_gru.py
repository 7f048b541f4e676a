"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as the sum of three parts: an embedding of the hashed word, one of its leading characters and the mean
of those of its character trigrams. Words over HEAD bytes, such as runs of scripts without spaces, enter as overlapping
pieces that count as words, so every trigram is read. A gated recurrent unit reads a window of WINDOW words in each direction, attention
pools the states, and a logistic output scores the window. Windows overlap by WINDOW - STRIDE words and cover the whole
text; a text's score is that of its worst window, calibrated on a part of the sample that is not trained on.

Forward and backward passes are numpy. The network is learned on a bounded sample (at most PER_CLASS texts of label 0
and 1); the first embedding dimension starts from the log odds of the feature in that sample. A text's label is taken
to hold for its most suspicious window: first by the words' odds, then by the network itself; more windows are learned
from in texts that are not toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from feedloom.llm import labelled
from feedloom.llm.textbytes import HEAD, Words, heads, mix, pieces, steps, take_apart

WORD_BUCKETS, PREFIX_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 14, 1 << 14
PREFIX, GRAMS = 5, HEAD - 2
SIZE, HIDDEN = 8, 8
WINDOW, STRIDE, BLOCK = 48, 36, 2048
PER_CLASS, PER_TEXT, EPOCHS, STEPS, BATCH, RATE = (4500, 2000), 2, 4, 150, 128, 0.01
CALIBRATE = 4


@dataclass
class Features:
    """Hashed parts of distinct words."""

    word: np.ndarray
    prefix: np.ndarray
    grams: np.ndarray  # (words, GRAMS)
    n: np.ndarray  # how many of them there are, at least one

    @property
    def share(self) -> np.ndarray:
        """(words, GRAMS): 1 / n for the first n."""
        return ((np.arange(GRAMS) < self.n[:, None]) / self.n[:, None]).astype(np.float32)


def features(w: Words, which: np.ndarray) -> Features:
    head = heads(w, which).astype(np.uint64)
    seen = np.minimum(w.lengths[which], HEAD)
    first = np.zeros(len(which), np.uint64)
    for j in range(PREFIX):
        first = first * np.uint64(257) + head[:, j]
    tri = head[:, :GRAMS] * np.uint64(66049) + head[:, 1 : GRAMS + 1] * np.uint64(257) + head[:, 2 : GRAMS + 2]
    return Features(
        (w.hashes[which] & np.uint64(WORD_BUCKETS - 1)).astype(np.uint16),
        (mix(first) & np.uint64(PREFIX_BUCKETS - 1)).astype(np.uint16),
        (mix(tri) & np.uint64(GRAM_BUCKETS - 1)).astype(np.uint16),
        np.clip(seen - 2, 1, GRAMS).astype(np.uint8),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def window_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of every window: each STRIDE words, the last one at the text's end."""
    more = np.maximum(-(-(counts - WINDOW) // STRIDE), 0)
    per = np.where(counts > 0, more + 1, 0)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return text, np.minimum(nth * STRIDE, np.maximum(counts[text] - WINDOW, 0))


@dataclass
class Network:
    embed: dict[str, np.ndarray]
    dense: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    blank: float = 0.0
    state: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)

        embed = {"word": np.zeros((WORD_BUCKETS, SIZE), np.float32), "prefix": np.zeros((PREFIX_BUCKETS, SIZE), np.float32), "gram": np.zeros((GRAM_BUCKETS, SIZE), np.float32)}
        dense = {"att": normal(2 * HIDDEN, 2 * HIDDEN), "att_v": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            dense |= {f"w{d}": normal(3 * SIZE, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": normal(HIDDEN, 3 * HIDDEN), f"n{d}": np.zeros(HIDDEN, np.float32)}
        return Network(embed, dense)

    def inputs(self, f: Features) -> np.ndarray:
        gram = (self.embed["gram"][f.grams] * f.share[:, :, None]).sum(1)
        return np.concatenate([self.embed["word"][f.word], self.embed["prefix"][f.prefix], gram], 1)

    def read(self, d: str, pre: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States (steps, rows, HIDDEN) of one direction, in the order of the words; pre: (steps, rows, 3 * HIDDEN)."""
        u, c = self.dense[f"u{d}"], self.dense[f"n{d}"]
        steps_, rows, _ = pre.shape
        out = np.empty((steps_, rows, HIDDEN), np.float32)
        h = np.zeros((rows, HIDDEN), np.float32)
        for t in range(steps_) if d == "f" else range(steps_ - 1, -1, -1):
            hu = h @ u
            gates = sigmoid_(pre[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            inner = hu[:, 2 * HIDDEN :] + c
            new = np.tanh(pre[t, :, 2 * HIDDEN :] + r * inner)
            after = new + z * (h - new)
            if mask is not None:
                after = np.where(mask[t][:, None], after, h)
            if keep is not None:
                keep.append((t, h, z, r, inner, new))
            h = after
            out[t] = h
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.tanh(states @ self.dense["att"])
        e = a @ self.dense["att_v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        return (weight[:, :, None] * states).sum(0), weight, a

    def window_logits(self, pre: dict[str, np.ndarray], mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self.read("f", pre["f"], mask, None), self.read("b", pre["b"], mask, None)], 2)
        return self.pooled(states, mask)[0] @ self.dense["out"] + self.dense["out_b"]

    def learn(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted logistic loss, of the dense parts and of the inputs x (steps, rows, 3 * SIZE)."""
        p, kept = self.dense, {"f": [], "b": []}
        pre = {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}
        states = np.concatenate([self.read(d, pre[d], mask, kept[d]) for d in "fb"], 2)
        pool, share, a = self.pooled(states, mask)
        error = ((sigmoid(pool @ p["out"] + p["out_b"]) - y) * weight).astype(np.float32)
        grad = {"out": pool.T @ error, "out_b": error.sum(keepdims=True)}
        dpool = error[:, None] * p["out"]
        dstates = share[:, :, None] * dpool
        dshare = (states * dpool).sum(2)
        de = share * (dshare - (share * dshare).sum(0))
        grad["att_v"] = np.einsum("trk,tr->k", a, de)
        da = de[:, :, None] * p["att_v"] * (1 - a * a)
        grad["att"] = np.einsum("tri,trj->ij", states, da)
        dstates = dstates + da @ p["att"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            gu, gc = np.zeros_like(u), np.zeros_like(p[f"n{d}"])
            dpre = np.zeros_like(pre[d])
            carry = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, z, r, inner, new in reversed(kept[d]):
                dh = dstates[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                live = mask[t][:, None]
                step = np.where(live, dh, 0)
                dnew = step * (1 - z) * (1 - new * new)
                dz = step * (h - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                dinner = dnew * r
                dpre[t] = np.concatenate([dz, dr, dnew], 1)
                dhu = np.concatenate([dz, dr, dinner], 1)
                gu += h.T @ dhu
                gc += dinner.sum(0)
                carry = step * z + dhu @ u.T + np.where(live, 0, dh)
            grad |= {f"u{d}": gu, f"n{d}": gc, f"w{d}": np.einsum("tri,trj->ij", x, dpre), f"c{d}": dpre.sum((0, 1))}
            dx += dpre @ p[f"w{d}"].T
        return grad, dx

    def each_window(self, f: Features, back: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, logit) of every window of texts with words back (places in f)."""
        x = self.inputs(f)
        pre = {d: np.concatenate([x @ self.dense[f"w{d}"] + self.dense[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}
        text, begin = window_starts(counts)
        base, last = (np.cumsum(counts) - counts)[text] + begin, np.cumsum(counts)[text]
        back = np.append(back, len(f.word))
        out = np.empty(len(text), np.float32)
        for k in range(0, len(base), BLOCK):
            at = base[k : k + BLOCK] + np.arange(WINDOW)[:, None]
            mask = at < last[k : k + BLOCK]
            whole = bool(mask.all())
            ids = back[at if whole else np.where(mask, at, len(back) - 1)]
            out[k : k + BLOCK] = self.window_logits({d: pre[d][ids] for d in "fb"}, None if whole else mask)
        return text, begin, out

    def text_logits(self, texts: list[bytes]) -> np.ndarray:
        """The worst window's logit of each text; not a number for a text without words."""
        out = np.full(len(texts), np.nan)
        for a, b in steps(texts):
            w = pieces(take_apart(texts[a:b]))
            if not len(w.hashes):
                continue
            _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            text, _, logit = self.each_window(features(w, first), back, w.counts)
            best = np.full(b - a, -np.inf)
            np.maximum.at(best, text, logit)
            out[a:b] = np.where(np.isfinite(best), best, np.nan)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits = self.text_logits(texts)
        return np.where(np.isnan(logits), sigmoid(np.float64(self.blank)), sigmoid(self.scale * logits + self.shift))


def sigmoid_(x: np.ndarray) -> np.ndarray:
    """Sigmoid in place, as half a tanh."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def log_odds(seen: np.ndarray, toxic: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much likelier a feature is in toxic texts: the log odds less their standard error, at least 0. What was seen
    in one or two texts says nothing, else the network would learn the sample's rare words."""
    n1, n0 = y.sum(), len(y) - y.sum()
    other = seen - toxic
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    return np.where(seen > 2, np.maximum(odds - error, 0), 0)


def train(texts: list[bytes], y: np.ndarray, seed: int) -> Network:
    net, rng = Network.start(seed), np.random.default_rng(seed)
    parts = []
    tallies = {n: np.zeros((2, size)) for n, size in (("word", WORD_BUCKETS), ("prefix", PREFIX_BUCKETS))}
    for a, b in steps(texts):
        w = pieces(take_apart(texts[a:b]))
        _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        f = features(w, first)
        of = np.repeat(np.arange(b - a), w.counts)
        for name, own in (("word", f.word), ("prefix", f.prefix)):
            size = tallies[name].shape[1]
            once = np.unique(of * size + own.astype(np.int64)[back])
            tallies[name][0] += np.bincount(once % size, minlength=size)
            tallies[name][1] += np.bincount(once % size, weights=y[a:b][once // size], minlength=size)
        parts.append((a, w.counts, f, back.astype(np.int32)))
    for name, (seen, toxic) in tallies.items():
        net.embed[name][:, 0] = log_odds(seen, toxic, y) / 4

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.dense.items()}
    squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in net.embed.items()}
    step = 0
    for turn, epochs in enumerate((EPOCHS, EPOCHS // 2)):
        # the most suspicious windows of each text: first by the words' own odds, then by the network itself
        chosen = []
        for a, counts, f, back in parts:
            if not len(back):
                continue
            if turn:
                text, begin, worth = net.each_window(f, back, counts)
            else:
                total = np.concatenate([[0], np.cumsum((net.embed["word"][f.word, 0] + net.embed["prefix"][f.prefix, 0])[back])])
                text, begin = window_starts(counts)
                base = (np.cumsum(counts) - counts)[text] + begin
                worth = total[np.minimum(base + WINDOW, np.cumsum(counts)[text])] - total[base]
            order = np.lexsort((begin, -worth, text))
            nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            take = order[(nth == 0) | ((nth < PER_TEXT) & (y[a + text[order]] == 0))]
            at = ((np.cumsum(counts) - counts)[text[take]] + begin[take])[:, None] + np.arange(WINDOW)
            mask = at < np.cumsum(counts)[text[take]][:, None]
            chosen.append((back[np.minimum(at, len(back) - 1)], mask, y[a + text[take]], f))
        if not chosen:
            return net
        offsets = np.cumsum([0, *(len(c[3].word) for c in chosen)])
        ids = np.concatenate([c[0] + o for c, o in zip(chosen, offsets, strict=False)])
        mask, target = np.concatenate([c[1] for c in chosen]), np.concatenate([c[2] for c in chosen])
        every = Features(*(np.concatenate([getattr(c[3], k) for c in chosen]) for k in ("word", "prefix", "grams", "n")))
        weight = np.where(target == 1, 0.5 / max((target == 1).sum(), 1), 0.5 / max((target == 0).sum(), 1)) * len(target)
        for _ in range(max(epochs, (STEPS >> turn) * BATCH // max(len(target), BATCH))):
            order = rng.permutation(len(target))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                live = np.ascontiguousarray(mask[rows].T)
                i = ids[rows].T.reshape(-1)
                part = Features(every.word[i], every.prefix[i], every.grams[i], every.n[i])
                x = net.inputs(part).reshape(WINDOW, len(rows), 3 * SIZE)
                grad, dx = net.learn(x, live, target[rows], weight[rows] / len(rows))
                step += 1
                for name, g in grad.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.dense[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
                dx = dx.reshape(-1, 3 * SIZE) * live.reshape(-1, 1)
                gram = (dx[:, None, 2 * SIZE :] * part.share[:, :, None]).reshape(-1, SIZE)
                for name, at, d in (("word", part.word, dx[:, :SIZE]), ("prefix", part.prefix, dx[:, SIZE : 2 * SIZE]), ("gram", part.grams.reshape(-1), gram)):
                    sort = np.argsort(at, kind="stable")
                    own, begins = np.unique(at[sort], return_index=True)
                    total = np.add.reduceat(d[sort], begins, axis=0)
                    squares[name][own] += total * total
                    net.embed[name][own] -= 0.1 * RATE * total / np.sqrt(squares[name][own])
    del parts, chosen
    return net


def fit(texts: list[bytes], y: np.ndarray, seed: int = 5) -> Network:
    """A network trained on all texts but each CALIBRATE-th, on which its worst windows' logits are calibrated."""
    apart = np.arange(len(y)) % CALIBRATE == CALIBRATE - 1
    net = train([t for t, x in zip(texts, apart, strict=True) if not x], y[~apart], seed)
    worst = net.text_logits([t for t, x in zip(texts, apart, strict=True) if x])
    known = ~np.isnan(worst)
    z, t = worst[known], y[apart][known]
    if 0 < t.sum() < len(t):
        # Newton steps of a lightly held logistic fit
        a, b = 1.0, 0.0
        for _ in range(25):
            p = sigmoid(a * z + b)
            q = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - t) * z).sum() + 0.5 * (a - 1), (p - t).sum() + 0.05 * b])
            hess = np.array([[(q * z * z).sum() + 0.5, (q * z).sum()], [(q * z).sum(), q.sum() + 0.05]])
            da, db = np.linalg.solve(hess, g)
            a, b = a - np.clip(da, -0.5, 0.5), b - np.clip(db, -2, 2)
        net.scale, net.shift = max(float(a), 0.05), float(b)
    return net


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Network:
    """Learned from up to per_class rows of label 0 and 1 outside the held-out fold, at the labels' own odds."""
    rows, shift = labelled.sample(docs, labels, label, per_class)
    got = rows.orderBy(F.xxhash64("text"), "text").toPandas()  # at most sum(per_class) rows
    y = got["label"].to_numpy(np.float64)
    net = fit([t.encode() for t in got["text"]], y) if len(y) else Network.start()
    net.shift += shift
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.blank = float(np.log(share / (1 - share)) + shift)
    return net


def toxicity_scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids with a score: doc_id, score (0 to 1), one row per input row.

    Null and empty texts, and texts without words, get the sample's base rate. Ids may be null or repeated; an empty
    table gives an empty result; labels, lang, source and doc_id are no inputs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return with_scores(rows, net).select("doc_id", "score")


def with_scores(rows: DataFrame, net: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """rows, all their columns kept, with a score column."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # the network's fixed size
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts), pa.float64())], names=[*batch.schema.names, score_col])

    return rows.mapInArrow(run, schema)
