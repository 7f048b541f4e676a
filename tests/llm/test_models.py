"""Learned scores: held-out accuracy, ranges and hard rows."""

import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import labelled, quality_fm, toxicity_gru
from rows import clashing, empty, frame, hard_rows

SF = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def held(spark, scores, label):
    docs = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scores.join(docs, "doc_id").filter(labelled.held_out(F.col("doc_id"))).select("score", label).toPandas()
    return rows["score"].to_numpy(), rows[label].to_numpy()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_fm.quality_model(docs, labels)
    score, y = held(spark, quality_fm.quality_scores(docs, model), "quality")
    assert auc(score, y) > 0.85
    got = quality_fm.quality_scores(clashing(frame(spark)), model).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality_fm.quality_scores(empty(spark), model).count() == 0
    none = quality_fm.quality_model(docs, labels.filter("false"))
    assert quality_fm.quality_scores(frame(spark), none).count() == len(hard_rows())


def test_sum_of_squares_identity():
    x = quality_fm.Sparse(np.array([0, 3]), np.array([0, 2, 3]), np.array([1.0, 0.5, 2.0]))
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(0.1, rng.normal(size=5), rng.normal(size=(5, 3)), np.zeros((0, 0)))
    pairs = sum((m.factor[x.feature[i]] @ m.factor[x.feature[j]]) * x.value[i] * x.value[j] for i in range(3) for j in range(i))
    assert np.isclose(m.logits(x)[0], 0.1 + (m.weight[x.feature] * x.value).sum() + pairs)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity_gru.toxicity_model(docs, labels)
    known = docs.join(labels.filter(labelled.held_out(F.col("doc_id"))).select("doc_id"), "doc_id", "left_semi")
    rows = toxicity_gru.toxicity_scores(known, net).join(labels, "doc_id").select("score", "toxic").toPandas()
    score, y = rows["score"].to_numpy(), rows["toxic"].to_numpy()
    assert ((score >= 0.5) == y).mean() > 0.95 and auc(score, y) > 0.95
    got = toxicity_gru.toxicity_scores(clashing(frame(spark)), net).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity_gru.toxicity_scores(empty(spark), net).count() == 0


def test_gradients():
    rng = np.random.default_rng(2)
    net = toxicity_gru.Network.start()
    net.dense = {k: rng.normal(0, 0.4, v.shape) for k, v in net.dense.items()}
    x = rng.normal(size=(6, 3, 3 * toxicity_gru.SIZE))
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        pre = {d: x @ net.dense[f"w{d}"] + net.dense[f"c{d}"] for d in "fb"}
        p = toxicity_gru.sigmoid(net.window_logits(pre, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    grad, dx = net.learn(x, mask, y, w)
    for name in ("uf", "ub", "wf", "cb", "nf", "att", "att_v", "out"):
        at = tuple(0 for _ in net.dense[name].shape)
        keep = net.dense[name][at]
        net.dense[name][at] = keep + 1e-3
        up = loss()
        net.dense[name][at] = keep - 1e-3
        down = loss()
        net.dense[name][at] = keep
        assert abs((up - down) / 2e-3 - grad[name][at]) < 2e-2, name


def test_windows_cover_texts():
    counts = np.array([0, 1, 48, 49, 84, 85, 500])
    text, begin = toxicity_gru.window_starts(counts)
    for i, n in enumerate(counts):
        seen = set()
        for b in begin[text == i]:
            seen |= set(range(b, min(b + toxicity_gru.WINDOW, n)))
        assert seen == set(range(n))


def test_long_runs_are_read_whole():
    import random

    import numpy as np

    from feedloom.llm import toxicity_gru as tg

    r = random.Random(4)

    def run(toxic):
        t = "".join(chr(r.randrange(0x4E00, 0x4F00)) for _ in range(60))
        k = r.randrange(10, 60)
        return (t[:k] + ("毒殺悪罵" if toxic else "") + t[k:]).encode()

    y = np.arange(400) % 2
    net = tg.fit([run(t) for t in y], y.astype(float))
    scores = net.scores([run(t) for t in y])
    ranks = np.argsort(np.argsort(scores))
    auc = (ranks[y == 1].sum() - 200 * 199 / 2) / 200**2
    assert auc > 0.9
