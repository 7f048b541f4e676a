"""The draw against its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from feedloom.llm import importance_draw as im
from rows import clashing, empty, frame, hard_rows, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(data, items, percent=25):
    corpus, target = (Counter(b for t in texts for b in features(t)[1]) for texts in ([r[1] for r in data], items))
    big, small = corpus.total(), target.total()
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (big + 10000) / ((corpus[b] + 1) * (small + 10000))))
    out = []
    for i, t, *_ in data:
        w, f = features(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def got(df):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def many(n):
    return [(i // 2 if i % 7 == 0 else i, words(i % 50, 12 + i % 30), None, None, None) for i in range(n)]


@pytest.mark.parametrize(("data", "few"), [(hard_rows(), 1000), (many(900), 5), (many(900), 1), ([(1, "a", None, None, None)], 1), ([], 1)])
def test_draw(spark, data, few):
    items = [words(7, 30), "hi", None, "", "a a a"]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    assert got(im.importance_draw(clashing(frame(spark, data)).repartition(3), target, few=few)) == brute(data, items)


def test_no_target(spark):
    target = spark.createDataFrame([], "text string")
    assert got(im.importance_draw(frame(spark), target, percent=100)) == brute(hard_rows(), [], 100)
    assert im.importance_draw(empty(spark), target).count() == 0


def test_pair_hashes():
    r = random.Random(1)
    lines = [" ".join("".join(r.choice("abzé漢9") for _ in range(r.choice([1, 2, 9, 70, 5000]))) for _ in range(r.randint(0, 9))) for _ in range(40)]
    counts, buckets, line = im.run_buckets(pa.array(lines))
    for i, t in enumerate(lines):
        w = t.split()
        assert counts[i] == len(w)
        want = [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
        assert sorted(buckets[line == i].tolist()) == sorted(want)


def test_cutoff_by_rounds(spark):
    r = random.Random(2)
    keys = [(r.randint(-9, 9), 0, r.randint(0, 5), 1, i) for i in range(2000)]
    df = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in im.KEY)).repartition(7)
    for k in (1, 500, 1999, 2000):
        assert im.cutoff(df, k, len(keys), few=3) == sorted(keys)[k - 1]
