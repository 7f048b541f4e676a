import hashlib
import random
import tracemalloc

import numpy as np

from feedloom.llm import queries
from feedloom.llm import suffix_dedup as sd
from rows import clashing, empty, frame, hard_rows


def test_suffix_array():
    r = random.Random(1)
    for _ in range(500):
        s = [r.randint(1, r.choice([1, 2, 3, 20])) for _ in range(r.randint(0, 40))] + [0]
        assert sd.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    last = sd.LAST
    docs = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for d, b in docs:
        for i in range(len(b) - sd.K + 1):
            w = b[i : i + sd.K]
            first[w] = min(first.get(w, last), d)
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - sd.K + 1):
            if first[b[i : i + sd.K]] < d:
                gone[i : i + sd.K] = b"\1" * sd.K
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((str(None if d == last else d), len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def got(df, **more):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.repeated_spans(df, **more).collect())


def test_hard_rows(spark):
    want = brute([(i, t) for i, t, *_ in hard_rows()])
    assert got(clashing(frame(spark))) == want
    for hot in (1, 2, 99):
        assert got(frame(spark), block=400, hot=hot) == want


def test_random_edits(spark):
    r = random.Random(9)
    base = "".join(r.choice("ab cd") for _ in range(900))
    rows = []
    for i in range(40):
        t = list(base[r.randint(0, 300) : r.randint(400, 900)])
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((i, "".join(t), None, None, None))
    want = brute([(i, t) for i, t, *_ in rows])
    for hot in (1, 3, 99):
        assert got(frame(spark, rows), block=2000, hot=hot) == want


def test_equal_hashes(spark, monkeypatch):
    """Strings are compared where hashes meet: with a hash of two values the result is the same."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 150))) for _ in range(12)]
    texts += [t[10:] + t[:30] for t in texts]
    owners = list(range(len(texts)))
    spans = [t.encode()[:70] for t in texts if len(t) >= 70]
    keys = np.zeros(len(spans), np.uint32)
    data, size = b"".join(spans), np.array([len(s) for s in spans])
    want = {}
    for s, o in zip(spans, owners, strict=False):
        for i in range(len(s) - sd.K + 1):
            want[s[i : i + sd.K]] = min(want.get(s[i : i + sd.K], o), o)
    monkeypatch.setattr(sd, "content_hash", lambda data, at, stop: ((stop - at) & 1).astype(np.uint64))
    found = sd.window_owners(data, np.cumsum(size) - size, size, keys, np.arange(len(spans)))
    assert found.tolist() == [want[s[i : i + sd.K]] for s in spans for i in range(len(s) - sd.K + 1)]


def test_query(spark, tmp_path):
    """The registered query over a folder of its own, with texts of half a megabyte that share a passage."""
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(90_000))
    rows = [(i, t) for i, t, *_ in hard_rows()] + [(100, long), (101, long[5000:80_000] + " end"), (102, "start " + long[-3000:])]
    frame(spark, [(*x, None, None, None) for x in rows]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_suffix_dedup(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found) == sorted((*x[:4], sha(x[4])) for x in brute(rows))


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "STEP", 200)
    texts = [b"x" * 130, b"abc" * 400, b""]
    found = [(i, o, p) for step in sd.pieces_of(texts) for i, o, p in step]
    for i, t in enumerate(texts):
        seen = {t[o + k : o + k + sd.K] for j, o, p in found if j == i for k in range(len(p) - sd.K + 1)}
        assert seen == {t[k : k + sd.K] for k in range(len(t) - sd.K + 1)}


def test_long_suffix_array(monkeypatch):
    monkeypatch.setattr(sd, "LONG", 5)
    r = random.Random(8)
    for _ in range(200):
        s = [r.randint(1, r.choice([1, 2, 3, 20])) for _ in range(r.randint(5, 60))] + [0]
        assert list(sd.suffix_array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_covered():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(0, 60)
        found = [(a, r.randint(a + 1, n)) for a in (r.randrange(n) for _ in range(r.randint(0, 9) if n else 0))]
        got_ = sd.covered(np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64), n)
        assert got_.tolist() == [any(a <= i < b for a, b in found) for i in range(n)]


def test_bucket_in_parts(monkeypatch):
    """A bucket's spans are worked on in parts of some bytes, whatever its size, with the same result."""
    r = np.random.default_rng(5)
    size = r.integers(sd.K, 77, 20_000).astype(np.uint8)
    key = r.integers(0, 10_000, len(size)).astype(np.uint32)
    spans = r.integers(97, 123, int(size.sum()), np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    again = np.flatnonzero(np.arange(len(size)) % 3 == 2)  # begins as the span before does, under the same key
    for i in again:
        spans[at[i] : at[i] + sd.K] = spans[at[i - 1] : at[i - 1] + sd.K]
    key[again] = key[again - 1]
    own = r.permutation(len(size))
    sd.powers(len(spans) + 1)  # tables stay, they are not counted
    found, peak = [], []
    for part in (len(spans) + 1, 1 << 16):
        monkeypatch.setattr(sd, "PART", part)
        tracemalloc.start()
        found.append(sd.run_owners(key, own, size, spans))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(*found, strict=True)) and (found[0][0] > 1).any()
    assert peak[1] < peak[0] / 3


def test_empty(spark):
    assert got(empty(spark)) == []
