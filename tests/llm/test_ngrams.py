import re
import random

from feedloom.llm import ngram_join as nj
from rows import clashing, empty, frame, hard_rows, words


def sets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def classes(rows):
    grams = [sets(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = grams[i], grams[j]
            if a and b and len(a & b) / len(a | b) >= 0.8:
                up[root(i)] = root(j)
    of = {}
    for i in range(len(rows)):
        of.setdefault(root(i), []).append(i)
    return sorted(sorted(str(rows[i][0]) for i in c) for c in of.values())


def check(spark, rows, df=None):
    got = nj.ngram_classes(frame(spark, rows) if df is None else df).collect()
    assert len(got) == len(rows)
    groups = {}
    for k, r in enumerate(got):
        key = r.class_id if r.class_id is not None else f"none{k}"
        groups.setdefault((key, r.class_size) if r.class_size > 1 else ("alone", k), []).append(r)
    assert sorted(sorted(str(r.doc_id) for r in g) for g in groups.values()) == classes(rows)
    return got


def test_hard_rows(spark):
    rows = [r for r in hard_rows() if r[0] is not None]
    check(spark, rows, clashing(frame(spark, rows)))


def test_chains_and_near_copies(spark):
    r = random.Random(5)
    rows, n = [], 0
    for c in range(6):
        base = [f"{w}{c}" for w in words(20 + c, 90).split()]
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = f"q{r.randint(0, 9)}"
            rows.append((n, " ".join(t), None, None, None))
            n += 1
        if c % 2:
            base[r.randrange(len(base))] = "drift"
    got = check(spark, rows)
    assert any(r.n_links for r in got)


def links(rows):
    """How many other distinct texts each row's text is similar to."""
    grams = {t: sets(t) for _, t, *_ in rows}
    found = {t: sum(1 for o, b in grams.items() if o != t and a and b and len(a & b) / len(a | b) >= 0.8) for t, a in grams.items()}
    return sorted((str(i), found[t]) for i, t, *_ in rows)


def test_links(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8, raising=False)
    monkeypatch.setattr(nj, "COLUMNS", 50, raising=False)
    r = random.Random(6)
    base = [f"{w}{i}" for i, w in enumerate(words(3, 80).split())]
    texts = [" ".join(base), ", ".join(base), " ".join(base).upper(), " ".join(base)]
    for k in range(30):
        t = list(base)
        for _ in range(k % 3):
            t[r.randrange(len(t))] = f"q{k}"
        texts.append((" " if k % 2 else "; ").join(t))
    rows = [r for r in hard_rows() if r[0] is not None] + [(100 + k, t, None, None, None) for k, t in enumerate(texts)]
    got = nj.ngram_classes(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == links(rows)


def test_one_of_each_class(spark):
    rows = hard_rows()
    left = nj.one_of_each_class(clashing(frame(spark)))
    assert left.columns == clashing(frame(spark)).columns
    assert 0 < left.count() < len(rows)


def test_bands():
    bands, rows = nj.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= nj.RECALL and bands * rows <= nj.MOST_HASHES


def test_empty(spark):
    assert nj.ngram_classes(empty(spark)).count() == 0


def test_long_words_with_blocks_in_another_order(spark):
    """Words over 64 letters are told apart by the order of their blocks, and pieces of 64 letters and 65 are not mixed up."""
    low, high = "a" * 63 + "b", "c" * 63 + "d"
    texts = [low + high, high + low, low + high + "e", low, low + "a", low + high, high + low[:63]]
    rows = [(k, " ".join([t] * 5 + [f"w{k}" for k in range(3)]), None, None, None) for k, t in enumerate(texts)]
    got = check(spark, rows)
    assert [r.n_links for r in sorted(got, key=lambda r: r.doc_id)] == [0] * 7


def test_recall_on_the_supplied_documents(spark):
    """Against all pairs: at least nine tenths of the links, and no pair that is not similar."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    grams = {t: sets(t) for t in set(texts.values())}
    holders = {}
    for t, g in grams.items():
        for x in g:
            holders.setdefault(x, []).append(t)
    want = dict.fromkeys(grams, 0)
    for t, g in grams.items():
        shared = {}
        for x in g:
            for o in holders[x]:
                shared[o] = shared.get(o, 0) + 1
        want[t] = sum(1 for o, n in shared.items() if o != t and n / (len(g) + len(grams[o]) - n) >= 0.8)
    got = {r.doc_id: r.n_links for r in nj.ngram_classes(docs).collect()}
    assert all(got[i] <= want[t] for i, t in texts.items())
    assert sum(got.values()) >= 0.9 * sum(want[t] for t in texts.values()) > 0
