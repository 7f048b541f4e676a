"""Decontamination, license scan and shards."""

import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm import decontaminate as dc
from feedloom.llm import hilbert_shard as hs
from feedloom.llm import license_scan as ls
from rows import clashing, empty, frame, hard_rows, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def listed(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


ITEMS = [(1, words(7, 30)), (2, "hi"), (3, None), (4, ""), (5, "nowhere to be found at all in any of these texts"), (6, words(5, 15)), (6, "One TWO"), (7, "a a a"), (None, words(4, 12))]


def test_decontaminate(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    wins = {}
    for i, t in ITEMS:
        w = listed(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t, *_ in hard_rows():
        w, hit, ids = listed(t), set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= of
        want.append((str(i), len(w), len(hit), sorted(str(x) for x in ids if x is not None), bool(hit)))
    got = dc.decontaminate(clashing(frame(spark)), items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == sorted(want)
    left = dc.clean_documents(clashing(frame(spark)), items)
    assert left.count() == sum(not x[4] for x in want)
    assert dc.decontaminate(empty(spark), items).count() == 0
    assert dc.decontaminate(frame(spark), items.filter("false")).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = frame(spark, [(1, "x rare1 y rare2 z", None, None, None), (2, "rare1 y y rare2", None, None, None), (3, "rare1 " + "y " * 9 + "rare2", None, None, None)])
    wins = spark.createDataFrame([(["rare1", "y", "rare2"],)], "window array<string>")
    got = {(r.doc_id, r.exact) for r in dc.window_matches(docs, wins, slop=2).collect()}
    assert (1, True) in got and (2, False) in got and not any(d == 3 for d, _ in got)


def test_proximity_keeps_changed_and_leading_passages(spark):
    texts = ["one two three four FIVE six seven eight nine ten", "rare1 rare2 z", "lead1 a b c lead2", "twin z z z", "by by by by"]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    changed = "one two three four changed six seven eight nine ten".split()
    wins = spark.createDataFrame([(changed,), (["p", "q", "rare1", "rare2"],), (["lead1", "lead2"],), (["twin", "by", "twin"],)], "window array<string>")
    got = {(r.doc_id, r.window[0], r.start, r.exact) for r in dc.window_matches(docs, wins, slop=2).collect()}
    assert got == {(0, "one", 0, False), (1, "p", -2, False)}


@pytest.mark.parametrize("rows_sent", [dc.BROADCAST_ROWS, -1])
def test_near_items(spark, monkeypatch, rows_sent):
    """A passage whose changed word is not of the two rarest is near, not hit; a copy is hit; repeated rows each have a row.
    Both with small tables broadcast and with every join shuffled."""
    monkeypatch.setattr(dc, "BROADCAST_ROWS", rows_sent)
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, "x " + passage), (2, passage.replace("one", "zero")), (4, "four " * 50)] + [(3, passage.replace("four", "other"))] * 40
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows])
    items = spark.createDataFrame([("a", passage), ("b", "absent words")], "item_id string, text string")
    got = dc.decontaminate(docs, items).collect()
    assert len(got) == 43
    # the rarest terms are "one" and "eight", so a passage without "one" is not near
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.n_near, tuple(r.near_items)) for r in got} == {
        (1, 11, 10, ("a",), 0, ()), (2, 10, 0, (), 0, ()), (3, 10, 0, (), 1, ("a",)), (4, 50, 0, (), 0, ())
    }


def test_license(spark):
    notes = ["Released under the MIT License.", "CC BY cc by", "x\nAll Rights Reserved\nGNU General Public License all rights reserved", "Licensed under CC BY-NC 4.0."]
    rows = hard_rows() + [(100 + k, t, None, None, None) for k, t in enumerate(notes)]
    got = {r.doc_id: r for r in ls.license_scan(clashing(frame(spark, rows))).collect()}
    assert len(got) and got[100].labels == ["mit"] and got[100].score == 1.0 and got[100].n_base == 0 and got[100].first_word is None
    assert (got[101].n_base, got[101].first_word, got[101].last_word, got[101].base_labels) == (2, 0, 2, ["cc-by"])
    assert (got[102].n_base, got[102].first_word, got[102].last_word, got[102].base_labels) == (3, 1, 8, ["gpl", "reserved"])
    assert got[103].labels == ["cc-by", "cc-by-nc-4.0"]
    assert (got[5].n_words, got[5].labels, got[5].score) == (0, [], 0.0)
    assert ls.license_scan(frame(spark, rows)).count() == len(rows)
    assert ls.license_scan(empty(spark)).count() == 0
    none = ls.license_scan(frame(spark, rows), templates={}, phrases={}).collect()
    assert len(none) == len(rows) and not any(r.labels or r.n_base or r.score for r in none)


def test_license_lines_do_not_matter(spark):
    header = ls.TEMPLATES["apache-2.0-header"].split()
    texts = [
        "# Licensed under the Apache License,\n# Version 2.0",
        "x\nPermission is\nhereby granted,\nfree of charge,\nto any person\nobtaining a copy\nof this software and associated\ndocumentation files",
        "Licensed under the Apache License\n" + "other line\n" * 9 + "Version 2.0",
        "mit filler released x under y the z license " + "word " * 3000,
        "word " * 1020 + "\n# ".join(" ".join(header[k : k + 4]) for k in range(0, len(header), 4)) + " word" * 2000,
    ]
    found = {r.doc_id: r for r in ls.license_scan(frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()}
    assert [found[k].labels for k in range(4)] == [["apache-2.0"], ["mit-grant"], [], []]
    assert found[4].labels == ["apache-2.0", "apache-2.0-grant", "apache-2.0-header"] and found[4].score == 1.0
    assert [b.start for b in found[1].blocks][0] == 1


def test_license_phrases_overlap(spark):
    got = ls.license_scan(frame(spark, [(1, "a a a b a a", None, None, None)]), phrases={"a a": "aa"}).first()
    assert (got.n_base, got.first_word, got.last_word, got.base_labels) == (3, 0, 4, ["aa"])


@pytest.mark.parametrize("terms", [ls.MAX_TERMS, -1])
def test_license_blocks(spark, monkeypatch, terms):
    """Against every window of every text, with segments of a few words; with a broadcast index and with a shuffled one."""
    import math
    import random

    monkeypatch.setattr(ls, "MAX_TERMS", terms)
    r = random.Random(5)
    templates = {f"t{k}": " ".join(r.choice("abcdefghij") for _ in range(n)) for k, n in enumerate((1, 4, 9, 14))} | {"blank": " - "}
    texts = [" ".join(r.choice("abcdefghijklmnopqrstuvw"[: r.choice((8, 12, 23))]) for _ in range(r.randrange(90))) for _ in range(60)]
    got = ls.license_scan(frame(spark, [(k // 2, t, None, None, None) for k, t in enumerate(texts)]), templates, {}, containment=0.7, segment=7).collect()
    want = []
    for k, t in enumerate(texts):
        w, blocks = t.split(), []
        for label, of in templates.items():
            own = set(of.split()) - {"-"}
            width = math.ceil(len(of.split()) * 1.25 - 1e-9)
            for i in range(len(w)):
                share = len(own & set(w[i : i + width])) / max(len(own), 1)
                if w[i] in own and share >= 0.7 - 1e-9:
                    blocks.append((label, i, share))
        want.append((k // 2, sorted(blocks), sorted({b[0] for b in blocks})))
    assert sorted((x.doc_id, [tuple(b) for b in x.blocks], x.labels) for x in got) == sorted(want)


def test_hilbert_curve():
    import itertools

    import numpy as np

    for n, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        order = hs.hilbert_index(points, bits)
        assert sorted(order) == list(range(len(points)))
        path = points[np.argsort(order)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rows = hard_rows() * 7
    got = hs.hilbert_shards(clashing(frame(spark, rows)), shards=5).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in by.values()]
    assert max(sizes) - min(sizes) <= 1 and len(by) == 5
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert hs.hilbert_shards(empty(spark)).count() == 0
    few = hs.hilbert_shards(frame(spark, hard_rows()[:3])).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_shards_prune(spark):
    """Lowest and highest values of the shards let a filter on any dimension skip some of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hs.hilbert_shards(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    for c, most in (("lang", 7), ("source", 6), ("size", 7), ("doc_id", 7)):
        ends = rows.groupby("shard")[c].agg(["min", "max"])
        values = rows[c].drop_duplicates()
        read = sum(((ends["min"] <= v) & (ends["max"] >= v)).sum() for v in values) / len(values)
        assert read < most, (c, read)
