"""The mixture against its definition, and its oracle on the rows that every operator must bear."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from feedloom.llm import block_mix as bm
from oracle import rows, spark_rows
from rows import clashing, empty, frame, hard_rows, words


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, share=1.5, repeats=2):
    """By repeated resharing, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= repeats * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def hot(n=400):
    return [(i, words(i, 3 + i % 37), None, ["hot", "hot", f"s{i % 5}", None][i % 4], None) for i in range(n)]


@pytest.mark.parametrize("data", [hard_rows(), hot()])
def test_targets_and_words(spark, data):
    made = bm.mix(clashing(frame(spark, data)), block=16, shard=8)
    got = bm.taken_words(made).collect()
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size(r[1])
    want = targets(sizes, (3, 1, 2))
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted((str(r[0]), size(r[1]), sizes[r[3]]) for r in data)
    assert sum(r.taken for r in got) == sum(int(t + 0.5) for t in want.values())
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {(r.source, round(r.target, 6)) for r in made.sources.collect()} == {(s, round(t, 6)) for s, t in want.items()}
    for r in made.sources.filter("slots > 0").collect():
        assert abs(made.draws.filter(F.col("k") == r.k).agg(F.sum("take")).first()[0] - r.target) <= 0.5
    again = bm.taken_words(bm.mix(frame(spark, data[::-1]).repartition(3), block=16, shard=8))
    assert spark_rows(again) == spark_rows(bm.taken_words(made))


def test_draws_are_random_and_permuted(spark):
    made = bm.mix(frame(spark, hot(3000)), block=16, shard=64)
    source = {r.k: r for r in made.sources.collect()}
    draws = made.draws.collect()
    assert len({(d.shard, d.slot) for d in draws}) == len(draws) == sum(s.slots for s in source.values())
    for k, s in source.items():
        for p in range(s.passes):
            assert sorted(d.block for d in draws if d.k == k and getattr(d, "pass") == p) == list(range(s.blocks))
    # counts of a shard vary as multinomial counts do: chi square over whole shards near its degrees of freedom
    share = {k: s.slots / len(draws) for k, s in source.items()}
    shards = len(draws) // 64
    n = Counter((d.shard, d.k) for d in draws)
    chi = sum((n[i, k] - 64 * p) ** 2 / (64 * p) for i in range(shards) for k, p in share.items())
    assert 0.6 < chi / (shards * (len(share) - 1)) < 1.4
    first = [d.block for d in sorted(draws, key=lambda d: (d.shard, d.slot)) if d.k == 0][:40]
    assert first != sorted(first)


def test_texts(spark):
    data = hard_rows()
    made = bm.mix(frame(spark, data), block=16, shard=8, texts=True)
    got = bm.mixed_texts(made).collect()
    takes = {(d.shard, d.slot): d.take for d in made.draws.collect()}
    assert {(r.shard, r.slot): size(r.text) for r in got} == takes
    streams = {}
    for d in sorted(made.documents.collect(), key=lambda d: d.start):
        streams.setdefault(d.k, []).extend(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    for r in got:
        assert r.text.split(" ") == streams[r.k][r.block * 16 : r.block * 16 + takes[r.shard, r.slot]]


def test_permutation(spark):
    for n in (1, 2, 3, 7, 8, 100, 129):
        df = bm.permuted(spark.range(n), "to", F.col("id"), F.lit(n).cast("long"), F.lit("k"))
        assert sorted(r["to"] for r in df.collect()) == list(range(n))


@pytest.mark.parametrize("data", [hard_rows(), hot(), [(1, None, None, None, None)], []])
def test_oracle(spark, data):
    got = bm.taken_words(bm.mix(frame(spark, data)))
    documents = frame(spark, data).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from documents")
    cur = con.execute(bm.OP11_SQL.replace("from documents", "from main.documents"))
    columns = [c[0] for c in cur.description]
    assert spark_rows(got) == (sorted(columns), rows(columns, cur.fetchall()))
    assert bm.taken_words(bm.mix(empty(spark))).count() == 0
