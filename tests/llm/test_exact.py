import hashlib
import re

import pytest

from feedloom.llm import exact_dedup
from feedloom.llm.queries import oracle_sql, queries
from oracle import oracle_rows, spark_rows
from rows import clashing, empty, frame, hard_rows

SF = "/root/testdata/sf0.001"


def test_hard_rows(spark):
    got = sorted(exact_dedup.exact_dedup(clashing(frame(spark)), block=2).collect(), key=str)
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t, *_ in hard_rows()]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((str(i), str(least[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_sparse_ids(spark):
    """Copies whose ids all fall into blocks of their own meet over the shards."""
    rows = [(k * 1_000_003 - 5_000_000, "hot text" if k % 3 else f"text {k}", None, None, None) for k in range(3000)]
    got = exact_dedup.exact_dedup(frame(spark, rows), shards=3).collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(got) == 3000 and len(hot) == 2000 and {r.group_size for r in hot} == {2000}
    assert {r.keep_id for r in hot} == {1_000_003 - 5_000_000} and [r.doc_id for r in hot if r.kept] == [1_000_003 - 5_000_000]


def test_one_of_each(spark):
    df = clashing(frame(spark))
    got = exact_dedup.distinct_documents(df)
    assert got.columns == df.columns
    assert got.count() == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, *_ in hard_rows()})


def test_empty(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, name):
    columns, got = spark_rows(queries()[name](spark, SF))
    assert (columns, got) == oracle_rows(SF, oracle_sql()[name])
