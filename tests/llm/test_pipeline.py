"""The pipeline's stages against brute force on what the stage before kept."""

import re

import corpus_pipeline
import numpy as np

from test_ngrams import classes
from feedloom.llm.toxicity_gru import toxicity_model, toxicity_scores

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    fine = {r.doc_id for r in toxicity_scores(docs, net).collect() if r.score < corpus_pipeline.TOXIC}
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        steps.append({r.doc_id for r in docs.collect()})
    assert steps[0] == fine
    seen = {}
    for i in sorted(fine):
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i]), i)
    assert steps[1] == set(seen.values())
    near = classes([(i, rows[i]) for i in sorted(steps[1])])
    assert steps[2] == {min(map(int, c)) for c in near}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        wins |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in wins}
    clean = {i for i in steps[2] if not any(tuple(w[k : k + n]) in wins for w in [words(rows[i])] for n in sizes for k in range(len(w) - n + 1))}
    assert steps[3] == clean
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == clean and np.all([r.n_tokens > 0 for r in last])
