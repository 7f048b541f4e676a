"""The alignment against a plain reading of its definition."""

import hashlib
from collections import Counter

import public_tokenizers as pt
import pytest
import sentencepiece
import tokenizers

from feedloom.llm import token_align as ta
from feedloom.llm.wordpiece_counts import printable_bytes
from rows import clashing, empty, frame, hard_rows, words

A, B = pt.path("byte_bpe_50k.json"), pt.path("piece_bpe_32k.model")
ODD = ["▁under", "a\x00b", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ Å é é", "漢字かな交じり文 한국어", " " * 70, "\n\n\t\r\n x", "emoji 👩‍👩‍👧 🇩🇪", "​﻿ ", "a" * 5000]


def brute(data):
    a_of, b_of, byte = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), printable_bytes()
    a_of.encode_special_tokens = True

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    docs, count = [], Counter()
    for i, text, *_ in data:
        a = a_of.encode(" " + (text or ""), add_special_tokens=False)
        b = b_of.encode(text or "")
        bytes_a = [bytes(byte[c] for c in t) for t in a.tokens]
        bytes_b = [bytes([int(b_of.id_to_piece(k)[3:5], 16)]) if b_of.is_byte(k) else b_of.id_to_piece(k).replace("▁", " ").encode() for k in b]
        want = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((i, [], [], [], ""))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        links = [(x, y) for x, e in zip(a.ids, ends_a) for y, f in zip(b, ends_b) if e == f] if len(a.ids) < 300 else [(x, b[ends_b.index(e)]) for x, e in zip(a.ids, ends_a) if e in set(ends_b)]
        count.update(links)
        groups, last = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(t) for t, end in zip(ids, of) if last < end <= e) for ids, of in ((a.ids, ends_a), (b, ends_b))))
            last = e
        docs.append((i, a.ids, b, links, ";".join(groups)))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        str((i, len(a), len(b), g.count(";") + 1 if g else 0, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), g and hashlib.sha256(g.encode()).hexdigest()))
        for i, a, b, ls, g in docs
    )


def got(df):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in df.collect())


HARD = [r for r in hard_rows() if r[1] is None or len(r[1]) < 9000] + [(100 + k, t, None, None, None) for k, t in enumerate(ODD)]


@pytest.mark.parametrize("piece", [1 << 21, 300])
def test_alignment(spark, monkeypatch, piece):
    monkeypatch.setattr(ta, "PIECE", piece)
    monkeypatch.setattr(ta, "TOGETHER", 4)
    assert got(ta.token_alignment(clashing(frame(spark, HARD)).repartition(2), A, B, digests=True)) == brute(HARD)


def test_tables_and_text(spark):
    data = [(1, "hello world", None, None, None), (2, "hello there", None, None, None)]
    pairs = {(r.a, r.b): (r["count"], r.best) for r in ta.pair_counts(frame(spark, data), A, B).collect()}
    assert max(n for n, _ in pairs.values()) == 2 and all(best for n, best in pairs.values() if n == 2)
    groups = {r.doc_id: r.groups for r in ta.token_alignment(frame(spark, data), A, B).collect()}
    assert all("|" in g for g in groups.values())
    assert ta.token_alignment(empty(spark), A, B).count() == 0


def test_megabyte(spark):
    text = words(9, 180000)
    r = ta.token_alignment(frame(spark, [(1, text, None, None, None), (2, text[:100], None, None, None)]), A, B).filter("doc_id = 1").first()
    assert len(text) > 1 << 20 and r.n_links == r.n_groups and r.groups.count("|") == r.n_groups
    ids = [[int(x) for g in r.groups.split(";") for x in g.split("|")[side].split(",")] for side in (0, 1)]
    assert tokenizers.Tokenizer.from_file(A).decode(ids[0]) == " " + text and (len(ids[0]), len(ids[1])) == (r.n_a, r.n_b)
