import base64
import hashlib
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import byte_bpe, queries
from rows import clashing, empty, frame, hard_rows, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(16384, 256), (64, 16), (7, 3), (50, 1)])
def test_like_the_library(spark, library, chunk, overlap):
    df = clashing(frame(spark))
    got = byte_bpe.encode_decode(df, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap, spaces=True).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in hard_rows())
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_digests(spark, library):
    got = byte_bpe.encode_decode(frame(spark), PATH, public_tokenizers.PATTERN, digests=True).filter("doc_id = 11").first()
    ids = library.encode_ordinary(words(5, 4000))
    assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got.decoded_sha256 == hashlib.sha256(words(5, 4000).encode()).hexdigest()


def test_long_runs(library):
    own = byte_bpe.codec(PATH, public_tokenizers.PATTERN, spaces=True)
    for t in ("a" * 3000, "ab" * 999, "é" * 500, " " * 1000 + "x", "the" * 400, "0" * 777):
        assert own.encode_pieces(pa.array(own.pattern.findall(t), pa.large_string())) == (",".join(map(str, library.encode_ordinary(t))), t.encode())


@given(st.text(alphabet=" \n\t\u00a0\u2003\x1c\x85aé.,'s1漢_", max_size=40))
@settings(max_examples=1500, deadline=None)
def test_parts(library, text):
    """Cutting at spaces gives what the whole text gives, and the same places of pre-tokens."""
    for spaces in (True, False):
        own = byte_bpe.codec(PATH, public_tokenizers.PATTERN, spaces)
        assert list(own.encode_texts(pa.array([text, text])))[1] == (",".join(map(str, library.encode_ordinary(text))), text.encode())
        assert own.starts(text).tolist() == [m.start() for m in own.pattern.finditer(text)]


def test_white_space():
    """The listed white space is what the pattern's engine and Python count as such."""
    assert set(byte_bpe.WHITE) == {c for c in map(chr, range(0x110000)) if c.isspace() or regex.match(r"\s", c)}


def test_forgets(library, monkeypatch):
    """Results do not depend on what is remembered."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    own = byte_bpe.Codec(PATH, public_tokenizers.PATTERN, spaces=True)
    for t in [words(i, 50) for i in range(5)] * 2:
        assert next(own.encode_texts(pa.array([t]))) == (",".join(map(str, library.encode_ordinary(t))), t.encode())


class Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def findall(self, text):
        self.calls += 1
        return self.pattern.findall(text)


def test_distinct_words_together(library):
    """Words never seen before are split by a few calls of the pattern, and little of them is kept afterwards."""
    own = byte_bpe.Codec(PATH, public_tokenizers.PATTERN, spaces=True)
    own.pattern = Counted(own.pattern)
    texts = [" ".join(f"w{n * 7919:x}q{n}" for n in range(k, k + 1000)) for k in range(0, 200_000, 1000)]
    texts += ["ends in white\n", "at the end ", " at the start", "a \nb c\u2003", "", "one"]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    got = [hashlib.sha256(ids.encode() + raw).digest() for ids, raw in own.encode_texts(pa.array(texts))]
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert got == [hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode() + t.encode()).digest() for t in texts]
    assert own.pattern.calls < 1000
    assert kept < 16 << 20


def test_long_texts_in_order(spark, library):
    """Chunks of several long texts, repeated rows, one id with two texts and a null id, in one partition."""
    long = [words(i, 300) for i in range(6)]
    rows = [(i, t, None, None, None) for i, t in enumerate(long)]
    rows += [rows[2], rows[2], (3, long[4], None, None, None), (None, long[5], None, None, None), (None, long[0], None, None, None)]
    df = frame(spark, rows).coalesce(1)
    got = byte_bpe.encode_decode(df, PATH, public_tokenizers.PATTERN, chunk=100, overlap=9, spaces=True).collect()
    want = sorted((str(i), library.encode_ordinary(t), t.encode()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want


def test_query(spark, library, tmp_path):
    """The registered query over a folder of its own, with a text of over a megabyte."""
    rows = [*hard_rows(), (99, words(9, 200_000), None, None, None)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_byte_bpe(spark, str(tmp_path)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(str(i), library.encode_ordinary(t or ""), t or "") for i, t, *_ in rows]
    assert got == sorted((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, ids, t in want)


def test_empty(spark):
    assert byte_bpe.encode_decode(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_other_patterns(spark):
    """By default nothing is cut at spaces, so a pattern whose matches hold them is encoded match by match."""
    pattern = r"[a-z]+ [a-z]+|\s|\S+?"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t, None, None, None) for k, t in enumerate(["of the of the and", "in to in\nthat is", "a b c d " * 50, ""])]
    got = byte_bpe.encode_decode(frame(spark, rows), PATH, pattern, chunk=64, overlap=16).collect()
    assert {r.doc_id: r.ids for r in got} == {k: enc.encode_ordinary(t) for k, t, *_ in rows}
