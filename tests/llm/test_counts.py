import random

import public_tokenizers
import regex

from feedloom.llm import wordpiece_counts as wc
from rows import clashing, empty, frame, hard_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces):
    n = 0
    while word:
        k = next(k for k in range(len(word), 0, -1) if k == 1 or word[:k] in pieces)
        word, n = word[k:], n + 1
    return n


def test_automaton():
    r = random.Random(3)
    for _ in range(60):
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(12)]
        own = wc.Automaton(pieces)
        for _ in range(40):
            word = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 14)))
            assert own.count(word) == greedy(word, set(pieces)), (pieces, word)


def test_rows(spark):
    pieces = set(wc.load_vocabulary(PATH))
    got = wc.token_counts(clashing(frame(spark)), PATH).collect()
    want = []
    for i, t, *_ in hard_rows():
        found = regex.findall(wc.WORDS, (t or "").lower())
        want.append((str(i), len((t or "").encode()), len(found), sum(greedy(w.encode() + bytes([wc.END]), pieces) for w in found)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_words, r.n_tokens) for r in got) == sorted(want)
    assert wc.token_counts(empty(spark), PATH).count() == 0
