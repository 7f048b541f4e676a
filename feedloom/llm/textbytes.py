"""Words and character counts of many texts at once, with array operations over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are taken apart at a time; texts stay whole, so one longer text makes a larger step.
STEP_BYTES = 1 << 20
#: The leading bytes of a word that its character inputs see, and how far apart the pieces of a longer one start: whole
#: characters of one to four bytes, and near enough that no trigram falls between two pieces.
HEAD, PIECE = 16, 12


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.zeros(256, np.uint8)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            code[b] = b
        elif 65 <= b <= 90:
            code[b] = b + 32
    kind = np.full(256, 15, np.uint8)
    for b in range(128):
        c = chr(b)
        if c.islower():
            kind[b] = 0
        elif c.isupper():
            kind[b] = 1
        elif c.isdigit():
            kind[b] = 2
        elif c == " ":
            kind[b] = 3
        elif c == "\n":
            kind[b] = 4
        elif c.isspace():
            kind[b] = 5
        elif c in "|!.,;:":
            kind[b] = 6 + "|!.,".find(c) if c in "|!.," else 10
        elif c in "#$%&*":
            kind[b] = 11
        elif c in "@/\\<>{}[]()=+_~^":
            kind[b] = 12
        elif c in "'\"-?":
            kind[b] = 13
        else:
            kind[b] = 14
    return code, kind


CODE, KIND = _tables()
KINDS = 16
_powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each value."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """Words of some texts in order: hash, place and length in bytes, and how many each text has."""

    data: np.ndarray  # all bytes, one zero after each text
    sizes: np.ndarray  # bytes of each text
    code: np.ndarray  # lower-cased word bytes, zero between words
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray  # words of each text


def take_apart(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = CODE[data]
    inside = np.zeros(len(code) + 1, np.int8)
    inside[:-1] = code != 0
    turns = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    starts, ends = turns[::2], turns[1::2]
    lengths = ends - starts
    if len(starts):
        letters = code[code != 0].astype(np.uint64)
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(at, lengths)
        letters *= _powers[place & 63]
        # blocks of 64 letters; those of a longer word are mixed with their number before they are added up
        per = (lengths + 63) >> 6
        first = np.cumsum(per) - per
        number = np.arange(int(per.sum())) - np.repeat(first, per)
        blocks = np.add.reduceat(letters, np.repeat(at, per) + 64 * number)
        hashes = mix(blocks[first])
        if len(blocks) > len(hashes):
            mixed = mix(blocks + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            hashes = np.where(per > 1, mix(np.add.reduceat(mixed, first)), hashes)
    else:
        hashes = np.zeros(0, np.uint64)
    text_ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    return Words(data, sizes, code, starts, lengths, hashes, counts)


def heads(w: Words, which: np.ndarray) -> np.ndarray:
    """The first HEAD bytes of some words, zero beyond their end."""
    at = w.starts[which][:, None] + np.arange(HEAD)
    out = w.code[np.minimum(at, len(w.code) - 1)]
    out[np.arange(HEAD) >= w.lengths[which][:, None]] = 0
    return out


def pieces(w: Words) -> Words:
    """The words, those over HEAD bytes cut into overlapping pieces of up to HEAD bytes, each hashed as a word of its own."""
    per = np.maximum(-(-(w.lengths - HEAD) // PIECE), 0) + 1
    of = np.repeat(np.arange(len(per)), per)
    ahead = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * PIECE
    starts, lengths = w.starts[of] + ahead, np.minimum(w.lengths[of] - ahead, HEAD)
    out = Words(w.data, w.sizes, w.code, starts, lengths, w.hashes[of], np.diff(np.searchsorted(starts, np.cumsum(w.sizes + 1)), prepend=0))
    cut = np.flatnonzero(per[of] > 1)
    out.hashes[cut] = mix((heads(out, cut).astype(np.uint64) * _powers[:HEAD]).sum(1))
    return out


def steps(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP_BYTES each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_BYTES:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
