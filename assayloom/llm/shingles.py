"""Word and shingle hashes of whole texts, computed over an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Texts are hashed together until they hold so many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes go through a digest, the others through rounds of eight bytes.
_ROUNDS = 16


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of all words: data holds the UTF-8 texts back to back, from the places `starts`.

    Words are runs without ASCII white space; A-Z count as a-z. A hash takes a word's length and its bytes eight at a time,
    scrambled after each, so it has no algebra by which different words come to one value.
    """
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[starts[starts < n]] = False
    first = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = starts[(starts > 0) & (starts < n)]
    after[inner - 1] = False
    last = np.flatnonzero(solid & ~after) + 1
    lower = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eights = np.ndarray((n,), "<u8", lower, 0, (1,))
    size = (last - first).astype(_U)
    hashes = mix(size * _U(0x9E3779B97F4A7C15))
    left, at, rows = size.copy(), first.copy(), np.arange(len(first))
    for _ in range(_ROUNDS):
        block = eights[at]
        short = left < _U(8)
        block[short] &= (_U(1) << (left[short] * _U(8))) - _U(1)
        hashes[rows] = mix(hashes[rows] ^ block)
        more = left > _U(8)
        if not more.any():
            break
        left, at, rows = left[more] - _U(8), at[more] + 8, rows[more]
    else:
        for i in rows.tolist():
            hashes[i] = np.frombuffer(blake2b(lower[first[i]: last[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return hashes, first, last


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-word shingle hashes; fewer words make one shingle, none make none."""
    texts = texts.fill_null("")
    lengths = np.asarray(pc.binary_length(texts)).astype(np.int64)
    at = 0
    while at < len(texts):
        ends = np.cumsum(lengths[at:])
        many = max(1, int(np.searchsorted(ends, CHUNK_BYTES, "right")))
        data = np.frombuffer(b"".join(texts.slice(at, many).cast(pa.binary()).to_pylist()), np.uint8)
        starts = np.concatenate([[0], ends[: many - 1]]).astype(np.int64)
        words, first, _ = word_hashes(data, starts)
        heads = np.searchsorted(first, starts)
        tails = np.append(heads[1:], len(words))
        weights = list((np.arange(n, dtype=_U) * _U(2) + _U(1)) * _U(0xD6E8FEB86659FD93))
        grams = np.zeros(max(0, len(words) - n + 1), _U)
        if len(words) >= n:
            for i, w in enumerate(weights):
                grams += (words[i: len(words) - n + 1 + i] ^ _U(i)) * w
        grams = mix(grams)
        for a, b in zip(heads.tolist(), tails.tolist()):
            if b - a >= n:
                yield np.unique(grams[a: b - n + 1])
            elif b > a:
                short = np.zeros(1, _U)
                for i in range(b - a):
                    short += (words[a + i: a + i + 1] ^ _U(i)) * weights[i]
                yield mix(short + _U(b - a))
            else:
                yield np.zeros(0, _U)
        at += many
