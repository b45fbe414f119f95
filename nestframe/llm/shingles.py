"""Word-shingle sets of texts as sorted 64-bit hashes, made with numpy over many texts at once.

Words are hashed eight bytes at a time by a keyed chain of non-linear mixes, long words by keyed
BLAKE2. The key is drawn by the caller and is no part of any result, so texts can't be made to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed together up to about so many bytes; a longer text is hashed alone.
CHUNK = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
#: Masks of a lane's first bytes, by their number.
_first = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_table = bytes(_lower)


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased: runs of bytes other than space and U+0009 to U+000D."""
    return text.encode().translate(_table).split()


def word_sets(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The distinct k-word shingles by their words; fewer words are one shingle."""
    words = words_of(text)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(k)), strict=False))


def word_hashes(texts: list[bytes], secret: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of the texts in order, and each text's first word's index (one more at the end)."""
    low = _lower[np.frombuffer(b" ".join(texts) + b" " + bytes(8), np.uint8)]
    space = _space[low[:-8]]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    size = end - start
    lanes = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    h = mix64(size.astype(np.uint64) * BASE ^ np.uint64(secret))
    for at in range(0, LONG, 8):
        live = np.flatnonzero(size > at)
        if not len(live):
            break
        h[live] = mix64(h[live] ^ (lanes[start[live] + at] & _first[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]], digest_size=8, key=secret.to_bytes(8, "little")).digest(), "little")
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, offsets)


def chain(words: np.ndarray, shingles: int, k: int) -> np.ndarray:
    """Hashes of the k words from each of the first ``shingles`` indexes on."""
    weight = mix64(np.arange(1, k + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    h = np.full(shingles, np.uint64(k), np.uint64)
    for j in range(k):
        h += words[j : j + shingles] * weight[j]
    return mix64(h)


def shingle_sets(texts: list[str | None], k: int, secret: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, sorted. Fewer words are one shingle; no words or null give an empty set."""
    done, size = [], 0
    for t in texts:
        done.append(t.encode() if t else b"")
        size += len(done[-1])
        if size >= CHUNK:
            yield from _sets(done, k, secret)
            done, size = [], 0
    if done:
        yield from _sets(done, k, secret)


def _sets(texts: list[bytes], k: int, secret: int) -> Iterator[np.ndarray]:
    words, at = word_hashes(texts, secret)
    every = chain(words, max(0, len(words) - k + 1), k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield chain(words[a:b], 1, b - a) if b > a else np.zeros(0, np.uint64)
