"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes, computed over blocks of bytes at once.

Words are the longest runs of bytes other than space and 0x09 to 0x0D after lower-casing A to Z. A word's hash is a
polynomial in its bytes (each byte stands for a random 64-bit number), taken from prefix sums and mixed. A text of fewer
words than a shingle has gives its whole sequence as the only shingle; one without words gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            out[0] = 1
            _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of lower-cased bytes."""
    word = ~_SPACE[buf]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[buf] * _power(_BASE, len(buf)), dtype=np.uint64)])
        h = (sums[end] - sums[start]) * _power(_INVERSE, len(buf))[start]
        return start, mix(h + (end - start).astype(np.uint64) * _PLACE[7])


def _cut(raw: bytes, at: int) -> int:
    """The first white space at or after `at`, so that no word is cut."""
    while at < len(raw) and not _SPACE[raw[at]]:
        at += 1
    return at


def word_hashes(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(place, hashes of the words) of each text. Texts go in blocks; a text longer than a block goes in parts."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:
            raw, parts, i = texts[at], [], 0
            while i < len(raw):
                j = _cut(raw, min(i + BLOCK, len(raw)))
                parts.append(_words(_LOWER[np.frombuffer(raw[i:j], dtype=np.uint8)])[1])
                i = j
            yield at, np.concatenate(parts)
            at += 1
            continue
        upto, size = at, 0
        while upto < len(texts) and size + len(texts[upto]) < BLOCK + (upto == at) * BLOCK:
            size += len(texts[upto]) + 1
            upto += 1
        buf = _LOWER[np.frombuffer(b" ".join(texts[at:upto]) + b" ", dtype=np.uint8)]
        start, h = _words(buf)
        ends = np.cumsum([len(t) + 1 for t in texts[at:upto]])
        cut = np.searchsorted(start, ends)
        for k, (i, j) in enumerate(zip([0, *cut[:-1]], cut)):
            yield at + k, h[i:j]
        at = upto


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    if not len(words):
        return words
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            h = h * _PLACE[7] + words[k : len(words) - width + 1 + k] * _PLACE[k % 7]
    return np.unique(mix(h))


def sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, in order."""
    for _, words in word_hashes([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]):
        yield shingles(words, width)
