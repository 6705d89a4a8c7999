"""Words and shingles of whole texts as 64-bit hashes, many texts at a time.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in
lower case.  Word hashes come from one polynomial prefix sum over the bytes
of all texts, shingle hashes from the hashes of five words in a row.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at once.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_A = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD_BYTE[_c] = True
_powers: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of a fixed odd number, and those of its inverse."""
    if "p" in _powers and len(_powers["p"]) >= n:
        return _powers["p"], _powers["i"]
    size = 1 << max(16, (n - 1).bit_length())
    found = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)])) for x in (_P, _INVERSE))
    # larger ones than a chunk needs are not kept
    if size <= 2 * CHUNK:
        _powers["p"], _powers["i"] = found
    return found


def _chunk_words(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a buffer that begins and ends outside words."""
    inside = _WORD_BYTE[joined]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edge[0::2], edge[1::2]
    p, inverse = powers(len(joined) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * p[: len(joined)])])
    return mix64((sums[stops] - sums[starts]) * inverse[starts]), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words start among them (one more entry at the end).

    A long text is hashed in chunks that end between words, so that what is held besides it does not grow with it.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    del raw
    hashes, places, lo = [], [], 0
    while lo < len(joined) - 1:
        hi = min(lo + CHUNK, len(joined))
        if hi < len(joined):
            # the last byte outside words, or the next one where a word is longer than a chunk
            gaps = np.flatnonzero(~_WORD_BYTE[joined[lo + 1 : hi]])
            if len(gaps):
                hi = lo + 2 + int(gaps[-1])
            else:
                while _WORD_BYTE[joined[hi - 1]]:
                    hi += 1
        h, at = _chunk_words(joined[lo:hi])
        hashes.append(h)
        places.append(at + lo)
        lo = hi - 1
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begins)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = WORDS, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shingle that starts at each word, and the bounds of each text's shingles among them.

    short: a text of 1 to n - 1 words gets one shingle, of all its words.
    """
    counts = np.diff(bounds)
    full = np.maximum(counts - (n - 1), 0)
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * _A + words[k : len(words) - n + 1 + k]
        h = mix64(h)
        ends = np.repeat(bounds[1:], counts)[: len(h)]
        h = h[np.arange(len(h)) + n <= ends]
    else:
        h = np.zeros(0, np.uint64)
    out = np.concatenate([[0], np.cumsum(full)])
    if not short or not ((counts > 0) & (full == 0)).any():
        return h, out
    parts, sizes = [], []
    for i, c in enumerate(counts):
        if full[i] or not c:
            parts.append(h[out[i] : out[i + 1]])
        else:
            v = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in words[bounds[i] : bounds[i + 1]]:
                    v = v * _A + w
            parts.append(mix64(np.array([v], np.uint64)))
        sizes.append(len(parts[-1]))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def groups(texts: list[str | None], size: int = 1_000_000) -> list[tuple[int, int]]:
    """[start, stop) of runs of texts with together about ``size`` characters."""
    found, start, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            found.append((start, i + 1))
            start, total = i + 1, 0
    return [*found, (start, len(texts))] if start < len(texts) else found
