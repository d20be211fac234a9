"""Distinct word shingles of texts as 64-bit hashes, many texts at once in numpy.

A-Z in lower case; words `[^\\x20\\x09-\\x0D]+`; shingles of five words, or all words where there are fewer. A word's hash is a
polynomial over random values of its bytes, mixed; a shingle's is a polynomial over its words' hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
WORDS = 5
#: Bytes of text hashed at once.
AT_ONCE = 500_000
_R = 0x9E3779B97F4A7C15 | 3
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, U)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_power = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        for name, r in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(1 << max(20, (n - 1).bit_length()), r, U)
            p[0] = 1
            _power[name] = np.cumprod(p, dtype=U)
    return _power["up"][:n], _power["down"][:n]


def slices(batch, rows: int = 1000):
    """A batch in parts of so many rows: what is made of a part is let go before the next."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word."""
    b = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[b] * up[:-1], dtype=U)])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def _long(text: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, a stretch between white space at a time."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + AT_ONCE)
        while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        out.append(word_hashes(text[at:to])[2])
        at = to
    return np.concatenate(out)


def _runs(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, t in enumerate(texts):
        if first < i and len(t or b"") > AT_ONCE:  # a long text is a run of its own, whatever stands before it
            yield first, i
            first = i
        held += len(t or b"")
        if held >= AT_ONCE or i + 1 == len(texts):
            yield first, i + 1
            first, held = i + 1, 0


def shingles(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, end, each text's number of distinct shingles, and all of them, ascending for each text."""
    for a, z in _runs(texts):
        some = [t or b"" for t in texts[a:z]]
        if len(some) == 1 and len(some[0]) > AT_ONCE:
            w = _long(some[0])
            doc = np.zeros(len(w), np.int64)
        else:
            start, _, w = word_hashes(b" ".join(some))
            at = np.cumsum([0, *(len(t) + 1 for t in some)])
            doc = np.searchsorted(at, start, "right") - 1
        n = np.bincount(doc, minlength=len(some))
        k = max(0, len(w) - WORDS + 1)
        h = np.zeros(k, U)
        for i in range(WORDS):
            h = h * U(_R) + w[i : i + k]
        whole = doc[:k] == doc[WORDS - 1 :] if k else np.zeros(0, bool)
        found, of = [mix(h[whole] + U(WORDS))], [doc[:k][whole]]
        first = np.cumsum(n) - n
        for m in range(1, WORDS):
            few = np.flatnonzero(n == m)
            h = np.zeros(len(few), U)
            for i in range(m):
                h = h * U(_R) + w[first[few] + i]
            found.append(mix(h + U(m)))
            of.append(few)
        h, of = np.concatenate(found), np.concatenate(of)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield a, z, np.bincount(of[new], minlength=len(some)), h[new]


def digests(size: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set, equal for equal sets."""
    stop = np.cumsum(size)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(salt)), dtype=U)])
        out.append((total[stop] - total[stop - size]).view(np.int64))
    return out[0], out[1]
