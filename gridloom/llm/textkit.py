"""Vectorised helpers over whole texts: words, 64-bit word hashes and shingle sets.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z only,
which is what ``bytes.lower`` and ``bytes.split`` do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once; a longer single text gets a buffer of its own.
CHUNK = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


#: What is part of a term: letters and digits of ASCII, and all bytes beyond it.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, A-Z lower-cased; ASCII signs and blanks part them."""
    return text.translate(_TERM).split()


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in a byte buffer."""
    solid = np.concatenate(([False], ~_SPACE[buf], [False])).view(np.int8)
    edges = np.diff(solid)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by prefix sums of a polynomial modulo 2^64."""
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), then the same for the next."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def chunks(texts: list[bytes] | list[str], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield first, i
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts taken together: buffer, word starts, word ends, word hashes, and
    the index of the first word of each text (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    starts, ends = word_bounds(buf)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of every ``words`` words in a
    row, of the whole sequence where there are fewer, nothing without words."""
    lower = [lowered(t) for t in texts]
    weights = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for a, b in chunks(lower):
        _, _, _, hashes, first = hashed_words(lower[a:b])
        n = max(0, len(hashes) - words + 1)
        windows = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            windows += hashes[k : k + n] * weights[k]
        windows = mix(windows)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= words:
                yield np.unique(windows[lo : hi - words + 1])
            elif hi > lo:
                yield mix(np.array([(hashes[lo:hi] * weights[: hi - lo]).sum() + np.uint64(hi - lo)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
