"""Hashes of the words of many texts at once, in numpy.

A word is a run of bytes other than ASCII white space, A-Z lower-cased.  Its hash is
multilinear: the sum over its bytes of a random 64-bit number of the byte times one of
the byte's place, mixed with the length.  Two different words share one with a
probability of about 2**-60.  Nothing is cached, so memory depends on the piece size
alone; a text of any length is cut to pieces at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once, about; a longer word is not cut.
PIECE = 1 << 19

_BYTES = np.random.default_rng(20250713).integers(0, 1 << 63, 512, dtype=np.uint64)
_PLACES = np.random.default_rng(20250714).integers(1 << 62, 1 << 63, 1 << 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUE = (_BYTES[:256] * np.uint64(2) + _BYTES[256:] % np.uint64(2))[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _places(n: int) -> np.ndarray:
    """Numbers of the first n places; beyond the table they are mixed from the place."""
    if n <= len(_PLACES):
        return _PLACES
    far = np.arange(len(_PLACES), n, dtype=np.uint64)
    return np.concatenate([_PLACES, mix(far * np.uint64(0x9E3779B97F4A7C15) + _PLACES[0]) | np.uint64(1)])


def _piece(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece; texts begin at `first`."""
    seen = ~_BLANK[data]
    start = seen.copy()
    start[1:] &= ~seen[:-1]
    start[first] = seen[first]
    at = np.flatnonzero(seen).astype(np.int32)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.flatnonzero(start[at])
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    value = _VALUE[data[at]] * _places(int(size.max()))[place]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64)), at[begin].astype(np.int64)


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one after the other, and the place of the
    first word of each text, with their total at the end.  A null text has none."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    found, starts = [], []
    at = 0
    while at < len(data):
        end = _cut(data, ends, at + PIECE)
        first = ends[np.searchsorted(ends, at) : np.searchsorted(ends, end)] - at
        h, s = _piece(data[at:end], first)
        found.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), ends)


def _cut(data: np.ndarray, ends: np.ndarray, near: int) -> int:
    """The first end of a text or white space from `near` on."""
    if near >= len(data):
        return len(data)
    text_end = int(ends[np.searchsorted(ends, near)])
    while near < text_end:
        blank = np.flatnonzero(_BLANK[data[near : min(near + 4096, text_end)]])
        if len(blank):
            return near + int(blank[0])
        near += 4096
    return text_end


def each(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    flat, at = hashes(texts)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield flat[a:b]
