"""Whole Arrow batches of text as numpy arrays: word bounds and hashes without a Python loop over words.

Words are ``[^\\x20\\x09-\\x0D]+``. In UTF-8 those separators are single bytes
that occur in no other character, so the bounds can be found among the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
"""Text that is worked on at once; a longer text makes a slice of its own."""

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so that its powers have inverses
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: each bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)

WINDOW = 1 << 16
"""Bytes whose prefix sums are in memory at once, however long the text."""


def _powers(base: int) -> np.ndarray:
    out = np.full(WINDOW + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


@dataclass
class Texts:
    """Some texts, end to end: text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Spans:
    """Runs of bytes inside texts; ``doc`` is the text that holds each one."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """``column`` in slices of about ``most`` bytes: first row, row after the last, texts. A null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, hi, Texts(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi


def runs(inside: np.ndarray, texts: Texts) -> Spans:
    """The longest runs of bytes for which ``inside`` holds, none of them across two texts."""
    n = len(inside)
    if not n:
        return Spans(*(np.zeros(0, np.int64) for _ in range(3)))
    edges = np.unique(texts.bounds[1:-1])
    edges = edges[(edges > 0) & (edges < n)]
    edges = edges[inside[edges - 1] & inside[edges]]  # where a text ends inside a run
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    start = np.concatenate([np.zeros(int(inside[0]), np.int64), start, edges])
    end = np.concatenate([end, np.full(int(inside[-1]), n), edges])
    if len(edges):
        start.sort()
        end.sort()
    return Spans(start, end, np.searchsorted(texts.bounds, start, "right") - 1)


def _windows(n: int, at: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Where each window of ``n`` bytes begins, and which of the ascending places ``at`` are in it."""
    for a in range(0, n + 1, WINDOW):
        yield a, slice(*np.searchsorted(at, [a, a + WINDOW]))


def hashes(texts: Texts, spans: Spans, table: np.ndarray = _BYTES) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever those bytes stand. Starts and ends ascend."""
    n, out = len(texts.data), np.zeros(len(spans.start), np.uint64)
    before, power, inverse = 0, 1, 1  # up to the window: the sum, and the powers there
    begins = _windows(n, spans.start)
    back = np.zeros(len(spans.start), np.uint64)
    for a, ending in _windows(n, spans.end):
        _, beginning = next(begins)
        block = texts.data[a : a + WINDOW]
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * _POWERS[: len(block)], out=total[1:])
        total = total * np.uint64(power) + np.uint64(before)
        out[beginning] -= total[spans.start[beginning] - a]
        out[ending] += total[spans.end[ending] - a]
        back[beginning] = _INVERSES[spans.start[beginning] - a] * np.uint64(inverse)
        before = int(total[-1])
        power, inverse = power * int(_POWERS[-1]) % (1 << 64), inverse * int(_INVERSES[-1]) % (1 << 64)
    return mix(out * back + (spans.end - spans.start).astype(np.uint64) * _GOLD)


def words(texts: Texts) -> Spans:
    return runs(~SPACE[texts.data], texts)


def ngrams(hashed: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``n`` consecutive words of one text, and the index of the first of them."""
    size = len(hashed) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashed[j : j + size]
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return mix(out[at] + np.uint64(n)), at


def characters(texts: Texts, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each of the ascending places ``at``."""
    out, before = np.zeros(len(at), np.int64), 0
    for a, here in _windows(len(texts.data), at):
        total = np.append(0, np.cumsum((texts.data[a : a + WINDOW] & 0xC0) != 0x80))
        out[here] = before + total[at[here] - a]
        before += int(total[-1])
    return out


def totals(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of ``values`` for each of ``n`` texts."""
    out = np.zeros(n, np.int64)
    np.add.at(out, doc, values.astype(np.int64))
    return out
