"""Vectorised work on the texts of Arrow batches, inside Spark's Arrow stages.

A batch's texts lie in one byte buffer.  Words, word hashes and hashes of word windows are
computed over the whole buffer at once; document borders are kept as offsets.  Hashes are
polynomials modulo 2**64 over a random byte table, read off prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; longer texts are handled alone.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240517)
_BYTES = _rng.integers(0, 2**64, (2, 256), np.uint64)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_WORD_BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of words hashed at once: tables of powers that a worker holds reach as far; longer words are hashed alone.
PIECE = 1 << 18


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, i below n at least, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK // 8)
        with np.errstate(over="ignore"):
            have = tuple(
                np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64)
                for b in (base, pow(base, -1, 2**64))
            )
        if size <= BLOCK:  # those of longer texts are not kept: an idle worker would hold them
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the output (a bijection on 64 bits)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each take at most ``limit`` bytes (or it is one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's values end to end, and their offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


@dataclass
class Words:
    """Words of a batch: their byte spans, and for each text the index of its first word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more than there are texts

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def left(self) -> np.ndarray:
        """How many words of the same text begin at or after each word."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def words(column: pa.Array) -> Words:
    """Runs of bytes other than space and \\x09-\\x0D, never across texts."""
    data, offsets = buffer(column)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
    after = np.concatenate((solid[1:], [False])) if len(solid) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def word_hashes(w: Words, way: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``lower``: A-Z count as a-z."""
    table = _BYTES[way].copy()
    if lower:
        table[65:91] = table[97:123]
    out, at = np.empty(len(w.start), np.uint64), 0
    while at < len(out):  # a word's hash doesn't depend on where the word stands
        base = w.start[at]
        to = max(at + 1, int(np.searchsorted(w.end, base + PIECE, "right")))
        start, end = w.start[at:to] - base, w.end[at:to] - base
        data = w.data[base : base + end[-1]]
        up, down = powers(_BASES[way], len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        out[at:to] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        at = to
    return out


def window_hashes(h: np.ndarray, n: int, way: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` values of h (those that cross texts are the caller's to drop)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASES[way], len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def sequence_hashes(w: Words, h: np.ndarray, way: int = 0) -> np.ndarray:
    """Hash of each text's whole sequence of word hashes."""
    up, down = powers(_WORD_BASES[way], len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[w.first[1:]] - sums[w.first[:-1]]) * down[w.first[:-1]] + w.count.astype(np.uint64))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and each text's borders.

    Lower-cased words; a text with fewer words than ``size`` has its whole sequence as one.
    """
    h = word_hashes(w, 0, lower=True)
    text, left = w.text_of(), w.left()
    full = np.flatnonzero(left >= size)
    values, owner = window_hashes(h, size)[full], text[full]
    few = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(few):
        values = np.concatenate((values, sequence_hashes(w, h)[few]))
        owner = np.concatenate((owner, few))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        keep = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(w.first)))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
