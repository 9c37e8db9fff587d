"""Exact encoding of texts by units that a tokenizer never looks across.

A unit ends where, whatever stands around, the tokenizer's pre-tokens end too, so the ids of a text
are the ids of its units end to end.  Each distinct unit of a block is encoded once by the
tokenizers library; a bounded memo keeps units between blocks.  Blocks and memo are small, since a worker
that waits for its next task keeps what they took.

Units are told apart by two 64-bit hashes and the memo by their bytes, so equal ids need equal bytes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import textkit as tk

#: Entries of each half of a worker's memo: the newer units, and those that were the newer ones before.
MEMO = 300_000
#: Bytes of text encoded together.
TOGETHER = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Short batches put together up to ``limit`` bytes of text, long ones cut."""
    held, size = [], 0
    for b in tk.blocks(batches, column, limit):
        n = b.column(column).nbytes
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _tail_mark(data: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Where a comma or full stop stands between an ASCII letter and a blank (or the text's end)."""
    mark = np.zeros(len(data), bool)
    mark[1:] = ((data[1:] == 0x2C) | (data[1:] == 0x2E)) & _LETTER[data[:-1]]
    mark[:-1] &= blank[1:]
    return mark


def spaced_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units for a tokenizer that drops white space: words, with a final comma or stop apart."""
    blank = tk._SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = ~blank & edge[:-1]
    start[1:] |= ~blank[1:] & blank[:-1]
    start |= _tail_mark(data, blank | edge[:-1]) & ~blank
    end = ~blank & edge[1:]
    end[:-1] |= ~blank[:-1] & (blank[1:] | start[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def byte_level_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units for byte-level BPE that keeps white space: cut before a lone space between two solid
    bytes, around a lone line feed, and before a comma or stop after a letter and before a space."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 2:
        solid = data > 0x20
        lone = solid[:-2] & solid[2:]
        space, feed = lone & (data[1:-1] == 0x20), lone & (data[1:-1] == 0x0A)
        start[1 : n - 1] |= space | feed
        start[2:n] |= feed
        start[1 : n - 1] |= ((data[1:-1] == 0x2C) | (data[1:-1] == 0x2E)) & _LETTER[data[:-2]] & ((data[2:] == 0x20) | (data[2:] == 0x0A))
        # a cut next to a text's border looked over it
        near = np.concatenate((offsets, offsets - 1, offsets + 1))
        start[near[(near >= 0) & (near <= n)]] = False
    start[offsets] = True
    at = np.flatnonzero(start[:n])
    return at, np.append(at[1:], n) if len(at) else at


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    # a task has one core: more threads take more CPU and memory for the same work
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """A tokenizer with a memo of units."""

    def __init__(self, path: str):
        self.tokenizer, self.memo, self.older = tokenizer(path), {}, {}

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Each unit's ids as little-endian 32-bit numbers."""
        known = {}
        for u in units:
            ids = self.memo.get(u)
            if ids is None:
                ids = self.older.get(u)
            known[u] = ids
        fresh = [u for u, ids in known.items() if ids is None]
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            done = self.tokenizer.encode_batch_fast([u.decode() for u in part], add_special_tokens=False)
            known.update((u, array("I", e.ids).tobytes()) for u, e in zip(part, done, strict=True))
        if len(self.memo) + len(known) > MEMO:
            self.memo, self.older = {}, self.memo
        if len(known) <= MEMO:  # those of one long text are not held
            self.memo.update(known)
        return [known[u] for u in units]

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end, and each unit's border in them."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        w = tk.Words(data, np.array([0, len(data)]), start, end, np.array([0, len(start)]))
        h, check = tk.word_hashes(w, 0), tk.word_hashes(w, 1)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        if (check != check[first][which]).any():
            _, first, which = np.unique(np.stack((h, check), 1), axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        raw = data.tobytes()
        own = self.ids_of([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        size = np.array([len(x) // 4 for x in own])
        flat, at = np.frombuffer(b"".join(own), np.uint32), np.concatenate(([0], np.cumsum(size)))
        lens = size[which]
        borders = np.concatenate(([0], np.cumsum(lens)))
        return flat[np.arange(borders[-1]) + np.repeat(at[which] - borders[:-1], lens)], borders


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; its memo lives on between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
