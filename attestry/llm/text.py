"""Vectorised text kernels shared by the operators: words, hashes, blocks.

Every kernel works on the UTF-8 bytes of many documents at once, so that no
Python object is made for a word.  A :class:`Block` is a slice of an Arrow
batch that holds at most ``BLOCK_BYTES`` of text, or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from attestry.llm import worker

#: Text bytes of a block; one longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

#: Bytes whose words are hashed at once; bounds the arrays of 8 bytes a byte.
CHUNK = 1 << 20

#: Words ``[^\x20\x09-\x0D]+``: every byte but a space and the five controls.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise 64-bit values (xor-shift and multiply, both bijective)."""
    x = x ^ _U(salt & (2**64 - 1))
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_MUL_BYTE, _MUL_WORD, _MUL_SIDE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
worker.caching(_powers.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 2 * CHUNK:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


class Block:
    """Texts of some rows as one byte array with row offsets."""

    def __init__(self, rows: pa.RecordBatch, column: str, name: str = ""):
        self.rows, self.name = rows, name
        texts = rows.column(column)
        if pa.types.is_large_string(texts.type):
            kind = np.int64
        else:
            texts, kind = texts.cast(pa.string()), np.int32
        n = len(texts)
        _, off, data = texts.buffers()
        if n == 0 or off is None:
            self.offsets, self.data = np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
        else:
            offs = np.frombuffer(off, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            if texts.null_count:  # a null may own bytes of the buffer
                null = texts.is_null().to_numpy(zero_copy_only=False)
                if (np.diff(offs)[null] > 0).any():
                    return self.__init__(rows.set_column(rows.schema.get_field_index(column), column, texts.fill_null("")), column, name)
            self.data, self.offsets = raw[offs[0] : offs[-1]], offs - offs[0]

    def __len__(self) -> int:
        return self.rows.num_rows

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows, cut wherever ``limit`` text bytes are reached."""
    whole = Block(batch, column)
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(whole.offsets, whole.offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield Block(batch.slice(start, stop - start), column)
        start = stop


class Words:
    """Word spans of a block.

    ``start``/``end`` are byte positions in ``data``, ``first`` has for each
    row the index of its first word (and the total at its end).
    """

    def __init__(self, block: Block, table: np.ndarray, lower: bool):
        data = _LOWER[block.data] if lower else block.data
        self.block, self.data, n = block, data, len(data)
        inside = table[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = block.offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, block.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, some ``CHUNK`` bytes at a time."""
        out, n, i = np.empty(len(self), np.uint64), len(self), 0
        while i < n:
            j = max(int(np.searchsorted(self.start, self.start[i] + CHUNK)), i + 1)
            lo = self.start[i]
            start, end = self.start[i:j] - lo, self.end[i:j] - lo
            up, down = powers(_MUL_BYTE, int(end[-1]) + 1)
            sums = _sums(_BYTE[self.data[lo : lo + end[-1]]] * up[:-1])
            out[i:j] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
            i = j
        return out

    def stop(self) -> np.ndarray:
        """For each word the index after the last word of its row."""
        return np.repeat(self.first[1:], self.counts)


def rolling(words: np.ndarray, k: int, side: bool = False) -> np.ndarray:
    """Rabin-Karp hash of the k words from each place; places whose window runs
    over the end of the array are left out.  ``side`` takes another base."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(_MUL_SIDE if side else _MUL_WORD, n)
    sums = _sums(words * up)
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1], k + side)


def windows(words: Words, hashes: np.ndarray, k: int, side: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all windows of k words within one row."""
    rolled = rolling(hashes, k, side)
    at = np.flatnonzero(np.arange(len(rolled)) + k <= words.stop()[: len(rolled)])
    return at, rolled[at]


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def join_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Original bytes of the kept words, joined by one space in each row.

    Returns a byte array and row offsets.
    """
    start, size = words.start[keep], words.end[keep] - words.start[keep]
    sizes = size + 1
    ends = np.cumsum(sizes)
    data = np.append(words.block.data, np.uint8(0x20))
    out = data[np.repeat(start, sizes) + spread(sizes)]
    out[ends - 1] = 0x20
    rows = np.searchsorted(np.flatnonzero(keep), words.first)
    return out, np.concatenate([[0], ends])[rows]


def text_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string array of ``data[bounds[i]:bounds[i+1]-1]``, the joined rows."""
    return pa.array([data[a : max(a, b - 1)].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
