"""Words, word hashes and word n-grams of many texts at once, as numpy arrays.

A slice of texts is one byte buffer with row offsets. Everything here is linear in the bytes, and
works on blocks of bounded size, so that one very long text costs no more memory per byte than many
short ones. Hashes are 64 bits, from polynomials modulo 2**64 with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 20


def byte_class(separators: str) -> np.ndarray:
    """Table of 256: True where a byte belongs to a word. Bytes from 0x80 always do."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Words of ``[^\\x20\\x09-\\x0D]+``.
SPACED = byte_class(" \t\n\v\f\r")
#: Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
ALNUM = byte_class("".join(chr(i) for i in range(128) if not chr(i).isalnum()))
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & (2**64 - 1), U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            n = max(n, 2 * len(self.up), 4096)
            self.up, self.down = _powers(self.base, n), _powers(pow(self.base, -1, 2**64), n)
        return self.up, self.down


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # combine_chunks of nothing
        column = pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(rows: pa.RecordBatch | pa.Table, column: str, most: int = 4 << 20) -> Iterator[pa.Table]:
    """Row ranges of about ``most`` bytes of ``column`` each, one row at least."""
    table = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
    if not table.num_rows:
        return
    size = pc.fill_null(pc.binary_length(table[column]), 0).to_numpy().astype(np.int64)
    piece = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
        yield table.slice(a, b - a)


class Words:
    """The words of the rows of a slice: ``starts`` and ``ends`` in ``data``; row r has the words
    ``first[r]`` to ``first[r + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED):
        inside = kind[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        if len(cuts) and cuts[-1] == len(data):
            cuts = cuts[:-1]
        held = inside[cuts] if len(data) else np.empty(0, bool)
        ends = np.append(cuts[1:], len(data))
        self.data, self.offsets = data, offsets
        self.starts, self.ends = cuts[held], ends[held]
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """A hash for each word; ``fold`` maps bytes first."""
        starts, ends, out = self.starts, self.ends, np.empty(len(self.starts), U)
        power, at = Powers(_BYTE_BASE), 0
        while at < len(starts):
            low = starts[at]
            upto = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
            part = self.data[low : ends[upto - 1]]
            part = part if fold is None else fold[part]
            up, down = power.upto(len(part))
            total = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=total[1:])
            s, e = starts[at:upto] - low, ends[at:upto] - low
            out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            at = upto
        return out


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` words have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U)
    out, step = np.empty(n, U), _BLOCK
    power = Powers(_WORD_BASE)
    for at in range(0, n, step):
        part = hashes[at : at + step + size - 1]
        up, down = power.upto(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        m = len(part) - size + 1
        out[at : at + m] = mix((total[size:] - total[:m]) * down[:m] + U(size))
    return out


def whole_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of all words of each row, equal to :func:`gram_hashes` of as many words; short rows only."""
    count = np.diff(first)
    out = np.zeros(len(count), U)
    for n in np.unique(count[count > 0]):
        rows = np.flatnonzero(count == n)
        up, _ = Powers(_WORD_BASE).upto(int(n))
        words = hashes[first[rows][:, None] + np.arange(n)]
        out[rows] = mix((words * up[:n]).sum(axis=1, dtype=U) + U(n))
    return out


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Positions of the words from which ``size`` words of the same row follow."""
    room = np.maximum(np.diff(first) - size + 1, 0)
    skip = np.repeat(first[:-1] - (np.cumsum(room) - room), room)
    return skip + np.arange(room.sum())


def segment_rows(counts: np.ndarray) -> np.ndarray:
    """Row index repeated by its count."""
    return np.repeat(np.arange(len(counts)), counts)
