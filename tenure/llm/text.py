"""Arrow text columns as flat numpy arrays: slices of bounded size, words, lines, hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. All offsets are byte offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for every byte value, and the multiplier of positions.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `limit` bytes of text; a longer text stays whole in a run of its own."""
    if not batch.num_rows:
        return
    ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)
    first = batch.column(column).offset
    ends = ends[first : first + batch.num_rows + 1].astype(np.int64)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


class Text:
    """The bytes of a string column (null: empty), with the rows' offsets."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if column.null_count:
            column = column.fill_null("")
        off = np.frombuffer(column.buffers()[1], np.int32)
        off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.off = off - off[0]
        self.n = len(column)


class Words:
    """The words of a Text: row, start and length of each; `ids` into the distinct words."""

    def __init__(self, text: Text):
        d, off = text.data, text.off
        self.inside = inside = ~SPACE[d]
        begins = np.unique(off[:-1][off[:-1] < off[1:]])
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[begins] = inside[begins]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        before = begins[begins > 0] - 1
        end[before] = inside[before]
        self.start = np.flatnonzero(start)
        self.length = np.flatnonzero(end) + 1 - self.start
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=text.n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self._data = d

    def __len__(self) -> int:
        return len(self.start)

    def encode(self) -> tuple[np.ndarray, pa.StringArray]:
        """A number for every word, and the distinct words in that order."""
        compact = self._data[self.inside]
        ends = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(compact))
        words = words.dictionary_encode()
        return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array."""
    t = Text(strings)
    return t.data, t.off


def hashes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every string, by content alone."""
    length = np.diff(off)
    out = np.zeros(len(length), np.uint64)
    full = np.flatnonzero(length)
    if len(full):
        starts = off[:-1][full]
        place = np.arange(len(data)) - np.repeat(off[:-1], length)
        powers = np.cumprod(np.full(int(length.max()), BASE, np.uint64))
        out[full] = np.add.reduceat(BYTE[data] * powers[place], starts)
    return mix(out ^ (length.astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], wrapping for unsigned values."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def grouped(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by row, then value, and where in that order a new pair begins. Rows are ascending."""
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        r, v = row[order], value[order]
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return order, new
