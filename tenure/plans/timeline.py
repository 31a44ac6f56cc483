"""Rows in the order of time, in parts of bounded size that one task each holds as arrays.

Rows are range-partitioned by time (a row number splits a frequent time over parts), sorted from the latest to the earliest
and packed as blocks of numbers, once. Sums over risk sets then need no shuffle of rows: a part adds up its own rows from the top,
and the totals of the parts before it come from the driver, which holds a few numbers per part and their number is
bounded. A time that may reach over the border of a part (its first and its last) is settled from the sums of all parts at that time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_ROWS = 1 << 16  # rows a task holds, while there are no more parts than the driver follows
MAX_PARTS = 1 << 16
BLOCK_ROWS = 1 << 10
STRIP = 1 << 12  # rows whose features are multiplied at once: a part's task holds no second matrix
LAYOUT = "part int, t binary, e binary, g binary, x binary, r binary, m binary"
NO_GROUP = -1


@dataclass(frozen=True)
class Part:
    """The rows of one part, latest first: time, event, group, features, a row number that stays, and a margin (0 at first).

    `start` is the first row of each distinct time.
    """

    number: int
    t: np.ndarray
    e: np.ndarray
    g: np.ndarray
    x: np.ndarray
    r: np.ndarray
    m: np.ndarray
    start: np.ndarray

    def per_time(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start, axis=0)

    def strips(self) -> Iterator[slice]:
        return (slice(a, min(a + STRIP, len(self.t))) for a in range(0, len(self.t), STRIP))

    def weighted(self, w: np.ndarray) -> np.ndarray:
        """Sums of the features times w at each distinct time."""
        out = np.zeros((len(self.start), self.x.shape[1]))
        for rows in self.strips():
            first = np.searchsorted(self.start, rows.start, "right") - 1
            end = np.searchsorted(self.start, rows.stop, "left")
            begin = np.maximum(self.start[first:end] - rows.start, 0)
            out[first:end] += np.add.reduceat(self.x[rows] * w[rows, None], begin, axis=0)
        return out

    def squares(self, w: np.ndarray) -> np.ndarray:
        """x' diag(w) x."""
        return sum((self.x[rows].T @ (self.x[rows] * w[rows, None]) for rows in self.strips()), np.zeros((self.x.shape[1],) * 2))

    @property
    def time(self) -> np.ndarray:
        return self.t[self.start]

    def spread(self, per_time: np.ndarray) -> np.ndarray:
        """A value of each distinct time, for every row."""
        return np.repeat(per_time, np.diff(np.append(self.start, len(self.t))), axis=0)


def parts_of(batches: Iterator[pa.RecordBatch], width: int, kind: type = np.float64, centre: np.ndarray | None = None) -> Iterator[Part]:
    """The parts of a task, less the centre of the features; the blocks of a part follow one another."""

    def joined(held: list[tuple], number: int) -> Part:
        t, e, g, x, r, m = (np.concatenate(c) for c in zip(*held))
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        x = x.reshape(len(t), width)
        if centre is not None:
            x -= centre  # the blocks were copied: in place
        return Part(number, t, e, g, x, r, m, start)

    held: list[tuple] = []
    now = -1
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column(0)[i].as_py()
            if held and number != now:
                part, held = joined(held, now), []
                yield part
                del part
            now = number
            kinds = (np.float64, np.int8, np.int32, kind, np.int64, np.float64)
            held.append(tuple(np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in enumerate(kinds, 1)))
    if held:
        part, held, batch = joined(held, now), [], None  # the blocks go before the part is worked on
        yield part


Encode = Callable[[np.ndarray], np.ndarray]


class Timeline:
    """A table's rows as parts in the order of time; `release` gives the storage back."""

    def __init__(
        self,
        rows: DataFrame,
        columns: Sequence[str],
        size: int,
        part_rows: int = PART_ROWS,
        kind: type = np.float64,
        encode: Encode | None = None,
        ties: Sequence[Column] = (),
    ):
        """rows: t, e (null counts as censored), g (a group number) and `columns`; size: their number.

        encode turns a matrix of the columns into kind; ties orders rows of one time. The columns are one array from the scan to
        the blocks: 38 of them reach Python in half to two thirds of the time they take as columns.
        """
        columns = list(columns)
        self.spark = rows.sparkSession
        self.width = len(columns)
        self.kind = kind
        self.centre: np.ndarray | None = None  # what the kernels find taken off the features
        self.parts = max(1, min(MAX_PARTS, -(-size // part_rows)))
        rows = rows.select(
            F.col("t").cast("double").alias("t"),
            F.coalesce(F.col("e").cast("int"), F.lit(0)).alias("e"),
            F.col("g").cast("int").alias("g"),
            F.monotonically_increasing_id().alias("_r"),
            F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>").alias("_x"),
            *(columns if ties else []),
        )
        latest = [F.col("t").desc(), *ties, F.col("_r")]
        if encode is not None and self.parts == 1 and not ties:
            # The one task that packs the part gets its rows encoded: that work is done where the rows are read.
            rows, encode = rows.mapInArrow(_encoder(self.width, kind, encode), "t double, e int, g int, _r long, _x binary"), None
        dealt = rows.repartition(1) if self.parts == 1 else rows.repartitionByRange(self.parts, *latest)
        ordered = dealt.sortWithinPartitions(*latest).select("t", "e", "g", "_r", "_x")
        self.first = self.blocks = ordered.mapInArrow(_packer(self.width, kind, encode), LAYOUT).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.blocks.unpersist()
        self.first.unpersist()

    def advance(self, margin: Callable[[Part], np.ndarray], afresh: bool = True) -> None:
        """Give every row the margin that follows from its first blocks (margins 0) or, not afresh, from its last. The last blocks are
        given back. Steps that are not afresh make the plan longer: the caller sees to it that they are few in a row."""

        def moved(part: Part) -> Iterator[pa.RecordBatch]:
            m = margin(part)
            for begin in range(0, len(m), BLOCK_ROWS):
                rows = slice(begin, begin + BLOCK_ROWS)
                yield _block(part.number, *(a[rows] for a in (part.t, part.e, part.g, part.x, part.r, m)))

        before = self.blocks
        if afresh:
            self.blocks = self.first
        self.blocks = self.rows(moved, LAYOUT).persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.agg(F.count("part")).collect()
        if before is not self.first:
            before.unpersist()

    def rows(self, kernel: Callable[[Part], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What the kernel makes of every part."""
        width, kind, centre = self.width, self.kind, self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts_of(batches, width, kind, centre):
                yield from kernel(part)

        return self.blocks.mapInArrow(run, schema)

    def total(self, kernel: Callable[[Part], np.ndarray], most: int) -> np.ndarray:
        """The sum of an array that the kernel gives for each part; at most `most` tasks, which add up the arrays of their parts."""
        width, kind, centre = self.width, self.kind, self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for part in parts_of(batches, width, kind, centre):
                mine = kernel(part)
                held = mine if held is None else held + mine
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["v"])

        tasks = max(1, min(self.parts, most, self.spark.sparkContext.defaultParallelism))
        rows = self.blocks.coalesce(tasks).mapInArrow(run, "v binary").toArrow()
        return sum(np.frombuffer(v.as_buffer(), np.float64) for v in rows.column(0))

    def vectors(self, kernel: Callable[[Part], Iterator[tuple[int, np.ndarray]]]) -> list[tuple[int, int, np.ndarray]]:
        """(part, number, vector) of what the kernel gives for each part: a few numbers per part."""

        def run(part: Part) -> Iterator[pa.RecordBatch]:
            for number, vector in kernel(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.number], pa.int32()), pa.array([number], pa.int32()), pa.array([vector], pa.list_(pa.float64()))],
                    ["part", "number", "v"],
                )

        table = self.rows(run, "part int, number int, v array<double>").toArrow()
        part, number, v = (table.column(c).combine_chunks() for c in range(3))
        return [(p.as_py(), n.as_py(), x.values.to_numpy()) for p, n, x in zip(part, number, v)]


def _block(part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    packed = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *packed], ["part", "t", "e", "g", "x", "r", "m"])


def _matrix(rows: pa.RecordBatch, width: int, kind: type, encode: Encode | None) -> np.ndarray:
    """The features of rows: arrays of numbers, or the bytes of numbers of kind where they were encoded before."""
    column = rows.column("_x")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows.num_rows, width)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, width)
    return (x if encode is None else encode(x)).astype(kind)


def _encoder(width: int, kind: type, encode: Encode) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([row.tobytes() for row in _matrix(batch, width, kind, encode)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t", "e", "g", "_r")), x], ["t", "e", "g", "_r", "_x"])

    return run


def _packer(width: int, kind: type, encode: Encode | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(begin, BLOCK_ROWS)
                t, e, g, r = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("t", "e", "g", "_r"))
                x = _matrix(rows, width, kind, encode)
                yield _block(part, t.astype(np.float64), e.astype(np.int8), g.astype(np.int32), x, r.astype(np.int64), np.zeros(len(t)))

    return pack


@dataclass(frozen=True)
class Borders:
    """What the parts need of each other for one set of weights.

    A vector is (events, sums...). `before[q]` sums all rows at or after the first time of part q; part q's own inner times come
    below it. times, sums and at: the times at the borders, latest first, the sums of the rows at or after them and of those at them.
    """

    before: np.ndarray
    first: np.ndarray
    last: np.ndarray
    times: np.ndarray
    sums: np.ndarray
    at: np.ndarray


def border_vector(part: Part, cells: np.ndarray) -> np.ndarray:
    """What a part tells the driver: its first and last time, the sums at both, and those of all its rows."""
    return np.concatenate([part.time[[0, -1]], cells[0], cells[-1], cells.sum(axis=0)])


def borders(vectors: dict[int, np.ndarray], parts: int) -> Borders:
    """From the vectors of border_vector by part."""
    width = (len(next(iter(vectors.values()))) - 2) // 3
    order = sorted(vectors)
    first = np.full(parts, np.nan)
    last = np.full(parts, np.nan)
    before = np.zeros((parts, width))
    times = sorted({t for q in order for t in vectors[q][:2]}, reverse=True)
    place = {t: i for i, t in enumerate(times)}
    at = np.zeros((len(times), width))
    sums = np.zeros((len(times), width))
    inner = np.zeros((len(times) + 1, width))  # sums of inner times that lie above a border time
    for q in order:
        v = vectors[q]
        first[q], last[q] = v[:2]
        high, low, total = np.split(v[2:], 3)
        at[place[v[0]]] += high
        if v[0] != v[1]:
            at[place[v[1]]] += low
            inner[place[v[1]]] += total - high - low
    sums = np.cumsum(at, axis=0) + np.cumsum(inner[:-1], axis=0)
    for q in order:
        before[q] = sums[place[first[q]]]
    return Borders(before, first, last, np.array(times), sums, at)
