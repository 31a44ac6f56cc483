"""Exact linear-interpolated quantiles of many columns without holding a column in one task.

A double's bits, read as an unsigned number after the sign is folded in, have the order of the doubles. So an order statistic is
found digit by digit: a scan counts, for every column, the next DIGIT bits of the values whose higher bits are those found so
far, and the digit in which the wanted rank falls is fixed. All columns and ranks share a scan, five scans settle all 64 bits, and what a scan
returns is at most 2**DIGIT counts for each rank, whatever the values are and however often one repeats.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.plans.columns import quoted
from tenure.plans.materialise import discard, materialise

EXACT_ROWS = 200_000  # rows one exact percentile aggregate may hold
DIGIT = 13
SIGN = np.uint64(1 << 63)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    limit: int = EXACT_ROWS,
    rows: int | None = None,
    counts: Sequence[int] | None = None,
    written: bool = False,
) -> dict[str, list[float | None]]:
    """`{column: [quantile per prob]}`; nulls are skipped, an all-null column gives None.

    Spark's exact percentile keeps one counter per distinct value in a single task, so above
    `limit` rows the order statistics are selected by digits instead. counts: the number of values of each column, where the
    caller knows them; written: df is a projection of a written table and need not be written again.
    """
    cols = list(cols)
    probs = [float(p) for p in probs]
    if not cols:
        return {}
    n_rows = df.count() if rows is None else rows
    numbers = df.select(*[F.col(quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    if n_rows <= limit:
        row = numbers.agg(*[F.percentile(f"c{i}", probs).alias(f"c{i}") for i in range(len(cols))]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(cols)}
    copy = None if written else materialise(numbers, "numbers")  # scanned once for each digit
    numbers = numbers if copy is None else copy
    if counts is None:
        counts = numbers.agg(*[F.count(c) for c in numbers.columns]).first()
    wanted = {}
    for i, n in enumerate(counts):
        places = [(n - 1) * p for p in probs] if n else []
        wanted[i] = sorted({r for at in places for r in (floor(at), ceil(at))})
    values = select_ranks(numbers, wanted)
    if copy is not None:
        discard(copy)
    out: dict[str, list[float | None]] = {}
    for i, (c, n) in enumerate(zip(cols, counts)):
        out[c] = [None] * len(probs)
        for j, p in enumerate(probs if n else []):
            at = (n - 1) * p
            low, high = values[i, floor(at)], values[i, ceil(at)]
            out[c][j] = low if low == high else float(low + (high - low) * (at - floor(at)))
    return out


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0.0 counts as 0.0, NaN as the greatest."""
    x = np.where(x == 0, 0.0, x)
    x = np.where(np.isnan(x), np.nan, x)
    bits = x.view(np.uint64)
    return np.where(bits & SIGN != 0, ~bits, bits | SIGN)


def from_bits(bits: int) -> float:
    raw = bits & ~int(SIGN) if bits & int(SIGN) else ~bits & (2**64 - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def select_ranks(numbers: DataFrame, wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """(column number, rank) to the value of that rank from 0, for columns of doubles; nulls have no rank."""
    names = numbers.columns
    width = len(names)
    found = {(c, r): 0 for c, ranks in wanted.items() for r in ranks}  # the bits so far
    before = dict(found)  # values below those bits
    done = 0
    while found and done < 64:
        step = min(DIGIT, 64 - done)
        prefixes = sorted({(c, bits) for (c, _), bits in found.items()})

        def count(batches: Iterator[pa.RecordBatch], done=done, step=step, prefixes=prefixes) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(prefixes), 1 << step), np.int64)
            for batch in batches:
                keys = {}
                flat = batch.column(0).flatten()
                values = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                for i, (c, bits) in enumerate(prefixes):
                    if c not in keys:
                        keys[c] = ordered_bits(values[known[:, c], c])
                    key = keys[c]
                    if done:
                        key = key[key >> np.uint64(64 - done) == np.uint64(bits)]
                    digit = (key >> np.uint64(64 - done - step)) & np.uint64((1 << step) - 1)
                    total[i] += np.bincount(digit.astype(np.int64), minlength=1 << step)
            i, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(digit, pa.int32()), pa.array(total[i, digit])], ["i", "digit", "n"])

        # One array a row: it reaches Python sooner than many columns do.
        parts = numbers.select(F.array(*names).alias("x")).mapInArrow(count, "i int, digit int, n long").groupBy("i", "digit").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((len(prefixes), 1 << step), np.int64)
        total[parts.column("i").to_numpy(), parts.column("digit").to_numpy()] = parts.column("n").to_numpy()
        upto = np.cumsum(total, axis=1)
        place = {p: i for i, p in enumerate(prefixes)}
        for (c, r), bits in found.items():
            line = upto[place[c, bits]]
            digit = int(np.searchsorted(line, r - before[c, r], "right"))
            before[c, r] += int(line[digit - 1]) if digit else 0
            found[c, r] = bits << step | digit
        done += step
    return {k: from_bits(bits) for k, bits in found.items()}
