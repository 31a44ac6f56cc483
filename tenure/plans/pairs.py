"""Counts of pairs by two orders, without building a pair."""

from __future__ import annotations

from decimal import Decimal

import numpy as np

_LOW = np.int64((1 << 32) - 1)


def total(products: np.ndarray) -> int:
    """The exact sum of 64-bit products, which need not fit 64 bits."""
    return (int((products >> np.int64(32)).sum()) << 32) + int((products & _LOW).sum())


def pairs_below(place: np.ndarray, value: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> tuple[int, int]:
    """Over cells i and j with place_j < place_i: the sums of asked_i * rows_j where value_j < value_i, and where they are equal.

    place is ascending. Values that differ have ranks that first differ at one binary digit, the greater having the 1 there: so for each
    digit, the cells are grouped by the digits above it, and a running sum along place counts the zeros before every one.
    """
    if not len(place):
        return 0, 0
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
    same = total(asked * _before(rank, place, rows))
    below = 0
    for digit in range(int(rank.max()).bit_length()):
        one = rank >> digit & 1
        below += total(np.where(one == 1, asked, 0) * _before(rank >> (digit + 1), place, np.where(one == 0, rows, 0)))
    return below, same


def _before(group: np.ndarray, place: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """For every cell, the amounts of its group at smaller places."""
    order = np.argsort(group, kind="stable")
    g, p, a = group[order], place[order], amount[order]
    upto = np.concatenate([[0], np.cumsum(a)])
    new = np.append(True, g[1:] != g[:-1])
    step = new | np.append(True, p[1:] != p[:-1])
    first = np.maximum.accumulate(np.where(step, np.arange(len(g)), 0))  # where cells of this place begin
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    out = np.empty(len(g), np.int64)
    out[order] = upto[first] - upto[start]
    return out


def decimals(values: list[int]) -> list[Decimal]:
    return [Decimal(v) for v in values]
