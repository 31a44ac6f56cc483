"""Gradient-boosted Cox model: histogram trees on Newton steps of the Cox loss.

Features are cut into at most 256 bins once and kept as bytes, in the order of time (`plans.timeline`). A round takes the risk-set
sums that give each row its gradient and curvature, then grows a tree level by level: gradients and curvatures are added up per
node, feature and bin inside each part and summed by Spark, the larger child of a node being its parent less the smaller, and
the split with the greatest gain is taken. Margins are kept with the rows and moved on every TABLE_ROUNDS trees; the
blocks before are given back. Where the table is one part, its task grows the trees by the same steps, all of them where the losses
are those of its own rows, else ROUNDS in a row. It keeps the rows column by column and the rows of each node as a list, counts columns of
few bins together and those where one bin has most rows by the other rows.
"""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.operators.survival import SurvivalModel, breslow_baseline, running_sums
from tenure.plans.materialise import discard, materialise
from tenure.plans.timeline import NO_GROUP, PART_ROWS, Part, Timeline, border_vector, borders
from tenure.sources.io import read_table, write_table

BINS = 256
ROUNDS = 25  # trees between two moves of the margins, in one task
TABLE_ROUNDS = 8  # the same over several parts, where every scan adds the trees since the last move to the margins
TASK_ROWS = 1 << 20  # rows of bytes that one task grows trees from; more are parts of part_rows
MOVES = 8  # of the margins, one after the other, until they are taken from all trees again
NODES_AT_ONCE = 64  # nodes of one level whose sums one job takes
SENT_BYTES = 1 << 27  # of sums that the tasks of such a job send to the driver
UNIT_CELLS = 1 << 12  # joint bins of columns that are counted together
MOSTLY = 0.875  # share of the rows in one bin
UNIT_ROWS = 1 << 14  # rows of a node from which that pays
LEAST_GAIN = 1e-6
LOSS = -1  # as a node's number: the loss after the tree
QUANTILE_ACCURACY = 10_000
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, below int, above int, value double"
)


@dataclass(frozen=True)
class Tree:
    """Nodes in breadth order; feature is -1 at a leaf. A row goes below if its value is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def rows(self, number: int) -> list[tuple]:
        return [
            (number, i, int(f), float(t), int(b), int(a), float(v))
            for i, (f, t, b, a, v) in enumerate(
                zip(self.feature, self.threshold, self.below, self.above, self.value)
            )
        ]

    @classmethod
    def of_rows(cls, rows: Sequence[Any]) -> Tree:
        def column(name: str, kind: type) -> np.ndarray:
            return np.array([r[name] for r in rows], dtype=kind)

        return cls(
            column("feature", int),
            column("threshold", float),
            column("below", int),
            column("above", int),
            column("value", float),
        )

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node at which each row of values ends."""
        inner, own = self.feature >= 0, np.arange(len(self.feature))
        feature = np.maximum(self.feature, 0)
        child = np.column_stack([np.where(inner, self.above, own), np.where(inner, self.below, own)]).ravel()  # a leaf leads to itself
        level = np.zeros(len(own), dtype=np.int64)
        for n in own[inner]:
            level[[self.below[n], self.above[n]]] = level[n] + 1
        values, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(level.max()):
            below = values.take(row + feature.take(node)) <= self.threshold.take(node)
            node = child.take(2 * node + below)
        return node

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


def forest_column(trees: Sequence[Tree], features: Sequence[str], rate: float) -> Column:
    """rate * sum of tree values, evaluated batch by batch with array lookups."""
    trees = list(trees)
    if not trees:
        return F.lit(0.0)

    @F.pandas_udf(T.DoubleType())
    def evaluate(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(dtype=float)
        return pd.Series(sum((tree.values(x) for tree in trees), np.zeros(len(x))) * rate)

    return evaluate(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]))


@dataclass
class BoostedModel(SurvivalModel):
    """Log hazard = rate * sum of trees; curves and medians use the baseline of this same score."""

    trees: list[Tree] = field(default_factory=list)
    rate: float = 0.05
    losses: list[float] = field(default_factory=list)

    def risk_column(self) -> Column:
        return forest_column(self.trees, self.features, self.rate)

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([r for i, t in enumerate(self.trees) for r in t.rows(i)], NODE_SCHEMA)

    def save(self, path: str) -> None:
        spark = self.baseline.sparkSession
        meta = {
            "name": self.name,
            "params": self.params,
            "version": self.version,
            "features": self.features,
            "rate": self.rate,
        }
        write_table(self.nodes(spark).withColumn("meta", F.lit(json.dumps(meta))).coalesce(1), f"{path}/trees")
        write_table(self.baseline, f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        rows = read_table(spark, f"{path}/trees").orderBy("tree", "node").collect()
        meta = json.loads(rows[0]["meta"])
        by_tree: dict[int, list] = {}
        for r in rows:
            by_tree.setdefault(r["tree"], []).append(r)
        return cls(
            name=meta["name"],
            features=meta["features"],
            baseline=read_table(spark, f"{path}/baseline"),
            params=meta["params"],
            version=meta["version"],
            trees=[Tree.of_rows(by_tree[k]) for k in sorted(by_tree)],
            rate=meta["rate"],
        )


# --- bins ---------------------------------------------------------------------------------------


def bin_borders(rows: DataFrame, names: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper borders of each column's bins but the last: all distinct values where they are few, else quantiles.

    What a scan returns is bounded by bins. Nulls and NaN fall into the last bin.
    """
    value = lambda n: F.when(~F.isnan(n), F.col(n))
    counts = rows.agg(*[F.approx_count_distinct(value(n)).alias(n) for n in names]).first()
    few = {n for n in names if counts[n] <= 2 * bins}
    found = rows.agg(
        *[
            (F.collect_set(value(n)) if n in few else F.percentile_approx(value(n), [i / bins for i in range(1, bins)], QUANTILE_ACCURACY)).alias(n)
            for n in names
        ]
    ).first()
    out = []
    for n in names:
        distinct = np.unique(np.array(found[n] or [], float))
        if n in few:
            distinct = distinct[:-1] if len(distinct) <= bins else np.unique(np.quantile(distinct, np.arange(1, bins) / bins, method="lower"))
        out.append(distinct)
    return out


def binned(borders_: list[np.ndarray]):
    def encode(x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for i, b in enumerate(borders_):
            out[:, i] = np.searchsorted(b, x[:, i], "left")  # NaN sorts last
        return out

    return encode


# --- rounds -------------------------------------------------------------------------------------


def _margin(part: Part, trees: Sequence[Tree], rate: float) -> np.ndarray:
    m = part.m
    for tree in trees:
        m = m + rate * tree.values(part.x)
    return m


def _sums_at(part: Part, w: np.ndarray) -> np.ndarray:
    """Events and summed weights at each distinct time."""
    return part.per_time(np.column_stack([part.e.astype(float), w]))


def _steps(sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """d / S0 and d / S0^2 of times whose risk-set and own sums are given."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(at[:, 0] > 0, at[:, 0] / sums[:, 1], 0.0)
        return a, np.where(at[:, 0] > 0, a / sums[:, 1], 0.0)


def _ascending(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a[::-1])[::-1]


def _gradients(part: Part, w: np.ndarray, carry: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of every row; carry: the part's sums from other parts (None: it is the only one)."""
    at = _sums_at(part, w)
    if carry is None:
        sums = [_ascending(s) for s in _steps(np.cumsum(at, axis=0), at)]
    else:
        before, low, high = carry
        inner = at[1:-1]
        steps = _steps(before + np.cumsum(inner, axis=0), inner)
        sums = [np.concatenate([[h], lo + _ascending(s), [lo]])[: len(at)] for s, lo, h in zip(steps, low, high)]
    a, b = (part.spread(s) for s in sums)
    return w * a - part.e, w * a - w * w * b


def _drawn(part: Part, seed: int, number: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round: a hash of its number, so it does not hang on the parts."""
    x = part.r.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 < share


@dataclass(frozen=True)
class _Unit:
    """Columns of few bins as one code. usual: the code of half of the rows or more, whose sums are what the others leave."""

    columns: tuple[int, ...]
    code: np.ndarray
    digits: tuple[np.ndarray, ...]  # by column: the bin of each code
    usual: int | None


def _units(x: np.ndarray) -> list[_Unit]:
    """All columns (a row of x each), those of few bins together, while their joint bins stay under UNIT_CELLS.

    Columns with one bin for almost all rows are kept from the others, so that their unit has one too.
    """
    sizes = x.max(axis=1).astype(int) + 1
    even = np.array([np.bincount(column).max() < MOSTLY * len(column) for column in x])
    sets: list[list[int]] = []
    cells = 1
    for c in np.lexsort((sizes, even)):
        if not sets or even[c] != even[sets[-1][0]] or cells * sizes[c] > UNIT_CELLS:
            sets.append([])
            cells = 1
        sets[-1].append(int(c))
        cells *= int(sizes[c])
    units = []
    for columns in sets:
        code, digits = x[columns[0]], [np.arange(sizes[columns[0]])]
        for c in columns[1:]:
            code = code.astype(np.uint16) * np.uint16(sizes[c]) + x[c]
            digits = [np.repeat(d, sizes[c]) for d in digits] + [np.tile(np.arange(sizes[c]), len(digits[0]))]
        counts = np.bincount(code, minlength=len(digits[0]))
        usual = int(counts.argmax())
        units.append(_Unit(tuple(columns), code, tuple(digits), usual if 2 * counts[usual] >= len(code) else None))
    return units


class _Rows:
    """Rows of bytes column by column, and the rows of each node of the tree that grows."""

    def __init__(self, x: np.ndarray, units: bool = False):
        self.x = np.ascontiguousarray(x.T)
        self.units = _units(self.x) if units and len(x) >= UNIT_ROWS else []
        self.held: dict[int, np.ndarray] = {}

    def hold(self, rows: np.ndarray) -> None:
        """A tree begins, with these rows at its root."""
        self.held = {0: rows}

    def sink(self, tree: Tree) -> None:
        """Every row goes down to where the tree has grown."""
        todo = list(self.held)
        while todo:
            node = todo.pop()
            if tree.feature[node] < 0:
                continue
            rows = self.held.pop(node)
            below = self.x[tree.feature[node]].take(rows) <= np.uint8(tree.threshold[node])
            for child, side in ((tree.below[node], below), (tree.above[node], ~below)):
                self.held[int(child)] = rows.take(np.flatnonzero(side))
                todo.append(int(child))

    def histograms(self, node: int, columns: list[int], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(column, bin, 2): the summed gradient and curvature of a node's rows."""
        rows = self.held[node]
        both = g.take(rows), h.take(rows)
        out = np.zeros((len(columns), BINS, 2))
        if not self.units or len(rows) < UNIT_ROWS:
            for i, c in enumerate(columns):
                at = self.x[c].take(rows)
                for k, v in enumerate(both):
                    out[i, :, k] = np.bincount(at, v, BINS)
            return out
        place = {c: i for i, c in enumerate(columns)}
        pairs = both[0] + 1j * both[1]  # added up in one pass
        whole = pairs.sum()
        for unit in self.units:
            if not any(c in place for c in unit.columns):
                continue
            at, values, sums = unit.code.take(rows), pairs, np.zeros(len(unit.digits[0]), complex)
            if unit.usual is not None:
                others = np.flatnonzero(at != unit.usual)
                at, values = at.take(others), pairs.take(others)
            np.add.at(sums, at.astype(np.intp), values)
            if unit.usual is not None:
                sums[unit.usual] = whole - sums.sum()
            for c, digit in zip(unit.columns, unit.digits):
                if c in place:
                    for k, v in enumerate((sums.real, sums.imag)):
                        out[place[c], :, k] = np.bincount(digit, v, BINS)
        return out


class _InTask:
    """The sums of a round from the rows of a single part, inside its task."""

    def __init__(self, part: Part, spec: BoostedCox):
        self.spec, self.m, self.followed = spec, part.m, 0
        self.rows, self.part = _Rows(part.x, units=True), replace(part, x=part.x[:0])  # the rows are held once
        self.e = part.e.astype(float)
        self.events = part.per_time(self.e)
        self._weigh()

    def _weigh(self) -> None:
        self.w = np.exp(self.m)
        self.at = np.column_stack([self.events, self.part.per_time(self.w)])
        self.sums = np.cumsum(self.at, axis=0)

    def follow(self, trees: Sequence[Tree]) -> None:
        """Margins move on by the trees grown since."""
        for tree in trees[self.followed :]:
            self.m = self.m + self.spec.learning_rate * self._values(tree)
            self._weigh()
        self.followed = len(trees)

    def _values(self, tree: Tree) -> np.ndarray:
        out = np.empty(len(self.m))
        sampled = self.rows.held
        for rows in (sampled, {0: self.left_out}):
            self.rows.held = rows
            self.rows.sink(tree)
            for node, at in rows.items():
                out[at] = tree.value[node]
        return out

    def loss(self) -> float:
        """The mean negative log partial likelihood per event."""
        dead = self.at[:, 0] > 0
        total = self.e.sum()
        return float((self.at[dead, 0] @ np.log(self.sums[dead, 1]) - self.m[self.e > 0].sum()) / total) if total else math.nan

    def start(self, trees: Sequence[Tree], number: int) -> None:
        self.follow(trees)
        a, b = (self.part.spread(_ascending(s)) for s in _steps(self.sums, self.at))
        a *= self.w
        self.g, self.h = a - self.e, a - self.w * self.w * b
        if self.spec.subsample < 1:
            drawn = _drawn(self.part, self.spec.random_state, number, self.spec.subsample)
            self.left_out = np.flatnonzero(~drawn)
            self.rows.hold(np.flatnonzero(drawn))
        else:
            self.left_out = np.zeros(0, int)
            self.rows.hold(np.arange(len(self.m)))

    def histograms(self, tree: Tree, wanted: list[int], columns: list[int]) -> np.ndarray:
        self.rows.sink(tree)
        return np.array([self.rows.histograms(node, columns, self.g, self.h) for node in wanted])


class _OnTable:
    """The sums of a round as Spark jobs over all parts."""

    def __init__(self, timeline: Timeline, spec: BoostedCox):
        self.timeline, self.spec = timeline, spec
        self.shared: Any = None

    def start(self, trees: Sequence[Tree], number: int) -> None:
        self.trees, self.number = list(trees), number
        rate = self.spec.learning_rate
        given = self.trees

        def totals(part: Part) -> Iterator[tuple[int, np.ndarray]]:
            yield 0, border_vector(part, _sums_at(part, np.exp(_margin(part, given, rate))))

        parts = self.timeline.parts
        found = borders({q: v for q, _, v in self.timeline.vectors(totals)}, parts)
        before = self._share(found.before)

        def inside(part: Part) -> Iterator[tuple[int, np.ndarray]]:
            at = _sums_at(part, np.exp(_margin(part, given, rate)))[1:-1]
            yield 0, np.array([s.sum() for s in _steps(before.value[part.number] + np.cumsum(at, axis=0), at)])

        inner = np.zeros((parts, 2))
        for q, _, v in self.timeline.vectors(inside):
            inner[q] = v
        before.unpersist()
        low, high = zip(*(running_sums(found, inner[:, k], s) for k, s in enumerate(_steps(found.sums, found.at))))
        if self.shared is not None:
            self.shared.unpersist()
        self.shared = self._share((found.before, np.array(low).T, np.array(high).T))

    def _share(self, value: Any) -> Any:
        return self.timeline.spark.sparkContext.broadcast(value)

    def histograms(self, tree: Tree, wanted: list[int], columns: list[int]) -> np.ndarray:
        spec, given, number, shared = self.spec, self.trees, self.number, self.shared

        out = []
        for begin in range(0, len(wanted), NODES_AT_ONCE):
            nodes = wanted[begin : begin + NODES_AT_ONCE]

            def add_up(part: Part, nodes: list[int] = nodes) -> np.ndarray:
                carry = tuple(v[part.number] for v in shared.value)
                g, h = _gradients(part, np.exp(_margin(part, given, spec.learning_rate)), carry)
                rows = _Rows(part.x)
                drawn = _drawn(part, spec.random_state, number, spec.subsample) if spec.subsample < 1 else np.ones(len(g), bool)
                rows.hold(np.flatnonzero(drawn))
                rows.sink(tree)
                return np.array([rows.histograms(node, columns, g, h) for node in nodes]).ravel()

            most = SENT_BYTES // (len(nodes) * len(columns) * BINS * 16)
            out.append(self.timeline.total(add_up, most).reshape(len(nodes), len(columns), BINS, 2))
        return np.concatenate(out)


class _Growing:
    """A tree in binned thresholds, grown level by level."""

    def __init__(self):
        self.feature, self.threshold, self.below, self.above, self.value = [-1], [0.0], [-1], [-1], [0.0]

    def tree(self) -> Tree:
        return Tree(*(np.array(c) for c in (self.feature, self.threshold, self.below, self.above, self.value)))

    def leaf(self, value: float) -> int:
        for column, v in zip((self.feature, self.threshold, self.below, self.above, self.value), (-1, 0.0, -1, -1, value)):
            column.append(v)
        return len(self.feature) - 1


def _best_split(sums: np.ndarray, spec: BoostedCox) -> tuple[float, int, int, np.ndarray, np.ndarray] | None:
    """(gain, column, bin, sums below, sums above) of a node's histograms; of equal gains the first column and bin."""
    below = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    above = whole - below
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + spec.reg_lambda)
    gain = score(below) + score(above) - score(whole)
    gain[(below[..., 1] < spec.min_child_weight) | (above[..., 1] < spec.min_child_weight)] = -math.inf
    column, place = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[column, place] > LEAST_GAIN:
        return None
    return float(gain[column, place]), int(column), int(place), below[column, place], above[column, place]


def _grow(sums: _InTask | _OnTable, spec: BoostedCox, width: int, number: int) -> Tree:
    """One tree, its thresholds being bins."""
    kept = max(1, round(spec.colsample_bytree * width))
    columns = sorted(random.Random(spec.random_state * 1_000_003 + number).sample(range(width), kept))
    worth = lambda s: float(-s[0] / (s[1] + spec.reg_lambda))
    growing = _Growing()
    at_level = {0: sums.histograms(growing.tree(), [0], columns)[0]}
    growing.value[0] = worth(at_level[0][0].sum(axis=0))
    for depth in range(spec.max_depth):
        pairs = []
        for node, held in sorted(at_level.items()):
            split = _best_split(held, spec)
            if split is None:
                continue
            _, column, place, below, above = split
            growing.feature[node], growing.threshold[node] = columns[column], float(place)
            growing.below[node], growing.above[node] = growing.leaf(worth(below)), growing.leaf(worth(above))
            children = [(growing.below[node], below[1]), (growing.above[node], above[1])]
            pairs.append((held, *(c for c, _ in sorted(children, key=lambda c: c[1]))))
        if depth + 1 == spec.max_depth or not pairs:
            break
        found = sums.histograms(growing.tree(), [small for _, small, _ in pairs], columns)
        at_level = {}
        for (held, small, large), mine in zip(pairs, found):
            at_level[small], at_level[large] = mine, held - mine
    return growing.tree()


def _losses(timeline: Timeline, trees: list[Tree], rate: float) -> list[float]:
    """The mean negative log partial likelihood per event after each of the trees, for all of them in one or two scans."""
    k, single = len(trees), timeline.parts == 1

    def sums(part: Part) -> tuple[np.ndarray, np.ndarray]:
        """Per time: events, and the summed weights after each tree; and the summed margins of events."""
        m = part.m
        columns, died = [part.e.astype(float)], []
        for tree in trees:
            m = m + rate * tree.values(part.x)
            columns.append(np.exp(m))
            died.append(m[part.e > 0].sum())
        return part.per_time(np.column_stack(columns)), np.array(died)

    def log_sums(total: np.ndarray, at: np.ndarray) -> np.ndarray:
        dead = at[:, 0] > 0
        return at[dead, 0] @ np.log(total[dead, 1:])

    outside, shared = np.zeros(k), None
    if not single:

        def totals(part: Part) -> Iterator[tuple[int, np.ndarray]]:
            yield 0, border_vector(part, sums(part)[0])

        found = borders({q: v for q, _, v in timeline.vectors(totals)}, timeline.parts)
        outside = log_sums(found.sums, found.at)
        shared = timeline.spark.sparkContext.broadcast(found.before)

    def inside(part: Part) -> Iterator[tuple[int, np.ndarray]]:
        at, died = sums(part)
        own, before = (at, 0.0) if shared is None else (at[1:-1], shared.value[part.number])
        yield 0, np.concatenate([[part.e.sum()], died - log_sums(before + np.cumsum(own, axis=0), own)])

    total = sum((v for _, _, v in timeline.vectors(inside)), np.zeros(k + 1))
    return [float(-(v - o) / total[0]) if total[0] else math.nan for v, o in zip(total[1:], outside)]


@dataclass(frozen=True)
class BoostedCox:
    """Each round: gradient and curvature of the Cox loss from risk-set sums, then one tree.

    A split needs a summed curvature of min_child_weight on both sides; leaves are Newton steps -G / (H + reg_lambda). With
    an eval_set, rounds end early_stopping_rounds after the least loss on it.
    """

    n_estimators: int = 400
    max_depth: int = 6
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 5
    early_stopping_rounds: int | None = 30
    random_state: int = 42
    reg_lambda: float = 1.0
    part_rows: int = PART_ROWS

    @property
    def name(self) -> str:
        return "BoostedCox"

    def get_params(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "part_rows"}

    def fit(
        self, df: DataFrame, features: Sequence[str], eval_set: DataFrame | None = None
    ) -> BoostedModel:
        features = list(features)
        names = [f"v{i}" for i in range(len(features))]

        def prepared(rows: DataFrame) -> DataFrame:
            return materialise(
                rows.select(
                    F.col("duration").cast("double").alias("t"),
                    F.col("event").cast("int").alias("e"),
                    F.lit(NO_GROUP).alias("g"),
                    *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)],
                ),
                "boost",
            )

        train = prepared(df)
        tables = [train] + ([prepared(eval_set)] if eval_set is not None and eval_set is not df else [])
        cuts = bin_borders(train, names)
        sizes = [t.count() for t in tables]
        # Both tables are in one part or both in several, as each tree is grown by one of both ways.
        rows = max(self.part_rows, TASK_ROWS) if self.part_rows == PART_ROWS and max(sizes) <= TASK_ROWS else self.part_rows
        lines = [Timeline(t, names, n, rows, np.uint8, binned(cuts)) for t, n in zip(tables, sizes)]
        try:
            trees, losses = self._rounds(lines[0], lines[-1] if eval_set is not None else None, len(names))
        finally:
            for line in lines:
                line.release()
        trees = [_in_values(t, cuts) for t in trees]
        scored = train.select(
            F.col("t").alias("duration"),
            F.col("e").alias("event"),
            forest_column(trees, names, self.learning_rate).alias("risk"),
        )
        scored = materialise(scored, "scored")
        model = BoostedModel(
            name=self.name,
            features=features,
            baseline=materialise(breslow_baseline(scored), "baseline"),
            params=self.get_params(),
            version=f"boosted-{uuid.uuid4().hex[:12]}",
            trees=trees,
            rate=self.learning_rate,
            losses=losses,
        )
        discard(scored, *tables)
        return model

    def _rounds(self, line: Timeline, held_out: Timeline | None, width: int) -> tuple[list[Tree], list[float]]:
        """The trees, their thresholds being bins, and the losses after each."""
        trees: list[Tree] = []
        losses: list[float] = []
        # A task that holds all rows also knows their losses: it grows the trees to the end.
        alone = line.parts == 1 and held_out in (None, line)
        moved = moves = 0
        while len(trees) < self.n_estimators:
            at_once = self.n_estimators if alone else ROUNDS if line.parts == 1 else TABLE_ROUNDS
            more, after = self._grown(line, width, len(trees), min(at_once, self.n_estimators - len(trees)), alone and held_out is not None)
            trees += more
            if held_out is not None:
                losses += after if alone else _losses(held_out, more, self.learning_rate)
                if self._past_best(losses):
                    # Rounds that a round-by-round check would not have seen do not count.
                    end = next(n for n in range(len(losses)) if self._past_best(losses[: n + 1]))
                    losses = losses[: end + 1]
                    return trees[: int(np.argmin(losses)) + 1], losses
            if len(trees) < self.n_estimators:
                rate, moves = self.learning_rate, moves + 1
                afresh = moves % MOVES == 0
                given = tuple(trees if afresh or not moved else trees[moved:])
                for each in {id(x): x for x in (line, held_out) if x is not None}.values():
                    each.advance(lambda part, given=given: _margin(part, given, rate), afresh)
                moved = len(trees)
        return trees, losses

    def _past_best(self, losses: list[float]) -> bool:
        return self.early_stopping_rounds is not None and len(losses) - 1 - int(np.argmin(losses)) >= self.early_stopping_rounds

    def _grown(self, line: Timeline, width: int, first: int, rounds: int, judged: bool) -> tuple[list[Tree], list[float]]:
        """The trees of so many rounds; judged: the task also gives the losses after each and ends early by them."""
        if line.parts > 1:
            sums, trees = _OnTable(line, self), []
            for number in range(first, first + rounds):
                sums.start(trees, number)
                trees.append(_grow(sums, self, width, number))
            return trees, []
        spec = self

        def boost(part: Part) -> Iterator[pa.RecordBatch]:
            sums, grown, losses = _InTask(part, spec), [], []
            del part
            for number in range(first, first + rounds):
                sums.start(grown, number)
                grown.append(_grow(sums, spec, width, number))
                if judged:
                    sums.follow(grown)
                    losses.append(sums.loss())
                    if spec._past_best(losses):
                        break
            rows = [r for i, t in enumerate(grown) for r in t.rows(i)]
            rows += [(i, LOSS, -1, 0.0, -1, -1, loss) for i, loss in enumerate(losses)]
            names = ["tree", "node", "feature", "threshold", "below", "above", "value"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        by_tree: dict[int, list] = {}
        after: list[float] = []
        for r in sorted(line.rows(boost, NODE_SCHEMA).collect(), key=lambda r: (r["tree"], r["node"])):
            if r["node"] == LOSS:
                after.append(r["value"])
            else:
                by_tree.setdefault(r["tree"], []).append(r)
        return [Tree.of_rows(by_tree[k]) for k in sorted(by_tree)], after


def _in_values(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """The tree with the borders of its bins as thresholds; a bin beyond the last border takes all values."""
    threshold = [
        0.0 if f < 0 else cuts[f][int(b)] if int(b) < len(cuts[f]) else math.inf for f, b in zip(tree.feature, tree.threshold)
    ]
    return Tree(tree.feature, np.array(threshold, float), tree.below, tree.above, tree.value)
