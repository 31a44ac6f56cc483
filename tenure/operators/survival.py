"""Cox proportional hazards on Spark: fit, baseline hazard, curves, medians, loss.

The fit lays its rows out in the order of time once (`plans.timeline`); a Newton step then only moves sums. The second
moments of the risk sets need no table of their own, because

    sum_k a_k * S2(t_k) = sum_j exp(r_j) * x_j x_j' * A(t_j),   A(t) = sum_{t_k <= t} a_k.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.functions.special import digamma, log_gamma, trigamma
from tenure.plans.materialise import discard, is_written, materialise
from tenure.plans.ordered import (
    BUCKET,
    ONE_WINDOW_LIMIT,
    Splits,
    measure_splits,
    running,
    step_lookup,
    with_bucket,
)
from tenure.plans.timeline import NO_GROUP, PART_ROWS, Borders, Part, Timeline, border_vector, borders
from tenure.sources.io import read_table, write_table

DEFAULT_HORIZONS = (30, 60, 90, 180, 365)
RANK_TOLERANCE = 1e-10  # of the greatest eigenvalue: below it the likelihood is flat
FEW_TIMES = 64  # times that are written into the plan itself
CURVE_POINTS = 4096  # times in one array of a curve
TASKS_PER_CORE = 4  # of rows that meet a whole curve
AREA_CELLS = 1 << 18  # (row, time) values that a task of restricted_mean holds at once
ENDLESS = 12.0  # log hazard per standard deviation beyond which a coefficient has no finite value
DIRECT_TIES = 512  # tied events summed term by term; beyond that in closed form


class SurvivalEstimator(Protocol):
    """What the trainer needs of a model."""

    @property
    def name(self) -> str: ...

    def get_params(self) -> dict[str, Any]: ...

    def fit(self, df: DataFrame, features: Sequence[str]) -> "SurvivalModel": ...


# --- pieces shared by fit, baseline and loss ----------------------------------------------------


def linear_risk(features: Sequence[str], coef: Sequence[float]) -> Column:
    """beta . x as one generated expression, summed in feature order."""
    total = F.lit(0.0)
    for i, (name, weight) in enumerate(zip(features, coef)):
        term = F.lit(float(weight)) * F.col(name).cast("double")
        total = term if i == 0 else total + term
    return total


def risk_sets(
    scored: DataFrame,
    sums: dict[str, Column] | None = None,
    duration: str = "duration",
    event: str = "event",
    risk: str = "risk",
    splits: Splits | None = None,
) -> tuple[DataFrame, bool]:
    """Per distinct duration: deaths `d`, `s0` = sum of exp(risk) over the risk set, and `sums`
    accumulated over the risk set likewise. Second value: whether the table is bucketed.
    """
    sums = sums or {}
    staged = scored.select(
        F.col(duration).cast("double").alias("t"),
        F.col(event).cast("int").alias("_e"),
        F.exp(F.col(risk)).alias("_w"),
        F.col(risk).alias("_r"),
        *[c.alias(n) for n, c in sums.items()],
    )
    if splits is None:
        splits = measure_splits(staged, ["t"])["t"]
    cells = (
        with_bucket(staged, splits)
        .groupBy(BUCKET, "t")
        .agg(
            F.sum("_e").alias("d"),
            F.sum(F.when(F.col("_e") == 1, F.col("_r")).otherwise(0.0)).alias("death_risk"),
            F.sum("_w").alias("s0"),
            *[F.sum(n).alias(n) for n in sums],
        )
    )
    outputs = {n: F.col(n) for n in ("s0", *sums)}
    return running(cells, "t", outputs, descending=True, bucketed=splits.bucketed), splits.bucketed


def breslow_baseline(
    scored: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk"
) -> DataFrame:
    """(t, hazard): cumulative baseline hazard at every distinct duration."""
    sets, bucketed = risk_sets(scored, duration=duration, event=event, risk=risk)
    return running(
        sets, "t", {"hazard": F.col("d") / F.col("s0")}, bucketed=bucketed
    ).select("t", "hazard")


def partial_log_likelihood(
    scored: DataFrame, duration: str = "duration", event: str = "event", risk: str = "risk"
) -> DataFrame:
    """One row: events, total Breslow log-likelihood, and its negated mean per event (the loss).

    Ties share the whole risk set of their time. The largest risk is taken off all risks first, which leaves the
    likelihood alone and keeps their exponentials finite.
    """
    top = scored.agg(F.max(risk)).first()[0]
    scored = scored.withColumn(risk, F.col(risk) - F.lit(float(top or 0.0)))
    sets, _ = risk_sets(scored, duration=duration, event=event, risk=risk)
    each = F.col("death_risk") - F.col("d") * F.log("s0")
    return sets.filter(F.col("d") > 0).agg(
        F.sum("d").alias("n_events"),
        F.sum(each).alias("log_likelihood"),
        F.try_divide(-F.sum(each), F.sum("d").cast("double")).alias("loss"),
    )


def tie_terms(d: np.ndarray, s0: np.ndarray, e0: np.ndarray) -> dict[str, np.ndarray]:
    """Efron sums over the d tied events of each time, m = 0..d-1, D_m = s0 - (m/d) e0:

    log = sum log D_m, a = sum 1/D_m, b = sum (m/d)/D_m, cq = sum (m/d)^q / D_m^2.
    Large d goes through the gamma function family instead of a loop over events.
    """
    out = {k: np.zeros(len(d)) for k in ("log", "a", "b", "c0", "c1", "c2")}
    small = (d > 0) & (d <= DIRECT_TIES)
    for m in range(int(d[small].max()) if small.any() else 0):
        at = np.flatnonzero(small & (d > m))
        f = m / d[at]
        den = s0[at] - f * e0[at]
        out["log"][at] += np.log(den)
        out["a"][at] += 1 / den
        out["b"][at] += f / den
        for q in range(3):
            out[f"c{q}"][at] += f**q / den**2
    big = np.flatnonzero(d > DIRECT_TIES)
    if big.size:
        n, e = d[big].astype(float), e0[big]
        z = n * s0[big] / e
        one = digamma(z + 1) - digamma(z - n + 1)
        two = trigamma(z - n + 1) - trigamma(z + 1)
        out["log"][big] = n * np.log(e / n) + log_gamma(z + 1) - log_gamma(z - n + 1)
        out["a"][big] = n / e * one
        out["b"][big] = (z * one - n) / e
        out["c0"][big] = (n / e) ** 2 * two
        out["c1"][big] = n / e**2 * (z * two - one)
        out["c2"][big] = (z * z * two - 2 * z * one + n) / e**2
    return out


# --- fitted model -------------------------------------------------------------------------------


@dataclass
class SurvivalModel:
    """A fitted model: how to score a row, and the baseline cumulative hazard.

    `baseline` is a table (t, hazard), one row per distinct training duration.
    """

    name: str
    features: list[str]
    baseline: DataFrame
    params: dict[str, Any] = field(default_factory=dict)
    version: str = "unknown"

    def risk_column(self) -> Column:
        raise NotImplementedError

    def risk(self, df: DataFrame) -> DataFrame:
        """Add `risk`, higher meaning earlier churn."""
        return df.withColumn("risk", self.risk_column())

    def hazard_at(self, times: Sequence[float]) -> list[float]:
        """Cumulative baseline hazard at each time: 0 before the first, carried forward after."""
        if not len(times):
            return []
        if len(times) <= FEW_TIMES:
            at = [F.coalesce(F.max(F.when(F.col("t") <= float(t), F.col("hazard"))), F.lit(0.0)).alias(f"h{i}") for i, t in enumerate(times)]
            return [float(v) for v in self.baseline.agg(*at).first()]
        asked = self.baseline.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "i int, at double")
        found = step_lookup(asked, "at", self.baseline, "t", ["hazard"])
        hazard = {r["i"]: r["hazard"] for r in found.select("i", "hazard").collect()}
        return [0.0 if hazard[i] is None else float(hazard[i]) for i in range(len(times))]

    def survival_array(self, times: Sequence[float], risk: str = "risk") -> Column:
        """array<double> of S(t | x) at the times, a projection over a column of risks."""
        scale = F.exp(F.col(risk))
        hazards = self.hazard_at(times)
        return F.array(*[F.exp(-F.lit(h) * scale) for h in hazards])

    def curve(self, times: Sequence[float] | None = None) -> DataFrame:
        """(points): the baseline at the times (all training times by default) as arrays of (t, h) in order of time.

        One array per range of times, so that neither the number of training times nor that of arrays has a limit.
        """
        if times is None:
            points = self.baseline.select("t", F.col("hazard").alias("h"))
        else:
            rows = [(float(t), h) for t, h in zip(times, self.hazard_at(times))]
            points = self.baseline.sparkSession.createDataFrame(rows, "t double, h double")
        ranges = with_bucket(points, measure_splits(points, ["t"], CURVE_POINTS)["t"])
        return ranges.groupBy(BUCKET).agg(F.array_sort(F.collect_list(F.struct("t", "h"))).alias("points")).select("points")

    def survival(self, df: DataFrame, times: Sequence[float] | None = None) -> DataFrame:
        """One row per (input row, t) with `surv`; times default to the training times.

        Every row meets every array of the curve, as every row has a value at every time.
        """
        if times is not None and 0 < len(times) <= FEW_TIMES:
            points = [F.struct(F.lit(float(t)).alias("t"), F.lit(h).alias("h")) for t, h in zip(times, self.hazard_at(times))]
            rows = self.risk(df).withColumn("_points", F.array(*points))
        else:
            rows = _meet(self.risk(df), self.curve(times).withColumnRenamed("points", "_points"), self._few(times))
        scaled = rows.withColumn("_scale", F.exp(F.col("risk"))).withColumn("_at", F.explode("_points"))
        return scaled.select(*df.columns, "risk", F.col("_at.t").alias("t"), F.exp(-F.col("_at.h") * F.col("_scale")).alias("surv"))

    def _few(self, times: Sequence[float] | None = None) -> bool:
        """Whether the times of a curve (all training times by default) are counted to be few enough for every task to hold them."""
        return (self.baseline.count() if times is None else len(times)) <= ONE_WINDOW_LIMIT

    def restricted_mean(self, df: DataFrame) -> DataFrame:
        """Add `risk`, `n_times`, `horizon_days` (the last training time) and `mean_days`: the area below the whole curve up to there."""
        points = materialise(self.baseline.select("t", F.col("hazard").alias("h")), "curve")
        if self._few():
            curve = points.orderBy("t").toArrow()
            if curve.num_rows and not any(c.null_count for c in curve.columns):
                return _restricted_mean_by_rows(self.risk(df), curve)
        span = Window.orderBy("t")
        splits = measure_splits(points, ["t"], CURVE_POINTS)["t"]
        ranges = with_bucket(points, splits)
        first = ranges.groupBy(BUCKET).agg(F.min("t").alias("t"))
        following = first.select(BUCKET, F.lead("t").over(span).alias("_next"))  # one row per range
        inside = Window.partitionBy(BUCKET).orderBy("t")
        steps = ranges.join(F.broadcast(following), BUCKET).select(
            BUCKET, "t", "h", (F.coalesce(F.lead("t").over(inside), "_next", "t") - F.col("t")).alias("width")
        )
        pieces = steps.groupBy(BUCKET).agg(
            F.collect_list(F.struct("h", "width")).alias("_points"), F.min("t").alias("_first"), F.max("t").alias("_last")
        ).drop(BUCKET)
        start = points.agg(F.min("t").alias("_start"))
        area = F.aggregate("_points", F.lit(0.0), lambda s, x: s + x["width"] * F.exp(-x["h"] * F.exp(F.col("risk"))))
        # A row's ranges are added up in the order of time, so the sum does not hang on the order of rows.
        row = self.risk(df).withColumn("_row", F.struct(*df.columns, "risk"))
        number = F.monotonically_increasing_id()
        met = _meet(row.withColumn("_id", number), pieces, False).select("_id", "_row", "_first", "_last", F.size("_points").alias("_n"), area.alias("_area"))
        parts = F.array_sort(F.collect_list(F.struct("_first", "_area")))
        whole = met.groupBy("_id").agg(F.first("_row").alias("_row"), F.sum("_n").alias("n_times"), F.max("_last").alias("horizon_days"), parts.alias("_parts"))
        mean = F.aggregate("_parts", F.col("_start"), lambda s, x: s + x["_area"])
        return whole.crossJoin(F.broadcast(start)).select("_row.*", "n_times", "horizon_days", mean.alias("mean_days"))

    def median(self, df: DataFrame) -> DataFrame:
        """Add `risk` and `median_days`: the first time with S <= 1/2, infinite when there is none.

        S(t) <= 1/2 means hazard(t) >= ln 2 * exp(-risk): a search for the first such step, done
        as the last step <= x on the negated axis.
        """
        steps = (
            self.baseline.filter(F.col("hazard") > 0)
            .groupBy((-F.col("hazard")).alias("_minus"))
            .agg(F.min("t").alias("median_days"))
        )
        asked = self.risk(df).withColumn("_x", -F.lit(math.log(2.0)) * F.exp(-F.col("risk")))
        found = step_lookup(asked, "_x", steps, "_minus", ["median_days"])
        endless = F.lit(float("inf"))
        return found.select(
            *df.columns, "risk", F.coalesce(F.col("median_days"), endless).alias("median_days")
        )

    def get_params(self) -> dict[str, Any]:
        return dict(self.params)


def _meet(rows: DataFrame, pieces: DataFrame, few: bool) -> DataFrame:
    """Every row beside every piece of a curve.

    Rows are streamed: few pieces are copied to every task, others are read again for each part of the rows. Left to itself Spark
    may copy the rows and stream the pieces, and one task then holds all rows beside its piece.
    """
    return _spread(rows).crossJoin(F.broadcast(pieces)) if few else _spread(rows).hint("shuffle_replicate_nl").crossJoin(pieces)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, however few files hold them: their work is rows times points of a curve."""
    return rows.repartition(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def _restricted_mean_by_rows(rows: DataFrame, curve: pa.Table) -> DataFrame:
    """restricted_mean() of rows with `risk` below a curve (t, h) in order of time that every task holds."""
    t, h = (curve.column(c).to_numpy() for c in ("t", "h"))
    shared = rows.sparkSession.sparkContext.broadcast((h, np.diff(t, append=t[-1:])))

    @F.arrow_udf("double")
    def area(risk: pa.Array) -> pa.Array:
        hazard, width = shared.value
        scale = np.exp(risk.to_numpy(zero_copy_only=False).astype(float))
        out, step = np.empty(len(scale)), max(1, AREA_CELLS // len(hazard))
        for i in range(0, len(scale), step):
            out[i : i + step] = np.exp(scale[i : i + step, None] * -hazard) @ width
        return pa.array(out, pa.float64(), mask=risk.is_null().to_numpy(zero_copy_only=False))

    return _spread(rows).select(
        "*", F.lit(len(t)).cast("long").alias("n_times"), F.lit(float(t[-1])).alias("horizon_days"), (F.lit(float(t[0])) + area("risk")).alias("mean_days")
    )


@dataclass
class CoxModel(SurvivalModel):
    coef: list[float] = field(default_factory=list)
    n_iterations: int = 0
    loss: float = float("nan")
    gradient_norm: float = float("nan")

    def risk_column(self) -> Column:
        return linear_risk(self.features, self.coef)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, float(b)) for i, (f, b) in enumerate(zip(self.features, self.coef))]
        return spark.createDataFrame(rows, "position int, feature string, coef double")

    def save(self, path: str) -> None:
        spark = self.baseline.sparkSession
        meta = {"name": self.name, "params": self.params, "version": self.version}
        table = self.coefficients(spark).withColumn("meta", F.lit(json.dumps(meta)))
        write_table(table.coalesce(1), f"{path}/coefficients")
        write_table(self.baseline, f"{path}/baseline")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CoxModel":
        rows = read_table(spark, f"{path}/coefficients").orderBy("position").collect()
        meta = json.loads(rows[0]["meta"]) if rows else {"name": "CoxPH", "params": {}, "version": path}
        return cls(
            name=meta["name"],
            features=[r["feature"] for r in rows],
            baseline=read_table(spark, f"{path}/baseline"),
            params=meta["params"],
            version=meta["version"],
            coef=[r["coef"] for r in rows],
        )


# --- Cox fit ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CoxPH:
    """Ridge-penalised Cox model, Newton steps with halving.

    Minimises (-log partial likelihood + alpha/2 * |beta|^2) / n and stops when the relative change
    of that value falls below `tol`. Without a penalty (alpha = 0) directions that the likelihood does not
    depend on, such as those of a full set of dummies, stay where they are, and a coefficient that grows without
    end (monotone likelihood) is an error that names its feature.
    """

    alpha: float = 1.0
    ties: str = "breslow"
    n_iter: int = 100
    tol: float = 1e-9
    part_rows: int = PART_ROWS

    @property
    def name(self) -> str:
        return "CoxPH"

    def get_params(self) -> dict[str, Any]:
        return {"alpha": self.alpha, "ties": self.ties, "n_iter": self.n_iter, "tol": self.tol}

    def fit(self, df: DataFrame, features: Sequence[str]) -> CoxModel:
        return self._fit(df, list(features), None, 1)[0]

    def fit_folds(self, df: DataFrame, features: Sequence[str], k: int, fold: str = "fold") -> list[CoxModel]:
        """One model per fold, each fitted on the rows of all other folds; every scan serves all models."""
        return self._fit(df, list(features), fold, k)

    def derivatives(self, df: DataFrame, features: Sequence[str], beta: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised negative log partial likelihood at beta, with its gradient and second derivatives."""
        problem = _CoxProblem.prepare(df, list(features), self, None, 1)
        try:
            state = problem.evaluate({0: np.array(beta, float)})[0]
            n = problem.n[0]
            return float(state.loss * n), state.gradient * n, problem.hessian({0: state})[0] * n
        finally:
            problem.release()

    def _fit(self, df: DataFrame, features: list[str], fold: str | None, k: int) -> list[CoxModel]:
        if self.alpha < 0:
            raise ValueError("alpha must not be negative")
        if self.ties not in ("breslow", "efron"):
            raise ValueError(f"unknown ties method {self.ties!r}")
        problem = _CoxProblem.prepare(df, features, self, fold, k)
        try:
            states, steps = self._minimise(problem)
            return [
                CoxModel(
                    name=self.name,
                    features=features,
                    baseline=baseline,
                    params=self.get_params(),
                    version=f"cox-{uuid.uuid4().hex[:12]}",
                    coef=[float(b) for b in states[m].beta],
                    n_iterations=steps[m],
                    loss=float(states[m].loss),
                    gradient_norm=float(np.linalg.norm(states[m].gradient)),
                )
                for m, baseline in enumerate(problem.baselines(states))
            ]
        finally:
            problem.release()

    def _minimise(self, problem: _CoxProblem) -> tuple[dict[int, _State], dict[int, int]]:
        """Newton steps of all models at once; a model that has converged drops out of the scans."""
        states = problem.evaluate({m: np.zeros(len(problem.features)) for m in range(problem.models)})
        steps = dict.fromkeys(states, 0)
        active = set(states)
        while active:
            delta = {}
            for m, hessian in problem.hessian({m: states[m] for m in active}).items():
                delta[m] = self._direction(hessian, states[m].gradient)
                steps[m] += 1
            ahead = problem.evaluate({m: states[m].beta - delta[m] for m in active})

            def worse() -> set[int]:
                return {
                    m for m in active
                    if ahead[m].loss > states[m].loss and steps[m] < self.n_iter and np.abs(delta[m]).max() > 1e-14
                }

            while again := worse():
                for m in again:
                    delta[m] = delta[m] / 2
                    steps[m] += 1
                ahead |= problem.evaluate({m: states[m].beta - delta[m] for m in again})
            for m in list(active):
                loss, before = ahead[m].loss, states[m].loss
                states[m] = ahead[m]
                if (abs(1 - loss / before) if before else abs(loss)) < self.tol or steps[m] >= self.n_iter:
                    active.discard(m)
        if self.alpha == 0:
            problem.refuse_endless(states)
        return states, steps

    def _direction(self, hessian: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        if self.alpha > 0:
            delta = np.linalg.solve(hessian, gradient)
        else:
            size, axes = np.linalg.eigh(hessian)
            kept = size > max(size.max(initial=0.0), 0.0) * RANK_TOLERANCE
            delta = axes[:, kept] @ ((axes[:, kept].T @ gradient) / size[kept])
        if not np.all(np.isfinite(delta)):
            raise ValueError("search direction is not finite, raise alpha")
        return delta


@dataclass
class _State:
    """A model's loss and gradient, and what its Hessian and baseline need of each part."""

    beta: np.ndarray
    loss: float
    gradient: np.ndarray
    borders: Borders | None  # None: one part
    inner: np.ndarray  # per part: log, a, hazard of its inner times
    terms: dict[str, np.ndarray] | None  # of the border times


def running_sums(borders: Borders, inner: np.ndarray, at_border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part, a running sum over ascending times up to its last (lowest) and up to its first time."""
    place = {t: i for i, t in enumerate(borders.times)}
    below = np.zeros(len(borders.times) + 1)
    for q, t in enumerate(borders.first):
        if not np.isnan(t):
            below[place[t]] += inner[q]  # inner times of q lie below its first time
    total = np.cumsum((at_border + below[:-1])[::-1])[::-1]
    found = [[total[place[t]] if not np.isnan(t) else 0.0 for t in side] for side in (borders.last, borders.first)]
    return np.array(found[0]), np.array(found[1])


@dataclass
class _CoxProblem:
    """Rows in the order of time and one model per fold (or one of all rows).

    A Newton step scans the parts three times for all models (twice if there is one part): totals per part, terms of the times
    inside, second derivatives. Nothing is shuffled but those sums.
    """

    timeline: Timeline
    source: DataFrame | None  # the table written for this fit
    spec: CoxPH
    features: list[str]
    models: int
    centre: np.ndarray
    deviation: np.ndarray
    n: np.ndarray  # rows of each model
    death_x: np.ndarray  # per model, the sum of x over its events

    @classmethod
    def prepare(cls, df: DataFrame, features: list[str], spec: CoxPH, fold: str | None, models: int) -> _CoxProblem:
        """Lay the needed columns out in the order of time, from a table that is written, and centre them by the sums of the parts."""
        group = F.lit(NO_GROUP) if fold is None else F.col(fold).cast("int")
        p = len(features)
        names = [f"v{i}" for i in range(p)]
        keep = df.select(
            F.col("duration").cast("double").alias("t"),
            F.col("event").cast("int").alias("e"),
            group.alias("g"),
            *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)],
        )
        source = None if is_written(df) else materialise(keep, "cox")
        keep = keep if source is None else source
        size = keep.count()
        if not size:
            raise ValueError("no rows to fit on")
        line = Timeline(keep, names, size, spec.part_rows)

        def sums(part: Part) -> Iterator[tuple[int, np.ndarray]]:
            for m in np.unique(part.g):
                out = np.zeros((3, p + 1))
                for rows in part.strips():
                    mine = part.g[rows] == m
                    x, died = part.x[rows][mine], part.e[rows][mine].astype(float)
                    out[:, :p] += x.sum(axis=0), died @ x, (x**2).sum(axis=0)
                    out[:2, p] += mine.sum(), died.sum()
                yield int(m), out.ravel()

        try:
            totals: dict[int, np.ndarray] = {}
            for _, m, v in line.vectors(sums):
                totals[m] = totals.get(m, 0.0) + v.reshape(3, p + 1)
            every = sum(totals.values(), np.zeros((3, p + 1)))
            centre = every[0, :p] / size
            if np.isnan(centre).any():
                bad = [f for f, c in zip(features, centre) if np.isnan(c)]
                raise ValueError(f"missing values in {', '.join(bad)}: impute first")
            own = [every - totals.get(m, 0.0) for m in range(models)] if fold is not None else [every]
            if any(o[1, p] == 0 for o in own):
                raise ValueError("no event observed")
        except Exception:
            line.release()
            if source is not None:
                discard(source)
            raise
        line.centre = centre
        return cls(
            timeline=line,
            source=source,
            spec=spec,
            features=features,
            models=models,
            centre=centre,
            deviation=np.sqrt(np.maximum(every[2, :p] / size - centre**2, 0.0)),
            n=np.array([o[0, p] for o in own]),
            death_x=np.array([o[1, :p] - o[1, p] * centre for o in own]),
        )

    def release(self) -> None:
        """Give back the parts and, where one was written for them, the table they can be made from again."""
        self.timeline.release()
        if self.source is not None:
            discard(self.source)

    @property
    def efron(self) -> bool:
        return self.spec.ties == "efron"

    def _cells(self) -> Callable[[Part, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A part's sums per distinct time for a model (d, s0, s1..., and e0, e1... over the events for Efron), and its rows' weights and deaths."""
        efron = self.efron

        def cells(part: Part, m: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            mine = (part.g != m).astype(float)
            died = part.e * mine
            w = np.exp(part.x @ beta) * mine
            p = part.x.shape[1]
            out = np.empty((len(part.start), (3 + 2 * p) if efron else 2 + p))
            out[:, 0], out[:, 1], out[:, 2 : 2 + p] = part.per_time(died), part.per_time(w), part.weighted(w)
            if efron:
                out[:, 2 + p], out[:, 3 + p :] = part.per_time(died * w), part.weighted(died * w)
            return out, w, died

        return cells

    def _split(self, sums: np.ndarray, cells: np.ndarray) -> dict[str, np.ndarray]:
        """Terms of times whose risk-set sums and own sums are given, with S1 and E1 beside them."""
        return _split_terms(sums, cells, len(self.features), self.efron)

    def evaluate(self, betas: dict[int, np.ndarray]) -> dict[int, _State]:
        cells, p, efron = self._cells(), len(self.features), self.efron
        single = self.timeline.parts == 1
        found: dict[int, Borders] = {}
        if not single:
            vectors: dict[int, dict[int, np.ndarray]] = {m: {} for m in betas}

            def totals(part: Part) -> Iterator[tuple[int, np.ndarray]]:
                for m, beta in betas.items():
                    yield m, border_vector(part, cells(part, m, beta)[0])

            for q, m, v in self.timeline.vectors(totals):
                vectors[m][q] = v
            found = {m: borders(v, self.timeline.parts) for m, v in vectors.items()}
        before = self._shared({m: b.before for m, b in found.items()})

        def inside(part: Part) -> Iterator[tuple[int, np.ndarray]]:
            for m, beta in betas.items():
                own, _, _ = cells(part, m, beta)
                own, carry = (own, 0.0) if single else (own[1:-1], before.value[m][part.number])
                x = _split_terms(carry + np.cumsum(own, axis=0), own, p, efron)
                pulled = x["s1"].T @ x["a"] - x["e1"].T @ x["b"]
                yield m, np.concatenate([[x["log"].sum(), x["a"].sum(), x["hazard"].sum()], pulled])

        inner = {m: np.zeros((self.timeline.parts, 3)) for m in betas}
        pulled = {m: np.zeros(p) for m in betas}
        for q, m, v in self.timeline.vectors(inside):
            inner[m][q] = v[:3]
            pulled[m] = pulled[m] + v[3:]
        before.unpersist()
        states = {}
        for m, beta in betas.items():
            log_sum, pull, terms = inner[m][:, 0].sum(), pulled[m], None
            if m in found:
                terms = self._split(found[m].sums, found[m].at)
                log_sum += terms["log"].sum()
                pull = pull + terms["s1"].T @ terms["a"] - terms["e1"].T @ terms["b"]
            log_likelihood = float(beta @ self.death_x[m]) - log_sum
            loss = (-log_likelihood + 0.5 * self.spec.alpha * float(beta @ beta)) / self.n[m]
            gradient = (-(self.death_x[m] - pull) + self.spec.alpha * beta) / self.n[m]
            states[m] = _State(beta, loss, gradient, found.get(m), inner[m], terms)
        return states

    def _shared(self, value: Any) -> Any:
        return self.timeline.spark.sparkContext.broadcast(value)

    def hessian(self, states: dict[int, _State]) -> dict[int, np.ndarray]:
        cells, p, efron = self._cells(), len(self.features), self.efron
        single = self.timeline.parts == 1
        betas = {m: s.beta for m, s in states.items()}
        carried = {}
        for m, s in states.items():
            if s.borders is not None:
                low, high = running_sums(s.borders, s.inner[:, 1], s.terms["a"])
                tied = dict(zip(s.borders.times, s.terms["b"]))
                b = np.array([[tied.get(t, 0.0) for t in side] for side in (s.borders.first, s.borders.last)]).T
                carried[m] = (s.borders.before, low, high, b)
        shared = self._shared(carried)

        def second(part: Part) -> Iterator[pa.RecordBatch]:
            i, j = np.triu_indices(p)
            for m, beta in betas.items():
                own, w, died = cells(part, m, beta)
                if single:
                    x = _split_terms(np.cumsum(own, axis=0), own, p, efron)
                    acc, tied = np.cumsum(x["a"][::-1])[::-1], x["b"]
                else:
                    before, low, high, b = (v[part.number] for v in shared.value[m])
                    x = _split_terms(before + np.cumsum(own[1:-1], axis=0), own[1:-1], p, efron)
                    acc = np.concatenate([[high], low + np.cumsum(x["a"][::-1])[::-1], [low]])[: len(own)]
                    tied = np.concatenate([[b[0]], x["b"], [b[1]]])[: len(own)]
                weight = w * (part.spread(acc) - died * part.spread(tied))
                total = part.squares(weight) - _outer(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), m), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["m", "i", "j", "v"]
                )

        out = {m: self.spec.alpha * np.eye(p) - (_outer(s.terms) if s.terms else 0.0) for m, s in states.items()}
        parts = self.timeline.rows(second, "m int, i int, j int, v double")
        for r in parts.groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect():
            out[r["m"]][r["i"], r["j"]] += r["v"]
            if r["i"] != r["j"]:
                out[r["m"]][r["j"], r["i"]] += r["v"]
        shared.unpersist()
        return {m: h / self.n[m] for m, h in out.items()}

    def refuse_endless(self, states: dict[int, _State]) -> None:
        for s in states.values():
            endless = [f for f, b, d in zip(self.features, s.beta, self.deviation) if abs(b) * d > ENDLESS]
            if endless:
                raise ValueError(f"monotone likelihood, no finite coefficient of {', '.join(endless)}: raise alpha")

    def baselines(self, states: dict[int, _State]) -> list[DataFrame]:
        """Breslow hazards on the uncentred scale, so that S = exp(-H exp(beta . x)): one table (t, hazard) per model."""
        cells, p, efron = self._cells(), len(self.features), self.efron
        single = self.timeline.parts == 1
        betas = {m: s.beta for m, s in states.items()}
        shift = {m: math.exp(-float(s.beta @ self.centre)) for m, s in states.items()}
        carried, at_borders = {}, []
        for m, s in states.items():
            if s.borders is not None:
                low, high = running_sums(s.borders, s.inner[:, 2], s.terms["hazard"])
                total = dict(zip(s.borders.last, low)) | dict(zip(s.borders.first, high))
                own_times = s.borders.times[s.borders.at[:, 1] > 0]
                at_borders += [(m, float(t), float(total[t] * shift[m])) for t in own_times]
                carried[m] = (s.borders.before, low)
        shared = self._shared(carried)

        def hazards(part: Part) -> Iterator[pa.RecordBatch]:
            for m, beta in betas.items():
                own, _, _ = cells(part, m, beta)
                times, before, low = part.time, 0.0, 0.0
                if not single:
                    own, times = own[1:-1], times[1:-1]
                    before, low = (v[part.number] for v in shared.value[m])
                present = own[:, 1] > 0
                x = _split_terms(before + np.cumsum(own, axis=0), own, p, efron)
                hazard = (low + np.cumsum(x["hazard"][::-1])[::-1]) * shift[m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(present.sum()), m), pa.int32()), pa.array(times[present]), pa.array(hazard[present])], ["m", "t", "hazard"]
                )

        schema = "m int, t double, hazard double"
        table = self.timeline.rows(hazards, schema)
        if at_borders:
            table = table.unionByName(self.timeline.spark.createDataFrame(at_borders, schema))
        table = materialise(table, "baseline")
        shared.unpersist()
        return [table.filter(F.col("m") == m).select("t", "hazard") for m in sorted(states)]


def _split_terms(sums: np.ndarray, cells: np.ndarray, p: int, efron: bool) -> dict[str, np.ndarray]:
    d, s0 = cells[:, 0], sums[:, 1]
    out = _time_terms(d, s0, cells[:, 2 + p] if efron else None)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["hazard"] = np.where(d > 0, d / s0, 0.0)
    out["s1"] = sums[:, 2 : 2 + p]
    out["e1"] = cells[:, 3 + p :] if efron else np.zeros((len(d), p))
    return out


def _outer(x: dict[str, np.ndarray]) -> np.ndarray:
    """The products of risk-set sums that the second derivative takes off, over the times given."""
    s1, e1 = x["s1"], x["e1"]
    out = s1.T @ (s1 * x["c0"][:, None])
    if x["c1"].any() or x["c2"].any():
        cross = s1.T @ (e1 * x["c1"][:, None])
        out = out - cross - cross.T + e1.T @ (e1 * x["c2"][:, None])
    return out


def _time_terms(d: np.ndarray, s0: np.ndarray, e0: np.ndarray | None) -> dict[str, np.ndarray]:
    if e0 is not None:
        return tie_terms(d, s0, e0)
    with np.errstate(divide="ignore", invalid="ignore"):
        died = d > 0
        zero = np.zeros(len(d))
        return {
            "log": np.where(died, d * np.log(s0), 0.0),
            "a": np.where(died, d / s0, 0.0),
            "b": zero,
            "c0": np.where(died, d / s0**2, 0.0),
            "c1": zero,
            "c2": zero,
        }
