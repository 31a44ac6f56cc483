"""Censoring-aware evaluation: concordance, Brier scores, time-dependent AUC, folds.

A scored table holds `risk`, `duration`, `event`. No metric builds pairs: concordance and AUC are
counted from ordered running totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenure.operators.survival import DEFAULT_HORIZONS, SurvivalModel
from tenure.plans.columns import quoted
from tenure.plans.materialise import discard, materialise, materialise_by
from tenure.plans.ordered import (
    BUCKET,
    MAX_BUCKETS,
    ONE_WINDOW_LIMIT,
    measure_splits,
    running,
    step_lookup,
    union_all,
    with_bucket,
)
from tenure.plans.pairs import decimals, pairs_below, total
from tenure.plans.parallel import together
from tenure.plans.timeline import PART_ROWS, Part, Timeline

DRIVER_CELLS = 1 << 24  # (part, risk bucket) counts the driver may hold
BUCKET_ROWS = 1 << 13  # of a group, whose pairs across parts are counted at once
METRIC_SCHEMA = "model string, fold int, metric string, t int, value double"


def c_index(scored: DataFrame, by: str | None = None, part_rows: int = PART_ROWS, buckets: int | None = None) -> DataFrame:
    """Harrell's concordance: concordant, tied, comparable, c_index, in one row or one per value of the whole number `by`. Exact.

    A pair is comparable when the earlier one is an event (a censoring at the same time counts as later). Rows are laid out
    from the latest time to the earliest, at one time censorings first and then the greater risks (`plans.timeline`), so
    a pair is an event and a row before it, but for events of one time, whose pairs are counted apart and taken off. Pairs inside a part are
    counted there. For pairs across parts, risks are cut into buckets: the rows and events of each (part, bucket) settle the pairs
    of different buckets, and pairs of one bucket are counted where the bucket's cells (part, risk) meet. A frequent risk is one
    cell a part and a frequent time is spread over parts, so neither fills a task.
    """
    group = F.lit(0) if by is None else F.col(quoted(by)).cast("int")
    rows = scored.select(
        F.col("duration").cast("double").alias("t"),
        F.coalesce(F.col("event").cast("int"), F.lit(0)).alias("e"),
        group.alias("g"),
        F.col("risk").cast("double").alias("risk"),
    ).dropna()
    count = F.col("n").cast("decimal(38,0)")
    at_risk = rows.groupBy("g", "t", "risk").agg(F.sum("e").alias("n"), F.count(F.lit(1)).alias("all"))
    at_time = at_risk.groupBy("g", "t").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.sum(count * (count - 1) / 2).alias("same"))
    apart = {
        r["g"]: (int(r["same"]), int(r["times"]), r["rows"])
        for r in at_time.groupBy("g").agg(F.sum("same").alias("same"), F.sum(count * (count - 1) / 2).alias("times"), F.sum("all").alias("rows")).collect()
    }
    size = sum(n for *_, n in apart.values())
    if buckets is None:
        # A bucket of a group is a call of its own: no more of them than the rows need.
        buckets = max(2, min(MAX_BUCKETS, -(-size // (BUCKET_ROWS * max(1, len(apart))))))
    line = Timeline(rows, ["risk"], size, part_rows, ties=[F.col("e"), F.col("risk").desc()])
    try:
        counts = _concordance(line, rows, sorted(apart), buckets)
    finally:
        line.release()
    out = []
    for g, (same, times, _) in apart.items():
        concordant, tied, comparable = (float(v) for v in (counts[g][0], counts[g][1] - same, counts[g][2] - times))
        out.append((g, concordant, tied, comparable, (concordant + 0.5 * tied) / comparable if comparable else None))
    if by is None and not out:
        out = [(0, 0.0, 0.0, 0.0, None)]
    table = scored.sparkSession.createDataFrame(out, f"{by or 'g'} int, concordant double, tied double, comparable double, c_index double")
    return table if by is not None else table.drop("g")


def _concordance(line: Timeline, rows: DataFrame, groups: list[int], buckets: int) -> dict[int, list[int]]:
    """Per group, the events and rows before them: of smaller risk, of the same, and all."""
    found = {g: [0, 0, 0] for g in groups}
    many = min(buckets, max(2, DRIVER_CELLS // (line.parts * max(1, len(groups)))))
    borders = np.zeros(0)
    if line.parts > 1:
        points = F.percentile_approx("risk", [i / many for i in range(1, many)], 20 * many)
        borders = np.unique(np.array(rows.select("risk").distinct().agg(points.alias("p")).first()["p"], float))
    width = len(borders) + 1

    def inside(part: Part) -> Iterator[pa.RecordBatch]:
        out = []
        for g in np.unique(part.g):
            mine = part.g == g
            risk, e = part.x[mine, 0], part.e[mine].astype(np.int64)
            place = np.arange(len(risk))
            below, same = pairs_below(place, risk, np.ones(len(risk), np.int64), e)
            bucket = np.searchsorted(borders, risk, "left")
            out.append((int(g), below, same, int(e @ place), np.bincount(bucket, minlength=width), np.bincount(bucket, e, width).astype(np.int64)))
        g, below, same, all_, n, died = zip(*out)
        kinds = [pa.int32(), pa.int32(), *[pa.decimal128(38, 0)] * 3, pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [[part.number] * len(g), g, decimals(below), decimals(same), decimals(all_), n, died]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "g", "below", "same", "all", "n", "died"])

    schema = "part int, g int, below decimal(38,0), same decimal(38,0), all decimal(38,0), n array<long>, died array<long>"
    of_parts: dict[int, dict[int, tuple]] = {g: {} for g in groups}
    for r in line.rows(inside, schema).collect():
        for k, v in enumerate(("below", "same", "all")):
            found[r["g"]][k] += int(r[v])
        of_parts[r["g"]][r["part"]] = (r["n"], r["died"])
    if line.parts == 1:
        return found
    for g, parts in of_parts.items():
        n, died = (np.array([parts[q][k] for q in sorted(parts)], np.int64) for k in (0, 1))
        before = np.cumsum(n, axis=0) - n
        lower = np.cumsum(before, axis=1) - before
        found[g][0] += total((died * lower).ravel())
        found[g][2] += total((died * before.sum(axis=1, keepdims=True)).ravel())

    def cells(part: Part) -> Iterator[pa.RecordBatch]:
        for g in np.unique(part.g):
            mine = part.g == g
            risk, at = np.unique(part.x[mine, 0], return_inverse=True)
            n = np.bincount(at)
            died = np.bincount(at, part.e[mine]).astype(np.int64)
            bucket = np.searchsorted(borders, risk, "left")
            whole = [np.full(len(risk), part.number, np.int32), np.full(len(risk), g, np.int32), bucket.astype(np.int32), risk, n, died]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in whole], ["part", "g", "bucket", "risk", "n", "died"])

    def across(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        place, risk, n, died = (table.column(c).to_numpy() for c in ("part", "risk", "n", "died"))
        below, same = pairs_below(place, risk, n, died)
        kind = pa.decimal128(38, 0)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "below": pa.array(decimals([below]), kind), "same": pa.array(decimals([same]), kind)})

    table = line.rows(cells, "part int, g int, bucket int, risk double, n long, died long")
    # Cells are few bytes, and Spark would let one task count them all.
    table = table.repartition(min(line.parts, width * len(groups)), "g", "bucket")
    table = table.groupBy("g", "bucket").applyInArrow(across, "g int, below decimal(38,0), same decimal(38,0)")
    for r in table.groupBy("g").agg(F.sum("below").alias("below"), F.sum("same").alias("same")).collect():
        found[r["g"]][0] += int(r["below"])
        found[r["g"]][1] += int(r["same"])
    return found


def censoring_km(train: DataFrame) -> DataFrame:
    """(t, g): Kaplan-Meier estimate of still being uncensored after t, per distinct duration.

    At a tied time events leave the risk set before censorings.
    """
    staged = train.select(
        F.col("duration").cast("double").alias("t"), F.col("event").cast("int").alias("_e")
    )
    splits = measure_splits(staged, ["t"])["t"]
    return _uncensored(_time_cells(with_bucket(staged, splits), []), [], splits.bucketed).select("t", "g")


def censoring_km_by_fold(folded: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """(fold, t, g): for each of k folds, censoring_km() of the rows of all others. The rows are read once for all of them."""
    staged = folded.select(
        F.col("duration").cast("double").alias("t"), F.col("event").cast("int").alias("_e"), F.col(quoted(fold)).cast("int").alias("_f")
    )
    splits = measure_splits(staged, ["t"])["t"]
    own = _time_cells(with_bucket(staged, splits), ["_f"])
    others = own.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(k)]))).filter(F.col("fold") != F.col("_f"))
    cells = others.groupBy("fold", BUCKET, "t").agg(*[F.sum(c).alias(c) for c in ("n", "d", "c")])
    return _uncensored(cells, ["fold"], splits.bucketed).select("fold", "t", "g")


def _time_cells(staged: DataFrame, by: list[str]) -> DataFrame:
    """Rows, events and censorings at each time."""
    return staged.groupBy(*by, BUCKET, "t").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_e").alias("d"),
        F.sum(1 - F.col("_e")).alias("c"),
    )


def _uncensored(cells: DataFrame, by: list[str], bucketed: bool) -> DataFrame:
    """The product-limit `g` over cells of _time_cells()."""
    at_risk = running(cells, "t", {"at_risk": F.col("n")}, by=by, descending=True, bucketed=bucketed)
    stay = 1.0 - F.coalesce(
        F.try_divide(F.col("c").cast("double"), (F.col("at_risk") - F.col("d")).cast("double")),
        F.lit(0.0),
    )
    return running(at_risk, "t", {"g": stay}, by=by, product=True, bucketed=bucketed)


def with_censoring_weight(scored: DataFrame, km: DataFrame) -> DataFrame:
    """Add `inv_g` = 1 / G(duration), null where G is 0: such a row has no weight."""
    found = step_lookup(scored, "duration", km, "t", ["g"])
    g = F.coalesce(F.col("g"), F.lit(1.0))
    return found.withColumn("inv_g", F.try_divide(F.lit(1.0), g)).drop("g")


def censoring_at(km: DataFrame, horizons: Sequence[float]) -> list[float]:
    """G at each horizon: the value of the last step at or before it."""
    row = km.agg(
        *[
            F.coalesce(F.min(F.when(F.col("t") <= float(h), F.col("g"))), F.lit(1.0)).alias(f"g{i}")
            for i, h in enumerate(horizons)
        ]
    ).first()
    return [float(v) for v in row]


def _long(row: DataFrame, names: Sequence[str], horizons: Sequence[float], value: str) -> DataFrame:
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(int(h)).alias("t"), F.col(n).alias(value))
                    for n, h in zip(names, horizons)
                ]
            )
        ).alias("_x")
    ).select("_x.t", f"_x.{value}")


def brier(
    weighted: DataFrame, km: DataFrame, hazards: Sequence[float], horizons: Sequence[float]
) -> DataFrame:
    """(t, brier): inverse-probability-of-censoring-weighted squared error of S at each horizon.

    `weighted` comes from `with_censoring_weight`; `hazards` is the baseline at the horizons. All
    horizons share one aggregation. Where a row that counts has no weight, the figure is null.
    """
    scale = F.exp(F.col("risk"))
    names, aggregates = [], []
    for i, (h, base, g) in enumerate(zip(horizons, hazards, censoring_at(km, horizons))):
        surv = F.exp(-F.lit(float(base)) * scale)
        died = (F.col("duration") <= float(h)) & F.col("event")
        alive = F.col("duration") > float(h)
        inv = F.lit(1.0 / g if g > 0 else None).cast("double")
        error = (
            F.when(died, surv * surv * F.col("inv_g"))
            .when(alive, (1 - surv) * (1 - surv) * inv)
            .otherwise(0.0)
        )
        unweighted = F.count_if((died | alive) & error.isNull())
        names.append(f"b{i}")
        aggregates.append(F.when(unweighted == 0, F.avg(error)).alias(f"b{i}"))
    return _long(weighted.agg(*aggregates), names, horizons, "brier")


def integrated_brier(scores: DataFrame) -> DataFrame:
    """Trapezoid over the horizons divided by their range; NaN below two horizons.

    The window holds one row per horizon.
    """
    by_time = Window.orderBy("t")
    step = (F.lead("t").over(by_time) - F.col("t")) * (
        F.lead("brier").over(by_time) + F.col("brier")
    ) / 2
    return (
        scores.withColumn("_area", step)
        .agg(F.sum("_area").alias("a"), (F.max("t") - F.min("t")).alias("r"))
        .select(
            F.coalesce(F.try_divide(F.col("a"), F.col("r").cast("double")), F.lit(float("nan"))).alias(
                "ibs"
            )
        )
    )


def td_auc(weighted: DataFrame, horizons: Sequence[float], limit: int = ONE_WINDOW_LIMIT) -> DataFrame:
    """(t, auc): cumulative/dynamic AUC; null where a horizon has no cases, no controls, or a case
    without a weight.

    For every risk value the controls at or below it are a running sum, so cases meet controls
    without a join; all horizons share one ordered pass.
    """
    staged = weighted.select(F.col("risk").cast("double").alias("risk"), "duration", "event", "inv_g")
    splits = measure_splits(staged, ["risk"], limit)["risk"]
    sums = []
    for i, h in enumerate(horizons):
        case = (F.col("duration") <= float(h)) & F.col("event")
        weight = F.coalesce("inv_g", F.lit(float("nan")))
        sums.append(F.sum(F.when(case, weight).otherwise(0.0)).alias(f"w{i}"))
        sums.append(F.count_if(F.col("duration") > float(h)).alias(f"n{i}"))
    cells = with_bucket(staged, splits).groupBy(BUCKET, "risk").agg(*sums)
    k = range(len(horizons))
    upto = running(
        cells, "risk", {f"c{i}": F.col(f"n{i}") for i in k}, bucketed=splits.bucketed
    )
    names = [f"auc{i}" for i in k]
    row = upto.agg(
        *[
            F.nanvl(
                F.try_divide(
                    F.sum(F.col(f"w{i}") * (F.col(f"c{i}") - F.col(f"n{i}") / 2.0)),
                    F.sum(f"w{i}") * F.sum(f"n{i}"),
                ),
                F.lit(None).cast("double"),
            ).alias(f"auc{i}")
            for i in k
        ]
    )
    return _long(row, names, horizons, "auc")


def valid_horizons(
    horizons: Sequence[int], train: DataFrame, test: DataFrame | None = None
) -> list[int]:
    """Horizons strictly inside the follow-up of the training (and the test) rows."""
    end = train.agg(F.max("duration")).first()[0]
    if test is not None:
        end = min(end, test.agg(F.max("duration")).first()[0])
    return [h for h in horizons if h < end]


@dataclass(frozen=True)
class FoldMetrics:
    """What one model scored on one fold: the rows of the metric table, (metric, t, value)."""

    model: str
    fold: int
    figures: tuple[tuple[str, int | None, float], ...]

    def value(self, metric: str) -> float:
        return next(v for m, t, v in self.figures if m == metric and t is None)

    def by_horizon(self, metric: str) -> dict[int, float]:
        return {t: v for m, t, v in self.figures if m == metric and t is not None}

    def rows(self) -> list[tuple]:
        return [(self.model, self.fold, m, t, float(v)) for m, t, v in self.figures]


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(model, fold, line): the metric table's figures of each fold as one line of text."""
    label = F.when(F.col("t").isNull(), F.col("metric")).otherwise(F.concat("metric", F.lit("@"), "t"))
    part = F.format_string("%s=%.4f", label, "value")
    parts = F.array_sort(F.collect_list(F.struct("metric", "t", part.alias("text"))))
    return metrics.groupBy("model", "fold").agg(parts.alias("p")).select(
        "model", "fold", F.array_join("p.text", " ").alias("line")
    )


def results_table(spark: SparkSession, results: Sequence[FoldMetrics]) -> DataFrame:
    return spark.createDataFrame([r for x in results for r in x.rows()], METRIC_SCHEMA)


def evaluate(
    model: SurvivalModel,
    test: DataFrame,
    train: DataFrame,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    fold: int = 0,
) -> FoldMetrics:
    """All figures of a fitted model; the test rows are scored once and reused."""
    scored = materialise(_scored(model, test), "scored")

    def ends(rows: DataFrame):
        return rows.agg(F.count(F.lit(1)).alias("n"), F.max("duration").alias("end")).first()

    def at_horizons() -> tuple[int, int, dict[int, float], dict[int, float]]:
        sizes, seen, km = together(lambda: ends(train), lambda: ends(scored), lambda: materialise(censoring_km(train), "censoring"))
        found = _at_horizons(model, scored, km, [h for h in horizons if h < min(sizes["end"], seen["end"])])
        discard(km)
        return sizes["n"], seen["n"], *found

    pairs, (n_train, n_test, brier_at, auc_at) = together(lambda: c_index(scored).first(), at_horizons)
    discard(scored)
    return _fold_metrics(model, fold, pairs["c_index"], brier_at, auc_at, n_train, n_test)


def evaluate_folds(models: Sequence[SurvivalModel], folded: DataFrame, horizons: Sequence[int] = DEFAULT_HORIZONS, fold: str = "fold") -> list[FoldMetrics]:
    """evaluate() of every fold's model on the rows of its fold, beside the rows of all other folds.

    What does not hang on a model's horizons is found for all folds at once: sizes and ends, concordance, censoring curves.
    """
    k = len(models)
    sides = [_scored(model, folded.filter(F.col(fold) == i)).withColumn("fold", F.lit(i)) for i, model in enumerate(models)]
    rows = folded.groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.max("duration").alias("end"))
    scored, seen, km = together(
        lambda: materialise_by(union_all(sides), "fold", "scored"),
        lambda: {r["fold"]: (r["n"], r["end"]) for r in rows.collect()},
        lambda: materialise(censoring_km_by_fold(folded, k, fold), "censoring"),
    )

    def at_horizons(i: int) -> tuple[dict[int, float], dict[int, float]]:
        known = [end for f, (_, end) in seen.items() if f != i and end is not None]
        end = min(max(known, key=lambda t: (math.isnan(t), t), default=None), seen.get(i, (0, None))[1])
        mine = F.col("fold") == i
        return _at_horizons(models[i], scored.filter(mine).drop("fold"), km.filter(mine).drop("fold"), [h for h in horizons if h < end])

    pairs, *found = together(lambda: c_index(scored, by="fold").collect(), *[partial(at_horizons, i) for i in range(k)])
    discard(scored, km)
    concordance = {r["fold"]: r["c_index"] for r in pairs}
    total = sum(n for n, _ in seen.values())
    return [
        _fold_metrics(model, i, concordance.get(i), *found[i], total - seen.get(i, (0, None))[0], seen.get(i, (0, None))[0])
        for i, model in enumerate(models)
    ]


def _scored(model: SurvivalModel, rows: DataFrame) -> DataFrame:
    return model.risk(rows).select(F.col("risk"), F.col("duration").cast("double").alias("duration"), F.col("event"))


def _at_horizons(model: SurvivalModel, scored: DataFrame, km: DataFrame, times: Sequence[int]) -> tuple[dict[int, float], dict[int, float]]:
    """Brier scores and areas under the curve by time."""
    if not times:
        return {}, {}
    hazards, weighted = together(lambda: model.hazard_at(times), lambda: materialise(with_censoring_weight(scored, km), "weighted"))
    scores, areas = together(
        lambda: brier(weighted, km, hazards, times).collect(), lambda: td_auc(weighted, times).collect() if len(times) >= 2 else []
    )
    discard(weighted)
    brier_at = {r["t"]: math.nan if r["brier"] is None else r["brier"] for r in scores}
    return brier_at, {r["t"]: r["auc"] for r in areas if r["auc"] is not None}


def _fold_metrics(
    model: SurvivalModel, fold: int, concordance: float | None, brier_at: dict[int, float], auc_at: dict[int, float], n_train: int, n_test: int
) -> FoldMetrics:
    ibs = math.nan
    if len(brier_at) >= 2:
        ordered = sorted(brier_at)
        area = sum((b - a) * (brier_at[a] + brier_at[b]) / 2 for a, b in zip(ordered, ordered[1:]))
        ibs = area / (ordered[-1] - ordered[0])
    figures = [("c_index", None, math.nan if concordance is None else concordance), ("ibs", None, ibs)]
    figures += [("brier", t, v) for t, v in brier_at.items()] + [("td_auc", t, v) for t, v in auc_at.items()]
    figures += [("n_train", None, n_train), ("n_test", None, n_test)]
    return FoldMetrics(model.name, fold, tuple(figures))


# --- folds --------------------------------------------------------------------------------------

FOLD_PREFIX = 3  # hex digits, 4096 slices of the hash range


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "customer_id") -> DataFrame:
    """Add `fold` in 0..k-1, balanced to one row within each event class, and reproducible.

    Rows are dealt in the order of a hash of (key, seed). The hash is uniform, so its leading
    digits cut each class into even slices: ranks are taken inside a slice and shifted by the
    sizes of the slices before it, never over a whole class. Rows without an event are a class of
    their own, and rows without a key are dealt out in the order of the hash of the seed.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = (
        df.withColumn("_h", F.md5(F.concat(text, F.lit(str(seed)))))
        .withColumn("_slice", F.substring("_h", 1, FOLD_PREFIX))
        .withColumn("_class", F.coalesce(F.col("event").cast("int"), F.lit(-1)))
    )
    sizes = hashed.groupBy("_class", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most 4096 slices per class.
    offsets = sizes.select(
        "_class", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(
        Window.partitionBy("_class", "_slice").orderBy("_h", key)
    )
    return (
        hashed.join(F.broadcast(offsets), ["_class", "_slice"])
        .withColumn("fold", ((F.col("_before") + inside - 1) % k).cast("int"))
        .select(*df.columns, "fold")
    )


def aggregate_folds(results: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of every metric and horizon."""
    return results.groupBy("metric", "t").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("n_folds"),
    )
