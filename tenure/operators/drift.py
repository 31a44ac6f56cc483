"""Distribution drift between a reference and a current table, and graded alerts.

All numeric columns go through one scan and one shuffle: rows are unpivoted to (column, value),
collapsed map-side, and compared along the value order of each column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.columns import kolmogorov_p
from tenure.functions.special import chi_square_p, chi_square_tail
from tenure.plans.columns import quoted
from tenure.plans.ordered import BUCKET, MAX_BUCKETS, ONE_WINDOW_LIMIT, SKETCH_ERROR, Splits, running, some_distinct, union_all, with_bucket
from tenure.plans.parallel import together

# Which methods measure a distance (drift above the threshold).
DISTANCES = {"psi", "wasserstein", "ed", "kl_div", "jensenshannon", "hellinger"}
P_VALUES = {"ks", "chi2", "es"}
BINNED = {"psi", "kl_div", "jensenshannon", "hellinger"}
ORDERED = {"ks", "wasserstein", "ed"}
DEFAULT_THRESHOLDS = {"distance": 0.1, "p_value": 0.05}
FEW_VALUES = 20  # numeric columns with at most this many values are compared value by value
EMPTY_SHARE = 1e-4  # share given to a bin that one side does not fill
ORDERED_SCHEMA = "column string, ks_distance double, ks_p double, wasserstein double, energy double"
COUNTS_SCHEMA = "column string, bin string, c_ref long, c_cur long"
REPORT_SCHEMA = "column string, method string, score double, threshold double, drifted boolean"


def is_distance(method: str) -> bool:
    return method.lower() in DISTANCES


def drift_rule(method: Column, score: Column, threshold: Column) -> Column:
    """Distances drift above the threshold, every other method (p-values) below it."""
    return F.when(F.lower(method).isin(*sorted(DISTANCES)), score > threshold).otherwise(
        score < threshold
    )


FACTS = ("n", "sd", "lo", "hi", "distinct")
Fields = Callable[[int, str, Column], list[Column]]


class _Rows:
    """A side given as a table: numeric columns as double, NaN as null."""

    def __init__(self, df: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        values = [F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None)).alias(f"v{i}") for i, c in enumerate(self.columns)]
        self.rows = df.select(*values)

    def facts(self) -> dict[str, dict]:
        """Per column: values, deviation, extent and (about) how many are distinct; one scan."""
        kinds = (F.count, F.stddev_pop, F.min, F.max, lambda v: F.approx_count_distinct(v, SKETCH_ERROR))
        names = [f"v{i}" for i in range(len(self.columns))]
        row = self.rows.agg(*[kind(v).alias(f"{k}|{v}") for v in names for k, kind in zip(FACTS, kinds)]).first()
        return {c: {k: row[f"{k}|{v}"] for k in FACTS} for c, v in zip(self.columns, names)}

    def stack(self, fields: Fields, splits: dict[str, Splits] | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """(_i, what fields makes of a value, w): a row per row and column (all, or only some) with a value; in buckets if splits are given."""
        rows = self.rows
        entries = []
        for i, c in enumerate(self.columns):
            if only is not None and i not in only:
                continue
            extra = []
            if splits is not None:
                rows = with_bucket(rows, Splits(f"v{i}", splits[c].points), f"_b{i}")
                extra = [F.col(f"_b{i}").alias(BUCKET)]
            there = F.col(f"v{i}").isNotNull().alias("_there")
            entries.append(F.struct(F.lit(i).alias("_i"), *fields(i, c, F.col(f"v{i}")), *extra, F.lit(1).cast("long").alias("w"), there))
        return rows.select(F.explode(F.array(*entries)).alias("_x")).select("_x.*").filter("_there").drop("_there")


class _Cells:
    """A side given as a profile: distinct values of each column with their number of rows."""

    def __init__(self, profile: ReferenceProfile, columns: Sequence[str]):
        self.columns, self.profile = list(columns), profile

    def facts(self) -> dict[str, dict]:
        return {c: self.profile.facts[c] for c in self.columns}

    def stack(self, fields: Fields, splits: dict[str, Splits] | None = None, only: Sequence[int] | None = None) -> DataFrame:
        parts = []
        for i, c in enumerate(self.columns):
            if only is not None and i not in only:
                continue
            cells = self.profile.values.filter(F.col("_i") == self.profile.numeric.index(c)).select("value", "n")
            extra = []
            if splits is not None:
                cells = with_bucket(cells, Splits("value", splits[c].points))
                extra = [BUCKET]
            parts.append(cells.select(F.lit(i).alias("_i"), *fields(i, c, F.col("value")), *extra, F.col("n").alias("w")))
        return union_all(parts)


class ReferenceProfile:
    """What comparisons need of a reference table, written once: cells of its values and categories, and facts of its columns.

    A report, or every micro-batch of a stream, reads the profile instead of the table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.values = spark.read.parquet(f"{path}/values")
        self.categories = spark.read.parquet(f"{path}/categories")
        rows = spark.read.parquet(f"{path}/facts").orderBy("position").collect()  # one row per column
        self.numeric = [r["column"] for r in rows if r["n"] is not None]
        self.categorical = [r["column"] for r in rows if r["n"] is None]
        self.facts = {r["column"]: {k: r[k] for k in FACTS} for r in rows if r["n"] is not None}

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802
        return self.values.sparkSession

    @classmethod
    def fit(cls, reference: DataFrame, path: str, columns: Sequence[str] | None = None) -> ReferenceProfile:
        spark = reference.sparkSession
        numeric, categorical = route_columns(reference, reference, columns)
        side = _Rows(reference, numeric)
        facts = side.facts() if numeric else {}
        rows = [(i, c, *(None if facts[c][k] is None else float(facts[c][k]) for k in FACTS)) for i, c in enumerate(numeric)]
        rows += [(len(numeric) + i, c, *(None for _ in FACTS)) for i, c in enumerate(categorical)]
        schema = "position int, column string, " + ", ".join(f"{k} double" for k in FACTS)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/facts")
        values = spark.createDataFrame([], "value double, n long, _i int")
        if numeric:
            values = side.stack(lambda i, c, v: [v.alias("value")]).groupBy("_i", "value").agg(F.sum("w").alias("n")).select("value", "n", "_i")
        values.write.partitionBy("_i").parquet(f"{path}/values") if numeric else values.write.parquet(f"{path}/values")
        _side_categories(reference, categorical).write.parquet(f"{path}/categories")
        return cls(spark, path)


@dataclass
class _Pair:
    """Both sides and the facts of the columns that have values on both; others cannot be compared and are left out."""

    reference: _Rows | _Cells
    current: _Rows
    columns: list[str]
    facts: pd.DataFrame  # index column: n_ref, n_cur, sd_ref, lo, hi, distinct (at most, and about)

    @classmethod
    def of(cls, reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str]) -> _Pair:
        side = _side(reference, columns)
        ref, cur = together(side.facts, _Rows(current, columns).facts)
        both = [c for c in columns if ref[c]["n"] and cur[c]["n"]]
        facts = pd.DataFrame(
            [
                {
                    "column": c,
                    "n_ref": ref[c]["n"],
                    "n_cur": cur[c]["n"],
                    "sd_ref": ref[c]["sd"],
                    "lo": min(ref[c]["lo"], cur[c]["lo"]),
                    "hi": max(ref[c]["hi"], cur[c]["hi"]),
                    "distinct": ref[c]["distinct"] + cur[c]["distinct"],
                }
                for c in both
            ],
            columns=["column", "n_ref", "n_cur", "sd_ref", "lo", "hi", "distinct"],
        ).set_index("column")
        return cls(_side(reference, both), _Rows(current, both), both, facts)

    @property
    def spark(self) -> SparkSession:
        return self.current.rows.sparkSession

    def stack(self, fields: Fields, splits: dict[str, Splits] | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Both sides' stacks under one another, with weights r and c."""
        none = F.lit(0).cast("long")
        ref = self.reference.stack(fields, splits, only).withColumnRenamed("w", "r").withColumn("c", none)
        cur = self.current.stack(fields, splits, only).withColumnRenamed("w", "c").withColumn("r", none)
        return ref.unionByName(cur)

    def facts_table(self) -> DataFrame:
        """One row per monitored column, hence broadcast."""
        rows = [
            (i, c, float(f.n_ref), float(f.n_cur), float(f.sd_ref or 0.0))
            for i, (c, f) in enumerate(self.facts.iterrows())
        ]
        return F.broadcast(
            self.spark.createDataFrame(
                rows, "_i int, column string, n_ref double, n_cur double, sd_ref double"
            )
        )


def _side(table: DataFrame | ReferenceProfile, columns: Sequence[str]) -> _Rows | _Cells:
    return _Cells(table, columns) if isinstance(table, ReferenceProfile) else _Rows(table, columns)


def _splits(pair: _Pair, limit: int) -> dict[str, Splits]:
    """Bucket borders of the columns with more distinct values than one window may hold, from the distinct values of both sides."""
    large = {
        c: max(2, min(MAX_BUCKETS, int(n // limit) + 1)) for c, n in pair.facts["distinct"].items() if (1 + 3 * SKETCH_ERROR) * n > limit
    }
    found = {c: Splits(c) for c in pair.columns}
    if large:
        number = {c: i for i, c in enumerate(pair.columns)}
        most = max(large.values())
        cells = pair.stack(lambda i, c, v: [v.alias("value")], only=[number[c] for c in large]).select("_i", "value")
        points = F.percentile_approx("value", [i / most for i in range(1, most)], max(1000, 20 * most))
        some = some_distinct(cells, "value", min(pair.facts["distinct"][c] for c in large), most)
        cut = {r["_i"]: r["p"] for r in some.groupBy("_i").agg(points.alias("p")).collect()}
        found |= {c: Splits(c, tuple(sorted({p + 0.0 for p in cut.get(number[c]) or []}))) for c in large}
    return found


def _running(pair: _Pair, limit: int) -> tuple[DataFrame, bool]:
    """(_i, value, u_ref, u_cur): rows of both sides up to every distinct value of a column, and whether they are in buckets.

    Columns go by number until the end: keys stay fixed width.
    """
    splits = _splits(pair, limit)
    bucketed = any(s.bucketed for s in splits.values())
    stacked = pair.stack(lambda i, c, v: [v.alias("value")], splits)
    cells = stacked.groupBy("_i", BUCKET, "value").agg(F.sum("r").alias("c_ref"), F.sum("c").alias("c_cur"))
    totals = None
    if bucketed:
        # Straight from the rows: partial sums leave one row per (task, column, bucket), so this
        # second scan shuffles next to nothing. One row per column and bucket in the end.
        per_bucket = stacked.groupBy("_i", BUCKET).agg(F.sum("r").alias("u_ref"), F.sum("c").alias("u_cur"), F.min("value").alias("_start"))
        following = Window.partitionBy("_i").orderBy(BUCKET)
        totals = per_bucket.withColumn("_next_start", F.lead("_start").over(following)).drop("_start")
    upto = running(
        cells,
        "value",
        {"u_ref": F.col("c_ref"), "u_cur": F.col("c_cur")},
        by=("_i",),
        bucketed=bucketed,
        totals=totals,
    )
    return upto, bucketed


def _distribution(pair: _Pair, limit: int) -> DataFrame:
    """(column, value, next_value, f_ref, f_cur, n_ref, n_cur, sd_ref): both distribution functions
    at every distinct value."""
    upto, bucketed = _running(pair, limit)
    inside = Window.partitionBy("_i", *([BUCKET] if bucketed else [])).orderBy("value")
    following_value = F.lead("value").over(inside)
    if bucketed:
        following_value = F.coalesce(following_value, F.col("_next_start"))
    upto = upto.withColumn("next_value", following_value)
    return upto.join(pair.facts_table(), "_i").select(
        "column",
        "value",
        "next_value",
        (F.col("u_ref") / F.col("n_ref")).alias("f_ref"),
        (F.col("u_cur") / F.col("n_cur")).alias("f_cur"),
        "n_ref",
        "n_cur",
        "sd_ref",
    )


def _quartiles(pair: _Pair, limit: int) -> dict[str, tuple[float, float]]:
    """The quartiles of both sides' values together, with linear interpolation."""
    ranks = {c: [(f.n_ref + f.n_cur - 1) * q for q in (0.25, 0.75)] for c, f in pair.facts.iterrows()}
    upto, _ = _running(pair, limit)
    rows = F.col("u_ref") + F.col("u_cur")
    at = []
    for k in range(4):
        wanted = [float((math.floor, math.ceil)[k % 2](ranks[c][k // 2])) for c in pair.columns]
        rank = F.array(*map(F.lit, wanted))[F.col("_i")]
        at.append(F.min(F.when(rows > rank, F.col("value"))).alias(f"q{k}"))
    out = {}
    for r in upto.groupBy("_i").agg(*at).collect():
        c = pair.columns[r["_i"]]
        low, high = ((r[f"q{2 * j}"], r[f"q{2 * j + 1}"], ranks[c][j]) for j in (0, 1))
        out[c] = tuple(a + (b - a) * (p - math.floor(p)) for a, b, p in (low, high))
    return out


def ordered_scores(
    reference: DataFrame | ReferenceProfile,
    current: DataFrame,
    columns: Sequence[str],
    limit: int = ONE_WINDOW_LIMIT,
) -> DataFrame:
    """(column, ks_distance, ks_p, wasserstein, energy): all three from one pass.

    wasserstein is divided by the reference deviation (0.001 at least); energy is
    sqrt(2 * integral of (F - G)^2).
    """
    pair = _Pair.of(reference, current, columns)
    if not pair.columns:
        return reference.sparkSession.createDataFrame([], ORDERED_SCHEMA)
    gap = F.abs(F.col("f_ref") - F.col("f_cur"))
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return (
        _distribution(pair, limit)
        .groupBy("column")
        .agg(
            F.max(gap).alias("ks_distance"),
            F.sum(gap * width).alias("_area"),
            F.sum(gap * gap * width).alias("_square"),
            F.max("n_ref").alias("n_ref"),
            F.max("n_cur").alias("n_cur"),
            F.max("sd_ref").alias("sd_ref"),
        )
        .select(
            "column",
            "ks_distance",
            kolmogorov_p(F.col("ks_distance"), F.col("n_ref"), F.col("n_cur")).alias("ks_p"),
            (F.col("_area") / F.greatest("sd_ref", F.lit(0.001))).alias("wasserstein"),
            F.sqrt(2.0 * F.col("_square")).alias("energy"),
        )
    )


def _side_totals(counts: DataFrame) -> DataFrame:
    """Values of each column on both sides, one row per column; columns without any on one side are left out."""
    totals = counts.groupBy("column").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"))
    return F.broadcast(totals.filter("n_ref > 0 and n_cur > 0"))


def _shares(counts: DataFrame) -> DataFrame:
    """Add shares r and c to (column, bin, c_ref, c_cur); bins unfilled on a side get EMPTY_SHARE."""
    totals = _side_totals(counts)

    def share(part: str, whole: str) -> Column:
        s = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
        return F.when(F.col(part) > 0, s).otherwise(F.lit(EMPTY_SHARE))

    return counts.join(totals, "column").select(
        "column", "bin", share("c_ref", "n_ref").alias("r"), share("c_cur", "n_cur").alias("c")
    )


def _numeric_bins(pair: _Pair) -> DataFrame:
    """(column, bin, c_ref, c_cur): equal widths over the joint range, or one bin per value."""
    few = _few_valued(pair)

    def place(i: int, c: str, value: Column) -> list[Column]:
        f = pair.facts.loc[c]
        bins = int(np.ceil(np.log2(f.n_ref + f.n_cur))) + 1
        if c in few:
            return [value.cast("string").alias("bin")]
        at = F.floor((value - F.lit(float(f.lo))) / F.lit((float(f.hi) - float(f.lo)) / bins))
        return [F.least(at, F.lit(bins - 1)).cast("string").alias("bin")]

    counts = pair.stack(place).groupBy("_i", "bin").agg(F.sum("r").alias("c_ref"), F.sum("c").alias("c_cur"))
    names = F.array(*map(F.lit, pair.columns))
    return counts.select(names[F.col("_i")].alias("column"), "bin", "c_ref", "c_cur")


def _few_valued(pair: _Pair) -> set[str]:
    """Columns with at most FEW_VALUES values; the sketch only rules out the clear cases."""
    maybe = [i for i, c in enumerate(pair.columns) if pair.facts["distinct"][c] <= 4 * FEW_VALUES]
    if not maybe:
        return set()
    values = pair.stack(lambda i, c, v: [v.alias("value")], only=maybe).select("_i", "value").distinct()
    return {pair.columns[r["_i"]] for r in values.groupBy("_i").count().collect() if r["count"] <= FEW_VALUES}


def _side_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bin, n): rows of every value of every column."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, bin string, n long")
    entries = [F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("bin")) for c in columns]
    stacked = df.select(F.explode(F.array(*entries)).alias("_x")).select("_x.*")
    return stacked.filter(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def _categorical_counts(
    reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    none = F.lit(0).cast("long")
    if isinstance(reference, ReferenceProfile):
        ref = reference.categories.filter(F.col("column").isin(list(columns)))
    else:
        ref = _side_categories(reference, columns)
    ref = ref.withColumnRenamed("n", "r").withColumn("c", none)
    cur = _side_categories(current, columns).withColumnRenamed("n", "c").withColumn("r", none)
    return ref.unionByName(cur).groupBy("column", "bin").agg(F.sum("r").alias("c_ref"), F.sum("c").alias("c_cur"))


def divergences(counts: DataFrame) -> DataFrame:
    """(column, psi, kl_div, jensenshannon, hellinger) from (column, bin, c_ref, c_cur)."""
    r, c = F.col("r"), F.col("c")
    m = (r + c) / 2
    return (
        _shares(counts)
        .groupBy("column")
        .agg(
            F.sum((c - r) * F.log(c / r)).alias("psi"),
            F.sum(r * F.log(r / c)).alias("kl_div"),
            F.sqrt(
                F.greatest(F.lit(0.0), F.sum(0.5 * r * F.log(r / m) + 0.5 * c * F.log(c / m)))
            ).alias("jensenshannon"),
            F.sqrt(0.5 * F.sum((F.sqrt(r) - F.sqrt(c)) * (F.sqrt(r) - F.sqrt(c)))).alias("hellinger"),
        )
    )


def binned_scores(
    reference: DataFrame | ReferenceProfile,
    current: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
) -> DataFrame:
    parts = []
    pair = _Pair.of(reference, current, numeric) if numeric else None
    if pair is not None and pair.columns:
        parts.append(_numeric_bins(pair))
    if categorical:
        parts.append(_categorical_counts(reference, current, categorical))
    return divergences(union_all(parts) if parts else reference.sparkSession.createDataFrame([], COUNTS_SCHEMA))


def chi_square_scores(
    reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """(column, statistic, df, chi2_p): current counts against the reference proportions.

    A value the reference lacks has expected count 0, so the statistic is infinite and p is 0.
    """
    counts = _categorical_counts(reference, current, columns)
    totals = _side_totals(counts)
    expected = F.col("c_ref") * F.col("n_cur") / F.col("n_ref")
    miss = F.col("c_cur") - F.col("_expected")
    return (
        counts.join(totals, "column")
        .withColumn("_expected", expected.cast("double"))
        .groupBy("column")
        .agg(
            F.sum(
                F.coalesce(F.try_divide(miss * miss, F.col("_expected")), F.lit(float("inf")))
            ).alias("statistic"),
            (F.count(F.lit(1)) - 1).cast("double").alias("df"),
        )
        .withColumn("chi2_p", chi_square_p("statistic", "df"))
    )


def epps_singleton(
    reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str], limit: int = ONE_WINDOW_LIMIT
) -> DataFrame:
    """(column, statistic, es_p): distance of the characteristic functions at two points.

    The test needs means and products of four numbers per row and side: plain aggregates in
    one scan, after the quartiles. Only the 4 x 4 systems are solved here. A column whose quartiles are equal has no scale and is left out.
    """
    pair = _Pair.of(reference, current, columns)
    quartiles = _quartiles(pair, limit) if pair.columns else {}
    spread = {c: (q[1] - q[0]) / 2 for c, q in quartiles.items()}
    schema = "column string, statistic double, es_p double"
    if not any(s > 0 for s in spread.values()):
        return pair.spark.createDataFrame([], schema)
    points = (0.4, 0.8)

    def waves(i: int, c: str, value: Column) -> list[Column]:
        angles = [value * F.lit(t / spread[c] if spread[c] > 0 else 0.0) for t in points]
        return [w.alias(f"w{k}") for k, w in enumerate([F.cos(x) for x in angles] + [F.sin(x) for x in angles])]

    numbers = range(4)
    aggregates = [F.sum(F.col(s) * F.col(f"w{i}")).alias(f"{s}{i}") for s in "rc" for i in numbers]
    aggregates += [F.sum(F.col(s) * F.col(f"w{i}") * F.col(f"w{j}")).alias(f"{s}{i}{j}") for s in "rc" for i in numbers for j in range(i, 4)]
    out = []
    for row in pair.stack(waves).groupBy("_i").agg(*aggregates).collect():
        c = pair.columns[row["_i"]]
        if spread[c] <= 0:
            continue
        n_ref, n_cur = float(pair.facts.n_ref[c]), float(pair.facts.n_cur[c])
        n = n_ref + n_cur
        mean, cov = {}, {}
        for side, s, size in (("ref", "r", n_ref), ("cur", "c", n_cur)):
            mean[side] = np.array([row[f"{s}{i}"] for i in numbers]) / size
            square = np.array([[row[f"{s}{min(i, j)}{max(i, j)}"] for j in numbers] for i in numbers]) / size
            cov[side] = square - np.outer(mean[side], mean[side])
        inverse = np.linalg.pinv((n / n_ref) * cov["ref"] + (n / n_cur) * cov["cur"])
        rank = int(np.linalg.matrix_rank(inverse))
        gap = mean["ref"] - mean["cur"]
        stat = float(n * gap @ inverse @ gap)
        if max(n_ref, n_cur) < 25:
            stat /= 1.0 + n**-0.45 + 10.1 * (n_ref**-1.7 + n_cur**-1.7)
        out.append((c, stat, chi_square_tail(stat, rank)))
    return pair.spark.createDataFrame(out, schema)


# --- report -------------------------------------------------------------------------------------


def route_columns(
    reference: DataFrame | ReferenceProfile, current: DataFrame, columns: Sequence[str] | None = None
) -> tuple[list[str], list[str]]:
    """(numeric, categorical) shared columns by type; dates are not monitored."""
    shared = columns or [c for c in reference.columns if c in current.columns]
    if isinstance(reference, ReferenceProfile):
        kinds = dict.fromkeys(reference.numeric, T.DoubleType()) | dict.fromkeys(reference.categorical, T.StringType())
    else:
        kinds = {f.name: f.dataType for f in reference.schema.fields}
    unknown = [c for c in shared if c not in kinds or c not in current.columns]
    if unknown:
        raise KeyError(f"not in both tables: {', '.join(unknown)}")
    numeric = [c for c in shared if isinstance(kinds[c], T.NumericType)]
    categorical = [c for c in shared if isinstance(kinds[c], (T.StringType, T.BooleanType))]
    return numeric, categorical


def _scores(
    reference: DataFrame | ReferenceProfile, current: DataFrame, columns: list[str], method: str, numeric: bool
) -> DataFrame:
    m = method.lower()
    if m in BINNED:
        table = binned_scores(
            reference, current, columns if numeric else (), () if numeric else columns
        )
        return table.select("column", F.lit(m).alias("method"), F.col(m).alias("score"))
    if numeric and m in ORDERED:
        name = {"ks": "ks_p", "wasserstein": "wasserstein", "ed": "energy"}[m]
        table = ordered_scores(reference, current, columns)
        return table.select("column", F.lit(m).alias("method"), F.col(name).alias("score"))
    if numeric and m == "es":
        table = epps_singleton(reference, current, columns)
        return table.select("column", F.lit(m).alias("method"), F.col("es_p").alias("score"))
    if not numeric and m == "chi2":
        table = chi_square_scores(reference, current, columns)
        return table.select("column", F.lit(m).alias("method"), F.col("chi2_p").alias("score"))
    raise ValueError(f"method {method!r} does not apply to {'numeric' if numeric else 'categorical'} columns")


def drift_report(
    reference: DataFrame | ReferenceProfile,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    num_method: str = "ks",
    cat_method: str = "chi2",
    thresholds: dict[str, float] | float | None = None,
) -> DataFrame:
    """One row per monitored column: column, method, score, threshold, drifted.

    `thresholds` is one number for all columns or one per column; by default 0.05 for p-values
    and 0.1 for distances. A column without values on one side has a null score and has not drifted.
    """
    numeric, categorical = route_columns(reference, current, columns)
    parts = []
    if numeric:
        parts.append(_scores(reference, current, numeric, num_method, True))
    if categorical:
        parts.append(_scores(reference, current, categorical, cat_method, False))
    if not parts:
        raise ValueError("no column to monitor")
    # A column that could not be compared is in the report without a score.
    asked = [(c, num_method.lower()) for c in numeric] + [(c, cat_method.lower()) for c in categorical]
    monitored = reference.sparkSession.createDataFrame(asked, "column string, method string")
    scores = monitored.join(F.broadcast(union_all(parts)), ["column", "method"], "left")
    default = F.when(
        F.col("method").isin(*sorted(DISTANCES)), F.lit(DEFAULT_THRESHOLDS["distance"])
    ).otherwise(F.lit(DEFAULT_THRESHOLDS["p_value"]))
    if isinstance(thresholds, dict):
        threshold = F.coalesce(
            *[F.when(F.col("column") == c, F.lit(float(v))) for c, v in thresholds.items()], default
        )
    else:
        threshold = default if thresholds is None else F.lit(float(thresholds))
    scores = scores.withColumn("threshold", threshold)
    rule = drift_rule(F.col("method"), F.col("score"), F.col("threshold"))
    return scores.select(
        "column", "method", "score", "threshold", F.coalesce(rule, F.lit(False)).alias("drifted")
    )


def dataset_drift(report: DataFrame, drift_share: float = 0.5) -> DataFrame:
    """One row: n_features, n_drifted, share, dataset_drift, summary."""
    share = F.coalesce(
        F.try_divide(F.count_if("drifted").cast("double"), F.count(F.lit(1)).cast("double")),
        F.lit(0.0),
    )
    return (
        report.agg(
            F.count(F.lit(1)).alias("n_features"),
            F.count_if("drifted").alias("n_drifted"),
            share.alias("share"),
        )
        .withColumn("dataset_drift", F.col("share") >= F.lit(float(drift_share)))
        .withColumn(
            "summary",
            F.format_string(
                "[%s] %d/%d features drifted (%.1f%%)",
                F.when(F.col("dataset_drift"), F.lit("DRIFTED")).otherwise(F.lit("STABLE")),
                F.col("n_drifted"),
                F.col("n_features"),
                F.col("share") * 100,
            ),
        )
    )


def drift_gate(report: DataFrame, drift_share: float = 0.5) -> bool:
    """True when the job should fail because the dataset drifted."""
    return bool(dataset_drift(report, drift_share).first()["dataset_drift"])


def drift_alerts(report: DataFrame, psi_critical: float = 0.2) -> DataFrame:
    """One row per drifted column, critical first, then by name.

    PSI is critical from `psi_critical` on and a warning below it; any other method is critical.
    """
    severity = F.when(
        F.lower("method").isin("psi", "psi_threshold") & (F.col("score") < psi_critical), "warning"
    ).otherwise("critical")
    return (
        report.filter("drifted")
        .select(
            F.col("column").alias("feature"),
            F.col("score").alias("drift_score"),
            "threshold",
            severity.alias("severity"),
            "method",
            F.format_string(
                "%s: %s=%.4f (threshold=%s)", "column", "method", "score", "threshold"
            ).alias("message"),
        )
        .orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "feature")
    )


def alert_digest(alerts: DataFrame) -> DataFrame:
    """One row: n_alerts, n_critical, n_warning, digest text."""
    line = F.format_string("  [%s] %s", F.upper("severity"), F.col("message"))
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    # At most one entry per monitored column.
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(rank.alias("k"), "feature", line.alias("line")))),
        lambda x: x["line"],
    )
    return (
        alerts.agg(
            F.count(F.lit(1)).alias("n_alerts"),
            F.count_if(F.col("severity") == "critical").alias("n_critical"),
            F.count_if(F.col("severity") != "critical").alias("n_warning"),
            lines.alias("_lines"),
        )
        .withColumn(
            "digest",
            F.when(F.col("n_alerts") == 0, F.lit("No drift alerts.")).otherwise(
                F.concat_ws(
                    "\n",
                    F.format_string(
                        "Drift alerts: %d total (%d critical, %d warning)",
                        "n_alerts",
                        "n_critical",
                        "n_warning",
                    ),
                    F.concat_ws("\n", "_lines"),
                )
            ),
        )
        .drop("_lines")
    )
