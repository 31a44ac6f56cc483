"""Feature matrix: extract, merge, impute, scale, attach targets."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tenure.operators.features import Behaviour, Demographics, Rfm, ticket_features
from tenure.plans.columns import quoted
from tenure.plans.materialise import is_written, materialise
from tenure.plans.parallel import together
from tenure.plans.quantiles import exact_quantiles

KEY = "customer_id"
TARGETS = ("event", "duration")
COLUMNS_AT_ONCE = 10  # whose moments are one generated aggregation; beyond a hundred fields Spark generates none


def merge_features(
    base: DataFrame,
    demographics: DataFrame,
    purchases: DataFrame,
    behaviour: DataFrame,
    tickets: DataFrame,
) -> DataFrame:
    """Left joins on one key over inputs already aggregated to one row per customer.

    Columns of `base` (the targets, when it has them) stay in the row.
    """
    merged = base
    for part in (demographics, purchases, behaviour, tickets):
        merged = merged.join(part, KEY, "left")
    return merged.withColumn("n_tickets", F.coalesce("n_tickets", F.lit(0.0)))


def feature_columns(df: DataFrame, skip: tuple[str, ...] = (KEY, *TARGETS)) -> list[str]:
    """Numeric columns, then booleans; a column of another type is an error, not a silent loss."""
    numeric, flags, other = [], [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, BooleanType):
            flags.append(f.name)
        else:
            other.append(f.name)
    if other:
        raise TypeError(f"not numeric: {', '.join(other)}")
    return numeric + flags


def _number(name: str) -> Column:
    """A column of numbers; NaN is missing."""
    return F.nanvl(F.col(quoted(name)).cast("double"), F.lit(None).cast("double"))


@dataclass(frozen=True)
class Preprocessor:
    """Median imputation and optional standardisation, learned once and applied as literals.

    Nulls and NaN are missing. A column's name may hold any character.
    """

    columns: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    scale: bool = True

    @classmethod
    def fit(cls, raw: DataFrame, scale: bool = True) -> "Preprocessor":
        """Scans of a materialised table, no shuffle beyond the final partials.

        Moments of the imputed column follow from those of the present values, because every
        absent value becomes the same constant.
        """
        cols = feature_columns(raw)
        value = {c: _number(c) for c in cols}
        moments: dict[str, tuple] = {}

        def learn(some: list[str]) -> None:
            each = [f(value[c]) for c in some for f in (F.count, F.avg, F.var_pop)]
            row = raw.agg(*[v.alias(f"a{i}") for i, v in enumerate(each)]).first()
            moments.update({c: row[3 * i : 3 * i + 3] for i, c in enumerate(some)})

        groups = [cols[i : i + COLUMNS_AT_ONCE] for i in range(0, len(cols), COLUMNS_AT_ONCE)] if scale else []
        rows, *_ = together(raw.count, *[partial(learn, some) for some in groups])
        counts = [moments[c][0] for c in cols] if scale else None
        numbers = raw.select(*[value[c].alias(c) for c in cols])
        quantiles = exact_quantiles(numbers, cols, [0.5], rows=rows, counts=counts, written=is_written(raw))
        medians = {c: q[0] for c, q in quantiles.items() if q[0] is not None}
        kept = tuple(c for c in cols if c in medians)
        means: dict[str, float] = {}
        scales: dict[str, float] = {}
        if scale:
            for c in kept:
                n, m, v = moments[c]
                present = n / rows
                mean = present * m + (1 - present) * medians[c]
                var = present * (v + (m - mean) ** 2) + (1 - present) * (medians[c] - mean) ** 2
                constant = var <= 1e-24 * max(1.0, mean * mean)
                means[c], scales[c] = mean, 1.0 if constant else var**0.5
        return cls(kept, medians, means, scales, scale)

    def transform(self, raw: DataFrame) -> DataFrame:
        """A projection; no job."""
        ahead = [KEY] if KEY in raw.columns else []
        behind = [c for c in TARGETS if c in raw.columns]
        out = []
        for c in self.columns:
            filled = F.coalesce(_number(c), F.lit(self.medians[c]))
            if self.scale:
                filled = (filled - F.lit(self.means[c])) / F.lit(self.scales[c])
            out.append(filled.alias(c))
        return raw.select(*ahead, *out, *behind)


class FeaturePipeline:
    """Raw tables to one row per labelled customer: features, `event`, `duration`."""

    def __init__(
        self,
        scale: bool = True,
        reference_date: datetime | None = None,
        session_gap_seconds: int | None = None,
        known_levels: dict[str, list[str]] | None = None,
    ) -> None:
        """`known_levels` names the levels of categorical columns (device_type, page_type, gender,
        acquisition_channel) that need not be learned by a scan."""
        self.scale = scale
        self.reference_date = reference_date
        self.session_gap_seconds = session_gap_seconds
        self.known_levels = known_levels or {}
        self._rfm: Rfm | None = None
        self._behaviour: Behaviour | None = None
        self._demographics: Demographics | None = None
        self._preprocessor: Preprocessor | None = None

    def fit(
        self,
        customers: DataFrame,
        transactions: DataFrame,
        clickstream: DataFrame,
        tickets: DataFrame,
        labels: DataFrame,
    ) -> "FeaturePipeline":
        self._fit(customers, transactions, clickstream, tickets, labels)
        return self

    def transform(
        self,
        customers: DataFrame,
        transactions: DataFrame,
        clickstream: DataFrame,
        tickets: DataFrame,
        labels: DataFrame,
    ) -> DataFrame:
        if self._preprocessor is None:
            raise RuntimeError("fit() must run before transform()")
        raw = self.raw_features(customers, transactions, clickstream, tickets, labels)
        return self._preprocessor.transform(raw)

    def fit_transform(
        self,
        customers: DataFrame,
        transactions: DataFrame,
        clickstream: DataFrame,
        tickets: DataFrame,
        labels: DataFrame,
    ) -> DataFrame:
        """Extracts once: the merged table written for fitting is also what gets transformed."""
        raw = self._fit(customers, transactions, clickstream, tickets, labels)
        return self._preprocessor.transform(raw)

    def raw_features(
        self,
        customers: DataFrame,
        transactions: DataFrame,
        clickstream: DataFrame,
        tickets: DataFrame,
        labels: DataFrame,
    ) -> DataFrame:
        if self._rfm is None:
            raise RuntimeError("fit() must run before features can be extracted")
        # Every customer with a label has a row, and brings its targets along: nothing to align.
        base = labels.select(
            KEY,
            F.col("event_observed").cast("boolean").alias("event"),
            F.col("duration_days").cast("double").alias("duration"),
        )
        return merge_features(
            base,
            self._demographics.transform(customers),
            self._rfm.transform(transactions),
            self._behaviour.transform(clickstream),
            ticket_features(tickets),
        )

    def fit_extractors(
        self, customers: DataFrame, transactions: DataFrame, clickstream: DataFrame
    ) -> "FeaturePipeline":
        known = self.known_levels
        behaviour = Behaviour(known.get("device_type"), known.get("page_type"), self.session_gap_seconds)
        demographics = Demographics(genders=known.get("gender"), channels=known.get("acquisition_channel"))
        self._rfm, self._behaviour, self._demographics = together(
            lambda: Rfm(self.reference_date).fit(transactions),
            lambda: behaviour.fit(clickstream),
            lambda: demographics.fit(customers),
        )
        return self

    def _fit(self, customers, transactions, clickstream, tickets, labels) -> DataFrame:
        self.fit_extractors(customers, transactions, clickstream)
        raw = materialise(
            self.raw_features(customers, transactions, clickstream, tickets, labels), "features"
        )
        self._preprocessor = Preprocessor.fit(raw, self.scale)
        return raw

    @property
    def preprocessor(self) -> Preprocessor:
        if self._preprocessor is None:
            raise RuntimeError("fit() has not run")
        return self._preprocessor

    @property
    def feature_names(self) -> list[str]:
        return list(self._preprocessor.columns) if self._preprocessor else []
