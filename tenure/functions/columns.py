"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days from start to end, rounded down also when negative.

    Interval arithmetic, so zone-less timestamps are not bent by the session's clock changes.
    """
    spent = end - start
    days = F.extract(F.lit("DAY"), spent)
    return days - F.when(spent < F.make_dt_interval(days), 1).otherwise(0)


def epoch_seconds(ts: Column, kind: str) -> Column:
    """Whole seconds since 1970 for either timestamp type."""
    since = ts - F.lit("1970-01-01 00:00:00").cast(kind)
    return (
        F.extract(F.lit("DAY"), since).cast("long") * 86400
        + F.extract(F.lit("HOUR"), since).cast("long") * 3600
        + F.extract(F.lit("MINUTE"), since).cast("long") * 60
        + F.floor(F.extract(F.lit("SECOND"), since)).cast("long")
    )


def add_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def one_hot(value: Column, level: object) -> Column:
    return F.coalesce(value == F.lit(level), F.lit(False)).cast("double")


def ordinal(value: Column, levels: list[str]) -> Column:
    """Position of value in levels, null when it is none of them."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.when(place > 0, (place - 1).cast("double"))


def kolmogorov_p(distance: Column, n_ref: Column, n_cur: Column) -> Column:
    """Asymptotic two-sample Kolmogorov p-value, 100 terms; 1 below lambda = 0.2."""
    lam = F.sqrt(n_ref * n_cur / (n_ref + n_cur)) * distance
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series))
    )
