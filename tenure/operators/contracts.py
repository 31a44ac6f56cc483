"""Row contracts: every broken rule of a row is named, and bad rows are set apart with reasons.

A contract also reads untyped input: a column of another type than the declared one is converted where that loses nothing, a value that
cannot be converted breaks the rule `type`, and a column that is not there breaks the rule `column` in every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.functions.columns import UUID_PATTERN
from tenure.plans.columns import quoted

# The enumerations of the customer tables.
CHANNELS = ["organic_search", "paid_search", "social_media", "email", "referral", "direct"]
GENDERS = ["M", "F", "Non-binary", "Unknown"]
TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
PAYMENTS = ["credit_card", "debit_card", "paypal", "crypto", "buy_now_pay_later"]
PAGES = ["home", "category", "product", "cart", "checkout", "confirmation", "search", "account"]
DEVICES = ["desktop", "mobile", "tablet"]


@dataclass(frozen=True)
class Rule:
    """`broken(column)` is true where a present value violates the rule."""

    column: str
    name: str
    broken: Callable[[Column], Column]


def uuid(column: str) -> Rule:
    return Rule(column, "uuid", lambda c: ~c.rlike(UUID_PATTERN))


def one_of(column: str, values: list[str]) -> Rule:
    return Rule(column, "enum", lambda c: ~c.isin(*values))


def in_range(column: str, low: float | None = None, high: float | None = None) -> Rule:
    def broken(c: Column) -> Column:
        out = F.isnan(c.cast("double"))
        if low is not None:
            out = out | (c < F.lit(low))
        if high is not None:
            out = out | (c > F.lit(high))
        return out

    return Rule(column, "range", broken)


def finite(column: str) -> Rule:
    return Rule(
        column, "finite", lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    )


@dataclass(frozen=True)
class Contract:
    schema: T.StructType
    rules: tuple[Rule, ...]
    strip: bool = True

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


def _schema(**columns: str) -> T.StructType:
    """`name="type"` for required columns, `name="type?"` for nullable ones."""
    kinds = {
        "string": T.StringType(),
        "timestamp": T.TimestampType(),
        "int": T.IntegerType(),
        "bigint": T.LongType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
    }
    return T.StructType(
        [T.StructField(n, kinds[k.rstrip("?")], k.endswith("?")) for n, k in columns.items()]
    )


CONTRACTS: dict[str, Contract] = {
    "customers": Contract(
        _schema(
            customer_id="string",
            first_name="string",
            last_name="string",
            email="string",
            country="string",
            acquisition_channel="string",
            registration_date="timestamp",
            age="int?",
            gender="string",
            loyalty_tier="string",
        ),
        (
            uuid("customer_id"),
            one_of("acquisition_channel", CHANNELS),
            in_range("age", 18, 100),
            one_of("gender", GENDERS),
            one_of("loyalty_tier", TIERS),
        ),
    ),
    "transactions": Contract(
        _schema(
            transaction_id="string",
            customer_id="string",
            event_timestamp="timestamp",
            order_value="double",
            num_items="int",
            product_category="string",
            payment_method="string",
            is_returned="boolean",
            discount_applied="double",
        ),
        (
            uuid("transaction_id"),
            uuid("customer_id"),
            in_range("order_value", 0.0),
            finite("order_value"),
            in_range("num_items", 1),
            one_of("payment_method", PAYMENTS),
            in_range("discount_applied", 0.0, 1.0),
        ),
    ),
    "clickstream": Contract(
        _schema(
            session_id="string",
            customer_id="string",
            event_timestamp="timestamp",
            page_type="string",
            time_on_page_seconds="double",
            device_type="string",
            added_to_cart="boolean",
            search_query="string?",
        ),
        (
            uuid("session_id"),
            uuid("customer_id"),
            one_of("page_type", PAGES),
            in_range("time_on_page_seconds", 0.0),
            one_of("device_type", DEVICES),
        ),
    ),
    "support_tickets": Contract(
        _schema(
            ticket_id="string",
            customer_id="string",
            created_at="timestamp",
            topic="string",
            raw_text="string",
            sentiment_score="double",
            resolved="boolean",
            resolution_days="double?",
        ),
        (
            uuid("ticket_id"),
            uuid("customer_id"),
            in_range("sentiment_score", -1.0, 1.0),
            in_range("resolution_days", 0.0),
        ),
    ),
    "survival_labels": Contract(
        _schema(
            customer_id="string",
            first_purchase_date="timestamp",
            last_purchase_date="timestamp",
            duration_days="double",
            event_observed="boolean",
            total_orders="bigint",
            total_revenue="double",
        ),
        (
            uuid("customer_id"),
            in_range("duration_days", 0.0),
            in_range("total_orders", 0),
            in_range("total_revenue", 0.0),
        ),
        strip=False,
    ),
}


def stripped(df: DataFrame) -> DataFrame:
    """Trim surrounding whitespace of every string column."""
    return df.select(
        *[
            F.btrim(F.col(quoted(f.name)), F.lit(" \t\n\v\f\r")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


def _converted(name: str, kind: T.DataType, want: T.DataType) -> Column:
    """The column as the declared type, null where that would lose something; numbers are no text, and text is read as Spark casts it."""
    c = F.col(quoted(name))
    stamps = (T.TimestampType, T.TimestampNTZType, T.DateType)
    if isinstance(want, T.StringType) or (isinstance(want, stamps) and not isinstance(kind, (T.StringType, *stamps))):
        return F.lit(None).cast(want)
    if isinstance(want, T.BooleanType) and isinstance(kind, T.NumericType):
        return F.when(c.isin(0, 1), c.cast("double") == 1)
    cast = c.try_cast(want)
    if isinstance(want, T.IntegralType) and isinstance(kind, T.FractionalType):
        return F.when(cast.cast(kind) == c, cast)
    if isinstance(want, T.NumericType) and isinstance(kind, T.BooleanType):
        return F.lit(None).cast(want)
    return cast


def typed_columns(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """Every declared column in its declared type; null where it is absent or cannot be converted."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for f in contract.schema.fields:
        if f.name not in kinds:
            out[f.name] = F.lit(None).cast(f.dataType)
        elif _same(kinds[f.name], f.dataType):
            out[f.name] = F.col(quoted(f.name))
        else:
            out[f.name] = _converted(f.name, kinds[f.name], f.dataType)
    return out


def _same(kind: T.DataType, want: T.DataType) -> bool:
    """Whether values need no conversion: the same type, or one that holds nothing the declared one lacks."""
    if kind == want or (isinstance(kind, T.TimestampNTZType) and isinstance(want, T.TimestampType)):
        return True
    wider = {T.LongType: (T.IntegerType, T.ShortType, T.ByteType), T.IntegerType: (T.ShortType, T.ByteType)}
    wider[T.DoubleType] = (T.FloatType, T.DecimalType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    return isinstance(kind, wider.get(type(want), ()))


def conditions(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """"column:rule" -> true where the row breaks it, in declaration order; never null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    typed = typed_columns(df, contract)
    out = {f"{c}:column": F.lit(True) for c in typed if c not in kinds}
    for f in contract.schema.fields:
        if f.name in kinds and not _same(kinds[f.name], f.dataType):
            out[f"{f.name}:type"] = F.col(quoted(f.name)).isNotNull() & typed[f.name].isNull()
    out |= {f"{c}:required": F.col(quoted(c)).isNull() for c in contract.required if c in kinds}
    for r in contract.rules:
        if r.column in kinds:
            out[f"{r.column}:{r.name}"] = F.coalesce(r.broken(typed[r.column]), F.lit(False))
    return out


def with_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Add `violations`: the name of every broken rule.

    One projection over the scan, no shuffle.
    """
    if contract.strip:
        df = stripped(df)
    checks = [F.when(broken, F.lit(name)) for name, broken in conditions(df, contract).items()]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def apply_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows in the declared types, quarantined rows as they came with their `violations`)."""
    checked = with_violations(df, contract)
    typed = typed_columns(df, contract)
    columns = [typed[c].alias(c) if c in typed else F.col(quoted(c)) for c in df.columns]
    valid = checked.filter(F.size("violations") == 0).select(*columns)
    return valid, checked.filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows breaking each rule, every rule listed, and rows breaking `any`, from one scan."""
    if contract.strip:
        df = stripped(df)
    checks = conditions(df, contract)
    any_broken = reduce(or_, checks.values())
    named = {**checks, "any": any_broken}
    counted = df.agg(*[F.count_if(broken).alias(f"n{i}") for i, broken in enumerate(named.values())])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("n_rows"))
            for i, name in enumerate(named)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")
