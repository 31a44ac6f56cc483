from __future__ import annotations

import os
import sys
from datetime import datetime

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tenure.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def day(text: str) -> datetime:
    return datetime.fromisoformat(text)


# Orders of three customers by day of 2021: (number, day, value, items, category, payment, returned, discount).
ORDERS = {
    "ana": [(11, "05-02", 20.0, 1, "Garden", "paypal", False, 0.0), (12, "06-11", 35.0, 2, "Kitchen", "debit_card", True, 0.05),
            (13, "06-30", 65.0, 6, "Garden", "paypal", False, 0.25)],
    "ben": [(21, "04-18", 9.5, 1, "Toys", "crypto", False, 0.0)],
    "cid": [(31, "02-07", 210.0, 8, "Sport", "credit_card", False, 0.1), (32, "07-19", 40.0, 3, "Sport", "debit_card", True, 0.3)],
}
# Visits: (customer, day, device, pages with their seconds and whether something went into the cart). Cid never visits.
VISITS = [
    ("ana", "05-02", "tablet", [("search", 12.0, False), ("product", 48.0, False), ("checkout", 30.0, True)]),
    ("ana", "06-11", "desktop", [("home", 15.0, False)]),
    ("ben", "04-18", "mobile", [("product", 25.0, True), ("product", 75.0, False)]),
]


@pytest.fixture(scope="session")
def shop(spark):
    """The five tables of three customers: one leaves, one wrote all tickets, one has neither visits nor tickets."""
    at = lambda d: day(f"2021-{d}")
    orders = [(f"o-{n}", c, at(d), *rest) for c, rows in ORDERS.items() for n, d, *rest in rows]
    clicks = [(f"v-{i}", c, at(d), page, s, device, cart) for i, (c, d, device, pages) in enumerate(VISITS) for page, s, cart in pages]
    tickets = [
        ("q-1", "ben", at("04-20"), "returns", "wrong size, please exchange", 0.1, True, 4.0),
        ("q-2", "ben", at("05-01"), "returns", "still no label", -0.6, False, None),
        ("q-3", "ben", at("05-03"), "payment", "refund arrived", 0.8, True, 1.0),
    ]
    people = [("ana", 33.0, "Non-binary", "Silver", "email"), ("ben", 61.0, "M", "Platinum", "referral"), ("cid", 19.0, "F", "Bronze", "direct")]
    outcome = [
        ("ana", at("05-02"), at("06-30"), 59.0, True, 3, 120.0),
        ("ben", at("04-18"), at("04-18"), 92.0, False, 1, 9.5),
        ("cid", at("02-07"), at("07-19"), 162.0, False, 2, 250.0),
    ]
    # The column names of the customer tables.
    schemas = {
        "customers": "customer_id string, age double, gender string, loyalty_tier string, acquisition_channel string",
        "transactions": "transaction_id string, customer_id string, event_timestamp timestamp, order_value double, num_items int, "
        "product_category string, payment_method string, is_returned boolean, discount_applied double",
        "clickstream": "session_id string, customer_id string, event_timestamp timestamp, page_type string, time_on_page_seconds double, "
        "device_type string, added_to_cart boolean",
        "tickets": "ticket_id string, customer_id string, created_at timestamp, topic string, raw_text string, sentiment_score double, "
        "resolved boolean, resolution_days double",
        "labels": "customer_id string, first_purchase_date timestamp, last_purchase_date timestamp, duration_days double, event_observed boolean, "
        "total_orders bigint, total_revenue double",
    }
    rows = {"customers": people, "transactions": orders, "clickstream": clicks, "tickets": tickets, "labels": outcome}
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in schemas.items()}


@pytest.fixture(scope="session")
def cohort_pdf() -> pd.DataFrame:
    """Survival rows with ties in time and in risk, and one time shared by a third of the rows."""
    rng = np.random.default_rng(3)
    n = 240
    pdf = pd.DataFrame(
        {
            "customer_id": [f"c{i}" for i in range(n)],
            "f1": rng.normal(size=n),
            "f2": rng.normal(size=n) * 2,
            "f3": rng.integers(0, 3, n).astype(float),
        }
    )
    time = np.ceil(rng.exponential(30, n) * np.exp(-0.6 * pdf.f1))
    pdf["event"] = rng.random(n) < 0.7
    end = 40.0
    pdf["event"] = pdf.event & (time <= end)
    pdf["duration"] = np.minimum(time, end)
    pdf["risk"] = np.round(0.6 * pdf.f1 + 0.1 * pdf.f3, 1)
    return pdf


@pytest.fixture(scope="session")
def cohort(spark, cohort_pdf):
    return spark.createDataFrame(cohort_pdf).repartition(3)
