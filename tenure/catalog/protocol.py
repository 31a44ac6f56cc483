"""Files, untyped input, saved models, runs and counters: the parts around the operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tenure.catalog import register
from tenure.catalog.customers import _QUOTED, feature_table, matrix_sql
from tenure.catalog.extended import _TREE_FEATURES, _TREE_SQL
from tenure.catalog.models import _MEDIANS_SQL, _NEWTON_STEPS, _newton_sql, fixed_model, scored_table
from tenure.catalog.monitoring import _REPORT_SQL, _psi_report, sides
from tenure.catalog.views import HORIZONS, RISK_FEATURES, labels, rounded, scored, sql
from tenure.operators.boosted import BoostedCox, BoostedModel
from tenure.operators.contracts import CONTRACTS, apply_contract, violation_counts
from tenure.operators.drift import drift_gate
from tenure.operators.evaluate import evaluate, results_table
from tenure.operators.quality import FaultAudit, fault_report
from tenure.operators.scoring import counted
from tenure.operators.survival import CoxModel, CoxPH
from tenure.operators.training import RunLog, train_final
from tenure.plans.materialise import checkpoint_root, materialise
from tenure.sources import retail
from tenure.sources.io import read_bundle, read_pair, write_bundle, write_json, write_table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- untyped input ------------------------------------------------------------------------------

# Every seventh, eleventh... order, by number, has one value that its declared type cannot hold.
_SPOILT = {"num_items": (7, ".5"), "order_value": (11, " EUR"), "is_returned": (13, "?"), "event_timestamp": (17, " or so")}


@register(
    "contract_types",
    sql("", "transactions").rstrip()
    + """,
raw AS (SELECT *, transaction_id::BIGINT AS k FROM transactions),
rows_ AS (SELECT k % 7 = 0 AND num_items IS NOT NULL AS items, k % 11 = 0 AS amount, k % 13 = 0 AND is_returned IS NOT NULL AS returned,
                 k % 17 = 0 AS late, num_items, is_returned, discount_applied, payment_method, order_value FROM raw)
SELECT r.rule, r.n AS n_rows FROM (SELECT count(*) AS n, count(*) FILTER (WHERE items) AS items, count(*) FILTER (WHERE amount) AS amount,
  count(*) FILTER (WHERE returned) AS returned, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE num_items IS NULL) AS no_items,
  count(*) FILTER (WHERE is_returned IS NULL) AS no_return, count(*) FILTER (WHERE discount_applied IS NULL) AS no_discount,
  count(*) FILTER (WHERE payment_method IS NULL) AS no_payment, count(*) FILTER (WHERE NOT amount AND order_value < 0) AS low,
  count(*) FILTER (WHERE NOT items AND num_items < 1) AS few, count(*) FILTER (WHERE payment_method = 'voucher') AS voucher,
  count(*) FILTER (WHERE discount_applied < 0 OR discount_applied > 1) AS discount FROM rows_),
LATERAL (SELECT unnest([
  {'rule': 'product_category:column', 'n': n}, {'rule': 'event_timestamp:type', 'n': late}, {'rule': 'order_value:type', 'n': amount},
  {'rule': 'num_items:type', 'n': items}, {'rule': 'is_returned:type', 'n': returned}, {'rule': 'discount_applied:type', 'n': 0},
  {'rule': 'transaction_id:required', 'n': 0}, {'rule': 'customer_id:required', 'n': 0}, {'rule': 'event_timestamp:required', 'n': 0},
  {'rule': 'order_value:required', 'n': 0}, {'rule': 'num_items:required', 'n': no_items}, {'rule': 'payment_method:required', 'n': no_payment},
  {'rule': 'is_returned:required', 'n': no_return}, {'rule': 'discount_applied:required', 'n': no_discount}, {'rule': 'transaction_id:uuid', 'n': 0},
  {'rule': 'customer_id:uuid', 'n': 0}, {'rule': 'order_value:range', 'n': low}, {'rule': 'order_value:finite', 'n': 0}, {'rule': 'num_items:range', 'n': few},
  {'rule': 'payment_method:enum', 'n': voucher}, {'rule': 'discount_applied:range', 'n': discount}, {'rule': 'any', 'n': n}]) AS r)""",
)
def _contract_types(spark, sf_dir):
    """Orders read as text, as from a file without types: what does not convert, and a column that is not there."""
    rows = retail.transactions(spark, sf_dir).withColumn("_k", F.col("transaction_id").cast("long"))
    for key in ("transaction_id", "customer_id"):
        rows = rows.withColumn(key, retail.uuid_form(F.col(key)))
    text = {
        c: F.when(F.col("_k") % n == 0, F.concat(F.col(c).cast("string"), F.lit(mark))).otherwise(F.col(c).cast("string"))
        for c, (n, mark) in _SPOILT.items()
    }
    text["discount_applied"] = F.col("discount_applied").cast("string")
    return violation_counts(rows.withColumns(text).drop("_k", "product_category"), CONTRACTS["transactions"])


@register(
    "contract_valid",
    sql(
        """SELECT customer_id, age FROM customers
           WHERE gender IS NOT NULL AND acquisition_channel <> 'billboard' AND (age BETWEEN 18 AND 100 OR age IS NULL) AND loyalty_tier <> 'None'""",
        "customers",
    ),
)
def _contract_valid(spark, sf_dir):
    rows = retail.customers(spark, sf_dir).withColumn("_id", F.col("customer_id"))
    valid, _ = apply_contract(rows.withColumn("customer_id", retail.uuid_form(F.col("customer_id"))), CONTRACTS["customers"])
    return valid.select(F.col("_id").alias("customer_id"), "age")


@register(
    "faults_zero_heavy",
    """SELECT 'lines' AS dataset, fault, n::BIGINT AS n FROM (SELECT
         count(*) FILTER (WHERE q > 0 AND l_discount - 0.1 > 10 * q) AS outliers FROM lineitem,
         (SELECT quantile_cont(l_discount - 0.1, 0.99) AS q FROM lineitem)) UNPIVOT (n FOR fault IN (outliers))""",
)
def _faults_zero_heavy(spark, sf_dir):
    """Outliers of a column whose 99th percentile is zero: a multiple of zero is no fence."""
    lines = retail.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") - 0.1).alias("below"))
    report = fault_report(lines, "lines", FaultAudit(key="l_orderkey", outlier_cols=("below",)))
    return report.filter("fault = 'outliers'")


# --- files --------------------------------------------------------------------------------------


@register(
    "bundle_round_trip",
    sql(
        """SELECT 'customers' AS dataset, count(*) AS n_rows, count(age)::DOUBLE AS total FROM customers
           UNION ALL SELECT 'support_tickets', count(*), round(sum(sentiment_score), 4) FROM support_tickets
           UNION ALL SELECT 'survival_labels', count(*), sum(duration_days) FROM labels""",
        "customers",
        "support_tickets",
        "labels",
    ),
)
def _bundle(spark, sf_dir):
    """Tables written as a bundle, one of them by month, and read back."""
    root = _folder(spark, "bundle")
    tickets = retail.support_tickets(spark, sf_dir).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    tables = {"customers": retail.customers(spark, sf_dir), "support_tickets": tickets, "survival_labels": labels(spark, sf_dir)}
    write_bundle(tables, root, partition_by={"support_tickets": ["month"]})
    back = read_bundle(spark, root, list(tables))
    sums = {"customers": F.count("age").cast("double"), "support_tickets": F.round(F.sum("sentiment_score"), 4), "survival_labels": F.sum("duration_days")}
    parts = [df.agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), sums[n].alias("total")) for n, df in back.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "pair_round_trip",
    """SELECT CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN 'current' ELSE 'reference' END AS side, count(*) AS n_rows,
              round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""",
)
def _pair(spark, sf_dir):
    """Reference and current tables of a drift comparison, written and read as a pair."""
    root = _folder(spark, "pair")
    for name, df in zip(("reference", "current"), sides(spark, sf_dir)):
        write_table(df, f"{root}/{name}", overwrite=False)
    pair = zip(("reference", "current"), read_pair(spark, f"{root}/reference", f"{root}/current"))
    parts = [df.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")) for n, df in pair]
    return parts[0].unionByName(parts[1])


@register(
    "json_round_trip",
    sql("SELECT customer_id, duration_days, event_observed, total_orders FROM labels", "labels"),
)
def _json(spark, sf_dir):
    path = _folder(spark, "labels")
    rows = labels(spark, sf_dir).select("customer_id", "duration_days", "event_observed", "total_orders")
    write_json(rows, path, overwrite=False)
    return spark.read.schema(rows.schema).json(path)


# --- the likelihood of all features -------------------------------------------------------------

_BETA = 0.02


def _derivatives_sql(efron: bool) -> str:
    """Gradient and curvature of every feature at one point, by definition."""
    left = "m / d * e" if efron else "0 * e"
    risk = " + ".join(_QUOTED)
    return matrix_sql(
        f"""SELECT feature, round(max(total) + {_BETA} - any_value(died), 5) AS gradient, round(max(curve) + 1, 5) AS curvature FROM (
          SELECT feature, sum(r1 / r0) AS total, sum(r2 / r0 - (r1 / r0) ** 2) AS curve FROM (
            SELECT feature, s0 - {left}0 AS r0, s1 - {left}1 AS r1, s2 - {left}2 AS r2 FROM (
              SELECT feature, d, s0, s1, s2, e0, e1, e2, unnest(range(d::BIGINT)) AS m FROM sets)) GROUP BY feature)
          JOIN (SELECT feature, sum(x) FILTER (WHERE event_observed) AS died FROM long GROUP BY feature) USING (feature) GROUP BY feature""",
        "imputed",
        "scaled",
    ).replace(
        "SELECT feature, round(max(total)",
        f""", wide AS (SELECT scaled.*, event_observed, duration_days AS t, exp({_BETA} * ({risk})) AS w FROM scaled JOIN labels USING (customer_id)),
        long AS (SELECT feature, x, event_observed, t, w FROM wide UNPIVOT (x FOR feature IN ({", ".join(_QUOTED)}))),
        sets AS (SELECT feature, t, sum(event_observed::INT) AS d, sum(sum(w)) OVER o AS s0, sum(sum(w * x)) OVER o AS s1, sum(sum(w * x * x)) OVER o AS s2,
            coalesce(sum(w) FILTER (WHERE event_observed), 0) AS e0, coalesce(sum(w * x) FILTER (WHERE event_observed), 0) AS e1,
            coalesce(sum(w * x * x) FILTER (WHERE event_observed), 0) AS e2 FROM long GROUP BY feature, t WINDOW o AS (PARTITION BY feature ORDER BY t DESC))
        SELECT feature, round(max(total)""",
        1,
    )


def _register_derivatives(name: str, ties: str) -> None:
    @register(name, _derivatives_sql(ties == "efron"))
    def _derivatives(spark, sf_dir):
        """Gradient and curvature of the penalised likelihood of the whole feature matrix at one point."""
        table, names = feature_table(spark, sf_dir)
        _, gradient, second = CoxPH(alpha=1.0, ties=ties).derivatives(table, names, [_BETA] * len(names))
        rows = [(n, float(g), float(c)) for n, g, c in zip(names, gradient, second.diagonal())]
        return rounded(spark.createDataFrame(rows, "feature string, gradient double, curvature double"), 5, "gradient", "curvature")


_register_derivatives("cox_derivatives", "breslow")
_register_derivatives("cox_derivatives_efron", "efron")


# --- models, runs, scores -----------------------------------------------------------------------


@register(
    "model_round_trip",
    sql(f"SELECT customer_id, round(risk, 9) AS risk, median_days FROM ({_MEDIANS_SQL})", "scored", "baseline"),
)
def _model_round_trip(spark, sf_dir):
    """A model written, read and applied."""
    table, path = scored_table(spark, sf_dir), _folder(spark, "model")
    fixed_model(table).save(path)
    out = CoxModel.load(spark, path).median(table.select("customer_id", *RISK_FEATURES))
    return rounded(out.select("customer_id", "risk", "median_days"), 9, "risk")


_STUMP_RATE = 0.3


@register(
    "boosted_scores",
    sql("", "scored").rstrip()
    + ",\n"
    + _TREE_SQL
    + f""",
leaf AS (SELECT path, -sum(g) / (sum(h) + 1) * {_STUMP_RATE} AS risk FROM rows1 GROUP BY path),
placed AS (SELECT customer_id, event, duration, coalesce(CASE WHEN f IS NULL THEN '' WHEN (CASE f WHEN 0 THEN {_TREE_FEATURES[0]} ELSE {_TREE_FEATURES[1]} END) <= v
                  THEN 'b' ELSE 'a' END, '') AS path FROM scored LEFT JOIN split0 ON true),
risks AS (SELECT customer_id, event, duration, leaf.risk FROM placed JOIN leaf USING (path)),
own AS (SELECT t, sum(d / s0) OVER (ORDER BY t) AS hazard FROM (SELECT duration AS t, sum(event::INT) AS d,
          sum(sum(exp(risk))) OVER (ORDER BY duration DESC) AS s0 FROM risks GROUP BY duration))
SELECT customer_id, round(risk, 8) AS risk, coalesce((SELECT min(t) FROM own WHERE hazard >= ln(2) * exp(-risk)), 'infinity'::DOUBLE) AS median_days,
       round(exp(-(SELECT max(hazard) FROM own WHERE t <= {HORIZONS[0]}) * exp(risk)), 8) AS surv FROM risks""",
)
def _boosted_scores(spark, sf_dir):
    """Risk, curve and median of a boosted model of one split, written and read before it is applied."""
    table = scored_table(spark, sf_dir)
    spec = BoostedCox(n_estimators=1, max_depth=1, learning_rate=_STUMP_RATE, subsample=1.0, colsample_bytree=1.0)
    path = _folder(spark, "boosted")
    spec.fit(table, list(_TREE_FEATURES)).save(path)
    model = BoostedModel.load(spark, path)
    out = model.median(table.select("customer_id", *_TREE_FEATURES))
    out = out.withColumn("surv", model.survival_array([HORIZONS[0]])[0])
    return rounded(out.select("customer_id", "risk", "median_days", "surv"), 8, "risk", "surv")


@register(
    "evaluation",
    sql("", "scored", "brier", "weighted", "horizons").rstrip()
    + """,
own AS (SELECT h FROM horizons WHERE h < (SELECT max(duration) FROM scored)),
pairs AS (SELECT (count(*) FILTER (WHERE a.risk > b.risk) + 0.5 * count(*) FILTER (WHERE a.risk = b.risk)) / count(*) AS v
  FROM scored a JOIN scored b ON a.event AND (a.duration < b.duration OR (a.duration = b.duration AND NOT b.event))),
brier_ AS (SELECT t, brier FROM brier JOIN own ON t = h),
auc_ AS (SELECT h, sum(inv_g * (below + same / 2.0)) / (sum(inv_g) * max(n)) AS v FROM (SELECT h, a.inv_g,
    (SELECT count(*) FROM weighted b WHERE b.duration > h AND b.risk < a.risk) AS below,
    (SELECT count(*) FROM weighted b WHERE b.duration > h AND b.risk = a.risk) AS same, (SELECT count(*) FROM weighted b WHERE b.duration > h) AS n
  FROM weighted a, own WHERE a.duration <= h AND a.event) GROUP BY h)
SELECT 'fixed' AS model, 0 AS fold, metric, t, round(value, 8) AS value FROM (
  SELECT 'c_index' AS metric, NULL::INT AS t, v AS value FROM pairs
  UNION ALL SELECT 'ibs', NULL, (SELECT sum(area) / (max(t) - min(t)) FROM (SELECT t, (lead(t) OVER (ORDER BY t) - t) * (lead(brier) OVER (ORDER BY t) + brier) / 2 AS area FROM brier_))
  UNION ALL SELECT 'brier', t::INT, brier FROM brier_ UNION ALL SELECT 'td_auc', h::INT, v FROM auc_
  UNION ALL SELECT 'n_train', NULL, count(*) FROM scored UNION ALL SELECT 'n_test', NULL, count(*) FROM scored)""",
)
def _evaluation(spark, sf_dir):
    """All figures of one model as the table of metrics."""
    table = scored_table(spark, sf_dir)
    rows = table.select("customer_id", "duration", "event", *RISK_FEATURES)
    return rounded(results_table(spark, [evaluate(fixed_model(table), rows, rows, HORIZONS)]), 8, "value")


@register(
    "final_run",
    sql("", "scored").rstrip()
    + ",\n"
    + _newton_sql()
    + f"""
SELECT 'CoxPH_final' AS name, 'final' AS training_mode, (SELECT count(*) FROM scored)::VARCHAR AS n_samples, '1' AS n_features, 'x' AS feature,
       round(b, 6) AS coef FROM b{_NEWTON_STEPS}""",
)
def _final_run(spark, sf_dir):
    """A model fitted on every row, its run in the log, and the coefficients of the model read back from it."""
    table = materialise(scored(spark, sf_dir).select("duration", "event", (F.col("frequency") / 10).alias("x")), "table")
    root = _folder(spark, "runs")
    log = RunLog(spark, root)
    run_id = train_final(CoxPH(alpha=1.0), table, ["x"], f"{root}/models", log)
    coef = CoxModel.load(spark, f"{root}/models/{run_id}").coefficients(spark)
    run = log.runs().filter(F.col("run_id") == run_id).select(
        "name", F.col("tags.training_mode").alias("training_mode"), F.col("params.n_samples").alias("n_samples"), F.col("params.n_features").alias("n_features")
    )
    return rounded(run.crossJoin(coef.select("feature", "coef")), 6, "coef")


@register(
    "scoring_counters",
    sql("SELECT count(*) AS total, count(*) FILTER (WHERE customer_id::BIGINT % 5 IN (0, 1, 2)) AS failed FROM scored", "scored"),
)
def _scoring_counters(spark, sf_dir):
    """Rows asked for and rows that cannot be scored: absent, not a number, infinite."""
    table, k = scored_table(spark, sf_dir), F.col("customer_id").cast("long") % 5
    spoilt = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("-inf"))).when(k != 0, F.col(RISK_FEATURES[0]))
    wide, seen = counted(table.withColumn(RISK_FEATURES[0], spoilt), fixed_model(table))
    wide.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["total"], seen.get["failed"])], "total long, failed long")


@register(
    "drift_gate",
    f"SELECT share, count(*) FILTER (WHERE drifted) / count(*) >= share AS failed FROM ({_REPORT_SQL}), (SELECT unnest([0.25, 0.9]) AS share) GROUP BY share",
)
def _drift_gate(spark, sf_dir):
    report = materialise(_psi_report(spark, sf_dir), "report")
    return spark.createDataFrame([(share, drift_gate(report, share)) for share in (0.25, 0.9)], "share double, failed boolean")


