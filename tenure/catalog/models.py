"""Survival models, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.catalog import register
from tenure.catalog.customers import feature_table
from tenure.catalog.views import (
    HORIZONS,
    RISK_COEF,
    RISK_FEATURES,
    rounded,
    scored,
    sql,
)
from tenure.operators.behaviour import (
    changed_scores,
    curve_breaks,
    median_by_risk_quartile,
    quartile_means,
    risk_by_outcome,
    spearman,
)
from tenure.operators.evaluate import (
    aggregate_folds,
    brier,
    c_index,
    censoring_km,
    integrated_brier,
    stratified_folds,
    td_auc,
    valid_horizons,
    with_censoring_weight,
)
from tenure.operators.scoring import score
from tenure.operators.survival import (
    CoxModel,
    CoxPH,
    breslow_baseline,
    partial_log_likelihood,
)
from tenure.operators.training import cross_validate
from tenure.plans.materialise import materialise

_SURV = "exp(-hazard * exp(risk))"


def scored_table(spark, sf_dir):
    return materialise(scored(spark, sf_dir), "scored")


def fixed_model(table) -> CoxModel:
    """The fixed linear score with the baseline its rows imply."""
    return CoxModel(
        name="fixed",
        features=list(RISK_FEATURES),
        baseline=materialise(breslow_baseline(table), "baseline"),
        coef=list(RISK_COEF),
        version="fixed-1",
    )


@register(
    "risk_score",
    sql("SELECT customer_id, round(risk, 9) AS risk FROM scored", "scored"),
)
def _risk_score(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("customer_id", "risk"), 9, "risk")


@register(
    "breslow_baseline",
    sql("SELECT t, round(hazard, 8) AS hazard FROM baseline", "baseline"),
)
def _breslow(spark, sf_dir):
    return rounded(breslow_baseline(scored_table(spark, sf_dir)), 8, "hazard")


@register(
    "survival_curve",
    sql(
        f"""SELECT customer_id, h::DOUBLE AS t, round({_SURV}, 8) AS surv
            FROM scored, (SELECT h, coalesce(max(hazard) FILTER (WHERE t <= h), 0) AS hazard
                          FROM horizons, baseline GROUP BY h)""",
        "baseline",
        "horizons",
    ),
)
def _survival_curve(spark, sf_dir):
    table = scored_table(spark, sf_dir)
    curves = fixed_model(table).survival(table.select("customer_id", *RISK_FEATURES), HORIZONS)
    return rounded(curves.select("customer_id", "t", "surv"), 8, "surv")


@register(
    "survival_all_times",
    sql(
        f"""SELECT customer_id, count(*) AS n_times, round(min({_SURV}), 8) AS least, round(sum({_SURV}), 5) AS total
            FROM scored, baseline GROUP BY customer_id""",
        "baseline",
    ),
)
def _survival_all_times(spark, sf_dir):
    """Every customer's curve at every training time, summed up."""
    table = scored_table(spark, sf_dir)
    curves = fixed_model(table).survival(table.select("customer_id", *RISK_FEATURES))
    each = curves.groupBy("customer_id").agg(F.count("t").alias("n_times"), F.min("surv").alias("least"), F.sum("surv").alias("total"))
    return rounded(rounded(each, 8, "least"), 5, "total")


@register(
    "restricted_mean",
    sql(
        f"""SELECT customer_id, count(*) AS n_times, max(t) AS horizon_days, round(min(t) + sum({_SURV} * (coalesce(after, t) - t)), 5) AS mean_days
            FROM scored, (SELECT *, lead(t) OVER (ORDER BY t) AS after FROM baseline) GROUP BY customer_id""",
        "baseline",
    ),
)
def _restricted_mean(spark, sf_dir):
    table = scored_table(spark, sf_dir)
    means = fixed_model(table).restricted_mean(table.select("customer_id", *RISK_FEATURES))
    return rounded(means.select("customer_id", "n_times", "horizon_days", "mean_days"), 5, "mean_days")


_MEDIAN = """coalesce((SELECT min(t) FROM baseline WHERE hazard >= ln(2) * exp(-risk)),
             'infinity'::DOUBLE)"""
_MEDIANS_SQL = f"SELECT customer_id, event, risk, {_MEDIAN} AS median_days FROM scored"


@register(
    "median_survival",
    sql(f"SELECT customer_id, median_days FROM ({_MEDIANS_SQL})", "scored", "baseline"),
)
def _median_survival(spark, sf_dir):
    table = scored_table(spark, sf_dir)
    return fixed_model(table).median(table.select("customer_id", *RISK_FEATURES)).select(
        "customer_id", "median_days"
    )


@register(
    "cox_partial_loglik",
    sql(
        """SELECT sum(d)::BIGINT AS n_events, round(sum(dr - d * ln(s0)), 5) AS log_likelihood,
                  round(-sum(dr - d * ln(s0)) / sum(d), 8) AS loss
           FROM (SELECT duration, sum(event::INT) AS d,
                        sum(CASE WHEN event THEN risk ELSE 0 END) AS dr,
                        sum(sum(exp(risk))) OVER (ORDER BY duration DESC) AS s0
                 FROM scored GROUP BY duration) WHERE d > 0""",
        "scored",
    ),
)
def _partial_loglik(spark, sf_dir):
    out = partial_log_likelihood(scored_table(spark, sf_dir))
    return rounded(rounded(out, 5, "log_likelihood"), 8, "loss")


# One-feature Newton steps, unrolled: x is the frequency divided by 10, alpha is 1.
_NEWTON_STEPS = 8


def _newton_sql() -> str:
    head = "x_ AS (SELECT duration AS t, event AS e, frequency / 10 AS x FROM scored),\nb0 AS (SELECT 0::DOUBLE AS b)"
    for i in range(_NEWTON_STEPS):
        head += f""",
b{i + 1} AS (
  SELECT any_value(b) - (any_value(b) - sum(dx) + sum(d * s1 / s0))
                        / (1 + sum(d * (s2 / s0 - (s1 / s0) ** 2))) AS b
  FROM (SELECT b, sum(e::INT) AS d, sum(CASE WHEN e THEN x ELSE 0 END) AS dx,
               sum(sum(exp(b * x))) OVER w AS s0, sum(sum(x * exp(b * x))) OVER w AS s1,
               sum(sum(x * x * exp(b * x))) OVER w AS s2
        FROM x_, b{i} GROUP BY b, t WINDOW w AS (ORDER BY t DESC)))"""
    return head


@register(
    "cox_fit_small",
    sql("", "scored").rstrip()
    + ",\n"
    + _newton_sql()
    + f"\nSELECT 'x' AS feature, round(b, 6) AS coef FROM b{_NEWTON_STEPS}",
)
def _cox_fit_small(spark, sf_dir):
    table = scored(spark, sf_dir).select(
        "duration", "event", (F.col("frequency") / 10).alias("x")
    )
    model = CoxPH(alpha=1.0).fit(table, ["x"])
    return rounded(model.coefficients(spark).select("feature", "coef"), 6, "coef")


def _efron_sql() -> str:
    """One-feature Newton steps with Efron's ties: the m-th of d tied events leaves m / d of their own sums out of the risk set."""
    out = "x_ AS (SELECT duration AS t, event AS e, frequency / 10 AS x FROM scored),\nb0 AS (SELECT 0::DOUBLE AS b)"
    for i in range(_NEWTON_STEPS):
        out += f""",
c{i} AS (
  SELECT any_value(b) AS b, t, sum(e::INT) AS d, coalesce(sum(x) FILTER (WHERE e), 0) AS dx,
         sum(sum(exp(b * x))) OVER w AS s0, sum(sum(x * exp(b * x))) OVER w AS s1, sum(sum(x * x * exp(b * x))) OVER w AS s2,
         coalesce(sum(exp(b * x)) FILTER (WHERE e), 0) AS e0, coalesce(sum(x * exp(b * x)) FILTER (WHERE e), 0) AS e1,
         coalesce(sum(x * x * exp(b * x)) FILTER (WHERE e), 0) AS e2
  FROM x_, b{i} GROUP BY t WINDOW w AS (ORDER BY t DESC)),
b{i + 1} AS (
  SELECT any_value(b) - (any_value(b) - any_value(total) + sum(r1 / r0)) / (1 + sum(r2 / r0 - (r1 / r0) ** 2)) AS b
  FROM (SELECT b, s0 - m / d * e0 AS r0, s1 - m / d * e1 AS r1, s2 - m / d * e2 AS r2, (SELECT sum(dx) FROM c{i}) AS total
        FROM (SELECT *, unnest(range(d::BIGINT)) AS m FROM c{i})))"""
    return out


@register(
    "cox_fit_efron_small",
    sql("", "scored").rstrip() + ",\n" + _efron_sql() + f"\nSELECT 'x' AS feature, round(b, 6) AS coef FROM b{_NEWTON_STEPS}",
)
def _cox_fit_efron_small(spark, sf_dir):
    table = scored(spark, sf_dir).select("duration", "event", (F.col("frequency") / 10).alias("x"))
    model = CoxPH(alpha=1.0, ties="efron").fit(table, ["x"])
    return rounded(model.coefficients(spark).select("feature", "coef"), 6, "coef")


@register(
    "cox_fit_unpenalised",
    sql("", "scored").rstrip()
    + ",\n"
    + _newton_sql().replace("any_value(b) - sum(dx)", "- sum(dx)").replace("(1 + sum(d * (s2", "(sum(d * (s2")
    + f"\nSELECT feature, round(CASE feature WHEN 'x' THEN b ELSE 0 END, 6) AS coef FROM b{_NEWTON_STEPS}, (SELECT unnest(['x', 'one']) AS feature)",
)
def _cox_fit_unpenalised(spark, sf_dir):
    """No penalty, beside a constant that the likelihood does not depend on."""
    table = scored(spark, sf_dir).select("duration", "event", (F.col("frequency") / 10).alias("x"), F.lit(1.0).alias("one"))
    model = CoxPH(alpha=0.0).fit(table, ["x", "one"])
    return rounded(model.coefficients(spark).select("feature", "coef"), 6, "coef").withColumn("coef", F.col("coef") + 0.0)


@register("cox_fit")
def _cox_fit(spark, sf_dir):
    """Coefficients on the whole scaled feature matrix."""
    table, names = feature_table(spark, sf_dir)
    return CoxPH(alpha=1.0).fit(table, names).coefficients(spark)


@register("cox_fit_efron")
def _cox_fit_efron(spark, sf_dir):
    table, names = feature_table(spark, sf_dir)
    return CoxPH(alpha=1.0, ties="efron").fit(table, names).coefficients(spark)


# --- evaluation ---------------------------------------------------------------------------------


@register("censoring_km", sql("SELECT t, round(g, 8) AS g FROM km", "km"))
def _censoring_km(spark, sf_dir):
    return rounded(censoring_km(scored_table(spark, sf_dir)), 8, "g")


@register(
    "horizon_clip",
    sql(
        "SELECT h AS t FROM (SELECT unnest([365, 1095, 2190, 4000]) AS h) "
        "WHERE h < (SELECT max(duration_days) FROM labels)",
        "labels",
    ),
)
def _horizon_clip(spark, sf_dir):
    kept = valid_horizons([365, 1095, 2190, 4000], scored(spark, sf_dir).select("duration"))
    return spark.createDataFrame([(h,) for h in kept], "t int")


@register(
    "c_index",
    sql(
        """SELECT *, round((concordant + 0.5 * tied) / comparable, 9) AS c_index
           FROM (SELECT count(*) FILTER (WHERE a.risk > b.risk)::DOUBLE AS concordant,
                        count(*) FILTER (WHERE a.risk = b.risk)::DOUBLE AS tied,
                        count(*)::DOUBLE AS comparable
                 FROM scored a JOIN scored b ON a.event AND (a.duration < b.duration
                      OR (a.duration = b.duration AND NOT b.event)))""",
        "scored",
    ),
)
def _c_index(spark, sf_dir):
    return rounded(c_index(scored_table(spark, sf_dir)), 9, "c_index")


def _weighted(spark, sf_dir):
    table = scored_table(spark, sf_dir)
    km = materialise(censoring_km(table), "censoring")
    weighted = materialise(
        with_censoring_weight(table.select("risk", "duration", "event"), km), "weighted"
    )
    return table, km, weighted


def _brier_scores(spark, sf_dir):
    table, km, weighted = _weighted(spark, sf_dir)
    return brier(weighted, km, fixed_model(table).hazard_at(HORIZONS), HORIZONS)


@register("brier", sql("SELECT t, round(brier, 8) AS brier FROM brier", "brier"))
def _brier(spark, sf_dir):
    return rounded(_brier_scores(spark, sf_dir), 8, "brier")


@register(
    "ibs",
    sql(
        """SELECT round(sum(area) / (max(t) - min(t)), 8) AS ibs
           FROM (SELECT t, (lead(t) OVER (ORDER BY t) - t)
                           * (lead(brier) OVER (ORDER BY t) + brier) / 2 AS area FROM brier)""",
        "brier",
    ),
)
def _ibs(spark, sf_dir):
    return rounded(integrated_brier(_brier_scores(spark, sf_dir)), 8, "ibs")


@register(
    "td_auc",
    sql(
        """SELECT h AS t, round(sum(inv_g * (below + same / 2.0)) / nullif(sum(inv_g) * max(n), 0), 8) AS auc
           FROM (SELECT h, a.inv_g, a.risk,
                        (SELECT count(*) FROM weighted b WHERE b.duration > h AND b.risk < a.risk) AS below,
                        (SELECT count(*) FROM weighted b WHERE b.duration > h AND b.risk = a.risk) AS same,
                        (SELECT count(*) FROM weighted b WHERE b.duration > h) AS n
                 FROM weighted a, horizons WHERE a.duration <= h AND a.event)
           GROUP BY h""",
        "weighted",
        "horizons",
    ),
)
def _td_auc(spark, sf_dir):
    _, _, weighted = _weighted(spark, sf_dir)
    return rounded(td_auc(weighted, HORIZONS), 8, "auc")


_FOLDS_SQL = """SELECT customer_id, event, ((row_number() OVER (PARTITION BY event
                       ORDER BY md5(customer_id || '42'), customer_id) - 1) % 5)::INT AS fold, risk
                FROM scored"""


@register("folds", sql(f"SELECT customer_id, event, fold FROM ({_FOLDS_SQL})", "scored"))
def _folds(spark, sf_dir):
    table = scored(spark, sf_dir).select("customer_id", "event")
    return stratified_folds(materialise(table, "keys"))


@register(
    "fold_aggregate",
    sql(
        f"""SELECT 'mean_risk' AS metric, NULL::INT AS t, round(avg(v), 8) AS mean,
                   round(stddev_pop(v), 8) AS std, count(*) AS n_folds
            FROM (SELECT fold, avg(risk) AS v FROM ({_FOLDS_SQL}) GROUP BY fold)""",
        "scored",
    ),
)
def _fold_aggregate(spark, sf_dir):
    folded = stratified_folds(scored_table(spark, sf_dir))
    per_fold = folded.groupBy("fold").agg(F.avg("risk").alias("value")).select(
        "fold",
        F.lit("mean_risk").alias("metric"),
        F.lit(None).cast("int").alias("t"),
        "value",
    )
    return rounded(aggregate_folds(per_fold), 8, "mean", "std")


@register("cv_metrics")
def _cv_metrics(spark, sf_dir):
    """Every fold's figures for a Cox model on the scaled feature matrix."""
    table, names = feature_table(spark, sf_dir)
    return cross_validate(CoxPH(alpha=1.0), table, names, horizons=HORIZONS)


def _cv_sql() -> str:
    """The five folds' one-feature Newton steps, unrolled, and every figure on the fold left out."""
    out = f"""folded AS ({_FOLDS_SQL}), x_ AS (SELECT f.fold, duration AS t, s.event AS e, frequency / 10 AS x FROM folded f JOIN scored s USING (customer_id)),
ks AS (SELECT unnest(range(5))::INT AS k), b0 AS (SELECT k, 0::DOUBLE AS b FROM ks)"""
    for i in range(_NEWTON_STEPS):
        out += f""",
b{i + 1} AS (
  SELECT k, any_value(b) - (any_value(b) - sum(dx) + sum(d * s1 / s0)) / (1 + sum(d * (s2 / s0 - (s1 / s0) ** 2))) AS b
  FROM (SELECT k, b, sum(e::INT) AS d, sum(CASE WHEN e THEN x ELSE 0 END) AS dx, sum(sum(exp(b * x))) OVER w AS s0,
               sum(sum(x * exp(b * x))) OVER w AS s1, sum(sum(x * x * exp(b * x))) OVER w AS s2
        FROM x_ JOIN b{i} ON fold <> k GROUP BY k, b, t WINDOW w AS (PARTITION BY k ORDER BY t DESC)) GROUP BY k)"""
    return (
        out
        + f""",
base AS (SELECT k, t, sum(d / s0) OVER (PARTITION BY k ORDER BY t) AS hazard FROM (
  SELECT k, t, sum(e::INT) AS d, sum(sum(exp(b * x))) OVER (PARTITION BY k ORDER BY t DESC) AS s0
  FROM x_ JOIN b{_NEWTON_STEPS} ON fold <> k GROUP BY k, t)),
km_ AS (SELECT k, t, product(CASE WHEN n - d > 0 THEN 1 - c / (n - d) ELSE 1 END) OVER (PARTITION BY k ORDER BY t) AS g FROM (
  SELECT k, t, sum(e::INT) AS d, sum((NOT e)::INT) AS c, sum(count(*)) OVER (PARTITION BY k ORDER BY t DESC) AS n
  FROM x_ JOIN ks ON fold <> k GROUP BY k, t)),
ends AS (SELECT k, max(t) FILTER (WHERE fold <> k) AS train_end, max(t) FILTER (WHERE fold = k) AS test_end, count(*) FILTER (WHERE fold <> k) AS n_train,
  count(*) FILTER (WHERE fold = k) AS n_test FROM x_, ks GROUP BY k),
at_ AS (SELECT k, h, coalesce((SELECT min(g) FROM km_ WHERE km_.k = ends.k AND t <= h), 1) AS gh,
  coalesce((SELECT max(hazard) FROM base WHERE base.k = ends.k AND t <= h), 0) AS hazard FROM ends, horizons WHERE h < least(train_end, test_end)),
test AS (SELECT k, t, e, b * x AS risk, (SELECT 1 / arg_max(g, km_.t) FROM km_ WHERE km_.k = b{_NEWTON_STEPS}.k AND km_.t <= x_.t) AS inv FROM x_ JOIN b{_NEWTON_STEPS} ON fold = k),
brier_ AS (SELECT k, h, avg(CASE WHEN t <= h AND e THEN s * s * coalesce(inv, 1) WHEN t > h THEN (1 - s) ** 2 / gh ELSE 0 END) AS v
  FROM (SELECT test.*, h, gh, exp(-hazard * exp(risk)) AS s FROM test JOIN at_ USING (k)) GROUP BY k, h),
auc_ AS (SELECT k, h, sum(w * (below + same / 2)) / (sum(w) * max(n)) AS v FROM (
  SELECT a.k, h, coalesce(a.inv, 1) AS w, count(*) FILTER (WHERE b.t > h AND b.risk < a.risk) AS below,
         count(*) FILTER (WHERE b.t > h AND b.risk = a.risk) AS same, count(*) FILTER (WHERE b.t > h) AS n
  FROM (SELECT *, row_number() OVER () AS r FROM test) a JOIN at_ ON a.k = at_.k AND a.t <= h AND a.e JOIN test b ON a.k = b.k GROUP BY a.r, a.k, h, a.inv)
  GROUP BY k, h),
pairs AS (SELECT a.k, count(*) FILTER (WHERE a.risk > b.risk) + 0.5 * count(*) FILTER (WHERE a.risk = b.risk) AS c, count(*) AS n
  FROM test a JOIN test b ON a.k = b.k AND a.e AND (a.t < b.t OR (a.t = b.t AND NOT b.e)) GROUP BY a.k),
ibs_ AS (SELECT k, sum(area) / (max(h) - min(h)) AS v FROM (SELECT k, h, (lead(h) OVER w - h) * (lead(v) OVER w + v) / 2 AS area FROM brier_ WINDOW w AS (PARTITION BY k ORDER BY h)) GROUP BY k)
SELECT 'CoxPH' AS model, k AS fold, metric, h::INT AS t, round(v, 6) AS value FROM (
  SELECT k, 'c_index' AS metric, NULL AS h, c / n AS v FROM pairs UNION ALL SELECT k, 'ibs', NULL, v FROM ibs_
  UNION ALL SELECT k, 'brier', h, v FROM brier_ UNION ALL SELECT k, 'td_auc', h, v FROM auc_
  UNION ALL SELECT k, 'n_train', NULL, n_train FROM ends UNION ALL SELECT k, 'n_test', NULL, n_test FROM ends)"""
    )


@register("cv_metrics_small", sql("", "scored", "horizons").rstrip() + ",\n" + _cv_sql())
def _cv_metrics_small(spark, sf_dir):
    """Five folds of a Cox model on one feature: every figure, from folds to fitted models to metrics."""
    table = scored(spark, sf_dir).select("customer_id", "duration", "event", (F.col("frequency") / 10).alias("x"))
    return rounded(cross_validate(CoxPH(alpha=1.0), materialise(table, "table"), ["x"], horizons=HORIZONS), 6, "value")


# --- behaviour of the scores --------------------------------------------------------------------


@register(
    "risk_by_outcome",
    sql(
        "SELECT event, round(avg(risk), 8) AS mean_risk, count(*) AS n FROM scored GROUP BY event",
        "scored",
    ),
)
def _risk_by_outcome(spark, sf_dir):
    return rounded(risk_by_outcome(scored(spark, sf_dir)), 8, "mean_risk")


@register(
    "spearman_risk",
    sql(
        """SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho
           FROM (SELECT rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0 AS rx,
                        rank() OVER (ORDER BY duration)
                          + (count(*) OVER (PARTITION BY duration) - 1) / 2.0 AS ry
                 FROM scored WHERE event)""",
        "scored",
    ),
)
def _spearman(spark, sf_dir):
    churned = materialise(scored(spark, sf_dir).filter("event"), "churned")
    return rounded(spearman(churned, "risk", "duration"), 8, "rho")


@register(
    "quartile_direction",
    sql(
        """SELECT q25, q75, round(avg(risk) FILTER (WHERE recency_days <= q25), 8) AS mean_low,
                  round(avg(risk) FILTER (WHERE recency_days >= q75), 8) AS mean_high
           FROM scored, (SELECT quantile_cont(recency_days, 0.25) AS q25,
                                quantile_cont(recency_days, 0.75) AS q75 FROM scored)
           GROUP BY q25, q75""",
        "scored",
    ),
)
def _quartile_direction(spark, sf_dir):
    return rounded(
        quartile_means(scored_table(spark, sf_dir), "recency_days", "risk"), 8, "mean_low", "mean_high"
    )


@register(
    "median_by_risk_quartile",
    sql("", "scored", "baseline").rstrip()
    + f""",
m AS ({_MEDIANS_SQL}), f AS (SELECT * FROM m WHERE isfinite(median_days)),
q AS (SELECT quantile_cont(risk, 0.25) AS q25, quantile_cont(risk, 0.75) AS q75 FROM f)
SELECT round(q25, 8) AS q25, round(q75, 8) AS q75,
       round(avg(median_days) FILTER (WHERE risk <= q25), 6) AS mean_low,
       round(avg(median_days) FILTER (WHERE risk >= q75), 6) AS mean_high
FROM f, q GROUP BY 1, 2""",
)
def _median_by_quartile(spark, sf_dir):
    table = scored_table(spark, sf_dir)
    medians = materialise(
        fixed_model(table).median(table.select(*RISK_FEATURES)).select("risk", "median_days"),
        "medians",
    )
    out = median_by_risk_quartile(medians)
    return rounded(rounded(out, 8, "q25", "q75"), 6, "mean_low", "mean_high")


@register(
    "curve_sanity",
    sql(
        f"""SELECT count(*) AS n_breaks FROM (
              SELECT surv, lag(surv) OVER (PARTITION BY customer_id ORDER BY t) AS before
              FROM (SELECT customer_id, h AS t, {_SURV} AS surv
                    FROM scored, (SELECT h, coalesce(max(hazard) FILTER (WHERE t <= h), 0) AS hazard
                                  FROM horizons, baseline GROUP BY h)))
            WHERE surv > before + 1e-9 OR surv NOT BETWEEN 0 AND 1""",
        "baseline",
        "horizons",
    ),
)
def _curve_sanity(spark, sf_dir):
    table = scored_table(spark, sf_dir)
    curves = fixed_model(table).survival(table.select("customer_id", *RISK_FEATURES), HORIZONS)
    return curve_breaks(curves).agg(F.count(F.lit(1)).alias("n_breaks"))


@register(
    "score_invariance",
    sql("", "scored", "baseline").rstrip()
    + f""",
m AS (SELECT customer_id, risk, median_days FROM ({_MEDIANS_SQL})), other AS (SELECT * FROM m ORDER BY md5(customer_id))
SELECT count(*) AS n_changed FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM other)""",
)
def _score_invariance(spark, sf_dir):
    """Scores of the same rows laid out differently; none may change."""
    table = scored_table(spark, sf_dir).select("customer_id", *RISK_FEATURES)
    model = fixed_model(scored_table(spark, sf_dir))
    shuffled = table.repartition(7, F.xxhash64("customer_id", F.lit(1)))
    return changed_scores(
        model.median(table), model.median(shuffled), ["customer_id", "risk", "median_days"]
    ).agg(F.count(F.lit(1)).alias("n_changed"))


@register(
    "batch_score",
    sql("", "scored", "baseline").rstrip()
    + f""",
at_ AS (SELECT {", ".join(f"coalesce(max(hazard) FILTER (WHERE t <= {h}), 0) AS h{h}" for h in HORIZONS)} FROM baseline)
SELECT customer_id, round(risk, 9) AS risk_score, {_MEDIAN} AS median_survival_days,
       {", ".join(f"round(exp(-h{h} * exp(risk)), 8) AS s_{h}" for h in HORIZONS)},
       'fixed-1' AS model_version
FROM scored, at_""",
)
def _batch_score(spark, sf_dir):
    """Whole-table scoring from a map of named features."""
    table = scored_table(spark, sf_dir)
    named = F.create_map(*[x for f in RISK_FEATURES for x in (F.lit(f), F.col(f))])
    asked = table.select("customer_id", named.alias("features"))
    scores, _ = score(asked, fixed_model(table), HORIZONS, features_map="features")
    probability = F.col("survival_curve.probabilities")
    return scores.select(
        "customer_id",
        F.round("risk_score", 9).alias("risk_score"),
        "median_survival_days",
        *[F.round(probability[i], 8).alias(f"s_{h}") for i, h in enumerate(HORIZONS)],
        "model_version",
    )
