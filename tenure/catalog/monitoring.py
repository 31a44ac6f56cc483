"""Drift of later against earlier lines and orders, reports and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenure.catalog import register
from tenure.catalog.views import rounded
from tenure.operators.drift import (
    alert_digest,
    binned_scores,
    chi_square_scores,
    dataset_drift,
    drift_alerts,
    drift_report,
    epps_singleton,
    ordered_scores,
)
from tenure.sources import retail

CUT = "1998-06-01"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "shifted"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "price_band"]

# `shifted` and `price_band` move with the side, so that drift is there to be found.
_SIDE_SQL = """
    SELECT l_shipdate >= TIMESTAMP '{cut}' AS cur, l_quantity, l_extendedprice, l_discount, l_tax,
           l_extendedprice * (CASE WHEN l_shipdate >= TIMESTAMP '{cut}' THEN 1.3::DOUBLE ELSE 1::DOUBLE END)
               AS shifted, l_returnflag, l_linestatus,
           CASE WHEN l_extendedprice * (CASE WHEN l_shipdate >= TIMESTAMP '{cut}' THEN 1.3::DOUBLE
                                             ELSE 1::DOUBLE END) < 60000 THEN 'low' ELSE 'high' END
               AS price_band
    FROM lineitem""".format(cut=CUT)


def sides(spark, sf_dir):
    """(reference, current): lines shipped before and from the cut on."""
    lines = retail.table(spark, sf_dir, "lineitem")
    late = F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz")

    def side(condition, factor: float):
        shifted = F.col("l_extendedprice") * F.lit(factor)
        return lines.filter(condition).select(
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            shifted.alias("shifted"),
            "l_returnflag",
            "l_linestatus",
            F.when(shifted < 60000, "low").otherwise("high").alias("price_band"),
        )

    return side(~late, 1.0), side(late, 1.3)


_LONG_SQL = (
    f"side AS ({_SIDE_SQL}),\nlong AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, cur, {c} AS x FROM side" for c in NUMERIC)
    + ")"
)

_CDF_SQL = """sizes AS (SELECT col, count(*) FILTER (WHERE NOT cur)::DOUBLE AS n_ref,
                  count(*) FILTER (WHERE cur)::DOUBLE AS n_cur,
                  stddev_pop(x) FILTER (WHERE NOT cur) AS sd FROM long GROUP BY col),
cdf AS (SELECT col, x, lead(x) OVER w AS nx,
               sum(r) OVER w / n_ref - sum(c) OVER w / n_cur AS gap, n_ref, n_cur, sd
        FROM (SELECT col, x, count(*) FILTER (WHERE NOT cur) AS r, count(*) FILTER (WHERE cur) AS c
              FROM long GROUP BY col, x) JOIN sizes USING (col)
        WINDOW w AS (PARTITION BY col ORDER BY x)),
ordered AS (SELECT col, max(abs(gap)) AS d, sum(abs(gap) * (nx - x)) AS area,
                   sum(gap * gap * (nx - x)) AS square, any_value(n_ref) AS n_ref,
                   any_value(n_cur) AS n_cur, any_value(sd) AS sd FROM cdf GROUP BY col),
ks AS (SELECT col, d, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(
                 list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
                                                   * exp(-2 * k * k * lam * lam))))) END AS p
       FROM (SELECT col, d, sqrt(n_ref * n_cur / (n_ref + n_cur)) * d AS lam FROM ordered))"""

_BINS_SQL = """facts AS (SELECT col, min(x) AS lo, max(x) AS hi, count(*) AS n, count(DISTINCT x) AS k
                 FROM long GROUP BY col),
num_bins AS (SELECT col, cur, CASE WHEN k <= 20 THEN x::VARCHAR
                    ELSE least(floor((x - lo) / ((hi - lo) / (ceil(log2(n)) + 1))), ceil(log2(n)))::VARCHAR
                    END AS bin
             FROM long JOIN facts USING (col)),
all_bins AS (SELECT * FROM num_bins UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', cur, {c} FROM side" for c in CATEGORICAL
) + """),
shares AS (SELECT col, CASE WHEN r > 0 THEN r / sum(r) OVER w ELSE 1e-4 END AS r,
                  CASE WHEN c > 0 THEN c / sum(c) OVER w ELSE 1e-4 END AS c
           FROM (SELECT col, bin, count(*) FILTER (WHERE NOT cur)::DOUBLE AS r,
                        count(*) FILTER (WHERE cur)::DOUBLE AS c FROM all_bins GROUP BY col, bin)
           WINDOW w AS (PARTITION BY col)),
divergence AS (SELECT col, sum((c - r) * ln(c / r)) AS psi, sum(r * ln(r / c)) AS kl_div,
                      sqrt(greatest(0, sum(0.5 * r * ln(r / ((r + c) / 2)) + 0.5 * c * ln(c / ((r + c) / 2)))))
                          AS jensenshannon,
                      sqrt(0.5 * sum((sqrt(r) - sqrt(c)) * (sqrt(r) - sqrt(c)))) AS hellinger
               FROM shares GROUP BY col)"""

_CHI_SQL = """cat AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, cur, {c} AS v FROM side" for c in CATEGORICAL
) + """),
chi AS (SELECT col, sum((c - e) * (c - e) / e) AS statistic, (count(*) - 1)::DOUBLE AS df
        FROM (SELECT col, c, r * sum(c) OVER w / sum(r) OVER w AS e
              FROM (SELECT col, v, count(*) FILTER (WHERE NOT cur)::DOUBLE AS r,
                           count(*) FILTER (WHERE cur)::DOUBLE AS c FROM cat GROUP BY col, v)
              WINDOW w AS (PARTITION BY col)) GROUP BY col)"""


# Two categories: the complementary error function by Simpson's rule; three: a closed form.
_CHI_P = """CASE df WHEN 2 THEN exp(-statistic / 2) WHEN 1 THEN CASE WHEN statistic > 80 THEN 0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(4001),
  lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(sqrt(statistic / 2) + i * 0.002, 2)) * 0.002 / 3)) END END"""


def _with(*steps: str) -> str:
    return "WITH " + ",\n".join((_LONG_SQL, *steps)) + "\n"


@register(
    "drift_ks",
    _with(_CDF_SQL)
    + 'SELECT col AS "column", round(d, 9) AS ks_distance, round(p, 8) AS ks_p FROM ks',
)
def _ks(spark, sf_dir):
    out = ordered_scores(*sides(spark, sf_dir), NUMERIC).select("column", "ks_distance", "ks_p")
    return rounded(rounded(out, 9, "ks_distance"), 8, "ks_p")


@register(
    "drift_wasserstein",
    _with(_CDF_SQL)
    + 'SELECT col AS "column", round(area / greatest(sd, 0.001), 8) AS wasserstein FROM ordered',
)
def _wasserstein(spark, sf_dir):
    out = ordered_scores(*sides(spark, sf_dir), NUMERIC).select("column", "wasserstein")
    return rounded(out, 8, "wasserstein")


@register(
    "drift_energy",
    _with(_CDF_SQL) + 'SELECT col AS "column", round(sqrt(2 * square), 8) AS energy FROM ordered',
)
def _energy(spark, sf_dir):
    out = ordered_scores(*sides(spark, sf_dir), NUMERIC).select("column", "energy")
    return rounded(out, 8, "energy")


def _register_binned(key: str, method: str) -> None:
    @register(
        key,
        _with(_BINS_SQL) + f'SELECT col AS "column", round({method}, 8) AS {method} FROM divergence',
    )
    def _binned(spark, sf_dir):
        out = binned_scores(*sides(spark, sf_dir), NUMERIC, CATEGORICAL)
        return rounded(out.select("column", method), 8, method)


for _key, _method in {
    "drift_psi": "psi",
    "drift_kl": "kl_div",
    "drift_js": "jensenshannon",
    "drift_hellinger": "hellinger",
}.items():
    _register_binned(_key, _method)


@register(
    "drift_chi2",
    _with(_CHI_SQL) + f'SELECT col AS "column", round(statistic, 6) AS statistic, df, round({_CHI_P}, 8) AS chi2_p FROM chi',
)
def _chi2(spark, sf_dir):
    out = chi_square_scores(*sides(spark, sf_dir), CATEGORICAL)
    return rounded(rounded(out, 6, "statistic"), 8, "chi2_p")


def _epps_sql() -> str:
    """The statistic by elimination of a symmetric 4 x 4 system, unrolled; its p-value has a closed form at 4 degrees of freedom."""
    k = range(4)
    waves = [f"{f}({t} / sigma * x)" for f in ("cos", "sin") for t in (0.4, 0.8)]
    wave = ", ".join(f"{w} AS w{i}" for i, w in enumerate(waves))
    part = lambda i, j, side: f"covar_pop(w{i}, w{j}) FILTER (WHERE {side}cur)"
    cells = [
        f"n / n_ref * {part(i, j, 'NOT ')} + n / n_cur * {part(i, j, '')} AS s{i}{j}".replace("n / n_ref", "any_value(n / n_ref)").replace("n / n_cur", "any_value(n / n_cur)")
        for i in k for j in range(i, 4)
    ]
    gaps = [f"avg(w{i}) FILTER (WHERE NOT cur) - avg(w{i}) FILTER (WHERE cur) AS g{i}" for i in k]
    steps = f"""counts AS (SELECT col, count(*)::DOUBLE AS n, count(*) FILTER (WHERE NOT cur)::DOUBLE AS n_ref, count(*) FILTER (WHERE cur)::DOUBLE AS n_cur,
  (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 2 AS sigma FROM long GROUP BY col),
waves AS (SELECT col, cur, n, n_ref, n_cur, {wave} FROM long JOIN counts USING (col)),
e0 AS (SELECT col, any_value(n) AS n, {", ".join(cells + gaps)} FROM waves GROUP BY col)"""
    for p in range(3):
        kept = [f"s{i}{j}" for i in range(p + 1) for j in range(i, 4)] + [f"g{i}" for i in range(p + 1)]
        moved = [f"s{i}{j} - s{p}{i} / s{p}{p} * s{p}{j} AS s{i}{j}" for i in range(p + 1, 4) for j in range(i, 4)]
        moved += [f"g{i} - s{p}{i} / s{p}{p} * g{p} AS g{i}" for i in range(p + 1, 4)]
        steps += f",\ne{p + 1} AS (SELECT col, n, {', '.join(kept + moved)} FROM e{p})"
    total = " + ".join(f"g{i} * g{i} / s{i}{i}" for i in k)
    return steps + f",\nepps AS (SELECT col, n * ({total}) AS x FROM e3)"


@register(
    "drift_epps_singleton",
    _with(_epps_sql()) + 'SELECT col AS "column", round(x, 4) AS statistic, round(exp(-x / 2) * (1 + x / 2), 8) AS es_p FROM epps',
)
def _epps(spark, sf_dir):
    return rounded(rounded(epps_singleton(*sides(spark, sf_dir), NUMERIC), 4, "statistic"), 8, "es_p")


_REPORT_SQL = (
    _with(_BINS_SQL)
    + """SELECT col AS "column", 'psi' AS method, psi AS score,
         CASE WHEN col = 'l_tax' THEN 0.25 ELSE 0.01 END::DOUBLE AS threshold,
         psi > CASE WHEN col = 'l_tax' THEN 0.25 ELSE 0.01 END AS drifted FROM divergence"""
)
# A low threshold, so that both severities occur in the report.
THRESHOLDS = {c: 0.01 for c in NUMERIC + CATEGORICAL} | {"l_tax": 0.25}
CRITICAL = 0.2


def _psi_report(spark, sf_dir):
    return drift_report(
        *sides(spark, sf_dir), num_method="psi", cat_method="psi", thresholds=THRESHOLDS
    )


@register(
    "drift_report",
    f'SELECT "column", method, round(score, 8) AS score, threshold, drifted FROM ({_REPORT_SQL})',
)
def _report(spark, sf_dir):
    return rounded(_psi_report(spark, sf_dir), 8, "score")


@register(
    "drift_report_ks",
    _with(_CDF_SQL)
    + """SELECT col AS "column", 'ks' AS method, round(p, 8) AS score, 0.05::DOUBLE AS threshold,
         p < 0.05 AS drifted FROM ks""",
)
def _report_ks(spark, sf_dir):
    return rounded(drift_report(*sides(spark, sf_dir), columns=NUMERIC), 8, "score")


@register(
    "drift_report_default",
    _with(_CDF_SQL, _CHI_SQL)
    + f"""SELECT "column", method, round(score, 8) AS score, 0.05::DOUBLE AS threshold, score < 0.05 AS drifted FROM (
           SELECT col AS "column", 'ks' AS method, p AS score FROM ks UNION ALL SELECT col, 'chi2', {_CHI_P} FROM chi)""",
)
def _report_default(spark, sf_dir):
    """KS for numbers and chi-square for categories, default thresholds."""
    return rounded(drift_report(*sides(spark, sf_dir)), 8, "score")


@register(
    "dataset_drift",
    f"""SELECT *, format('[{{}}] {{}}/{{}} features drifted ({{:.1f}}%)',
                         CASE WHEN dataset_drift THEN 'DRIFTED' ELSE 'STABLE' END,
                         n_drifted, n_features, share * 100) AS summary
        FROM (SELECT *, share >= 0.25 AS dataset_drift
              FROM (SELECT count(*) AS n_features, count(*) FILTER (WHERE drifted) AS n_drifted,
                           count(*) FILTER (WHERE drifted) / count(*) AS share
                    FROM ({_REPORT_SQL})))""",
)
def _dataset_drift(spark, sf_dir):
    return dataset_drift(_psi_report(spark, sf_dir), drift_share=0.25)


_ALERTS_SQL = f"""
    SELECT "column" AS feature, score AS drift_score, threshold, method,
           CASE WHEN score >= {CRITICAL} THEN 'critical' ELSE 'warning' END AS severity,
           format('{{}}: {{}}={{:.4f}} (threshold={{}})', "column", method, score, threshold) AS message
    FROM ({_REPORT_SQL}) WHERE drifted"""


@register(
    "drift_alerts",
    f"""SELECT feature, round(drift_score, 8) AS drift_score, threshold, method, severity, message
        FROM ({_ALERTS_SQL})""",
)
def _alerts(spark, sf_dir):
    return rounded(drift_alerts(_psi_report(spark, sf_dir), CRITICAL), 8, "drift_score")


@register(
    "alert_digest",
    f"""SELECT count(*) AS n_alerts, count(*) FILTER (WHERE severity = 'critical') AS n_critical,
               count(*) FILTER (WHERE severity <> 'critical') AS n_warning,
               CASE WHEN count(*) = 0 THEN 'No drift alerts.' ELSE
                 format('Drift alerts: {{}} total ({{}} critical, {{}} warning)', count(*),
                        count(*) FILTER (WHERE severity = 'critical'),
                        count(*) FILTER (WHERE severity <> 'critical'))
                 || chr(10) || string_agg('  [' || upper(severity) || '] ' || message, chr(10)
                       ORDER BY (severity <> 'critical')::INT, feature) END AS digest
        FROM ({_ALERTS_SQL})""",
)
def _digest(spark, sf_dir):
    return alert_digest(drift_alerts(_psi_report(spark, sf_dir), CRITICAL))
