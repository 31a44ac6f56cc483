from __future__ import annotations

import math
import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators import boosted, survival, training
from tenure.operators import evaluate as evaluation
from tenure.operators.behaviour import changed_scores, curve_breaks, quartile_means, risk_by_outcome, spearman
from tenure.operators.boosted import BoostedCox, BoostedModel
from tenure.operators.evaluate import (
    aggregate_folds,
    brier,
    c_index,
    censoring_km,
    censoring_km_by_fold,
    evaluate,
    evaluate_folds,
    integrated_brier,
    metric_lines,
    results_table,
    stratified_folds,
    td_auc,
    with_censoring_weight,
)
from tenure.operators.scoring import counted, score
from tenure.operators.survival import CoxModel, CoxPH, partial_log_likelihood, tie_terms
from tenure.operators.training import RunLog, cross_validate, train_final
from tenure.plans.pairs import pairs_below
from tenure.plans.timeline import NO_GROUP, PART_ROWS, Part, Timeline

FEATURES = ["f1", "f2", "f3"]


def newton(pdf, alpha, ties):
    """Dense Newton iterations on the driver, straight from the definition."""
    x = pdf[FEATURES].to_numpy()
    t, e = pdf.duration.to_numpy(), pdf.event.to_numpy()
    beta = np.zeros(len(FEATURES))
    for _ in range(30):
        g, h = alpha * beta, alpha * np.eye(len(FEATURES))
        w = np.exp(x @ beta)
        for tk in np.unique(t[e]):
            risk, dead = t >= tk, (t == tk) & e
            d = dead.sum()
            for m in range(d):
                f = m / d if ties == "efron" else 0.0
                s0 = w[risk].sum() - f * w[dead].sum()
                s1 = w[risk] @ x[risk] - f * (w[dead] @ x[dead])
                s2 = (x[risk].T * w[risk]) @ x[risk] - f * (x[dead].T * w[dead]) @ x[dead]
                g = g + s1 / s0
                h = h + s2 / s0 - np.outer(s1, s1) / s0**2
            g = g - x[dead].sum(axis=0)
        beta = beta - np.linalg.solve(h, g)
    return beta


@pytest.fixture(scope="module")
def cox(cohort):
    return CoxPH(alpha=1.0).fit(cohort, FEATURES)


@pytest.mark.parametrize("ties", ["breslow", "efron"])
@pytest.mark.parametrize("part_rows", [PART_ROWS, 90, 7])
def test_fit_matches_dense_newton(cohort, cohort_pdf, ties, part_rows):
    """One part, a few parts, and so many that one time fills several."""
    model = CoxPH(alpha=1.0, ties=ties, part_rows=part_rows).fit(cohort, FEATURES)
    np.testing.assert_allclose(model.coef, newton(cohort_pdf, 1.0, ties), atol=1e-7)
    assert model.gradient_norm < 1e-6
    assert_baseline(model, cohort_pdf)


def assert_baseline(model, pdf):
    w = np.exp(pdf[FEATURES].to_numpy() @ np.array(model.coef))
    hazard, want = 0.0, {}
    for t in sorted(pdf.duration.unique()):
        hazard += ((pdf.duration == t) & pdf.event).sum() / w[(pdf.duration >= t).to_numpy()].sum()
        want[t] = hazard
    got = [(r["t"], r["hazard"]) for r in model.baseline.collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


@pytest.mark.parametrize("part_rows", [PART_ROWS, 31])
@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_folds_are_fitted_together(spark, cohort_pdf, part_rows, ties):
    """Each fold's model is the one fitted on the other folds alone; a time of one fold only is in no other baseline."""
    pdf = cohort_pdf.assign(fold=[i % 3 for i in range(len(cohort_pdf))])
    pdf.loc[0, ["duration", "event", "fold"]] = [77.0, True, 0]
    models = CoxPH(alpha=0.5, ties=ties, part_rows=part_rows).fit_folds(spark.createDataFrame(pdf).repartition(4), FEATURES, 3)
    for k, model in enumerate(models):
        rest = pdf[pdf.fold != k]
        np.testing.assert_allclose(model.coef, newton(rest, 0.5, ties), atol=1e-6)
        assert_baseline(model, rest)


def test_continuous_times_over_many_parts(spark, cohort_pdf):
    rng = np.random.default_rng(5)
    pdf = cohort_pdf.assign(duration=rng.exponential(30, len(cohort_pdf)))
    model = CoxPH(alpha=1.0, part_rows=11).fit(spark.createDataFrame(pdf), FEATURES)
    np.testing.assert_allclose(model.coef, newton(pdf, 1.0, "breslow"), atol=1e-7)
    assert_baseline(model, pdf)


def test_fit_without_penalty(spark, cohort, cohort_pdf):
    model = CoxPH(alpha=0.0).fit(cohort, FEATURES)
    np.testing.assert_allclose(model.coef, newton(cohort_pdf, 0.0, "breslow"), atol=1e-6)
    # a full set of dummies and a constant: the likelihood is flat along their sum
    pdf = cohort_pdf.assign(d0=(cohort_pdf.f3 == 0) * 1.0, d1=(cohort_pdf.f3 == 1) * 1.0, d2=(cohort_pdf.f3 == 2) * 1.0, one=1.0)
    flat = CoxPH(alpha=0.0).fit(spark.createDataFrame(pdf), ["f1", "d0", "d1", "d2", "one"])
    less = CoxPH(alpha=0.0).fit(spark.createDataFrame(pdf), ["f1", "d1", "d2"])
    assert flat.coef[4] == 0 and flat.coef[0] == pytest.approx(less.coef[0], abs=1e-6)
    assert [flat.coef[2] - flat.coef[1], flat.coef[3] - flat.coef[1]] == pytest.approx(less.coef[1:], abs=1e-6)
    assert flat.loss == pytest.approx(less.loss)


@pytest.mark.parametrize("rows,times", [(20_000, 300), (9_000, 9_000), (20_000, 1)])
def test_a_part_is_summed_up_without_a_second_matrix(rows, times):
    rng = np.random.default_rng(5)
    p, t = 24, np.sort(rng.integers(0, times, rows) if times < rows else np.arange(rows))[::-1].astype(float)
    x, e = rng.normal(size=(rows, p)), (rng.random(rows) < 0.4).astype(np.int8)
    part = Part(0, t, e, np.full(rows, NO_GROUP), x, np.arange(rows), np.zeros(rows), np.flatnonzero(np.append(True, t[1:] != t[:-1])))
    problem = survival._CoxProblem(None, None, CoxPH(ties="efron"), [f"x{i}" for i in range(p)], 1, *[np.zeros(1)] * 4)
    beta = rng.normal(size=p) / 10
    tracemalloc.start()
    cells, w, died = problem._cells()(part, 0, beta)
    peak = tracemalloc.get_traced_memory()[1] - cells.nbytes
    tracemalloc.stop()
    assert peak < x.nbytes / 2 or times == rows
    each = np.column_stack([died, w, x * w[:, None], died * w, x * (died * w)[:, None]])
    want = np.array([each[t == v].sum(axis=0) for v in t[part.start]])
    assert np.allclose(cells, want) and np.allclose(part.squares(w), x.T @ (x * w[:, None]))


def test_fit_names_what_has_no_finite_coefficient(spark):
    rows = [(float(i), True, float(10 - i), float(i % 2)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "duration double, event boolean, early double, odd double")
    with pytest.raises(ValueError, match="monotone likelihood.*early"):
        CoxPH(alpha=0.0).fit(df, ["early", "odd"])
    with pytest.raises(ValueError, match="alpha"):
        CoxPH(alpha=-1.0).fit(df, ["odd"])
    with pytest.raises(ValueError, match="no event"):
        CoxPH().fit(df.withColumn("event", F.lit(False)), ["odd"])


def test_curves_at_all_training_times(spark):
    times = [(i / 7, i * 0.001) for i in range(1, 10_001)]
    model = CoxModel(name="m", features=["x"], baseline=spark.createDataFrame(times, "t double, hazard double"), coef=[1.0])
    rows = spark.createDataFrame([(i, i / 1000) for i in range(300)], "id int, x double")
    curves = model.survival(rows)
    out = curves.groupBy("id").agg(F.count("t").alias("n"), F.sum("surv").alias("s")).collect()
    hazard = np.array([h for _, h in times])
    assert len(out) == 300 and {r["n"] for r in out} == {10_000}
    for r in out[:5]:
        assert r["s"] == pytest.approx(np.exp(-hazard * math.exp(r["id"] / 1000)).sum())
    t = np.array([t for t, _ in times])
    for r in model.restricted_mean(rows).collect()[:5]:
        s = np.exp(-hazard * math.exp(r["x"]))
        assert r["mean_days"] == pytest.approx(t[0] + (s[:-1] * np.diff(t)).sum())
        assert (r["n_times"], r["horizon_days"]) == (10_000, t[-1])
    assert model.hazard_at([0, 1 / 7, 5000 / 7 + 0.01, 1e9]) == pytest.approx([0, 0.001, 5.0, 10.0])


@pytest.mark.parametrize("limit", [50_000, 100])
def test_area_below_a_curve_holds_no_table_in_one_task(spark, monkeypatch, limit):
    monkeypatch.setattr(survival, "ONE_WINDOW_LIMIT", limit, raising=False)
    times = [(i / 7, i * 0.001) for i in range(1, 5_001)]
    model = CoxModel(name="m", features=["x"], baseline=spark.createDataFrame(times, "t double, hazard double"), coef=[1.0])
    values = [None, math.nan, *(i / 100 for i in range(200))]
    means = model.restricted_mean(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id int, x double").coalesce(1))
    plan = means._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" in plan and "BroadcastNestedLoopJoin BuildLeft" not in plan
    t, hazard = np.array(times).T
    got = {r["id"]: r for r in means.collect()}
    assert len(got) == len(values) and means.columns == ["id", "x", "risk", "n_times", "horizon_days", "mean_days"]
    assert dict(means.dtypes)["n_times"] == "bigint" and got[0]["mean_days"] is None and math.isnan(got[1]["mean_days"])
    for r in (got[2], got[77], got[201]):
        s = np.exp(-hazard * math.exp(r["x"]))
        assert r["mean_days"] == pytest.approx(t[0] + (s[:-1] * np.diff(t)).sum())
        assert (r["n_times"], r["horizon_days"]) == (5_000, t[-1])


@pytest.mark.parametrize("limit", [50_000, 100])
def test_rows_of_one_file_meet_a_whole_curve_in_many_tasks(spark, monkeypatch, limit):
    monkeypatch.setattr(survival, "ONE_WINDOW_LIMIT", limit, raising=False)
    times = [(i / 7, i * 0.001) for i in range(1, 5_001)]
    model = CoxModel(name="m", features=["x"], baseline=spark.createDataFrame(times, "t double, hazard double"), coef=[1.0])
    curves = model.survival(spark.createDataFrame([(i, i / 100) for i in range(40)], "id int, x double").coalesce(1))
    assert curves.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    got = curves.groupBy("id", "x").agg(F.count("t").alias("n"), F.sum("surv").alias("s"), F.max("t").alias("end")).collect()
    hazard = np.array([h for _, h in times])
    assert len(got) == 40 and {(r["n"], r["end"]) for r in got} == {(5_000, times[-1][0])}
    for r in got[:5]:
        assert r["s"] == pytest.approx(np.exp(-hazard * math.exp(r["x"])).sum())


def test_closed_form_tie_terms(monkeypatch):
    d = np.array([600.0, 600.0, 0.0])
    s0, e0 = np.array([1000.0, 650.0, 5.0]), np.array([600.0, 650.0, 0.0])
    closed = tie_terms(d, s0, e0)
    monkeypatch.setattr(survival, "DIRECT_TIES", 10_000)
    direct = tie_terms(d, s0, e0)
    for k in closed:
        np.testing.assert_allclose(closed[k], direct[k], rtol=1e-8)


def test_baseline_loss_and_curves(cohort, cohort_pdf, cox):
    pdf = cohort_pdf.assign(r=cohort_pdf[FEATURES].to_numpy() @ np.array(cox.coef))
    hazard = {}
    total = loglik = 0.0
    for tk in sorted(pdf.duration.unique()):
        s0 = np.exp(pdf.r[pdf.duration >= tk]).sum()
        dead = pdf[(pdf.duration == tk) & pdf.event]
        total += len(dead) / s0
        loglik += dead.r.sum() - len(dead) * math.log(s0)
        hazard[tk] = total
    got = {r["t"]: r["hazard"] for r in cox.baseline.collect()}
    assert got.keys() == hazard.keys()
    for t in got:
        assert got[t] == pytest.approx(hazard[t])
    scored = cox.risk(cohort)
    assert partial_log_likelihood(scored).first()["log_likelihood"] == pytest.approx(loglik)

    curves = cox.survival(cohort.select("customer_id", *FEATURES), [5, 10, 20, 30])
    assert curves.count() == 4 * len(pdf)
    assert curve_breaks(curves).count() == 0
    assert curve_breaks(cox.survival(cohort.select("customer_id", *FEATURES))).count() == 0
    medians = {r["customer_id"]: r["median_days"] for r in cox.median(cohort).collect()}
    times = np.array(sorted(hazard))
    steps = np.array([hazard[t] for t in times])
    for r in pdf.itertuples():
        below = times[np.exp(-steps * math.exp(r.r)) <= 0.5]
        assert medians[r.customer_id] == (below[0] if len(below) else math.inf)


def test_save_and_load(spark, cohort, cox, tmp_path):
    cox.save(str(tmp_path / "m"))
    again = CoxModel.load(spark, str(tmp_path / "m"))
    assert again.coef == cox.coef and again.params == cox.params
    assert changed_scores(cox.median(cohort), again.median(cohort), ["customer_id", "risk", "median_days"]).count() == 0


# --- metrics ------------------------------------------------------------------------------------


def concordance(pdf):
    conc = tied = comp = 0
    t, e, r = pdf.duration.to_numpy(), pdf.event.to_numpy(), pdf.risk.to_numpy()
    for i in np.flatnonzero(e):
        later = (t > t[i]) | ((t == t[i]) & ~e)
        comp += later.sum()
        conc += (later & (r < r[i])).sum()
        tied += (later & (r == r[i])).sum()
    return conc, tied, comp


@pytest.mark.parametrize("part_rows,buckets", [(PART_ROWS, 1024), (50, 1024), (7, 3)])
def test_c_index_is_exact(cohort, cohort_pdf, part_rows, buckets):
    row = c_index(cohort, part_rows=part_rows, buckets=buckets).first()
    conc, tied, comp = concordance(cohort_pdf)
    assert (row["concordant"], row["tied"], row["comparable"]) == (conc, tied, comp)
    assert row["c_index"] == pytest.approx((conc + tied / 2) / comp)


@pytest.mark.parametrize("part_rows", [PART_ROWS, 40])
def test_c_index_of_groups(spark, cohort_pdf, part_rows):
    pdf = cohort_pdf.assign(fold=[i % 3 for i in range(len(cohort_pdf))])
    rows = c_index(spark.createDataFrame(pdf), by="fold", part_rows=part_rows, buckets=4).collect()
    assert {r["fold"]: (r["concordant"], r["tied"], r["comparable"]) for r in rows} == {k: concordance(pdf[pdf.fold == k]) for k in range(3)}


def test_c_index_of_nothing(spark, cohort):
    assert c_index(cohort.limit(0)).first()["c_index"] is None
    odd = spark.createDataFrame([(None, 1.0, True), (2.0, None, True), (3.0, 1.0, True), (4.0, 1.0, None)], "duration double, risk double, event boolean")
    assert tuple(c_index(odd).first()) == (0.0, 1.0, 1.0, 0.5)


def test_sums_beyond_64_bits():
    below, same = pairs_below(np.arange(3), np.array([1.0, 2.0, 2.0]), np.full(3, 2**31), np.full(3, 2**31))
    assert (below, same) == (2 * 2**62, 2**62)


def test_c_index_of_one_hot_risk(spark):
    df = spark.createDataFrame([(1.0, float(i), i % 2 == 0) for i in range(50)], "risk double, duration double, event boolean")
    assert c_index(df).first()["c_index"] == 0.5


def km(pdf):
    g, out = 1.0, {}
    for t in sorted(pdf.duration.unique()):
        at = (pdf.duration >= t).sum() - ((pdf.duration == t) & pdf.event).sum()
        c = ((pdf.duration == t) & ~pdf.event).sum()
        g *= 1 - c / at if at else 1.0
        out[t] = g
    return out


def test_ipcw_metrics(cohort, cohort_pdf):
    g = km(cohort_pdf)
    table = censoring_km(cohort)
    got = {r["t"]: r["g"] for r in table.collect()}
    assert got == pytest.approx(g)
    times = [5, 15, 25]
    base = [0.1, 0.3, 0.6]
    pdf = cohort_pdf
    weighted = with_censoring_weight(cohort.select("risk", "duration", "event"), table)
    want_brier, want_auc = {}, {}
    gi = pdf.duration.map(g).to_numpy()
    for h, b in zip(times, base):
        s = np.exp(-b * np.exp(pdf.risk.to_numpy()))
        gh = min(v for t, v in g.items() if t <= h)
        died = ((pdf.duration <= h) & pdf.event).to_numpy()
        alive = (pdf.duration > h).to_numpy()
        inv = np.where(gi > 0, 1 / np.where(gi > 0, gi, 1), 0)
        want_brier[h] = np.mean(died * s**2 * inv + alive * (1 - s) ** 2 / gh)
        r = pdf.risk.to_numpy()
        below = (r[alive][None, :] < r[died][:, None]).sum(1) + 0.5 * (r[alive][None, :] == r[died][:, None]).sum(1)
        want_auc[h] = (inv[died] * below).sum() / (inv[died].sum() * alive.sum())
    scores = brier(weighted, table, base, times)
    assert {r["t"]: r["brier"] for r in scores.collect()} == pytest.approx(want_brier)
    area = sum((b - a) * (want_brier[a] + want_brier[b]) / 2 for a, b in zip(times, times[1:]))
    assert integrated_brier(scores).first()["ibs"] == pytest.approx(area / 20)
    for limit in (50_000, 10):
        auc = {r["t"]: r["auc"] for r in td_auc(weighted, times, limit=limit).collect()}
        assert auc == pytest.approx(want_auc)
    assert td_auc(weighted, [0]).first()["auc"] is None


def test_folds_are_balanced_and_stable(cohort):
    a = stratified_folds(cohort, 5)
    sizes = a.groupBy("event", "fold").count().toPandas()
    for _, part in sizes.groupby("event"):
        assert part["count"].max() - part["count"].min() <= 1
    b = stratified_folds(cohort.repartition(7), 5)
    assert changed_scores(a, b, ["customer_id", "fold"]).count() == 0


def test_cross_validation_and_runs(spark, cohort, tmp_path):
    runs = RunLog(spark, str(tmp_path / "runs"))
    out = cross_validate(CoxPH(alpha=0.5), cohort, FEATURES, n_splits=2, horizons=[10, 20, 30, 4000], runs=runs)
    rows = out.toPandas()
    c = rows[rows.metric == "c_index"]["value"]
    assert len(c) == 2 and (c > 0.55).all()
    assert 4000 not in set(rows.t.dropna())
    assert rows[rows.metric.isin(["n_test"])]["value"].sum() == cohort.count()
    agg = {(r["metric"], r["t"]): r for r in aggregate_folds(out).collect()}
    assert agg["c_index", None]["std"] == pytest.approx(np.std(c))
    logged = runs.runs().toPandas()
    assert len(logged) == 3 and logged.parent_run_id.isna().sum() == 1
    logged_metrics = runs.logged_metrics().toPandas()
    of_folds = logged_metrics[logged_metrics.fold.notna()]
    assert len(of_folds) == len(rows)
    parent = logged.run_id[logged.parent_run_id.isna()].item()
    above = logged_metrics[logged_metrics.run_id == parent].set_index(["metric", "t"]).value
    assert set(of_folds.parent_run_id) == {parent}
    assert above["mean_c_index"].item() == pytest.approx(c.mean()) and above["std_c_index"].item() == pytest.approx(np.std(c))
    assert above["mean_td_auc", 20] == pytest.approx(rows[(rows.metric == "td_auc") & (rows.t == 20)]["value"].mean())
    fold0 = of_folds.run_id[of_folds.fold == 0].iloc[0]
    kept = CoxModel.load(spark, f"{tmp_path}/runs/models/{fold0}")
    folded = stratified_folds(cohort, 2)
    assert c_index(kept.risk(folded.filter("fold = 0"))).first()["c_index"] == pytest.approx(c.iloc[0])
    run_id = train_final(CoxPH(), cohort, FEATURES, str(tmp_path / "models"), runs)
    assert CoxModel.load(spark, f"{tmp_path}/models/{run_id}").version == run_id


@pytest.fixture(scope="module")
def folded(cohort):
    """Three folds, with a time and an event missing here and there."""
    number = F.substring("customer_id", 2, 9).cast("int")
    gaps = cohort.withColumn("duration", F.when(number % 50 != 7, F.col("duration"))).withColumn("event", F.when(number % 40 != 9, F.col("event")))
    return gaps.withColumn("fold", number % 3)


def test_censoring_of_all_folds_at_once(folded):
    got = {k: [(r["t"], r["g"]) for r in censoring_km_by_fold(folded, 3).filter(F.col("fold") == k).orderBy("t").collect()] for k in range(3)}
    want = {k: [tuple(r) for r in censoring_km(folded.filter(F.col("fold") != k)).orderBy("t").collect()] for k in range(3)}
    assert got == want


def test_folds_evaluated_at_once(folded, cox):
    """The same figures as fold by fold."""
    folded = folded.filter("duration IS NOT NULL")
    models = [cox, replace(cox, coef=[0.1, 0.2, -0.3]), cox]
    got = [m.rows() for m in evaluate_folds(models, folded, [10, 20, 4000])]
    want = [evaluate(m, folded.filter(F.col("fold") == k), folded.filter(F.col("fold") != k), [10, 20, 4000], k).rows() for k, m in enumerate(models)]
    for rows, expected in zip(got, want):
        assert [r[:4] for r in rows] == [r[:4] for r in expected]
        assert [r[4] for r in rows] == pytest.approx([r[4] for r in expected], nan_ok=True)


def test_cross_validation_reads_the_folds_once(cohort, monkeypatch):
    """The folded table is not written again for the fit, and what all folds share is found in one pass over it."""
    written, ranked = [], []

    def spy(module, name, seen, note):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (seen.append(note(*a)), plain(*a, **k))[1])

    for module, name in ((survival, "materialise"), (evaluation, "materialise")):
        spy(module, name, written, lambda df, label="table": label)
    spy(evaluation, "materialise_by", written, lambda df, column, label="table": label)
    spy(training, "materialise_by", written, lambda df, column, label="table": label)
    spy(evaluation, "c_index", ranked, lambda *a: "c_index")
    cross_validate(CoxPH(alpha=0.5), cohort, FEATURES, n_splits=3, horizons=[10, 20])
    counts = {label: written.count(label) for label in ("folds", "cox", "scored", "censoring")}
    assert counts == {"folds": 1, "cox": 0, "scored": 1, "censoring": 1} and len(ranked) == 1


def test_buckets_of_risks_follow_the_rows(cohort, monkeypatch):
    """Every bucket is a call of its own: a few hundred rows do not make a thousand of them."""
    asked = []
    plain = evaluation._concordance
    monkeypatch.setattr(evaluation, "_concordance", lambda line, rows, groups, buckets: (asked.append(buckets), plain(line, rows, groups, buckets))[1])
    by_default, many = c_index(cohort, part_rows=50).first(), c_index(cohort, part_rows=50, buckets=1024).first()
    assert by_default == many and asked == [2, 1024]

def test_evaluation_summary(cohort, cox):
    result = evaluate(cox, cohort, cohort, [10, 20], fold=3)
    assert result.value("n_train") == result.value("n_test") == cohort.count()
    line = metric_lines(results_table(cohort.sparkSession, [result])).first()
    assert (line["model"], line["fold"]) == ("CoxPH", 3) and "c_index=0." in line["line"] and "td_auc@10=" in line["line"]
    lone = evaluate(cox, cohort, cohort, [10])
    assert math.isnan(lone.value("ibs")) and lone.by_horizon("td_auc") == {} and list(lone.by_horizon("brier")) == [10]


def test_rows_without_a_weight_make_the_figures_null(spark):
    # Everyone is censored by time 5, so nothing after it has a censoring weight.
    rows = [(1.0, 0.1, False), (5.0, 0.2, False), (7.0, 0.3, True)]
    df = spark.createDataFrame(rows, "duration double, risk double, event boolean")
    table = spark.createDataFrame([(1.0, 0.5), (5.0, 0.0)], "t double, g double")
    weighted = with_censoring_weight(df, table)
    assert {r["duration"]: r["inv_g"] for r in weighted.collect()} == {1.0: 2.0, 5.0: None, 7.0: None}
    assert [r["brier"] for r in brier(weighted, table, [0.1], [6]).collect()] == [None]
    assert [r["auc"] for r in td_auc(weighted, [7]).collect()] == [None]


def test_folds_keep_rows_without_event_or_key(spark):
    rows = [("a", True), (None, True), ("b", None), (None, None)] * 3
    df = spark.createDataFrame(rows, "customer_id string, event boolean")
    assert stratified_folds(df, 2).count() == 12


def test_partial_likelihood_of_large_risks(spark):
    rows = [(float(i + 1), i % 3 != 0, i * 0.7) for i in range(12)]
    near = spark.createDataFrame(rows, "duration double, event boolean, risk double")
    far = near.withColumn("risk", F.col("risk") + 790)
    assert partial_log_likelihood(far).first()["log_likelihood"] == pytest.approx(partial_log_likelihood(near).first()["log_likelihood"])


# --- behaviour and scoring ----------------------------------------------------------------------


def test_behaviour_checks(cohort, cohort_pdf, cox):
    scored = cox.risk(cohort)
    means = {r["event"]: r["mean_risk"] for r in risk_by_outcome(scored).collect()}
    assert means[True] > means[False]
    churned = cohort.filter("event")
    pdf = cohort_pdf[cohort_pdf.event]
    want = pdf.risk.rank().corr(pdf.duration.rank())
    assert spearman(churned, "risk", "duration").first()["rho"] == pytest.approx(want)
    row = quartile_means(scored, "f1", "risk").first()
    assert row["q25"] == pytest.approx(np.percentile(cohort_pdf.f1, 25))
    assert row["mean_high"] > row["mean_low"]
    assert changed_scores(scored, cox.risk(cohort.repartition(5)), ["customer_id", "risk"]).count() == 0


def test_scoring_from_a_map(spark, cohort, cox):
    named = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])
    asked = cohort.select("customer_id", named.alias("features")).unionByName(
        spark.createDataFrame([("broken", {"f1": 1.0})], "customer_id string, features map<string,double>")
    )
    good, bad = score(asked, cox, [10, 20], features_map="features")
    assert good.count() == cohort.count()
    row = good.first()
    assert row["survival_curve"]["time_days"] == [10, 20]
    assert 1 >= row["survival_curve"]["probabilities"][0] >= row["survival_curve"]["probabilities"][1] >= 0
    assert bad.first()["missing"] == ["f2", "f3"]
    wide, seen = counted(asked, cox, "features")
    wide.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": cohort.count() + 1, "failed": 1}


def plain_tree(pdf, margin, spec, number=0):
    """Leaf values of one tree for every row, from the definition: all values are candidate thresholds."""
    x, t, e = pdf[FEATURES].to_numpy(), pdf.duration.to_numpy(), pdf.event.to_numpy()
    w = np.exp(margin)
    s0 = np.array([w[t >= u].sum() for u in t])
    a = np.array([(1 / s0)[e & (t <= u)].sum() for u in t])
    b = np.array([(1 / s0**2)[e & (t <= u)].sum() for u in t])
    g, h = w * a - e, w * a - w * w * b
    out = np.zeros(len(pdf))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + spec.reg_lambda)

    def grow(rows, depth):
        best = (1e-6, None)
        if depth < spec.max_depth:
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    low, high = rows & (x[:, f] <= v), rows & (x[:, f] > v)
                    if min(h[low].sum(), h[high].sum()) < spec.min_child_weight:
                        continue
                    gain = score(low) + score(high) - score(rows)
                    best = max(best, (gain, (low, high)), key=lambda c: c[0])
        if best[1] is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + spec.reg_lambda)
            return
        for side in best[1]:
            grow(side, depth + 1)

    grow(np.ones(len(pdf), bool), 0)
    return out


def test_boosting_of_a_few_parts_worth_of_rows_runs_in_one_task(spark, monkeypatch):
    """A Spark job for each level of each tree is for tables beyond one task."""
    seen, grown = [], BoostedCox._grown
    monkeypatch.setattr(BoostedCox, "_grown", lambda self, line, *a: seen.append(line.parts) or grown(self, line, *a))
    rows = spark.range(PART_ROWS + 500).select(
        (F.pmod(F.col("id") * 7919, F.lit(997)) + 1).alias("duration"), (F.col("id") % 3 > 0).alias("event"), F.pmod(F.col("id") * 31, F.lit(17)).alias("x")
    )
    spec = BoostedCox(n_estimators=3, max_depth=2, part_rows=PART_ROWS)
    whole, parts = spec.fit(rows, ["x"], eval_set=rows), replace(spec, part_rows=40_000).fit(rows, ["x"], eval_set=rows)
    assert seen == [1, 2]
    assert len(whole.losses) == len(parts.losses) == 3 and whole.losses == pytest.approx(parts.losses, rel=1e-3)


@pytest.mark.parametrize("part_rows", [PART_ROWS, 50])
def test_boosting_matches_the_definition(cohort, cohort_pdf, part_rows):
    spec = BoostedCox(
        n_estimators=3, max_depth=3, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0, min_child_weight=4, part_rows=part_rows
    )
    model = spec.fit(cohort, FEATURES, eval_set=cohort)
    margin = np.zeros(len(cohort_pdf))
    got = np.zeros(len(cohort_pdf))
    for tree, loss in zip(model.trees, model.losses):
        margin = margin + 0.3 * plain_tree(cohort_pdf, margin, spec)
        got = got + 0.3 * tree.values(cohort_pdf[FEATURES].to_numpy())
        np.testing.assert_allclose(got, margin, atol=1e-9)
        w, t = np.exp(margin), cohort_pdf.duration.to_numpy()
        want = -np.mean([margin[i] - math.log(w[t >= t[i]].sum()) for i in np.flatnonzero(cohort_pdf.event)])
        assert loss == pytest.approx(want)


def test_parts_grow_the_same_trees(cohort, monkeypatch):
    """With draws of rows and columns, margins moved in between, and a separate table for the losses."""
    monkeypatch.setattr(boosted, "ROUNDS", 2)
    held_out = cohort.filter("f3 > 0")
    models = [
        BoostedCox(n_estimators=5, max_depth=2, learning_rate=0.3, min_child_weight=2, part_rows=n).fit(cohort, FEATURES, eval_set=held_out)
        for n in (PART_ROWS, 60)
    ]
    assert models[0].losses == pytest.approx(models[1].losses)
    for one, many in zip(models[0].trees, models[1].trees):
        assert one.feature.tolist() == many.feature.tolist() and one.threshold.tolist() == many.threshold.tolist()
        assert one.value == pytest.approx(many.value)
    assert models[0].losses[-1] == pytest.approx(partial_log_likelihood(models[0].risk(held_out)).first()["loss"])


def test_margins_move_on_from_the_last_move(cohort, monkeypatch):
    """With the trees grown since alone, and from all trees every MOVES moves; a level's nodes are summed a few at a time."""
    for name, few in (("ROUNDS", 2), ("TABLE_ROUNDS", 2), ("MOVES", 3), ("NODES_AT_ONCE", 1)):
        monkeypatch.setattr(boosted, name, few)
    seen, advance = [], Timeline.advance
    monkeypatch.setattr(Timeline, "advance", lambda line, margin, afresh: seen.append(afresh) or advance(line, margin, afresh))
    held_out = cohort.filter("f3 > 0")
    spec = BoostedCox(n_estimators=7, max_depth=3, learning_rate=0.3, min_child_weight=2)
    whole = spec.fit(cohort, FEATURES)  # one task, no moves
    assert not seen
    for part_rows in (PART_ROWS, 60):
        model = replace(spec, part_rows=part_rows).fit(cohort, FEATURES, eval_set=held_out)
        assert seen == [flag for flag in (False, False, True) for _ in range(2)]
        seen.clear()
        for one, many in zip(whole.trees, model.trees, strict=True):
            assert one.feature.tolist() == many.feature.tolist() and one.threshold.tolist() == many.threshold.tolist()
            assert one.value == pytest.approx(many.value)
        assert model.losses[-1] == pytest.approx(partial_log_likelihood(model.risk(held_out)).first()["loss"])


def test_rows_of_one_task_are_boosted_and_judged_in_one_job(cohort, monkeypatch):
    """No scan for the losses and none to move the margins, where the losses are those of the rows that are boosted."""

    def none(*a):
        raise AssertionError("another scan")

    monkeypatch.setattr(boosted, "ROUNDS", 2)
    monkeypatch.setattr(boosted, "_losses", none)
    monkeypatch.setattr(Timeline, "advance", none)
    model = BoostedCox(n_estimators=5, max_depth=2, learning_rate=0.3, min_child_weight=2).fit(cohort, FEATURES, eval_set=cohort)
    assert len(model.trees) == len(model.losses) == 5
    assert model.losses[-1] == pytest.approx(partial_log_likelihood(model.risk(cohort)).first()["loss"])


def test_columns_counted_together_give_the_sums_of_each():
    """Few bins, many bins, one bin for almost all rows; nodes of many rows and of few."""
    rng = np.random.default_rng(8)
    n = 3 * boosted.UNIT_ROWS
    rare = rng.random(n) < 0.1
    x = np.column_stack(
        [rng.integers(0, 2, n), rng.integers(0, 256, n), np.where(rare, rng.integers(0, 200, n), 7), rng.integers(0, 5, n), np.where(rare, 1, 0), np.zeros(n)]
    ).astype(np.uint8)
    g, h = rng.normal(size=n), rng.random(n)
    together = boosted._Rows(x, units=True)
    assert sorted(c for u in together.units for c in u.columns) == list(range(6)) and len(together.units) < 6
    assert any(u.usual is not None for u in together.units)
    tree = boosted.Tree(np.array([4, -1, -1]), np.zeros(3), np.array([1, -1, -1]), np.array([2, -1, -1]), np.zeros(3))
    drawn = np.flatnonzero(rng.random(n) < 0.9)
    together.hold(drawn)
    for columns in ([0, 1, 2, 3, 4, 5], [1, 3, 4]):
        for node in (0, 1, 2):
            if node == 1:
                together.sink(tree)
                assert set(together.held) == {1, 2} and len(together.held[2]) < boosted.UNIT_ROWS < len(together.held[1])
            rows = drawn if node == 0 else drawn[(x[drawn, 4] > 0) == (node == 2)]
            want = [[np.bincount(x[rows, c], v[rows], boosted.BINS) for v in (g, h)] for c in columns]
            np.testing.assert_allclose(together.histograms(node, columns, g, h), np.moveaxis(want, 1, 2), atol=1e-9)
        together.hold(drawn)


def test_bins_of_many_values_and_gaps(spark):
    rows = [(float(i % 700), float(i % 3) if i % 5 else None, float("nan")) for i in range(2100)]
    a, b, c = boosted.bin_borders(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert len(a) == 255 and np.all(np.diff(a) > 0) and b.tolist() == [0.0, 1.0] and len(c) == 0
    placed = boosted.binned([a, b, c])(np.array([[0.0, 1.0, 5.0], [699.0, np.nan, np.nan]]))
    assert placed.tolist() == [[0, 1, 0], [255, 2, 0]]


def test_boosted_loss_falls_and_reloads(spark, cohort, tmp_path):
    model = BoostedCox(
        n_estimators=3, max_depth=2, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0
    ).fit(cohort, FEATURES, eval_set=cohort)
    assert model.losses[0] > model.losses[1] > model.losses[2]
    assert c_index(model.risk(cohort)).first()["c_index"] > 0.6
    loss = partial_log_likelihood(model.risk(cohort)).first()["loss"]
    assert loss == pytest.approx(model.losses[-1])
    assert curve_breaks(model.survival(cohort.select("customer_id", *FEATURES), [5, 10, 20])).count() == 0
    model.save(str(tmp_path / "b"))
    again = BoostedModel.load(spark, str(tmp_path / "b"))
    assert changed_scores(model.risk(cohort), again.risk(cohort), ["customer_id", "risk"]).count() == 0


def test_boosting_stops_early(cohort):
    model = BoostedCox(
        n_estimators=8, max_depth=2, learning_rate=30.0, subsample=1.0, early_stopping_rounds=1
    ).fit(cohort, FEATURES, eval_set=cohort)
    assert len(model.losses) == int(np.argmin(model.losses)) + 2 < 8
    assert len(model.trees) == int(np.argmin(model.losses)) + 1
