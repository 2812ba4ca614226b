"""Ecological inference on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import scalars as S
from civicspark.operators import ecological as E
from civicspark.operators import ordered as O
from civicspark.plans import bindings as B
from civicspark.plans.bindings import CTES, sql
from civicspark.plans.registry import query

CTES["district"] = "SELECT draw, grp, cand, sum(b * n) / sum(n) AS v FROM draws JOIN draw_precincts USING (precinct) GROUP BY 1, 2, 3"


def _r(df, digits=8, *cols):
    """Round the named columns (all doubles when none is named)."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def _q(cols: str, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())


def _prefs(t):
    return E.district_draws(B.draws(t), B.draw_precincts(t))


@query("ei_prepare", """SELECT l_partkey, n, round(x, 8) AS x, round(t, 8) AS t FROM (SELECT *, CAST(g AS DOUBLE) / n AS x, 1.0::DOUBLE - CAST(w AS DOUBLE) / n AS t FROM
       (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS g, count(*) FILTER (l_linestatus = 'O') AS w FROM lineitem GROUP BY 1))
       WHERE n > 0 AND x > 0 AND x < 1 AND t > 0 AND t < 1""")
def ei_prepare(t):
    counts = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("g"),
                                                 F.count_if(F.col("l_linestatus") == "O").alias("w"))
    return _r(E.prepare(counts, "g", "w", "total").select("l_partkey", "n", "x", "t"))


_BOUNDS = """SELECT precinct, x, t, n,
    CASE WHEN x = 0 THEN NULL WHEN x = 1 THEN t ELSE greatest(0.0, (t - (1 - x)) / x) END AS lower_b, CASE WHEN x = 0 THEN NULL WHEN x = 1 THEN t ELSE least(1.0, t / x) END AS upper_b,
    CASE WHEN x = 1 THEN NULL WHEN x = 0 THEN t ELSE greatest(0.0, (t - x) / (1 - x)) END AS lower_w, CASE WHEN x = 1 THEN NULL WHEN x = 0 THEN t ELSE least(1.0, t / (1 - x)) END AS upper_w
    FROM precincts"""


@query("ei_bounds", sql("precincts", f"SELECT precinct, {_q('lower_b upper_b lower_w upper_w')} FROM ({_BOUNDS})"))
def ei_bounds(t):
    return _r(E.bounds(B.precincts(t)).select("precinct", "lower_b", "upper_b", "lower_w", "upper_w"))


def _wm(v: str, w: str) -> str:
    return f"round(sum({v} * {w}) / sum(CASE WHEN {v} IS NOT NULL THEN {w} END), 8) AS {v}"


@query("ei_bounds_aggregate", sql("precincts", f"SELECT {_wm('lower_b', 'x * n')}, {_wm('upper_b', 'x * n')}, {_wm('lower_w', '(1 - x) * n')}, {_wm('upper_w', '(1 - x) * n')} FROM ({_BOUNDS})"))
def ei_bounds_aggregate(t):
    return _r(E.bounds_aggregate(B.precincts(t)))


@query("ei_goodman", sql("precincts", """SELECT round(regr_intercept(t, x), 8) AS intercept, round(regr_slope(t, x), 8) AS slope, round(regr_intercept(t, x), 8) AS rate_w,
       round(regr_intercept(t, x) + regr_slope(t, x), 8) AS rate_b FROM precincts"""))
def ei_goodman(t):
    return _r(E.goodman(B.precincts(t)))


@query("ei_goodman_weighted", sql("precincts", """SELECT round((wt - slope * wx) / w, 8) AS intercept, round(slope, 8) AS slope, round((wt - slope * wx) / w, 8) AS rate_w, round((wt - slope * wx) / w + slope, 8) AS rate_b
       FROM (SELECT *, (wxt / w - wx / w * wt / w) / (wxx / w - wx / w * wx / w) AS slope FROM
       (SELECT CAST(sum(n) AS DOUBLE) AS w, sum(n * x) AS wx, sum(n * t) AS wt, sum(n * x * x) AS wxx, sum(n * x * t) AS wxt FROM precincts))"""))
def ei_goodman_weighted(t):
    return _r(E.goodman(B.precincts(t), "n"))


@query("ei_tomography", sql("precincts", """SELECT precinct, round(beta_b, 8) AS beta_b, round((t - beta_b * x) / nullif(1 - x, 0), 8) + 0.0 AS beta_w FROM
       (SELECT precinct, x, t, unnest(range(0, 200)) / 199.0::DOUBLE AS beta_b FROM precincts)"""))
def ei_tomography(t):
    return _r(E.tomography(B.precincts(t)).select("precinct", "beta_b", "beta_w"))


@query("ei_agg_bias", sql("precincts", f"""SELECT round(intercept, 6) AS intercept, round(slope, 6) AS slope, round(sqrt(s2 * (1 / n + mx * mx / sxx)), 6) AS se_intercept, round(sqrt(s2 / sxx), 6) AS se_slope FROM
       (SELECT *, my - slope * mx AS intercept, (syy - slope * sxy) / (n - 2) AS s2 FROM (SELECT *, sxy / sxx AS slope FROM
       (SELECT CAST(regr_count(est, x) AS DOUBLE) AS n, regr_avgx(est, x) AS mx, regr_avgy(est, x) AS my, regr_sxx(est, x) AS sxx, regr_syy(est, x) AS syy, regr_sxy(est, x) AS sxy
        FROM (SELECT x, (lower_b + upper_b) / 2 AS est FROM ({_BOUNDS})))))"""))
def ei_agg_bias(t):
    est = E.bounds(B.precincts(t)).select("x", ((F.col("lower_b") + F.col("upper_b")) / 2).alias("est"))
    return _r(E.ols(est, "x", "est"), 6)


def _estimated(t):
    p = B.precincts(t)
    k = F.col("precinct")
    beta_b, beta_w = (k * 7 % 97 + 1).cast("double") / 100.0, (k * 13 % 89 + 1).cast("double") / 100.0
    return p.withColumns({"beta_b": beta_b, "beta_w": beta_w, "est_b": (beta_b + F.col("t")) / 2, "est_w": (beta_w + F.col("t")) / 2})


CTES["estimated"] = """SELECT *, (beta_b + t) / 2 AS est_b, (beta_w + t) / 2 AS est_w FROM (SELECT *, CAST(precinct * 7 % 97 + 1 AS DOUBLE) / 100.0 AS beta_b,
    CAST(precinct * 13 % 89 + 1 AS DOUBLE) / 100.0 AS beta_w FROM precincts)"""


def _err(g: str) -> str:
    size = "n * x" if g == "b" else "n * (1 - x)"
    exprs = {f"abs_error_{g}": f"est_{g} - beta_{g}", f"pct_error_{g}": f"(est_{g} - beta_{g}) / beta_{g}", f"pct_error_{g}_using_t": f"(beta_{g} - t) / beta_{g}",
             f"improvement_{g}": f"(abs(t - beta_{g}) - abs(est_{g} - beta_{g})) / abs(beta_{g})", f"difference_{g}": f"abs(est_{g} - t)",
             f"cell_{g}_t": f"{size} * beta_{g}", f"cell_{g}_not": f"{size} * (1 - beta_{g})"}
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in exprs.items())


@query("ei_errors", sql("precincts estimated", f"SELECT precinct, {_err('b')}, {_err('w')} FROM estimated"))
def ei_errors(t):
    return _r(E.estimate_errors(_estimated(t)).drop("x", "t", "n", "beta_b", "beta_w", "est_b", "est_w"), 6)


def _ways(size: str, rate: str) -> str:
    whole = f"floor({size})"
    k = f"least({whole}, floor({rate} * ({size})))"
    return f"(lgamma({whole} + 1) - lgamma({k} + 1) - lgamma({whole} - {k} + 1))"


@query("ei_scenario_counts", sql("precincts estimated", f"""SELECT precinct, round(a, 6) + 0.0 AS log_agg, round(e, 6) + 0.0 AS log_eco, round(a - e, 6) + 0.0 AS log_ratio FROM
       (SELECT precinct, {_ways('CAST(n AS DOUBLE)', 't')} AS a, {_ways('x * n', 'beta_b')} + {_ways('(1.0 - x) * n', 'beta_w')} AS e FROM estimated)"""))
def ei_scenario_counts(t):
    return _r(E.scenario_counts(_estimated(t)).select("precinct", "log_agg", "log_eco", "log_ratio"), 6)


@query("ei_district_draws", sql("district", f"SELECT draw, grp, cand, {_q('v')} FROM district"))
def ei_district_draws(t):
    return _r(_prefs(t))


@query("ei_district_draws_weighted", sql("draws draw_precincts", """SELECT draw, grp, cand, round(sum(b * w) / sum(w), 8) AS v FROM
       (SELECT *, n * CASE WHEN grp = 0 THEN x ELSE 1 - x END AS w FROM draws JOIN draw_precincts USING (precinct)) GROUP BY 1, 2, 3"""))
def ei_district_draws_weighted(t):
    return _r(E.district_draws_by_group(B.draws(t), B.draw_precincts(t)))


_SUMMARY = "round(avg({v}), 8) AS mean, round(quantile_cont({v}, {lo}), 8) AS lower, round(quantile_cont({v}, {hi}), 8) AS upper"


@query("ei_posterior_summary", sql("district", f"SELECT grp, cand, {_SUMMARY.format(v='v', lo=0.025, hi=0.975)} FROM district GROUP BY 1, 2"))
def ei_posterior_summary(t):
    return _r(E.summary(_prefs(t), ["grp", "cand"], "v"))


@query("ei_precinct_summary", sql("draws", f"""SELECT *, round(1 - mean, 8) AS complement_mean FROM (SELECT precinct, grp, cand, {_SUMMARY.format(v='b', lo=0.025, hi=0.975)} FROM draws GROUP BY 1, 2, 3)"""))
def ei_precinct_summary(t):
    out = _r(E.summary(B.draws(t), ["precinct", "grp", "cand"], "b"))
    return out.withColumn("complement_mean", F.round(F.lit(1.0) - F.col("mean"), 8))


@query("ei_ci80", sql("draws", "SELECT precinct, grp, round(quantile_cont(b, 0.1), 8) AS lower, round(quantile_cont(b, 0.9), 8) AS upper FROM draws GROUP BY 1, 2"))
def ei_ci80(t):
    return _r(O.exact_quantiles(B.draws(t), ["precinct", "grp"], "b", E.INTERVAL_80))


@query("ei_agg_moments", sql("district", """SELECT round(avg(b0), 8) AS mean_b, round(avg(b1), 8) AS mean_w, round(stddev_samp(b0), 8) AS sd_b, round(stddev_samp(b1), 8) AS sd_w, round(var_samp(b0), 8) AS var_b,
       round(covar_samp(b0, b1), 8) + 0.0 AS cov_bw FROM (SELECT draw, max(CASE WHEN grp = 0 THEN v END) AS b0, max(CASE WHEN grp = 1 THEN v END) AS b1 FROM district WHERE cand = 0 GROUP BY 1)"""))
def ei_agg_moments(t):
    p = E.paired(_prefs(t), ["draw"], 0, "v")
    return _r(p.agg(F.avg("b0").alias("mean_b"), F.avg("b1").alias("mean_w"), F.stddev_samp("b0").alias("sd_b"), F.stddev_samp("b1").alias("sd_w"),
                    F.var_samp("b0").alias("var_b"), F.covar_samp("b0", "b1").alias("cov_bw")))


CTES["diffs"] = "SELECT draw, max(CASE WHEN grp = 0 THEN v END) - max(CASE WHEN grp = 1 THEN v END) AS diff FROM district WHERE cand = 1 GROUP BY 1"


@query("ei_polarization_prob", sql("district diffs", "SELECT round(100 * avg(CASE WHEN diff > 0.005 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS percent FROM diffs"))
def ei_polarization_prob(t):
    return _r(E.polarization(_prefs(t), 1, (0, 1), threshold=0.005))


@query("ei_polarization_abs", sql("district diffs", "SELECT round(avg(CASE WHEN abs(diff) > 0.005 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS share FROM diffs"))
def ei_polarization_abs(t):
    d = E.group_difference(_prefs(t), 1, (0, 1))
    return _r(d.agg(F.avg(F.when(F.abs("diff") > 0.005, 1.0).otherwise(0.0)).alias("share")))


@query("ei_polarization_interval", sql("district diffs", "SELECT round(quantile_cont(diff, 0.05), 8) AS lower, round(quantile_cont(diff, 0.95), 8) AS upper FROM diffs"))
def ei_polarization_interval(t):
    return _r(E.polarization(_prefs(t), 1, (0, 1), percentile=90.0))


CTES["chosen"] = "SELECT draw, grp, arg_max(cand, {'v': v, 'c': -cand}) AS choice FROM district GROUP BY 1, 2"


@query("ei_candidate_of_choice", sql("district chosen", """SELECT d.grp, d.cand, round(avg(CASE WHEN d.cand = c.choice THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS share
       FROM district d JOIN chosen c ON d.draw = c.draw AND d.grp = c.grp GROUP BY 1, 2"""))
def ei_candidate_of_choice(t):
    return _r(E.candidate_of_choice(_prefs(t)))


@query("ei_choice_differs", sql("district chosen", """SELECT a.grp AS grp1, b.grp AS grp2, round(avg(CASE WHEN a.choice <> b.choice THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS share
       FROM chosen a JOIN chosen b ON a.draw = b.draw AND a.grp <> b.grp GROUP BY 1, 2"""))
def ei_choice_differs(t):
    return _r(E.choice_differs(_prefs(t)))


_PAIRED = "SELECT {keys}, max(CASE WHEN grp = 0 THEN {v} END) AS b0, max(CASE WHEN grp = 1 THEN {v} END) AS b1 FROM {src} WHERE cand = 0 GROUP BY ALL"


def _band(keys: str, v: str, src: str, points: int, lo: float, hi: float) -> str:
    return f"""SELECT step, {_SUMMARY.format(v='y', lo=lo, hi=hi)} FROM (SELECT step, b0 * (step / {points - 1}.0::DOUBLE) + b1 * (1 - step / {points - 1}.0::DOUBLE) AS y FROM
        (SELECT b0, b1, CAST(unnest(range(0, {points})) AS INTEGER) AS step FROM ({_PAIRED.format(keys=keys, v=v, src=src)}) WHERE b0 IS NOT NULL AND b1 IS NOT NULL)) GROUP BY 1"""


@query("ei_fit_band", sql("draws", _band("precinct, draw", "b", "draws", 101, 0.1, 0.9)))
def ei_fit_band(t):
    return _r(E.line_band(E.paired(B.draws(t), ["precinct", "draw"], 0), [], 101, E.INTERVAL_80))


@query("ei_regression_band", sql("district", _band("draw", "v", "district", 100, 0.025, 0.975)))
def ei_regression_band(t):
    return _r(E.line_band(E.paired(_prefs(t), ["draw"], 0, "v"), [], 100, E.INTERVAL_95))


@query("ei_truncate", sql("precincts", "SELECT precinct, round(floor(x * 10000.0::DOUBLE) / 10000.0::DOUBLE, 4) AS x, round(floor(t * 10000.0::DOUBLE) / 10000.0::DOUBLE, 4) AS t FROM precincts"))
def ei_truncate(t):
    return B.precincts(t).select("precinct", *[F.round(S.truncate(F.col(c), 4), 4).alias(c) for c in ("x", "t")])


@query("ei_compare_runs", sql("draws", """SELECT precinct, grp, round(avg(CASE WHEN cand = 0 THEN b END), 8) AS run1, round(avg(CASE WHEN cand = 1 THEN b END), 8) AS run2 FROM draws GROUP BY 1, 2
       HAVING run1 IS NOT NULL AND run2 IS NOT NULL"""))
def ei_compare_runs(t):
    """Two runs side by side: the first two outcomes stand for the two runs."""
    d = B.draws(t)
    return _r(E.compare_runs(d.filter(F.col("cand") == 0), d.filter(F.col("cand") == 1), ["precinct", "grp"], "b"))


@query("ei_truth_compare", sql("draws draw_precincts", """SELECT round(sum(truth * n) / sum(n), 8) AS true_aggregate, round(avg(abs(lo - mean)), 8) AS mean_abs_low, round(avg(abs(hi - mean)), 8) AS mean_abs_high
       FROM (SELECT precinct, avg(b) AS mean, quantile_cont(b, 0.1) AS lo, quantile_cont(b, 0.9) AS hi FROM draws WHERE grp = 0 AND cand = 0 GROUP BY 1) JOIN draw_precincts USING (precinct)"""))
def ei_truth_compare(t):
    mine = B.draws(t).filter((F.col("grp") == 0) & (F.col("cand") == 0))
    s = E.summary(mine, ["precinct"], "b", E.INTERVAL_80).join(B.draw_precincts(t), "precinct")
    return _r(s.agg((F.sum(F.col("truth") * F.col("n")) / F.sum("n")).alias("true_aggregate"), F.avg(F.abs(F.col("lower") - F.col("mean"))).alias("mean_abs_low"),
                    F.avg(F.abs(F.col("upper") - F.col("mean"))).alias("mean_abs_high")))


@query("ei_pooled_draws", sql("draws", f"""SELECT round(avg(b0), 8) AS mean_b, round(avg(b1), 8) AS mean_w, round(stddev_samp(b0), 8) AS sd_b, round(stddev_samp(b1), 8) AS sd_w, round(corr(b0, b1), 8) + 0.0 AS corr_bw
       FROM ({_PAIRED.format(keys='precinct, draw', v='b', src='draws')}) WHERE b0 IS NOT NULL AND b1 IS NOT NULL"""))
def ei_pooled_draws(t):
    p = E.paired(B.draws(t), ["precinct", "draw"], 0)
    return _r(p.agg(F.avg("b0").alias("mean_b"), F.avg("b1").alias("mean_w"), F.stddev_samp("b0").alias("sd_b"), F.stddev_samp("b1").alias("sd_w"),
                    F.corr("b0", "b1").alias("corr_bw")))


@query("ei_validate", sql("draws draw_precincts", """SELECT count(DISTINCT grp) AS n_groups, count(DISTINCT cand) AS n_cands, count(DISTINCT precinct) AS n_precincts,
       (SELECT count(DISTINCT precinct) FROM draw_precincts) AS n_known, count(DISTINCT precinct) FILTER (precinct NOT IN (SELECT precinct FROM draw_precincts)) AS n_unknown FROM draws"""))
def ei_validate(t):
    return E.validate(B.draws(t), B.draw_precincts(t))
