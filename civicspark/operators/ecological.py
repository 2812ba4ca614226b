"""Ecological inference on tables: bounds, regressions, posterior draws.

A posterior sample is a long table (draw, precinct, grp, cand, b); a precinct table holds the group share
``x``, the outcome share ``t`` and the population ``n``. Sampling the posterior itself is not done here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions import scalars as S
from civicspark.operators import ordered as O
from civicspark.operators.aggregates import weighted_mean
from civicspark.session import materialise

INTERVAL_95 = {"lower": 0.025, "upper": 0.975}
INTERVAL_80 = {"lower": 0.1, "upper": 0.9}


def prepare(df: DataFrame, group: str, without: str, total: str) -> DataFrame:
    """Shares from counts: x = group / total, t = 1 - without / total; only populated, mixed areas stay."""
    n = F.col(total).cast("double")
    out = df.withColumns({"x": S.ratio(F.col(group).cast("double"), n), "t": F.lit(1.0) - S.ratio(F.col(without).cast("double"), n), "n": F.col(total)})
    return out.filter((F.col("n") > 0) & (F.col("x") > 0) & (F.col("x") < 1) & (F.col("t") > 0) & (F.col("t") < 1))


def bounds(df: DataFrame) -> DataFrame:
    """Deterministic bounds of both groups' rates; NULL for a group absent from a precinct, and where x or t is NULL."""
    x, t = F.col("x"), F.col("t")
    rest = F.nullif(F.lit(1.0) - x, F.lit(0.0))
    some = F.nullif(x, F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)

    def pick(mixed: Column, only_b: Column, only_w: Column) -> Column:
        return F.when(x.isNull() | t.isNull(), null).when(x == 0, only_w).when(x == 1, only_b).otherwise(mixed)

    null = F.lit(None).cast("double")
    return df.withColumns({
        "lower_b": pick(F.greatest(zero, (t - rest) / some), t, null), "upper_b": pick(F.least(one, t / some), t, null),
        "lower_w": pick(F.greatest(zero, (t - some) / rest), null, t), "upper_w": pick(F.least(one, t / rest), null, t)})


def bounds_aggregate(df: DataFrame, skip_null: bool = True) -> DataFrame:
    """Bounds weighted by each group's population."""
    b = bounds(df)
    nb, nw = F.col("x") * F.col("n"), (F.lit(1.0) - F.col("x")) * F.col("n")
    return b.agg(*[weighted_mean(F.col(c), nb if c.endswith("b") else nw, skip_null).alias(c)
                   for c in ("lower_b", "upper_b", "lower_w", "upper_w")])


def goodman(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Regress t on x, optionally weighted: intercept is the complement's rate, intercept + slope the group's.

    Rows without x, t or weight take no part. Sums of centred products, one row; NULL if the weights or x's spread are 0.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col("x").alias("x"), F.col("t").alias("t"), w.alias("w")).filter("x IS NOT NULL AND t IS NOT NULL AND w IS NOT NULL")
    means = rows.agg(F.struct(F.avg("x").alias("x"), F.avg("t").alias("t")).alias("m")).scalar()
    rows = rows.withColumn("_m", means).withColumn("dx", F.col("x") - F.col("_m.x")).withColumn("dt", F.col("t") - F.col("_m.t"))
    sums = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("dx")).alias("wx"), F.sum(F.col("w") * F.col("dt")).alias("wt"),
                    F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("wxx"), F.sum(F.col("w") * F.col("dx") * F.col("dt")).alias("wxt"),
                    F.avg("x").alias("x0"), F.avg("t").alias("t0"))
    slope = (F.col("w") * F.col("wxt") - F.col("wx") * F.col("wt")) / F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    fitted = sums.withColumn("slope", slope)
    intercept = F.col("t0") - F.col("slope") * F.col("x0") + (F.col("wt") - F.col("slope") * F.col("wx")) / F.nullif(F.col("w"), F.lit(0.0))
    return fitted.select(intercept.alias("intercept"), "slope", intercept.alias("rate_w"), (intercept + F.col("slope")).alias("rate_b"))


def tomography(df: DataFrame, points: int = 200) -> DataFrame:
    """Each precinct's line beta_w = (t - beta_b x) / (1 - x) on an even grid of beta_b."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / F.lit(points - 1))
    lines = df.withColumn("beta_b", F.explode(grid))
    rest = F.nullif(F.lit(1.0) - F.col("x"), F.lit(0.0))
    return lines.withColumn("beta_w", (F.col("t") - F.col("beta_b") * F.col("x")) / rest)


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Coefficients and standard errors of y on x, from centred moments."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = ok.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"),
               F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    slope = F.col("cxy") / F.nullif(F.col("vx"), F.lit(0.0))
    fit = m.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    rss = F.greatest(F.lit(0.0), F.col("n") * (F.col("vy") - F.col("slope") * F.col("cxy")))
    s2 = rss / F.nullif(F.col("n") - 2, F.lit(0.0))
    sxx = F.nullif(F.col("n") * F.col("vx"), F.lit(0.0))
    return fit.select("intercept", "slope", F.sqrt(s2 * (1 / F.col("n") + F.col("mx") * F.col("mx") / sxx)).alias("se_intercept"),
                      F.sqrt(s2 / sxx).alias("se_slope"))


def estimate_errors(df: DataFrame) -> DataFrame:
    """Errors of estimates against the truth (beta_b, beta_w, est_b, est_w, x, t, n), and the four cell counts."""
    out = {}
    for g in ("b", "w"):
        true, est, t = F.col(f"beta_{g}"), F.col(f"est_{g}"), F.col("t")
        out |= {f"abs_error_{g}": est - true, f"pct_error_{g}": S.ratio(est - true, true), f"pct_error_{g}_using_t": S.ratio(true - t, true),
                f"improvement_{g}": S.ratio(F.abs(t - true) - F.abs(est - true), F.abs(true)), f"difference_{g}": F.abs(est - t)}
        size = F.col("n") * (F.col("x") if g == "b" else F.lit(1.0) - F.col("x"))
        out |= {f"cell_{g}_t": size * true, f"cell_{g}_not": size * (F.lit(1.0) - true)}
    return df.withColumns(out)


def scenario_counts(df: DataFrame) -> DataFrame:
    """Log numbers of ways to realise a precinct, aggregate and per group, and the log of their ratio."""
    n = F.col("n").cast("bigint")

    def ways(size: Column, rate: Column) -> Column:
        whole = F.floor(size)
        return S.log_binom(whole, F.least(whole, F.floor(rate * size)))

    x = F.col("x")
    agg = ways(n.cast("double"), F.col("t"))
    eco = ways(x * n, F.col("beta_b")) + ways((F.lit(1.0) - x) * n, F.col("beta_w"))
    return df.withColumns({"log_agg": agg, "log_eco": eco}).withColumn("log_ratio", F.col("log_agg") - F.col("log_eco"))


def district_draws(draws: DataFrame, precincts: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per draw, group and candidate: the population-weighted share over precincts (``weight`` replaces ``n``)."""
    w = F.col("n").cast("double") if weight is None else weight
    j = draws.join(precincts, "precinct")
    return j.groupBy("draw", "grp", "cand").agg(weighted_mean(F.col("b"), w).alias("v"))


def district_draws_by_group(draws: DataFrame, precincts: DataFrame) -> DataFrame:
    """The same with each group's own population: n x for group 0, n (1 - x) for group 1."""
    own = F.col("n") * F.when(F.col("grp") == 0, F.col("x")).otherwise(F.lit(1.0) - F.col("x"))
    return district_draws(draws, precincts, own)


def summary(draws: DataFrame, keys: Sequence[str], value: str, interval: dict[str, float] = INTERVAL_95) -> DataFrame:
    """Posterior mean and equal-tailed interval per key."""
    mean = draws.groupBy(*keys).agg(F.avg(value).alias("mean"))
    ends = O.exact_quantiles(draws, list(keys), value, interval).select(*[F.col(k).alias(f"_s_{k}") for k in keys], *interval)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    return mean.join(ends, same, "left").select(*keys, "mean", *interval)  # a key without values keeps its row, all NULL


def group_difference(prefs: DataFrame, cand: int, groups: tuple[int, int]) -> DataFrame:
    """Per draw: the first group's share minus the second's for one candidate."""
    mine = prefs.filter(F.col("cand") == cand).groupBy("draw").agg(
        *[F.max(F.when(F.col("grp") == g, F.col("v"))).alias(f"g{i}") for i, g in enumerate(groups)])
    return mine.select("draw", (F.col("g0") - F.col("g1")).alias("diff"))


def polarization(prefs: DataFrame, cand: int, groups: tuple[int, int], threshold: float | None = None,
                 percentile: float | None = None) -> DataFrame:
    """Percent of draws above ``threshold``, or the interval that holds ``percentile`` percent: exactly one is given."""
    if (threshold is None) == (percentile is None):
        raise ValueError("give exactly one of threshold and percentile")
    diff = group_difference(prefs, cand, groups)
    if threshold is not None:
        return diff.agg((F.avg(F.when(F.col("diff") > threshold, 1.0).otherwise(0.0)) * 100).alias("percent"))
    tail = (100.0 - percentile) / 200.0
    return O.exact_quantiles(diff, [], "diff", {"lower": tail, "upper": 1.0 - tail})


def choices(prefs: DataFrame, leave_out: Sequence[int] = ()) -> DataFrame:
    """Each group's candidate of choice per draw (ties: the smaller number)."""
    kept = prefs.filter(~F.col("cand").isin(list(leave_out))) if leave_out else prefs
    return kept.groupBy("draw", "grp").agg(F.max_by("cand", F.struct(F.col("v"), -F.col("cand"))).alias("choice"))


def candidate_of_choice(prefs: DataFrame, leave_out: Sequence[int] = ()) -> DataFrame:
    """Share of draws in which a candidate is a group's choice; candidates never chosen get 0."""
    kept = prefs.filter(~F.col("cand").isin(list(leave_out))) if leave_out else prefs
    marked = kept.join(choices(prefs, leave_out), ["draw", "grp"])
    return marked.groupBy("grp", "cand").agg(F.avg(F.when(F.col("cand") == F.col("choice"), 1.0).otherwise(0.0)).alias("share"))


def choice_differs(prefs: DataFrame, leave_out: Sequence[int] = ()) -> DataFrame:
    """Share of draws in which two groups' choices differ, for every ordered pair of groups."""
    c = choices(prefs, leave_out)
    a, b = c.select("draw", F.col("grp").alias("grp1"), F.col("choice").alias("c1")), c.select("draw", F.col("grp").alias("grp2"), F.col("choice").alias("c2"))
    both = a.join(b, "draw").filter(F.col("grp1") != F.col("grp2"))
    return both.groupBy("grp1", "grp2").agg(F.avg(F.when(F.col("c1") != F.col("c2"), 1.0).otherwise(0.0)).alias("share"))


def line_band(pairs: DataFrame, keys: Sequence[str], points: int, interval: dict[str, float]) -> DataFrame:
    """Mean and band of ``b0 x + b1 (1 - x)`` over draws on an even grid of x; ``pairs`` holds b0 and b1 per draw.

    The draws are stored once; what moves per grid point are counts of value bins and the values of the bins that hold the ends.
    """
    keys = list(keys)
    pairs = materialise(pairs.select(*keys, "b0", "b1"), "pairs")
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    grid = pairs.withColumn("step", F.explode(steps)).withColumn("x", F.col("step") / F.lit(points - 1))
    lines = grid.select(*keys, "step", (F.col("b0") * F.col("x") + F.col("b1") * (F.lit(1.0) - F.col("x"))).alias("y"))
    by = [*keys, "step"]
    ends = O.binned_quantiles(lines, by, "y", interval).select(*[F.col(k).alias(f"_s_{k}") for k in by], *interval)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in by])
    return lines.groupBy(*by).agg(F.avg("y").alias("mean")).join(ends, same, "left").select(*by, "mean", *interval)


def paired(draws: DataFrame, keys: Sequence[str], cand: int, value: str = "b") -> DataFrame:
    """The two groups' values side by side, complete pairs only."""
    mine = draws.filter(F.col("cand") == cand).groupBy(*keys).agg(
        *[F.max(F.when(F.col("grp") == g, F.col(value))).alias(f"b{g}") for g in (0, 1)])
    return mine.filter(F.col("b0").isNotNull() & F.col("b1").isNotNull())


def compare_runs(one: DataFrame, two: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two sets of estimates side by side."""
    a = one.groupBy(*keys).agg(F.avg(value).alias("run1"))
    b = two.groupBy(*keys).agg(F.avg(value).alias("run2"))
    return a.join(b, list(keys))


def validate(draws: DataFrame, precincts: DataFrame) -> DataFrame:
    """Cardinalities that must agree, as one row of counts."""
    shape = draws.agg(F.countDistinct("grp").alias("n_groups"), F.countDistinct("cand").alias("n_cands"), F.countDistinct("precinct").alias("n_precincts"))
    known = precincts.agg(F.countDistinct("precinct").alias("n_known"))
    unknown = draws.select("precinct").distinct().join(precincts.select("precinct"), "precinct", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    return (shape.withColumn("n_known", known.scalar()).withColumn("n_unknown", unknown.scalar()))
