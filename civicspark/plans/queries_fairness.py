"""Access fairness on candidate facility sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import fairness as FA
from civicspark.plans import bindings as B
from civicspark.plans.bindings import CTES, sql
from civicspark.plans.registry import query

BETA = (1.0, 0.5, -0.4)
WEIGHTS = (0.0, 0.5)
FAR = 10.0  # stands in for a distance that is not recorded: beyond all that are

CTES["set_dist"] = """SELECT set_id, person, theta, min(dist) AS r FROM membership JOIN distances USING (facility) JOIN people USING (person) GROUP BY 1, 2, 3"""
CTES["set_reach"] = """SELECT s.set_id, p.person, p.theta, coalesce(d.r, 10.0) AS r FROM (SELECT DISTINCT set_id FROM membership) s CROSS JOIN people p
    LEFT JOIN set_dist d ON d.set_id = s.set_id AND d.person = p.person"""
_P = "1 / (1 + exp(-(1.0::DOUBLE + 0.5 * theta - 0.4 * r)))"
_LP = "-ln(1 + exp(-(1.0::DOUBLE + 0.5 * theta - 0.4 * r)))"
_KINDS = {"distance": "-r", "prob": _P, "logprob": _LP}
CTES["set_scores"] = " UNION ALL ".join(
    f"""SELECT set_id, '{k}' AS objective, {w}::DOUBLE AS weight, round(sum(CASE WHEN theta = 1 THEN {(1 - w) / 2} ELSE {(1 + w) / 2} END * ({u})), 6) AS total,
    round(coalesce(sum(CASE WHEN theta <> 1 THEN {u} END), 0), 6) AS low_total FROM set_reach GROUP BY 1""" for k, u in _KINDS.items() for w in WEIGHTS)


def _reach(t):
    return FA.set_reach(B.membership(t), B.distances(t), B.people(t), t.lineitem.count())


def _all(t):
    """Sets, recorded pairs, people and the stand-in distance."""
    return B.membership(t), _reach(t), B.people(t), FAR


def _scores(t):
    s = FA.set_objectives(*_all(t), BETA, WEIGHTS)
    return s.withColumns({c: F.round(c, 6) for c in ("total", "low_total")})


def _one(t):
    """Unweighted probability scores: the plane of the frontier."""
    return _scores(t).filter((F.col("objective") == "prob") & (F.col("weight") == 0.0)).select("set_id", "total", "low_total")


_ONE = "SELECT set_id, total, low_total FROM set_scores WHERE objective = 'prob' AND weight = 0.0"


@query("fair_set_distance", sql("set_dist", "SELECT set_id, person, r FROM set_dist"))
def fair_set_distance(t):
    return FA.set_distance(B.membership(t), B.distances(t), t.lineitem.count())


@query("fair_set_objective", sql("set_scores", "SELECT set_id, objective, weight, total, low_total FROM set_scores"))
def fair_set_objective(t):
    return _scores(t)


@query("fair_combine", sql("set_scores", """SELECT a.set_id, round(a.total + 0.3::DOUBLE * b.total, 8) AS summed, round(0.35::DOUBLE * a.total + 0.65::DOUBLE * b.total, 8) AS balanced
       FROM set_scores a JOIN set_scores b ON a.set_id = b.set_id WHERE a.objective = 'distance' AND b.objective = 'prob' AND a.weight = 0 AND b.weight = 0"""))
def fair_combine(t):
    s = _scores(t).filter(F.col("weight") == 0.0)
    wide = s.groupBy("set_id").agg(*[F.max(F.when(F.col("objective") == k, F.col("total"))).alias(k) for k in ("distance", "prob")])
    return wide.select("set_id", F.round(FA.combine(F.col("distance"), F.col("prob"), 0.3), 8).alias("summed"),
                       F.round(FA.combine_balanced(F.col("distance"), F.col("prob"), 0.3), 8).alias("balanced"))


_BEST = "SELECT objective, weight, arg_max(set_id, {'s': total, 'i': -set_id}) AS set_id, max(total) AS best FROM set_scores GROUP BY 1, 2"


@query("fair_best_set", sql("set_scores", _BEST))
def fair_best_set(t):
    return FA.best_set(_scores(t), ["objective", "weight"])


@query("fair_lump", sql("set_scores", f"""SELECT set_id, string_agg(objective || '_' || CASE WHEN weight = 0 THEN '0.0' ELSE '0.5' END, ',' ORDER BY objective || '_' || CASE WHEN weight = 0 THEN '0.0' ELSE '0.5' END) AS objectives,
       count(*) AS n FROM ({_BEST}) GROUP BY 1"""))
def fair_lump(t):
    best = FA.best_set(_scores(t), ["objective", "weight"])
    return FA.lump(best, F.concat("objective", F.lit("_"), F.col("weight").cast("string")))


@query("fair_group_means", sql("set_reach", f"SELECT set_id, theta, round(avg(r) + 1e-12, 9) AS mean_distance, round(avg({_P}) + 1e-12, 9) AS mean_prob FROM set_reach GROUP BY 1, 2"))
def fair_group_means(t):
    # means of two-decimal distances can end exactly on a rounding tie: both engines step off it the same way
    return FA.group_means(*_all(t), BETA).withColumns({c: F.round(F.col(c) + F.lit(1e-12), 9) for c in ("mean_distance", "mean_prob")})


@query("fair_covariance", sql("set_reach", f"SELECT set_id, round(covar_pop(theta, {_P}), 8) + 0.0 AS cov FROM set_reach GROUP BY 1"))
def fair_covariance(t):
    return FA.covariance(*_all(t), BETA).withColumn("cov", F.round("cov", 8) + F.lit(0.0))


@query("fair_price", sql("set_reach", f"""SELECT set_id, round((max(d) OVER () - d) / abs(max(d) OVER ()), 6) + 0.0 AS price_dist, round((max(p) OVER () - p) / abs(max(p) OVER ()), 6) + 0.0 AS price_prob
       FROM (SELECT set_id, -sum(r) AS d, sum({_P}) AS p FROM set_reach GROUP BY 1)"""))
def fair_price(t):
    return FA.price_of_fairness(*_all(t), BETA).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("price_dist", "price_prob")})


@query("fair_pareto", sql("set_scores", f"SELECT * FROM ({_ONE}) a WHERE NOT EXISTS (SELECT 1 FROM ({_ONE}) b WHERE b.total > a.total AND b.low_total > a.low_total)"))
def fair_pareto(t):
    return FA.pareto(_one(t), "total", "low_total")


_EXT = f"""SELECT a.total AS a_star, a.low_total AS l_at_a_star, l.low_total AS l_star, l.total AS a_at_l_star FROM
    (SELECT * FROM ({_ONE}) ORDER BY total DESC, set_id LIMIT 1) a, (SELECT * FROM ({_ONE}) ORDER BY low_total DESC, set_id LIMIT 1) l"""


@query("fair_frontier_extremes", sql("set_scores", _EXT))
def fair_frontier_extremes(t):
    return FA.frontier_extremes(_one(t), "total", "low_total")


@query("fair_greedy_guarantee", sql("set_scores", f"""SELECT i, round(i / 5.0::DOUBLE, 6) AS alpha, round(i / 5.0::DOUBLE * (1 - exp(-1)) * l_star, 6) AS low, round((1 - i / 5.0::DOUBLE) * (1 - exp(-1)) * a_star, 6) AS total
       FROM (SELECT *, CAST(unnest(range(0, 6)) AS INTEGER) AS i FROM ({_EXT}))"""))
def fair_greedy_guarantee(t):
    g = FA.greedy_guarantee(FA.frontier_extremes(_one(t), "total", "low_total"), 5)
    return g.withColumns({c: F.round(c, 6) for c in ("alpha", "low", "total")})


@query("fair_assignment_cost", sql("distances people", """SELECT coalesce(CAST(grp AS VARCHAR), 'all') AS grp, round(avg(d * (0.8::DOUBLE * th + 1.7::DOUBLE * (1 - th))), 6) AS cost, count(*) AS n FROM
       (SELECT person, d, CAST(theta AS INTEGER) AS grp, CAST((person * 31 + s * 17) % 100 AS DOUBLE) / 100.0 AS th FROM
        (SELECT person, theta, min(dist) AS d, unnest(range(0, 4)) AS s FROM distances JOIN people USING (person) GROUP BY person, theta)) GROUP BY ROLLUP (grp)"""))
def fair_assignment_cost(t):
    nearest = B.distances(t).groupBy("person").agg(F.min("dist").alias("dist"))
    assigned = nearest.join(B.people(t), "person").select("person", "dist", F.col("theta").cast("int").alias("grp"))
    types = B.people(t).select("person", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scenario"))
    types = types.withColumn("theta", ((F.col("person") * 31 + F.col("scenario") * 17) % 100).cast("double") / 100.0)
    return FA.assignment_cost(assigned, types, 0.8, 1.7).withColumn("cost", F.round("cost", 6))
