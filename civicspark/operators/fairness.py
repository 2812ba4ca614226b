"""Scoring of candidate facility sets: nearest open facility, objectives, fairness indices, Pareto frontier."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions import scalars as S
from civicspark.operators import ordered as O
from civicspark.session import dealt, parts_for

GREEDY_SHARE = 1.0 - 1.0 / math.e


CUTS = 8  # at least: parts of a set's people that may lie in different tasks


def set_distance(membership: DataFrame, distances: DataFrame, pairs: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Per set and person: the distance to the nearest facility of the set.

    ``pairs``: about how many rows ``distances`` has, by which the work is dealt (0: the optimizer deals); ``keep``: columns of
    ``distances`` that a person has one value of. A set is dealt in few cuts, so that sums per set are small where they leave a task.
    """
    size = membership.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("facility").alias("facilities"), F.count_distinct("set_id").alias("sets")).first()
    rows = pairs * size["n"] // max(size["facilities"], 1)
    cuts = max(CUTS, 4 * parts_for(rows) // max(size["sets"], 1))
    met = distances.join(membership, "facility").withColumn("_cut", F.pmod(F.xxhash64("person"), F.lit(cuts)))
    nearest = dealt(met, rows, "set_id", "_cut").groupBy("set_id", "_cut", "person", *keep).agg(F.min("dist").alias("r"))
    return nearest.select("set_id", "person", *keep, "r")


def set_reach(membership: DataFrame, distances: DataFrame, people: DataFrame, pairs: int = 0) -> DataFrame:
    """``set_distance`` with each person's theta, a row for each row of the person in ``people``; people without one are left out.

    Theta joins the pairs, of which there are fewer than of sets and people. Equal rows of ``people`` become one with their number until
    the distances are known.
    """
    who = dealt(people, pairs, "person").groupBy("person", "theta").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    nearest = set_distance(membership, dealt(distances, pairs, "person").join(who, "person"), pairs, ["theta", "_n"])
    return nearest.select("set_id", "person", F.explode(F.array_repeat("theta", F.col("_n"))).alias("theta"), "r")


def utilities(theta: Column, r: Column, beta: Sequence[float]) -> dict[str, Column]:
    """Utility per person by objective kind: minus distance, success probability, its log."""
    one = F.lit(1.0)
    return {"distance": -r, "prob": S.logistic(one, theta, r, beta), "logprob": S.log_logistic(one, theta, r, beta)}


def over_everyone(sets: DataFrame, reach: DataFrame, people: DataFrame, far: float, figures: dict[str, Column]) -> DataFrame:
    """Per set: each figure (an expression over theta and r) summed over *all* people, ``far`` standing in where r is not recorded.

    ``sets``: set_id; ``reach``: set_id, theta, r of recorded pairs; ``people``: theta. No set meets the people it lacks: the sum over
    all people at ``far`` is one number, to which a set's recorded pairs add their difference. People and pairs without theta
    take no part.
    """
    at_far = people.filter(F.col("theta").isNotNull()).withColumn("r", F.lit(float(far)))
    base = at_far.agg(F.struct(*[F.coalesce(F.sum(f), F.lit(0.0)).alias(n) for n, f in figures.items()]).alias("b")).scalar()
    known = reach.filter("theta IS NOT NULL AND r IS NOT NULL").select("set_id", "theta", "r", *[f.alias(f"_at_{n}") for n, f in figures.items()])
    known = known.withColumn("r", F.lit(float(far))).select("set_id", *[(F.col(f"_at_{n}") - f).alias(n) for n, f in figures.items()])
    sums = known.groupBy(F.col("set_id").alias("_set")).agg(*[F.sum(n).alias(n) for n in figures])
    joined = sets.select("set_id").distinct().join(sums, F.col("set_id") == F.col("_set"), "left").withColumn("_b", base)
    return joined.select("set_id", *[(F.coalesce(F.col(n), F.lit(0.0)) + F.col(f"_b.{n}")).alias(n) for n in figures])


def set_objectives(sets: DataFrame, reach: DataFrame, people: DataFrame, far: float, beta: Sequence[float], weights: Sequence[float]) -> DataFrame:
    """Long scores (set_id, objective, weight, total, low_total); the high group weighs (1 - w)/2, others (1 + w)/2.

    ``low_total`` sums the low group's raw utilities. Every set is scored on all people (see ``over_everyone``).
    """
    high = F.col("theta") == F.lit(1.0)
    kinds = utilities(F.col("theta"), F.col("r"), beta)
    figures = {}
    for kind, u in kinds.items():
        figures |= {f"{kind}_high": F.when(high, u).otherwise(0.0), f"{kind}_low": F.when(high, 0.0).otherwise(u)}
    sums = over_everyone(sets, reach, people, far, figures)
    rows = []
    for kind in kinds:
        hi, lo = F.col(f"{kind}_high"), F.col(f"{kind}_low")
        rows += [F.struct(F.lit(kind).alias("objective"), F.lit(float(w)).alias("weight"),
                          (hi * F.lit((1 - w) / 2) + lo * F.lit((1 + w) / 2)).alias("total"), lo.alias("low_total")) for w in weights]
    return sums.select("set_id", F.explode(F.array(*rows)).alias("s")).select("set_id", "s.*")


def combine(first: Column, second: Column, weight: float) -> Column:
    """first + weight * second."""
    return first + F.lit(weight) * second


def combine_balanced(first: Column, second: Column, weight: float) -> Column:
    """(1 - w)/2 of the first and (1 + w)/2 of the second."""
    return F.lit((1 - weight) / 2) * first + F.lit((1 + weight) / 2) * second


def best_set(scores: DataFrame, keys: Sequence[str], score: str = "total") -> DataFrame:
    """The set with the largest score per objective; the smallest id wins a tie."""
    return scores.groupBy(*keys).agg(F.max_by("set_id", F.struct(F.col(score), -F.col("set_id"))).alias("set_id"), F.max(score).alias("best"))


def lump(best: DataFrame, label: Column) -> DataFrame:
    """Objectives that choose the same set become one line; their number is the number of objectives at most."""
    return best.groupBy("set_id").agg(F.concat_ws(",", F.array_sort(F.collect_list(label))).alias("objectives"), F.count(F.lit(1)).alias("n"))


def group_means(sets: DataFrame, reach: DataFrame, people: DataFrame, far: float, beta: Sequence[float], groups: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """Mean distance and probability of each group of people per set; a group without people has NULL means."""
    p = S.logistic(F.lit(1.0), F.col("theta"), F.col("r"), beta)
    figures = {}
    for i, g in enumerate(groups):
        mine = F.col("theta") == F.lit(float(g))
        figures |= {f"d{i}": F.when(mine, F.col("r")).otherwise(0.0), f"p{i}": F.when(mine, p).otherwise(0.0)}
    sums = over_everyone(sets, reach, people, far, figures)
    sizes = people.agg(F.array(*[F.count_if(F.col("theta") == F.lit(float(g))) for g in groups]).alias("n")).scalar()
    rows = F.array(*[F.struct(F.lit(float(g)).alias("theta"), F.col(f"d{i}").alias("d"), F.col(f"p{i}").alias("p"), F.nullif(F.col("_n")[i], F.lit(0)).alias("n"))
                     for i, g in enumerate(groups)])
    return (sums.withColumn("_n", sizes).select("set_id", F.explode(rows).alias("g"))
            .select("set_id", "g.theta", (F.col("g.d") / F.col("g.n")).alias("mean_distance"), (F.col("g.p") / F.col("g.n")).alias("mean_prob")))


def covariance(sets: DataFrame, reach: DataFrame, people: DataFrame, far: float, beta: Sequence[float]) -> DataFrame:
    """Population covariance of group value and success probability per set, over all people."""
    p = S.logistic(F.lit(1.0), F.col("theta"), F.col("r"), beta)
    centre = people.agg(F.struct(F.avg("theta").alias("mean"), F.count("theta").alias("n")).alias("c")).scalar()
    sums = over_everyone(sets, reach, people, far, {"p": p, "tp": p * F.col("theta")})
    return sums.withColumn("_c", centre).select("set_id", (F.col("tp") / F.col("_c.n") - F.col("p") / F.col("_c.n") * F.col("_c.mean")).alias("cov"))


def price_of_fairness(sets: DataFrame, reach: DataFrame, people: DataFrame, far: float, beta: Sequence[float]) -> DataFrame:
    """(best - own) / |best| per set, for total distance and total probability over all people."""
    p = S.logistic(F.lit(1.0), F.col("theta"), F.col("r"), beta)
    own = over_everyone(sets, reach, people, far, {"dist": -F.col("r"), "prob": p})
    best = own.agg(F.struct(F.max("dist").alias("dist"), F.max("prob").alias("prob")).alias("b")).scalar()
    rated = own.withColumn("_b", best)
    return rated.select("set_id", *[S.ratio(F.col(f"_b.{c}") - F.col(c), F.abs(F.col(f"_b.{c}"))).alias(f"price_{c}") for c in ("dist", "prob")])


def pareto(scores: DataFrame, f: str, g: str) -> DataFrame:
    """Rows that no other row beats strictly on both ``f`` and ``g``.

    The best ``g`` among strictly larger ``f`` is a running maximum over distinct ``f``, cut into value
    ranges: no task sees the whole table and no pair of rows is formed.
    """
    steps = scores.groupBy(F.col(f).alias("_f")).agg(F.max(g).alias("_g"))
    above = O.running(steps, [], [-F.col("_f")], {"_above": ("max", F.col("_g"))}, strict=True)
    j = scores.join(above.select("_f", "_above"), F.col(f) == F.col("_f"))
    return j.filter(F.col("_above").isNull() | (F.col("_above") <= F.col(g))).select(*scores.columns)


def frontier_extremes(scores: DataFrame, f: str, g: str) -> DataFrame:
    """Best total with its low-group value, best low-group value with its total (ties: smallest set id)."""
    top_f = F.max_by(F.struct(f, g), F.struct(F.col(f), -F.col("set_id")))
    top_g = F.max_by(F.struct(f, g), F.struct(F.col(g), -F.col("set_id")))
    e = scores.agg(top_f.alias("a"), top_g.alias("l"))
    return e.select(F.col(f"a.{f}").alias("a_star"), F.col(f"a.{g}").alias("l_at_a_star"), F.col(f"l.{g}").alias("l_star"), F.col(f"l.{f}").alias("a_at_l_star"))


def greedy_guarantee(extremes: DataFrame, k: int) -> DataFrame:
    """k + 1 guaranteed points between the two extremes."""
    e = extremes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("alpha", F.col("i") / F.lit(k))
    share = F.lit(GREEDY_SHARE)
    return e.select("i", "alpha", (F.col("alpha") * share * F.col("l_star")).alias("low"), ((F.lit(1.0) - F.col("alpha")) * share * F.col("a_star")).alias("total"))


def assignment_cost(assigned: DataFrame, types: DataFrame, d_low: float, d_high: float) -> DataFrame:
    """Mean travel cost over scenarios and people, overall and per group.

    ``assigned``: (person, grp, dist); ``types``: (scenario, person, theta), theta in 0..1 mixes the two modes.
    """
    j = assigned.join(types, "person")
    cost = F.col("dist") * (F.lit(d_low) * F.col("theta") + F.lit(d_high) * (F.lit(1.0) - F.col("theta")))
    return j.rollup("grp").agg(F.avg(cost).alias("cost"), F.count(F.lit(1)).alias("n")).withColumn("grp", F.coalesce(F.col("grp").cast("string"), F.lit("all")))
