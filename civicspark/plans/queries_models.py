"""Feature engineering and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import features as FE
from civicspark.operators import joins as J
from civicspark.operators import models as M
from civicspark.operators import sampling as SA
from civicspark.plans import bindings as B
from civicspark.functions.hashing import HASH_SPACE, key_hash_sql
from civicspark.plans.bindings import CTES, NEEDS, sql
from civicspark.plans.registry import query
from civicspark.session import materialise

CATEGORIES = ["demo", "sex"]
NUMERIC = ["age", "distance", "fraction_no_vehicle", "popDensity"]
ELECTION = "2000-11-08"

CTES["model_rows"] = f"""SELECT v.*, CAST(v.voter_key * 37 % 1000 AS DOUBLE) / 10.0 AS distance, tr.total, tr.land, tr.no_vehicle, tr.one_vehicle, tr.two_vehicles, h.vote_method
    FROM raw_voters v JOIN tracts tr ON v.tract_geoid = tr.geo_id LEFT JOIN (SELECT voter_id, max(vote_method) AS vote_method FROM history WHERE election_at = '{ELECTION}' GROUP BY 1) h
    ON v.voter_key = h.voter_id"""


def model_rows(t):
    """Voters with tract counts, a distance and the method used in one election."""
    once = B.history(t).filter(F.col("election_at") == ELECTION).groupBy("voter_id").agg(F.max("vote_method").alias("vote_method"))
    tr = B.tracts(t).select("geo_id", "total", "land", "no_vehicle", "one_vehicle", "two_vehicles")
    v = B.raw_voters(t).withColumn("distance", (F.col("voter_key") * 37 % 1000).cast("double") / 10.0)
    return (v.join(tr, F.col("tract_geoid") == F.col("geo_id")).drop("geo_id")
            .join(once.withColumnRenamed("voter_id", "_v"), F.col("voter_key") == F.col("_v"), "left").drop("_v"))


def _prepared(t):
    shares = {"fraction_no_vehicle": ["no_vehicle"], "fraction_some_vehicle": ["one_vehicle", "two_vehicles"]}
    rows = model_rows(t).withColumnRenamed("dob", "age")
    return FE.prepare(rows, ["registered_at"], ("registered_at", "2016-11-08"), ["distance"], ["age"], "vote_method", shares, "total", "land")


def _encoded(t):
    df = _prepared(t).na.drop(subset=["vote_method", *NUMERIC])
    enc, labels, pipeline = FE.encode(df, CATEGORIES)
    return enc, labels


def _inputs():
    return [*NUMERIC, *[f"{c}_hot" for c in CATEGORIES]]


def _assembled(t):
    enc, labels = _encoded(t)
    return FE.assemble(enc, _inputs(), "vote_method"), labels


@query("ml_index", sql("raw_voters", """SELECT sex, CAST(row_number() OVER (ORDER BY n DESC, sex) - 1 AS DOUBLE) AS idx, n FROM
       (SELECT CASE WHEN sex = '' THEN 'NA' ELSE sex END AS sex, count(*) AS n FROM raw_voters GROUP BY 1)"""))
def ml_index(t):
    enc, _, _ = FE.encode(B.raw_voters(t).select("voter_key", "sex"), ["sex"], one_hot=False)
    return enc.groupBy("sex", F.col("sex_index").alias("idx")).agg(F.count(F.lit(1)).alias("n"))


def _hot(t, cols):
    enc, labels, _ = FE.encode(B.raw_voters(t).select("voter_key", *cols), cols)
    for c in cols:
        enc = FE.vector_to_columns(enc, f"{c}_hot", labels[c][:-1])
    return enc.drop(*[f"{c}_index" for c in cols]), labels


_SEX = "CASE WHEN sex = '' THEN 'NA' ELSE sex END"

# rows ready for a model, and the categories of their columns by falling frequency
CTES["prep"] = f"""SELECT voter_key, {_SEX} AS sex, demo, CAST(tract_geoid AS VARCHAR) AS tract, CASE WHEN vote_method = 'voted' THEN 1.0::DOUBLE ELSE 0.0 END AS y,
    date_diff('day', try_cast(dob AS DATE), DATE '2021-02-18') * (1 / 365.0::DOUBLE) AS age, distance, CAST(no_vehicle AS DOUBLE) / total AS fraction_no_vehicle,
    CAST(total AS DOUBLE) / nullif(land, 0) AS "popDensity" FROM model_rows WHERE try_cast(registered_at AS DATE) <= DATE '2016-11-08'"""
CTES["whole"] = 'SELECT * FROM prep WHERE age IS NOT NULL AND distance IS NOT NULL AND fraction_no_vehicle IS NOT NULL AND "popDensity" IS NOT NULL'
NEEDS |= {"model_rows": ["raw_voters", "tracts", "history"], "prep": ["model_rows"], "whole": ["prep"]}


def _categories_sql(source: str, cols) -> str:
    """column, category and place of the categories of some columns, most frequent first; ``last`` is the base."""
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS category FROM {source}" for c in cols)
    return f"""SELECT *, place = count(*) OVER (PARTITION BY "column") AS last FROM (SELECT "column", category, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, category) AS place
        FROM ({each}) GROUP BY 1, 2)"""


def _totals_sql(rows: str, numeric, categories: str, cols) -> str:
    """Sum of y x for each input of a model: the intercept, the numbers and every category but the base."""
    parts = [f"SELECT '(intercept)' AS \"column\", '' AS category, sum(y) AS total FROM {rows}"]
    parts += [f"SELECT '{c}', '', sum(y * \"{c}\") FROM {rows}" for c in numeric]
    parts += [f"SELECT '{c}', k.category, coalesce(sum(r.y) FILTER (r.{c} = k.category), 0) FROM ({categories}) k, {rows} r WHERE k.\"column\" = '{c}' AND NOT k.last GROUP BY 2" for c in cols]
    return " UNION ALL ".join(parts)


def newton_sql(source: str, xs, rounds: int = 9) -> str:
    """SQL of one row b0, b1, ...: the logistic model of y on the columns ``xs`` of ``source``, by Newton steps solved with L D L'."""
    d = len(xs) + 1
    x = ["1.0", *[f'"{c}"' for c in xs]]
    z = " + ".join(f"b{i} * {x[i]}" for i in range(d))
    sums = [f"sum((y - p) * {x[i]}) AS g{i}" for i in range(d)] + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(d) for j in range(i + 1)]
    # each figure is a query of its own around those before it: an alias used again in its own SELECT would be written out anew each time
    solve = []
    for j in range(d):
        solve.append([f"h{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f" AS d{j}"])
        solve.append([f"(h{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}_{j}" for i in range(j + 1, d)])
    solve += [[f"g{i}" + "".join(f" - l{i}_{k} * f{k}" for k in range(i)) + f" AS f{i}"] for i in range(d)]
    solve += [[f"f{i} / d{i}" + "".join(f" - l{k}_{i} * s{k}" for k in range(i + 1, d)) + f" AS s{i}"] for i in reversed(range(d))]
    steps = ["n0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(d)) + ")"]
    for r in range(rounds):
        solved = f"(SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM {source}, n{r}))"
        for figures in filter(None, solve):
            solved = f"(SELECT *, {', '.join(figures)} FROM {solved})"
        steps.append(f"n{r + 1} AS MATERIALIZED (SELECT " + ", ".join(f"b{i} + s{i} AS b{i}" for i in range(d)) + f" FROM {solved}, n{r})")
    return f"(WITH {', '.join(steps)} SELECT * FROM n{rounds})"


@query("ml_onehot", sql("raw_voters", """SELECT voter_key, CASE WHEN sex = '' THEN 'NA' ELSE sex END AS sex, CASE WHEN sex = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS "sex_hot[F]",
       CASE WHEN sex = 'M' THEN 1.0::DOUBLE ELSE 0.0 END AS "sex_hot[M]" FROM raw_voters"""))
def ml_onehot(t):
    return _hot(t, ["sex"])[0]


@query("ml_onehot_many", sql("raw_voters", f"""SELECT v.voter_key, k."column", k.category, CASE WHEN k.category = CASE k."column" WHEN 'demo' THEN v.demo ELSE {_SEX} END THEN 1.0::DOUBLE ELSE 0.0 END AS value
       FROM raw_voters v, ({_categories_sql(f"(SELECT demo, {_SEX} AS sex FROM raw_voters)", CATEGORIES)}) k WHERE NOT k.last"""))
def ml_onehot_many(t):
    """All columns encoded by one pipeline, as rows."""
    wide, labels = _hot(t, CATEGORIES)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(v).alias("category"), F.col(f"`{c}_hot[{v}]`").alias("value")) for c in CATEGORIES for v in labels[c][:-1]]
    return wide.select("voter_key", F.inline(F.array(*cells)))


@query("ml_assemble", sql("raw_voters tracts history model_rows", """SELECT * FROM (SELECT CASE WHEN vote_method = 'voted' THEN 1.0::DOUBLE ELSE 0.0 END AS label,
       round(date_diff('day', try_cast(dob AS DATE), DATE '2021-02-18') * (1 / 365.0::DOUBLE), 8) AS "features[0]", distance AS "features[1]", round(CAST(no_vehicle AS DOUBLE) / total, 8) AS "features[2]",
       round(CAST(total AS DOUBLE) / nullif(land, 0), 8) AS "features[3]" FROM model_rows WHERE try_cast(registered_at AS DATE) <= DATE '2016-11-08')
       WHERE label IS NOT NULL AND "features[0]" IS NOT NULL AND "features[1]" IS NOT NULL AND "features[2]" IS NOT NULL AND "features[3]" IS NOT NULL"""))
def ml_assemble(t):
    flat = FE.vector_to_columns(_assembled(t)[0], "features", [str(i) for i in range(len(NUMERIC))])
    return flat.withColumns({c: F.round(f"`{c}`", 8) for c in flat.columns if c.startswith("features")})


@query("ml_prepare", sql("raw_voters tracts history model_rows", """SELECT voter_key, round(date_diff('day', try_cast(dob AS DATE), DATE '2021-02-18') * (1 / 365.0::DOUBLE), 8) AS age, distance,
       CASE WHEN vote_method = 'voted' THEN 1 ELSE 0 END AS vote_method, round(CAST(no_vehicle AS DOUBLE) / total, 8) AS fraction_no_vehicle,
       round(CAST(one_vehicle + two_vehicles AS DOUBLE) / total, 8) AS fraction_some_vehicle, round(CAST(total AS DOUBLE) / nullif(land, 0), 8) AS "popDensity"
       FROM model_rows WHERE try_cast(registered_at AS DATE) <= DATE '2016-11-08'"""))
def ml_prepare(t):
    p = _prepared(t)
    rounded = ["age", "fraction_no_vehicle", "fraction_some_vehicle", "popDensity"]
    return p.select("voter_key", "distance", "vote_method", *[F.round(c, 8).alias(c) for c in rounded])


def _one_row(t, name, value):
    """A fitted figure as a one-row table."""
    return t.spark.createDataFrame([(name, float(value))], "model string, auc double")


def _split(t):
    """Training and test rows by the voter's hash, stored once: fitting reads them many times."""
    enc, _ = _encoded(t)
    rows = materialise(SA.hash_split(FE.assemble(enc, _inputs(), "vote_method", ["voter_key"]), "voter_key"), "model_rows")
    return rows.filter("is_train = 1"), rows.filter("is_train = 0")


def _category_rows(df, cols):
    """Rows with blank categories named, and the categories of each column by falling frequency."""
    clean, labels, _ = FE.encode(df, cols, one_hot=False)
    return clean, labels


@query("ml_logistic", sql("whole", f"""SELECT "column", category, round(total, 2) AS fitted_total FROM ({_totals_sql(
    f"(SELECT * FROM whole WHERE {key_hash_sql('voter_key')} < {int(0.8 * HASH_SPACE)})", NUMERIC, _categories_sql("whole", CATEGORIES), CATEGORIES)})"""))
def ml_logistic(t):
    """The score equations of the model fitted on the training rows: its expected totals are the totals that the data show."""
    df, labels = _category_rows(_prepared(t).na.drop(subset=["vote_method", *NUMERIC]), CATEGORIES)
    train = materialise(SA.hash_split(df, "voter_key").filter("is_train = 1"), "train")
    fit = M.newton_logistic(train, NUMERIC, labels, "vote_method")
    return M.fitted_totals(train, fit, "vote_method").withColumn("fitted_total", F.round("fitted_total", 2))


@query("ml_mlp")
def ml_mlp(t):
    train, test = _split(t)
    inputs = train.select("features").first()["features"].size
    return _one_row(t, "perceptron", M.area_under_roc(M.perceptron(train, inputs).transform(test)))


@query("ml_tree")
def ml_tree(t):
    train, test = _split(t)
    return _one_row(t, "tree", M.area_under_roc(M.tree(train).transform(test)))


_RANK = "SELECT label, score, avg(rn) OVER (PARTITION BY score) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM scored)"


@query("ml_auc", sql("scored", f"""SELECT round((sum(CASE WHEN label = 1 THEN rank END) - p * (p + 1) / 2) / (p * n), 8) AS auc FROM ({_RANK}),
       (SELECT CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (label <> 1) AS DOUBLE) AS n FROM scored) GROUP BY p, n"""))
def ml_auc(t):
    return M.auc(B.scored(t)).withColumn("auc", F.round("auc", 8))


_STEPS = """SELECT score, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS DOUBLE) AS p, CAST(sum(neg) OVER () AS DOUBLE) AS n FROM
    (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM scored GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"""


@query("ml_roc_points", sql("scored", f"SELECT score, tp, fp, round(fp / n, 8) AS fpr, round(tp / p, 8) AS tpr FROM ({_STEPS})"))
def ml_roc_points(t):
    return M.roc_points(B.scored(t)).withColumns({c: F.round(c, 8) for c in ("fpr", "tpr")})


@query("ml_best_f_threshold", sql("scored", f"""SELECT arg_max(score, {{'f': f, 's': score}}) AS threshold, round(max(f), 8) AS f_measure FROM (SELECT score, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM
       (SELECT score, CAST(tp AS DOUBLE) / (tp + fp) AS pr, tp / p AS re FROM ({_STEPS})))"""))
def ml_best_f_threshold(t):
    return M.best_f_threshold(B.scored(t)).withColumn("f_measure", F.round("f_measure", 8))


@query("ml_coef_table", sql("whole", 'SELECT "column", \'\' AS category, round(coefficient, 6) AS coefficient FROM (SELECT unnest([\'(intercept)\', '
       + ", ".join(f"'{c}'" for c in NUMERIC) + ']) AS "column", unnest([b0, b1, b2, b3, b4]) AS coefficient FROM ' + newton_sql("whole", NUMERIC) + ")"))
def ml_coef_table(t):
    rows = _prepared(t).na.drop(subset=["vote_method", *NUMERIC])
    return M.fit_table(t.spark, M.newton_logistic(rows, NUMERIC, {}, "vote_method"), {}).withColumn("coefficient", F.round("coefficient", 6))


DISTANCES = ["distance", "distance_early", "distance_drop"]


def _distance_rows(t):
    """Three distances per voter: to the polling place, the early site and the drop box."""
    k = F.col("voter_key")
    rows = _prepared(t).na.drop(subset=["vote_method", "distance"])
    return rows.withColumns({"distance_early": (k * 53 % 700).cast("double") / 10.0, "distance_drop": (k * 91 % 400).cast("double") / 10.0})


CTES["three"] = "SELECT *, CAST(voter_key * 53 % 700 AS DOUBLE) / 10.0 AS distance_early, CAST(voter_key * 91 % 400 AS DOUBLE) / 10.0 AS distance_drop FROM prep WHERE distance IS NOT NULL"
NEEDS |= {"three": ["prep"]}
_MARGIN = "b0 + b1 * distance + b2 * distance_early + b3 * distance_drop"


@query("ml_counterfactual", sql("three", f"""SELECT distance, multiplier, round(avg(p), 6) AS turnout, round(avg(CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS turnout_hard,
       round(avg(far), 6) AS mean_distance, round(stddev(far), 6) AS stdev_distance, count(*) AS n FROM (SELECT distance, multiplier, far, 1 / (1 + exp(-(z + b * x * (multiplier - 1)))) AS p FROM
       (SELECT z, multiplier, unnest(['distance', 'distance_early', 'distance_drop']) AS distance, unnest([distance, distance_early, distance_drop]) AS x, unnest([b1, b2, b3]) AS b,
        unnest([distance * multiplier, distance_early * multiplier, distance_drop * multiplier]) AS far
        FROM (SELECT *, {_MARGIN} AS z, unnest([{', '.join(f'{m!r}::DOUBLE' for m in M.MULTIPLIERS)}]) AS multiplier FROM three, {newton_sql("three", DISTANCES)}))) GROUP BY 1, 2"""))
def ml_counterfactual(t):
    """Turnout under each of three distances scaled by eight multipliers: one pass over the rows."""
    rows = materialise(_distance_rows(t).select("vote_method", *DISTANCES), "distances")
    out = M.counterfactual(M.newton_logistic(rows, DISTANCES, {}, "vote_method"), rows, DISTANCES)
    return out.withColumns({c: F.round(c, 6) for c in ("turnout", "turnout_hard", "mean_distance", "stdev_distance")})


@query("ml_counterfactual_tree")
def ml_counterfactual_tree(t):
    """The same by a decision tree, whose thresholds on the scaled distance move."""
    rows = materialise(_distance_rows(t).select("vote_method", *DISTANCES), "distances")
    model = M.tree(FE.assemble(rows, DISTANCES, "vote_method"))
    return M.tree_counterfactual(model, rows, [F.col(c) for c in DISTANCES], {c: i for i, c in enumerate(DISTANCES)})


def _tract_rows(t):
    """Order lines by the supplier's nation: outcome, a distance, one more number, and an activity flag."""
    li = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey"), F.col("l_quantity").alias("distance"), F.col("l_discount").alias("discount"),
                           (F.col("l_linestatus") == "F").cast("int").alias("outcome"), (F.col("l_returnflag") != "N").alias("active"))
    return li.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("s_nationkey", "tract").drop("s_name", "s_acctbal", "s_suppkey", "l_suppkey")


@query("ml_per_tract")
def ml_per_tract(t):
    return M.per_group_sensitivity(_tract_rows(t), "tract", "key", ["distance", "discount"], "distance", "outcome", F.col("active"))


_TOP_TRACTS = "(SELECT * FROM whole WHERE tract IN (SELECT tract FROM whole GROUP BY 1 ORDER BY count(*) DESC, tract LIMIT 8))"


@query("ml_fixed_effect", sql("whole", f"""SELECT "column", category, round(total, 2) AS fitted_total FROM ({_totals_sql(_TOP_TRACTS, NUMERIC, _categories_sql(_TOP_TRACTS, ["tract"]), ["tract"])})"""))
def ml_fixed_effect(t):
    """The tract as a category, on the rows of the most frequent tracts; checked by the score equations."""
    df = _prepared(t).na.drop(subset=NUMERIC).withColumn("tract", F.col("tract_geoid").cast("string"))
    top, labels = _category_rows(J.semi(df, J.top_keys(df, "tract", 8), "tract", "tract"), ["tract"])
    top = materialise(top, "top_tracts")
    fit = M.newton_logistic(top, NUMERIC, labels, "vote_method")
    return M.fitted_totals(top, fit, "vote_method").withColumn("fitted_total", F.round("fitted_total", 2))


@query("ml_linear_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem")
def ml_linear_trend(t):
    return M.linear_trend(t.lineitem, "l_quantity", "l_extendedprice").withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4)})
