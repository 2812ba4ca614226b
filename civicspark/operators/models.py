"""Turnout models: MLlib classifiers, ROC curves, counterfactual distance, one model per tract."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.hashing import HASH_SPACE, key_hash
from civicspark.operators import ordered as O
from civicspark.operators.joins import join_keys
from civicspark.session import materialise

# The multipliers applied to the distance, eight even steps from 0.05 to 2.
MULTIPLIERS = [0.05 + (2.0 - 0.05) * k / 7 for k in range(8)]
RIDGE = 1e-8


def logistic(train: DataFrame):
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=10).fit(train)


def perceptron(train: DataFrame, inputs: int):
    layers = [inputs, 40, 40, 2]
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=layers, maxIter=100, seed=1234).fit(train)


def tree(train: DataFrame):
    return DecisionTreeClassifier(featuresCol="features", labelCol="label").fit(train)


def roc_steps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (and group): positives and negatives there, and among scores at least as high."""
    by = list(by)
    steps = df.groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return O.running(steps, by, [-F.col("score")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})


def _with_totals(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        totals = steps.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        return join_keys(steps, totals, list(by))
    total = steps.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t")).scalar()
    return steps.withColumn("_t", total).withColumn("_p", F.col("_t.p")).withColumn("_n", F.col("_t.n")).drop("_t")


def roc_points(df: DataFrame) -> DataFrame:
    """False and true positive rate per distinct score, highest first."""
    s = _with_totals(roc_steps(df), [])
    return s.select("score", "tp", "fp", (F.col("fp") / F.nullif(F.col("_n"), F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif(F.col("_p"), F.lit(0))).alias("tpr"))


def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact rank-sum area: ties count half. NULL for groups with one class."""
    s = _with_totals(roc_steps(df, by), by)
    part = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    return s.groupBy(*by).agg((F.sum(part) / F.nullif(F.max(F.col("_p").cast("double") * F.col("_n")), F.lit(0.0))).alias("auc"))


def area_under_roc(predictions: DataFrame) -> float:
    """The exact area for a fitted classifier's probabilities."""
    return auc(predictions.select("label", vector_to_array("probability")[1].alias("score"))).first()["auc"]


def best_f_threshold(df: DataFrame) -> DataFrame:
    """The score threshold with the largest F-measure (ties: the higher score)."""
    s = _with_totals(roc_steps(df), [])
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("_p"), F.lit(0))
    f = F.lit(2.0) * precision * recall / F.nullif(precision + recall, F.lit(0.0))
    rated = s.withColumn("f", F.coalesce(f, F.lit(0.0)))
    return rated.agg(F.max_by("score", F.struct("f", "score")).alias("threshold"), F.max("f").alias("f_measure"))


@dataclass(frozen=True)
class Fit:
    """A logistic model: ``coefficients`` (intercept first), the columns they belong to, and whether the steps came to rest."""

    columns: list[tuple[str, str]]
    coefficients: list[float]
    converged: bool

    def inputs(self) -> list[Column]:
        """The columns as numbers; a category is 1 where its column has that value."""
        return [F.lit(1.0), *[F.col(c).cast("double") if not v else (F.col(c) == v).cast("double") for c, v in self.columns[1:]]]

    def margin(self) -> Column:
        return reduce(add, [x * F.lit(b) for x, b in zip(self.inputs(), self.coefficients, strict=True)])


def newton_logistic(df: DataFrame, numeric: Sequence[str], categories: dict[str, list[str]], label: str, iterations: int = 30, tolerance: float = 1e-12) -> Fit:
    """The maximum-likelihood logistic model of a 0/1 label on numbers and categories (the last of each is the base).

    Newton steps: a step is one pass in which every task adds up gradient and Hessian of its rows, d + d * d numbers, which are summed by
    place; the d unknowns are solved for on the driver. Steps that do not gain likelihood are halved. Rows with a NULL, NaN or
    infinite input take no part.
    """
    columns = [("(intercept)", ""), *[(c, "") for c in numeric], *[(c, v) for c, values in categories.items() for v in values[:-1]]]
    d = len(columns)
    inputs = Fit(columns, [0.0] * d, False).inputs()
    rows = df.select(F.array(*inputs).alias("x"), F.col(label).cast("double").alias("y"))
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    rows = materialise(rows.filter(finite & F.col("y").isNotNull()), "training")
    schema = pa.schema([("place", pa.int32()), ("value", pa.float64())])

    def sums_at(beta: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + d + d * d)
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                z = x @ beta
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                total[0] += np.sum(y * z - np.logaddexp(0, z))
                total[1:1 + d] += (y - p) @ x
                total[1 + d:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=schema)

        out = np.zeros(1 + d + d * d)
        for r in rows.mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            out[r.place] = r.value
        return out

    beta, done = np.zeros(d), False
    best = sums_at(beta)
    for _ in range(iterations):
        gradient, hessian = best[1:1 + d], best[1 + d:].reshape(d, d)
        scale = np.sqrt(np.diag(hessian) + 1e-300)  # inputs of one size, so that the solver's cut-off treats them alike
        step = np.linalg.lstsq(hessian / np.outer(scale, scale) + RIDGE * 1e-4 * np.eye(d), gradient / scale, rcond=None)[0] / scale
        gain = float(gradient @ step)  # Newton's decrement: twice the likelihood still to gain
        if gain < tolerance:
            done = True
            break
        tried = sums_at(beta + step)
        while tried[0] < best[0] - 1e-9 * abs(best[0]):
            step = step / 2
            tried = sums_at(beta + step)
        beta, best = beta + step, tried
    return Fit(columns, beta.tolist(), done)


def fitted_totals(df: DataFrame, fit: Fit, label: str) -> DataFrame:
    """Per coefficient: the model's expected total of its input over the outcomes, sum of p x. At the likelihood's maximum, and only there,
    this is what the data show, sum of y x (the score equations)."""
    inputs = fit.inputs()
    whole = reduce(and_, [x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) for x in [*inputs, F.col(label).cast("double")]])
    p = _sigmoid(fit.margin())
    sums = df.filter(whole).agg(*[F.sum(p * x).alias(f"_{i}") for i, x in enumerate(inputs)])
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(v).alias("category"), F.col(f"_{i}").alias("fitted_total")) for i, (c, v) in enumerate(fit.columns)])
    return sums.select(F.inline(named))


def fit_table(spark, fit: Fit, categories: dict[str, list[str]]) -> DataFrame:
    """As many rows as the model has coefficients, and 0 for each base category."""
    rows = [(c, v, float(b)) for (c, v), b in zip(fit.columns, fit.coefficients, strict=True)] + [(c, v[-1], 0.0) for c, v in categories.items()]
    return spark.createDataFrame(rows, "column string, category string, coefficient double")


def _scaled_means(df: DataFrame, predictions: dict[tuple[str, float], Sequence[tuple[str, Column]]]) -> DataFrame:
    """One aggregation for all distances and multipliers, then a row for each."""
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for k, ((distance, m), outs) in enumerate(predictions.items()):
        far = F.col(distance).cast("double") * F.lit(float(m))
        aggs += [F.avg(far).alias(f"_mean{k}"), F.stddev(far).alias(f"_sd{k}"), *[F.avg(c).alias(f"_{n}{k}") for n, c in outs]]
        rows.append(F.struct(F.lit(distance).alias("distance"), F.lit(float(m)).alias("multiplier"), *[F.col(f"_{n}{k}").alias(n) for n, _ in outs],
                             F.col(f"_mean{k}").alias("mean_distance"), F.col(f"_sd{k}").alias("stdev_distance"), F.col("_n").alias("n")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def counterfactual(fit: Fit, df: DataFrame, distances: Sequence[str], multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """Mean predicted turnout (probability, and share above one half) with one distance scaled: a row per distance and multiplier.

    Scaling shifts the margin by coefficient * distance * (m - 1): one pass over the rows, which are sent through no model twice.
    """
    at = {c: b for (c, v), b in zip(fit.columns, fit.coefficients, strict=True) if not v}
    out = {}
    for distance in distances:
        for m in multipliers:
            p = _sigmoid(fit.margin() + F.lit(at[distance]) * F.col(distance).cast("double") * F.lit(float(m) - 1.0))
            out[distance, m] = [("turnout", p), ("turnout_hard", (p > 0.5).cast("double"))]
    return _scaled_means(df, out)


def tree_counterfactual(model, df: DataFrame, inputs: Sequence[Column], distances: dict[str, int], multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """The same for a fitted decision tree: ``distances`` maps a column to its place among the ``inputs``.

    ``m x <= t`` is ``x <= t / m``: only the thresholds on the scaled distance move, and the tree is one expression per multiplier.
    """
    root = model._call_java("rootNode")

    def grow(node, moved: int, m: float) -> Column:
        if node.subtreeDepth() == 0:
            counts = list(node.impurityStats().stats())
            return F.lit(float(counts[1] / max(sum(counts), 1e-300)))
        split = node.split()
        x = inputs[split.featureIndex()]
        if "Continuous" in split.getClass().getSimpleName():
            left = x <= F.lit(split.threshold() / (m if split.featureIndex() == moved else 1.0))
        else:
            left = x.isin(list(split.leftCategories()))
        return F.when(left, grow(node.leftChild(), moved, m)).otherwise(grow(node.rightChild(), moved, m))

    out = {}
    for distance, place in distances.items():
        for m in multipliers:
            p = grow(root, place, float(m))
            out[distance, m] = [("turnout", p), ("turnout_hard", (p > 0.5).cast("double"))]
    return _scaled_means(df, out)


def _linear(coefs: Column, xs: Sequence[Column]) -> Column:
    return reduce(add, [coefs[0], *[coefs[i + 1] * x for i, x in enumerate(xs)]])


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grouped_logistic(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, iterations: int = 12, tolerance: float = 1e-6) -> DataFrame:
    """One logistic model per group, all groups at once: (by, coefs = [intercept, ...], converged, iterations).

    Rows with a NULL or non-finite feature or label take no part. A group whose coefficients still move after
    ``iterations`` steps (say, because a line separates its outcomes) is marked not converged.

    Newton steps on sums: a step is one aggregation of gradient and Hessian, combined on the map side, and a
    tiny solve per group. A group of any size costs its partial sums only; no group is gathered anywhere.
    The training columns are written once to the shared folder, so that steps do not repeat what made them, and
    the coefficient table (one row per group) after each step, to keep the plan flat. It ends when no group moves.
    """
    by, d = list(by), len(features) + 1
    xs = [F.col(f).cast("double") for f in features]
    full = [F.lit(1.0), *xs]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    @F.pandas_udf("coefs array<double>, moved double")
    def solve(coefs: pd.Series, gradient: pd.Series, hessian: pd.Series) -> pd.DataFrame:
        out, moved = [], []
        for b, g, h in zip(coefs, gradient, hessian):
            m = np.zeros((d, d))
            for (i, j), v in zip(pairs, h):
                m[i, j] = m[j, i] = v
            scale = np.trace(m) / d
            step = np.linalg.lstsq(m + RIDGE * max(scale, 1e-12) * np.eye(d), np.asarray(g, float), rcond=None)[0]
            step = np.clip(step, -10, 10)
            out.append((np.asarray(b, float) + step).tolist())
            moved.append(float(np.abs(step).max()))
        return pd.DataFrame({"coefs": out, "moved": moved})

    rows = df.select(*by, *[x.alias(f"_x{i}") for i, x in enumerate(full)], F.col(label).cast("double").alias("_y"))
    whole = [F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in [*(f"_x{i}" for i in range(d)), "_y"]]
    rows = materialise(rows.filter(reduce(and_, whole)).hint("rebalance"), "training_rows")  # even files: hot groups no longer sit together
    x = [F.col(f"_x{i}") for i in range(d)]
    coefs = None
    for step in range(1, iterations + 1):
        if coefs is None:
            current = rows.withColumn("coefs", F.array(*[F.lit(0.0)] * d))
        else:
            current = join_keys(rows, coefs.select(*by, "coefs"), by)
        current = current.withColumn("_p", _sigmoid(_linear(F.col("coefs"), x[1:])))
        w = F.col("_p") * (F.lit(1.0) - F.col("_p"))
        sums = current.groupBy(*by).agg(F.first("coefs").alias("coefs"), *[F.sum(x[i] * (F.col("_y") - F.col("_p"))).alias(f"_g{i}") for i in range(d)],
                                        *[F.sum(w * x[i] * x[j]).alias(f"_h{i}_{j}") for i, j in pairs])
        solved = solve("coefs", F.array(*[f"_g{i}" for i in range(d)]), F.array(*[f"_h{i}_{j}" for i, j in pairs]))
        coefs = materialise(sums.select(*by, solved.alias("s")).select(*by, "s.*"), "coefficients")
        if (coefs.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return coefs.select(*by, "coefs", (F.col("moved") < tolerance).alias("converged"), F.lit(step).alias("iterations"))


def per_group_sensitivity(df: DataFrame, group: str, key: str, features: Sequence[str], distance: str, label: str, active: Column,
                          min_rows: int = 200, splits: int = 4, train: float = 0.8, multipliers: Sequence[float] = MULTIPLIERS) -> DataFrame:
    """Per tract with enough rows: several splits, a model each, then AUC, coefficients and scaled-distance turnout.

    The row threshold counts all rows, the models see the active ones without NULLs (``n_filtered``); tracts with a
    single outcome are left out. Split i uses salt i. Averages over the splits are returned; ``converged`` tells
    whether every split's model settled, otherwise the figures that rest on coefficients are NULL.
    """
    whole = reduce(and_, [F.col(c).isNotNull() for c in [*features, label]])
    active = active & whole
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(active).alias("n_filtered"),
                                   F.countDistinct(F.when(active, F.col(label))).alias("_classes"))
    kept = counts.filter((F.col("n_samples") >= min_rows) & (F.col("_classes") > 1)).drop("_classes")
    rows = join_keys(df.filter(active), kept.select(group), [group])
    salted = [F.struct(F.lit(s).alias("split"), (key_hash(key, s) < F.lit(int(train * HASH_SPACE))).alias("is_train")) for s in range(splits)]
    spread = rows.select("*", F.explode(F.array(*salted)).alias("_s")).select(*rows.columns, "_s.*")
    by = [group, "split"]
    coefs = grouped_logistic(spread.filter("is_train"), by, features, label)
    test = join_keys(spread.filter(~F.col("is_train")), coefs, by)
    xs = [F.col(f).cast("double") for f in features]
    scored = test.withColumn("score", _sigmoid(_linear(F.col("coefs"), xs))).withColumn("label", F.col(label))
    areas = auc(scored, by).groupBy(group).agg(F.avg("auc").alias("auc"))
    at = features.index(distance) + 1
    # scaling the distance shifts the linear predictor by coef * distance * (m - 1)
    z = _linear(F.col("coefs"), xs)
    shifted = [F.avg(_sigmoid(z + F.col("coefs")[at] * F.col(distance) * F.lit(m - 1.0))).alias(f"turnout_with_dist_times_{str(m).replace('.', '_')}")
               for m in multipliers]
    turnout = test.groupBy(group).agg(*shifted, F.avg(distance).alias("mean_distance"), F.avg(F.col(label).cast("double")).alias("true_turnout"))
    names = ["intercept", *[f"coef_{f}" for f in features]]
    means = coefs.groupBy(group).agg(*[F.avg(F.col("coefs")[i]).alias(n) for i, n in enumerate(names)], F.min("converged").alias("converged"),
                                     F.max("iterations").alias("iterations"))
    out = kept
    for part in (means, areas, turnout):
        out = join_keys(out, part, [group], "left")
    rests = {*names, "auc", *[c for c in turnout.columns if c.startswith("turnout_with")]}
    return out.select(*[F.when(F.col("converged"), F.col(c)).alias(c) if c in rests else c for c in out.columns])


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS line of y on x over rows where both are numbers."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return ok.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))
