"""Feature preparation: casts, shares, age bands, indexing and one-hot encoding."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions import scalars as S

MISSING = "NA"


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast many columns in one projection; unreadable text becomes NULL."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def affine(c: Column, factor: float = 1.0, offset: float = 0.0) -> Column:
    return c * F.lit(factor) + F.lit(offset)


def share_columns(df: DataFrame, shares: Mapping[str, Sequence[str]], total: str) -> DataFrame:
    """Each new column is the sum of its sources over ``total``; all sources are dropped."""
    used = {c for cols in shares.values() for c in cols}
    made = [S.fraction([F.col(c) for c in cols], F.col(total)).alias(n) for n, cols in shares.items()]
    return df.select(*[c for c in df.columns if c not in used], *made)


def age_bands(cols: Sequence[str], prefix: str, edges: Sequence[int]) -> dict[str, list[str]]:
    """Assign age columns to [edge, next edge) by the first number in their name; ``under`` counts as 0."""
    bands: dict[str, list[str]] = {f"{prefix}{a}_{b}": [] for a, b in zip(edges, edges[1:])}
    for c in cols:
        number = re.search(r"\d+", c)
        age = 0 if "under" in c.lower() or number is None else int(number.group())
        for a, b in zip(edges, edges[1:]):
            if a <= age < b:
                bands[f"{prefix}{a}_{b}"].append(c)
    return {k: v for k, v in bands.items() if v}


def some_vehicle(cols: Sequence[str], without: str, include_without: bool = False) -> list[str]:
    """The columns of households with a vehicle; ``include_without`` restores the older, all-inclusive list."""
    return [c for c in cols if include_without or c != without]


def fill_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.replace("", MISSING, subset=list(cols))


def encoder(cols: Sequence[str], one_hot: bool = True) -> Pipeline:
    """Index by falling frequency (NULL rows are skipped), then one-hot with the last category dropped."""
    indexed = [f"{c}_index" for c in cols]
    stages = [StringIndexer(inputCols=list(cols), outputCols=indexed, handleInvalid="skip")]
    if one_hot:
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in cols], dropLast=True))
    return Pipeline(stages=stages)


def encode(df: DataFrame, cols: Sequence[str], one_hot: bool = True) -> tuple[DataFrame, dict[str, list[str]], PipelineModel]:
    """The encoded table, the labels per column and the fitted pipeline: one pass counts all columns."""
    clean = fill_blank(df, cols)
    model = encoder(cols, one_hot).fit(clean)
    labels = dict(zip(cols, model.stages[0].labelsArray))
    return model.transform(clean), {c: list(v) for c, v in labels.items()}, model


def assemble(df: DataFrame, cols: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    packed = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    return packed.select(*keep, "features", F.col(label).cast("double").alias("label"))


def vector_to_columns(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """One column per component, named ``<col>[<label>]``; the vector is dropped."""
    arr = vector_to_array(F.col(col))
    parts = df.withColumn("_a", arr)
    return parts.select(*[c for c in df.columns if c != col], *[F.col("_a")[i].alias(f"{col}[{n}]") for i, n in enumerate(names)])


def prepare(df: DataFrame, dates: Sequence[str], cutoff: tuple[str, str], numbers: Sequence[str], births: Sequence[str],
            outcome: str, shares: Mapping[str, Sequence[str]], total: str, land: str, end: str = "2021-02-18") -> DataFrame:
    """The whole non-categorical chain in three projections.

    Day counts, registration cut-off (the column leaves), numeric casts, ages, outcome to 0/1, shares, density.
    """
    cut_col, cut_day = cutoff
    kept = df.filter(S.to_day(F.col(cut_col)) <= F.to_date(F.lit(cut_day)))
    made = {c: S.days_to(F.col(c), end) for c in dates if c != cut_col}
    made |= {c: F.col(c).try_cast("double") for c in numbers}
    made |= {c: S.age_years(F.col(c), end) for c in births}
    made[outcome] = F.coalesce(S.relabel(F.col(outcome), {"voted": 1}, 0), F.lit(0))
    out = share_columns(kept.withColumns(made).drop(cut_col), shares, total)
    return out.withColumn("popDensity", S.ratio(F.col(total).cast("double"), F.col(land))).drop(land)
