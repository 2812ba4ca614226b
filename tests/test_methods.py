"""Operators against brute force: polygons, grids, quantiles, models, open records."""

import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicspark.operators import fairness as FA
from civicspark.operators import geo
from civicspark.operators import models as M
from civicspark.operators import ordered as O
from civicspark.operators import places as PL
from civicspark.operators import sampling as SA
from civicspark.operators import tables as TB
from civicspark.plans import bindings as B
from civicspark.plans.registry import Tables

RING = "poly_id bigint, ring array<struct<lon: double, lat: double>>"


def ray(x, y, rings):
    """Even-odd rule over all rings of a polygon."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.5, 1.0, 7.0])
def test_clipped_cells_against_ray_casting(spark, cell):
    """Stars, parts, a hole, edges and corners on the cells' borders, points on borders and corners."""
    rng = random.Random(int(cell * 10))
    polygons = {}
    for k in range(6):
        cx, cy, n = rng.uniform(-8, 8), rng.uniform(-8, 8), rng.randint(3, 40)
        polygons[k] = [[(cx + math.cos(2 * math.pi * i / n) * (r := rng.uniform(0.3, 5)), cy + math.sin(2 * math.pi * i / n) * r) for i in range(n)]]
    polygons[6] = [[(-3.0, -3.0), (4.0, -3.0), (4.0, 4.0), (-3.0, 4.0)], [(-1.0, -1.0), (-1.0, 2.0), (2.0, 2.0), (2.0, -1.0)]]
    polygons[7] = [[(0.0, 0.0), (5.0, 5.0), (0.0, 5.0)], [(-9.0, -9.0), (-8.5, -9.0), (-8.5, -8.0)]]
    polygons[8] = [[(-7.0, 0.0), (0.0, -7.0), (7.0, 0.0), (0.0, 7.0)]]
    points = [(rng.uniform(-10, 10), rng.uniform(-10, 10)) for _ in range(800)] + [(float(x), float(y)) for x in range(-8, 9) for y in range(-8, 9)]
    points += [(x + 0.5, y + 0.25) for x, y in points[-60:]]
    rows = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)] + [(9999, None, 1.0)], "point_id bigint, lat double, lon double")
    shapes = spark.createDataFrame([(k, ring) for k, rings in polygons.items() for ring in rings], RING)
    want = {(i, k) for i, (x, y) in enumerate(points) for k, rings in polygons.items() if ray(x, y, rings)}
    assert {tuple(r) for r in geo.points_in_polygons(rows, shapes, cell).collect()} == want


def test_interior_cells_hold_no_edges(spark):
    square = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]
    cells = geo.polygon_cells(spark.createDataFrame([(1, square)], RING), 5.0).collect()
    inside = [c for c in cells if c.edges is None]
    assert len(inside) == 72 and all(c.corner for c in inside) and max(len(c.edges) for c in cells if c.edges) <= 2


def test_grids_stay_in_their_part(spark):
    parts = [(1, 0, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (1, 1, [(20.0, 0.0), (25.0, 0.0), (25.0, 5.0)])]
    polys = spark.createDataFrame(parts, "poly_id bigint, part int, ring array<struct<lon: double, lat: double>>")
    still = geo.region_grid(polys, 50.0, 10.0).collect()
    moved = geo.region_grid(polys, 50.0, 10.0, 40.0).collect()
    assert min(r.lon for r in still) > 0.08 and min(r.lat for r in still) > 0.08
    for rows in (still, moved):
        assert {r.part for r in rows} == {0, 1} and all(ray(r.lon, r.lat, [parts[r.part][2]]) for r in rows)
    assert {(r.part, r.row, r.col): r.lat for r in still} != {(r.part, r.row, r.col): r.lat for r in moved}


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_binned_quantiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    frame = pd.DataFrame({"k": np.repeat(["a", "b", "c"], 400), "v": np.concatenate([rng.normal(size=400), rng.integers(0, 4, 400) * 1.0, np.r_[rng.normal(size=399), 1e9]])})
    df = spark.createDataFrame(frame).unionAll(spark.createDataFrame([("d", 5.0), (None, 1.0), (None, 2.0), ("a", None)], "k string, v double"))
    probs = {"lo": 0.025, "mid": 0.5, "hi": 0.9, "top": 1.0}
    got = {r.k: [r[n] for n in probs] for r in O.binned_quantiles(df, ["k"], "v", probs, bins).collect()}
    want = {k: np.quantile(g.v, list(probs.values())) for k, g in frame.groupby("k")} | {"d": [5.0] * 4, None: np.quantile([1.0, 2.0], list(probs.values()))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def _people(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        d, a, g = rng.uniform(0, 50), rng.uniform(18, 90), rng.choice(["x", "y", "z"])
        p = 1 / (1 + math.exp(-(-1 + 0.04 * a - 0.05 * d + (g == "y"))))
        rows.append((i, d, a, g, int(rng.random() < p), rng.uniform(0, 9)))
    return spark.createDataFrame([*rows, (n, None, 1.0, "x", 1, 1.0)], "id long, d double, a double, g string, y int, e double"), rows


def test_newton_meets_the_score_equations(spark):
    df, rows = _people(spark)
    fit = M.newton_logistic(df, ["d", "a"], {"g": ["y", "z", "x"]}, "y")
    assert fit.converged and [c for c, _ in fit.columns] == ["(intercept)", "d", "a", "g", "g"]
    x = np.array([[1, d, a, g == "y", g == "z"] for _, d, a, g, _, _ in rows], float)
    y = np.array([r[4] for r in rows], float)
    p = 1 / (1 + np.exp(-x @ np.array(fit.coefficients)))
    assert np.allclose(x.T @ (y - p), 0, atol=1e-5)
    totals = {(r.column, r.category): r.fitted_total for r in M.fitted_totals(df, fit, "y").collect()}
    assert np.allclose([totals[c] for c in fit.columns], x.T @ y, atol=1e-4)
    table = {(r.column, r.category): r.coefficient for r in M.fit_table(spark, fit, {"g": ["y", "z", "x"]}).collect()}
    assert len(table) == 6 and table["g", "x"] == 0.0
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    plain = VectorAssembler(inputCols=["d", "a"], outputCol="features").transform(df.na.drop()).withColumn("label", F.col("y").cast("double"))
    library = LogisticRegression(maxIter=200, tol=1e-12, standardization=False).fit(plain)
    mine = M.newton_logistic(df, ["d", "a"], {}, "y").coefficients
    assert np.allclose(mine, [library.intercept, *library.coefficients], atol=1e-4)


def test_collinear_and_constant_inputs_still_fit(spark):
    df, rows = _people(spark, 200)
    df = df.na.drop().withColumn("twice", F.col("d") * 2).withColumn("one", F.lit(1.0))
    fit = M.newton_logistic(df, ["d", "twice", "one"], {}, "y")
    totals = {r.column: r.fitted_total for r in M.fitted_totals(df, fit, "y").collect()}
    assert totals["d"] == pytest.approx(sum(d * y for _, d, _, _, y, _ in rows), abs=1e-3) and totals["twice"] == pytest.approx(2 * totals["d"], abs=1e-3)


def test_counterfactuals_equal_sending_scaled_rows_through_the_model(spark):
    df, _ = _people(spark)
    df = df.na.drop()
    fit = M.newton_logistic(df, ["d", "e"], {}, "y")
    got = {(r.distance, round(r.multiplier, 6)): r for r in M.counterfactual(fit, df, ["d", "e"], [0.05, 1.0, 2.0]).collect()}
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=["d", "a", "e"], outputCol="features")
    model = M.tree(assembler.transform(df).withColumn("label", F.col("y").cast("double")))
    by_tree = {(r.distance, round(r.multiplier, 6)): r for r in M.tree_counterfactual(model, df, [F.col(c) for c in "dae"], {"d": 0, "e": 2}, [0.05, 1.0, 2.0]).collect()}
    for distance in ("d", "e"):
        for m in (0.05, 1.0, 2.0):
            scaled = df.withColumn(distance, F.col(distance) * m)
            z = sum((F.col(c) * b for (c, _), b in zip(fit.columns[1:], fit.coefficients[1:])), F.lit(fit.coefficients[0]))
            p = scaled.agg(F.avg(1 / (1 + F.exp(-z))), F.avg(distance), F.count("id")).first()
            mine = got[distance, m]
            assert (mine.turnout, mine.mean_distance) == pytest.approx((p[0], p[1])) and mine.n == p[2]
            sent = model.transform(assembler.transform(scaled)).agg(F.avg(vector_to_array("probability")[1])).first()[0]
            assert by_tree[distance, m].turnout == pytest.approx(sent)


def test_null_groups_are_groups(spark):
    df = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, "a").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("score"))
    assert SA.hash_rank(df, "id", ["g"]).count() == 20
    sizes = spark.createDataFrame([("a", 3), (None, 4)], "g string, n int")
    assert {r.g: r["count"] for r in SA.sample_stratified(df, "id", "g", sizes, "n").groupBy("g").count().collect()} == {"a": 3, None: 4}
    assert {r.g for r in M.auc(df, ["g"]).collect()} == {"a", None}
    assert {r.g for r in M.grouped_logistic(df, ["g"], ["score"], "label").collect()} == {"a", None}


def test_history_maps_and_columns(spark):
    df = spark.createDataFrame([(1, "2000-11-07", "a"), (1, "2000-11-07", "b"), (1, "1999-01-01", "c"), (2, None, "d"), (3, "2001-01-01", None)], "k long, at string, how string")
    got = {r.k: r for r in TB.history_columns(TB.history_maps(df, "k", "at", "how"), ["2000-11-07"], lambda d: "x").collect()}
    assert got[1].history == {"1999-01-01": "c", "2000-11-07": "b"} and got[1].x == "b"
    assert got[2].history == {"": "d"} and got[2].x is None and got[3].history == {"2001-01-01": None}


def test_split_keeps_every_row_once(spark):
    df = spark.range(10).select("id", F.when(F.col("id") % 3 == 0, "x").alias("Met"), F.lit(None).cast("string").alias("none"))
    met, rest = TB.split_parts(df, F.col("Met") == "x")
    assert met.columns == df.columns and sorted(r.id for r in met.collect()) == [0, 3, 6, 9] and rest.count() == 6
    nobody, all_rows = TB.split_parts(df, F.col("none") == "x")
    assert nobody.count() == 0 and all_rows.count() == 10


def test_open_records_bring_every_field(spark):
    response = {"pollingLocations": [{"address": {"city": "A", "landmark": "oak"}, "sources": [{"name": "s", "official": True, "seen": "now"}], "hours2": {"mon": "7-9"}},
                                     {"address": None, "sources": []}], "other": None}
    df = spark.createDataFrame([(1, json.dumps(response)), (2, "not json"), (3, None)], "id long, r string")
    rows = PL.flatten_places(df, "r", ["id"]).orderBy("place_index").collect()
    assert len(rows) == 2 and {"Pollinghours", "AddressCity", "AddressLandmark", "Hours2", "SourcesSeen", "SourcesOfficial"} <= set(rows[0].asDict())
    assert (rows[0].AddressLandmark, rows[0].Hours2, rows[0].SourcesSeen, rows[0].SourcesOfficial) == ("oak", '{"mon":"7-9"}', "now", 1)
    assert rows[1].AddressCity is None and rows[1].source_index is None


def dealt_to(df):
    """Numbers of partitions that a plan deals rows to, by what."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {(re.sub(r"#\d+L?", "", m[1]), int(m[2])) for m in re.finditer(r"hashpartitioning\(([^()]*), (\d+)\), REPARTITION_BY_NUM", plan)}


def test_reach_is_dealt_by_the_number_of_pairs(spark, monkeypatch):
    """Partitions follow the rows instead of the session's number; people may repeat, lack theta or be missing; equal to brute force."""
    monkeypatch.setattr("civicspark.session.ROWS_PER_PART", 50)
    rng = random.Random(5)
    members = [(s, f) for s in range(30) for f in rng.sample(range(40), 3)] + [(0, None), (7, 99)]
    near = [(p, f, rng.randint(0, 999) / 100) for p in [*range(60), None] for f in rng.sample(range(40), 20)]
    who = [(p, float(p % 2)) for p in range(50)] + [(3, 1.0), (3, 1.0), (4, 1.0), (5, None), (None, 1.0), (77, 0.0)]
    sets = spark.createDataFrame(members, "set_id bigint, facility bigint")
    pairs = spark.createDataFrame(near, "person bigint, facility bigint, dist double")
    people = spark.createDataFrame(who, "person bigint, theta double")
    want = {}
    for s, f in members:
        for p, g, d in near:
            if f == g:
                want[s, p] = min(d, want.get((s, p), d))
    found = FA.set_distance(sets, pairs, len(near))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((s, p, r)) for (s, p), r in want.items())
    reach = FA.set_reach(sets, pairs, people, len(near))
    assert sorted(map(repr, map(tuple, reach.collect()))) == sorted(repr((s, p, t, r)) for (s, p), r in want.items() for q, t in who if p is not None and p == q)
    small, large = ({n for by, n in dealt_to(FA.set_reach(sets, pairs, people, k)) if by == "set_id, _cut"} for k in (1220, 12200))
    assert len(small) == len(large) == 1 and max(large) > 9 * max(small) > 9 * 8
    assert not dealt_to(FA.set_reach(sets, pairs, people, 100))  # few rows: left to the optimizer


def test_pairs_are_dealt_by_the_number_of_lines(spark, monkeypatch, tmp_path):
    rows = spark.range(3000)
    rows.select((F.col("id") % 700).alias("l_orderkey"), (F.col("id") % 13).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(700).select(F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    plain = {tuple(r) for r in B.distances(Tables(spark, str(tmp_path))).collect()}
    assert {(p, f) for p, f, _ in plain} == {(k % 700 % 90, k % 13) for k in range(3000)}
    monkeypatch.setattr("civicspark.session.ROWS_PER_PART", 100)
    pairs = B.distances(Tables(spark, str(tmp_path)))
    assert dealt_to(pairs) == {("l_orderkey", 30), ("person, facility", 30)}
    assert sorted(map(tuple, pairs.collect())) == sorted(plain)


def test_first_seen_counts_are_dealt_by_the_number_of_places(spark, monkeypatch):
    """Blank points, types and names, equal rows, a type that is not asked for; equal to brute force, nothing joined."""
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "a", "b", "x"]), rng.choice([None, *range(25)])) for _ in range(900)]
    first, want = {}, {}
    for p, k, n in rows:
        if p is not None:
            first[k, n] = min(p, first.get((k, n), p))
        want.setdefault((p, k), [0, 0])[0] += 1
    for (k, _), p in first.items():
        want[p, k][1] += k is not None
    every = {(p, k): [0, 0] for p in {r[0] for r in rows} for k in ("a", "b", "c")} | want
    seen = spark.createDataFrame(rows, "point bigint, place_type string, name bigint")
    monkeypatch.setattr("civicspark.session.ROWS_PER_PART", 60)
    for types, right in (((), want), (("a", "b", "c"), every)):
        counts = PL.first_seen_counts(seen, types)
        assert dealt_to(counts) == {("point", 15)} and "Join" not in counts._jdf.queryExecution().executedPlan().toString()
        assert sorted(repr(tuple(r)) for r in counts.collect()) == sorted(repr((p, k, t, u)) for (p, k), (t, u) in right.items())
    monkeypatch.setattr("civicspark.session.ROWS_PER_PART", 900)
    few = PL.first_seen_counts(seen, ("a", "b", "c"))
    assert not dealt_to(few) and sorted(map(repr, map(tuple, few.collect()))) == sorted(map(repr, map(tuple, counts.collect())))
