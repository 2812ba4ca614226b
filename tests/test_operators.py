"""Operators against brute force, known values and properties, on data made to be awkward (ties, hot keys, blanks)."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civicspark.functions import predicates as P
from civicspark.functions import scalars as S
from civicspark.operators import ecological as E
from civicspark.operators import fairness as FA
from civicspark.operators import geo
from civicspark.operators import joins as J
from civicspark.operators import models as M
from civicspark.operators import ordered as O
from civicspark.operators import places as PL
from civicspark.operators import sampling as SA
from civicspark.operators import tables as TB
from civicspark.sources import files as FI
from civicspark.sources import jdbc
from civicspark.streaming import backlog as BL


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    """Small ranges, so that small tables are cut too."""
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 20)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, and many values are equal."""
    rng = np.random.default_rng(7)
    n = 6000
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n)),
                        "v": np.where(rng.random(n) < 0.3, 1.5, rng.normal(size=n).round(4))})
    return spark.createDataFrame(pdf), pdf


def test_quantiles_match_numpy(skewed):
    df, pdf = skewed
    got = {r["k"]: (r["a"], r["m"]) for r in O.exact_quantiles(df, ["k"], "v", {"a": 0.025, "m": 0.6}).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.percentile(g.v, [2.5, 60]))
    whole = O.exact_quantiles(df, [], "v", {"a": 0.1, "m": 0.5}).first()
    assert np.allclose(tuple(whole), np.percentile(pdf.v, [10, 50]))


def test_row_numbers_and_running_totals(skewed):
    df, pdf = skewed
    got = O.row_numbers(df, ["k"], [F.col("v"), F.col("id")]).toPandas()
    want = pdf.sort_values(["v", "id"]).assign(rn=lambda x: x.groupby("k").cumcount() + 1)
    merged = got.merge(want[["id", "rn"]], on="id")
    assert (merged.rn_x == merged.rn_y).all()
    run = O.running(df, [], [F.col("id")], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, strict=True).toPandas().sort_values("id")
    assert np.allclose(run.total, pdf.v.cumsum().shift(fill_value=0))
    assert np.allclose(run.top.iloc[1:].to_numpy(float), pdf.v.cummax().shift().iloc[1:])


def test_hot_key_is_spread_over_tasks(spark):
    """Input partitioned by the key alone: the ranges of its hot key still end up in several partitions."""
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 10 > 6).cast("int").alias("k")).repartition(8, "k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = O.row_numbers(df, ["k"], [F.col("id")])
        parts = plan.filter(F.col("k") == 0).select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 3 and plan.agg(F.countDistinct("k", "rn")).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_samples_are_exact_and_disjoint(skewed):
    df, pdf = skewed
    assert SA.sample_exact(df, "id", 0.137).select("id").distinct().count() == math.floor(0.137 * len(pdf))
    todo = F.col("k") == 0
    picked = SA.sample_backlog(df, todo, "id", 0.05)
    assert picked.count() == math.floor(0.05 * len(pdf)) and picked.filter(~todo).count() == 0
    parts = SA.sample_disjoint(df, "id", [100, 250, 50]).groupBy("subset").count().toPandas()
    assert sorted(parts["count"]) == [50, 100, 250]
    sizes = df.groupBy("k").agg(F.floor(F.count("*") / 4).alias("want"))
    strat = SA.sample_stratified(df, "id", "k", sizes, "want").groupBy("k").count().toPandas().set_index("k")["count"]
    assert (strat == pdf.groupby("k").size().floordiv(4)[strat.index]).all()


def _spots(rng, n):
    hot = rng.random(n) < 0.35
    return np.where(hot, rng.normal(33, 0.01, n), rng.uniform(-90, 90, n)), np.where(hot, rng.normal(-84, 0.01, n), rng.uniform(-180, 180, n))


@pytest.mark.parametrize("metric", ["planar", "geodesic"])
def test_nearest_paths_agree_with_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    plat, plon = _spots(rng, 400)
    flat, flon = _spots(rng, 700)
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(400), "lat": plat, "lon": plon}))
    places = spark.createDataFrame(pd.DataFrame({"place_id": range(700), "place_type": np.where(np.arange(700) % 5 == 0, "a", "b"), "lat": flat, "lon": flon}))
    if metric == "planar":
        d = (plat[:, None] - flat) ** 2 + (plon[:, None] - flon) ** 2
    else:
        p, f = np.radians(plat)[:, None], np.radians(flat)
        d = np.sin((f - p) / 2) ** 2 + np.cos(p) * np.cos(f) * np.sin(np.radians(flon - plon[:, None]) / 2) ** 2
    kinds = np.where(np.arange(700) % 5 == 0, "a", "b")
    want = {(i, k): int(np.argmin(np.where(kinds == k, d[i], np.inf))) for i in range(400) for k in "ab"}
    for leaf in (geo.LEAF_PLACES, 3):
        found = geo.nearest(points, places, metric, leaf).select("point_id", "place_type", "place_id").collect()
        assert {(r[0], r[1]): r[2] for r in found} == want


def test_nearest_ties_missing_coordinates_and_empty_types(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "point_id bigint, lat double, lon double")
    places = spark.createDataFrame([(9, "a", 1.0, 0.0), (4, "a", -1.0, 0.0), (5, "a", None, 0.0)], "place_id bigint, place_type string, lat double, lon double")
    for leaf in (10, 1):
        wide = geo.nearest_wide(geo.nearest(points, places, leaf=leaf), ["a", "none"]).collect()
        assert len(wide) == 1 and wide[0]["closest_a"] == 4 and wide[0]["closest_none"] is None


def test_attach_nearest_keeps_everyone(spark):
    rng = np.random.default_rng(9)
    plat, plon = _spots(rng, 200)
    people = spark.createDataFrame(pd.DataFrame({"id": range(200), "lat": plat, "lon": plon})).withColumn("lat", F.when(F.col("id") != 7, F.col("lat")))
    places = spark.createDataFrame(pd.DataFrame({"place_id": range(90), "place_type": ["a", "b"] * 45, "lat": plat[:90] + 0.3, "lon": plon[:90]}))
    one = geo.attach_nearest(people, "id", places, ["a", "b", "c"]).orderBy("id").collect()
    assert len(one) == 200 and one[0].asDict().keys() == {"id", "lat", "lon", *(f"{k}_{t}" for k in ("closest", "dist_to") for t in "abc")}
    assert one[7]["closest_a"] is None and one[8]["closest_c"] is None and one[8]["closest_b"] is not None


def test_radius_crosses_date_line_and_pole(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 0.0)], "point_id bigint, lat double, lon double")
    places = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.9, 180.0), (3, 10.0, 10.0)], "place_id bigint, lat double, lon double")
    assert {(r[0], r[1]) for r in geo.within_radius(points, places, 50.0).select("point_id", "place_id").collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize(("n", "km"), [(1, None), (7, None), (30, 900.0), (3, 50.0)])
def test_n_nearest_against_brute_force(spark, n, km):
    """Clustered places, some on one spot: the n nearest on the sphere, in any radius."""
    rng = np.random.default_rng(n)
    plat, plon = _spots(rng, 150)
    flat, flon = _spots(rng, 500)
    flat[:40], flon[:40] = flat[0], flon[0]
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(150), "lat": plat, "lon": plon}))
    places = spark.createDataFrame(pd.DataFrame({"place_id": range(500), "lat": flat, "lon": flon}))
    p, f = np.radians(plat)[:, None], np.radians(flat)
    h = np.sin((f - p) / 2) ** 2 + np.cos(p) * np.cos(f) * np.sin(np.radians(flon - plon[:, None]) / 2) ** 2
    d = 2 * 6371.0088 * np.arcsin(np.minimum(1, np.sqrt(h)))
    for leaf in (16, 2):
        got = {}
        for r in geo.nearest_n(points, places, n, km, leaf).collect():
            got.setdefault(r["point_id"], {})[r["nearby_rank"]] = (r["place_id"], r["km"])
        for i in range(150):
            near = np.sort(d[i][d[i] <= (km or np.inf)])[:n]
            mine = [got.get(i, {})[k] for k in range(len(got.get(i, {})))]
            assert np.allclose([x for _, x in mine], near, atol=1e-6) and len({j for j, _ in mine}) == len(mine) and len(mine) == len(near)
    if km:
        pairs = {(r["point_id"], r["place_id"]) for r in geo.within_radius(points, places, km).collect()}
        assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= km))}


def test_dedup_cascade_matches_sequential_model(spark):
    rng = random.Random(5)
    rows = [(i, *[rng.choice(["", *"abcdefgh"]) + ("" if rng.random() < 0.4 else str(rng.randint(0, 9))) for _ in range(3)]) for i in range(400)]
    seen, want = [set(), set(), set()], []
    for row in rows:
        keep = True
        for s, v in zip(seen, row[1:]):
            if v != "" and v in s:
                keep = False
                break
            s.add(v)
        if keep:
            want.append(row[0])
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string")
    assert sorted(r["id"] for r in TB.dedup_cascade(df, ["a", "b", "c"], ["id"]).collect()) == want


def test_update_takes_null_and_insert_skips_known(spark):
    target = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, v string")
    assert {tuple(r) for r in TB.update_from(target, spark.createDataFrame([(1, None)], "k bigint, v string"), "k", ["v"]).collect()} == {(1, None), (2, "y")}
    source = spark.createDataFrame([(2, "no"), (3, "first"), (3, "second")], "k bigint, v string")
    assert {tuple(r) for r in TB.insert_absent(target, source, "k", [F.col("v")]).collect()} == {(1, "x"), (2, "y"), (3, "first")}


def test_anti_join_forms_agree(spark):
    left = spark.createDataFrame([(i % 7,) for i in range(50)], "k bigint")
    right = spark.createDataFrame([(1,), (2,)], "j bigint")
    distinct = {r[0] for r in J.anti_distinct(left, right, "k", "j").collect()}
    assert distinct == {r[0] for r in J.anti_rows(left, right, "k", "j").distinct().collect()} == {0, 3, 4, 5, 6}


def test_contains_join_against_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 25)))) for i in range(200)]
    names = sorted({"".join(rng.choice("abC ") for _ in range(rng.randint(0, 6))) for _ in range(80)})
    got = J.contains_join(spark.createDataFrame(texts, "id bigint, t string"), spark.createDataFrame([(n,) for n in names], "n string"), "id", "t", "n")
    assert {tuple(r) for r in got.collect()} == {(i, n) for i, t in texts for n in names if n and n.lower() in t.lower()}


def test_pareto_against_brute_force(spark):
    rng = np.random.default_rng(11)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (1500, 2)))]
    want = {i for i, f, g in pts if not any(f2 > f and g2 > g for _, f2, g2 in pts)}
    got = FA.pareto(spark.createDataFrame(pts, "set_id bigint, f double, g double"), "f", "g")
    assert {r["set_id"] for r in got.collect()} == want


def test_goodman_known_values(spark):
    xs = [0.0, 0.2, 0.4, 0.6, 0.8]
    exact = E.goodman(spark.createDataFrame([(x, x, 1) for x in xs], "x double, t double, n bigint")).first()
    assert exact["intercept"] == pytest.approx(0, abs=1e-12) and exact["slope"] == pytest.approx(1)
    rows = list(zip([*xs, 0.9], [0.1, 0.3, 0.5, 0.7, 0.9, 0.9], [1000] * 5 + [1]))
    w = E.goodman(spark.createDataFrame(rows, "x double, t double, n bigint"), "n").first()
    assert w["intercept"] == pytest.approx(0.1, abs=1e-3) and w["slope"] == pytest.approx(1, abs=1e-3)


def test_bounds_of_homogeneous_precincts(spark):
    rows = E.bounds(spark.createDataFrame([(0.0, 0.3, 10), (1.0, 0.4, 10), (0.5, 0.8, 10)], "x double, t double, n bigint")).collect()
    by_x = {r["x"]: r for r in rows}
    assert by_x[0.0]["lower_b"] is None and by_x[0.0]["upper_w"] == 0.3
    assert by_x[1.0]["upper_b"] == 0.4 and by_x[1.0]["lower_w"] is None
    assert by_x[0.5]["lower_b"] == pytest.approx(0.6) and by_x[0.5]["upper_b"] == 1.0


def test_polarization_properties(spark):
    rng = np.random.default_rng(1)
    prefs = spark.createDataFrame([(d, g, 0, float(v)) for d in range(300) for g, v in enumerate(rng.normal([0.6, 0.4], 0.1))], "draw bigint, grp bigint, cand bigint, v double")
    more, less = (E.polarization(prefs, 0, (0, 1), threshold=x).first()["percent"] for x in (0.2, 0.4))
    assert more >= less
    w95, w90 = (E.polarization(prefs, 0, (0, 1), percentile=p).first() for p in (95.0, 90.0))
    assert w95["lower"] <= w90["lower"] <= w90["upper"] <= w95["upper"]
    for bad in ({}, {"threshold": 0.1, "percentile": 90.0}):
        with pytest.raises(ValueError):
            E.polarization(prefs, 0, (0, 1), **bad)


def test_log_binomial(spark):
    cases = [(n, k) for n in (0, 1, 5, 32, 33, 40, 1000, 250_000) for k in (0, 1, n // 3, n) if k <= n]
    df = spark.createDataFrame(cases, "n bigint, k bigint").withColumn("v", S.log_binom(F.col("n"), F.col("k")))
    for r in df.collect():
        assert r["v"] == pytest.approx(math.lgamma(r["n"] + 1) - math.lgamma(r["k"] + 1) - math.lgamma(r["n"] - r["k"] + 1), abs=1e-6)
    assert spark.range(1).select(S.log_binom(F.lit(3), F.lit(5)).alias("v")).first()["v"] is None


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(4)
    score, label = rng.integers(0, 30, 400).astype(float), rng.integers(0, 2, 400)
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    assert M.auc(df).first()["auc"] == pytest.approx(want)


def test_grouped_logistic_recovers_each_group(spark):
    rng = np.random.default_rng(8)
    frames = []
    for g, (a, b) in enumerate([(0.5, -1.0), (-0.3, 2.0)]):
        x = rng.normal(size=4000)
        frames.append(pd.DataFrame({"g": g, "x": x, "y": (rng.random(4000) < 1 / (1 + np.exp(-(a + b * x)))).astype(int)}))
    coefs = {r["g"]: r["coefs"] for r in M.grouped_logistic(spark.createDataFrame(pd.concat(frames)), ["g"], ["x"], "y").collect()}
    assert coefs[0] == pytest.approx([0.5, -1.0], abs=0.15) and coefs[1] == pytest.approx([-0.3, 2.0], abs=0.2)


def test_fill_same_address_uses_earlier_rows_only(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "a", None), (4, "b", None), (5, "a", "y"), (6, "a", None), (7, None, "z"), (8, None, None)]
    df = spark.createDataFrame(rows, "i bigint, addr string, v string")
    got = {r["i"]: r["v"] for r in PL.fill_same_address(df, ["addr"], "i", ["v"]).collect()}
    assert got == {1: None, 2: "x", 3: "x", 4: None, 5: "y", 6: "x", 7: "z", 8: None}
    assert {r["i"]: r["v"] for r in PL.fill_same_address(df, ["addr"], "i", ["v"], any_row=True).collect()}[1] == "x"


def test_filename_regex_keeps_leading_letters(spark):
    path = spark.range(1).select(F.lit("/d/civicAPI_points_Providence_City_spacing_2.5_version_3/part.csv").alias("p"))
    assert tuple(path.select(*[c.alias(n) for n, c in FI.filename_features(F.col("p")).items()]).first()) == ("Providence City", "2.5", "3")


def test_mixed_encodings_keep_every_line(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(b"id,name\n" + "1,Zoë\n".encode() + "2,Zoë\n".encode("latin-1"))
    assert [tuple(r)[:2] for r in FI.read_mixed_encoding(spark, str(tmp_path), ["id", "name"]).orderBy("id").collect()] == [("1", "Zoë"), ("2", "Zoë")]


def test_html_rows(spark):
    html = "<table><tr><td>1</td><td><b>Hall</b> Bldg  A\n</td></tr><tr class='x'><td>2</td><td></td></tr></table>"
    rows = FI.html_rows(spark.createDataFrame([(1, html)], "id bigint, html string"), "html", ["id"], junk=[" Bldg "]).collect()
    assert [r["cells"] for r in rows] == [["1", "Hall A"], ["2", ""]]


def test_jdbc_reads_are_partitioned():
    options = jdbc.read_options("jdbc:x", "voters", "id", 0, 1_000_000, 64)
    assert options["numPartitions"] == "64" and options["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        jdbc.read_options("jdbc:x", "voters", "id", 5, 5, 4)


def test_compose_without_groups_keeps_all(spark):
    assert spark.range(3).filter(P.compose()).count() == 3


def test_resume_point_never_negative(spark):
    df = spark.createDataFrame([(0, True), (1, True), (2, False)], "i bigint, done boolean")
    start = BL.resume_point(df, "i", F.col("done"))
    assert start.first()["start"] == 0 and BL.rows_from(df, "i", start).count() == 3


def test_hot_keys_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k"))
    plan = TB.first_per_key(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_cross_joins_in_nearest(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "point_id bigint, lat double, lon double")
    places = spark.createDataFrame([(1, "a", 1.0, 0.0)], "place_id bigint, place_type string, lat double, lon double")
    for leaf in (10, 1):
        plan = geo.nearest(points, places, leaf=leaf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_key_hash_salts_are_independent_and_text_keys_work(spark):
    df = spark.range(20000).select("id", F.concat(F.lit("GA"), "id").alias("key"))
    a, b = (SA.hash_split(df, "id", 0.8, salt=s).filter("is_train = 0").select("id") for s in (0, 1))
    assert 700 < a.join(b, "id").count() < 900
    assert SA.sample_exact(df, "key", 0.1).count() == 2000
    moved = geo.jitter(df.select("id", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), "id", 1.0).select(
        F.sqrt(F.col("lat") * F.col("lat") + F.col("lon") * F.col("lon")).alias("d"), F.atan2("lat", "lon").alias("b"))
    assert abs(moved.stat.corr("d", "b")) < 0.05 and moved.filter("d > 0.018").count() > 500


def test_sets_are_scored_on_everyone(spark):
    sets = spark.createDataFrame([(1,), (2,), (3,)], "set_id bigint")
    reach = spark.createDataFrame([(1, 1.0, 9.0), (2, 1.0, 5.0), (2, 0.0, 5.0)], "set_id bigint, theta double, r double")
    people = spark.createDataFrame([(1.0,), (0.0,)], "theta double")
    got = {r["set_id"]: r["total"] for r in FA.set_objectives(sets, reach, people, 10.0, (1.0, 0.5, -0.4), (0.0,)).filter("objective = 'distance'").collect()}
    assert got == {1: -9.5, 2: -5.0, 3: -10.0}
    means = {(r["set_id"], r["theta"]): r["mean_distance"] for r in FA.group_means(sets, reach, people, 10.0, (1.0, 0.5, -0.4)).collect()}
    assert means == {(1, 0.0): 10.0, (1, 1.0): 9.0, (2, 0.0): 5.0, (2, 1.0): 5.0, (3, 0.0): 10.0, (3, 1.0): 10.0}


def test_null_rules_of_ecological_tables(spark):
    p = spark.createDataFrame([(0.1, 0.145, 10), (0.9, 0.865, 30), (None, 0.5, 1000), (0.5, None, 7), (0.5, 0.505, None)], "x double, t double, n bigint")
    fit = E.goodman(p, "n").first()
    assert fit["intercept"] == pytest.approx(0.055) and fit["slope"] == pytest.approx(0.9)
    assert E.bounds(p).filter("x is null or t is null").select("lower_b", "upper_b", "lower_w", "upper_w").distinct().collect() == [(None,) * 4]
    draws = spark.createDataFrame([(0, 0, 0, 1, 0.5), (0, 0, 0, 2, None), (0, 1, 0, 3, 0.5)], "draw int, grp int, cand int, precinct int, b double")
    sizes = spark.createDataFrame([(1, 10), (2, 10), (3, 0)], "precinct int, n bigint")
    assert {r["grp"]: r["v"] for r in E.district_draws(draws, sizes).collect()} == {0: 0.5, 1: None}
    got = {r["grp"]: r["mean"] for r in E.summary(draws.withColumn("grp", F.when(F.col("grp") == 0, 0)), ["grp"], "b").collect()}
    assert got == {0: 0.5, None: 0.5}


def test_repeated_changes_take_one(spark):
    target = spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, v string")
    changes = spark.createDataFrame([(1, "b"), (1, "a")], "k bigint, v string")
    assert sorted(tuple(r) for r in TB.update_from(target, changes, "k", ["v"]).collect()) == [(1, "a"), (2, "y")]
    assert J.lookup(target.select("k"), changes, "k", ["v"]).count() == 2


def test_log_logistic_stays_finite(spark):
    got = spark.range(1).select(S.log_logistic(F.lit(1.0), F.lit(0.0), F.lit(2000.0), (1.0, 0.5, -0.4)).alias("v")).first()["v"]
    assert got == pytest.approx(-799.0)


def test_contains_join_is_linear_in_the_text(spark):
    text = "abc def " * 8000 + "needle in it"
    names = spark.createDataFrame([("Needle",), ("def abc",), ("no",), ("",), ("x" * 70000,)], "name string")
    found = J.contains_join(spark.createDataFrame([(1, text), (2, None)], "k bigint, t string"), names, "k", "t", "name").collect()
    assert {tuple(r) for r in found} == {(1, "Needle"), (1, "def abc")}


def test_ranges_grow_with_the_rows(spark):
    counts = [O.with_ranges(spark.range(n).withColumn("k", F.lit(1)), ["k"], [F.col("id")]).select("_range").distinct().count() for n in (100, 400)]
    assert counts[0] >= 4 and counts[1] >= 3 * counts[0]


def test_delimited_text_cannot_mislabel_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"ID","name"\n1,"caf\x93x\x94"\n')
    assert [tuple(r)[:2] for r in FI.read_mixed_encoding(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect()] == [("1", "caf\u201cx\u201d")]
    for name, text in (("b", "id,name\n1,x\n"), ("c", "name,id\ny,2\n"), ("d", "id,name\n3,z\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    paths = [str(tmp_path / f"{n}.csv") for n in "bcd"]
    both = FI.read_many(spark, paths)
    assert sorted((r["id"], r["name"]) for r in both.collect()) == [("1", "x"), ("2", "y"), ("3", "z")]
    with pytest.raises(Exception):
        FI.read_delimited(spark, paths[:2]).collect()
    (tmp_path / "e.csv").write_text('id,name\n1,"two\nlines"\n')
    assert FI.read_records(spark, str(tmp_path / "e.csv")).collect()[0]["name"] == "two\nlines"


def test_multipolygon_keeps_all_parts(spark, tmp_path):
    square = "[[0,0],[0,1],[1,1],[0,0]]"
    (tmp_path / "g.json").write_text('{"features":[{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[%s],[%s,%s]]},"properties":{"a":"1"}},'
                                     '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[%s]},"properties":{"a":"2"}}]}' % ((square,) * 4))
    rows = FI.read_geojson(spark, str(tmp_path / "g.json")).collect()
    assert [[len(part) for part in r["geometry"]["parts"]] for r in rows] == [[1, 2], [1]]


def test_separable_and_broken_groups_are_flagged(spark):
    rows = [("ok", float(i % 7), int(i * 7919 % 11 < 3 + i % 7)) for i in range(300)] + [("split", float(i), int(i > 50)) for i in range(100)] + [("null", None, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = {r["g"]: r["converged"] for r in M.grouped_logistic(df, ["g"], ["x"], "y").collect()}
    assert got == {"ok": True, "split": False}
    keyed = df.withColumn("k", F.monotonically_increasing_id())
    out = {r["g"]: r for r in M.per_group_sensitivity(keyed, "g", "k", ["x"], "x", "y", F.lit(True), min_rows=20, splits=2).collect()}
    assert out["ok"]["intercept"] is not None and out["split"]["intercept"] is None and not out["split"]["converged"] and "null" not in out


def test_repeated_points_and_parts_in_polygons(spark):
    ring = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    polys = spark.createDataFrame([(1, ring(0.0)), (1, ring(10.0)), (2, ring(20.0))], "poly_id bigint, ring array<struct<lon: double, lat: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 11.0), (3, 1.0, 5.0), (4, 1.0, 21.0)], "point_id bigint, lat double, lon double")
    assert sorted(tuple(r) for r in geo.points_in_polygons(points, polys).collect()) == [(1, 1), (2, 1), (4, 2)]
