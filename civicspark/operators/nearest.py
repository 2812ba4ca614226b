"""The nearest places, or all within a distance, through an adaptive tree of cells.

The tree is a table. A cell is cut into up to 64 children until it holds few places; each cell that is kept has its bounding
box and its count, and is stored in its parent's row. A search is a chain of equi-joins with one row per parent:

* the dive follows one child per level, whose box lies wholly nearest among those with enough places. The farthest corner of a box
  with enough places bounds the distance of the last place wanted;
* the descent then keeps the children whose box is not beyond that bound, which is fixed: rows never have to meet again on the way.
  A cell that holds few places is closed and waits for the end, so a dense region makes its own branch deep and no other;
* the places of the closed cells are compared.

Nothing is paired but points and places of cells within the bound. Hot cells are rows of a join whose other side has one
row per cell, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.geometry import unit_sphere
from civicspark.session import materialise

BITS = {"planar": 3, "geodesic": 2}  # a cell is cut into 2**bits parts per axis: 64 children
LEVELS = {"planar": 9, "geodesic": 10}
LEAF_PLACES = 16
LIMITS = {"planar": [(-90.0, 90.0), (-180.0, 180.0)], "geodesic": [(-1.0, 1.0)] * 3}


def dims(metric: str, lat: str, lon: str) -> list[Column]:
    """Coordinates in which straight distance grows with the metric's distance."""
    return [F.col(lat).cast("double"), F.col(lon).cast("double")] if metric == "planar" else unit_sphere(F.col(lat), F.col(lon))


def _total(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


class Tree:
    """Cells of places (place_id, place_type, lat, lon): ``children`` by parent, ``leaves`` with their places, ``depth``."""

    def __init__(self, places: DataFrame, metric: str, leaf: int, same: int | None):
        """``same``: how many places (smallest ids) of one type and spot are kept; None keeps all."""
        self.metric, self.axes = metric, range(len(LIMITS[metric]))
        bits, levels = BITS[metric], LEVELS[metric]
        places = places.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("place_id", "place_type", "lat", "lon")
        if same == 1:
            places = places.groupBy("place_type", "lat", "lon").agg(F.min("place_id").alias("place_id"))
        elif same is not None:
            number = F.row_number().over(Window.partitionBy("place_type", "lat", "lon").orderBy("place_id"))
            places = places.withColumn("_number", number).filter(F.col("_number") <= same).drop("_number")
        places = places.select("*", *[d.alias(f"d{i}") for i, d in zip(self.axes, dims(metric, "lat", "lon"))])
        places = materialise(places, "places")
        cells = 1 << (bits * levels)
        steps = [F.greatest(F.lit(0), F.least(F.floor((F.col(f"d{i}") - F.lit(lo)) * F.lit(cells / (hi - lo))), F.lit(cells - 1))).cast("bigint")
                 for i, (lo, hi) in zip(self.axes, LIMITS[metric])]

        def key(level: int) -> Column:
            return _total([F.shiftleft(F.shiftright(s, bits * (levels - level)), bits * levels * i) for i, s in zip(self.axes, steps)])

        path = F.array(*[F.struct(F.lit(n).alias("level"), key(n).alias("key"), key(n - 1).alias("parent")) for n in range(1, levels + 1)])
        spread = places.withColumn("_c", F.explode(path)).select("*", "_c.*").drop("_c")
        boxes = [F.min(f"d{i}").alias(f"lo{i}") for i in self.axes] + [F.max(f"d{i}").alias(f"hi{i}") for i in self.axes]
        nodes = spread.groupBy("place_type", "level", "key", "parent").agg(F.count(F.lit(1)).alias("n"), *boxes)
        nodes = materialise(nodes.withColumn("closed", (F.col("n") <= leaf) | (F.col("level") == levels)), "cells")
        cut = nodes.filter(~F.col("closed")).select("place_type", (F.col("level") + 1).alias("level"), F.col("key").alias("parent"))
        kept = nodes.filter("level = 1").unionByName(nodes.filter("level > 1").join(cut, ["place_type", "level", "parent"], "left_semi").select(*nodes.columns))
        kept = materialise(kept, "tree")
        self.depth = kept.agg(F.max("level")).first()[0] or 0
        child = F.struct("key", "n", *[f"lo{i}" for i in self.axes], *[f"hi{i}" for i in self.axes], "closed")
        self.children = kept.groupBy("place_type", (F.col("level") - 1).alias("above"), "parent").agg(F.collect_list(child).alias("children"))
        leaves = kept.filter("closed").select("place_type", "level", "key")
        self.leaves = spread.join(leaves, ["place_type", "level", "key"]).select(
            "place_type", F.col("level").alias("leaf_level"), F.col("key").alias("leaf"), "place_id", F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"),
            *[f"d{i}" for i in self.axes])
        self.types = places.select("place_type").distinct()

    def _side(self, level: int) -> DataFrame:
        side = self.children.filter(F.col("above") == level).select(F.col("place_type").alias("_type"), F.col("parent").alias("_parent"), "children")
        # the first two levels have at most 1 and 64 parents per type, on which a shuffle would gather all points
        return F.broadcast(side) if level < 2 else side

    def search(self, spots: DataFrame, want: int | None, reach: float | None) -> DataFrame:
        """Pairs of spots (lat, lon) and places that can be among the ``want`` nearest of a type and not beyond ``reach`` (in the metric's
        straight distance): spot, place, and the square ``_d`` of that distance."""
        q = [F.col(f"q{i}") for i in self.axes]
        spots = spots.select("lat", "lon", *[d.alias(f"q{i}") for i, d in zip(self.axes, dims(self.metric, "lat", "lon"))])
        live = spots.withColumn("_t", self.types.agg(F.collect_set("place_type").alias("t")).scalar())  # a dimension far smaller than the points
        start = F.lit(float("inf")) if reach is None else F.lit(reach * reach)
        live = live.withColumn("place_type", F.explode("_t")).drop("_t").select("*", F.lit(0).cast("bigint").alias("at"), start.alias("bound"))

        def gap(c: Column) -> Column:
            parts = [F.greatest(c[f"lo{i}"] - q[i], F.lit(0.0), q[i] - c[f"hi{i}"]) for i in self.axes]
            return _total([p * p for p in parts])

        def far(c: Column) -> Column:
            parts = [F.greatest(c[f"hi{i}"] - q[i], q[i] - c[f"lo{i}"]) for i in self.axes]
            return _total([p * p for p in parts]) * F.lit(1 + 1e-12)  # room for ties that rounding tells apart

        own = [c for c in live.columns if c not in ("at", "bound")]
        if want is not None:
            for level in range(self.depth):
                met = live.join(self._side(level), (F.col("place_type") == F.col("_type")) & (F.col("at") == F.col("_parent")), "left")
                enough = F.transform(F.filter("children", lambda c: c["n"] >= want), lambda c: F.struct(far(c).alias("far"), c["key"].alias("key"), c["closed"].alias("closed")))
                met = met.withColumn("best", F.array_min(enough))
                live = met.select(*own, F.when(~F.col("best.closed"), F.col("best.key")).alias("at"), F.least("bound", "best.far").alias("bound"))
            live = live.withColumn("at", F.lit(0).cast("bigint"))
        live = live.select(*own, "bound", "at", F.lit(None).cast("int").alias("leaf_level"), F.lit(None).cast("bigint").alias("leaf"))
        for level in range(self.depth):
            met = live.join(self._side(level), (F.col("place_type") == F.col("_type")) & (F.col("at") == F.col("_parent")), "left")
            near = F.transform(F.filter("children", lambda c: gap(c) <= F.col("bound")), lambda c: F.struct(
                F.when(~c["closed"], c["key"]).alias("at"), F.when(c["closed"], F.lit(level + 1)).alias("leaf_level"), F.when(c["closed"], c["key"]).alias("leaf")))
            stays = F.array(F.struct("at", "leaf_level", "leaf"))
            flat = met.select(*own, "bound", F.explode(F.when(F.col("leaf").isNotNull(), stays).otherwise(near)).alias("c"))
            live = flat.select(*own, "bound", "c.*")
        tried = live.filter(F.col("leaf").isNotNull()).join(self.leaves, ["place_type", "leaf_level", "leaf"])
        parts = [(q[i] - F.col(f"d{i}")) * (q[i] - F.col(f"d{i}")) for i in self.axes]
        tried = tried.withColumn("_d", _total(parts)).filter(F.col("_d") <= F.col("bound"))
        return tried.select("lat", "lon", "place_type", "place_id", "place_lat", "place_lon", "_d")


def spots_of(points: DataFrame) -> DataFrame:
    """Each distinct point is searched once. Their rows are few bytes and much work, so they keep the session's number of shuffle partitions
    instead of being coalesced by size."""
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon")
    return known.repartition(spread, "lat", "lon").distinct()
