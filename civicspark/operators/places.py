"""Stored place responses: flattening, first-seen counts, address reuse, geocode lookup, ranked reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions import scalars as S
from civicspark.operators import ordered as O
from civicspark.operators import tables as TB
from civicspark.session import dealt, materialise

ADDRESS = ["locationName", "line1", "line2", "line3", "city", "state", "zip"]
SCALARS = ["pollingHours", "startDate", "endDate", "notes"]
SOURCES = ["name", "official"]


def count_types(df: DataFrame, col: str) -> DataFrame:
    """Occurrences of each type in a JSON list column."""
    # explode_outer, here and below: plain explode adds a size() test that parses the text a second time
    kinds = df.select(F.explode_outer(F.from_json(col, "array<string>")).alias("kind")).filter(F.col("kind").isNotNull())
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def first_seen_counts(seen: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """Per point and type: how many places, and how many whose (type, name) no earlier point had.

    With ``types`` each point has a row for each of them, with zeros where it has no place of that type.
    The first point of a name is a minimum, so names are merged before they move; a name counts once. Places, first points and zeros
    are rows of one sum, dealt by point to as many partitions as the places need: nothing is joined.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    firsts = seen.groupBy("place_type", "name").agg(F.min("point").alias("point")).filter("place_type IS NOT NULL AND point IS NOT NULL")
    places = seen.select("point", "place_type", one.alias("total"), zero.alias("unseen"))
    rows = places.unionByName(firsts.select("point", "place_type", zero.alias("total"), one.alias("unseen")))
    sums = [F.sum(c).alias(c) for c in ("total", "unseen")]
    counts = dealt(rows, seen.count(), "point").groupBy("point", "place_type").agg(*sums)
    if types:
        blank = [F.struct(F.lit(t).alias("place_type"), zero.alias("total"), zero.alias("unseen")) for t in types]
        own = F.struct("place_type", "total", "unseen")
        counts = counts.select("point", F.explode(F.array(own, *blank)).alias("c")).select("point", "c.*").groupBy("point", "place_type").agg(*sums)
    return counts


def fill_same_address(df: DataFrame, address: Sequence[str], order: str, cols: Sequence[str], any_row: bool = False) -> DataFrame:
    """Fill NULL columns from the earliest row with the same address; an address with no part given matches nothing.

    Only earlier rows count unless ``any_row``. The earliest non-NULL value of an address is an aggregate:
    one row per address meets the table, whatever the number of people living there.
    """
    address = list(address)
    given = reduce(or_, [F.coalesce(F.col(a).cast("string"), F.lit("")) != "" for a in address])
    firsts = df.filter(given).groupBy(*[F.col(a).alias(f"_a_{a}") for a in address]).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v")))).alias(f"_f_{c}") for c in cols])
    cond = [F.col(a).eqNullSafe(F.col(f"_a_{a}")) for a in address]
    joined = df.join(firsts, cond, "left")
    filled = {}
    for c in cols:
        usable = F.lit(True) if any_row else F.col(f"_f_{c}.at") < F.col(order)
        filled[c] = F.coalesce(F.col(c), F.when(usable, F.col(f"_f_{c}.v")))
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def ecdf(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """Rank over size per group: ties get consecutive steps."""
    ranked = O.row_numbers(df, list(by), [F.col(value), F.col(tie)], "_rank")
    sizes = df.groupBy(*[F.col(b).alias(f"_b_{b}") for b in by]).agg(F.count(F.lit(1)).alias("_size"))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by])
    return ranked.join(sizes, same).withColumn("ecdf", F.col("_rank") / F.col("_size")).drop("_rank", "_size", *[f"_b_{b}" for b in by])


def mask_repeats(df: DataFrame, index: Sequence[str], tie: str) -> DataFrame:
    """Blank an index value unless its row is the first of its prefix in report order.

    The first row of a prefix is a minimum over (remaining index, tie): nothing is sorted.
    """
    out = df
    for i in range(len(index)):
        prefix = list(index[: i + 1])
        place = F.struct(*[F.col(c) for c in index[i + 1:]], F.col(tie))
        first = df.groupBy(*[F.col(c).alias(f"_p_{c}") for c in prefix]).agg(F.min(place).alias(f"_first_{i}"))
        out = out.join(first, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in prefix]).drop(*[f"_p_{c}" for c in prefix])
    shown = []
    for c in df.columns:
        if c in index:
            i = list(index).index(c)
            place = F.struct(*[F.col(x) for x in index[i + 1:]], F.col(tie))
            shown.append(F.when(place == F.col(f"_first_{i}"), F.col(c)).otherwise("").alias(c))
        else:
            shown.append(F.col(c))
    return out.select(*shown)


def flatten_places(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """One row per place and source of a stored response: type, position, and every field that any place, address or source has.

    Records are open: the usual fields always have a column, further ones get theirs (in name order, after the usual ones) when some
    response carries them. Their names come from one distributed pass, as many as there are distinct fields. Nested values stay JSON text.
    """
    parsed = df.select(*keep, F.explode_outer(F.from_json(col, "map<string,array<string>>")).alias("place_type", "places"))
    places = parsed.select(*keep, "place_type", F.posexplode_outer("places").alias("place_index", "_place")).filter(F.col("_place").isNotNull())
    places = places.withColumn("_p", F.from_json("_place", "map<string,string>")).drop("_place")
    places = places.withColumn("_a", F.from_json(F.col("_p")["address"], "map<string,string>")).withColumn("_s", F.from_json(F.col("_p")["sources"], "array<map<string,string>>"))
    places = materialise(places, "places")  # parsed once, read twice

    def names(level: str, keys: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.transform(F.coalesce(keys, none), lambda k: F.struct(F.lit(level).alias("level"), k.alias("key")))

    source_keys = F.flatten(F.transform("_s", lambda s: F.map_keys(s)))
    fields = places.select(F.explode(F.concat(names("", F.map_keys("_p")), names("Address", F.map_keys("_a")), names("Sources", source_keys))).alias("f"))
    found = {(r.level, r.key) for r in fields.select("f.*").distinct().collect()} - {("", "address"), ("", "sources")}

    def columns(level: str, usual: Sequence[str], record: Column) -> list[Column]:
        keys = [*usual, *sorted(k for at, k in found if at == level and k not in usual)]
        return [record[k].alias(level + k[:1].upper() + k[1:].lower()) for k in keys]

    flat = places.select(*keep, "place_type", "place_index", *columns("", SCALARS, F.col("_p")), *columns("Address", ADDRESS, F.col("_a")),
                         F.posexplode_outer("_s").alias("source_index", "_source"))
    out = flat.select(*[c for c in flat.columns if c != "_source"], *columns("Sources", SOURCES, F.col("_source")))
    return out.withColumn("SourcesOfficial", F.col("SourcesOfficial").try_cast("boolean").cast("int"))


def sample_first_place(df: DataFrame, col: str, keep: Sequence[str], types: Sequence[str] = ()) -> DataFrame:
    """Every attribute of the first place of each type (all types unless named), as rows (attribute, value).

    Whatever keys a place, its address and its sources carry: ``<type><Key>``, ``<type>Address<Key>`` and
    ``<type>Sources<i><Key>``, the type without its last letter. Values are text.
    """
    parsed = df.select(*keep, F.explode_outer(F.from_json(col, "map<string,array<string>>")).alias("kind", "places"))
    first = parsed.select(*keep, "kind", F.from_json(F.get("places", F.lit(0)), "map<string,string>").alias("m")).filter(F.col("m").isNotNull())
    if types:
        first = first.filter(F.col("kind").isin(list(types)))

    def named(entries: Column, prefix: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(F.concat(prefix, S.capitalize(e["key"])).alias("attribute"), e["value"].alias("value")))

    none = F.array().cast("array<struct<attribute:string,value:string>>")
    plain = named(F.filter(F.map_entries("m"), lambda e: ~e["key"].isin("address", "sources") & ~e["value"].rlike(r"^[\[{]")), F.lit(""))
    address = F.coalesce(named(F.map_entries(F.from_json(F.col("m")["address"], "map<string,string>")), F.lit("Address")), none)
    sources = F.transform(F.from_json(F.col("m")["sources"], "array<map<string,string>>"),
                          lambda s, i: named(F.map_entries(s), F.concat(F.lit("Sources"), i.cast("string"))))
    rows = first.select(*keep, "kind", F.explode(F.concat(plain, address, F.coalesce(F.flatten(sources), none))).alias("a"))
    kind = F.left("kind", F.length("kind") - 1)
    return rows.filter(F.col("a.value").isNotNull()).select(*keep, F.concat(kind, F.col("a.attribute")).alias("attribute"), F.col("a.value").alias("value"))


def normalise_address(parts: Sequence[Column]) -> Column:
    return F.upper(S.sanitize(F.concat_ws(" ", *[S.blank_to_null(p) for p in parts]), collapse=True))


def geocode(df: DataFrame, address: str, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Coordinates by address: the primary table, then the fallback for what it misses, with match and source.

    Tables: (address, lat, lon, tract); of several rows for an address the smallest counts. Each distinct address is looked up once and the
    result joined back, so a shared address costs one probe.
    """
    wanted = df.select(F.col(address).alias("_a")).filter(F.col(address) != "").distinct()
    def one(table: DataFrame, side: str) -> DataFrame:
        first = table.groupBy(F.col("address").alias(f"_{side}a")).agg(F.min(F.struct("lat", "lon", "tract")).alias("v"))
        return first.select(f"_{side}a", F.col("v.lat").alias(f"_{side}lat"), F.col("v.lon").alias(f"_{side}lon"), F.col("v.tract").alias(f"_{side}t"))

    p, f = one(primary, "p"), one(fallback, "f")
    found = wanted.join(p, F.col("_a") == F.col("_pa"), "left").join(f, F.col("_a") == F.col("_fa"), "left")
    hit, second = F.col("_plat").isNotNull(), F.col("_flat").isNotNull()
    coded = found.select("_a", F.when(hit, F.col("_plat")).otherwise(F.col("_flat")).alias("latitude"),
                         F.when(hit, F.col("_plon")).otherwise(F.col("_flon")).alias("longitude"),
                         F.when(hit, F.col("_pt")).otherwise(F.col("_ft")).alias("census_tract"), hit.cast("int").alias("match"),
                         F.when(hit, "primary").when(second, "fallback").alias("geocode_source"))
    return df.join(coded, F.col(address) == F.col("_a"), "left").drop("_a").withColumn("match", F.coalesce("match", F.lit(0)))


def distinct_places(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of every place key."""
    return TB.first_per_key(df, [key], [F.col(order)])
