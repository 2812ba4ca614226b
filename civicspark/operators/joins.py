"""Joins with prefixed columns, anti and semi joins, lookups, substring matches.

No broadcast hints here: dimension tables grow with the data, so the optimizer and adaptive execution
choose the join from real sizes, and split skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOT = "$"


def prefixed(df: DataFrame, prefix: str, cols: Sequence[str] | None = None, dot: str = DOT) -> DataFrame:
    """Columns renamed ``<prefix><dot><name>``; ``None`` or ``*`` takes them all."""
    names = [n for c in (cols or ["*"]) for n in (df.columns if c == "*" else [c])]
    return df.select(*[F.col(c).alias(f"{prefix}{dot}{c}") for c in names])


def join_prefixed(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: str,
                  cols: Sequence[str] | None = None, how: str = "inner", dot: str = DOT) -> DataFrame:
    """Equi-join; the right side's columns arrive prefixed."""
    wanted = list(dict.fromkeys([right_key, *(cols or right.columns)]))
    side = prefixed(right, prefix, wanted, dot)
    key = f"{prefix}{dot}{right_key}"
    joined = left.join(side, left[left_key] == side[key], how)
    return joined if cols is None or right_key in cols else joined.drop(key)


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], where: Column | None = None,
              cols: dict[str, Sequence[str]] | None = None, dot: str = DOT) -> DataFrame:
    """Inner star join: ``dims`` holds (table, key in fact, key in table); the fact key is the prefix.

    One table may serve many keys. ``where`` applies to the fact before any join.
    """
    out = fact.filter(where) if where is not None else fact
    for table, fact_key, dim_key in dims:
        out = join_prefixed(out, table, fact_key, dim_key, fact_key, (cols or {}).get(fact_key), dot=dot)
    return out


def anti_distinct(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct keys of ``left`` with no partner in ``right``; de-duplicated before the join shuffles."""
    keys = left.select(F.col(left_key)).distinct()
    return keys.join(right.select(F.col(right_key).alias("_k")), F.col(left_key) == F.col("_k"), "left_anti")


def anti_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with no partner in ``right``, duplicates kept."""
    return left.join(right.select(F.col(right_key).alias("_k")), F.col(left_key) == F.col("_k"), "left_anti")


def semi(left: DataFrame, keys: DataFrame, left_key: str, key: str) -> DataFrame:
    return left.join(keys.select(F.col(key).alias("_k")), F.col(left_key) == F.col("_k"), "left_semi")


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys (ties: smaller key first) with their counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("num"))
    return counts.orderBy(F.desc("num"), F.asc(key)).limit(n)


def lookup(df: DataFrame, table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Fill columns from a table; NULL where the key is absent. Of several rows for a key the smallest values count (NULL first)."""
    one = table.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct(*values)).alias("_v"))
    return df.join(one, F.col(key) == F.col("_k"), "left").select(*df.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def numeric_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on text codes compared as numbers (``"007"`` meets ``"7"``); unreadable codes never match."""
    left_keys = [F.col(a).try_cast("bigint").alias(f"_l{i}") for i, (a, _) in enumerate(pairs)]
    right_keys = [F.col(b).try_cast("bigint").alias(f"_r{i}") for i, (_, b) in enumerate(pairs)]
    a, b = left.select("*", *left_keys), right.select("*", *right_keys)
    cond = [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(len(pairs))]
    return a.join(b, cond, how).drop(*[f"_l{i}" for i in range(len(pairs))], *[f"_r{i}" for i in range(len(pairs))])


def contains_join(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, gram: int = 3) -> DataFrame:
    """(key, name) pairs where the text contains the whole name, ignoring case; blank names are left out.

    Two equi-joins, no pairing of texts with names: the positions where a text holds some name's opening
    ``gram`` letters (one row per opening, with the lengths of the names behind it), then the piece of each such
    length against the whole name. A position carries no more of the text than the longest name. Names that share an opening cost one probe per distinct length. Names
    shorter than ``gram`` are matched against all pieces of their size. ``key`` identifies a text.
    """
    t = texts.select(F.col(key), F.lower(text).alias("_t"))
    n = names.select(name, F.lower(name).alias("_n")).filter(F.length("_n") > 0)
    shortest, longest = n.agg(F.min(F.length("_n")), F.max(F.length("_n"))).first()
    if longest is None:
        return t.select(key, F.lit(None).cast(names.schema[name].dataType).alias(name)).limit(0)

    def pieces(size: int, upto: int) -> Column:
        """At every position, what follows it: ``upto`` characters, at the end of the text fewer, but ``size`` at least."""
        return F.regexp_extract_all("_t", F.lit(f"(?s)(?=(.{{{size},{max(size, upto)}}}))"), F.lit(1))

    long = n.filter(F.length("_n") >= gram)
    openings = long.groupBy(F.left("_n", F.lit(gram)).alias("_g")).agg(F.collect_set(F.length("_n")).alias("_lengths"))
    spots = t.select(key, F.explode_outer(pieces(gram, longest)).alias("_p")).withColumn("_g", F.left("_p", F.lit(gram)))
    probes = spots.join(openings, "_g").select(key, "_p", F.explode("_lengths").alias("_l"))
    found = probes.select(key, F.left("_p", F.col("_l")).alias("_n")).join(long, "_n").select(key, name)
    if shortest < gram:
        short = t.select(key, F.explode_outer(F.flatten(F.array(*[pieces(s, s) for s in range(1, gram)]))).alias("_n"))
        found = found.unionByName(short.join(n.filter(F.length("_n") < gram), "_n").select(key, name))
    return found.dropDuplicates()


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the right side's keys do not come out."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
