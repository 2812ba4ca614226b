"""Row predicates. Each returns one ``Column``; an empty column list returns ``None`` (no condition)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions.hashing import HASH_SPACE, key_hash


def _any(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(or_, conditions) if conditions else None


def _all(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(and_, conditions) if conditions else None


def empty(cols: Sequence[str]) -> Column | None:
    """Any of the columns is blank or NULL."""
    return _any(F.col(c).isNull() | (F.col(c) == "") for c in cols)


def any_null(cols: Sequence[str]) -> Column | None:
    return _any(F.col(c).isNull() for c in cols)


def all_null(cols: Sequence[str]) -> Column | None:
    return _all(F.col(c).isNull() for c in cols)


def nonnull(cols: Sequence[str]) -> Column | None:
    return _all(F.col(c).isNotNull() for c in cols)


def nonempty(cols: Sequence[str]) -> Column | None:
    return _all(F.col(c).isNotNull() & (F.col(c) != "") for c in cols)


def equals(values: Mapping[str, object]) -> Column | None:
    return _all(F.col(c) == F.lit(v) for c, v in values.items())


def isin(values: Mapping[str, Sequence[object]]) -> Column | None:
    return _all(F.col(c).isin(list(v)) for c, v in values.items())


def in_range(limits: Mapping[str, tuple[float | None, float | None]]) -> Column | None:
    """Columns strictly between their limits; a limit that is None is open. NULL is in no range."""
    found = [F.col(c) > F.lit(low) for c, (low, _) in limits.items() if low is not None]
    found += [F.col(c) < F.lit(high) for c, (_, high) in limits.items() if high is not None]
    return _all(found)


def sampled(key: str, fraction: float, salt: int = 0) -> Column | None:
    """Bernoulli sampling by key hash: the same rows on every run; no condition from 1 upward."""
    if not fraction or fraction >= 1:
        return None
    return key_hash(key, salt) < F.lit(int(fraction * HASH_SPACE))


def compose(*, empty_cols: Sequence[str] = (), nonempty_cols: Sequence[str] = (), equal: Mapping[str, object] | None = None,
            among: Mapping[str, Sequence[object]] | None = None, null_cols: Sequence[str] = (),
            all_null_cols: Sequence[str] = (), nonnull_cols: Sequence[str] = (), sample: tuple[str, float] | None = None,
            extra: str | Column | None = None) -> Column:
    """AND of every group that is given; TRUE when none is."""
    groups = [empty(empty_cols), nonempty(nonempty_cols), equals(equal or {}), isin(among or {}), any_null(null_cols),
              all_null(all_null_cols), nonnull(nonnull_cols), sampled(*sample) if sample else None,
              F.expr(extra) if isinstance(extra, str) else extra]
    present = [g for g in groups if g is not None]
    return reduce(and_, present) if present else F.lit(True)


def has_point(lat: str = "latitude", lon: str = "longitude", wanted: bool = True) -> Column:
    """Rows with (or without) both coordinates filled."""
    return nonempty([lat, lon]) if wanted else empty([lat, lon])
