"""Scalar functions as Column expressions: strings, dates, numbers, conditions, stored JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The census label marker and the longest column name kept.
ESTIMATE_MARKER = "Estimate!!"
LABEL_LENGTH = 42

# Two-letter state codes and state names.
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "MH": "Marshall Islands",
    "AE": "Armed Forces Middle East", "AA": "Armed Forces Americas", "AP": "Armed Forces Pacific",
}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def join_address(parts: Sequence[Column], state: str, zip_code: Column) -> Column:
    """Non-empty parts joined by a space, the state name before the zip code."""
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts], F.lit(state), blank_to_null(zip_code))


def sanitize(c: Column, collapse: bool = False) -> Column:
    """Commas become spaces; ``collapse`` also squeezes and trims whitespace."""
    spaced = F.replace(c, F.lit(","), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, r"\s+", " ")) if collapse else spaced


def clean_label(label: Column) -> Column:
    """A census label as a column name."""
    tail = F.substring_index(label, ESTIMATE_MARKER, -1)
    name = F.replace(tail, F.lit("!"), F.lit(""))
    for old in (":", " ", "(", ")", "__"):
        name = F.replace(name, F.lit(old), F.lit("_"))
    return F.substring(name, 1, LABEL_LENGTH)


def pad_code(c: Column, width: int) -> Column:
    """Left-pad with zeros; longer codes stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def strip_zeros(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


def metro_states(metro: Column) -> Column:
    """State codes in the part after the last comma of a metro name."""
    return F.split(F.trim(F.element_at(F.split(metro, ","), -1)), "-")


def state_name(code: Column) -> Column:
    """The name of a state code, NULL for an unknown one. The table has a fixed size, so it is a literal map instead of a join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair]), code)


def state_code(name: Column) -> Column:
    """The code of a state's name in any case, NULL for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for code, full in STATE_NAMES.items() for x in (full.lower(), code)]), F.lower(name))


def metro_state(metro: Column, marker: str = "multiple") -> Column:
    """The one state of a metro, or ``marker`` when it spans several."""
    states = metro_states(metro)
    return F.when(F.size(states) == 1, F.element_at(states, 1)).otherwise(F.lit(marker))


def election_column(date: Column, prefix: str = "", suffix: str = "") -> Column:
    """``2016-11-08`` as ``voted_2016_11_08``."""
    return F.concat(F.lit(f"{prefix}voted_"), F.translate(date, "-", "_"), F.lit(suffix))


def election_column_name(date: str) -> str:
    return "voted_" + date.replace("-", "_")


def to_day(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """A date, or NULL where the text is not one."""
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def days_to(text: Column, end: str, fmt: str = "yyyy-MM-dd") -> Column:
    return F.datediff(F.to_date(F.lit(end)), to_day(text, fmt))


def age_years(text: Column, end: str, fmt: str = "yyyy-MM-dd") -> Column:
    """Days to ``end`` times 1/365: not calendar years."""
    return days_to(text, end, fmt) * F.lit(1 / 365)


def year_to_age(year: Column, end_year: int) -> Column:
    return F.lit(end_year) - year.try_cast("double")


def threshold(x: Column, limit: int) -> Column:
    """1.0 up to ``limit`` (whole numbers), else 0.0."""
    return F.when(x < F.lit(limit + 0.5), F.lit(1.0)).otherwise(F.lit(0.0))


def nonnull_flag(c: Column, null_value=0, other_value=1) -> Column:
    return F.when(c.isNotNull(), F.lit(other_value)).otherwise(F.lit(null_value))


def relabel(c: Column, values: Mapping[object, object], default=None) -> Column:
    """Map values; others become ``default`` (NULL unless given)."""
    pairs = list(values.items())
    out = F.when(c == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for old, new in pairs[1:]:
        out = out.when(c == F.lit(old), F.lit(new))
    return out.otherwise(F.lit(default))


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    return num / F.nullif(den, F.lit(0))


def fraction(parts: Sequence[Column], total: Column) -> Column:
    return ratio(reduce(add, parts).cast("double"), total)


def logistic(intercept: Column, theta: Column, r: Column, beta: Sequence[float]) -> Column:
    """1 / (1 + exp(-(b0 + b1 theta + b2 r)))."""
    z = intercept * F.lit(beta[0]) + F.lit(beta[1]) * theta + F.lit(beta[2]) * r
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_logistic(intercept: Column, theta: Column, r: Column, beta: Sequence[float]) -> Column:
    """log(logistic), finite for any finite argument."""
    z = intercept * F.lit(beta[0]) + F.lit(beta[1]) * theta + F.lit(beta[2]) * r
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def log_gamma_int(n: Column) -> Column:
    """ln(n!) for a whole number: exact summation to 32, then the Stirling series (error below 1e-13)."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(32))).cast("int")), F.lit(0.0),
                        lambda acc, k: acc + F.log(k.cast("double")))
    large = (x * F.log(x) - x + F.lit(0.5) * F.log(F.lit(6.283185307179586) * x) + F.lit(1.0) / (12.0 * x)
             - F.lit(1.0) / (360.0 * F.pow(x, F.lit(3.0))) + F.lit(1.0) / (1260.0 * F.pow(x, F.lit(5.0))))
    return F.when(n < 2, F.lit(0.0)).when(n <= 32, small).otherwise(large)


def log_binom(n: Column, k: Column) -> Column:
    """ln C(n, k); NULL outside 0 <= k <= n."""
    inside = (k >= 0) & (k <= n)
    return F.when(inside, log_gamma_int(n) - log_gamma_int(k) - log_gamma_int(n - k))


def truncate(x: Column, digits: int) -> Column:
    return F.floor(x * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)


def capitalize(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def parse_coordinate(text: Column) -> tuple[Column, Column]:
    """``"lon,lat"`` as two doubles, both NULL unless both parse."""
    parts = F.split(text, ",")
    lon = F.get(parts, F.lit(0)).try_cast("double")
    lat = F.get(parts, F.lit(1)).try_cast("double")
    ok = (F.size(parts) == 2) & lon.isNotNull() & lat.isNotNull()
    return F.when(ok, lon), F.when(ok, lat)


def pick_component(components: Column, kind: str, field: str) -> Column:
    """``field`` of the first typed component that carries the type ``kind``."""
    hit = F.filter(components, lambda c: F.array_contains(c["types"], F.lit(kind)))
    return F.get(hit, F.lit(0))[field]
