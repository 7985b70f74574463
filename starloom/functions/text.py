"""Text expressions of the observation and candidate tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_of(uri: Column) -> Column:
    """The processing version in a path, '' if there is none."""
    return F.regexp_extract(uri, r"(l2b-v\d+)", 1)


def tail_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def designation(name: Column) -> Column:
    """'313052 (2000 RL52)' -> '313052'; '(2010 HK)' -> '2010 HK'."""
    name = F.trim(name)
    return F.when(name.startswith("("), F.regexp_replace(name, r"^\(|\).*$", "")).otherwise(F.split(name, " ")[0])


def _three(value: Column, pattern: str) -> Column:
    d, m, s = (F.regexp_extract(value, pattern, i).cast("double") for i in (2, 3, 4))
    return F.when(F.regexp_extract(value, pattern, 1) == "-", -1.0).otherwise(1.0) * (d + m / 60 + s / 3600)


def hours_to_degrees(value: Column) -> Column:
    """'10:21:55.11' as degrees."""
    return _three(value, r"^([+-]?)(\d+):(\d+):(\d+(?:\.\d+)?)") * 15


def sexagesimal_degrees(value: Column) -> Column:
    """\"-42 10'20.1\" as degrees; the sign holds for all parts."""
    return _three(value, r"^([+-]?)(\d+) (\d+)'(\d+(?:\.\d+)?)")


def numbered(prefix: str, n: Column, digits: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", n)


def marker_label(candidate: Column) -> Column:
    return F.concat(F.lit("#"), F.regexp_extract(candidate, r"-0*(\d+)$", 1))


def clean_key(value: Column) -> Column:
    return F.upper(F.trim(value))


def object_prefix(value: Column) -> Column:
    """A store prefix without surrounding slashes, with one at its end unless it is empty."""
    bare = F.regexp_replace(value, r"^/+|/+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("/")))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def free_of(value: Column, banned: list[str]) -> Column:
    """Whether none of the banned words occurs."""
    low = F.lower(value)
    out = F.lit(True)
    for b in banned:
        out = out & ~low.contains(b.lower())
    return out
