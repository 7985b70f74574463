"""Views of the star-schema tables as sources, images, observations and spectra.

Each view is one projection in SQL that Spark and other engines read alike; arithmetic is on integers until the last cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import reachable


def _num(expr: str, by: int = 1) -> str:
    return f"cast({expr} as double) / cast({by} as double)"


_X, _Y = _num("(o_orderkey * 7919) % 100003", 100), _num("(o_orderkey * 104729) % 100019", 100)
_BX = f"{_X} + {_num('o_orderkey % 7 - 3')} * cast(0.125 as double)"
_BY = f"{_Y} + {_num('o_orderkey % 5 - 2')} * cast(0.125 as double)"
_SNR = "cast(1 + (o_orderkey * {}) % 997 as double) / cast(4 as double)"
_DAYS = {"spark": "datediff(o_orderdate, date'1858-11-17')", "duck": "date_diff('day', date '1858-11-17', cast(o_orderdate as date))"}

#: name: (table, columns, rest of the statement)
VIEWS = {
    "src_a": ("orders", f"o_orderkey as id, {_X} as x, {_Y} as y, o_totalprice as flux, {_SNR.format(31)} as snr", ""),
    "src_b": ("orders", f"o_orderkey as id, {_BX} as x, {_BY} as y, o_totalprice * cast(1 + o_orderkey % 3 as double) as flux, {_SNR.format(37)} as snr", "where o_orderkey % 10 <> 0"),
    "sky_a": ("orders", f"o_orderkey as id, 150 + ({_X}) / cast(100 as double) as ra, ({_Y}) / cast(200 as double) - 45 as dec, o_totalprice as flux", ""),
    "sky_b": ("orders", f"o_orderkey as id, 150 + ({_BX}) / cast(100 as double) as ra, ({_BY}) / cast(200 as double) - 45 as dec, o_totalprice * cast(1 + o_orderkey % 3 as double) as flux", "where o_orderkey % 10 <> 0"),
    "grid": ("lineitem", "cast(l_suppkey % 64 as int) as y, cast(l_partkey % 64 as int) as x, max(l_extendedprice) as v", "group by 1, 2"),
    "grid_b": ("lineitem", "cast(l_suppkey % 64 as int) as y, cast(l_partkey % 64 as int) as x, max(l_extendedprice * l_discount) as v", "group by 1, 2"),
    "obs": ("orders", f"o_orderkey as id, o_custkey as f, cast({{days}} as double) as mjd, cast(0.75 as double) + {_num('o_orderkey % 1000', 1000)} as wave, cast(0.04 as double) as bw", ""),
    "channels": ("part", "p_partkey as channel, p_size as detector, p_retailprice as wavelength", ""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, rest = VIEWS[name]
    source = reachable(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    columns = columns.format(days=_DAYS["spark"])
    if rest.startswith("group by"):
        y, x, v = columns.split(", ")
        agg = v.rsplit(" as ", 1)
        from pyspark.sql import functions as F

        return source.groupBy(F.expr(y), F.expr(x)).agg(F.expr(agg[0]).alias(agg[1]))
    if rest:
        source = source.where(rest.removeprefix("where "))
    return source.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def sql(*names: str) -> str:
    """WITH entries of the views, to stand before a query."""
    return ", ".join(f"{n} as (select {VIEWS[n][1].format(days=_DAYS['duck'])} from {VIEWS[n][0]} {VIEWS[n][2]})" for n in names)
