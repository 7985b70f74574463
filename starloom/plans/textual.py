"""Queries on names, paths, dates and angles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sky, text
from ..session import reachable
from .views import sql, view


def _part(spark, d):
    return reachable(spark).read.parquet(f"{d}/part.parquet")


def _orders(spark, d):
    return reachable(spark).read.parquet(f"{d}/orders.parquet")


def _uri():
    return F.concat(F.lit("s3://store/"), F.when(F.col("p_partkey") % 5 == 0, "raw").otherwise(F.concat(F.lit("l2b-v"), (F.col("p_partkey") % 30).cast("string"))), F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".fits"))


def version_extract(spark, d):
    return _part(spark, d).select("p_partkey", text.version_of(_uri()).alias("version"))


def uri_tail(spark, d):
    return _part(spark, d).select("p_partkey", text.tail_of(_uri()).alias("file"))


def designation_parse(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.format_string("(20%02d HK%d)", (F.col("p_partkey") % 30).cast("int"), F.col("p_partkey"))).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(" (2000 RL52)")))
    return _part(spark, d).select("p_partkey", text.designation(name).alias("designation"))


def sexagesimal(spark, d):
    k = F.col("p_partkey")
    ra = F.format_string("%02d:%02d:%02d.25", (k % 24).cast("int"), (k % 60).cast("int"), (k * 7 % 60).cast("int"))
    dec = F.format_string("%s%02d %02d'%02d.5", F.when(k % 2 == 0, "-").otherwise("+"), (k % 90).cast("int"), (k * 3 % 60).cast("int"), (k * 11 % 60).cast("int"))
    cut = lambda c: F.floor(c * 1e8 + 0.5) / 1e8
    return _part(spark, d).select("p_partkey", cut(text.hours_to_degrees(ra)).alias("ra"), cut(text.sexagesimal_degrees(dec)).alias("dec"))


def id_format(spark, d):
    cid = text.numbered("SX6M-", F.col("p_partkey"))
    return _part(spark, d).select("p_partkey", cid.alias("candidate_id"), text.marker_label(cid).alias("label"), text.clean_key(F.concat(F.lit(" "), F.lower(cid), F.lit(" "))).alias("key"))


def prefix_normalised(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(""), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("a/"), F.col("p_brand"))), F.when(F.col("p_partkey") % 3 == 0, "//").otherwise(""))
    return _part(spark, d).select("p_partkey", text.object_prefix(raw).alias("prefix"))


def time_columns(spark, d):
    t = F.col("o_orderdate")
    mjd = F.floor(sky.mjd_of(t) + 0.5).cast("long")
    return _orders(spark, d).select("o_orderkey", mjd.alias("mjd"), (F.floor(sky.julian_year(F.floor(sky.mjd_of(t) + 0.5)) * 1e6 + 0.5) / 1e6).alias("year"), text.short_date(t).alias("label"))


def banned_words(spark, d):
    return _part(spark, d).select("p_partkey", text.free_of(F.col("p_name"), ["almond", "steel", "discovery"]).alias("clean"))


def key_lines(spark, d):
    """Whitespace-separated fields of key lines, three at most before the rest."""
    line = F.concat_ws("  ", F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_name"))
    parts = F.split(line, r"\s+", 4)
    return _part(spark, d).where(line.contains("1")).select("p_partkey", parts[0].alias("first"), parts[2].alias("third"), parts[3].alias("rest"))


def angle_wrap(spark, d):
    s = view(spark, d, "src_a")
    return s.select("id", sky.angle_difference(((F.col("id") * 37) % 720).cast("double"), ((F.col("id") * 91) % 360).cast("double")).alias("diff"), F.pmod(F.col("id") - 500, F.lit(360)).alias("wrapped"))


def roundings(spark, d):
    """The four ways of rounding a half: to even, up, towards zero, down."""
    v = (F.col("id") - 7000) / 2.0
    return view(spark, d, "src_a").select("id", F.rint(v).alias("even"), F.floor(v + 0.5).cast("long").alias("up"), v.cast("long").alias("towards_zero"), F.floor(v).cast("long").alias("down"))


def rectangle_distances(spark, d):
    return view(spark, d, "src_a").select("id", sky.rectangle_distance("x", "y", 100, 100, 600, 400).alias("distance"))


def tail_expectation(spark, d):
    n = view(spark, d, "src_a").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.select((F.floor(sky.expected_tail("n", 5.0) * 1e9 + 0.5) / 1e9).alias("expected"))


def distinct_labels(spark, d):
    o = _orders(spark, d)
    return o.groupBy((F.col("o_custkey") % 50).alias("g")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("labels"))


def fingerprint(spark, d):
    return _part(spark, d).select("p_partkey", F.sha2(F.concat_ws(":", "p_name", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")), 256).alias("sha256"))


def id_union(spark, d):
    ids = [reachable(spark).read.parquet(f"{d}/{t}.parquet").select(F.col(c).cast("long").alias("id")) for t, c in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("customer", "c_custkey"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


def tagged_union(spark, d):
    a, b = view(spark, d, "src_a").select("id", "flux"), view(spark, d, "src_b").select("id", "flux", "snr")
    out = a.withColumn("epoch", F.lit("A")).unionByName(b.withColumn("epoch", F.lit("B")), allowMissingColumns=True)
    return out.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.count("snr").alias("n_snr"), F.max("flux").alias("top"))


def proper_motion(spark, d):
    s = view(spark, d, "sky_a")
    pm = F.when(F.col("id") % 4 != 0, (F.col("id") % 200 - 100).cast("double"))
    ra, dec = sky.propagated("ra", "dec", pm, pm, 2016.0, 2025.5)
    cut = lambda c: F.floor(c * 1e8 + 0.5) / 1e8
    return s.select("id", cut(ra).alias("ra"), cut(dec).alias("dec"))


QUERIES = {
    f.__name__: f
    for f in (
        version_extract, uri_tail, designation_parse, sexagesimal, id_format, prefix_normalised, time_columns, banned_words, key_lines, angle_wrap, roundings, rectangle_distances,
        tail_expectation, distinct_labels, fingerprint, id_union, tagged_union, proper_motion,
    )
}

_A = f"with {sql('src_a')}"
_URI = "'s3://store/' || case when p_partkey % 5 = 0 then 'raw' else 'l2b-v' || (p_partkey % 30) end || '/' || p_brand || '/' || p_partkey || '.fits'"
_LINE = "p_brand || '  ' || p_size || '  ' || p_partkey || '  ' || p_name"
_RAW = "case when p_partkey % 2 = 0 then '/' else '' end || case when p_partkey % 7 = 0 then '' else 'a/' || p_brand end || case when p_partkey % 3 = 0 then '//' else '' end"
SQL = {
    "version_extract": f"select p_partkey, regexp_extract({_URI}, '(l2b-v\\d+)', 1) as version from part",
    "uri_tail": f"select p_partkey, string_split({_URI}, '/')[-1] as file from part",
    "designation_parse": "select p_partkey, case when p_partkey % 3 = 0 then '20' || lpad((p_partkey % 30)::varchar, 2, '0') || ' HK' || p_partkey else p_partkey::varchar end as designation from part",
    "sexagesimal": "select p_partkey, floor((p_partkey % 24 + (p_partkey % 60) / 60.0::double + (p_partkey * 7 % 60 + 0.25::double) / 3600) * 15 * 1e8 + 0.5) / 1e8 as ra, floor(case when p_partkey % 2 = 0 then -1.0::double else 1.0::double end * (p_partkey % 90 + (p_partkey * 3 % 60) / 60.0::double + (p_partkey * 11 % 60 + 0.5::double) / 3600) * 1e8 + 0.5) / 1e8 as dec from part",
    "id_format": "select p_partkey, 'SX6M-' || lpad(p_partkey::varchar, greatest(3, length(p_partkey::varchar))::int, '0') as candidate_id, '#' || p_partkey as label, 'SX6M-' || lpad(p_partkey::varchar, greatest(3, length(p_partkey::varchar))::int, '0') as key from part",
    "prefix_normalised": f"select p_partkey, case when trim({_RAW}, '/') = '' then '' else trim({_RAW}, '/') || '/' end as prefix from part",
    "time_columns": "select o_orderkey, date_diff('day', date '1858-11-17', (o_orderdate + interval 12 hour)::date) as mjd, floor((2000 + (date_diff('day', date '1858-11-17', (o_orderdate + interval 12 hour)::date) - 51544.5::double) / 365.25::double) * 1e6 + 0.5) / 1e6 as year, strftime(o_orderdate, '%b %-d, %Y') as label from orders",
    "banned_words": "select p_partkey, not (contains(lower(p_name), 'almond') or contains(lower(p_name), 'steel') or contains(lower(p_name), 'discovery')) as clean from part",
    "key_lines": f"select p_partkey, regexp_split_to_array({_LINE}, '\\s+')[1] as first, regexp_split_to_array({_LINE}, '\\s+')[3] as third, regexp_replace({_LINE}, '^\\S+\\s+\\S+\\s+\\S+\\s+', '') as rest from part where contains({_LINE}, '1')",
    "angle_wrap": f"{_A} select id, abs((((id * 37) % 720 - (id * 91) % 360 + 180)::double % 360 + 360) % 360 - 180) as diff, ((id - 500) % 360 + 360) % 360 as wrapped from src_a",
    "roundings": f"{_A}, v as (select id, (id - 7000) / 2.0::double as v from src_a) select id, round_even(v, 0) as even, floor(v + 0.5)::bigint as up, trunc(v)::bigint as towards_zero, floor(v)::bigint as down from v",
    "rectangle_distances": f"{_A}, q as (select id, greatest(100.0::double - x, 0.0::double, x - 600.0::double) as dx, greatest(100.0::double - y, 0.0::double, y - 400.0::double) as dy from src_a) select id, sqrt(dx * dx + dy * dy) as distance from q",
    "tail_expectation": f"{_A} select floor(count(*) * exp(-5.0::double * 5.0::double / 2) * 1e9 + 0.5) / 1e9 as expected from src_a",
    "distinct_labels": "select o_custkey % 50 as g, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as labels from orders group by 1",
    "fingerprint": "select p_partkey, sha256(p_name || ':' || p_size || ':' || p_partkey) as sha256 from part",
    "id_union": "select s_suppkey as id from supplier union select p_partkey from part union select c_custkey from customer",
    "tagged_union": f"with {sql('src_a', 'src_b')} select 'A' as epoch, count(*) as n, 0::bigint as n_snr, max(flux) as top from src_a union all select 'B', count(*), count(snr), max(flux) from src_b",
    "proper_motion": f"with {sql('sky_a')}, p as (select *, coalesce(case when id % 4 <> 0 then (id % 200 - 100)::double end, 0) as pm from sky_a) select id, floor((ra + pm * 9.5::double / 3600000 / cos(radians(dec))) * 1e8 + 0.5) / 1e8 as ra, floor((dec + pm * 9.5::double / 3600000) * 1e8 + 0.5) / 1e8 as dec from p",
}
