"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is then rendered.

Every turn gets the fingerprint of the conversation up to it: two sums, modulo nothing (decimals), of 64-bit hashes of
(place, role, text), with the number of turns. The fingerprints of a conversation's proper prefixes are the probe side of an
anti-join against whole conversations; what no longer one contains is maximal. Distinct fingerprints are joined, so
that a first turn shared by a third of all conversations is one row. Only what stays is rendered. Only built-in DataFrame
functions are used.

Defined results: turns are ordered by turn number, null last, then role and the hash of the text; a null role or text counts as
empty; a turn without conv_id is a conversation of that one turn; of equal conversations the one with the least conv_id
stays, null being the least; repeated rows are turns of their own; very long texts are hashed and rendered whole; an empty table
gives an empty result. Columns beyond conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

SEEDS = (11, 23)


def _clean(turns: DataFrame) -> DataFrame:
    """conv_id, own, turn, role, text: turns of a conversation share conv_id and own; of equal turns without conv_id one stays."""
    clean = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    alone = clean.where("conv_id is null").distinct().withColumn("own", F.sha2(F.to_json(F.struct("turn", "role", "text")), 256))
    return clean.where("conv_id is not null").withColumn("own", F.lit("")).unionByName(alone)


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(s), "role", "text").alias(f"h{i}") for i, s in enumerate(SEEDS)]


def prefix_fingerprints(clean: DataFrame) -> DataFrame:
    """conv_id, own, n, place (from 1), p0, p1: the fingerprint of the conversation of n turns up to each turn."""
    whole = W.partitionBy("conv_id", "own")
    line = whole.orderBy(F.asc_nulls_last("turn"), "role", "h0", "h1")
    hashed = clean.select("conv_id", "own", "turn", "role", *_hashes()).withColumn("place", F.row_number().over(line))
    upto = line.rowsBetween(W.unboundedPreceding, 0)
    sums = [
        F.sum(F.xxhash64(F.lit(s), "place", f"h{i}").cast("decimal(20,0)")).over(upto).alias(f"p{i}") for i, s in enumerate(SEEDS)
    ]
    return hashed.select("conv_id", "own", F.count(F.lit(1)).over(whole).alias("n"), "place", *sums)


def maximal(clean: DataFrame) -> DataFrame:
    """conv_id, own and n_turns of the conversations that neither equal an earlier id's nor begin a longer one."""
    prefixes = Scratch(clean.sparkSession).keep(prefix_fingerprints(clean), "prefixes")
    whole = prefixes.where("place = n").groupBy("place", "p0", "p1").agg(F.min(F.struct("conv_id", "own")).alias("c"))
    inner = prefixes.where("place < n").select("place", "p0", "p1").distinct()
    return whole.join(inner, ["place", "p0", "p1"], "left_anti").select("c.conv_id", "c.own", F.col("place").cast("long").alias("n_turns"))


def rendered() -> Column:
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", *_hashes(), "text"))),
        lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")),
    )
    return F.array_join(lines, "")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: the maximal conversations, formatted."""
    clean = _clean(turns)
    kept = maximal(clean).withColumnsRenamed({"conv_id": "_id", "own": "_own"})
    stay = clean.join(kept, clean.conv_id.eqNullSafe(kept["_id"]) & (clean.own == kept["_own"]))
    return stay.groupBy("conv_id", "own").agg(F.first("n_turns").alias("n_turns"), rendered().alias("rendered")).drop("own")


def op6_collapse(spark, sf_dir) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
with c as (
  select conv_id, count(*) as n_turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' order by turn nulls last, coalesce(role, ''), coalesce(text, '')) as rendered
  from conversations group by conv_id),
one as (select min(conv_id) as conv_id, n_turns, rendered from c group by n_turns, rendered)
select conv_id, n_turns, rendered from one a
where not exists (select 1 from one b where b.n_turns > a.n_turns and starts_with(b.rendered, a.rendered))
"""
