"""Mixing sources to target weights by Sainte-Lague apportionment, taken in equal-token blocks.

Seats (words) go to sources by the highest quotients target / (2k - 1); each source's seats go to its shards in the same
way by their sizes, so that no shard is dealt more than the cap while the source isn't. Every source's documents form, in
a seeded order, a stream of words that is cut into blocks of one size; within a shard a seeded permutation orders the
blocks, and whole blocks, the last one in part, fill the quota. A quota beyond a shard's own words repeats whole passes
over it. Only built-in DataFrame functions are used.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own; repeated rows (of one
source, doc_id, null or not, and size) are documents of their own, which are counted first and stand side by side in the stream; an
empty table gives an empty result; ties in the order fall to doc_id, then size; a very long text may span any number of
blocks; columns beyond doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, count_words, each_copy, guarded, sized_broadcast

SHARDS = 64
#: Documents that one ordering window holds on average; the windows' number follows the source's size.
CELL_DOCS = 256
MAX_BLOCK = 1024
MIN_BLOCKS = 65_536
REPEAT_CAP = 3
#: A prime above any number of blocks in a shard: i -> (i * PRIME + offset) mod n permutes the n blocks.
PRIME = 2_147_483_647


def sainte_lague(df: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: ``seats`` of each group dealt to its parties by the highest quotients votes / (2k - 1).

    Rounding votes * seats / total gives all but a few of the seats; the missing ones go to the highest of the next
    quotients, surplus ones are taken from the lowest awarded. Ties: the party that sorts first wins.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total = F.sum(votes).over(g)
    rounded = F.when(total > 0, F.floor(F.col(votes) * F.col(seats) / total + F.lit(0.5))).otherwise(0).cast("long")
    base = df.withColumn("_k", rounded).withColumn(
        "_over", F.when(total > 0, F.sum("_k").over(g) - F.col(seats)).otherwise(0).cast("long")
    )
    # candidate seats: the next |over| of each party if seats are missing, its last |over| if there are too many
    options = (
        base.where((F.col("_over") != 0) & (F.col(votes) > 0))
        .withColumn("_j", F.explode(F.sequence(F.lit(1), F.abs("_over"))))
        .withColumn("_seat", F.when(F.col("_over") > 0, F.col("_k") - F.col("_j") + 1).otherwise(F.col("_k") + F.col("_j")))
        .where(F.col("_seat") > 0)
        .withColumn("_q", F.col(votes) / (2 * F.col("_seat") - 1))
    )
    rank = F.when(
        F.col("_over") > 0,
        F.row_number().over(g.orderBy(F.asc("_q"), F.desc_nulls_first(party), F.desc("_seat"))),
    ).otherwise(F.row_number().over(g.orderBy(F.desc("_q"), F.asc_nulls_last(party), F.asc("_seat"))))
    keys = [*group, party]
    change = (
        options.withColumn("_rank", rank)
        .where(F.col("_rank") <= F.abs("_over"))
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("_over") > 0, -1).otherwise(1)).alias("_change"))
    )
    c = change.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_change")
    cond = F.lit(True)
    for k in keys:
        cond = cond & base[k].eqNullSafe(c[f"_c_{k}"])
    return base.join(c, cond, "left").select(
        *df.columns, (F.col("_k") + F.coalesce("_change", F.lit(0))).cast("long").alias("quota")
    )


def targets(sources: DataFrame, cap: float = REPEAT_CAP) -> DataFrame:
    """Adds ``target``: the sum of all sizes shared by ``weight``, none above ``cap`` times the source's size.

    In ascending order of cap / weight a source is capped while its level stays below that of the rest.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("_ratio"), F.asc_nulls_last("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_level", level)
        .withColumn("_open", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("_ratio") <= F.col("_level"), F.col("_cap"))
            .otherwise(F.least("_cap", F.col("weight") * F.col("_open")))
            .cast("double"),
        )
        .drop("_cap", "_ratio", "_level", "_open")
    )


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1..cycle, repeating, over sources by code point, null last."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")))
    return sources.withColumn("weight", (1 + (place - 1) % cycle).cast("double"))


def _hex(key: str, start: int, length: int) -> Column:
    return F.conv(F.substring(key, start, length), 16, 10).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, seed: str = "mix", cap: int = REPEAT_CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    ``docs`` needs doc_id, text and source; ``weights`` (source, weight) defaults to 1, 2, 3 repeating.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.keep(
        docs.select("doc_id", "source", count_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).select(
            "*", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("size").cast("string"))).alias("key")
        ),
        "sized",
    ).withColumn("shard", _hex("key", 1, 4) % SHARDS)

    per_shard = scratch.keep(
        sized.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"), F.count(F.lit(1)).alias("n_docs")), "shards"
    )
    sources = per_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size"), F.sum("n_docs").alias("n_docs"))
    if weights is None:
        sources = cyclic_weights(sources)
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, sources.source.eqNullSafe(w["_s"])).drop("_s")
    all_words = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    block = F.least(F.lit(MAX_BLOCK), F.greatest(F.lit(1), (all_words / MIN_BLOCKS).cast("long"))).cast("long")
    shared = targets(sources, cap).withColumn("block", block)
    shared = shared.withColumn("seats", F.floor(F.sum("target").over(W.partitionBy(F.lit(0)))).cast("long"))
    dealt = scratch.keep(
        sainte_lague(shared, [], "source", "target", "seats").select(
            "source", "source_size", "target", "block", F.least("quota", F.col("source_size") * cap).cast("long").alias("source_words"),
            F.greatest(F.lit(1), F.ceil(F.col("n_docs") / (SHARDS * CELL_DOCS))).cast("long").alias("cells"),
        ),
        "sources",
    )
    d = dealt.withColumnRenamed("source", "_s")
    joined = per_shard.join(sized_broadcast(d), per_shard.source.eqNullSafe(d["_s"])).drop("_s")
    joined = joined.withColumn("votes", F.col("shard_size").cast("double"))
    quotas = sainte_lague(joined, ["source"], "shard", "votes", "source_words").select(
        "source", "shard", "shard_size", "source_size", "target", "block", "cells", F.col("quota").alias("quota_words")
    )
    quotas = scratch.keep(quotas, "quotas")

    # every document's place in its shard's stream: words of earlier cells, then of earlier documents of its cell
    q = quotas.withColumnsRenamed({"source": "_s", "shard": "_h"})
    placed = sized.join(sized_broadcast(q), sized.source.eqNullSafe(q["_s"]) & (sized.shard == q["_h"])).drop("_s", "_h")
    placed = placed.withColumn("cell", _hex("key", 5, 8) % F.col("cells"))
    per_cell = placed.groupBy("source", "shard", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("cell_size"))
    earlier = W.partitionBy("source", "shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = per_cell.select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), F.col("cell").alias("_c"),
        F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("cell_start"),
    )
    inside = W.partitionBy("source", "shard", "cell").orderBy("key", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(inside))
    placed = placed.join(
        sized_broadcast(starts),
        placed.source.eqNullSafe(starts["_s"]) & (placed.shard == starts["_h"]) & (placed.cell == starts["_c"]),
    ).drop("_s", "_h", "_c")

    b, z = F.col("block"), F.col("shard_size")
    taken = (
        each_copy(placed, "copies", "copy")
        .withColumn("last", F.col("cell_start") + F.col("upto") - F.col("copy") * F.col("size"))
        .withColumn("first", F.col("last") - F.col("size"))
        .withColumn("passes", F.when(z > 0, F.floor(F.col("quota_words") / z)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("quota_words") - F.col("passes") * z)
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(z / b)).cast("long"))
        .withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.col("blocks")))
    )

    def position(i: Column) -> Column:
        return F.pmod(i * F.lit(PRIME) + F.col("offset"), F.col("blocks"))

    # words before a block in the permuted order: whole blocks, of which the stream's last one is short
    short = F.col("blocks") * b - z

    def words_of(i: Column) -> Column:
        before = position(i) * b - F.when(position(F.col("blocks") - 1) < position(i), short).otherwise(0)
        span = F.greatest(F.lit(0), F.least(b, F.col("rest") - before))
        return F.greatest(F.lit(0), F.least(F.col("last"), i * b + span) - F.greatest(F.col("first"), i * b))

    covered = F.when(
        (F.col("size") > 0) & (F.col("rest") > 0),
        F.aggregate(
            F.sequence(F.floor(F.col("first") / b).cast("long"), F.floor((F.col("last") - 1) / b).cast("long")),
            F.lit(0).cast("long"),
            lambda acc, i: acc + words_of(i),
        ),
    ).otherwise(0)
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + covered).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, *, seed: str = "mix") -> DataFrame:
    """``docs`` as the mix repeats them; columns stay those of ``docs``.

    A document of which the mix takes a share comes floor(taken / size + u) times, u being a seeded number in [0, 1) of its
    own: on average as often as it is taken, whatever a document's length is to a block's.
    """
    docs, back = guarded(docs, "doc_id", "text", "source")
    m = mix(docs, weights, seed=seed)
    chance = _hex("_key", 1, 8) / F.lit(float(1 << 32))
    copies = (
        m.where("size > 0")
        .groupBy("doc_id", "size")
        .agg((F.sum("taken") / F.sum("size")).alias("_share"))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("copies"), F.col("doc_id").cast("string"), F.col("size").cast("string"))))
        .select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.floor(F.col("_share") + chance).cast("int").alias("_copies"))
        .where("_copies > 0")
    )
    sized = docs.withColumn("_words", count_words(F.col("text")))
    return back(
        sized.join(copies, sized.doc_id.eqNullSafe(copies["_id"]) & (F.col("_words") == F.col("_size")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    )


def op1_mix(spark, sf_dir) -> DataFrame:
    from .common import table

    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")
