"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly.

Every benchmark item is cut into windows of WINDOW consecutive words (shorter items are one window). A window's tokens
are ordered by rarity over all documents; since containment must be whole, its prefix is its one rarest token, and
only places of documents that have that token meet the window, with the words around them. Length and position bounds discard
windows that can't fit, the words are compared, and the places of each occurrence are counted. Built-in functions only.

Documents are read in place: neither they nor their words are shuffled. A bitmap of the prefix tokens' hashes picks the places
(a false one fails the join); these meet the windows, which are broadcast up to a checked number; beyond it the places are
shuffled by their tokens.

Defined results: null texts have no words; items without words have no windows; equal items are found together; null
item_ids count as hits but name no item; repeated documents are rows of their own; ties of rarity fall to the longer, then the
smaller token; very long texts are searched whole; an empty benchmark hits nothing. Columns beyond doc_id, text and
item_id are ignored, whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, guarded, sized_broadcast, table

WINDOW = 10
#: Everything that is not part of a word, in text with A-Z lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap for each prefix token, and in all.
BITS, MOST_BITS = 64, 1 << 22


def plain_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each between single spaces."""
    low = F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    ).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(F.coalesce(low, F.lit("")), GAP, " "))


def _split(plain: Column) -> Column:
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """win, len, items: the distinct windows of all items with the ids (as strings) of those that have them."""
    words = items.select(F.col("item_id").cast("string").alias("item"), _split(plain_words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("t"))
    return cut.groupBy("t").agg(F.collect_set("item").alias("items")).select(F.array_join("t", " ").alias("win"), F.col("t").alias("tokens"), F.size("t").alias("len"), "items")


def rarity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """token, n: how often each window token occurs in all documents."""
    wanted = windows.select(F.explode("tokens").alias("token")).distinct()
    words = docs.select(F.explode(_split(plain_words(F.col("text")))).alias("token"))
    found = words.join(sized_broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def with_prefix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``token`` (the rarest of the window; ties: the longer, then the smaller) and ``ahead``, the words before it."""
    each = windows.select("win", F.posexplode("tokens").alias("ahead", "token")).join(counts, "token")
    best = each.groupBy("win").agg(F.min(F.struct("n", (-F.length("token")).alias("l"), "token", "ahead")).alias("b"))
    return windows.join(best, "win").select("win", "tokens", "len", "items", F.col("b.token").alias("token"), F.col("b.ahead").alias("ahead"))


def _in_bitmap(windows: DataFrame):
    """A function (token) -> whether it may be a prefix token. The bitmap's size follows their number, up to MOST_BITS."""
    tokens = windows.select("token").distinct()
    bits = min(MOST_BITS, 1 << max(6, (BITS * tokens.count()).bit_length()))
    place = lambda t: F.xxhash64(t).bitwiseAND(F.lit(bits - 1))
    spot = tokens.select(place(F.col("token")).alias("h")).select(F.shiftright("h", 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    words = {r["at"]: r["bits"] for r in spot.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()}
    bitmap = F.lit(np.array([words.get(i, 0) for i in range(bits >> 6)], np.int64))
    return lambda t: F.getbit(F.get(bitmap, F.shiftright(place(t), 6).cast("int")), place(t).bitwiseAND(F.lit(63)).cast("int")) == 1


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (distinct item ids as strings, sorted) and the text's digest for every document."""
    windows = scratch.keep(item_windows(items, size), "windows")
    counts = scratch.keep(rarity(docs, windows), "counts")
    ready = scratch.keep(with_prefix(windows, counts), "ready")
    near = size - 1
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", _digest(F.col("text")).alias("digest"), _split(plain_words(F.col("text"))).alias("w"))
    listed = _in_bitmap(ready)
    places = F.array_compact(F.transform("w", lambda t, i: F.when(listed(t), i + 1)))
    around = F.transform(
        places, lambda p: F.struct(p.alias("p"), F.get("w", p - 1).alias("t"), F.greatest(F.lit(1), p - near).alias("from"), F.slice("w", F.greatest(F.lit(1), p - near), 2 * near + 1).alias("words"))
    )
    # a row for each place of a prefix token, and one without that carries the document itself
    asked = base.select("rid", "doc_id", "digest", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(around, F.array(F.lit(None)))).alias("at"))
    met = asked.join(sized_broadcast(ready, BROADCAST_ROWS), F.col("at.t") == F.col("token"), "left")
    # the prefix token's place says where the window would be: ``ahead`` words before it, the rest behind it
    start = F.col("at.p") - F.col("ahead")
    inside = (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    whole = F.when(inside, F.slice("at.words", start - F.col("at.from") + 1, F.col("len")) == F.col("tokens"))
    met = met.where(F.col("at").isNull() | F.coalesce(whole, F.lit(False)))
    hit = F.when(F.col("at").isNotNull(), F.sequence(start, start + F.col("len") - 1))
    found = met.select("rid", "doc_id", "digest", "n_words", hit.alias("hit"), "items")
    return (
        found.groupBy("rid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.first("digest").alias("digest"),
        )
        .drop("rid")
    )


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of an item. The ids to drop are joined, not the texts.

    Ids go with the digest of their text: clean documents stay that share a null or repeated id with one to drop.
    """
    scratch = Scratch(docs.sparkSession)
    docs, back = guarded(docs, "doc_id", "text")
    bad = contamination(docs, items, scratch).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    bad = scratch.keep(bad.distinct(), "bad")
    return back(docs.join(sized_broadcast(bad), docs.doc_id.eqNullSafe(bad["_id"]) & (_digest(docs.text) == bad["_digest"]), "left_anti"))


def op7_decontam(spark, sf_dir) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_SQL_WORDS} as w from benchmark),
win as (select distinct item, least(10, len(w)) as n, array_to_string(w[i : i + 9], ' ') as g
        from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
g as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
h as (select g.doc_id, g.i, g.n, win.item from g join win on g.g = win.g and g.n = win.n),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
s as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join s using (doc_id)
"""
