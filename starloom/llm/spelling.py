"""Spelling variants: words one edit apart, found by walking a trie as a table, level by level.

Words stand in two tries, one by their letters and one by their letters reversed, told apart by the first character of a node's name.
A trie is a table of edges: only nodes where words end or part are kept, so an edge carries all letters up to the next such node. States are
(word, rest, node): the rest is the part of the word behind its position. An edit in the second half of a word is found in the
forward trie, one in the first half in the other, so all states begin with an edge that leaves a word's own path in its second half.
There one letter is deleted (of equal neighbours the last) or replaced by a greater one; an insertion is the other word's deletion. Then
states join the edges by node and next letter until the rest is used up. Where that is at the end of another word, the two are near. An edge
has bits of hashes of all that follows it, and edits after which no word goes on so are dropped before they are states.

A form is the near word of largest n, if that is RATIO times the word's n; roots follow forms by doubling.

Defined results: null texts have no words; a null doc_id counts as the empty text before the colon; repeated rows count as often as they occur;
ties of n fall to the smaller word in code-point order; words longer than LONG letters are named by their digest, as are
prefixes of theirs, so a text of one endless word costs rows for its letters but no copies of it; columns beyond doc_id and text are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table
from .hashing import pieces, release

LEAST_LETTERS, LEAST_COUNT, RATIO, DELETED = 7, 2, 10, 31
#: Runs of letters, A-Z being lower-cased. A shorter run can't become a word; a run is matched whole, as it is taken from its first letter on.
_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
#: Letters up to which words and nodes are named by themselves.
LONG = 32
FORWARD, BACKWARD = ">", "<"
#: Bits of the sets of hashes that an edge has of what follows it.
PLACES = 124
SETS = [f"{c}{k}" for c in ("here", "after") for k in range(2)]
_PATHS = "node string, i int, size int, nxt string, wid string, n bigint"


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of the runs of some documents, added up before they are sent."""
    found: dict[str, int] = {}

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        ids = b.column(0).to_pylist()
        for start, texts in pieces(b.column(1)):
            for i, text in enumerate(texts, start):
                if not text:
                    continue
                doc_id = ids[i]
                crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run in _RUNS.findall(text.lower().decode()):  # of bytes, so only A-Z
                    h = zlib.crc32(run.encode(), crc)
                    if h % DELETED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    found[run] = found.get(run, 0) + 1
            if len(found) >= 100_000:
                yield batch()
                found = {}
    if found:
        yield batch()
    found = {}
    release()


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, one in DELETED with a letter deleted, of at least LEAST_LETTERS letters and LEAST_COUNT occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(_words_of, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _digest(h) -> str:
    return "#" + h.copy().hexdigest()


def _long_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the second half of long words' paths; names of prefixes come from one running digest."""
    schema = pa.schema([(k, pa.int32() if k in ("i", "size") else pa.int64() if k == "n" else pa.string()) for k in (x.split()[0] for x in _PATHS.split(", "))])
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            size, name = len(word), _digest(hashlib.sha256(word.encode()))
            for side, letters in ((FORWARD, word), (BACKWARD, word[::-1])):
                h = hashlib.sha256()
                for i in range(size + 1):
                    if i >= (size - 1) // 2:
                        node = letters[:i] if i <= LONG else _digest(h)
                        rows.append((side + node, i, size, letters[i] if i < size else None, name, n))
                        if len(rows) >= 10_000:
                            yield batch()
                            rows = []
                    if i < size:
                        h.update(letters[i].encode())
    if rows:
        yield batch()
    release()


def _place(rest: Column) -> Column:
    """A place among PLACES for a string."""
    return F.pmod(F.xxhash64(rest), F.lit(PLACES)).cast("int")


def _bits(place: Column) -> list[Column]:
    """PLACES bits in two numbers, the one of ``place`` set."""
    half = PLACES // 2
    bit = lambda k: F.pow(F.lit(2.0), k).cast("long")
    return [F.when(place < half, bit(place)).otherwise(0), F.when(place >= half, bit(place - half)).otherwise(0)]


def _meet(bits: list[Column], held: str) -> Column:
    """Whether the sets ``held`` (two columns of that name) have one of the bits."""
    return (bits[0].bitwiseAND(F.col(f"{held}0")) != 0) | (bits[1].bitwiseAND(F.col(f"{held}1")) != 0)


def _paths(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes on the second half of each short word's path in either trie, and those of long words (without their letters).

    Rows have the depth, the word's size, its next letter (null at its end) and n.
    """
    short = words.where(F.length("word") <= LONG).withColumn("size", F.length("word"))
    both = short.select("word", "n", "size", F.explode(F.array(F.struct(F.lit(FORWARD).alias("side"), F.col("word").alias("letters")), F.struct(F.lit(BACKWARD).alias("side"), F.reverse("word").alias("letters")))).alias("t"))
    at = both.select("word", "n", "size", "t.side", "t.letters", F.explode(F.sequence(((F.col("size") - 1) / 2).cast("int"), F.col("size"))).alias("i"))
    nxt = F.when(F.col("i") < F.col("size"), F.substring("letters", F.col("i") + 1, F.lit(1)))
    near = at.select(F.concat("side", F.substring("letters", F.lit(1), F.col("i"))).alias("node"), "i", "size", nxt.alias("nxt"), F.col("word").alias("wid"), "n")
    return near, words.where(F.length("word") > LONG).select("word", "n").mapInArrow(_long_paths, _PATHS)


def _turned(word: str) -> Column:
    """A word in the direction of the row's trie."""
    return F.when(F.substring("node", 1, 1) == BACKWARD, F.reverse(word)).otherwise(F.col(word))


def _spelt(own: DataFrame) -> DataFrame:
    """``own`` with the letters of every word, and its next one: short words are their names, so that only long ones carry them."""
    letters = F.coalesce("letters", _turned("wid"))
    return own.withColumn("letters", letters).withColumn("nxt", F.when(F.col("i") < F.col("size"), F.substring("letters", F.col("i") + 1, F.lit(1))))


def _hashed(unique: DataFrame) -> DataFrame:
    """A side of a join with one row a key, spread evenly: its partitions are hashed, so that the other side needn't be sorted."""
    return unique.hint("shuffle_hash")


def _tail(text: Column, start: Column | int) -> Column:
    return F.substring(text, F.lit(start) if isinstance(start, int) else start, F.length(text))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, near, near_n: each pair of ``words`` (word, n) that differ by one inserted, deleted or replaced letter, both ways round."""
    digest = F.concat(F.lit("#"), F.sha2(F.encode("word", "UTF-8"), 256))
    named = scratch.keep(words.where(F.length("word") > LONG).select(digest.alias("wid"), "word"), "named")
    short, long = _paths(words)
    ends = F.max(F.when(F.col("nxt").isNull(), F.struct("wid", "n"))).alias("end")
    nodes = short.unionByName(long).groupBy("node").agg(F.min("nxt").alias("lo"), F.max("nxt").alias("hi"), ends)
    kept = scratch.keep(nodes.where(F.col("end").isNotNull() | (F.col("lo") != F.col("hi"))).select("node", "end"), "nodes")
    slim = ("node", "i", "size", "wid", "n")
    own = short.select(*slim).join(_hashed(kept), "node").withColumn("letters", F.lit(None).cast("string"))
    far = long.select(*slim).join(_hashed(kept), "node").join(named, "wid")
    own = scratch.keep(own.unionByName(far.withColumn("letters", _turned("word")).drop("word")), "own")

    along = W.partitionBy("wid", F.substring("node", 1, 1)).orderBy("i")
    steps = own.select("node", "i", "size", "wid", "letters").withColumn("child", F.lead("node").over(along)).withColumn("upto", F.lead("i").over(along))
    steps = _spelt(steps.where(F.col("child").isNotNull()))
    label = F.substring("letters", F.col("i") + 1, F.col("upto") - F.col("i"))
    # what follows an edge's node in some word, with its first letter and without it
    steps = steps.withColumns({"here": _place(_tail(F.col("letters"), F.col("i") + 1)), "after": _place(_tail(F.col("letters"), F.col("i") + 2))})
    sets = [F.bit_or(v).alias(f"{c}{k}") for c in ("here", "after") for k, v in enumerate(_bits(F.col(c)))]
    edges = steps.groupBy("node", F.col("nxt").alias("c")).agg(F.first(label).alias("label"), F.first("child").alias("child"), *sets)
    edges = edges.join(_hashed(kept.withColumnRenamed("node", "child")), "child")
    edges = scratch.keep(edges.select("node", "c", "label", "child", "end", *SETS), "edges")

    cut, states = _seeds(own, edges)
    found = [scratch.keep(cut, "cut")]
    level = 0
    while True:
        states = scratch.keep(states.where((F.col("rest") != "") | F.col("end").isNotNull()), f"states{level}")
        scratch.drop(*(["own", "nodes"] if not level else [f"states{level - 1}"]))
        found.append(scratch.keep(states.where("rest = ''").select("wid", "n", "end"), f"found{level}"))
        going = states.where("rest <> ''").select("wid", "n", "rest", "node", F.substring("rest", 1, 1).alias("c"))
        if going.isEmpty():
            break
        level += 1
        moved = going.join(_hashed(edges), ["node", "c"]).where(F.col("rest").startswith(F.col("label")) & _meet(_bits(_place(_tail(F.col("rest"), 2))), "after"))
        states = moved.select("wid", "n", _tail(F.col("rest"), F.length("label") + 1).alias("rest"), F.col("child").alias("node"), "end")
    scratch.drop("edges", f"states{level}")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # an edit in the middle may be found in both tries
    pairs = pairs.select("wid", "n", F.col("end.wid").alias("near"), F.col("end.n").alias("near_n")).dropDuplicates(["wid", "near"])
    way = lambda *names: F.struct(*[F.col(c).alias(n) for c, n in zip(names, ("wid", "near", "near_n"), strict=True)])
    pairs = pairs.select(F.explode(F.array(way("wid", "near", "near_n"), way("near", "wid", "n"))).alias("p")).select("p.*")
    if named.isEmpty():
        return pairs.withColumnRenamed("wid", "word")
    return _unnamed(_unnamed(scratch.keep(pairs, "pairs"), named, "wid", "word"), named, "near", "near")


def _seeds(own: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words without their last letter, and the states after one edit where another edge leaves a word's path in its second half.

    A pair is found from one of its words: from the longer one, by a deletion, or from the one with the lesser letter where they differ.
    """
    here = own.where((F.col("i") >= F.floor(F.col("size") / 2)) & (F.col("i") < F.col("size")))
    cut = here.where((F.col("i") == F.col("size") - 1) & F.col("end").isNotNull()).select("wid", "n", "end")
    fans = edges.groupBy("node").agg(F.collect_list(F.struct("c", "label", "child", "end", *SETS)).alias("fan"))  # an edge for each letter at most
    out = _spelt(here.select("node", "i", "size", "wid", "n", "letters").join(_hashed(fans), "node"))
    out = out.withColumn("after", _place(_tail(F.col("letters"), F.col("i") + 2)))
    out = out.select("i", "nxt", "wid", "n", "letters", *[v.alias(f"_after{k}") for k, v in enumerate(_bits(F.col("after")))], F.explode("fan").alias("e"))
    out = out.where(F.col("e.c") != F.col("nxt")).select("i", "nxt", "wid", "n", "letters", "_after0", "_after1", "e.*")
    bits = [F.col("_after0"), F.col("_after1")]
    # an edit is gone into only if some word goes on so behind the edge
    replaced, deleted = (F.col("c") > F.col("nxt")) & _meet(bits, "after"), _meet(bits, "here")
    behind, tail = _tail(F.col("letters"), F.col("i") + 2), _tail(F.col("label"), 2)
    edits = F.array(*[F.when(ok, need) for ok, need in ((replaced, tail), (deleted, F.col("label")))])
    out = out.where(replaced | deleted).select("wid", "n", "child", "end", behind.alias("rest"), F.explode(edits).alias("need")).where(F.col("need").isNotNull() & F.col("rest").startswith(F.col("need")))
    return cut, out.select("wid", "n", _tail(F.col("rest"), F.length("need") + 1).alias("rest"), F.col("child").alias("node"), "end")


def _unnamed(rows: DataFrame, named: DataFrame, name: str, word: str) -> DataFrame:
    """Words in place of the names of long ones."""
    digest = F.col(name).startswith("#")
    far = rows.where(digest).join(named.select(F.col("wid").alias(name), F.col("word").alias("_word")), name).drop(name).withColumnRenamed("_word", word)
    return rows.where(~digest).withColumnRenamed(name, word).unionByName(far)


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where the forms (word, form) lead. Counts grow tenfold along a chain, so a few doublings reach the end."""
    step = forms.select("word", F.col("form").alias("root"))
    level = 0
    while True:
        step = scratch.keep(step, f"roots{level}")
        ahead = step.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = step.join(ahead, F.col("root") == F.col("_at"), "left")
        if joined.where(F.col("_next").isNotNull()).isEmpty():
            return step
        step = joined.select("word", F.coalesce("_next", "root").alias("root"))
        level += 1


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the texts."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(counted_words(docs), "words")
    near = near_words(words, scratch)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    told = words.join(best, "word", "left")
    strong = -F.col("best.rank") >= RATIO * F.col("n")
    told = told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.rank")).alias("form_n"),
    )
    told = scratch.keep(told, "told")
    ends = roots(told.where(F.col("form").isNotNull()).select("word", "form"), scratch)
    return told.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling(spark, sf_dir) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: The checksum is computed bit by bit into a table, then byte by byte.
ORACLE_SQL = """
with recursive tab as (
  select list(list_reduce([k::ubigint] || range(8)::ubigint[], lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by k) as t
  from range(256) as r(k)),
runs as (
  select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
hexed as (select run, hex(id || ':' || run) as x from runs where length(run) >= 7),
crc as (
  select run, xor(4294967295::ubigint, list_reduce([4294967295::ubigint] || list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::ubigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1]))) as h
  from hexed, tab),
cut as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from crc),
v as (select word, count(*) as n from cut where length(word) >= 7 group by word having count(*) >= 2),
d as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from (select word, unnest(range(1, length(word) + 1)) as i from v)),
p as (
  select a.word, b.word as near from d a join d b on a.s = b.s and a.i = b.i and a.word <> b.word
  union select d.word, v.word from d join v on d.s = v.word
  union select v.word, d.word from d join v on d.s = v.word),
q as (select p.word, p.near, v.n as near_n, row_number() over (partition by p.word order by v.n desc, p.near) as k, count(*) over (partition by p.word) as n_near from p join v on p.near = v.word),
f as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * v.n then near end as form, case when near_n >= 10 * v.n then near_n end as form_n
  from v left join (select * from q where k = 1) q using (word)),
chain as (select word, word as cur, 0 as depth from f union all select c.word, f.form, depth + 1 from chain c join f on c.cur = f.word where f.form is not null),
r as (select word, arg_max(cur, depth) as root from chain group by word)
select word, form, root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from f join r using (word)
"""
