"""Exact repeated passages: hash-compared suffix sort, one bucket of the corpus at a time.

A byte goes if a string of LENGTH bytes that covers it starts at another place too (of the same or another document).

1. Anchors. In every window of LENGTH bytes the GRAM-byte string with the least hash is chosen; equal windows choose the
   same one. Occurrences of a repeated window therefore meet under the hash of their anchor, and only about two anchors in
   LENGTH - GRAM bytes are kept. An anchor's context is all that windows around it can reach.
2. Whole contexts that occur twice are repeated as they are: their places are marked by counting, without moving any
   text; two are the same if their 128-bit digests are. One of each goes on if its anchor also has other contexts.
3. Suffix sort. Contexts of one anchor are sorted by what follows it, by a mergesort whose comparisons find the common
   extension by binary search over prefix polynomial hashes; neighbours are verified on the bytes. Minima of neighbours'
   extensions give every pair's; extensions to the left are found likewise. A pair whose two extensions reach LENGTH
   covers both from the left end to the right one.

An anchor with more than CHUNK different contexts is divided. Windows that occur twice in a part are settled there; of all
others, and of one of each of these, the hashes are counted over all parts, in packed rows, and a second, independent hash
must agree. Copies of whole texts are one text from the start. Texts are keyed by 64 bits; where two of different SHA-256
have one key, they are keyed anew.

Defined results: a null or empty text has no bytes; texts below LENGTH bytes lose nothing; repeated rows are copies of
each other; null or repeated doc_ids don't matter (texts are known by their keys); very long texts are taken whole, one at a
time; columns beyond doc_id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast, table
from .hashing import BASE_2, inverses, mixed, pieces, prefix_sums

LENGTH = 400
GRAM = 64
CHUNK = 3_000
#: Contexts that are sorted at a time; groups are never divided by it.
SORTED = 2_000
#: Window hashes of divided groups that one bucket holds on average.
BUCKET = 1_000_000
#: Groups up to this size compare all pairs of neighbours' minima; larger ones go level by level.
PAIRED = 64
#: Bytes and rows up to which marks are broadcast to the scan of the texts; beyond, texts and marks meet by a shuffle.
MARK_BYTES, MARK_ROWS = 32 << 20, 300_000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value (by its upper 32 bits) in each run of ``width`` values."""
    n = len(values) - width + 1
    key = (values >> np.uint64(32) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """text index, place, anchor hash and context digest of all anchors; texts have LENGTH bytes at least."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    sums, inverse = prefix_sums(data), inverses(len(data) + 1)
    n = len(data) - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[:n])
    least = sliding_argmin(grams, LENGTH - GRAM + 1)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    ok = np.ones(len(least), bool)
    for e in ends[:-1]:  # windows that would cross from one text to the next
        ok[max(0, e - LENGTH + 1) : e] = False
    at = np.unique(least[ok])
    doc = np.searchsorted(ends, at, side="right")
    low = np.maximum(begins[doc], at - (LENGTH - GRAM))
    high = np.minimum(ends[doc], at + LENGTH)
    digests = [xxhash.xxh3_128_digest(b"%d:" % (p - a) + joined[a:b]) for a, p, b in zip(low.tolist(), at.tolist(), high.tolist(), strict=True)]
    return doc, at - begins[doc], grams[at], digests


def _entries(docs: DataFrame, tk: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in pieces(batch.column(1)):
                held = {ids[start + i]: t for i, t in enumerate(texts) if len(t or b"") >= LENGTH}
                if not held:
                    continue
                doc, at, gram, context = anchors(list(held.values()))
                keys = np.array(list(held), np.int64)[doc]
                cols = [pa.array(keys), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["tk", "pos", "fp", "ctx"])

    return docs.select(tk.alias("tk"), F.col("text").cast("string")).mapInArrow(run, "tk bigint, pos int, fp bigint, ctx binary")


class Suffixes:
    """Byte strings (data[start:start + size]) ordered by group and content, with hashes to compare them by."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.data, self.start, self.size, self.group = data, start, size, group
        self.sums, self.inverse = prefix_sums(data), inverses(len(data) + 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of strings i and j: binary search on equal prefix hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[a + mid] - self.sums[a]) * self.inverse[a] == (self.sums[b + mid] - self.sums[b]) * self.inverse[b]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def verified(self, i: np.ndarray, j: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``lengths`` where the bytes agree so far; shorter where a hash lied."""
        out = lengths.copy()
        for k in range(0, len(i), 1024):
            n = lengths[k : k + 1024]
            ends = np.cumsum(n)
            within = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
            differ = self.data[np.repeat(self.start[i[k : k + 1024]], n) + within] != self.data[np.repeat(self.start[j[k : k + 1024]], n) + within]
            if differ.any():
                np.minimum.at(out, k + np.repeat(np.arange(len(n)), n)[differ], within[differ])
        return out

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j."""
        out = self.group[i] < self.group[j]
        k = np.flatnonzero(self.group[i] == self.group[j])
        i, j = i[k], j[k]
        c = self.common(i, j)
        last = len(self.data) - 1
        shorter, longer = c == self.size[i], c == self.size[j]
        smaller = self.data[np.minimum(self.start[i] + c, last)] < self.data[np.minimum(self.start[j] + c, last)]
        out[k] = np.where(shorter, ~longer, ~longer & smaller)
        return out

    def sorted(self) -> np.ndarray:
        """Stable bottom-up mergesort; all pairs of runs of one width are merged at once, each element by its rank in the other run."""
        n = len(self.start)
        order = np.arange(n)
        place = np.arange(n)
        width = 1
        while width < n:
            first = place // (2 * width) * (2 * width)
            left = place - first < width
            low = np.where(left, np.minimum(first + width, n), first)
            high = np.where(left, np.minimum(first + 2 * width, n), np.minimum(first + width, n))
            other, base = low.copy(), low.copy()
            while True:
                k = np.flatnonzero(low < high)
                if not len(k):
                    break
                mid = (low[k] + high[k]) >> 1
                x, y = order[k], order[mid]
                # a left element goes behind the right ones that are less; a right one behind the left ones that aren't greater
                behind = np.where(left[k], self.before(y, x), ~self.before(x, y))
                low[k] = np.where(behind, mid + 1, low[k])
                high[k] = np.where(behind, high[k], mid)
            rank = low - base
            target = np.where(left, place + rank, first + (place - first - width) + rank)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order


def _levels(right: np.ndarray, back: Suffixes, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right reach of each member (in the order of right extensions) of a large group."""
    m = len(members)
    sub = Suffixes(back.data, back.start[members], back.size[members], np.zeros(m, np.int64))
    order = sub.sorted()
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    table = [sub.verified(order[:-1], order[1:], sub.common(order[:-1], order[1:]))]
    while 2 * (1 << len(table) - 1) <= m - 1:
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # of neighbours' extensions from rank a to rank b
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            s = k == level
            out[s] = np.minimum(table[level][a[s]], table[level][b[s] - (1 << int(level))])
        return out

    lefts, rights = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    for r in np.unique(right):
        run = np.concatenate(([0], np.cumsum(right < r)))  # members whose right extensions reach r with each other
        by = np.lexsort((rank, run))
        together = np.flatnonzero(run[by][1:] == run[by][:-1])
        if not len(together):
            continue
        c = least(rank[by[together]], rank[by[together + 1]])
        best = np.full(m, -1, np.int64)
        np.maximum.at(best, by[together], c)
        np.maximum.at(best, by[together + 1], c)
        good = (best >= 0) & (best + r >= LENGTH)
        lefts[good] = np.maximum(lefts[good], best[good])
        rights[good] = np.maximum(rights[good], r)
    return lefts, rights


def reaches(group: np.ndarray, contexts: list[bytes], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far left and right of its anchor each context is covered by strings that others of its group have; -1 for not at all.

    ``group`` is ascending; the anchor stands ``lead`` bytes into its context.
    """
    n = len(contexts)
    size = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    ahead = Suffixes(data, begin + lead, size - lead, group)
    total = len(data)
    back = Suffixes(data[::-1], total - begin - lead, lead, group)
    order = ahead.sorted()
    g = group[order]
    right = np.zeros(max(0, n - 1), np.int64)
    same = np.flatnonzero(g[1:] == g[:-1])
    i, j = order[same], order[same + 1]
    right[same] = ahead.verified(i, j, ahead.common(i, j))
    left_of, right_of = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    for s, m in zip(starts[sizes > PAIRED], sizes[sizes > PAIRED], strict=True):
        members = order[s : s + m]
        left_of[members], right_of[members] = _levels(right[s : s + m - 1], back, members)
    place = np.arange(n)
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= PAIRED, sizes)
    k = place[small & (place + 1 < ends)]
    reach = right[k]
    step = 1
    while len(k):
        # pairs at this distance in the order; those that can't reach LENGTH any more are dropped with all further ones
        alive = reach + (LENGTH - GRAM) >= LENGTH
        k, reach = k[alive], reach[alive]
        i, j = order[k], order[k + step]
        c = back.common(i, j)
        good = c + reach >= LENGTH
        x, y, r = i[good], j[good], reach[good]
        c = back.verified(x, y, c[good])
        sure = c + r >= LENGTH
        for e in (x[sure], y[sure]):
            np.maximum.at(left_of, e, c[sure])
            np.maximum.at(right_of, e, r[sure])
        step += 1
        more = k + step < ends[k]
        k, reach = k[more], np.minimum(reach[more], right[k[more] + step - 1])
    return left_of, right_of


_COVERED = "tk bigint, lo int, hi int, bucket int, windows binary, tks binary, starts binary"
_NAMES = [x.split()[0] for x in _COVERED.split(", ")]


def _ranges(tk: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    k = len(tk)
    cols = [pa.array(tk.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.nulls(k, pa.int32())]
    return pa.RecordBatch.from_arrays([*cols, *[pa.nulls(k, pa.binary())] * 3], names=_NAMES)


def _distinct(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each distinct pair, the number of each place's pair, and how often each pair occurs."""
    order = np.lexsort((np.arange(len(h)), h2, h))
    new = np.concatenate(([True], (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]]))) if len(h) else np.zeros(0, bool)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number, np.bincount(number)


def _windows(tk: np.ndarray, fp: int, contexts: list[bytes], lead: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A part of a divided group: ranges of windows that it has twice, and its distinct window hashes, packed by bucket."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    count = size - LENGTH + 1
    who = np.repeat(np.arange(len(contexts)), count)
    within = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + within
    # scattered, as a first byte counts once in either polynomial: a step from place to place could make up for it
    salt = mixed(mixed(np.array([fp], np.int64).view(np.uint64)) + (lead[who] - within).astype(np.uint64))

    def hashed(*base: int) -> np.ndarray:
        sums = prefix_sums(data, *base)
        return mixed((sums[at + LENGTH] - sums[at]) * inverses(len(data) + 1, *base)[at] + salt)

    h, h2 = hashed(), hashed(BASE_2)
    start = pos[who] - lead[who] + within
    first, number, times = _distinct(h, h2)
    twice = np.flatnonzero(times[number] > 1)
    if len(twice):
        w, s = who[twice], start[twice]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)))
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(w)])) - 1
        yield _ranges(tk[w[begin]], s[begin], s[end] + LENGTH)
    # a window that is settled here goes on without a place (-1), for those that have it once elsewhere
    h, h2, t, place = h[first], h2[first], tk[who[first]], np.where(times > 1, -1, start[first])
    bucket = (h % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        k = order[a:b]
        cols = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([int(bucket[k[0]])], pa.int32())]
        blobs = [np.stack((h[k], h2[k])).tobytes(), t[k].astype(np.int64).tobytes(), place[k].astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([*cols, *[pa.array([x], pa.binary()) for x in blobs]], names=_NAMES)


def _counted(group: pa.Table) -> pa.Table:
    """Windows with a place whose hashes occur twice in the bucket."""
    join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    tk, start = join("tks", np.int64), join("starts", np.int32)
    both = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in group.column("windows").to_pylist()]
    _, number, times = _distinct(*np.concatenate(both, axis=1))
    k = np.flatnonzero((times[number] > 1) & (start >= 0))
    return pa.table({"tk": pa.array(tk[k]), "lo": pa.array(start[k]), "hi": pa.array(start[k] + np.int32(LENGTH))})


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered ranges of sorted context rows (fp, part, buckets, tk, pos, lead, ctx), many groups at a time; buckets: 0 if undivided."""

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        fp, part, buckets, tk, pos, lead, ctx = zip(*rows, strict=True)
        key = np.array([fp, part], np.int64).T
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
        tk, lead, pos = (np.array(x, np.int64) for x in (tk, lead, pos))
        divided = np.array(buckets) > 0
        k = np.flatnonzero(~divided)
        if len(k):
            left, right = reaches(group[k], [ctx[i] for i in k], lead[k])
            found = left >= 0
            k = k[found]
            yield _ranges(tk[k], pos[k] - left[found], pos[k] + right[found])
        for g in np.unique(group[divided]):
            k = np.flatnonzero(group == g)
            yield from _windows(tk[k], fp[k[0]], [ctx[i] for i in k], lead[k], pos[k], buckets[k[0]])

    held: list = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if len(held) >= SORTED and row[:2] != held[-1][:2]:
                yield from flush(held)
                held = []
            held.append(row)
    if held:
        yield from flush(held)


def _beside_texts(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Texts with the marks (tk, one binary and others) of each: by broadcast if the marks are small, else by a shuffle."""
    rows, size = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("marks")), F.lit(0))).first()
    return docs.join(F.broadcast(marks) if rows <= MARK_ROWS and size <= MARK_BYTES else marks, "tk", how)


def _packed(*names: str):
    """Sorted structs of ints of one group as a string of decimal numbers (bounded by the text that they belong to)."""
    return F.array_join(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct(*names))), lambda s: F.array(*[s[n].cast("string") for n in names]))), ",")


def _emitted(docs: DataFrame, tk: Column, wanted: DataFrame) -> DataFrame:
    """fp, tk, pos, lead, ctx of the wanted anchors (tk, doc_id of one copy, marks: pos,fp,pos,fp...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, texts in pieces(batch.column(2)):
                out = []
                for t, m, text in zip(keys[start:], marks[start:], texts, strict=False):
                    numbers = list(map(int, m.split(",")))
                    for pos, fp in zip(numbers[0::2], numbers[1::2], strict=True):
                        lead = min(pos, LENGTH - GRAM)
                        out.append((fp, t, pos, lead, text[pos - lead : pos + LENGTH]))
                for k in range(0, len(out), 4096):
                    cols = [pa.array(x, t) for x, t in zip(zip(*out[k : k + 4096], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=["fp", "tk", "pos", "lead", "ctx"])

    keyed = docs.select(tk.alias("tk"), "doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= LENGTH)
    both = _beside_texts(keyed, wanted, "inner").where(F.col("doc_id").eqNullSafe(F.col("one")))
    return both.select("tk", "marks", "text").mapInArrow(run, "fp bigint, tk bigint, pos int, lead int, ctx binary")


def keyed_texts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """The distinct texts of LENGTH bytes at least (tk, one: a doc_id that has it, copies, size), and the key as a column.

    Texts of different SHA-256 that share a key are keyed anew. They are as few as chance collisions of 64 bits (n ** 2 / 2 ** 65).
    """
    tk = F.xxhash64("text")
    while True:
        texts = scratch.keep(
            docs.where(F.octet_length("text") >= LENGTH)
            .groupBy(tk.alias("tk"))
            .agg(
                F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).alias("size"),
                F.min(F.sha2("text", 256)).alias("least"), F.max(F.sha2("text", 256)).alias("most"),
            ),
            f"texts-{uuid.uuid4().hex}",
        )
        shared = [r.tk for r in texts.where("least <> most").select("tk").collect()]
        if not shared:
            return texts.drop("least", "most"), tk
        tk = F.when(tk.isin(shared), F.xxhash64(F.sha2("text", 256), tk)).otherwise(tk)


def _repeated(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """The contexts that occur twice (whole) or whose anchor has several: fp, ctx, whole, rep (one place), several, k (contexts of the anchor)."""
    # written before the join, so that both its sides are plain shuffles, whatever the size, and AQE divides a frequent anchor's contexts
    crowded = scratch.keep(contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "crowded")
    info = contexts.join(crowded.hint("merge"), "fp", "left").where("k is not null or lo <> hi")
    return info.select("fp", "ctx", (F.col("lo") != F.col("hi")).alias("whole"), F.col("lo").alias("rep"), F.col("k").isNotNull().alias("several"), "k")


def covered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Column]:
    """tk (key of the text), marks: lo,hi,lo,hi... of all ranges to remove, for the texts that have any; and the key as a column."""
    texts, key = keyed_texts(docs, scratch)
    entries = scratch.keep(_entries(docs, key), "entries")
    at = F.struct("tk", "pos")
    contexts = scratch.keep(entries.groupBy("fp", "ctx").agg(F.min(at).alias("lo"), F.max(at).alias("hi")), "contexts")
    info = scratch.keep(_repeated(contexts, scratch), "info")
    whole = (
        entries.join(info.where("whole").select("fp", "ctx"), ["fp", "ctx"], "left_semi")
        .join(texts.select("tk", "size"), "tk")
        .select("tk", F.greatest(F.lit(0), F.col("pos") - (LENGTH - GRAM)).alias("lo"), F.least(F.col("size"), F.col("pos") + LENGTH).cast("int").alias("hi"))
    )
    reps = info.where("several").select(F.col("rep.tk").alias("tk"), F.col("rep.pos").alias("pos"), "fp", "k")
    wanted = scratch.keep(
        reps.groupBy("tk").agg(_packed("pos", "fp").alias("marks")).join(texts.select("tk", "one"), "tk"), "wanted"
    )
    rows = _emitted(docs, key, wanted)
    big = scratch.keep(info.where(F.col("several") & (F.col("k") > CHUNK)).select("fp", "k").distinct(), "big")
    members = big.agg(F.sum("k")).first()[0]
    if members:
        # as few rows as there are anchors with more than CHUNK contexts
        rows = rows.join(sized_broadcast(big), "fp", "left")
        parts = F.coalesce(F.ceil(F.col("k") / CHUNK), F.lit(1)).cast("int")
        buckets = F.when(F.col("k").isNull(), 0).otherwise(max(1, members * LENGTH // BUCKET)).cast("int")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("tk", "pos"), parts).cast("int")).withColumn("buckets", buckets)
    else:
        rows = rows.withColumns({"part": F.lit(0), "buckets": F.lit(0)})
    rows = rows.select("fp", "part", "buckets", "tk", "pos", "lead", "ctx").repartition("fp", "part").sortWithinPartitions("fp", "part")
    settled = scratch.keep(rows.mapInArrow(_settle, _COVERED), "settled")
    ranges = settled.where("bucket is null").select("tk", "lo", "hi")
    if members:
        packed = settled.where("bucket is not null").select("bucket", "windows", "tks", "starts")
        ranges = ranges.unionByName(packed.groupBy("bucket").applyInArrow(_counted, "tk bigint, lo int, hi int"))
    # what a representative's context covers holds for all places with that context
    ranges = ranges.unionByName(whole).unionByName(texts.where("copies > 1").select("tk", F.lit(0).alias("lo"), F.col("size").alias("hi")))
    high = F.max("hi").over(W.partitionBy("tk").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    flat = ranges.withColumn("before", high).withColumn("new", F.when(F.col("before") >= F.col("lo"), 0).otherwise(1))
    flat = flat.withColumn("run", F.sum("new").over(W.partitionBy("tk").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)))
    spans = flat.groupBy("tk", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return scratch.keep(spans.groupBy("tk").agg(_packed("lo", "hi").alias("marks")), "spans"), key


def trimmed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    spans, key = covered(docs, Scratch(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_pylist()
            for start, texts in pieces(batch.column(2)):
                sizes, gone, counts, kept = [], [], [], []
                for m, text in zip(marks[start : start + len(texts)], texts, strict=True):
                    text = text or b""
                    ends = list(map(int, m.split(","))) if m else []
                    lows, highs = ends[0::2], ends[1::2]
                    parts = [text[a:b] for a, b in zip([0, *highs], [*lows, len(text)], strict=True)]
                    sizes.append(len(text))
                    gone.append(sum(highs) - sum(lows))
                    counts.append(len(lows))
                    kept.append(b"".join(parts))
                cols = [batch.column(0).slice(start, len(texts)), *[pa.array(x, pa.int64()) for x in (sizes, gone, counts)], pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.octet_length("text") >= LENGTH, key).alias("tk"), F.col("text").cast("string").alias("text"))
    both = _beside_texts(keyed, spans, "left").select("doc_id", "marks", "text")
    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op9_repeats(spark, sf_dir) -> DataFrame:
    out = trimmed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Spans to remove from each text, by counting every string of ``length`` bytes (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            h = hashlib.blake2b(t[i : i + length], digest_size=16).digest()
            seen[h] = seen.get(h, 0) + 1
    out = []
    for t in texts:
        spans: list[tuple[int, int]] = []
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1] = (spans[-1][0], i + length)
                else:
                    spans.append((i, i + length))
        out.append(spans)
    return out
