"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set is that of its distinct word shingles. Sets of one band of sizes split the domain of shingles into the
same n1 first-level partitions, and each of these into three second-level ones; for every choice of two of the three, a
signature is the hash of the first-level partition, the choice and what the set has there. Sets a <= b that reach the threshold
(3/4) differ in at most k = (a + b) / 7 elements. As k < 2 * n1, some first-level partition holds one of these at most, and
then one of its three choices agrees. A difference spoils two choices at first and one more later, so that k of
them spoil ``_spoiled(k, n1)`` at most: a set with more signatures that aren't of nothing has a proper one in common with each
similar set; a set with fewer (small ones that leave many partitions empty) also signs for what it hasn't got.
A set near the lower end of its band also signs for the band below, where a smaller partner would be. Sets of fewer than
SMALL shingles use partitions of one element.

More signatures agree than one, in most cases. By one order of all signatures (their hashes) the largest ones are left out, as many
as leave a share of agreeing ones; ``m`` says how many any similar set still shares.

Equal sets are one class from the start, so copies never meet as pairs. In a group of one signature up to ALL_PAIRS
classes are compared with each other; larger groups compare everyone with a pivot. What a chunk of texts has of a hot
signature is settled where the texts are read; only its pivot goes on. Every link is verified: first an
odd sketch (parity bits; its distance bounds the true difference from below, so it never drops a link), then the sets.
After the components are known, large groups with several of them go through further rounds (``_rest``), which end with an
exact comparison of all documents of different components that could still have a link. So components are exact; the
links inside a component aren't all found, and no number of links is returned.

Defined results: a null or empty text has an empty set, links with nothing and is its own component; shorter texts
than a shingle are one shingle; very long texts are shingled whole, one at a time; repeated rows are copies; null doc_ids take
part but name no component unless alone; a similarity of exactly 3/4 links; an empty table gives an empty result. Columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, guarded, sized_broadcast, table
from .hashing import mixed, pieces, shingle_sets

SHINGLE = 5
SMALL = 64
RATIO = 3
#: First-level partitions per element of the band's largest set: above 1/6 (half the differing elements) by the room for empty choices.
DENSITY = 0.2
#: A set of s shingles keeps s / SPARE more signatures than those that similar sets may spoil.
SPARE = 8
ALL_PAIRS = 6
#: Classes that share a signature in one chunk of texts from which on the chunk settles them itself.
LOCAL = 24
#: Signatures that one bucket holds on average, and their number per byte of text.
BUCKET = 1_000_000
PER_BYTE = 0.13
CHUNK = 400_000
#: Members of a group that are compared with as many others at a time.
BLOCK = 1_000

_BLOBS = "bucket int, cls binary, meta binary, counts binary, sigs binary"
_FOUND = "doc_id bigint, tk bigint, n int, cls bigint, sketch binary, gid bigint, a bigint, b bigint, size int, band int, m int"
_KIND = pa.schema(
    [("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("sketch", pa.binary()), ("gid", pa.int64()),
     ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("band", pa.int32()), ("m", pa.int32())]
)


def _class_of(u: np.ndarray) -> int:
    h1 = int(mixed(u + np.uint64(1)).sum(dtype=np.uint64))
    h2 = int(mixed(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    cls = mixed(np.array([h1 ^ (h2 * 3 & (1 << 64) - 1)], np.uint64) + np.uint64(len(u)))
    return int(cls.view(np.int64)[0])


def odd_sketch(u: np.ndarray) -> bytes:
    """Parities of the elements that fall on each of 2 ** k bits, k by the set's size."""
    bits = 1 << max(7, (4 * len(u)).bit_length())
    return np.packbits(np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _spoiled(k: int, n1: int) -> int:
    """The most signatures that k differing elements change: two each, and the third of a partition that has one already."""
    return 2 * min(k, n1) + min(max(0, k - n1), n1)


def _keys(sigs: np.ndarray, buckets: int) -> np.ndarray:
    """Distinct signatures in their order: 32 bits, by which they are ordered, before the bucket that other bits choose."""
    return np.unique(sigs << np.uint64(32) | (sigs >> np.uint64(32)) % np.uint64(buckets))


def signatures(u: np.ndarray, buckets: int = 1 << 20) -> list[tuple[np.ndarray, int, int]]:
    """(ordered signatures, band, m) of a set for each band it signs in; a similar set of that band has m of them at least."""
    s = len(u)
    out = []
    spread = mixed(u * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7))

    def kept(sigs: np.ndarray, spoiled: int, band: int) -> tuple[np.ndarray, int, int]:
        keys = _keys(sigs, buckets)
        least = len(keys) - spoiled
        spare = min(least, -(-s // SPARE))
        # a similar set of 3/4 the size may keep fewer to spare
        return keys[: len(keys) - least + spare], band, min(spare, math.ceil(0.75 * s / SPARE))

    if 3 * s < 4 * SMALL:
        out.append(kept(mixed(spread + np.uint64(3)), s // 4, 0))
    low = SMALL
    while low <= s:
        top = low * RATIO
        if 3 * s < 4 * top:  # its band, or the one below if a partner of 3/4 its size lies there
            k = (s + (s * 4 // 3 if s < top else top - 1)) // 7
            n1 = math.ceil(DENSITY * top)
            place = ((u >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
            second = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            inside = place[starts].astype(np.int64)
            content, number = np.zeros((n1, 3), np.uint64), np.zeros((n1, 3), np.int64)
            for j in range(3):
                content[inside, j] = np.add.reduceat(np.where(second == j, spread, np.uint64(0)), starts)
                number[inside, j] = np.add.reduceat((second == j).astype(np.int64), starts)
            label = np.arange(3 * n1, dtype=np.uint64).reshape(n1, 3) * np.uint64(0xA0761D6478BD642F) + np.uint64(low * 1_000_003)
            sigs = mixed(content.sum(axis=1, keepdims=True, dtype=np.uint64) - content + mixed(label))  # choice j leaves out part j
            some = number.sum(axis=1, keepdims=True) > number
            spoiled = _spoiled(k, n1)
            if some.sum() > spoiled:
                out.append(kept(sigs[some], spoiled, low))
            else:
                out.append((_keys(sigs.ravel(), buckets), low, 1))
        low = top
    return out


def _size_code(n: int) -> int:
    """256 times the binary logarithm: what size comparisons of candidates need, in 13 bits."""
    return int(math.log2(n) * 256)


#: Size codes of similar sets differ by no more.
REACH = math.ceil(math.log2(4 / 3) * 256) + 1


def _meta(n: int, band: int, m: int) -> int:
    own = 0 if band and n < band * RATIO or not band and n < SMALL else 1  # 1: the band below its own
    return _size_code(n) << 3 | own << 1 | (m >= math.ceil(0.75 * n / SPARE))


def _known(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size code, whether the band below, and m (from below) of packed ``_meta``."""
    code = (meta >> 3).astype(np.int32)
    m = np.where(meta & 1, np.exp2(code / 256) * (0.75 / SPARE), 1.0)
    return code, (meta >> 1 & 1).astype(np.int32), np.maximum(1, m.astype(np.int32))


def _finished(**columns) -> bytes:
    """Rows of the result, packed, with nulls in the columns that aren't given."""
    k = len(next(iter(columns.values())))
    cols = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in _KIND]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KIND, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(pa.RecordBatch.from_arrays(cols, schema=_KIND))
    return sink.getvalue().to_pybytes()


def _pairs_of(cls: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distinct pairs of classes (the lesser first) at the given places whose sizes may be similar."""
    a, b = cls[left], cls[right]
    ok = (np.abs(code[left] - code[right]) <= REACH) & (a != b)
    pairs = np.stack((np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])), axis=1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _signed(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows for buckets of signatures, and finished rows (bucket < 0): documents, and what chunks settled of hot signatures."""
    schema = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("cls", "meta", "counts", "sigs")]])

    def done(**columns) -> pa.RecordBatch:
        blob = _finished(**columns)
        where = -1 - int(np.frombuffer(blob, np.uint8)[-64:].sum(dtype=np.int64) * 2_654_435_761 + len(blob)) % buckets
        return pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([blob], pa.binary()), *[pa.nulls(1, pa.binary())] * 3], schema=schema)

    def blobs(held: list) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for k, *_ in held])
        doc = np.repeat(np.arange(len(held)), [len(k) for k, *_ in held])
        cls, meta = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.uint16)
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((first, [len(keys)])))
        hot = np.repeat(sizes >= LOCAL, sizes)
        if hot.any():
            at = np.flatnonzero(hot)
            pivot = np.repeat(first, sizes)[at]
            code, below, m = _known(meta[doc[at]])
            gid = mixed(keys[at]).view(np.int64)
            yield done(gid=gid, a=cls[doc[at]], size=code, band=below, m=m)
            pairs = _pairs_of(cls[doc], (meta >> 3).astype(np.int32)[doc], pivot, at)
            if len(pairs):
                yield done(a=pairs[:, 0], b=pairs[:, 1])
            stays = np.ones(len(keys), bool)
            stays[at] = at == pivot
            # the pivots' entries are marked: whoever meets one of them is a member of a large group
            marked = np.unique(doc[at[at == pivot]])
            doc[at] = len(held) + np.searchsorted(marked, doc[at])
            cls, meta = np.concatenate((cls, cls[marked])), np.concatenate((meta, meta[marked] | np.uint16(4)))
            keys, doc = keys[stays], doc[stays]
        bucket = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        bucket, doc, low = bucket[order], doc[order], (keys[order] >> np.uint64(32)).astype(np.uint32)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        out = []
        for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
            ids, counts = np.unique(doc[a:b], return_counts=True)
            out.append((int(bucket[a]), cls[ids].tobytes(), meta[ids].tobytes(), counts.astype(np.uint32).tobytes(), low[a:b].tobytes()))
        for k in range(0, len(out), 256):
            cols = zip(*out[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        seen: set[int] = set()
        for batch in batches:
            ids, tks = batch.column(0), batch.column(2)
            for start, texts in pieces(batch.column(1)):
                rows = []
                for u in shingle_sets(texts, SHINGLE):
                    cls = _class_of(u) if len(u) else 0
                    rows.append((len(u), cls, odd_sketch(u) if len(u) else None))
                    if len(u) and cls not in seen:
                        seen.add(cls)
                        for keys, band, m in signatures(u, buckets):
                            held.append((keys, cls, _meta(len(u), band, m)))
                            total += len(keys)
                n, cls, sketch = zip(*rows, strict=True)
                doc_id, tk = (c.slice(start, len(texts)).to_pylist() for c in (ids, tks))
                yield done(doc_id=doc_id, tk=tk, n=n, cls=cls, sketch=sketch)
                if total >= CHUNK:
                    yield from blobs(held)
                    held, total, seen = [], 0, set()
        if held:
            yield from blobs(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_key(docs)).mapInArrow(run, _BLOBS)


def _text_key(docs: DataFrame) -> Column:
    """64 bits of a document's text, to tell the texts of one doc_id apart."""
    return F.xxhash64(docs["text"].cast("string"))


def _candidates(group: pa.Table) -> pa.Table:
    """Pairs (gid null) to compare, and the members (b null) of groups that were only compared with a pivot."""
    bucket = int(group.column("bucket")[0].as_py())
    if bucket < 0:
        return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in group.column("cls").to_pylist()])
    join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
    sig, cls, meta = join("sigs", np.uint32), join("cls", np.int64), join("meta", np.uint16)
    doc = np.repeat(np.arange(len(cls), dtype=np.int32), join("counts", np.uint32))
    order = np.argsort(sig, kind="stable")
    again = np.concatenate(([False], sig[order[1:]] == sig[order[:-1]]))
    order = order[again | np.concatenate((again[1:], [False]))]
    sig, doc = sig[order], doc[order]
    order = np.lexsort((meta[doc] & 4 == 0, cls[doc], sig))  # a class's marked entry first
    sig, doc = sig[order], doc[order]
    c = cls[doc]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (c[1:] != c[:-1]))) if len(sig) else np.zeros(0, bool)
    sig, doc, c = sig[new], doc[new], c[new]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [len(sig)])))
    marked = np.maximum.reduceat(meta[doc] & 4, starts) > 0 if len(sig) else np.zeros(0, bool)
    large = np.repeat((sizes > ALL_PAIRS) | marked & (sizes > 1), sizes)
    size_of, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    place = np.arange(len(sig)) - first
    left, right = [], []
    for step in range(1, ALL_PAIRS):  # all pairs of small groups
        x = np.flatnonzero(~large & (place + step < size_of))
        left.append(x)
        right.append(x + step)
    x = np.flatnonzero(large & (place > 0))
    left.append(first[x])
    right.append(x)
    pairs = _pairs_of(c, (meta >> 3).astype(np.int32)[doc], np.concatenate(left), np.concatenate(right))
    rest = np.flatnonzero(large)
    code, below, m = _known(meta[doc[rest]])
    gid = mixed(sig[rest].astype(np.uint64) << np.uint64(32) | np.uint64(bucket)).view(np.int64)
    known = {"gid": (None, gid), "a": (pairs[:, 0], c[rest]), "b": (pairs[:, 1], None), "size": (None, code), "band": (None, below), "m": (None, m)}
    cols = []
    for f in _KIND:
        both = [pa.nulls(k, f.type) if x is None else pa.array(x, f.type) for x, k in zip(known.get(f.name, (None, None)), (len(pairs), len(rest)), strict=True)]
        cols.append(pa.concat_arrays(both))
    return pa.table(cols, schema=_KIND)


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the odd sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if 7 * sketch_distance(sa[i], sb[i]) <= na[i] + nb[i]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (a, b)], names=["a", "b"])

    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    near = scratch.keep(_near(pairs, classes), f"{name}-near")
    ends = scratch.keep(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), f"{name}-ends")
    wanted = ends.join(classes.select("cls", F.col("doc_id").alias("_id")), "cls").select("_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                held = [(_class_of(u), u.tobytes()) for u in shingle_sets(texts, SHINGLE) if len(u)]
                cls, sets = zip(*held, strict=True) if held else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    w = sized_broadcast(wanted)
    texts = texts.join(w, texts.doc_id.eqNullSafe(w["_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(run, "cls bigint, set binary").join(ends, "cls", "left_semi").dropDuplicates(["cls"])
    sets = scratch.keep(sets, f"{name}-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                u, v = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v))
                if 100 * both >= 75 * (len(u) + len(v) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([z[i] for i in keep], pa.int64()) for z in (a, b)], names=["a", "b"])

    one, two = sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), sets.select(F.col("cls").alias("b"), F.col("set").alias("y"))
    return scratch.keep(near.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"), f"{name}-links")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp (the least node reachable) for every node of the links (a, b).

    Each round hangs all larger neighbours, then all smaller ones, on the least neighbour, until nothing changes. A node
    that gathers a third of all links only ever takes part in a minimum and in a join that can be split.
    """
    edges = scratch.keep(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-cc0"
    )
    i = 0
    while True:
        i += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"{name}-large{i}")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = scratch.keep(nxt.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-cc{i}")
        changed = nxt.exceptAll(edges).limit(1).count() + edges.exceptAll(nxt).limit(1).count()
        scratch.drop(f"{name}-cc{i - 1}", f"{name}-large{i}")
        edges = nxt
        if not changed:  # every round but the last lowers some node's label
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _open(rest: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the groups that hold several components, with their components."""
    named = rest.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    several = named.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
    return named.join(several, "gid", "left_semi")


def _blockwise(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in the blocks of sorted rows (gid, i, j, own, cls, n, comp, sketch) that sketches allow."""

    def fold(sketches: list[bytes], size: int) -> np.ndarray:
        x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
        while x.shape[1] > size:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return np.ascontiguousarray(x).view(np.uint64)

    def compare(rows: list) -> Iterator[tuple[int, int]]:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r[7]), []).append(r)
        crossed = rows[0][1] != rows[0][2]
        for la, ra in by.items():
            for lb, rb in by.items():
                if la > lb:
                    continue
                x, y = fold([r[7] for r in ra], la), fold([r[7] for r in rb], la)
                (cx, nx, px, ox), (cy, ny, py, oy) = (tuple(np.array([r[k] for r in z], np.int64) for k in (4, 5, 6, 3)) for z in (ra, rb))
                for k in range(0, len(x), 32):
                    s = slice(k, k + 32)
                    d = np.bitwise_count(x[s, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                    ok = (px[s, None] != py[None, :]) & (7 * d <= nx[s, None] + ny[None, :])
                    ok &= 4 * np.minimum(nx[s, None], ny[None, :]) >= 3 * np.maximum(nx[s, None], ny[None, :])
                    if crossed:
                        ok &= ox[s, None] != oy[None, :]
                    for i, j in zip(*np.nonzero(ok), strict=True):
                        yield min(cx[k + i], cy[j]), max(cx[k + i], cy[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        seen: set[tuple[int, int]] = set()  # pairs of earlier groups that share more than one signature

        def flush() -> pa.RecordBatch:
            if len(seen) > BLOCK * BLOCK:
                seen.clear()
            new = set(compare(held)) - seen if held else set()
            seen.update(new)
            found = np.array(sorted(new), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and row[:3] != held[-1][:3]:
                    yield flush()
                    held = []
                held.append(row)
        yield flush()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _rest(docs, classes, found, tested, links, comps, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links that pivots alone did not show, in large groups of several components.

    First everyone is compared with the group's most central member, as long as that joins components. Then only
    documents can have a link left whose signatures of a band lie in such groups ``m`` times at least. Two of them would share m
    groups, so each enters its k - m + 1 smallest ones only, where they are compared in blocks by their sketches.
    """
    rest = scratch.keep(found.where("gid is not null").select("gid", F.col("a").alias("cls"), "size", "band", "m"), "rest")
    for i in range(1, 9):
        open_ = scratch.keep(_open(rest, comps), f"open{i}")
        k = open_.groupBy("cls").agg(F.count(F.lit(1)).alias("k"))
        weighed = open_.join(k, "cls")
        pivot = weighed.groupBy("gid").agg(F.max(F.struct("k", "cls", "size", "comp")).alias("p"))
        new = weighed.join(pivot, "gid").where(f"comp <> p.comp and abs(size - p.size) <= {REACH}")
        new = new.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()
        new = scratch.keep(new.join(tested, ["a", "b"], "left_anti"), f"star{i}")
        if not new.limit(1).count():
            break
        tested = tested.unionByName(new)
        more = _links(docs, classes, new, scratch, f"star{i}")
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        comps = scratch.keep(components(links, scratch, f"star{i}"), f"comps{i}")
    unsafe = open_.groupBy("cls", "band").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).where("k >= least")
    left = open_.join(unsafe, ["cls", "band"])
    sizes = left.groupBy("gid").agg(F.count(F.lit(1)).alias("c"))
    first = F.row_number().over(W.partitionBy("cls", "band").orderBy("c", "gid"))
    left = left.join(sizes, "gid").withColumn("r", first).where("r <= k - least + 1").drop("c", "r")
    several = left.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    left = scratch.keep(left.join(several.select("gid", "c"), "gid").select("gid", "c", "cls", "comp"), "left")
    if not left.limit(1).count():
        return links, comps
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    placed = left.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("gid", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "cls", "comp")
    placed = placed.join(classes.select("cls", "n", "sketch"), "cls").select("gid", "i", "j", "own", "cls", "n", "comp", "sketch")
    more = _blockwise(placed.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")).distinct()
    more = scratch.keep(more.join(tested, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        links = links.unionByName(_links(docs, classes, more, scratch, "last"))
        comps = scratch.keep(components(links, scratch, "last"), "comps-last")
    return links, comps


def assigned(docs: DataFrame) -> DataFrame:
    """doc_id, tk, n_shingles, component_id and first (is this the document that stays for its component) for every document.

    The one that stays has the least doc_id, null being the greatest, and of its texts the one of least key.
    """
    scratch = Scratch(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    buckets = max(8, int(size * PER_BYTE / BUCKET))
    found = scratch.keep(_signed(docs, buckets).groupBy("bucket").applyInArrow(_candidates, _FOUND), "found")
    sets = found.where("n is not null").select("doc_id", "tk", "n", "cls", "sketch")
    classes = scratch.keep(
        sets.where("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("lead"),
        ),
        "classes",
    )
    pairs = scratch.keep(found.where("b is not null").select("a", "b").distinct(), "pairs")
    links = _links(docs, classes, pairs, scratch, "first")
    comps = scratch.keep(components(links, scratch, "first"), "comps")

    links, comps = _rest(docs, classes, found, pairs, links, comps, scratch)

    named = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    names = named.groupBy("comp").agg(F.min("lead").alias("lead"), F.sum("copies").alias("members")).where("members > 1")
    naming = named.select(F.col("cls").alias("_cls"), "comp").join(names, "comp").select("_cls", F.col("lead.doc_id").alias("_id"), F.col("lead.tk").alias("_tk"))
    naming = scratch.keep(naming, "naming")
    slim = sets.select("doc_id", "tk", "n", "cls")
    out = slim.join(sized_broadcast(naming), (slim.n > 0) & (slim.cls == naming["_cls"]), "left")
    first = F.col("_cls").isNull() | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")))
    return out.select("doc_id", "tk", F.col("n").cast("long").alias("n_shingles"), F.coalesce("_id", "doc_id").alias("component_id"), first.alias("first"))


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return assigned(docs).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id; rows without an id come last.

    Rows are told apart by their id and text: of different texts with one id those stay that are in no other's component, and of
    rows with one id and one text one stays. Only such rows are shuffled with their texts; all others are dropped where they
    are read. Documents without words are in no component and stay.
    """
    scratch = Scratch(docs.sparkSession)
    docs, back = guarded(docs, "doc_id", "text")
    found = scratch.keep(assigned(docs), "components")
    named = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"))
    gone = scratch.keep(named(found.where("not first")).distinct(), "gone")
    again = scratch.keep(named(found.where("first").groupBy("doc_id", "tk").agg(F.count(F.lit(1)).alias("k")).where("k > 1")), "again")
    same = lambda df, t: df["doc_id"].eqNullSafe(t["_id"]) & (_text_key(df) == t["_tk"])
    g = sized_broadcast(gone)
    kept = docs.join(g, same(docs, g), "left_anti")
    if not again.limit(1).count():
        return back(kept)
    b = sized_broadcast(again)
    return back(kept.join(b, same(kept, b), "left_anti").unionByName(kept.join(b, same(kept, b), "left_semi").dropDuplicates(["doc_id", "text"])))


def op5_components(spark, sf_dir) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as t from documents),
s as (
  select doc_id, list_distinct(case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')]
    else list_transform(range(1, len(t) - 3), lambda i: concat_ws(' ', t[i], t[i + 1], t[i + 2], t[i + 3], t[i + 4])) end) as g from w),
e as (select doc_id, unnest(g) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * k >= 75 * (len(x.g) + len(y.g) - k)),
u as (select a, b from l union all select b, a from l),
r as (select doc_id as n, doc_id as c from documents union select u.b, r.c from r join u on u.a = r.n)
select s.doc_id, len(g)::bigint as n_shingles, (select min(c) from r where r.n = s.doc_id) as component_id from s
"""
