"""Line deduplication: two Bloom filters say which lines repeat, and only suspected repeats are shuffled and confirmed.

A line's key is the line without white space at its ends, A-Z lower-cased. A first pass over the texts leaves, for each chunk
of documents, the 128-bit digests of its keys (blake2b) and the number of documents with each: one row a chunk, in a table that is
bucketed by chunk. The filters are divided by the digests' leading bits into as many buckets as the corpus needs, so they
neither fill up nor are they broadcast: a chunk sends 32 bits of each key to the key's bucket; there a key goes into
the filter of keys seen once, and into that of keys seen twice if the first had it already; each chunk gets back one bit a key.
The bits are joined with the chunks where these lie. Digests of suspected keys are then counted exactly; what only the
filters suspected falls away. No document with a key that another chunk has can be missed, as filters have no false negatives.

``keep="first"`` leaves each repeated key its first line in its first document (by doc_id, nulls last, then by the text's digest).

Defined results: a null or empty text is one empty line; lines without a key (only white space) always stay; repeated rows are documents
of their own, and under ``keep="first"`` equal rows keep the same line; ties can't arise otherwise; a very long text is a chunk of its own
and is split whole; columns beyond doc_id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, table
from .hashing import mixed, pieces, release

MIN_DOCS = 10
#: A chunk ends at so many bytes of text or keys; a bucket of the filters is meant for so many keys, with so many bits for each.
CHUNK, CHUNK_KEYS = 1 << 24, 200_000
BUCKET_KEYS, KEY_BITS, PROBES = 1 << 21, 16, 3
DIGEST = 16

_CHUNKS = "chunk bigint, n int, digests binary, docs binary, owners binary"
_OWNER = 25


def key_of(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def owner_of(doc_id: int | None, text: bytes) -> bytes:
    """Bytes that sort documents: by doc_id, nulls last, then by the text's digest."""
    rank = b"\xff" * 9 if doc_id is None else b"\x00" + (int(doc_id) + (1 << 63)).to_bytes(8, "big")
    return rank + digest_of(text)


def _chunks(docs: DataFrame, owned: bool) -> DataFrame:
    """One row a chunk: its keys' digests in ascending order, documents with each (32 bits) and, if asked for, the first of them."""
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("digests", pa.binary()), ("docs", pa.binary()), ("owners", pa.binary())])

    def row(found: dict[bytes, list]) -> pa.RecordBatch:
        order = sorted(found)
        counts = np.array([found[d][0] for d in order], np.uint32).tobytes()
        owners = b"".join(found[d][1] for d in order) if owned else None
        values = [uuid.uuid4().int >> 65, len(order), b"".join(order), counts, owners]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            ids = batch.column(0)
            for start, texts in pieces(batch.column(1)):
                for i, text in enumerate(texts):
                    text = text or b""
                    owner = owner_of(ids[start + i].as_py(), text) if owned else b""
                    for key in {key_of(x) for x in text.split(b"\n")}:
                        if not key:
                            continue
                        digest = digest_of(key)
                        entry = found.get(digest)
                        if entry is None:
                            found[digest] = [1, owner]
                        else:
                            entry[0] += 1
                            entry[1] = min(entry[1], owner)
                    size += len(text)
                    if size >= CHUNK or len(found) >= CHUNK_KEYS:
                        if found:
                            yield row(found)
                        found, size = {}, 0
        if found:
            yield row(found)
        found = {}
        release()

    return docs.select("doc_id", "text").mapInArrow(run, _CHUNKS)


def _heads(digests: bytes) -> np.ndarray:
    """The digests' leading 64 bits."""
    return np.frombuffer(digests, ">u8").astype(np.uint64)[:: DIGEST // 8]


def _sent(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, marks, many: 32 bits of each key to the bucket of its ``bits`` leading bits, and a bit for keys of several documents."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("marks", pa.binary()), ("many", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heads = _heads(row["digests"])
                bucket = (heads >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(heads), np.int32)
                marks = ((heads << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                many = np.frombuffer(row["docs"], np.uint32) > 1
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = list(zip(starts, [*starts[1:], len(heads)], strict=True))
                columns = [
                    [row["chunk"]] * len(cuts), [int(bucket[a]) for a, _ in cuts], [marks[a:b].tobytes() for a, b in cuts], [np.packbits(many[a:b]).tobytes() for a, b in cuts],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        release()

    return chunks.select("chunk", "digests", "docs").mapInArrow(run, "chunk bigint, bucket int, marks binary, many binary")


class Filter:
    """A Bloom filter of 32-bit marks, of ``bits`` bits (a power of two)."""

    def __init__(self, bits: int):
        self.mask, self.data = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8)

    def places(self, marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        h = mixed(marks.astype(np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        at = [(h + np.uint64(i) * step) & self.mask for i in range(PROBES)]
        return [((p >> np.uint64(3)).astype(np.int64), np.left_shift(1, p & np.uint64(7)).astype(np.uint8)) for p in at]

    def add(self, places: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray | slice = slice(None)) -> None:
        for byte, bit in places:
            np.bitwise_or.at(self.data, byte[chosen], bit[chosen])

    def has(self, places: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.ones(len(places[0][0]), bool)
        for byte, bit in places:
            out &= (self.data[byte] & bit) != 0
        return out


def repeats(rows: list[tuple[np.ndarray, np.ndarray]], bits: int) -> list[np.ndarray]:
    """Which of each row's marks the filter of marks seen twice has; rows are (distinct marks, those that count as seen twice at once)."""
    once, twice = Filter(bits), Filter(bits)
    for marks, many in rows:
        places = once.places(marks)
        twice.add(places, once.has(places) | many)
        once.add(places)
    return [twice.has(twice.places(marks)) for marks, _ in rows]


def _answers(sent: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket, suspected: one bit for each key that the chunk sent to the bucket."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        marks = [np.frombuffer(m, np.uint32) for m in group["marks"]]
        many = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(m)).astype(bool) for f, m in zip(group["many"], marks, strict=True)]
        flags = repeats(list(zip(marks, many, strict=True)), bits)
        return pd.DataFrame({"chunk": group["chunk"], "bucket": group["bucket"], "suspected": [np.packbits(f).tobytes() for f in flags]})

    return sent.groupBy("bucket").applyInPandas(answer, "chunk bigint, bucket int, suspected binary")


def _suspects(chunks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """digest, docs, owner of the keys in each chunk that the filters suspect."""
    told = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "suspected"))).alias("told"))
    joined = chunks.join(told, "chunk").select("digests", "docs", "owners", F.col("told.suspected").alias("suspected"))
    schema = pa.schema([("digest", pa.binary()), ("docs", pa.int64()), ("owner", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                heads = _heads(row["digests"])
                bucket = (heads >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(heads), np.int64)
                sizes = np.diff(np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(heads)))
                flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(row["suspected"], sizes.tolist(), strict=True)]
                chosen = np.flatnonzero(np.concatenate(flags)).tolist()
                docs, owners = np.frombuffer(row["docs"], np.uint32), row["owners"]
                columns = [
                    [row["digests"][i * DIGEST : (i + 1) * DIGEST] for i in chosen], [int(docs[i]) for i in chosen], [owners and owners[i * _OWNER : (i + 1) * _OWNER] for i in chosen],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        release()

    return joined.mapInArrow(run, "digest binary, docs bigint, owner binary")


def repeated_keys(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, owned: bool = False) -> DataFrame:
    """digest, n, owner: the keys of at least ``min_docs`` (2 or more) documents, with the number of these and the first of them."""
    if min_docs < 2:
        raise ValueError("a key repeats from two documents on")
    spark = scratch.spark
    name = f"starloom_lines_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = _chunks(docs, owned).write.format("parquet").option("compression", "zstd").option("path", f"{scratch.base}/{name}")
    writer.bucketBy(parts, "chunk").saveAsTable(name)
    try:
        chunks = spark.table(name)
        total = chunks.agg(F.sum("n")).first()[0] or 0
        buckets = max(16, 1 << max(0, (total // BUCKET_KEYS)).bit_length())
        bits = buckets.bit_length() - 1
        size = max(1 << 10, 1 << (KEY_BITS * total // buckets).bit_length())
        answers = _answers(_sent(chunks, bits), size)
        suspects = _suspects(chunks, answers, bits)
        found = suspects.groupBy("digest").agg(F.sum("docs").alias("n"), F.min("owner").alias("owner")).where(F.col("n") >= min_docs)
        return scratch.keep(found, "repeated")
    finally:
        spark.sql(f"drop table if exists {name}")
        scratch.drop(name)


def kept_lines(text: bytes, owner: bytes | None, repeated: Callable[[bytes], bytes | bool | None]) -> tuple[bytes, int, int]:
    """The text without lines of repeated keys, its lines and how many of them were dropped.

    ``repeated`` gives for a digest nothing if the key isn't repeated, else its owner; with ``owner`` the first line of an own key stays.
    """
    lines = text.split(b"\n")
    verdict: dict[bytes, bool] = {b"": True}
    kept = []
    for line in lines:
        key = key_of(line)
        stays = verdict.get(key)
        if stays is None:
            held = repeated(digest_of(key))
            stays = not held
            verdict[key] = stays
            if held and owner is not None and held == owner:
                kept.append(line)
                continue
        if stays:
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


_RESULT = "doc_id {id}, text string, n_lines bigint, n_dropped bigint"


def _result(ids: pa.Array, rows: list[tuple[bytes, int, int]], texts: list[bytes | None], schema: pa.Schema) -> pa.RecordBatch:
    kept = pa.array([None if t is None else r[0] for r, t in zip(rows, texts, strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), kept, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], schema=schema)


def deduplicated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep: str = "none", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text (without the lines of keys that at least ``min_docs`` documents have; null stays null), n_lines (before), n_dropped.

    Up to ``broadcast_rows`` repeated keys are broadcast, and texts stay where they are. Beyond that, digests of lines are joined with the
    keys, and each text's repeated digests with the text by its digest.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    owned = keep == "first"
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    repeated = repeated_keys(docs, scratch, min_docs, owned)
    out = _RESULT.format(id=docs.schema["doc_id"].dataType.simpleString())
    near = repeated.limit(broadcast_rows + 1).count() <= broadcast_rows
    if near:
        held = {bytes(r.digest): bytes(r.owner) if owned else True for r in repeated.collect()}
        shared = scratch.spark.sparkContext.broadcast(held)

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                ids = batch.column(0)
                schema = pa.schema([("doc_id", ids.type), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
                for start, texts in pieces(batch.column(1)):
                    own = ids.slice(start, len(texts))
                    owners = [owner_of(i, t or b"") for i, t in zip(own.to_pylist(), texts, strict=True)] if owned else [None] * len(texts)
                    yield _result(own, [kept_lines(t or b"", o, held.get) for t, o in zip(texts, owners, strict=True)], texts, schema)

        return docs.mapInArrow(here, out)
    return _joined(docs, repeated, out, owned, scratch)


def _joined(docs: DataFrame, repeated: DataFrame, out: str, owned: bool, scratch: Scratch) -> DataFrame:
    """The same by joins: texts meet their own repeated digests by the text's digest; equal texts are looked up once."""
    marked = docs.withColumn("t", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("t", pa.string()), ("digests", pa.list_(pa.binary()))])
        for batch in batches:
            names = batch.column(0)
            for start, texts in pieces(batch.column(1)):
                lists = [[digest_of(k) for k in {key_of(x) for x in (t or b"").split(b"\n")} if k] for t in texts]
                yield pa.RecordBatch.from_arrays([names.slice(start, len(texts)), pa.array(lists, pa.list_(pa.binary()))], schema=schema)

    lists = marked.select("t", "text").mapInArrow(listed, "t string, digests array<binary>").groupBy("t").agg(F.first("digests").alias("digests"))
    pairs = lists.select("t", F.explode("digests").alias("digest")).join(repeated.select("digest", "owner"), "digest")
    own = pairs.groupBy("t").agg(F.collect_list(F.struct("digest", "owner")).alias("held"))
    joined = marked.join(scratch.keep(own, "own"), "t", "left").select("doc_id", "text", "held")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            schema = pa.schema([("doc_id", ids.type), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
            for start, texts in pieces(batch.column(1)):
                own = ids.slice(start, len(texts))
                rows = []
                for i, t, held in zip(own.to_pylist(), texts, batch.column(2).slice(start, len(texts)).to_pylist(), strict=True):
                    known = {x["digest"]: x["owner"] if owned else True for x in held or ()}
                    rows.append(kept_lines(t or b"", owner_of(i, t or b"") if owned else None, known.get))
                yield _result(own, rows, texts, schema)

    return joined.mapInArrow(apart, out)


def op13_lines(spark, sf_dir) -> DataFrame:
    out = deduplicated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select r, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from d),
keyed as (select r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
hot as (select key from (select distinct r, key from keyed where key <> '') group by key having count(*) >= 10),
kept as (select r, string_agg(line, chr(10) order by i) as text, count(*) as n from keyed where key not in (select key from hot) group by r)
select doc_id, len(l)::bigint as n_lines, (len(l) - coalesce(n, 0))::bigint as n_dropped, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (r)
"""
