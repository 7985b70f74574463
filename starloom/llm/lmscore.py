"""Language-model scoring: cross-entropy difference of a target and a background bigram model.

Both models count the same hashed vocabulary over all documents: unigrams of lower-cased words fall on a place for 8 to 16
words of the corpus, bigrams on a place a word at least, without a ceiling. They are matched: the background's counts are
scaled to the target's number of words, and both use the same Dirichlet smoothing. A document's score is the mean over its
words of target loss minus background loss, in nats; low means close to the target.

Counts never leave the executors. Documents are packed into chunks; a chunk sends what it counts to buckets of places, and
each bucket adds up and answers every chunk with the sums at the places that the chunk has.

Target documents are those labelled quality = 1; the background is all documents.

Defined results: a null or empty text has no words and null losses; a document's first word is scored by its
unigram; repeated rows count as often as they occur; without any target document both models are the background; an empty
table gives an empty result. Several labels of a document: it is a target if any says so. A very long text is a chunk of its
own; ties don't arise, as nothing is ranked; columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, count_words, sized_broadcast, table
from .hashing import mixed, word_hashes

MIN_BITS = 14
#: Bytes of text of a chunk, and words of the corpus for each bucket of places.
CHUNK = 1 << 22
BUCKET = 2_000_000
ALPHA = 0.1
MU = 20.0

_PARTS = "chunk bigint, bucket int, n int, places binary, target binary, background binary, ids array<bigint>, lengths array<bigint>, texts binary"


def sizes(words: int) -> tuple[int, int]:
    """Bits of the places of unigrams and of bigrams for a corpus of so many words."""
    bits = math.ceil(math.log2(words + 1))
    return max(MIN_BITS, bits - 4), max(MIN_BITS, bits)


def places(texts: list[bytes | None], bits: int, bi_bits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of each word's unigram and of the bigram that it ends, whether it is a first word, and words per text."""
    h, counts = word_hashes(texts)
    uni = (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)
    prev = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h
    bi = (mixed(prev * np.uint64(0x9FB21C651E98DF25) + h) >> np.uint64(64 - (bi_bits or bits))).astype(np.int64)
    first = np.zeros(len(h), bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    return uni, bi, first, counts


def _pack(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as the largest needs, compressed behind that number."""
    x = x.astype(np.min_scalar_type(int(x.max())))
    return bytes([x.itemsize]) + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[1:], n * blob[0], codec="zstd"), f"u{blob[0]}").astype(np.int64)


class Chunk:
    """The places of a chunk's words: bigrams stand behind the 2 ** bits unigrams; ``at`` holds the distinct ones by bucket."""

    def __init__(self, texts: list[bytes | None], bits: int, bi_bits: int, buckets: int):
        uni, bi, self.first, self.words = places(texts, bits, bi_bits)
        self.follows = ~self.first
        at, self.place = np.unique(np.concatenate((uni, (1 << bits) + bi[self.follows])), return_inverse=True)
        bucket = at % buckets
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.place = back[self.place]
        self.at, self.bucket = at[order], bucket[order]

    def loss(self, count: np.ndarray, total: float, vocabulary: int) -> np.ndarray:
        """Every word's loss by a model's counts at the places ``at``."""
        n = len(self.first)
        uni = count[self.place[:n]]
        p = (uni + ALPHA) / (total + ALPHA * vocabulary)
        out = p.copy()
        before = uni[np.flatnonzero(self.follows) - 1]
        out[self.follows] = np.minimum((count[self.place[n:]] + MU * p[self.follows]) / (before + MU), 1.0)
        return -np.log(out)


def _parts(marked: DataFrame, bits: int, bi_bits: int, buckets: int) -> DataFrame:
    """For each chunk one row with its documents (bucket null), and one for each bucket with its places and their counts."""
    most = CHUNK
    schema = pa.schema(
        [("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), *[(k, pa.binary()) for k in ("places", "target", "background")],
         ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary())]
    )

    def packed(held: list) -> pa.RecordBatch:
        ids, targets, texts = zip(*held, strict=True)
        name = uuid.uuid4().int >> 65
        joined = b"".join(t or b"" for t in texts)
        rows = [(name, None, len(joined), None, None, None, list(ids), [len(t or b"") for t in texts], pa.compress(joined, codec="zstd", asbytes=True))]
        c = Chunk(list(texts), bits, bi_bits, buckets)
        chosen = np.repeat(np.array(targets, bool), c.words)
        chosen = np.concatenate((chosen, chosen[c.follows]))
        background = np.bincount(c.place, minlength=len(c.at))
        target = np.bincount(c.place[chosen], minlength=len(c.at))
        starts = np.flatnonzero(np.concatenate(([True], c.bucket[1:] != c.bucket[:-1]))) if len(c.at) else []
        for a, b in zip(starts, [*starts[1:], len(c.at)], strict=True) if len(c.at) else ():
            steps = np.diff(c.at[a:b] // buckets, prepend=0)
            rows.append((name, int(c.bucket[a]), int(b - a), _pack(steps), _pack(target[a:b]), _pack(background[a:b]), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        total = 0
        for batch in batches:
            cols = (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))
            for row in zip(*[c.to_pylist() for c in cols], strict=True):
                size = len(row[2] or b"") + 1
                if held and total + size > most:
                    yield packed(held)
                    held, total = [], 0
                held.append(row)
                total += size
        if held:
            yield packed(held)

    return marked.select("doc_id", "is_target", "text").mapInArrow(run, _PARTS)


def _answers(parts: DataFrame) -> DataFrame:
    """The rows of the buckets with the counts of all chunks at their places in place of their own."""

    def add(group: pa.Table) -> pa.Table:
        n = group.column("n").to_pylist()
        cols = [[_unpack(x, k) for x, k in zip(group.column(c).to_pylist(), n, strict=True)] for c in ("places", "target", "background")]
        at = np.concatenate([np.cumsum(x) for x in cols[0]])
        order = np.argsort(at, kind="stable")
        at = at[order]
        new = np.concatenate(([True], at[1:] != at[:-1]))
        starts, of = np.flatnonzero(new), np.cumsum(new) - 1
        ends = np.cumsum(n)
        out = []
        for x in cols[1:]:
            sums = np.empty(len(order), np.int64)
            sums[order] = np.add.reduceat(np.concatenate(x)[order], starts)[of]
            out.append(pa.array([_pack(sums[b - k : b]) for k, b in zip(n, ends, strict=True)], pa.binary()))
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "n": group.column("n"), "target": out[0], "background": out[1]})

    asked = parts.where("bucket is not null").select("chunk", "bucket", "n", "places", "target", "background")
    return asked.groupBy("bucket").applyInArrow(add, "chunk bigint, bucket int, n int, target binary, background binary")


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score. ``targets`` holds the doc_ids of the target."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = sized_broadcast(targets.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct())
    sized = slim.select("doc_id", count_words(F.col("text")).alias("words"))
    sized = sized.join(t, sized.doc_id == t["_id"], "left")
    words, chosen = sized.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_id").isNotNull(), F.col("words"))), F.lit(0))).first()
    bits, bi_bits = sizes(words)
    buckets = max(8, words // BUCKET)
    marked = slim.join(t, slim.doc_id == t["_id"], "left").withColumn("is_target", F.col("_id").isNotNull())
    parts = scratch.keep(_parts(marked, bits, bi_bits, buckets), "parts")
    total = float(chosen or words)
    scale = total / max(1, words)

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bucket", "ascending")])  # nulls, that is the documents, come last
        ids, lengths, texts = (group.column(c)[-1].as_py() for c in ("ids", "lengths", "texts"))
        *n, size = group.column("n").to_pylist()
        joined = pa.decompress(texts, size, codec="zstd", asbytes=True)
        stops = np.cumsum(lengths).tolist()
        texts = [joined[b - k : b] for k, b in zip(lengths, stops, strict=True)]
        c = Chunk(texts, bits, bi_bits, buckets)
        got = [
            np.concatenate([np.zeros(0), *[_unpack(x, k) for x, k in zip(group.column(name).to_pylist(), n, strict=False)]])
            for name in ("target", "background")
        ]
        models = (got[0] if chosen else got[1], got[1] * scale)
        ends = np.concatenate(([0], np.cumsum(c.words)))
        out = []
        for m in models:
            loss = np.concatenate(([0.0], np.cumsum(c.loss(m, total, 1 << bits))))
            sums = loss[ends[1:]] - loss[ends[:-1]]
            out.append(pa.array([x / k if k else None for x, k in zip(sums.tolist(), c.words.tolist(), strict=True)], pa.float64()))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(c.words, pa.int64()), "target_loss": out[0], "background_loss": out[1]})

    own = parts.where("bucket is null").select("chunk", "bucket", "n", "target", "background", "ids", "lengths", "texts")
    met = own.unionByName(_answers(parts), allowMissingColumns=True)
    scored = met.groupBy("chunk").applyInArrow(finish, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op8_lm_score(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))
