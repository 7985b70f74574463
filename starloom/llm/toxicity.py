"""Toxicity: every significant toxic passage of a text by maximum-scoring segments of token log-odds.

1. Words of labelled documents are counted by class, once a document. A word's score is its log-odds between the classes
   under a Dirichlet prior of an even part and one proportional to its frequency overall; so are word beginnings, which stand
   in for words that are not listed; all words whose log-odds are significant are listed, all others share the log-odds
   of the rest. At most TRAINING_ROWS labelled rows, chosen by a hash of doc_id, are learnt from: this bounds the lexicon that is
   sent to the workers.
2. One linear scan finds all maximal scoring segments of a text.
3. Extreme-value calibration: chance scores of the best segment of n words follow a Gumbel law with decay lambda (which solves
   E[exp(lambda * score)] = 1 on clean text) and location log(K n) / lambda. A segment's evidence is
   -log(K n exp(-lambda S)), its negative log expected count; segments above SIGNIFICANT are toxic passages.
4. A logistic curve over the best passage's evidence, fitted to histograms of the training documents, gives the score.

Only rows with crc32(doc_id as text) mod 3 other than 1 are learnt from; labels, lang, source and doc_id are no inputs.

Defined results: a null or empty text has no segments and the score of no evidence; null labels are not learnt from;
repeated rows count as often as they occur; with no label of one class all scores are 0; an empty table gives an empty
result. Several labels of a document: each counts. Ties: of segments with one sum all are kept. Very long texts are scanned
whole, in the worker that reads them; columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast, table
from .hashing import pieces

_WORD = re.compile(r"[^\W\d_]+|\d+")
#: The Dirichlet prior of a word: EVEN plus PRIOR times its share of all documents' words.
EVEN, PRIOR = 0.5, 500.0
MIN_Z = 3.5
#: The bound of the labelled rows that the lexicon, the calibration and the curve are fitted on.
TRAINING_ROWS = 200_000
SIGNIFICANT = 3.0
EULER = 0.5772156649015329
#: Evidence is counted in bins of this width between these ends to fit the curve.
BIN, LEAST, MOST = 0.25, -20.0, 60.0
PARTIAL_WORDS = 300_000
#: Lengths of word beginnings that stand in for words that are not listed themselves, the longest first.
PREFIXES = (8, 7, 6, 5, 4)
CACHE = 200_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(words: list[str]) -> set[str]:
    """The distinct words of a text and their beginnings (marked by a final *) of the lengths in PREFIXES."""
    found = set(words)
    for w in tuple(found):
        found.update(w[:k] + "*" for k in PREFIXES if len(w) > k)
    return found


def class_counts(labelled: DataFrame) -> DataFrame:
    """word, toxic, clean over rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(held[0].keys() | held[1].keys())
            cols = [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in held[::-1]]]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "clean"])
            for c in held:
                c.clear()

        for batch in batches:
            marks = batch.column(1).to_pylist()
            for start, texts in pieces(batch.column(0)):
                for text, toxic in zip(texts, marks[start:], strict=False):
                    held[toxic].update(features(words_of(text and text.decode())))
                    if len(held[0]) > PARTIAL_WORDS:
                        yield from flush()
        yield from flush()

    parts = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic bigint, clean bigint")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Lexicon:
    """Scores of listed words and of all others, with the decay of chance scores."""

    def __init__(self, listed: dict[str, float], rest: float, decay: float, clean: dict[str, float]):
        self.listed, self.rest, self.decay, self.clean = listed, rest, decay, clean
        self.known: dict[str, float | None] = {}

    def score(self, word: str) -> float | None:
        """Score of a word or of its longest listed beginning; None if neither is listed. Answers are kept in a bounded table."""
        known = self.known
        if word in known:
            return known[word]
        if len(known) >= CACHE:
            known.clear()
        keys = [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]
        known[word] = next((self.listed[k] for k in keys if k in self.listed), None)
        return known[word]


def fit_lexicon(counts: DataFrame) -> Lexicon | None:
    """Log-odds with Dirichlet priors; ``counts`` stays distributed, only the listed words come to the driver."""
    t, c = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not t or not c:
        return None
    prior = EVEN + (F.col("toxic") + F.col("clean")) * (PRIOR / (t + c))
    pt, pc = (F.col("toxic") + prior) / (t + PRIOR), (F.col("clean") + prior) / (c + PRIOR)
    scored = counts.select(
        "word", "toxic", "clean", (F.log(pt / (1 - pt)) - F.log(pc / (1 - pc))).alias("odds"), F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("sd")
    ).withColumn("z", F.col("odds") / F.col("sd"))
    rows = scored.where(F.abs("z") >= MIN_Z).orderBy("word").collect()
    listed = {r.word: r.odds for r in rows}
    lt, lc = sum(r.toxic for r in rows), sum(r.clean for r in rows)
    rest = min(-0.01, math.log((t - lt + PRIOR) / (t + PRIOR)) - math.log((c - lc + PRIOR) / (c + PRIOR)))
    clean = {r.word: (r.clean + EVEN) / (c + PRIOR) for r in rows}
    return Lexicon(listed, rest, _decay(listed, clean, rest), clean)


def _decay(listed: dict[str, float], clean: dict[str, float], rest: float) -> float:
    """The positive solution of sum(p * exp(decay * score)) = 1 for the clean words' law."""
    s = np.array([*listed.values(), rest])
    p = np.array([*[clean[w] for w in listed], max(0.0, 1 - sum(clean.values()))])
    mean = lambda x: float((p * np.exp(np.minimum(x * s, 700.0))).sum())
    if float((p * s).sum()) >= 0 or not (s > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(high, 1e-3)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in one pass over the scores.

    Each candidate keeps the running sums before and behind it. A new positive score joins the latest candidate that
    began lower than the current sum began, unless that one already ended at least as high as the current sum.
    """
    found: list[list] = []  # start, end, sum before, sum behind
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, y - x) for a, b, x, y in found]


def segments(words: list[str], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """Maximal segments of a text; runs of unlisted words count as one step between listed ones."""
    hits = [(i, s) for i, s in enumerate(map(lexicon.score, words)) if s is not None]
    scores, spans, at = [], [], 0
    for i, s in hits:
        if i > at:
            scores.append((i - at) * lexicon.rest)
            spans.append((at, i))
        scores.append(s)
        spans.append((i, i + 1))
        at = i + 1
    return [(spans[a][0], spans[b - 1][1], v) for a, b, v in maximal_segments(scores)]


_RAW = "doc_id bigint, n_words bigint, segments array<struct<first:int,last:int,score:double>>"


def scan(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, n_words and all maximal segments (word ranges and sums) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for start, texts in pieces(batch.column(1)):
                words = [words_of(t and t.decode()) for t in texts]
                found = [[{"first": a, "last": b, "score": v} for a, b, v in segments(w, lexicon)] for w in words]
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "segments"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RAW)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic curve over (evidence, clean, toxic) counts, by Newton steps."""
    x, c, t = (np.array(v, np.float64) for v in zip(*bins, strict=True))
    a, b = 0.0, 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        n = c + t
        g = np.array([(t - n * p).sum() - 1e-3 * a, ((t - n * p) * x).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _bounded(marks: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the labelled rows, chosen by a hash of their ids, or all of them if they are fewer."""
    n = marks.count()
    if n <= rows:
        return marks
    return marks.where(F.pmod(F.xxhash64("doc_id", F.lit("training")), F.lit(1 << 40)) < int(0.98 * rows / n * (1 << 40)))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence and passages (word ranges of significant segments) of every document.

    ``learn`` is a condition on doc_id for the labelled rows to learn from.
    """
    scratch = Scratch(docs.sparkSession)
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    marks = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = sized_broadcast(_bounded(marks, TRAINING_ROWS).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = scratch.keep(class_counts(slim.join(marks, slim.doc_id == marks["_id"]).select("text", "toxic")), "counts")
    lexicon = fit_lexicon(counts)
    if lexicon is None:
        none = slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
        return none.withColumns({"evidence": F.lit(None).cast("double"), "passages": F.array().cast("array<struct<first:int,last:int,score:double>>")})
    raw = scratch.keep(scan(slim, lexicon), "raw")
    decay = lexicon.decay
    n = F.greatest(F.col("n_words"), F.lit(1))
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    raw = raw.withColumn("gumbel", best * decay - F.log(n))
    labelled = raw.join(marks, raw.doc_id == marks["_id"])
    # mean of a Gumbel law: log K + Euler's constant, from clean training documents that have any segment
    mean = labelled.where((F.col("toxic") == 0) & (F.size("segments") > 0)).agg(F.avg("gumbel")).first()[0]
    log_k = (mean if mean is not None else 0.0) - EULER
    evidence = F.col("gumbel") - log_k
    raw = raw.withColumn("evidence", F.when(F.size("segments") > 0, evidence).otherwise(F.least(evidence, F.lit(0.0))))
    binned = raw.join(marks, raw.doc_id == marks["_id"]).groupBy(
        F.floor(F.least(F.greatest("evidence", F.lit(LEAST)), F.lit(MOST)) / BIN).alias("bin")
    ).agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    bins = [((r.bin + 0.5) * BIN, r.clean, r.toxic) for r in binned.orderBy("bin").collect()]
    a, b = _logistic(bins)
    x = F.least(F.greatest("evidence", F.lit(LEAST)), F.lit(MOST))
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(max(b, 0.0)) * x)))
    passages = F.filter("segments", lambda s: s["score"] * decay - F.log(n) - log_k >= SIGNIFICANT)
    return raw.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), "evidence", passages.alias("passages")
    )


def op4_toxicity(spark, sf_dir) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
