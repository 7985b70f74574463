import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import hashing, lmscore, tokencount, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA)


def segments_by_hand(scores):
    """Maximal segments by their definition: take the best, then the same left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    n = len(scores)
    sums = {(a, b): math.fsum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1)}
    a, b = max(sums, key=lambda k: (round(sums[k], 9), k[0] - k[1]))
    return [*segments_by_hand(scores[:a]), (a, b), *[(x + b, y + b) for x, y in segments_by_hand(scores[b:])]]


@pytest.mark.parametrize("seed", range(20))
def test_maximal_segments(seed):
    r = random.Random(seed)
    scores = [r.choice((-1, 1)) * r.uniform(0.1, 3) for _ in range(r.randint(0, 30))]
    got = toxicity.maximal_segments(scores)
    assert [(a, b) for a, b, _ in got] == segments_by_hand(scores)
    assert all(abs(v - sum(scores[a:b])) < 1e-9 for a, b, v in got)


def test_toxic_passages_on_held_out_rows(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            at = r.randrange(len(t))
            t[at:at] = [r.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "w1 w2"), (1000, None), (1001, ""), (1002, "idiot " * 50), (1002, "idiot " * 50), (1003, "w1 " * 5000)]
    labels += [(None, 1, 1), (2000, 1, None), (3, 1, 0)]
    out = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 600]
    assert held and all(x.predicted == (x.doc_id % 5 == 0) for x in held)
    by = {x.doc_id: x for x in out}
    assert by[1002].predicted == 1 and len(by[1002].passages) == 1 and by[1003].predicted == 0 and by[1001].predicted == 0
    text = dict(rows)
    for x in held:
        for p in x.passages:
            assert set(toxicity.words_of(text[x.doc_id])[p["first"] : p["last"]]) & set(bad)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [x.score for x in toxicity.toxicity(docs(spark, [(1, "a")]), none).collect()] == [0.0]
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


def test_language_model_losses_by_hand(spark):
    rows = [(1, "a b a b c"), (2, "c c d"), (3, "a"), (4, None), (5, ""), (3, "a")]
    out = {}
    for x in lmscore.score(docs(spark, rows), spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")).collect():
        out.setdefault(x.doc_id, x)
    bits = lmscore.MIN_BITS
    size = 1 << bits
    dense = np.zeros((2, 2 * size))
    for i, t in rows:
        uni, bi, first, _ = lmscore.places([(t or "").encode()], bits)
        for k in (1, 0) if i == 1 else (1,):
            np.add.at(dense[k], uni, 1)
            np.add.at(dense[k], size + bi[~first], 1)
    dense[1] *= dense[0, :size].sum() / dense[1, :size].sum()

    def loss(m, text):
        uni, bi, _, _ = lmscore.places([text.encode()], bits)
        total, before = 0.0, None
        for u, b in zip(uni, bi, strict=True):
            p = (m[u] + lmscore.ALPHA) / (m[:size].sum() + lmscore.ALPHA * size)
            if before is not None:
                p = min(1.0, (m[size + b] + lmscore.MU * p) / (m[before] + lmscore.MU))
            total -= math.log(p)
            before = u
        return total / len(uni)

    for i, t in rows[:3]:
        assert abs(out[i].target_loss - loss(dense[0], t)) < 1e-4
        assert abs(out[i].background_loss - loss(dense[1], t)) < 1e-4
        assert abs(out[i].score - (out[i].target_loss - out[i].background_loss)) < 1e-12
    assert out[1].score < out[2].score
    assert out[4].n_tokens == 0 and out[4].score is None and out[5].score is None


def test_language_model_grows_with_the_corpus(spark, monkeypatch):
    """Many chunks and buckets add up to the counts of one table, which no ceiling keeps from following the corpus."""
    for name, value in (("MAX_BITS", lmscore.MIN_BITS), ("CHUNK", 50_000), ("BUCKET", 20_000)):
        monkeypatch.setattr(lmscore, name, value, raising=False)
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(300)) for _ in range(1000)]
    chosen = spark.createDataFrame([(i,) for i in range(200)], "doc_id bigint")
    out = {x.doc_id: x for x in lmscore.score(docs(spark, list(enumerate(texts))), chosen).collect()}
    assert len(out) == len(texts)

    # the true bigrams of all documents, without any hashing
    uni, bi = Counter(), Counter()
    for t in texts:
        w = t.split()
        uni.update(w)
        bi.update(zip(w, w[1:], strict=False))
    size = 1 << 15
    for i in range(0, 1000, 100):
        w = texts[i].split()
        p = [(uni[x] / 5 + lmscore.ALPHA) / (60_000 + lmscore.ALPHA * size) for x in w]
        q = [p[0]] + [(bi[a, b] / 5 + lmscore.MU * y) / (uni[a] / 5 + lmscore.MU) for a, b, y in zip(w, w[1:], p[1:], strict=False)]
        assert abs(out[i].background_loss + sum(map(math.log, q)) / len(w)) < 0.4

    # the same hashes counted in one dense table for each model
    hashed = [lmscore.places([t.encode()], 15, 19)[:2] for t in texts]
    for column, own, scale in (("target_loss", hashed[:200], 1.0), ("background_loss", hashed, 0.2)):
        u, b = np.zeros(size), np.zeros(1 << 19)
        for x, y in own:
            np.add.at(u, x, scale)
            np.add.at(b, y[1:], scale)
        p = (u + lmscore.ALPHA) / (60_000 + lmscore.ALPHA * size)
        for i, (x, y) in enumerate(hashed):
            q = np.minimum(1.0, (b[y[1:]] + lmscore.MU * p[x[1:]]) / (u[x[:-1]] + lmscore.MU))
            assert abs(out[i][column] + (np.log(p[x[0]]) + np.log(q).sum()) / len(x)) < 1e-9


def test_language_model_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint")
    assert lmscore.score(docs(spark, []), none).count() == 0
    assert [x.score for x in lmscore.score(docs(spark, [(1, "a b")]), none).collect()] == [0.0]


def exact(pieces, fallback=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda s: len(t.encode(s).ids)


TEXTS = [
    "", " ", "a", "hello world", "  two  spaces ", "line\nbreak\n\n and more", "ünïcödé ß 漢字 かな", "😀😀 x😀", "<s> <unk> </s>", "<unk>😀", "▁already ▁▁ marked", "tab\tand\r\n", "a" * 500,
    "The quick brown fox, 12345.678! (ok)", "\u0000\u0001", "e\u0301", "ﷺ",
]


def test_counts_equal_the_tokenizer(spark):
    pieces = tokencount.load_pieces()
    want = exact(pieces)
    count = tokencount.Counter(pieces)
    assert [count(t) for t in TEXTS] == [want(t) for t in TEXTS]
    assert [count(t) for t in TEXTS] == [count(t) for t in TEXTS]
    got = tokencount.token_counts(docs(spark, [*enumerate(TEXTS), (99, None), (None, "a b")])).collect()
    assert {x.doc_id: x.n_tokens for x in got if x.doc_id is not None} == {**{i: want(t) for i, t in enumerate(TEXTS)}, 99: 0}


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_fractions(seed):
    r = random.Random(seed)
    pieces = [("<unk>", 0.0), ("▁", -2.0)] + [(p, -float(r.randint(1, 4)) / r.choice((1, 3, 7))) for p in sorted({"".join(r.choice("▁ab") if i == 0 else r.choice("ab") for i in range(r.randint(1, 4))) for _ in range(25)} - {"▁"})]
    count = tokencount.Counter(pieces)
    want = exact(pieces, False)
    for _ in range(60):
        t = "".join(r.choice("ab c") for _ in range(r.randint(0, 25)))
        assert count(t) == want(t), t


def test_hash_of_repeated_powers():
    data = np.frombuffer(b"abcabcabc", np.uint8)
    p, inv = hashing.prefix_sums(data), hashing.inverses(len(data))
    a, b = np.array([0, 3, 6, 1]), np.array([3, 6, 9, 4])
    h = (p[b] - p[a]) * inv[a]
    assert h[0] == h[1] == h[2] != h[3]


def test_language_model_with_a_vocabulary_of_its_own(spark):
    """Losses from plain counts of words and pairs of words; places are distinct for so few of them."""
    rows = [(1, "A b a c"), (2, "c a b b"), (3, "d"), (4, "b a"), (5, None), (6, "x " * 3000)]
    chosen = {1, 4}
    out = {x.doc_id: x for x in lmscore.score(docs(spark, rows), spark.createDataFrame([(i,) for i in chosen], "doc_id bigint")).collect()}
    words = {i: (t or "").lower().split() for i, t in rows}
    every = {w for t in words.values() for w in t}
    assert len({int(lmscore.places([w.encode()], lmscore.sizes(sum(map(len, words.values())))[0])[0][0]) for w in every}) == len(every)
    vocabulary = 1 << lmscore.sizes(sum(map(len, words.values())))[0]
    total = sum(len(words[i]) for i in chosen)
    for column, own in (("target_loss", chosen), ("background_loss", set(words))):
        scale = total / sum(len(words[i]) for i in own)
        uni, bi = Counter(), Counter()
        for i in own:
            uni.update(words[i])
            bi.update(zip(words[i], words[i][1:], strict=False))
        for i, t in words.items():
            if not t:
                assert out[i][column] is None and out[i].n_tokens == 0
                continue
            loss = 0.0
            for k, w in enumerate(t):
                p = (uni[w] * scale + lmscore.ALPHA) / (total + lmscore.ALPHA * vocabulary)
                if k:
                    p = min(1.0, (bi[t[k - 1], w] * scale + lmscore.MU * p) / (uni[t[k - 1]] * scale + lmscore.MU))
                loss -= math.log(p)
            assert abs(out[i][column] - loss / len(t)) < 1e-9, (i, column)


def test_toxicity_scores_by_hand(spark):
    """Counts, log-odds, decay, segments, Gumbel mean and logistic curve from plain loops, and the score of every text."""
    r = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(240):
        t = [r.choice(words) for _ in range(r.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            t[r.randrange(len(t))] = "vile"
            t.append("vilest")
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    import zlib

    learn = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    counts = {0: Counter(), 1: Counter()}
    for i, t in rows:
        if i in learn:
            counts[learn[i]].update(toxicity.features(toxicity.words_of(t)))
    tox, cln = (sum(counts[k].values()) for k in (1, 0))
    listed = {}
    for w in counts[0] | counts[1]:
        a, b = counts[1][w], counts[0][w]
        prior = toxicity.EVEN + (a + b) * toxicity.PRIOR / (tox + cln)
        p, q = (a + prior) / (tox + toxicity.PRIOR), (b + prior) / (cln + toxicity.PRIOR)
        odds = math.log(p / (1 - p)) - math.log(q / (1 - q))
        if abs(odds / math.sqrt(1 / (a + prior) + 1 / (b + prior))) >= toxicity.MIN_Z:
            listed[w] = odds
    assert "vile" in listed
    lt, lc = (sum(counts[k][w] for w in listed) for k in (1, 0))
    rest = min(-0.01, math.log((tox - lt + toxicity.PRIOR) / (tox + toxicity.PRIOR)) - math.log((cln - lc + toxicity.PRIOR) / (cln + toxicity.PRIOR)))
    share = {w: (counts[0][w] + toxicity.EVEN) / (cln + toxicity.PRIOR) for w in listed}

    def mean(x):
        return sum(share[w] * math.exp(x * listed[w]) for w in listed) + max(0.0, 1 - sum(share.values())) * math.exp(x * rest)

    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    decay = max(high, 1e-3)
    gumbel, some = {}, {}
    for i, t in rows:
        s = []
        for w in toxicity.words_of(t):
            keys = [w, *[w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k]]
            s.append(next((listed[k] for k in keys if k in listed), rest))
        best = max((sum(s[a:b]) for a, b in segments_by_hand(s)), default=0.0)
        some[i] = best > 0
        gumbel[i] = best * decay - math.log(max(1, len(s)))
    clean = [gumbel[i] for i, y in learn.items() if y == 0 and some[i]]
    log_k = (sum(clean) / len(clean) if clean else 0.0) - toxicity.EULER
    evidence = {i: g - log_k if some[i] else min(g - log_k, 0.0) for i, g in gumbel.items()}
    bins = {}
    for i, y in learn.items():
        k = math.floor(min(max(evidence[i], toxicity.LEAST), toxicity.MOST) / toxicity.BIN)
        bins.setdefault(k, [0, 0])[y] += 1
    a, b = toxicity._logistic([((k + 0.5) * toxicity.BIN, *bins[k]) for k in sorted(bins)])
    # the curve is at the ridge likelihood's top: its slopes vanish
    for g in (lambda x: 1.0, lambda x: x):
        slope = sum((y - (c + y) / (1 + math.exp(-(a + b * (k + 0.5) * toxicity.BIN)))) * g((k + 0.5) * toxicity.BIN) for k, (c, y) in bins.items())
        assert abs(slope) < 0.01 * max(1, abs(a), abs(b))
    out = {x.doc_id: x for x in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    for i, _ in rows:
        want = 1 / (1 + math.exp(-(a + max(b, 0.0) * min(max(evidence[i], toxicity.LEAST), toxicity.MOST))))
        assert abs(out[i].score - want) < 1e-6, i


def test_many_significant_words_are_all_listed(spark):
    """More significant words than any fixed list would hold are scored: each alone gives a document away."""
    name = lambda k: "bad" + chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(i, f"{name(i % 300)} good" if i % 2 else f"fine{chr(97 + i % 20)} good") for i in range(18_000)]
    counts = toxicity.class_counts(spark.createDataFrame([(t, i % 2) for i, t in rows], "text string, toxic int"))
    found = toxicity.fit_lexicon(counts).listed
    assert sum(w.startswith("bad") and not w.endswith("*") for w in found) == 150


def test_training_rows_are_bounded(spark):
    marks = spark.range(20_000).select(F.col("id").alias("doc_id"))
    n = toxicity._bounded(marks, 5000).count()
    assert 4500 < n <= 5000 and toxicity._bounded(marks, 30_000).count() == 20_000


def test_token_counts_of_nothing_and_of_very_long_texts(spark):
    assert tokencount.token_counts(docs(spark, [])).count() == 0
    long = "word and more " * 100_000
    got = {x.doc_id: x.n_tokens for x in tokencount.token_counts(docs(spark, [(1, long), (2, "x" * 200_000)])).collect()}
    one = exact(tokencount.load_pieces())
    assert got[1] == one(long) and got[2] == one("x" * 200_000)
