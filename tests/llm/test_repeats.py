import random

import numpy as np
import pytest

from starloom.llm import repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tk string, pos string"


def noise(r, n, letters="abcdefghij éß"):
    return "".join(r.choice(letters) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    shared = [noise(r, n) for n in (380, 420, 700, 1500)]
    rows = []
    for i in range(60):
        parts = [noise(r, r.randint(0, 600))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 60)
            parts += [s[a : len(s) - r.randint(0, 60)], noise(r, r.randint(0, 80))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, None), (102, ""), (103, "a" * 399), (104, "a" * 900), (105, "ab" * 700), (106, "ab" * 500 + "c"), (None, shared[2]), (107, "a" * 400)]
    return rows


def check(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in repeats.trimmed(d).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, spans in zip(rows, texts, repeats.brute_force(texts), strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0] + [h for _, h in spans], [lo for lo, _ in spans] + [len(t)], strict=True))
        want.append((str(i), len(t), len(t) - len(kept), len(spans), kept))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_equal_brute_force(spark, seed):
    check(spark, corpus(seed))


@pytest.mark.parametrize("chunk", [1, 3])
def test_divided_anchors_give_the_same(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    check(spark, corpus(3))


def test_divided_anchors_tell_first_bytes_from_places(spark, monkeypatch):
    """In a text of period d windows meet an anchor d bytes apart; first bytes that differ by d must not make up for that."""
    monkeypatch.setattr(repeats, "CHUNK", 1)
    r = random.Random(10)
    wave = noise(r, 25, "bcdefghijklmnopqrst") * 40
    check(spark, [(i, noise(r, 500) + c + wave + noise(r, 500)) for i, c in enumerate("az")])


def test_large_groups_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PAIRED", 2)
    check(spark, corpus(4))


def test_marks_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MARK_ROWS", 0)
    check(spark, corpus(5)[:30])


def test_suffixes_sort_like_bytes():
    r = random.Random(9)
    parts = [noise(r, r.randint(0, 12), "ab").encode() for _ in range(300)]
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    group = np.sort(np.array([r.randint(0, 4) for _ in parts]))
    s = repeats.Suffixes(data, np.cumsum(size) - size, size, group)
    order = s.sorted()
    assert [(group[i], parts[i]) for i in order] == sorted(zip(group, parts, strict=True))


def test_a_lying_hash_is_found_out():
    data = np.frombuffer(b"abcdeabcxe", np.uint8)
    s = repeats.Suffixes(data, np.array([0, 5]), np.array([5, 5]), np.array([0, 0]))
    assert s.verified(np.array([0]), np.array([1]), np.array([5])).tolist() == [3]


def test_empty(spark):
    assert repeats.trimmed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_that_share_a_key_are_keyed_anew(spark, monkeypatch):
    """With a key of few bits different texts collide: each still loses what it repeats, and nothing else."""
    from pyspark.sql import functions as F

    full = F.xxhash64
    monkeypatch.setattr(repeats.F, "xxhash64", lambda *c: full(*c) if len(c) > 1 else full(*c) % 5)
    check(spark, corpus(6)[:25])


def test_windows_need_both_hashes():
    h, h2 = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    first, number, times = repeats._distinct(h, h2)
    assert first.tolist() == [0, 1, 3] and number.tolist() == [0, 1, 0, 2] and times.tolist() == [2, 1, 1]


def test_very_long_texts(spark):
    r = random.Random(8)
    a, b = noise(r, 700_000), noise(r, 300_000)
    check(spark, [(1, a), (2, b + a[1000:2000]), (3, "q" * 50_000)])


def test_contexts_of_a_frequent_anchor_are_divided(spark, tmp_path):
    """An anchor with half of all contexts doesn't go to one task: AQE finds its join skewed and divides it."""
    from pyspark.sql import functions as F

    from starloom.llm.common import Scratch

    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        i = F.col("id")
        place = lambda x: F.struct(x.alias("tk"), F.lit(0).alias("pos"))
        made = spark.range(0, 20_000, 1, 16).select(
            F.when(i < 10_000, -1).otherwise(i).alias("fp"), F.md5(i.cast("string")).cast("binary").alias("ctx"),
            place(i).alias("lo"), place(i + F.when(i % 1000 == 0, 1).otherwise(0)).alias("hi"),
        )
        made.repartition(16).write.parquet(f"{tmp_path}/contexts")
        found = repeats._repeated(spark.read.parquet(f"{tmp_path}/contexts"), Scratch(spark))
        rows = found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = [(-1, i, i % 1000 == 0, True, 10_000) for i in range(10_000)] + [(i, i, True, False, None) for i in range(10_000, 20_000, 1000)]
    assert sorted((r.fp, r.rep.tk, r.whole, r.several, r.k) for r in rows) == sorted(want)
