import random

import pytest
from pyspark.sql import functions as F

from starloom.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", "x") for i, t, s in rows], SCHEMA)


def seats_by_hand(votes, n):
    got = {k: 0 for k in votes}
    for _ in range(n):
        best = max(sorted(votes), key=lambda k: votes[k] / (2 * got[k] + 1))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_seats_equal_highest_quotients(spark, seed):
    r = random.Random(seed)
    votes = {f"p{i:02d}": r.randint(1, 1000) for i in range(12)}
    n = r.randint(5, 200)
    df = spark.createDataFrame([(k, float(v), n) for k, v in votes.items()], "party string, votes double, seats bigint")
    got = {x.party: x.quota for x in mixing.sainte_lague(df, [], "party", "votes", "seats").collect()}
    assert got == seats_by_hand(votes, n)


def test_targets_stop_at_three_sizes(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 2.0), ("c", 500, 3.0), (None, 0, 1.0)], "source string, source_size bigint, weight double")
    t = {x.source: x.target for x in mixing.targets(df).collect()}
    assert t["a"] == 30 and t[None] == 0
    assert abs(sum(t.values()) - 1510) < 1e-6
    assert abs(t["c"] / t["b"] - 1.5) < 1e-9


def test_taken_is_near_target_and_bounded(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 8) for _ in range(r.randint(0, 300))), f"s{i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(None, "a b c", "s1"), (3, None, "s2"), (3, "", "s2"), (7, "x y", "s0"), (7, "x y", "s0")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x["size"]
        size, target, taken = by.get(x.source, (0, 0, 0))
        by[x.source] = (size + x["size"], x.target, taken + x.taken)
        assert x.source_size >= x["size"]
    for size, target, taken in by.values():
        assert abs(taken - target) <= max(0.03 * target, 20)
    assert abs(sum(t for _, t, _ in by.values()) - sum(s for s, _, _ in by.values())) < 1e-3
    again = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_small_sources_get_their_targets_beside_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_BLOCKS", 1)
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(400), "large") for i in range(300)] + [(1000 + i, words(100), "small") for i in range(20)]
    rows += [(2000 + i, words(150), "some") for i in range(200)] + [(3000, words(90), "tiny")]
    by = {}
    for x in mixing.mix(docs(spark, rows)).collect():
        assert 0 <= x.taken <= 3 * x["size"]
        by[x.source] = (x.target, by.get(x.source, (0, 0))[1] + x.taken)
    assert set(by) == {"large", "small", "some", "tiny"}
    for target, taken in by.values():
        assert abs(taken - target) <= 1


def test_empty_table_and_copies(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    one = docs(spark, [(1, "a b c d", "s"), (2, "e f g h", "s")])
    assert mixing.mixed_documents(one).columns == one.columns
    assert mixing.mixed_documents(one).count() == 2


def test_taken_words_by_hand(spark, monkeypatch):
    """Every document's words taken, word by word: streams, blocks, permutation and quotas from plain loops."""
    import hashlib

    monkeypatch.setattr(mixing, "MIN_BLOCKS", 300)
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.randint(0, 60))), ["a", "b", "c", None][i % 7 % 4]) for i in range(500)]
    rows += [(None, "x y z", "a")] * 30 + [(7, "k l", "b")] * 5 + [(9, " ".join(["long"] * 3000), "c")]
    sized = [(i, len((t or "").split()), s) for i, t, s in rows]
    total = sum(n for _, n, _ in sized)
    block = max(1, total // 300)
    size_of = {s: sum(n for _, n, x in sized if x == s) for s in ("a", "b", "c", None)}
    weight = {"a": 1.0, "b": 2.0, "c": 3.0, None: 1.0}
    target, left, free = {}, float(total), dict(weight)
    while True:  # cap what exceeds three sizes, share the rest
        over = [s for s in free if left * free[s] / sum(free.values()) >= 3 * size_of[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size_of[s]
            del free[s]
        left = total - sum(target.values())
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    order = ["a", "b", "c", None]
    seats = {k: 0 for k in order}
    for _ in range(int(sum(target.values()) + 1e-9)):
        seats[max(order, key=lambda k: (target[k] / (2 * seats[k] + 1), -order.index(k)))] += 1
    want = []
    for s in order:
        shards = {}
        for i, n, x in sized:
            if x == s:
                key = hashlib.md5(":".join(["mix", *([str(i)] if i is not None else []), str(n)]).encode()).hexdigest()
                shards.setdefault(int(key[:4], 16) % 64, []).append((key, i is not None, i or 0, n, i))
        words = {h: sum(x[3] for x in v) for h, v in shards.items()}
        quota = {h: 0 for h in words}
        for _ in range(min(seats[s], 3 * size_of[s])):
            best = max(sorted(words), key=lambda h: words[h] / (2 * quota[h] + 1))
            quota[best] += 1
        for h, v in shards.items():
            stream = [k for k, x in enumerate(sorted(v)) for _ in range(x[3])]
            blocks = [stream[a : a + block] for a in range(0, len(stream), block)] or [[]]
            n = len(blocks)
            offset = spark.range(1).select(F.pmod(F.xxhash64(F.lit("mix"), F.lit(s).cast("string"), F.lit(h).cast("long")), F.lit(n))).first()[0]
            place = sorted(range(n), key=lambda i: (i * mixing.PRIME + offset) % n)
            chosen = [k for i in place for k in blocks[i]]
            passes, rest = divmod(quota[h], len(stream)) if stream else (0, 0)
            taken = [passes * x[3] for x in sorted(v)]
            for k in chosen[:rest]:
                taken[k] += 1
            want += [(x[4], x[3], s, t) for x, t in zip(sorted(v), taken, strict=True)]
    got = [(x.doc_id, x["size"], x.source, x.taken) for x in mixing.mix(docs(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_each_copy(spark):
    from starloom.llm.common import each_copy

    d = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 10, 99, 100, 101)], "n bigint")
    got = {}
    for x in each_copy(d, "n", "k").collect():
        got.setdefault(x.n, []).append(x.k)
    assert all(sorted(v) == list(range(n)) for n, v in got.items()) and len(got) == 8
