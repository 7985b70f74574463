import random
from itertools import combinations

import numpy as np
import pytest

from starloom.llm import hashing, neardup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, cls string, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA)


def shingles(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def varied(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(160):
        n = int(2 ** r.uniform(0, 9.5))
        words = [r.choice(vocabulary) for _ in range(n)]
        if i % 3 == 0:
            words[n // 2 : n // 2] = passage
        rows.append((i, " ".join(words)))
        for k in range(r.choice((0, 0, 0, 2))):
            near = list(words)
            for _ in range(max(1, len(near) * r.choice((1, 2, 3, 5)) // 120)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            rows.append((1000 + 10 * i + k, " ".join(near).upper() if k else " ".join(near)))
    base = [r.choice(vocabulary) for _ in range(140)]
    for i in range(60):  # one large family around a base that isn't the least
        near = list(base)
        for _ in range(i % 6):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        rows.append((5000 + i, "  ".join(near)))
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "a b c d e"), (9005, "a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = varied(seed)
    got = sorted(tuple(x) for x in neardup.similar_components(docs(spark, rows).repartition(3)).collect())
    assert got == by_hand(rows)


def test_similar_sets_share_their_guaranteed_signatures():
    r = np.random.default_rng(3)
    for n in (5, 20, 63, 64, 80, 150, 191, 192, 250, 400, 800, 3000):
        for _ in range(5):
            u = np.unique(r.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
            drop = int(len(u) / 8)  # as many elements replaced as leave 7/9 similar
            v = np.unique(np.concatenate((u[drop:], r.integers(0, 2**63, drop, dtype=np.int64).view(np.uint64))))
            common = len(np.intersect1d(u, v))
            assert common / (len(u) + len(v) - common) >= 0.75
            shared = [(len(np.intersect1d(x, y)), max(lx, ly)) for x, bx, lx in neardup.signatures(u) for y, by, ly in neardup.signatures(v) if bx == by]
            assert shared and all(k >= least for k, least in shared)


def test_sketch_never_overstates():
    r = np.random.default_rng(5)
    for a, b in ((30, 40), (100, 100), (500, 900)):
        u, v = (np.unique(r.integers(0, 2000, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (a, b))
        assert neardup.sketch_distance(neardup.odd_sketch(u), neardup.odd_sketch(v)) <= len(np.setxor1d(u, v))


def test_words_hash_alike_wherever_they_stand():
    (a, n), (b, m) = hashing.word_hashes([b"xx Foo bar", b"bar"]), hashing.word_hashes([b"foo\t\tBAR"])
    assert list(n) == [3, 1] and list(m) == [2]
    assert list(a[1:]) == [b[0], b[1], b[1]]


def test_one_stays_of_each_group(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "q"), (None, "z z z"), (None, "z z z"), (7, None)]
    d = docs(spark, rows)
    kept = neardup.deduplicated(d)
    assert kept.columns == d.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [(False, 3), (False, 7), (False, 9), (True, 0)]


def test_texts_of_one_id_and_rows_without_one_are_told_apart(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b, c = a + " more", " ".join(f"c{i}" for i in range(60))
    rows = [(5, a), (3, b), (5, c), (None, a), (None, c + " x"), (None, "lone words of a row"), (None, "lone words of a row"), (None, None), (6, "")]
    kept = sorted((str(x.doc_id), str(x.text)) for x in neardup.deduplicated(docs(spark, rows)).collect())
    # 3 stays for a and b, 5 for c; rows without an id go where one with an id is alike
    assert kept == sorted([("3", b), ("5", c), ("None", "lone words of a row"), ("None", "None"), ("6", "")])
    family = [(None, a), (None, b), (None, a + " other")]
    assert neardup.deduplicated(docs(spark, family)).count() == 1


def test_empty(spark):
    assert neardup.similar_components(docs(spark, [])).count() == 0


def test_two_level_signatures_and_what_spoils_them():
    """The bound of _spoiled is met by the worst differences, and sets with many empty partitions stay within reach."""
    r = np.random.default_rng(11)
    for n in (64, 70, 100, 190, 192, 250, 255, 600):
        u = np.unique(r.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
        clustered = np.sort(u >> np.uint64(6))  # all elements in one corner of the domain: most partitions are empty
        for base in (u, clustered):
            v = np.unique(np.concatenate((base[int(len(base) / 8) :], r.integers(0, 2**57, int(len(base) / 8), dtype=np.int64).view(np.uint64))))
            common = len(np.intersect1d(base, v))
            assert common / (len(base) + len(v) - common) >= 0.75
            shared = [(len(np.intersect1d(x, y)), max(mx, my)) for x, bx, mx in neardup.signatures(base) for y, by, my in neardup.signatures(v) if bx == by]
            assert shared and all(k >= m for k, m in shared)


@pytest.mark.parametrize("local", [2])
def test_hot_signatures_settled_where_they_are_read(spark, monkeypatch, local):
    monkeypatch.setattr(neardup, "LOCAL", local)
    rows = varied(7)
    got = sorted(tuple(x) for x in neardup.similar_components(docs(spark, rows).repartition(3)).collect())
    assert got == by_hand(rows)


def test_similarity_of_exactly_three_quarters_links_across_bands(spark):
    rows = []
    for i, n in enumerate((6, 21, 60, 90, 180, 540)):  # 3n shingles against 4n: exactly 3/4
        words = [f"d{i}x{k}" for k in range(4 * n + 4)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[: 3 * n + 4])), (10 * i + 2, " ".join(words[: 3 * n + 3]))]
    want = by_hand(rows)
    assert len({c for *_, c in want}) < len(rows)
    assert sorted(tuple(x) for x in neardup.similar_components(docs(spark, rows)).collect()) == want


def test_a_chain_needs_as_many_rounds_as_it_needs(spark):
    from starloom.llm.common import Scratch

    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")
    got = {x.node: x.comp for x in neardup.components(links, Scratch(spark), "chain").collect()}
    assert got == {i: 0 for i in range(n + 1)}


def test_a_very_long_text_and_its_near_copy(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    near = [*words[:60_000], "other", *words[60_001:]]
    rows = [(2, " ".join(words)), (1, " ".join(near)), (3, "x" * 400_000), (4, None)]
    got = {x.doc_id: x.component_id for x in neardup.similar_components(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
