import random
import re
import zlib
from collections import Counter

import pytest

from starloom.llm import spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, word string, n string, form string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "w", "n", "f") for i, t in rows], SCHEMA)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def edited(a, b):
    """Whether exactly one insertion, deletion or replacement turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :]


def words_by_hand(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def by_hand(rows):
    n = words_by_hand(rows)
    near = {w: [v for v in n if edited(w, v)] for w in n}
    form = {}
    for w, all_ in near.items():
        best = min(all_, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def same(spark, rows):
    got = [tuple(r[k] for k in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.spelling_variants(docs(spark, rows).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)
    return set(got)


def test_random_words_equal_all_pairs(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abé") for _ in range(r.randint(7, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababa", "bababab", "ÉCLAIRÉ", "éclairé", "naïveté×÷"]
    rows = []
    for i in range(90):
        t = []
        for _ in range(40):
            w = list(r.choice(base))
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "é", "bb"])
            t.append("".join(w))
        rows.append((i % 70, " ".join(t) + " a1b,c-d_e"))
    rows += [(None, "abcdefg abcdefg ABCDEFG"), (None, "abcdefg"), (5, None), (6, ""), (7, "short words only"), (8, rows[0][1]), (8, rows[0][1])]
    got = same(spark, rows)
    assert sum(x[2] > 0 for x in got) > 100


def test_chains_of_forms_and_ties(spark):
    word = "chainedword"
    counts = {word: 12_000, word + "s": 1_100, word + "st": 100, word + "sta": 9, word[:-1]: 1_200, "tiedword": 30, "tiedwordb": 400, "tiedworda": 400}
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(counts.items())]
    got = {x[0]: x for x in same(spark, rows)}
    assert got[word + "sta"][5] == word and got[word + "sta"][3] == word + "st" and got["tiedword"][3] == "tiedworda"


@pytest.mark.parametrize("size", [31, 32, 33, 34, 200])
def test_long_words(spark, size):
    r = random.Random(size)
    rows = []
    for k, letters in enumerate(("abcdefghij", "a", "ab")):
        w = "".join(r.choice(letters) for _ in range(size))
        for v in (w, w[1:], w[:-1], w + "z", "z" + w, w[: size // 2] + "z" + w[size // 2 + 1 :], w[:3] + "zz" + w[3:], w[:5] + w[6:]):
            rows += [(k, v)] * (2 if v == w else 25)
    same(spark, rows)


def test_an_endless_word(spark):
    rows = [(1, "ab" * 30_000), (2, "ab" * 30_000), (3, "x" + "ab" * 30_000 + " " + "y" * 50_000), (4, "x" + "ab" * 30_000 + " " + "y" * 50_001), (5, "y" * 50_000 + " " + "y" * 50_001)]
    got = spelling.spelling_variants(docs(spark, rows)).collect()
    words = words_by_hand(rows)
    assert {(g.word, g.n) for g in got} == set(words.items())
    assert all(g.n_near == sum(edited(g.word, v) for v in words) for g in got) and sum(g.n_near for g in got) >= 2


def test_empty(spark):
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, None), (2, "few letters")])).count() == 0
