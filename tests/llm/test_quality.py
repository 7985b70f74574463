import random

import pytest

from starloom.llm import quality
from starloom.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, symbols string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y") for i, t, lang, s in rows], SCHEMA)


def plain(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_base_features_by_hand():
    assert quality.base_features(None) == (0, 0, 0, 0, 0, 0, 0)
    assert quality.base_features("") == (0, 0, 0, 0, 0, 0, 0)
    # the window "a b c" is there twice, so are "c d e"? no: six words are covered
    assert quality.base_features("a b c\nx a b c\n\nx a b c") == (11, 11, 0, 1, 11, 3, 0)
    n, chars, symbols, dup, repeat, lines, signs = quality.base_features("é# |b c\u00a0d e\n \n*")
    assert (n, chars, symbols, dup, repeat, lines, signs) == (5, 9, 3, 0, 0, 2, 3)


def test_junk_goes_and_clean_documents_stay(spark):
    rows = [(i, plain(i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$$$" for w in plain(i).split(" ")), "en", "s1") for i in range(30)]
    rows += [(2000, None, "en", "s1"), (2001, "", None, None), (2002, "a b", "en", "s0"), (None, plain(5), None, None), (3, plain(3), "en", "s0"), (2003, "w " * 100, "en", "s1")]
    d = docs(spark, rows)
    got = {}
    for x in quality.judged(d, ["doc_id"], Scratch(spark)).collect():
        got.setdefault(x.doc_id, []).append((x.base_failed, x.kept))
    assert all(got[i][0] == (False, True) for i in range(300))
    assert all(got[1000 + i] == [(False, False)] for i in range(30))
    assert all(got[i] == [(True, False)] for i in (2000, 2001, 2002, 2003))
    assert len(got[3]) == 2
    kept = quality.quality_filter(d)
    assert kept.columns == d.columns
    assert kept.count() == 302


def test_sketches_merge(spark):
    rows = [(i, plain(i), "en", f"s{i % 3}") for i in range(90)]
    f = quality.with_features(docs(spark, rows), ["lang", "source"])
    f = f.withColumns(quality.feature_columns(f["_f"]))
    whole = {tuple(x) for x in quality.quantiles(quality.sketch(f, ["word_length"]), ["lang"]).collect()}
    parts = quality.sketch(f.where("source = 's0'"), ["word_length"]).unionByName(quality.sketch(f.where("source <> 's0'"), ["word_length"]))
    assert whole == {tuple(x) for x in quality.quantiles(parts, ["lang"]).collect()}


def test_empty(spark):
    d = docs(spark, [])
    assert quality.judged(d, ["doc_id"], Scratch(spark)).count() == 0
    assert quality.quality_filter(d).count() == 0


def test_sources_of_different_spread_get_different_fences(spark):
    """Two sources with one median: words of nearly one length in s0, of widely different lengths in s1."""
    r = random.Random(1)
    rows = []
    for i in range(400):
        n = 60 + 5 * r.random() if i % 2 else r.choice((42, 50, 58, 61, 64, 72, 80))
        rows.append((i, " ".join("w" * max(1, round(n / 10 + r.uniform(-0.5, 0.5))) for _ in range(200)), "en", f"s{i % 2}"))
    f = quality.with_features(docs(spark, rows), ["lang", "source"])
    f = f.withColumns(quality.feature_columns(f["_f"]))
    t = {(x.source, x.feature): x for x in quality.thresholds(quality.sketch(f, list(quality.FEATURES))).collect()}
    wide, close = t["s0", "word_length"], t["s1", "word_length"]
    assert wide.high - wide.low > 1.5 * (close.high - close.low)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_fences_come_from_the_sketches(spark, sf):
    """No fence of the given tables is decided by the least spread, and fences differ between groups."""
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    f = quality.with_features(d, ["lang", "source"])
    f = f.withColumns(quality.feature_columns(f["_f"])).where(~quality.base_failed(f["_f"]))
    t = quality.thresholds(quality.sketch(f, list(quality.FEATURES))).collect()
    assert not [x for x in t if x.spread <= 0]
    assert all(len({x.high for x in t if x.feature == k}) > 10 for k in quality.FEATURES)


def prose(r, n=200):
    """Sentences of plain words, some of them said twice, and now and then a line that comes again."""
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)]
    if r.random() < 0.3:
        words[50 : 50 + 4] = words[10:14]
    lines = [" ".join(words[i : i + 10]) + r.choice([".", ",", "!", ", so.", ""]) for i in range(0, n, 10)]
    if r.random() < 0.3:
        lines[r.randrange(1, len(lines))] = lines[0]
    return "\n".join(lines)


def test_every_rule_rejects_its_own_junk(spark):
    """Junk of one kind each among clean documents: long words, signs, words said again, lines that come again."""
    r = random.Random(3)
    rows = [(i, prose(r), "en" if i % 2 else "de", f"s{i % 4}") for i in range(600)]

    def word(least=2, most=8):
        return "".join(r.choice("abcdefghij") for _ in range(r.randint(least, most)))

    def again():
        w = [word() for _ in range(110)]
        return ", ".join(w + w[:46] + [word() for _ in range(50)])

    def lined():
        lines = [word(5) + r.choice(",. ") for _ in range(60)]
        return "\n".join(lines + r.sample(lines, 50))  # no three of them in the same order

    def long():
        return ", ".join(word(14, 20) for _ in range(120))

    def signs():
        return prose(r).replace(" ", " ~^ ")

    kinds = {"word_length": long, "signs": signs, "repeats": again, "dup_lines": lined}
    junk = {k: range(1000 * n, 1000 * n + 5) for n, k in enumerate(kinds, 1)}
    for n, make in enumerate(kinds.values(), 1):
        rows += [(1000 * n + i, make(), "en", "s1") for i in range(5)]
    out = {x.doc_id: x for x in quality.judged(docs(spark, rows), ["doc_id"], Scratch(spark)).collect()}
    assert all(out[i].kept for i in range(600))
    f = quality.with_features(docs(spark, rows), ["doc_id", "lang", "source"])
    f = f.withColumns(quality.feature_columns(f["_f"]))
    high = {(t.lang, t.source, t.feature): t.high for t in quality.thresholds(quality.sketch(f.where(~quality.base_failed(f["_f"])), list(kinds))).collect()}
    value = {x.doc_id: x for x in f.collect()}
    for k, ids in junk.items():
        for i in ids:
            assert not out[i].base_failed and not out[i].kept, (k, i)
            assert value[i][k] > high["en", "s1", k], (k, i, value[i][k])


def test_ties_long_texts_and_clashing_columns(spark):
    """A value at the fence is inside; a text of a megabyte is counted whole; feature names may be columns."""
    rows = [(i, plain(i), "en", "s") for i in range(60)] + [(100, " ".join(plain(k) for k in range(1500)), "en", "s")]
    d = docs(spark, rows).withColumnRenamed("kept", "word_length")
    kept = quality.quality_filter(d)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, *_ in rows}
    out = {x.doc_id: x["_f"] for x in quality.judged(d, ["doc_id"], Scratch(spark)).collect()}
    assert out[100].n_words == 180_000
