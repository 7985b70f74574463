import random
from collections import Counter, defaultdict

import pytest
from test_decontam import WORD, low
from test_neardup import by_hand as components_by_hand

import corpus_pipeline
from starloom.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(4000)]
    items = [(i, " ".join(r.choice(words) for _ in range(25))) for i in range(6)]
    rows = []
    for i in range(260):
        t = [r.choice(words) for _ in range(r.randint(20, 300))]
        if i % 20 == 3:
            t[5:5] = items[i % 6][1].split()
        if i % 20 == 7:
            t = [w + "###" for w in t]
        rows.append((i, " ".join(t), ["en", "de"][i % 2], f"s{i % 4}"))
        if i % 10 == 1:
            t[len(t) // 2] = "changed"
            rows.append((1000 + i, " ".join(t), "en", f"s{(i + 1) % 4}"))
        if i % 10 == 2:
            rows.append((2000 + i, " ".join(t), "en", "s1"))
    rows += [(3000, None, "en", "s1"), (3001, "", None, None)]
    return rows, items


def quality_by_hand(rows):
    feats, base = {}, {}
    for d, t, lang, source in rows:
        n, chars, _, dup, repeats, lines, signs = quality.base_features(t)
        base[d] = n < 50 or 100 * repeats > 50 * n
        per = lambda a, b: 1000 * a // b if b else 0
        feats[d] = {"word_length": per(chars, n), "signs": per(signs, n), "repeats": per(repeats, n), "dup_lines": per(dup, lines)}

    def bucket(v):
        k = max(0, v.bit_length() - 8)
        return v >> k << k

    def quantiles(values):
        v = sorted(map(bucket, values))
        return len(v), *[next(x for i, x in enumerate(v) if 100 * (i + 1) >= k * len(v)) for k in (25, 50, 90)]

    groups = {k: defaultdict(list) for k in ("all", "lang", "own")}
    for d, _, lang, source in rows:
        if not base[d]:
            for name, key in (("all", ()), ("lang", lang), ("own", (lang, source))):
                for f, v in feats[d].items():
                    if v or not quality.FEATURES[f]["some"]:
                        groups[name][key, f].append(v)
    kept = []
    for d, t, lang, source in rows:
        if base[d]:
            continue
        ok = True
        for f, rule in quality.FEATURES.items():
            if not groups["own"][(lang, source), f]:
                continue  # no document of the group has any of the feature
            _, *q = quantiles(groups["all"][(), f])
            for name, key in (("lang", lang), ("own", (lang, source))):
                n, *own = quantiles(groups[name][key, f])
                q = [(n * a + rule["prior"] * b) / (n + rule["prior"]) for a, b in zip(own, q, strict=True)]
            at = dict(zip((25, 50, 90), q, strict=True))
            reach = rule["fence"] * (at[rule["spread"][1]] - at[rule["spread"][0]] or quality.LEAST)
            ok &= feats[d][f] <= q[1] + reach and not (rule["low"] and feats[d][f] < q[1] - reach)
        if ok:
            kept.append((d, t, lang, source))
    return kept


def clean_by_hand(rows, items):
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [WORD.findall(low(t))] for i in range(max(1, len(w) - 9))}
    out = []
    for row in rows:
        w = WORD.findall(low(row[1]))
        if not any(tuple(w[i : i + 10]) in windows for i in range(len(w))):
            out.append(row)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = fixture()
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages_equal_brute_force(spark, folder):
    rows, items = fixture()
    docs = spark.read.parquet(folder + "/documents.parquet")
    want = quality_by_hand(rows)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = docs.cache()
        kept.append(sorted(x.doc_id for x in docs.collect()))
    assert kept[0] == sorted(x[0] for x in want) and len(want) < len(rows)
    least = {d: c for d, _, c in components_by_hand([x[:2] for x in want])}
    want = [x for x in want if least[x[0]] == x[0]]
    assert kept[1] == sorted(x[0] for x in want) and len(kept[1]) < len(kept[0])
    want = clean_by_hand(want, items)
    assert kept[2] == sorted(x[0] for x in want) and len(kept[2]) < len(kept[1])
    mixed = Counter(x.doc_id for x in corpus_pipeline.STAGES[3][1](spark, docs, folder).collect())
    assert set(mixed) <= set(kept[2]) and max(mixed.values()) <= 3
    size = {d: len((t or "").split()) for d, t, _, _ in rows}
    assert abs(sum(size[d] * k for d, k in mixed.items()) / sum(size[d] for d in kept[2]) - 1) < 0.15


def test_run_is_repeatable_and_shards_evenly(spark, folder):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first == again and len(first) > 100
    per = Counter(x[4] for x in first)
    assert len(per) == 40 and max(per.values()) - min(per.values()) <= 1


def test_more_columns_and_odd_rows_pass(spark, tmp_path):
    """Columns named like those that stages make pass through; null ids, repeated rows and a very long text do no harm."""
    rows, items = fixture()
    rows = [x for x in rows if x[0] < 120] + [(None, rows[9][1], "en", "s1"), (None, None, None, None), (9, rows[9][1], "de", "s1"), (9, rows[12][1] + " " + rows[15][1], "de", "s1")]
    rows += [(500, " ".join(t for _, t, *_ in fixture()[0][:250] if t) * 3, "en", "s2")]
    extra = SCHEMA + ", tk long, cls string, kept string, _id long, size string, taken int, shard string, _f int, slot string"
    spark.createDataFrame([(*x, 0, 1, "c", "k", 7, "s", 3, "h", 5, "q") for x in rows], extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) > 40 and len({(x.shard, x.slot) for x in out}) == len(out)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
