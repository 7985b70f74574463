"""Quality rules whose thresholds come from the corpus: mergeable quantile sketches per language and source.

Per document a few integer features are counted over its whole text. A sketch of a feature is its histogram over
buckets of 8 leading bits (relative error below 1 %), so sketches of parts add up to the sketch of the whole, in any
order, and nothing depends on how rows were dealt. A (language, source) group's quantiles are drawn towards those of its
language, and these towards those of all documents, in proportion to the feature's prior number of documents; a
document outside q50 - reach .. q50 + reach, with reach = fence * spread, is rejected. The spread is a distance of two
quantiles of the sketch: of the lower quartile and the median where every document has some of the feature (junk lies high, so these fences
hold while less than half of a group is junk). Repeats are zero for most documents; their sketches are of the documents that
have any, and the spread is from the median of these to their 90th percentile, which junk reaches only if it is a tenth of
them. A feature that no document has rejects none; one that has no spread in any sketch, all values being alike, is credited with LEAST.

Sketches hold only documents that pass the base rule, so that stubs don't bend the thresholds.

Defined results: a null or empty text has no words and fails the base rule; null language or source is a group of its
own; repeated rows count as often as they occur; a value equal to a fence is inside; very long texts are counted whole, in
the worker that reads them; columns of docs may have any names, those of the features too; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast, table
from .hashing import pieces

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Signs: ASCII punctuation of all kinds, symbols among it. Clean text has some, so their number has a spread.
SIGNS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_SIGNS = re.compile(SIGNS)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The least spread (per thousand), where all values are alike.
LEAST = 4
#: Features per thousand words (dup_lines: thousand lines): quantiles (percent) whose distance is the spread, how many spreads
#: from the median are inside, documents that the wider group counts for, whether values below the fence are rejected too, and
#: whether only documents that have any of the feature are sketched.
FEATURES = {
    "word_length": {"spread": (25, 50), "fence": 16, "prior": 50, "low": True, "some": False},
    "signs": {"spread": (25, 50), "fence": 20, "prior": 1000, "low": False, "some": False},
    "repeats": {"spread": (50, 90), "fence": 5, "prior": 1000, "low": False, "some": True},
    "dup_lines": {"spread": (50, 90), "fence": 2, "prior": 1000, "low": False, "some": True},
}
QUANTILES = (25, 50, 90)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_signs long"


def base_features(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """The counts named in BASE for one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        upto = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, len(lines), len(_SIGNS.findall(text))


def with_features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and, in one struct ``_f``, the counts of BASE."""
    names = [x.split()[0] for x in BASE.split(", ")]
    schema = docs.select(*columns).withColumn("_f", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':') for x in BASE.split(', '))}>")).schema
    source = docs.select(*columns, F.col("text").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, pa.int64()) for n in names])
        for batch in batches:
            rows = [base_features(t and t.decode()) for _, texts in pieces(batch.column(batch.num_columns - 1)) for t in texts]
            values = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            found = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*columns, "_f"])

    return source.mapInArrow(count, schema)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def feature_columns(f: Column) -> dict[str, Column]:
    """Integer features of a document with words, by name."""
    per = lambda part, whole: F.when(whole > 0, F.floor(1000 * part / whole)).otherwise(0).cast("long")
    return {
        "word_length": per(f["word_chars"], f["n_words"]),
        "signs": per(f["n_signs"], f["n_words"]),
        "repeats": per(f["n_repeat_words"], f["n_words"]),
        "dup_lines": per(f["n_dup_lines"], f["n_lines"]),
    }


def bucket(value: Column) -> Column:
    """The sketch's bucket: the value with all but its 8 leading bits cleared."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(value)) - 8)).cast("long")
    return (value - F.pmod(value, step)).cast("long")


def sketch(featured: DataFrame, names: list[str]) -> DataFrame:
    """lang, source, feature, bucket, n: mergeable by adding ``n``; zeros of features that most documents haven't are left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), bucket(F.col(n)).alias("bucket")) for n in names]))
    told = featured.select("lang", "source", cells.alias("c")).where((F.col("c.bucket") > 0) | ~F.col("c.feature").isin([k for k, v in FEATURES.items() if v["some"]]))
    return told.groupBy("lang", "source", "c.feature", "c.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, feature, n, q25, q50, q90 of merged sketches: the least bucket that holds the rank."""
    merged = cells.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "feature")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    ranked = merged.withColumn("upto", upto).withColumn("total", F.sum("n").over(group))
    least = [F.min(F.when(100 * F.col("upto") >= k * F.col("total"), F.col("bucket"))).cast("double").alias(f"q{k}") for k in QUANTILES]
    return ranked.groupBy(*by, "feature").agg(F.max("total").cast("double").alias("n"), *least)


def _of_feature(value) -> Column:
    """``value(rule)`` of the row's feature."""
    return F.coalesce(*[F.when(F.col("feature") == k, value(v)) for k, v in FEATURES.items()])


def thresholds(cells: DataFrame) -> DataFrame:
    """lang, source, feature, spread, low, high: fences from the group's quantiles drawn towards its language's and all documents'."""
    prior = _of_feature(lambda v: F.lit(float(v["prior"])))
    drawn = lambda q, wider: ((F.col("n") * F.col(q) + prior * F.col(wider)) / (F.col("n") + prior)).alias(q)
    names = [f"q{k}" for k in QUANTILES]
    alls = quantiles(cells, []).select("feature", *[F.col(q).alias(f"_{q}") for q in names])
    langs = quantiles(cells, ["lang"]).join(F.broadcast(alls), "feature").select("lang", "feature", *[drawn(q, f"_{q}") for q in names])
    langs = langs.select(F.col("lang").alias("_l"), F.col("feature").alias("_f"), *[F.col(q).alias(f"_{q}") for q in names])
    own = quantiles(cells, ["lang", "source"])
    both = own.join(langs, own.lang.eqNullSafe(langs["_l"]) & (own.feature == langs["_f"])).select("lang", "source", "feature", *[drawn(q, f"_{q}") for q in names])
    both = both.withColumn("spread", _of_feature(lambda v: F.col(f"q{v['spread'][1]}") - F.col(f"q{v['spread'][0]}")))
    reach = _of_feature(lambda v: F.lit(v["fence"])) * F.when(F.col("spread") > 0, F.col("spread")).otherwise(LEAST)
    low = _of_feature(lambda v: F.lit(v["low"]))
    return both.select("lang", "source", "feature", "spread", F.when(low, F.col("q50") - reach).alias("low"), (F.col("q50") + reach).alias("high"))


def _fences(cells: DataFrame) -> DataFrame:
    """One row for each (lang, source) with the fences of all features."""
    t = thresholds(cells)
    pick = lambda k, c: F.max(F.when(F.col("feature") == k, F.col(c)))
    return t.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        *[pick(k, c).alias(f"_{c}_{k}") for k in FEATURES for c in ("low", "high")]
    )


def _outside() -> Column:
    bad = F.lit(False)
    for k, v in FEATURES.items():
        bad = bad | F.coalesce(F.col(k) > F.col(f"_high_{k}"), F.lit(False))
        if v["low"]:
            bad = bad | F.coalesce(F.col(k) < F.col(f"_low_{k}"), F.lit(False))
    return bad


def judged(docs: DataFrame, columns: list[str], scratch: Scratch, fences: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``docs`` with ``_f``, ``base_failed`` and ``kept``; the fences are learnt here unless given."""
    wanted = [*columns, *[c for c in ("lang", "source") if c not in columns]]
    f = F.col("_f")
    featured = with_features(docs, wanted).withColumns(feature_columns(f)).withColumn("base_failed", base_failed(f))
    if fences is None:
        featured = scratch.keep(featured, "features")
        fences = learnt_fences(featured, scratch)
    joined = featured.join(
        sized_broadcast(fences), featured.lang.eqNullSafe(fences["_lang"]) & featured.source.eqNullSafe(fences["_source"]), "left"
    )
    return joined.withColumn("kept", ~F.col("base_failed") & ~_outside()).select(*columns, "_f", "base_failed", "kept")


def learnt_fences(featured: DataFrame, scratch: Scratch) -> DataFrame:
    cells = scratch.keep(sketch(featured.where("not base_failed"), list(FEATURES)), "sketch")
    return scratch.keep(_fences(cells), "fences")


def quality_filter(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that a rule rejects; all columns stay as they are.

    Two passes over the texts (sketches, then verdicts), so that no text is shuffled or joined by id.
    """
    scratch = Scratch(docs.sparkSession)
    f = F.col("_f")
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], *[F.col(c) for c in ("lang", "source", "text")])
    featured = with_features(renamed, ["lang", "source"]).withColumns(feature_columns(f)).withColumn("base_failed", base_failed(f))
    fences = learnt_fences(featured, scratch)
    own = [f"c{i}" for i in range(len(docs.columns))]
    return judged(renamed, [*own, "lang", "source"], scratch, fences).where("kept").select(
        *[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)]
    )


def op3_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judged(docs, ["doc_id"], Scratch(spark))
    return out.select(
        "doc_id", *[F.col("_f")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept"
    )


def _oracle() -> str:
    feats = "union all ".join(
        f"select lang, source, '{k}' as feature, {k} as v from f where not base_failed {f'and {k} > 0 ' if v['some'] else ''}" for k, v in FEATURES.items()
    )
    case = lambda value: "case feature " + " ".join(f"when '{k}' then {value(v)}" for k, v in FEATURES.items()) + " end"
    prior = case(lambda v: v["prior"]) + "::double"
    spread = case(lambda v: f"q{v['spread'][1]} - q{v['spread'][0]}")
    high = " or ".join(f"coalesce({k} > (select max(high) from t where t.feature = '{k}' and t.lang is not distinct from f.lang and t.source is not distinct from f.source), false)" for k in FEATURES)
    low = " or ".join(f"coalesce({k} < (select max(low) from t where t.feature = '{k}' and t.lang is not distinct from f.lang and t.source is not distinct from f.source), false)" for k, v in FEATURES.items() if v["low"])

    def quant(name: str, by: list[str]) -> str:
        keys = ", ".join([*by, "feature"])
        found = ", ".join(f"min(case when 100 * upto >= {k} * total then bucket end)::double as q{k}" for k in QUANTILES)
        return f"""{name} as (select {keys}, max(total)::double as n, {found}
            from (select {keys}, bucket, sum(n) over (partition by {keys} order by bucket) as upto, sum(n) over (partition by {keys}) as total
                  from (select {keys}, bucket, sum(n) as n from cells group by {keys}, bucket)) group by {keys})"""

    def drawn(name: str, inner: str, wider: str, keys: str, on: str) -> str:
        cols = ", ".join(f"(i.n * i.q{k} + i.prior * o.q{k}) / (i.n + i.prior) as q{k}" for k in QUANTILES)
        return f"{name} as (select {keys}, i.feature, {cols} from (select *, {prior} as prior from {inner}) i join {wider} o on i.feature = o.feature{on})"

    return f"""
with w as (
  select doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
g as (
  select *, len(words) as n_words,
    case when len(words) < 3 then [] else list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2])) end as tri
  from w),
pos as (select doc_id, unnest(tri) as t, unnest(range(len(tri))) as i from g),
rep as (select doc_id, i, count(*) over (partition by doc_id, t) as c from pos),
hit as (select doc_id, count(distinct p) as n_repeat from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep where c > 1) group by doc_id),
b as (
  select g.doc_id, lang, source, n_words::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
    len(regexp_extract_all(coalesce(text, ''), '{SIGNS}'))::bigint as n_signs
  from g left join hit using (doc_id)),
f as (
  select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed,
    coalesce(1000 * word_chars // nullif(n_words, 0), 0) as word_length, coalesce(1000 * n_signs // nullif(n_words, 0), 0) as signs,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) as repeats, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) as dup_lines
  from b),
v as ({feats}),
cells as (select lang, source, feature, v - v % (2 ** greatest(0, length(ltrim(bin(v), '0')) - 8))::bigint as bucket, count(*) as n from v group by all),
{quant("own", ["lang", "source"])}, {quant("langs", ["lang"])}, {quant("alls", [])},
{drawn("l", "langs", "alls", "i.lang", "")},
{drawn("d", "own", "l", "i.lang, i.source", " and i.lang is not distinct from o.lang")},
r as (select *, {spread} as spread from d),
e as (select *, {case(lambda v: v["fence"])} * case when spread > 0 then spread else {LEAST} end as reach from r),
t as (select lang, source, feature, q50 - reach as low, q50 + reach as high from e)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({high} or {low}) as kept
from f"""


ORACLE_SQL = _oracle()
