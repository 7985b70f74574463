import re

from starloom.llm import decontam
from starloom.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def by_hand(rows, items):
    windows = []
    for item, t in items:
        w = WORD.findall(low(t))
        windows += [(str(item) if item is not None else None, tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9)) if w]
    out = []
    for d, t in rows:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        out.append((str(d), len(w), len(hit), sorted(found - {None})))
    return sorted(out)


def test_hits_equal_brute_force(spark):
    passage = "The quick Brown fox jumps over the lazy dog and then it Éats eleven small green apples again"
    items = [(1, passage), (2, "Short item!"), (3, None), (4, "..."), (10, passage.lower()), (None, "one two three"), (5, "ha ha ha ha ha ha ha ha ha ha ha ha")]
    rows = [
        (1, "x y z " + passage + " tail"), (2, "the-quick brown_fox JUMPS over; the lazy dog and then"), (3, "short, ITEM and short item"), (4, None), (5, ""), (6, "...!"),
        (7, "the quick brown fox jumps over the lazy cat and then it éats"), (8, "ha " * 25), (None, "one two three"), (9, "one two"), (2, "short item"), (2, "short item"),
        (11, "the quick brown fox jumps over the lazy dog and then it éats eleven " * 3), (12, "word " * 3000 + passage),
    ]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA)
    b = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, doc_id string")
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, list(x["items"])) for x in decontam.contamination(d, b, Scratch(spark)).collect())
    assert got == by_hand(rows, items)
    kept = decontam.decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["4", "5", "6", "7", "9"]


def test_clean_documents_stay_beside_a_contaminated_one_of_their_id(spark):
    rows = [(None, "one two three"), (None, "clean"), (None, None), (1, "so one two three"), (1, "clean too"), (1, None), (2, "one, Two three!")]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA)
    b = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    got = sorted((str(x.doc_id), str(x.text)) for x in decontam.decontaminated(d, b).collect())
    assert got == [("1", "None"), ("1", "clean too"), ("None", "None"), ("None", "clean")]


def test_a_bitmap_that_is_full_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BITS", 64)
    d = spark.createDataFrame([(1, "a b c d"), (2, "c d e f")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b"), (2, "e f"), (3, "d e")], "item_id bigint, text string")
    got = sorted((x.doc_id, x.n_hit, list(x["items"])) for x in decontam.contamination(d, b, Scratch(spark)).collect())
    assert got == [(1, 2, ["1"]), (2, 3, ["2", "3"])]


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    b = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert decontam.contamination(d, b, Scratch(spark)).count() == 0
    assert [tuple(x)[1:3] for x in decontam.contamination(one, b, Scratch(spark)).collect()] == [(3, 0)]


def test_the_bitmap_is_a_literal_of_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    w = spark.createDataFrame([("a",), ("b",)], "token string")
    plan = d.select(decontam._in_bitmap(w)(d.text))._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit([0,0,0,528384][" in plan
