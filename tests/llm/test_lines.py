import hashlib
import random

import numpy as np
import pytest

from starloom.llm import lines

SCHEMA = "doc_id bigint, text string, lang string, source string, n_lines string, digests string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], SCHEMA)


def by_hand(rows, least, first=False):
    """Loops over whole texts; white space and case as the contract has them."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen, best = {}, {}
    for r, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            seen.setdefault(k, set()).add(r)
            rank = (i is None, i or 0, hashlib.blake2b((t or "").encode(), digest_size=16).digest())
            best[k] = min(best.get(k, rank), rank)
    out = []
    for i, t in rows:
        rank = (i is None, i or 0, hashlib.blake2b((t or "").encode(), digest_size=16).digest())
        kept, done = [], set()
        for x in (t or "").split("\n"):
            k = key(x)
            if not k or len(seen[k]) < least or (first and best[k] == rank and k not in done):
                kept.append(x)
            done.add(k)
        n = len((t or "").split("\n"))
        out.append((str(i), "\n".join(kept) if t is not None else None, n, n - len(kept)))
    return sorted(out, key=repr)


def odd_rows():
    r = random.Random(4)
    common = ["All rights reserved.", "  all RIGHTS reserved.\t", "ALL RIGHTS RESERVED.\r", "Été à la une", "ÉTÉ À LA UNE", "\x85x", "x", "", "   ", "a b", "a  b"]
    rows = [(i % 31, "\n".join(r.choice(common) if r.random() < 0.4 else f"line {r.randrange(400)}" for _ in range(r.randint(0, 12)))) for i in range(120)]
    rows += [(None, "x\nx\nA B"), (None, "x\nx\nA B"), (7, None), (8, ""), (9, "\n"), (9, "\n"), (10, "x" * 2_000_000 + "\nx\n" + "y\n" * 200_000 + "end"), (11, "y"), (12, "\n".join(f"line {k}" for k in range(30_000)))]
    return rows


@pytest.mark.parametrize(("least", "keep", "limit"), [(10, "none", 200_000), (2, "none", 0), (2, "first", 200_000), (10, "first", 0)])
def test_kept_lines_equal_loops(spark, least, keep, limit):
    rows = odd_rows()
    got = lines.deduplicated_lines(docs(spark, rows).repartition(7), least, keep, limit).collect()
    assert sorted(((str(x.doc_id), x.text, x.n_lines, x.n_dropped) for x in got), key=repr) == by_hand(rows, least, keep == "first")


def test_small_chunks_and_crowded_filters_change_nothing(spark, monkeypatch):
    """Filters that suspect nearly everything and chunks of a few keys give the same rows."""
    monkeypatch.setattr(lines, "CHUNK_KEYS", 5)
    rows = odd_rows()[:120]
    crowded = lines._answers
    monkeypatch.setattr(lines, "_answers", lambda sent, bits: crowded(sent, 16))
    got = lines.deduplicated_lines(docs(spark, rows).coalesce(1), 3).collect()
    assert sorted(((str(x.doc_id), x.text, x.n_lines, x.n_dropped) for x in got), key=repr) == by_hand(rows, 3)


@pytest.mark.parametrize("seed", range(5))
def test_filters_miss_no_repeat_and_suspect_little(seed):
    r = np.random.default_rng(seed)
    rows = [(m := np.unique(r.integers(0, 1 << 32, 3000, dtype=np.uint32)), r.random(len(m)) < 0.01) for _ in range(10)]
    rows += [(np.unique(np.concatenate((rows[0][0][:50], rows[3][0][:50]))), np.zeros(100, bool))]
    seen = {}
    for marks, many in rows:
        for m, f in zip(marks.tolist(), many.tolist(), strict=True):
            seen[m] = seen.get(m, 0) + 1 + f
    flags = lines.repeats(rows, 1 << 19)
    false = 0
    for (marks, _), flag in zip(rows, flags, strict=True):
        for m, f in zip(marks.tolist(), flag.tolist(), strict=True):
            assert f or seen[m] == 1
            false += f and seen[m] == 1
    assert false < 0.02 * sum(len(m) for m, _ in rows)


def test_chunks_are_not_shuffled(spark):
    scratch = lines.Scratch(spark)
    plans = []
    suspects = lines._suspects
    lines._suspects = lambda *a: plans.append(x := suspects(*a)) or x
    try:
        lines.repeated_keys(docs(spark, odd_rows()), scratch)
    finally:
        lines._suspects = suspects
    plan = plans[0]._jdf.queryExecution().simpleString()
    chunks = [x for x in plan.splitlines() if "digests" in x and "Exchange" in x]
    assert not chunks, plan


def test_bad_parameters_and_empty(spark):
    d = docs(spark, [])
    assert lines.deduplicated_lines(d).count() == 0
    with pytest.raises(ValueError, match="two documents"):
        lines.deduplicated_lines(d, 1)
    with pytest.raises(ValueError, match="none"):
        lines.deduplicated_lines(d, 2, "last")
