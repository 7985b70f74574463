import zlib

import numpy as np
import pytest

from starloom.llm import sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, curve string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 5, "c") for i, t, lang, s in rows], SCHEMA)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3)])
def test_curve_visits_every_cell_once_in_steps_of_one(dims, bits):
    side = 1 << bits
    axes = [a.ravel() for a in np.meshgrid(*[np.arange(side)] * dims, indexing="ij")]
    index = sharding.hilbert_index(axes, bits)
    order = np.argsort(index)
    assert sorted(index) == list(range(side**dims))
    points = np.stack(axes, axis=1)[order]
    assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_law_and_slots(spark, law):
    rows = [(i, "é" * (i * 37 % 400), ["en", "de", None][i % 3], f"s{i % 4}") for i in range(700)]
    rows += [(None, None, None, None), (50_005, "same", "en", "s1"), (50_005, "same", "en", "s1")] + [(10_000 + i, "hot", "en", "s0") for i in range(900)]
    got = sharding.shard_documents(docs(spark, rows), 40, law=law).collect()
    assert len(got) == len(rows)
    slots, sizes = {}, {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
        sizes[x.shard] = sizes.get(x.shard, 0) + x["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(40))
    if law == "rows":
        counts = [len(slots.get(s, [])) for s in range(40)]
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(x["size"] for x in got)
    text = {i: t for i, t, *_ in rows if i is not None}
    for x in got:
        if x.doc_id in text:
            b = (text[x.doc_id] or "").encode()
            assert x["size"] == len(b) + 16 and x.text_crc32 == zlib.crc32(b)
    assert len({(x.shard, x.slot) for x in got}) == len(rows)


def test_shards_are_narrow_in_their_dimensions(spark):
    rows = [(i, "x" * (i % 97), f"l{i % 4}", f"s{i % 8}") for i in range(4000)]
    got = sharding.shard_documents(docs(spark, rows), 40).collect()
    by = {}
    for x in got:
        by.setdefault(x.shard, set()).add((x.doc_id % 4, x.doc_id % 8))
    assert sum(map(len, by.values())) / len(by) < 6  # of 8 (language, source) pairs


def test_empty(spark):
    assert sharding.shard_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_places_by_hand(spark, law):
    """Every row's shard and slot from a plain sort; sources differ only behind their seventh byte; rows repeat."""
    rows = [(i % 400, "t" * (i * 31 % 150), ["english-a", "english-b", None][i % 3], f"a-long-source-{i % 5}") for i in range(600)]
    rows += [(7, "same", "english-a", "a-long-source-1")] * 40 + [(None, None, None, None)] * 9 + [(8, "x" * 100_000, "english-b", "z")]

    slim = []
    for i, t, lang, source in rows:
        b = (t or "").encode()
        size = len(b) + 16
        shift = max(0, size.bit_length() - 7)
        slim.append((i, size, zlib.crc32(b), (lang is not None, lang or ""), (source is not None, source or ""), size >> shift << shift))
    axes = []
    for d in (3, 4, 5):
        values = sorted(x[d] for x in slim)
        bins = {}
        for v in set(values):
            n = values.count(v)
            bins[v] = min(15, int((values.index(v) + n - n / 2) / len(values) * 16))
        axes.append(np.array([bins[x[d]] for x in slim]))
    curve = sharding.hilbert_index(axes)
    order = sorted(range(len(slim)), key=lambda k: (curve[k], slim[k][2], slim[k][0] is not None, slim[k][0] or 0, slim[k][1]))
    total, upto, want, used = sum(x[1] for x in slim), 0, [], {}
    for rank, k in enumerate(order):
        i, size, crc = slim[k][:3]
        shard = rank * 40 // len(slim) if law == "rows" else min(39, int((upto + size / 2) * 40 / total))
        upto += size
        want.append((i, size, crc, shard, used.setdefault(shard, 0)))
        used[shard] += 1
    got = [(x.doc_id, x["size"], x.text_crc32, x.shard, x.slot) for x in sharding.shard_documents(docs(spark, rows), 40, law=law).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
