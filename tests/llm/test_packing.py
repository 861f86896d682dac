"""Packing: every token in exactly one place, no window over its size, little room unused."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.packing import deal, fill, pack, packed, tokenizer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200))
def test_fill(sizes):
    sizes = np.array(sizes, np.int64)
    place, offset, context, begins = fill(sizes, (8, 16, 32, 64))
    used, spans = {}, {}
    for s, w, o, c, b in zip(sizes, place, offset, context, begins):
        assert b <= o and o + s <= b + c and (s <= 8 or c >= s)
        spans.setdefault((w, b), set()).add(c)
        for x in range(o, o + s):
            assert x < 64 and (w, x) not in used
            used[w, x] = True
    assert all(len(x) == 1 for (w, b), x in spans.items() if any(w == v and b == y and s > 8 for s, v, y in zip(sizes, place, begins)))
    if len(sizes):
        # Best fit: no two windows are at most half full.
        room = np.bincount(place, weights=sizes, minlength=place.max() + 1)
        assert (room <= 32).sum() <= 1


def test_tiers_matter():
    """With tiers short texts share short contexts, so that less is attended to, at about the same use of room."""
    sizes = np.minimum(np.random.default_rng(1).lognormal(5, 1.1, 20_000).astype(np.int64) + 1, 2048)
    told = {}
    for tiers in ((2048,), (128, 256, 512, 1024, 2048)):
        place, offset, context, begins = fill(sizes, tiers)
        use = np.bincount(np.unique(np.stack([place, begins]), axis=1, return_inverse=True)[1], weights=sizes)
        told[len(tiers)] = (place.max() + 1, (use**2).sum(), len({*zip(place, offset)}))
    best = -(-sizes.sum() // 2048)
    assert told[1][0] <= best * 1.005 and told[5][0] <= best * 1.01 and told[5][1] < 0.7 * told[1][1]


def test_deal(spark):
    cost = np.minimum(np.random.default_rng(0).lognormal(sigma=0.5, size=5000), 2.5)  # a window's cost has a ceiling
    df = spark.createDataFrame([(i, float(c)) for i, c in enumerate(cost)], "sequence bigint, cost double").repartition(7)
    got = deal(df, 50).collect()
    by, n = np.zeros(100), np.zeros(100)
    for r in got:
        by[r["step"]] += cost[r["sequence"]]
        n[r["step"]] += 1
    assert len({r["sequence"] for r in got}) == 5000 and n.max() == n.min() == 50 and by.max() / by.min() < 1.01
    assert deal(df.limit(0)).count() == 0


def test_pack(spark):
    sizes = [(i, n) for i, n in enumerate([0, 1, 2048, 2049, 5000, 100, None, -3])] + [(5, 100), (None, 7)] + [(100 + i, 10 + i % 700) for i in range(3000)]
    df = spark.createDataFrame([(i, n, 0, 0) for i, n in sizes], "doc_id bigint, n_tokens bigint, part int, row int")
    got = pack(df, group=500).collect()
    whole = {}
    for r in got:
        n = r["token_to"] - r["token_from"]
        assert 0 <= n <= 2048 and 0 <= r["start"] and r["start"] + n <= 2048 and r["tier"] >= n
        whole.setdefault(r["doc_id"], []).append((r["token_from"], r["token_to"]))
    assert sorted(whole[4]) == [(0, 2048), (2048, 4096), (4096, 5000)] and sorted(whole[3]) == [(0, 2048), (2048, 2049)]
    assert sorted(whole[5]) == [(0, 100), (0, 100)] and whole[None] == [(0, 7)] and whole[0] == whole[6] == whole[7] == [(0, 0)]
    assert len(got) == len(sizes) + 3
    places = {}
    for r in got:
        for x in range(r["start"], r["start"] + r["token_to"] - r["token_from"]):
            assert (r["sequence"], x) not in places
            places[r["sequence"], x] = 1
    assert len(places) / (len({s for s, _ in places}) * 2048) > 0.95
    assert pack(df.limit(0)).count() == 0


def test_packed_texts(spark):
    t = tokenizer()
    texts = ["", "Hello world!", "naïve 😀 " * 3000, None, "<|endoftext|>", "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n"] for r in packed(df).groupBy("doc_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n")).collect()}
    assert got == {i: len(t.encode_ordinary(x or "")) for i, x in enumerate(texts)}
    assert t.decode(t.encode_ordinary(texts[2])) == texts[2]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_use_on_documents(spark, sf):
    from millrace.llm.queries import p6_use

    assert p6_use(spark, f"/root/testdata/{sf}").first()["used"] > 0.98
