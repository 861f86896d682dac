"""Leak search against brute force, over random and nasty texts."""

import random

import numpy as np
import pytest

from millrace.llm.leaks import build_index, leaked, least_edits, scan
from millrace.llm.text import words


def edits(doc, passage):
    """Sellers' algorithm, plainly."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(passage):
        new = [i + 1]
        for j, x in enumerate(doc):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != w)))
        row = new
    return min(row)


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t or "")
        for e, p in items:
            q = words(p or "")
            n = min(12, len(q))
            if q and (any(w[i : i + n] == q[j : j + n] for i in range(len(w) - n + 1) for j in range(len(q) - n + 1)) or (len(q) >= 8 and edits(w, q) <= len(q) // 8)):
                out.add((d, e))
    return out


def test_words():
    assert words("Café <b>fo​o</b>-BAR­ baz ﬁn １２") == ["cafe", "foo", "bar", "baz", "fin", "12"]
    assert words("") == words("<br/>!?") == [] and words("a < b > c") == ["a", "b", "c"] and words("Straße STRASSE") == ["strasse", "strasse"]


def _texts(seed):
    """(documents, items) of few words, with edits around what is allowed."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 5, 6, 7, 8, 9, 11, 12, 15, 16, 17, 24, 31, 40, 64])))) for i in range(40)]
    docs = []
    for d in range(120):
        noise = lambda: r.choices(vocabulary + [f"n{i}" for i in range(100)], k=r.randrange(0, 20))
        p = words(r.choice(items)[1])
        k = r.random()
        if k < 0.7:
            for _ in range(r.randrange(0, len(p) // 8 + 2)):
                if p:
                    i, kind = r.randrange(len(p)), r.randrange(4)
                    p[i : i + 1] = [["zz"], [], [p[i], "yy"], ["yy", "xx", p[i]]][kind]
        else:
            p = p[r.randrange(0, 3) :][: r.randrange(9, 15)]
        docs.append((d, " ".join(noise() + p + noise())))
    return docs + [(900, ""), (901, "w1 " * 3000)], items


@pytest.mark.parametrize("seed", range(6))
def test_scan_is_brute_force(seed):
    docs, items = _texts(seed)
    index = build_index(items)
    assert set(scan(index, [d for d, _ in docs], [t for _, t in docs])) == brute(docs, items)


def test_least_edits():
    assert least_edits(np.array([9, 1, 2, 4, 9]), np.array([1, 2, 3, 4])) == 1 and least_edits(np.array([], int), np.array([1, 2])) == 2


def test_leaked(spark):
    long = " ".join(f"word{i}" for i in range(30))
    docs = [(1, f"x {long} y"), (1, f"x {long} y"), (2, None), (3, ""), (4, "a b c"), (5, "<i>A</i>, B​! c"), (None, long), (6, "Á b c " * 20_000)]
    items = [(10, long), (10, long), (11, "a b c"), (12, None), (13, ""), (None, "a b c"), (14, "never seen at all")]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, eval_id int")
    e = spark.createDataFrame([(k, p, "t") for k, p in items], "eval_id bigint, passage string, text string")
    want = sorted([(1, 10), (4, 11), (5, 11), (6, 11), (None, 10)], key=repr)
    for most in (5, 200_000):  # joined by seeds, or sent to all tasks
        assert sorted(map(tuple, leaked(d, e, most, bits=20).collect()), key=repr) == want
    assert leaked(d.limit(0), e).count() == 0 and leaked(d, e.limit(0)).count() == 0 and leaked(d.limit(0), e, 5, 20).count() == 0


def test_join_is_brute_force(spark):
    docs, items = _texts(11)
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, passage string")
    assert set(map(tuple, leaked(d, e, 100, bits=21).collect())) == brute(docs, items)
