"""Ranked search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidebars.llm import lexical_search as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def expected(rows, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, t in items:
        scores = []
        for i, c, size in docs:
            m = 100 - 75 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(t) if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        best = sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top]
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table(make):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    pick = lambda: words[min(rng.randrange(400), rng.randrange(400))]
    rows = [(n, " ".join(pick() for _ in range(rng.randint(0, 80)))) for n in range(300)]
    rows += [(400 + n, rows[5][1]) for n in range(40)] + [(None, rows[7][1]), (900, rows[9][1].upper()), (901, rows[9][1] + " é日本 x"), (902, " ".join(pick() for _ in range(20000)))]
    items = [(n, " ".join(pick() for _ in range(rng.randint(1, 30)))) for n in range(12)]
    items += [(50, rows[5][1]), (51, rows[7][1]), (52, rows[9][1]), (53, None), (54, "  ,"), (55, "qqq rrr"), (56, "É é 日本 " + words[0]), (None, words[1]), (57, f"{words[0]} {words[0]} {words[3]}")]
    return rows, items


@pytest.mark.parametrize("options", [{}, {"bits": 3}, {"block_bytes": 200}, {"top": 3}])
def test_best_documents(spark, make, table, options):
    rows, items = table
    got = ls.ranked(make(rows), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, items, options.get("top", 10))


def test_odd_documents(spark, make, odd):
    items = [(1, odd[3][1]), (2, "short one line"), ("x", "b c a")][:2]
    got = ls.ranked(make(odd), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = expected(odd, items)
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_tables(spark, make, table):
    rows, items = table
    items = spark.createDataFrame(items, "item_id long, text string")
    assert ls.ranked(make([]), items).count() == 0
    assert ls.ranked(make(rows[:20]), items.limit(0)).count() == 0
    assert ls.ranked(make([(1, None)]), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_spare_work(table):
    """No bound is below its score, and few documents are scored."""
    rows, items = table
    texts = [(t or "").encode() for _, t in rows]
    words, owner, hashed, tf = ls.postings(texts)
    q = ls.Queries([t or "" for _, t in items])
    df = np.array([np.count_nonzero(hashed == h) for h in q.terms])
    q.weigh(int(np.count_nonzero(words)), int(words.sum()), df)
    got = ls.impact(tf, ls.length_part(words, q.n, q.total)[owner])
    table_ = ls.sketches(len(texts), owner, hashed, got)
    bound = table_[:, q.used].astype(np.int64) @ q.matrix.astype(np.int64) * ls.LEVEL
    exact = np.zeros_like(bound)
    for k, (of, w) in enumerate(zip(q.of, q.weights, strict=True)):
        for t, x in zip(of, w, strict=True):
            at = hashed == q.terms[t]
            exact[owner[at], k] += x * got[at]
    assert (bound >= exact).all()
    search = ls.Search(q, 10)
    search.read(texts, np.arange(len(texts)))
    assert search.scored < 0.5 * np.count_nonzero(exact)


def test_slices_without_any_term_of_an_item(spark, make, table):
    """Documents alone in their tasks that share coordinates with items, but no term."""
    rows, items = table
    rows = [(n, f"zzq{n} " * (n % 7 + 1)) for n in range(40)] + rows[:30]
    docs = make(rows).repartitionByRange(len(rows), "doc_id")
    got = ls.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), bits=2).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, items)
    q = ls.Queries(["aaa bbb"]).weigh(10, 100, np.array([1, 1]), 0)
    search = ls.Search(q, 10)
    for k, t in enumerate([b"ccc", b"", b"aaa x", b"ccc"]):
        search.read([t], np.array([k]))
    assert [x.tolist() for x in search.id] == [[2]]


def test_short_documents_in_lots(table, monkeypatch):
    rows, items = table
    texts = [(t or "").encode() for _, t in rows]
    q = ls.Queries([t or "" for _, t in items])
    q.weigh(300, 12000, np.full(len(q.terms), 20))
    found = []
    for cells in (ls.CELLS, 7 * len(items)):
        monkeypatch.setattr(ls, "CELLS", cells)
        search = ls.Search(q, 10)
        most = []
        monkeypatch.setattr(search, "_next", lambda bound, f=search._next, most=most: most.append(bound.size) or f(bound))
        search.read(texts, np.arange(len(texts)))
        assert max(most) <= cells
        found.append([(s.tolist(), i.tolist()) for s, i in zip(search.score, search.id)])
    assert found[0] == found[1] and any(found[0][0])
