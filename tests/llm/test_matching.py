"""Set join and winnowing against plain Python."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tidebars.llm import set_join as sj
from tidebars.llm import winnowing as wn
from tidebars.llm.common import bit_filter, grams, passes, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in combinations([x for x in sets if x[0] is not None], 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            up[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for i in up:
        least[find(i)] = min(least[find(i)], i)
    return sorted(((i, len(s), None if i is None else least[find(i)]) for i, s in sets), key=repr)


def check(make, rows):
    got = sj.linked(make(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_components(rows)


def test_odd_documents(make, odd):
    check(make, odd)


def test_near_copies_and_chains(make, prose):
    """A large group of near copies of one text (some pairs of which are not similar), chains, and a passage that many texts share."""
    rng = random.Random(5)
    rows, base, passage = [], prose(120, 1).split(), prose(40, 2)
    for n in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{n}{rng.randrange(99)}"
        rows.append((n, " ".join(w)))
    chain = prose(100, 3).split()
    for n in range(12):
        chain = [f"c{n}a", *chain[1:]] if n % 2 else [*chain[3:], f"c{n}b", f"c{n}c", f"c{n}d"]
        rows.append((100 + n, " ".join(chain)))
    rows += [(200 + n, f"{prose(60, 1000 + n)} {passage} {prose(20, 2000 + n)}") for n in range(40)]
    rows += [(300 + n, prose(rng.randint(1, 9), 50 + n % 7)) for n in range(30)]
    check(make, rows)


def keeping(prose, core, lacks):
    """A text of its own core and of boilerplate in 40 pieces, some of which it lacks."""
    return " ".join([core, *(f"gap{k}" if k in lacks else prose(30, 5000 + k) for k in range(40))])


def test_copies_that_keep_parts_of_boilerplate(make, prose):
    """Sets 0, 1 and 3 are a chain, and 2 links with 3 only. All lists of 2 and 3 are led by 0, from which 3 is further apart than 2."""
    rng = random.Random(3)
    core, lead, own = prose(300, 4999), set(range(6, 37, 6)), " own0 own1 own2 own3 own4 own5"
    step = lambda a, b: set(range(3 * a, 3 * b + 1, 3))
    family = [(set(), ""), (step(1, 5), own), (step(4, 12), ""), (step(1, 10), own), ({30}, ""), ({36}, "")]
    rows = [(n, keeping(prose, core, lead ^ other) + end) for n, (other, end) in enumerate(family)]
    rows += [(100 + n, keeping(prose, "", set(rng.sample(range(40), 20)))) for n in range(60)]
    assert {i: c for i, _, c in expected_components(rows)}[2] == 0
    check(make, rows)


def test_random_parts_of_boilerplate(make, prose):
    rng = random.Random(4)
    rows = []
    for f in range(10):
        share = rng.choice((0.08, 0.1, 0.12, 0.15))
        for n in range(8):
            lacks = {k for k in range(40) if rng.random() < share}
            rows.append((8 * f + n, f"{keeping(prose, prose(300, 6000 + f), lacks)} g{f}a{rng.randrange(4)} g{f}b{rng.randrange(4)}"))
    check(make, rows)


def test_exact_threshold(make):
    """80 of 100 shingles in common links, 79 does not."""
    def text(lo, hi):
        return " ".join(f"w{k}" for k in range(lo, hi))

    # n words give n - 4 shingles; shifted by s they share n - 4 - s of n - 4 + s
    rows = [(1, text(0, 94)), (2, text(10, 104)), (3, text(500, 589)), (4, text(510, 600))]
    check(make, rows)
    got = {r.doc_id: r.component_id for r in sj.linked(make(rows)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == 4


def test_keep_one(make, odd):
    kept = sj.one_of_each(make(odd))
    assert kept.columns == make(odd).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and 5 not in ids and 6 not in ids and ids.count(None) == 2 and 9 in ids and 10 not in ids


def test_no_documents(make):
    assert sj.linked(make([])).count() == 0
    assert sj.linked(make([(1, None), (2, " ")])).count() == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    got = {r.id: r.component for r in sj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[1000 + k] == 1000 for k in range(1, 50))
    find = lambda x: got.get(x, x)
    assert all(find(a) == find(b) for a, b in edges)
    assert sj.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def expected_hits(rows, items):
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark, prose):
    rows = [(1, prose(30, 7)), (2, prose(12, 8)), (3, "Four Words, only here!"), (4, None), (5, ""), (6, "..."), (7, prose(30, 7)), (7, prose(30, 7)), (8, prose(10, 9)), (9, "ten two " * 9), (10, "solo"), (None, prose(15, 10))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(make, odd, prose, items):
    bench, table = items
    rng = random.Random(2)
    rows = list(odd)
    for n in range(60):
        source = words(prose(30, 7)) if n % 3 else words(prose(12, 8)) + ["x"] + words(prose(10, 9))
        a = rng.randrange(0, 15)
        cut = source[a : a + rng.randint(5, 20)]
        rows.append((100 + n, f"{prose(20, 300 + n)}! {' - '.join(cut).upper()} {prose(rng.randint(0, 9), 400 + n)}"))
    rows += [(900, "four words only here four WORDS only here"), (901, "ten two ten two ten two ten two ten two ten"), (902, "a solo b"), (903, prose(30, 7)), (904, prose(9, 9))]
    got = wn.contamination(make(rows), table).select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated").collect()
    want = expected_hits(rows, [x for x in bench if x[0] is not None])
    assert sorted(((*r[:4], list(r.item_ids), r.contaminated) for r in got), key=repr) == want
    kept = wn.without_benchmark(make(rows), table)
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in want if not r[-1]), key=repr)


def test_no_items_and_no_documents(spark, make, odd, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in wn.contamination(make(odd), none).collect()} == {0}
    assert wn.contamination(make([]), items[1]).count() == 0


def test_every_ten_words_have_a_fingerprint(prose):
    text = prose(200, 4).encode()
    h, owner, *_ = word_hashes([text], "alnum")
    g, at = grams(h, owner, 5)
    chosen = set(wn.winnowed(g, at, owner, 6).tolist())
    assert all(any(k in chosen for k in range(a, a + 6)) for a in range(len(g) - 5))
    assert len(chosen) < len(g) / 2


def test_bit_filter_loses_nothing(spark):
    have = [(int(x),) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)]
    w = bit_filter(spark.createDataFrame(have, "h long"), "h", 12)
    assert passes(w, np.array(have, np.int64)[:, 0].view(np.uint64), 12).all() and 0 < np.unpackbits(w.view(np.uint8)).sum() <= 500


def test_hot_lists_give_the_same(make, prose, monkeypatch):
    """With every token listed apart, and with none, lists are the same."""
    rows = [(n, f"{prose(30, n % 9)} {prose(3, 100 + n)}") for n in range(60)]
    want = expected_components(rows)
    for hot in (-(10**9), 10**9):
        monkeypatch.setattr(sj.prefixes, "__defaults__", (hot,))
        assert sorted(map(tuple, sj.linked(make(rows)).collect()), key=repr) == want


def test_parity_bits_bound_differences(prose):
    for n, k in ((40, 3), (300, 40), (300, 0), (5, 200), (900, 450)):
        x, y = sj.shingle_sets([f"{prose(n, 1)} {prose(30, 2)}".encode(), f"{prose(n, 1)} {prose(k, 3)}".encode()])
        real = len(np.setxor1d(x, y))
        bound = sj.least_difference(sj.parity_bits(x), sj.parity_bits(y))
        assert bound <= real and bound % 2 == real % 2
        if len(x) < 2 * len(y) and len(y) < 2 * len(x):
            assert bound >= real / 3


def jobs_of(spark, run):
    """The number of jobs that ``run`` starts, and its result."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_stars_need_no_round(spark):
    """Edges that are stars already are not joined again: what the driver holds for a round is not spent on them."""
    stars = spark.createDataFrame([(k % 5, 10 + k) for k in range(60)] + [(3, 3)], "a long, b long")
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")
    few, got = jobs_of(spark, lambda: sj.components(stars).collect())
    many, line = jobs_of(spark, lambda: sj.components(chain).collect())
    assert sorted((r.id, r.component) for r in got) == [(10 + k, k % 5) for k in range(60)]
    assert sorted((r.id, r.component) for r in line) == [(k, 0) for k in range(1, 13)]
    assert few <= 8 < many


def test_rounds_make_no_broadcast_tables(spark, monkeypatch):
    """Joins over small edges are not turned into broadcasts, of which the driver makes and holds the tables."""
    plans = []
    monkeypatch.setattr(sj, "cut", lambda df: [plans.append(df), df.collect()] and spark.createDataFrame(df.collect(), df.schema))
    sj.components(spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")).collect()
    text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum(t.count("SortMergeJoin") for t in text) >= 2 and not any("BroadcastHashJoin" in t for t in text)


def test_the_sketch_is_sent_once(spark, make, prose, monkeypatch):
    sent = []
    make_one = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: sent.append(getattr(v, "nbytes", 0)) or make_one(self, v))
    rows = [(n, f"{prose(30, n % 7)} {prose(3, 100 + n)}") for n in range(40)]
    check(make, rows)
    assert sum(n >= 4 << sj.SKETCH_BITS for n in sent) == 1


def test_only_leaders_of_moved_sets_meet_again(spark):
    group = spark.createDataFrame([(low, i, f"{low}-{i}") for low, i in [(1, 2), (1, 3), (4, 5), (6, 7), (8, 9), (10, 11)]], "low long, id long, delta string")
    parts = lambda d: spark.createDataFrame(list(d.items()), "id long, component long")
    before = parts({2: 1, 7: 6, 9: 8})
    after = parts({2: 1, 3: 1, 7: 6, 9: 0, 8: 0, 10: 4})  # 3 joins 1; 8 and 9 get a smaller component; 10 joins 4; 5, 6 and 7 stay
    got = sj.regrouped(group, before, after)
    assert got.columns == group.columns
    assert sorted(r.delta for r in got.collect()) == ["1-2", "1-3", "10-11", "8-9"]
