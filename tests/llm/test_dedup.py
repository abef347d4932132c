"""Chunk recipes and line dedup against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tidebars.llm import chunk_recipes as cr
from tidebars.llm import line_dedup as ld


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1024, 4096, 32768), (16, 64, 256)])
def test_exact_groups(make, odd, sizes):
    got = cr.exact_groups(make(odd), sizes=sizes).collect()
    assert sorted(map(tuple, got), key=repr) == expected_groups(odd)


def test_colliding_identifiers_are_widened(make, odd):
    docs = make(odd)
    assert not cr.colliding(cr.chunks(docs, "text", 1, (16, 64, 256))).isEmpty()
    got = cr.exact_groups(docs, widths=(1, 16), sizes=(16, 64, 256)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_groups(odd)
    with pytest.raises(ValueError):
        cr.exact_groups(docs, widths=(1,), sizes=(16, 64, 256))


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    a, b = rng.bytes(40_000), rng.bytes(100)
    for text, ends in zip([a, b + a, b"", b"x"], cr.cuts([a, b + a, b"", b"x"]), strict=True):
        assert (not text and not ends) or ends[-1] == len(text)
        assert all(0 < y - x <= 32768 for x, y in zip([0, *ends], ends, strict=False))
    one, two = cr.cuts([a, b + a])
    chunks = {a[x:y] for x, y in zip([0, *one], one, strict=False)}
    shifted = {(b + a)[x:y] for x, y in zip([0, *two], two, strict=False)}
    assert len(chunks & shifted) >= len(chunks) - 3


def test_empty_tables(make):
    docs = make([])
    assert cr.exact_groups(docs).count() == 0
    assert ld.dedup_lines(docs).count() == 0


def expected_lines(rows, least=3):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(lower)
    held = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        lost = lambda k: len(held[k]) >= least and i != max((x for x in held[k] if x is not None), default=None)
        keep = [x for x in lines if len(key(x)) < 20 or not lost(key(x))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def test_lines(make, odd):
    got = ld.dedup_lines(make(odd))
    assert got.columns == [*make(odd).columns, "n_lines", "n_dropped"]
    rows = got.select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, rows), key=repr) == expected_lines(odd)


def test_line_held_by_a_third(make, prose):
    rows = [(n, f"{prose(8, n)}\n" + ("A line that many documents share here\n" if n % 3 == 0 else "") + prose(5, -n)) for n in range(300)]
    got = ld.dedup_lines(make(rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == expected_lines(rows)
