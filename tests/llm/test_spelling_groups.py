"""Words, near pairs and roots against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidebars.llm import spelling_groups as sg

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_words(rows, least=3):
    total = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows):
    n = expected_words(rows)
    around = defaultdict(list)
    for a in n:
        for b in n:
            if a != b and abs(len(a) - len(b)) < 2 and near(a, b):
                around[a].append(b)
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n)


def misspelt(seed, words=120, texts=60):
    """Words over few letters, so that many are near each other, with edits and accents."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(words)]
    rows = []
    for i in range(texts):
        out = []
        for _ in range(rng.randint(0, 120)):
            w = list(base[min(rng.randrange(words), rng.randrange(words))])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [w[k], rng.choice("abÈÿz")], [rng.choice("xyzÀ")]])
            out.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "\n", "œ", "1"]).join(out)))
    return rows


@pytest.mark.parametrize("options", [{}, {"sample": 30, "leaf_words": 5, "piece_words": 3}])
def test_variants(make, options):
    chain = " ".join(["xbcdefgh"] * 40 + ["xbcdefgz"] * 12 + ["xbcdefyz"] * 4)
    rows = [*misspelt(1), (500, chain), (501, chain)]
    got = sorted(map(tuple, sg.variants(make(rows), **options).collect()))
    assert got == expected(rows)
    assert any(r[1] and r[1] != r[2] for r in got) and len(got) > 100


def test_odd_documents(make, odd):
    long = "a" * 3000
    rows = [*odd, (20, f"{long} {long} {long}b"), (21, f"{long} {long}b {long}b {long}b {long}b"), (22, "Straße straße STRASSE naïve ÷×÷×÷ ÷×÷×÷ ÷×÷×÷")]
    assert sorted(map(tuple, sg.variants(make(rows)).collect())) == expected(rows)


def test_empty_table(make):
    assert sg.variants(make([])).count() == 0
    assert sg.variants(make([(1, None), (2, "")])).count() == 0


def test_query_on_a_table(spark, make, tmp_path):
    rows = misspelt(2, 60, 40)
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sg.op13_spelling_groups(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == expected(rows)


def test_marks_are_crc32():
    texts = [b"alpha beta \xc3\xa9t\xc3\xa9", b"", b"gamma" * 50]
    data, owner, start, end, _ = sg.runs(texts)
    prefix = np.array([zlib.crc32(b"%d:" % i) for i in (7, 8, 123456)], np.uint32)
    got = sg.marks(data, start, end, prefix[owner])
    assert got.tolist() == [zlib.crc32(b"%d:" % (7, 8, 123456)[o] + data[a:b]) for o, a, b in zip(owner, start, end, strict=True)]


def test_boxes_lose_no_near_word():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(1500)})
    piece = sg.Piece(words, [1] * len(words))
    x, y = piece.near(words)
    got = {(words[i], words[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}
    longer = sorted({w[:k] + "h" + w[k:] for w in words[::20] for k in (0, 3, 6)})
    x, y = piece.near(longer)
    got = {(longer[i], words[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a in longer for b in words if near(a, b)}
