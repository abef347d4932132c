"""Fingerprints and anchors against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from tidebars.llm import anchor_cover as ac


def expected_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_components(pairs, apart=4):
    """pairs of (doc_id, fingerprint)."""
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= apart:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


def check(make, rows, **options):
    got = ac.near_groups(make(rows), **options).collect()
    prints = [(d, expected_fingerprint(t)) for d, t in rows]
    want = [(d, f, c) for (d, f), c in zip(prints, expected_components(prints), strict=True)]
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def test_odd_documents(make, odd):
    check(make, [*odd, (16, "A  b\tC"), (17, "a b c"), (18, "a b c d"), (None, "a b c D")])


def test_near_copies(make, prose):
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = prose(60 + 40 * g, g).split()
        for n in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"y{n}"
            rows.append((1000 * g + n, " ".join(w)))
    rows += [(9000 + n, prose(50, 100 + n)) for n in range(30)]
    check(make, rows)


def test_pieces_of_large_lists(make, prose):
    rng = random.Random(4)
    base = prose(200, 7).split()
    rows = [(n, " ".join(w if rng.random() > 0.02 else f"z{n}" for w in base)) for n in range(80)]
    check(make, rows, piece_homes=5)


def test_empty_table(make):
    assert ac.near_groups(make([])).count() == 0


def test_query_on_a_table(spark, make, odd, tmp_path):
    make(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = ac.op12_anchor_cover(spark, str(tmp_path)).collect()
    prints = [(d, expected_fingerprint(t)) for d, t in odd]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, expected_components(prints), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("step", [1 << 21, 50])
@pytest.mark.parametrize("batch", [7, 1000])
def test_links_hold_all_groups(monkeypatch, step, batch):
    """Random fingerprints in dense balls: links of all cells connect exactly what brute force does, in short and long lists."""
    import pyarrow as pa

    monkeypatch.setattr(ac, "STEP", step)
    rng = random.Random(step + batch)
    values = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            values.append(x)
    values = np.unique(np.array(values, np.uint64))
    row, cell, other = ac.placed(values, 2)
    order = np.lexsort((other, cell))
    cell, other, fp = cell[order], other[order], values[row][order]
    batches = [pa.RecordBatch.from_arrays([pa.array(cell[a : a + batch]), pa.array(other[a : a + batch]), pa.array(fp[a : a + batch].view(np.int64))], ["cell", "other", "fp"]) for a in range(0, len(cell), batch)]
    up = {int(v): int(v) for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for part in ac._links(batches, 4):
        for a, b in zip(*(part.column(c).to_numpy().view(np.uint64).tolist() for c in ("a", "b")), strict=True):
            assert (a ^ b).bit_count() <= 4
            up[find(max(find(a), find(b)))] = min(find(a), find(b))
    want = expected_components([(int(v), int(v)) for v in values])
    assert [find(int(v)) for v in values] == want


def test_every_part_is_near_an_anchor():
    x = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    row, cell, other = ac.placed(x, ac.RADIUS)
    assert sorted(row[~other].tolist()) == sorted(list(range(2000)) * 3)
