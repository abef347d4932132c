"""SimHash near-dedup by anchor-point covering.

A fingerprint of 64 bits is read as three parts. Two fingerprints that differ in at most four bits differ in at most one bit of some part,
so each part is searched for pairs within one bit. The anchors of a part are the words of a covering code: 15 of its bits form a Hamming
code word, the other 6 or 7 bits are free, so no part is further than one bit (the covering radius) from its nearest anchor. Each distinct
fingerprint is replicated to every anchor within radius plus threshold (two bits); there it meets all fingerprints whose nearest anchor
this is. The code is linear, so the anchors around a part follow from its syndrome by a small table.

Equal fingerprints are one row. Inside an anchor's list, links that only repeat what earlier links connected are not emitted where the list
is long: members are reached breadth first from a leader, and the distance to the leader rules most others out (triangle inequality).
Lists with more than ``PIECE_HOMES`` nearest fingerprints are cut into pieces, and every row of the list goes to each piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import cut, documents, filled, map_arrow, raw, slices, stored
from tidebars.llm.set_join import components

WORDS = 4
SEED = 42
BITS_APART = 4
#: Of each part: the bits that form a Hamming code word, and the free bits.
CODE_BITS, FREE_BITS = 15, (6, 6, 7)
RADIUS = 1
#: Nearest fingerprints of one anchor that one piece of its list holds on average.
PIECE_HOMES = 100_000
#: Comparisons that are written out as index arrays at a time.
STEP = 1 << 21


def shingle_hashes(text: bytes, k: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``k`` words joined by one space, repeats included; of the whole sequence if there are fewer words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, seed)]
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = [0, *(end[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(begin, end[k - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in more than half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[a : a + (1 << 16)], np.uint64).astype(">u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big") if hashes else 0


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row. Null, empty and wordless texts have fingerprint 0."""

    def run(batches):
        for part in slices(batches, "text"):
            made = np.array([fingerprint(shingle_hashes(t)) for t in raw(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")), run, "doc_id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low ``CODE_BITS`` bits: the exclusive or of the places (from 1) of the bits set. It is 0 for code words."""
    out = np.zeros(x.shape, np.uint64)
    for place in range(CODE_BITS):
        out ^= ((x >> np.uint64(place)) & np.uint64(1)) * np.uint64(place + 1)
    return out


def _steps(free: int, reach: int) -> list[np.ndarray]:
    """For each syndrome the bit patterns of weight ``reach`` at most that lead from a part with that syndrome to an anchor, nearest first."""
    bits = CODE_BITS + free
    layers = [{0}]
    for _ in range(reach):
        layers.append({m | 1 << b for m in layers[-1] for b in range(bits) if not m >> b & 1})
    masks = np.array([m for layer in layers for m in sorted(layer)], np.uint64)
    syndromes = _syndrome(masks)
    return [masks[syndromes == s] for s in range(CODE_BITS + 1)]


def placed(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, cell (part and anchor) and whether it is not the row's nearest anchor, for every anchor within ``reach``."""
    rows, cells, others = [], [], []
    shift = 0
    for part, free in enumerate(FREE_BITS):
        width = CODE_BITS + free
        x = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        s = _syndrome(x)
        for value, masks in enumerate(_steps(free, reach)):
            at = np.flatnonzero(s == value)
            rows.append(np.repeat(at, len(masks)))
            cells.append((x[at][:, None] ^ masks[None, :]).ravel() | np.uint64(part << 32))
            others.append(np.tile(np.arange(len(masks)) > 0, len(at)))
        shift += width
    return np.concatenate(rows), np.concatenate(cells).view(np.int64), np.concatenate(others)


def _near(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= apart


def short_lists(fps: np.ndarray, size: np.ndarray, homes: np.ndarray, apart: int):
    """Links of many lists at once: each home against all rows after it in its list. Rows lie list after list, homes first."""
    start = np.cumsum(size) - size
    home = np.repeat(start, homes) + _ranges(homes)
    last = np.repeat(start + size, homes)
    todo = last - home - 1
    edge = np.searchsorted(np.cumsum(todo), np.arange(0, int(todo.sum()) + STEP, STEP))
    for a, b in zip(edge, edge[1:], strict=False):
        n = todo[a : b + 1]
        x = np.repeat(home[a : b + 1], n)
        y = x + 1 + _ranges(n)
        hit = _near(fps[x], fps[y], apart)
        yield fps[x[hit]], fps[y[hit]]


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def grouped(homes: np.ndarray, apart: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The connected groups of ``homes``, each with its leader first, and links that hold them together."""
    left, groups, links = homes, [], []
    while len(left):
        lead, left = left[0], left[1:]
        away = np.bitwise_count(left ^ lead)
        members, front = [np.array([lead])], np.array([lead])
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            reach = int(np.bitwise_count(some ^ lead).max()) + apart
            at = np.flatnonzero(away <= reach)
            met = _near(left[at][:, None], some[None, :], apart)
            found = met.any(axis=1)
            got = left[at[found]]
            if len(got):
                links.append((got, some[met[found].argmax(axis=1)]))
                members.append(got)
                front = np.concatenate([front, got])
                keep = np.ones(len(left), bool)
                keep[at[found]] = False
                left, away = left[keep], away[keep]
        groups.append(np.concatenate(members))
    return groups, links


def long_list(groups: list[np.ndarray], others: np.ndarray, apart: int):
    """One link from each of ``others`` to each group that it touches."""
    single = np.array([g[0] for g in groups if len(g) == 1], np.uint64)
    rows = max(1, STEP // max(1, len(others)))
    for a in range(0, len(single), rows):
        x, y = np.nonzero(_near(single[a : a + rows, None], others[None, :], apart))
        yield single[a : a + rows][x], others[y]
    for group in groups:
        if len(group) == 1:
            continue
        far = np.bitwise_count(group ^ group[0]).astype(np.int64)
        away = np.bitwise_count(others ^ group[0]).astype(np.int64)
        rest = others[away <= far.max() + apart]
        for a in range(0, len(group), 64):
            if not len(rest):
                break
            some = group[a : a + 64]
            met = _near(rest[:, None], some[None, :], apart)
            found = met.any(axis=1)
            yield rest[found], some[met[found].argmax(axis=1)]
            rest = rest[~found]


def _links(batches, apart: int):
    """Rows (cell, other, fp) in order of cell and other -> links. Whole lists are worked through many at a time; a list that goes on
    over batches keeps its homes only, and the others pass by."""
    cell = np.empty(0, np.int64)
    other = np.empty(0, bool)
    fp = np.empty(0, np.uint64)
    groups = None  # of the list that goes on, once its homes are complete

    def out(links):
        x, y = (np.concatenate([side, np.empty(0, np.uint64)]).view(np.int64) for side in links)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def finished(cell, other, fp, groups):
        if groups is not None:
            n = int(np.searchsorted(cell, cell[0], side="right"))
            yield from long_list(groups, fp[:n], apart)
            cell, other, fp = cell[n:], other[n:], fp[n:]
        if not len(cell):
            return
        start = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
        size = np.diff(start, append=len(cell))
        homes = np.add.reduceat((~other).astype(np.int64), start)
        big = homes * size > STEP
        keep = np.repeat(~big, size)
        yield from short_lists(fp[keep], size[~big], homes[~big], apart)
        for a, n, h in zip(start[big].tolist(), size[big].tolist(), homes[big].tolist(), strict=True):
            found, links = grouped(fp[a : a + h], apart)
            yield from links
            yield from long_list(found, fp[a + h : a + n], apart)

    for batch in batches:
        cell = np.concatenate([cell, batch.column("cell").to_numpy(zero_copy_only=False)])
        other = np.concatenate([other, batch.column("other").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(cell):
            continue
        last = int(np.searchsorted(cell, cell[-1]))
        if last:
            for x in finished(cell[:last], other[:last], fp[:last], groups):
                yield out(x)
            cell, other, fp, groups = cell[last:], other[last:], fp[last:], None
        if len(cell) > STEP and other[-1]:
            homes = int(np.searchsorted(other, True)) if groups is None else 0
            if groups is None:
                groups, links = grouped(fp[:homes], apart)
                for x in links:
                    yield out(x)
            for x in long_list(groups, fp[homes:-1], apart):
                yield out(x)
            cell, other, fp = cell[-1:], other[-1:], fp[-1:]
    if len(cell):
        for x in finished(cell, other, fp, groups):
            yield out(x)


def near_links(fps: DataFrame, apart: int = BITS_APART, piece_homes: int = PIECE_HOMES) -> DataFrame:
    """a, b: links between distinct fingerprints (column ``fp``) within ``apart`` bits, enough of them to connect all that are linked."""
    reach = RADIUS + apart // len(FREE_BITS)

    def replicate(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                values = batch.column("fp").slice(a, 5000).to_numpy(zero_copy_only=False).view(np.uint64)
                row, cell, other = placed(values, reach)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(other), pa.array(values[row].view(np.int64))], ["cell", "other", "fp"])

    def nearest(batches):
        for batch in batches:
            _, cell, _ = placed(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), RADIUS)
            yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])

    # an anchor with more nearest fingerprints than a piece holds is cut; others have piece 0
    homes = map_arrow(fps.select("fp"), nearest, "cell long").groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > piece_homes)
    large = stored(homes.select("cell", F.ceil(F.col("m") / piece_homes).cast("int").alias("pieces")), "large-anchors")
    rows = map_arrow(fps.select("fp"), replicate, "cell long, other boolean, fp long").join(large, "cell", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("pieces", F.lit(1))).cast("int")
    rows = rows.withColumn("own", own).withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces") - 1, F.lit(0)))))
    # a piece is a list of its own: its number is put above part and anchor
    rows = rows.select((F.col("cell") + F.shiftleft(F.col("piece").cast("long"), 40)).alias("cell"), (F.col("other") | (F.col("piece") != F.col("own"))).alias("other"), "fp")
    return map_arrow(rows.repartition("cell").sortWithinPartitions("cell", "other"), lambda batches: _links(batches, apart), "a long, b long").filter("a != b")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", apart: int = BITS_APART, piece_homes: int = PIECE_HOMES) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over fingerprints that differ in ``apart`` bits at most.

    Words are what is left between ASCII white space, A-Z in lower case. Null, empty and wordless texts have fingerprint 0, which links like
    any other. Repeated rows give equal rows; rows of one doc_id with different texts stand for themselves. Rows without doc_id link like
    others but name no component; a component of such rows only has none. An empty table gives no rows.
    """
    if apart // len(FREE_BITS) != 1:
        raise ValueError(f"the code covers {len(FREE_BITS)} to {2 * len(FREE_BITS) - 1} bits")
    rows = cut(fingerprints(docs, doc_id, text))
    heads = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprints")
    parts = components(near_links(heads, apart, piece_homes)).withColumnRenamed("id", "fp")
    named = heads.join(parts, "fp", "left").select("fp", "head", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "fingerprint-parts")
    least = stored(named.groupBy("component").agg(F.min("head").alias("component_id")), "fingerprint-groups")
    return rows.join(stored(named.join(least, "component").select("fp", "component_id"), "fingerprint-components"), "fp").select("doc_id", "fp", "component_id")


def op12_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op12_anchor_cover": (op12_anchor_cover, None)}
