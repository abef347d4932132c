"""N-gram Jaccard join with set-relation skipping.

A document is the set of its five-word shingles. Equal sets are one class, joined once. Classes meet over an index: each set's tokens are put
in one global order (rare ones first, by a count sketch of fixed size over all documents), and only the first fifth of them can be where
two similar sets first meet, so an index list holds (set, size, place) for such tokens only.

Two relations between sets keep lists from becoming pairs:

* Index skipping. Entries know their place, and two places bound what two sets can share, so most entries are passed over unread. A list is
  cut into blocks by set size, and an entry is put only into blocks of sizes that its place in its own set still allows: the later its
  place, the fewer tokens can follow, and the narrower its range. A set reads one block of each of its lists.
* Answer skipping. Each list's smallest and largest id are its leaders. Every set is first compared with the leaders of its lists only.
  Sets linked through leaders share a component, and the answer for a pair inside one component adds nothing, so it is not computed. For a
  pair across components, what sets both apart from a common leader is known, and the pair's answer follows from that: it is skipped unless
  they share enough of it (``through_leaders``). Sets left outside meet the smallest member of their lists first, for as long as that joins
  any; only then is what is left compared.

So a group of thousands of near copies costs a few comparisons for each member. No link between different components is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import bit_filter, cut, documents, filled, grams, map_arrow, mix, passes, raw, slices, stored, weights, word_hashes

WORDS = 5
#: The similarity as a fraction, so that comparisons are in whole numbers.
SIMILAR = (4, 5)
#: Sets are compared with a leader from this similarity on: also of sets that do not link with it, what sets them apart from it is worth knowing.
LEAD = (2, 5)
SKETCH_BITS, PIECE_BITS = 21, 15
FILTER_BITS = 23
#: A token that this many more documents hold than a sketch counter has on average is listed apart.
HOT = 10_000
#: Block edges grow by this factor of the set size.
BLOCK_GROWTH = 1.05


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted. A text of fewer words has one, of its whole sequence; a wordless text none."""
    hashed, owner, _, _, _ = word_hashes(texts, "spaced")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    g, at = grams(hashed, owner, k)
    edges = np.searchsorted(at, bounds)
    out = []
    for i in range(len(texts)):
        n = bounds[i + 1] - bounds[i]
        if n >= k:
            out.append(np.unique(g[edges[i] : edges[i + 1]]))
        elif n:
            w = hashed[bounds[i] : bounds[i + 1]]
            out.append(mix(np.array([np.sum(w * weights(k)[:n], dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def parity_bits(s: np.ndarray) -> bytes:
    """One bit for the parity of the tokens in each of 4n to 8n bins, a power of two. Two sets differ in at least as many tokens as their bits do."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of tokens in one set only, from both sets' parity bits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def token_sketch(docs: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of documents by token hash, summed over all documents; a fixed number of 2**bits counters. docs: text."""
    pieces = 1 << max(0, bits - PIECE_BITS)

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for part in slices(batches, "text"):
            for s in shingle_sets(raw(part.column("text"))):
                np.add.at(counts, s >> np.uint64(64 - bits), 1)
        if counts.any():
            small = np.minimum(counts, 65535).astype("<u2").reshape(pieces, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in small], pa.binary())], ["piece", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(data, "<u2").astype(np.uint64)
                total[piece] = total[piece] + got if piece in total else got
        if total:
            capped = [np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(capped, pa.binary())], ["piece", "counts"])

    kind = "piece int, counts binary"
    summed = map_arrow(map_arrow(docs, run, kind).repartition(pieces, "piece"), add, kind).toArrow()  # one array of fixed size in all
    out = np.zeros(1 << bits, np.uint32)
    step = len(out) // pieces
    for piece, data in zip(summed.column("piece").to_pylist(), summed.column("counts"), strict=True):
        out[piece * step : (piece + 1) * step] = np.frombuffer(data.as_buffer(), "<u4")
    return out


def prefixes(docs: DataFrame, sent: Broadcast, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), its first tokens in the global order, how many of them (all that come before
    the rest) are not hot, and its parity bits. docs: doc_id, text; sent: the token sketch."""
    bits, limit = len(sent.value).bit_length() - 1, float(sent.value.mean()) + hot

    def run(batches):
        for part in slices(batches, "text"):
            n, digests, tokens, cold, bits_of = [], [], [], [], []
            for s in shingle_sets(raw(part.column("text"))):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                counts = sent.value[s >> np.uint64(64 - bits)]
                order = np.argsort(counts, kind="stable")[: prefix_size(len(s))] if len(s) else []
                tokens.append(s[order].view(np.int64))
                cold.append(int(np.count_nonzero(counts[order] <= limit)))
                bits_of.append(parity_bits(s))
            columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(cold, pa.int32()), pa.array(bits_of, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_shingles", "digest", "tokens", "cold", "bits"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, digest binary, tokens array<long>, cold int, bits binary")


def plausible(pairs: DataFrame, rows: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose parity bits leave room for such a similarity. None of them is lost; what moves is about a tenth of the sets."""
    num, den = similar
    side = lambda k: rows.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    both = pairs.select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

    def run(batches):
        for batch in batches:
            p = batch.to_pydict()
            keep = [(nx + ny - least_difference(x, y)) * (num + den) >= 2 * num * (nx + ny) for nx, ny, x, y in zip(p["n_a"], p["n_b"], p["bits_a"], p["bits_b"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long").distinct()


def index_entries(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """token, id, n, at, hot: one row for each prefix token of each class, under its smallest doc_id.

    Documents that are not their class's head are few beside all; their ids are put into a bit array, and only rows that it lets through are
    joined with the classes. All others are heads, and their tokens do not move here.
    """
    rest = rows.join(classes.filter("members > 1").select("digest", "head"), "digest").filter("doc_id != head").select(F.xxhash64("doc_id").alias("h"))
    words = bit_filter(rest, "h", FILTER_BITS)
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))

    def heads(batches):
        for batch in batches:
            hit = passes(words, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)
            got = batch.filter(pa.array(~hit))
            for a in range(0, got.num_rows, 500):
                yield _exploded(got.slice(a, 500))

    def others(batches):
        for batch in batches:
            hit = passes(words, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)
            yield batch.filter(pa.array(hit)).select(names)

    names = rows.columns
    kind = "token long, id long, n int, at int, hot boolean"
    doubtful = map_arrow(hashed, others, rows.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    found = doubtful.withColumnRenamed("doc_id", "head").join(classes, ["digest", "head"]).select(F.col("head").alias("id"), F.col("n_shingles").cast("int").alias("n"), "cold", F.posexplode("tokens").alias("at", "token"))
    return map_arrow(hashed, heads, kind).unionByName(found.select("token", "id", "n", "at", (F.col("at") >= F.col("cold")).alias("hot")))


def _exploded(rows: pa.RecordBatch) -> pa.RecordBatch:
    lists = rows.column("tokens")
    size = np.diff(lists.offsets.to_numpy())
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    each = lambda c: np.repeat(rows.column(c).to_numpy(zero_copy_only=False), size)
    return pa.RecordBatch.from_arrays([lists.flatten(), pa.array(each("doc_id")), pa.array(each("n_shingles").astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(at >= each("cold"))], ["token", "id", "n", "at", "hot"])


def index_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with two sets or more, each with the list's smallest and largest id (low, high) and their sizes and places.

    Lists of ordinary tokens are read in order, a batch at a time, after one shuffle by token. Hot tokens' lists may hold a large share of all
    documents: they are summed before a shuffle, and joined back where Spark may split them.
    """

    def run(batches):
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
            token = now.column("token").to_numpy()
            start = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
            yield _shared(now.slice(0, start[-1]), start[:-1])
            kept = now.slice(start[-1])
        if kept is not None:
            yield _shared(kept, np.array([0]))

    kind = "token long, id long, n int, at int, low long, low_n int, low_at int, high long, high_n int, high_at int"
    plain = map_arrow(entries.filter("not hot").drop("hot").repartition("token").sortWithinPartitions("token", "id"), run, kind)
    hot = entries.filter("hot").drop("hot")
    entry = F.struct("id", "n", "at")
    ends = hot.groupBy("token").agg(F.min(entry).alias("l"), F.max(entry).alias("h")).filter("l.id < h.id")
    ends = stored(ends.select("token", *(F.col(f"{e[0]}.{c}").alias(e + f) for e in ("low", "high") for c, f in (("id", ""), ("n", "_n"), ("at", "_at")))), "hot-lists")
    return plain.unionByName(hot.join(ends, "token"))


def _shared(rows: pa.RecordBatch, start: np.ndarray) -> pa.RecordBatch:
    """Rows of runs with two ids or more; ``start``: where the runs of one token begin."""
    ids = rows.column("id").to_numpy()
    size = np.diff(start, append=len(ids))
    first, last = np.repeat(start, size), np.repeat(start + size - 1, size)
    keep = np.flatnonzero(ids[first] < ids[last]) if len(ids) else np.empty(0, np.int64)
    ends = [rows.column(c).take(pa.array(at[keep])) for at in (first, last) for c in ("id", "n", "at")]
    names = ["token", "id", "n", "at", "low", "low_n", "low_at", "high", "high_n", "high_at"]
    return pa.RecordBatch.from_arrays([*rows.take(pa.array(keep)).columns, *ends], names)


def may_link(n: Column, at: Column, m: Column, by: Column) -> Column:
    """Whether sets of sizes n and m that share the token at places ``at`` and ``by`` can be similar: before it they share no more than the
    smaller place, after it no more than the shorter rest."""
    num, den = SIMILAR
    return (F.least(at, by) + 1 + F.least(n - at - 1, m - by - 1)) * (num + den) >= (n + m) * num


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in ``links`` (a, b). Alternates two steps until the edges are stars: join larger neighbours
    to a node's smallest neighbour, then smaller ones. Edges with thousands at one node are aggregated before their shuffle.

    The joins are sort-merge joins whatever their size: both sides are shuffled by then, and tables made for a broadcast would add up in the
    driver over the rounds.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        # in a star the smallest node has larger neighbours only, and each of them has no other
        if least.filter("m < a and n > 1").count() == 0:
            break
        large = both.join(least.select("a", F.least("m", "a").alias("m")).hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")


def compared(docs: DataFrame, pairs: DataFrame, sent: Broadcast) -> DataFrame:
    """a, b, common, size_a, size_b for the pairs (a, b) of doc_ids, and the tokens that only one of them has, only_a and only_b, in the global order.
    Sets are made again from the texts of documents that occur in a pair.

    A document may pass the bit array without being in a pair; it then joins nothing. sent: the token sketch."""
    bits = len(sent.value).bit_length() - 1
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    words = bit_filter(ids.select(F.xxhash64("id").alias("h")), "h", FILTER_BITS)
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text")

    def run(batches):
        for batch in batches:
            hit = passes(words, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)
            for part in slices(iter([batch.filter(pa.array(hit))]), "text"):
                sets = [s.tobytes() for s in shingle_sets(raw(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["id", "tokens"])

    sets = map_arrow(keyed, run, "id long, tokens binary")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def count(batches):
        for batch in batches:
            common, only = [], ([], [])
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                for here, there, out in ((p, q, only[0]), (q, p, only[1])):
                    rest = np.setdiff1d(here, there, assume_unique=True)
                    out.append(rest[np.argsort(sent.value[rest >> np.uint64(64 - bits)], kind="stable")].view(np.int64))
                common.append(len(p) - len(only[0][-1]))
            size = [pa.array([len(v.as_buffer()) // 8 for v in batch.column(c)], pa.int64()) for c in ("x", "y")]
            deltas = [pa.array(rows, pa.list_(pa.int64())) for rows in only]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), *size, *deltas], ["a", "b", "common", "size_a", "size_b", "only_a", "only_b"])

    return map_arrow(both, count, "a long, b long, common long, size_a long, size_b long, only_a array<long>, only_b array<long>")


def leader_rows(known: DataFrame) -> DataFrame:
    """low, id, w, p, k, delta: what sets each set apart from a leader it was compared with.

    With R tokens of the leader (P in all) that a set lacks and A others that it has, its weight is w = 5 R + 4 A: the set links with the
    leader if w <= P. Two sets can only link if they share at least (w + w' - P) / 9 tokens of what sets them apart from the leader, so their
    deltas meet as sets do: the first token that both have, in any order that is the same for all, lies early in both. The order here puts
    what few of the leader's deltas hold first: of what the set has, the globally rare; then of what it lacks, the globally common. What the
    leader alone has is missing in all others and comes last.
    """
    num, den = SIMILAR
    assert (num, den) == (4, 5)
    c = F.col
    delta = lambda has, lacks: F.concat(has, F.reverse(lacks)).alias("delta")
    one = known.select(c("a").alias("low"), c("b").alias("id"), c("size_a").alias("p"), c("size_b").alias("q"), "common", delta("only_b", "only_a"))
    other = known.select(c("b").alias("low"), c("a").alias("id"), c("size_b").alias("p"), c("size_a").alias("q"), "common", delta("only_a", "only_b"))
    weight = 5 * (c("p") - c("common")) + 4 * (c("q") - c("common"))
    return one.union(other).select("low", "id", weight.alias("w"), "p", F.size("delta").alias("k"), "delta")


def _probed() -> Column:
    """Entries of a set outside the leader's component that can be the first it shares with a lighter one."""
    return F.when(F.col("w") > F.col("p"), F.col("k") - F.ceil((F.col("w") - F.col("p")) / 9) + 1).otherwise(0)


def _listed(inside: Column) -> Column:
    """Entries that can be the first a set shares with a heavier one, or, inside the leader's component, with any set outside."""
    w, p = F.col("w"), F.col("p")
    return F.col("k") - F.ceil(F.when(inside, w + 1).otherwise(F.greatest(2 * w - p, w + 1)) / 9) + 1


def through_leaders(group: DataFrame, parts: DataFrame, heads_only: bool = False) -> DataFrame:
    """x, y: pairs across components that may link, of sets that were compared with one leader; each set only with its lists' smallest
    members if ``heads_only``.

    Across components one of two sets, x, is outside the leader's component and so has w > P; if both are, x is the one with the larger
    weight. A set y of the leader's component may have any weight, also a larger one than x, as it may have joined over a third set.
    """
    c = F.col
    named = lambda k: parts.select(c("id").alias(k), c("component").alias(f"{k}_part"))
    rows = group.join(named("low"), "low", "left").join(named("id"), "id", "left")
    rows = rows.select("low", "id", "w", "p", "k", "delta", F.coalesce("id_part", "id").alias("part"), F.coalesce("low_part", "low").alias("low_part"))
    inside = c("part") == c("low_part")
    early = lambda n, at: F.posexplode(F.slice("delta", F.lit(1), F.greatest(n, F.lit(0)).cast("int"))).alias(at, "token")
    probe = rows.filter(~inside & (c("w") > c("p"))).select("low", c("id").alias("x"), c("w").alias("wx"), "p", c("part").alias("cx"), c("k").alias("kx"), early(_probed(), "ax"))
    index = rows.select("low", c("id").alias("y"), c("w").alias("wy"), c("part").alias("cy"), c("k").alias("ky"), inside.alias("inside"), early(_listed(inside), "ay"))
    if heads_only:
        index = index.groupBy("low", "token").agg(F.min(F.struct("y", "wy", "cy", "ky", "inside", "ay")).alias("head")).select("low", "token", "head.*")
    least = F.ceil((c("wx") + c("wy") - c("p")) / 9)
    later = c("inside") | (c("wx") > c("wy")) | ((c("wx") == c("wy")) & (c("x") < c("y")))
    return probe.join(index, ["low", "token"]).filter(later & (c("cx") != c("cy")) & (c("ax") + least <= c("kx")) & (c("ay") + least <= c("ky"))).select("x", "y")


def regrouped(group: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of leaders that are in another component than before, or have a set that is. All other leaders would give the same pairs again."""
    was = before.select("id", F.col("component").alias("was"))
    moved = stored(after.join(was, "id", "left").filter(F.coalesce("was", "id") != F.col("component")).select("id"), "moved")
    of_sets = group.select("low", "id").join(moved, "id", "left_semi").select("low")
    themselves = group.select("low").distinct().join(moved.withColumnRenamed("id", "low"), "low", "left_semi")
    return group.join(stored(of_sets.union(themselves).distinct(), "moved-leaders"), "low", "left_semi")


def is_link() -> Column:
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return F.col("common") * SIMILAR[1] >= union * SIMILAR[0]


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    component_id is the smallest doc_id reachable by links. Null, empty and wordless texts have no shingles and link with nothing. Rows of
    one doc_id are one node: it has the links of all its texts. A row without doc_id has no component and links nothing. Equal rows give
    equal results. An empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(token_sketch(texts.select("text")))
    rows = cut(prefixes(texts, sent))
    named = rows.filter("doc_id is not null and digest is not null")
    # what is summed by a key is stored before it is joined by that key: then both sides are shuffled, and Spark may split large partitions
    classes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("members")), "classes")
    met = cut(index_lists(index_entries(named, classes)))
    c = F.col
    below = met.filter((c("id") > c("low")) & may_link(c("n"), c("at"), c("low_n"), c("low_at"))).select(c("low").alias("a"), c("id").alias("b"))
    above = met.filter((c("id") < c("high")) & may_link(c("n"), c("at"), c("high_n"), c("high_at"))).select(c("id").alias("a"), c("high").alias("b"))
    first = cut(plausible(below.union(above).distinct(), named, LEAD))
    texts_by_id = texts.filter("doc_id is not null")
    known = cut(compared(texts_by_id, first, sent))
    parts = stored(components(known.filter(is_link()).select("a", "b")), "parts")
    joined = lambda: parts.select(c("id").alias("a"), c("component").alias("b"))
    ordered = lambda pairs: pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    # sets that no leader joined meet the smallest member of each list of what sets them apart from a leader, until that joins nothing more
    group = leader_rows(known)
    seen, now = first, group
    while True:
        fresh = cut(plausible(ordered(through_leaders(now, parts, heads_only=True)).join(seen, ["a", "b"], "left_anti"), named))
        if fresh.isEmpty():
            break
        seen = seen.union(fresh)
        met_now = cut(compared(texts_by_id, fresh, sent).filter(is_link()).select("a", "b"))
        if met_now.isEmpty():
            break
        before, parts = parts, stored(components(joined().union(met_now)), "parts")
        now = regrouped(group, before, parts)

    # answer skipping: across components only; pairs compared with a common leader by their deltas, others by their places in the list
    placed = met.select("token", "id", "n", "at", "low", "high").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = stored(placed.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("token"), "mixed-lists")
    # pairs that bits ruled out have no deltas
    with_low = first.select(c("a").alias("low"), c("b").alias("id"), F.lit(True).alias("by_low"))
    with_high = first.select(c("a").alias("id"), c("b").alias("high"), F.lit(True).alias("by_high"))
    open_rows = placed.join(mixed, "token").join(with_low, ["low", "id"], "left").join(with_high, ["high", "id"], "left")
    by = [(F.coalesce(f"by_{k}", F.lit(False)) | (c("id") == c(k))).alias(f"by_{k}") for k in ("low", "high")]
    open_rows = cut(open_rows.select("token", "id", "n", "at", "component", *by))
    grow = math.log(BLOCK_GROWTH)
    block = lambda size: F.floor(F.log(size.cast("double")) / grow).cast("int")
    num, den = SIMILAR
    # a set of size m <= n that meets this entry first at its place needs min(m, n - at) >= overlap: m is at most (n - at) * (num + den) / num - n
    most = F.least(F.col("n").cast("double"), (F.col("n") - F.col("at")) * (num + den) / num - F.col("n"))
    fewest = F.ceil(F.col("n") * num / den)
    index = open_rows.filter(most >= fewest).select("token", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("component").alias("cy"), F.col("by_low").alias("ly"), F.col("by_high").alias("hy"), F.explode(F.sequence(block(fewest), block(most))).alias("block"))
    probe = open_rows.select("token", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("component").alias("cx"), F.col("by_low").alias("lx"), F.col("by_high").alias("hx"), block(F.col("n")).alias("block"))
    unseen = probe.join(index, ["token", "block"]).filter(~((c("lx") & c("ly")) | (c("hx") & c("hy"))) & (c("cx") != c("cy")) & ((c("nx") < c("ny")) | ((c("nx") == c("ny")) & (c("x") < c("y")))) & may_link(c("nx"), c("ax"), c("ny"), c("ay")))
    crossing = unseen.select("x", "y").union(through_leaders(group, parts))
    rest = cut(plausible(ordered(crossing).join(seen, ["a", "b"], "left_anti"), named))
    links = joined()
    if not rest.isEmpty():
        links = links.union(compared(texts_by_id, rest, sent).filter(is_link()).select("a", "b"))
    # rows of one id, and members of one class, are tied without comparison
    ties = named.select("doc_id", "digest").join(classes.filter("members > 1"), "digest").filter("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    whole = components(links.union(ties))
    sent.unpersist()
    return rows.join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, and rows without doc_id."""
    keep = linked(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


def op2_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))


QUERIES = {"op2_set_join": (op2_set_join, None)}
