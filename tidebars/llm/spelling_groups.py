"""Spelling variants by k-d trees over letter-count vectors.

Words are counted map-side, then over all documents. Two words that differ by one inserted, deleted or replaced code point have letter counts
at L1 distance two at most: for words of one length at most one letter is one up and at most one is one down; if one word is longer by one,
only one letter is one up. So each length has a k-d tree over letter counts (letters share 32 bins, which keeps these bounds), and a word
visits the leaves whose boxes its counts allow, in the tree of its own length and in that of words one shorter.

The trees that spread words over tasks are cut from a bounded sample of words; that decides balance only. A leaf with more words than
``PIECE_WORDS`` is cut into pieces, and every visitor goes to each piece. Inside a piece its words form a k-d tree again, searched by all
visitors at once; what is left is compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import _powers, cut, documents, filled, map_arrow, mix, raw, slices, stored

LEAST_CHARS, LEAST_COUNT, RATIO, MARK = 5, 3, 2, 97
BINS = 32
#: Words that decide where the spreading trees are cut.
SAMPLE = 40_000
#: Words that a leaf of a spreading tree should hold, and that a piece of it holds at most on average.
LEAF_WORDS, PIECE_WORDS = 4096, 16_384
#: Words in a leaf of the trees inside a piece, and visitors that search them at once.
SMALL_LEAF, VISITORS = 48, 1 << 16
#: Distinct words that a task sums up before it passes them on.
HELD_WORDS = 500_000


# --- counting ---------------------------------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def runs(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, A-Z in lower case, and of every run of letters: text number, start, end and hash."""
    data = (b"\n".join(texts) + b"\n").lower()
    at = np.frombuffer(data, np.uint8)
    lead = at == 0xC3  # code points from U+00C0 to U+00FF are this byte and one more
    inside = ((at >= 97) & (at <= 122)) | lead
    inside[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(at) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((at.astype(np.uint64) + np.uint64(1)) * up[: len(at)], dtype=np.uint64)])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, np.searchsorted(first, start, side="right") - 1, start, end, hashed


def marks(data: bytes, start: np.ndarray, end: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """CRC-32 of each run after a prefix, whose CRC-32 is given."""
    at, table = np.frombuffer(data, np.uint8), _crc_table()
    order = np.argsort(start - end, kind="stable")  # the longest first, so that those that go on stand in front
    here, size = start[order], (end - start)[order]
    crc = prefix[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    step, n = 0, len(order)
    while n:
        crc[:n] = table[(crc[:n] ^ at[here[:n] + step]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
        step += 1
        n = int(np.searchsorted(-size, -step, side="left"))
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def counted(texts: list[bytes], ids: list[int | None]) -> dict[bytes, int]:
    """Occurrences of the words of some texts, with one code point deleted where the mark says so."""
    data, owner, start, end, hashed = runs(texts)
    prefix = np.array([zlib.crc32(b"" if i is None else b"%d:" % i) for i in ids], np.uint32)
    crc = marks(data, start, end, prefix[owner])
    marked = (crc % MARK == 0) & np.array([i is not None for i in ids], bool)[owner]
    out: dict[bytes, int] = defaultdict(int)
    for k in np.flatnonzero(marked).tolist():
        word = data[start[k] : end[k]].decode()
        cut_at = int(crc[k]) % len(word)
        out[(word[:cut_at] + word[cut_at + 1 :]).encode()] += 1
    rest = np.flatnonzero(~marked)
    _, where, n = np.unique(hashed[rest], return_index=True, return_counts=True)
    for a, b, m in zip(start[rest[where]].tolist(), end[rest[where]].tolist(), n.tolist(), strict=True):
        out[data[a:b]] += m
    return {w: m for w, m in out.items() if len(w) >= LEAST_CHARS and (len(w) >= 2 * LEAST_CHARS or len(w.decode()) >= LEAST_CHARS)}


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least five code points and ``least_count`` occurrences."""

    def run(batches):
        total: dict[bytes, int] = defaultdict(int)

        def out():
            words = pa.array(list(total), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()

        for part in slices(batches, "text"):
            for w, m in counted(raw(part.column("text")), part.column("doc_id").to_pylist()).items():
                total[w] += m
            if len(total) > HELD_WORDS:
                yield from out()
        yield from out()

    rows = map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- trees ------------------------------------------------------------------------------------------------------------


def bins(code: np.ndarray) -> np.ndarray:
    """The bin of each letter: one for each of a-z, six for the others."""
    return np.where(code < 128, code - 97, 26 + code % 6)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (one row for each word, all of one length) and letter counts by bin, 255 at most."""
    n, size = len(words), len(words[0]) if words else 0
    code = np.array(words, dtype=f"U{max(size, 1)}").view(np.uint32).reshape(n, max(size, 1)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * BINS + bins(code)).ravel(), minlength=n * BINS).reshape(n, BINS)
    return code.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)


def best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The bin and count that part the rows most evenly (count or less, more); None if all rows are equal."""
    n = len(counts)
    best = None
    for t in range(4):
        more = np.count_nonzero(counts > t, axis=0)
        k = int(np.abs(2 * more - n).argmin())
        if 0 < more[k] < n and (best is None or abs(2 * int(more[k]) - n) < best[0]):
            best = (abs(2 * int(more[k]) - n), k, t)
    if best is None:
        spread = counts.max(axis=0) > counts.min(axis=0)
        if not spread.any():
            return None
        k = int(spread.argmax())
        return k, int(counts[:, k].min())
    return best[1:]


def grown(counts: np.ndarray, leaf: float) -> list:
    """A k-d tree as [bin, count, left, right] or, for a leaf, [number]. Leaves hold at most ``leaf`` rows unless these are equal."""
    number = iter(range(1 << 62))

    def node(rows):
        place = best_cut(rows) if len(rows) > leaf else None
        if place is None:
            return [next(number)]
        right = rows[:, place[0]] > place[1]
        return [*place, node(rows[~right]), node(rows[right])]

    return node(counts)


def visits(tree: list, counts: np.ndarray, up: int, down: int) -> list[tuple[np.ndarray, int]]:
    """Rows and the leaf, for each leaf whose box holds a vector that has at most ``up`` letters more and ``down`` fewer than the row."""
    out = []
    low, high = np.zeros(BINS, np.int16), np.full(BINS, 255, np.int16)

    def go(node, rows, more, fewer):
        # more: by how much the box forces letters up; fewer: by how much it forces letters down
        if not len(rows):
            return
        if len(node) == 1:
            out.append((rows, node[0]))
            return
        k, t, left, right = node
        have = counts[rows, k].astype(np.int16)
        was = int(high[k])
        if t < was:
            forced = fewer + np.maximum(have - t, 0) - np.maximum(have - was, 0)
            keep = forced <= down
            high[k] = t
            go(left, rows[keep], more[keep], forced[keep])
            high[k] = was
        else:
            go(left, rows, more, fewer)
        was = int(low[k])
        if t + 1 > was:
            forced = more + np.maximum(t + 1 - have, 0) - np.maximum(was - have, 0)
            keep = forced <= up
            low[k] = t + 1
            go(right, rows[keep], forced[keep], fewer[keep])
            low[k] = was
        else:
            go(right, rows, more, fewer)

    zero = np.zeros(len(counts), np.int16)
    go(tree, np.arange(len(counts)), zero, zero)
    return out


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of code points of one length that differ in exactly one place."""
    return np.count_nonzero(a != b, axis=1) == 1


def one_deleted(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Rows of ``long`` that become the row of ``short`` by one deletion: its beginning and its end agree and cover it."""
    size = short.shape[1]
    front = np.cumprod(long[:, :size] == short, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((long[:, 1:] == short)[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return front + back >= size


class Piece:
    """Words of one length with a k-d tree, searched by visitors of that length or one more."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n, self.size = words, n, len(words[0])
        self.code, self.counts = letters(words)
        self.parity = self._parity(self.counts)
        self.tree = grown(self.counts, SMALL_LEAF)
        self.leaves = {leaf: rows for rows, leaf in visits(self.tree, self.counts, 0, 0)}

    @staticmethod
    def _parity(counts: np.ndarray) -> np.ndarray:
        return np.packbits(counts & 1, axis=1).view(np.uint32).ravel()

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Visitor and word numbers of all near pairs. Of words of one length each pair is found from the smaller word only."""
        code, counts = letters(words)
        parity = self._parity(counts)
        same = code.shape[1] == self.size
        xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for rows, leaf in visits(self.tree, counts, 1 if same else 0, 1):
            mine = self.leaves[leaf]
            step = max(1, (1 << 20) // len(mine))
            for a in range(0, len(rows), step):
                x, y = np.nonzero(np.bitwise_count(parity[rows[a : a + step]][:, None] ^ self.parity[mine][None, :]) <= (2 if same else 1))
                x, y = rows[a : a + step][x], mine[y]
                for b in range(0, len(x), limit := max(1, (1 << 21) // self.size)):
                    i, j = x[b : b + limit], y[b : b + limit]
                    hit = one_replaced(code[i], self.code[j]) if same else one_deleted(code[i], self.code[j])
                    xs.append(i[hit])
                    ys.append(j[hit])
        x, y = np.concatenate(xs), np.concatenate(ys)
        if same:
            keep = [words[i] < self.words[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)]
            x, y = x[keep], y[keep]
        return x, y


# --- the search over all words ----------------------------------------------------------------------------------------


def spreading_trees(words: DataFrame, sample: int, leaf_words: int) -> dict[int, list]:
    """A tree for each length that occurs among ``sample`` words (the first by hash); other lengths have one leaf."""
    total = words.count()
    few = [r.word for r in words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()]
    by_length = defaultdict(list)
    for w in few:
        by_length[len(w)].append(w)
    share = leaf_words * len(few) / max(total, 1)
    return {size: grown(letters(ws)[1], max(share, 2)) for size, ws in by_length.items()}


def near_pairs(words: DataFrame, sample: int = SAMPLE, leaf_words: int = LEAF_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """word, n, other, other_n for each ordered pair of near words among ``words`` (word, n; distinct, stored)."""
    trees = words.sparkSession.sparkContext.broadcast(spreading_trees(words, sample, leaf_words))
    plain = [0]

    def placed(batches, homes_only: bool):
        for batch in batches:
            given = batch.column("word").to_pylist()
            by_length = defaultdict(list)
            for k, w in enumerate(given):
                by_length[len(w)].append(k)
            for size, at in by_length.items():
                step = max(1, (1 << 21) // size)
                for s in range(0, len(at), step):
                    some = np.array(at[s : s + step])
                    counts = letters([given[k] for k in some.tolist()])[1]
                    searches = [(0, size, 0, 0)] if homes_only else [(0, size, 0, 0), (1, size, 1, 1), (2, size - 1, 0, 1)]
                    for kind, tree, up, down in searches:
                        for rows, leaf in visits(trees.value.get(tree, plain), counts, up, down):
                            n = len(rows)
                            cell = np.full(n, (tree << 24) | leaf, np.int64)
                            if homes_only:
                                yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])
                            else:
                                taken = batch.take(pa.array(some[rows]))
                                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(n, kind, np.int32)), taken.column("word"), taken.column("n")], ["cell", "kind", "word", "n"])

    # cells are as many as leaves, whose number is bounded by the sample and the lengths of words
    homes = map_arrow(words.select("word"), lambda b: placed(b, True), "cell long").groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > piece_words)
    large = stored(homes.select("cell", F.ceil(F.col("m") / piece_words).cast("int").alias("pieces")), "large-leaves")
    rows = map_arrow(words.select("word", "n"), lambda b: placed(b, False), "cell long, kind int, word string, n long").join(large, "cell", "left")
    pieces = F.coalesce("pieces", F.lit(1))
    own = F.pmod(F.xxhash64("word"), pieces).cast("int")
    # a word of the leaf lies in one piece; a visitor sees all
    at = F.when(F.col("kind") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), pieces - 1))
    rows = rows.withColumn("piece", F.explode(at)).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "kind")

    def search(batches):
        here, homes, waiting, piece = None, ([], []), ([], []), None

        def found():
            if not homes[0] or not waiting[0]:
                return
            nonlocal piece
            piece = piece or Piece(*homes)
            by_length = defaultdict(list)
            for k, w in enumerate(waiting[0]):
                by_length[len(w)].append(k)
            for at in by_length.values():
                x, y = piece.near([waiting[0][k] for k in at])
                x = np.array(at)[x] if len(x) else x
                a, na = [waiting[0][k] for k in x.tolist()], [waiting[1][k] for k in x.tolist()]
                b, nb = [piece.words[k] for k in y.tolist()], [piece.n[k] for k in y.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(na + nb, pa.int64()), pa.array(b + a, pa.string()), pa.array(nb + na, pa.int64())], ["word", "n", "other", "other_n"])

        for batch in batches:
            cell, part, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "piece", "kind"))
            edges = np.flatnonzero((np.diff(cell, prepend=cell[:1] - 1) != 0) | (np.diff(part, prepend=part[:1]) != 0)).tolist() if len(cell) else []
            for a, b in zip(edges, [*edges[1:], len(cell)], strict=True):
                if (cell[a], part[a]) != here:
                    yield from found()
                    here, homes, waiting, piece = (cell[a], part[a]), ([], []), ([], []), None
                middle = a + int(np.searchsorted(kind[a:b], 0, side="right"))
                for to, lo, hi in ((homes, a, middle), (waiting, middle, b)):
                    to[0].extend(batch.column("word").slice(lo, hi - lo).to_pylist())
                    to[1].extend(batch.column("n").slice(lo, hi - lo).to_pylist())
                if len(waiting[0]) >= VISITORS:
                    yield from found()
                    waiting = ([], [])
        yield from found()

    return map_arrow(rows.select("cell", "piece", "kind", "word", "n"), search, "word string, n long, other string, other_n long")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, leaf_words: int = LEAF_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word.

    Null and empty texts have no words. Repeated rows count again. Rows without doc_id count with their runs as they are: a mark is made from a
    doc_id. Of near words with equal counts the smallest in code-point order is the form. Counts at least double from a word to its form, so
    the forms make trees, and roots are found by doubling: after k rounds a word knows the word 2**k forms away. An empty table gives no rows.
    """
    words = stored(vocabulary(docs, doc_id, text), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words, sample, leaf_words, piece_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    form_n = -F.col("best.less")
    good = F.coalesce(form_n >= RATIO * F.col("n"), F.lit(False))
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, form_n).cast("long").alias("form_n")))
    way = stored(rows.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = stored(way.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if way.filter("moved").isEmpty():
            break
        way = way.select("word", "root")
    return rows.join(way.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


QUERIES = {"op13_spelling_groups": (op13_spelling_groups, None)}
