"""Ranked lexical search with hashed max-sketches.

A document's sketch has a fixed number of coordinates. Each of its terms is hashed to one of them and gives its impact (what a query term
of weight 1 would add to the score), rounded up to a level of one byte; a coordinate holds the largest level. For a query, its weights times
the levels at its terms' coordinates add up to an upper bound of the score, and a block of queries is looked up in all sketches of a slice
of documents by one product of matrices.

Documents are then scored exactly in order of descending bounds, a few for each query at a time, until no bound left reaches the score of
the k-th best so far; the best are carried from slice to slice, so that the threshold rises as a task reads on. Each task passes on its k best
for each query, and the best of all tasks are the result. Texts do not move, and no document above the threshold is left out: a bound is
never below the score, and equal scores are compared by id.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.llm.common import cut, documents, filled, map_arrow, raw, slices, word_hashes

TOP = 10
SKETCH_BITS = 11
#: Impacts are below 1,000,000; a level stands for this much.
LEVEL = 4096
#: Bytes of item texts that are searched for at once; a longer item is a block of its own.
BLOCK_BYTES = 1 << 17
#: Documents scored exactly for each query before its threshold is looked at again.
ROUND = 12
#: Bounds (documents times items) that are held at once; short documents come in several lots.
CELLS = 1 << 21
#: Rows without an id stand after all others.
LAST = (1 << 63) - 1
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_part(words: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * words * n) div total, exact also where the product leaves 64 bits."""
    if len(words) and int(words.max()) * 75 * n >= 1 << 62:
        return np.array([25 + 75 * int(w) * n // total for w in words], np.int64)
    return 25 + 75 * words.astype(np.int64) * n // max(total, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def postings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; then text, term hash (ascending inside a text) and occurrences of each distinct term."""
    hashed, owner, _, _, _ = word_hashes(texts, "alnum")
    words = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    order = np.lexsort((hashed, owner))
    h, o = hashed[order], owner[order]
    fresh = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
    return words, o[fresh], h[fresh], np.diff(fresh, append=len(h))


def sketches(docs: int, owner: np.ndarray, hashed: np.ndarray, impacts: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """One row of 2**bits levels for each document: the largest impact of the terms at a coordinate, rounded up. Terms come in the order of ``postings``."""
    out = np.zeros((docs, 1 << bits), np.uint8)
    place = owner.astype(np.int64) << bits | (hashed >> np.uint64(64 - bits)).astype(np.int64)
    start = np.flatnonzero(np.diff(place, prepend=-1))
    if len(start):
        out.reshape(-1)[place[start]] = np.maximum.reduceat(-(-impacts // LEVEL), start)
    return out


class Queries:
    """A block of items: their terms (hashes), and after ``weigh`` the terms' weights."""

    def __init__(self, texts: list[str]):
        counts = [Counter(_TERM.findall(t.encode().lower())) for t in texts]
        words = sorted({w for c in counts for w in c})
        hashed = word_hashes([b" ".join(words)], "alnum")[0]
        order = np.argsort(hashed)
        number = {words[k]: n for n, k in enumerate(order.tolist())}
        self.terms = hashed[order]
        self.of = [np.array([number[w] for w in c], np.int64) for c in counts]
        self.times = [np.array(list(c.values()), np.int64) for c in counts]

    def weigh(self, n: int, total: int, df: np.ndarray, bits: int = SKETCH_BITS) -> Queries:
        self.n, self.total, self.bits = n, total, bits
        w = np.array([term_weight(n, int(x)) for x in df], np.int64)
        self.weights = [w[of] * times for of, times in zip(self.of, self.times, strict=True)]
        at = (self.terms >> np.uint64(64 - bits)).astype(np.int64)
        self.used, where = np.unique(at, return_inverse=True)
        self.matrix = np.zeros((len(self.used), len(self.of)), np.float32)
        for k, (of, weights) in enumerate(zip(self.of, self.weights, strict=True)):
            np.add.at(self.matrix[:, k], where[of], weights)
        return self


class Search:
    """The best documents of each query over the slices read so far."""

    def __init__(self, queries: Queries, top: int):
        self.q, self.top = queries, top
        self.score = [np.empty(0, np.int64) for _ in queries.of]
        self.id = [np.empty(0, np.int64) for _ in queries.of]
        self.least = np.ones(len(queries.of))  # a bound below it is not looked at
        self.scored = 0

    def read(self, texts: list[bytes], ids: np.ndarray) -> None:
        lot = max(1, CELLS // max(1, len(self.q.of)))
        for a in range(0, len(texts), lot):
            self._read(texts[a : a + lot], ids[a : a + lot])

    def _read(self, texts: list[bytes], ids: np.ndarray) -> None:
        q = self.q
        words, owner, hashed, tf = postings(texts)
        at = np.searchsorted(q.terms, hashed)
        met = np.flatnonzero(q.terms[np.minimum(at, len(q.terms) - 1)] == hashed)
        if not len(met):  # coordinates may be shared and bounds above 0, but every score is 0
            return
        got = impact(tf, length_part(words, q.n, q.total)[owner])
        table = sketches(len(texts), owner, hashed, got, q.bits)
        # in single precision; the margin is far above what rounding can take away
        bound = (table[:, q.used].astype(np.float32) @ q.matrix) * np.float32(LEVEL * (1 + 1e-4))
        key, value = owner[met].astype(np.int64) * len(q.terms) + at[met], got[met]
        while True:
            docs, which = self._next(bound)
            if not len(docs):
                return
            bound[docs, which] = -1
            self._keep(which, self._exact(docs, which, key, value), ids[docs])

    def _next(self, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the documents with the highest bounds, of those that reach its threshold."""
        some = np.flatnonzero((bound >= self.least).any(axis=0))
        part = bound[:, some]
        if len(part) > ROUND:
            rows = np.argpartition(part, len(part) - ROUND, axis=0)[-ROUND:]
        else:
            rows = np.repeat(np.arange(len(part))[:, None], len(some), axis=1)
        which = np.broadcast_to(some, rows.shape)
        keep = bound[rows, which] >= self.least[which]
        return rows[keep], which[keep]

    def _exact(self, docs: np.ndarray, which: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        self.scored += len(docs)
        out = np.zeros(len(docs), np.int64)
        order = np.argsort(which, kind="stable")
        edges = np.flatnonzero(np.diff(which[order], prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:b]
            q = int(which[rows[0]])
            want = docs[rows].astype(np.int64)[:, None] * len(self.q.terms) + self.q.of[q][None, :]
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            out[rows] = (np.where(key[at] == want, value[at], 0) * self.q.weights[q][None, :]).sum(axis=1)
        return out

    def _keep(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(which, kind="stable")
        edges = np.flatnonzero(np.diff(which[order], prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:b]
            q = int(which[rows[0]])
            rows = rows[score[rows] > 0]
            s, i = np.concatenate([self.score[q], score[rows]]), np.concatenate([self.id[q], ids[rows]])
            best = np.lexsort((i, -s))[: self.top]
            self.score[q], self.id[q] = s[best], i[best]
            if len(best) == self.top:
                self.least[q] = s[best[-1]]


def _statistics(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each of ``terms``. Each task sums before anything moves."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        n = np.zeros(len(sent.value) + 2, np.int64)
        for part in slices(batches, "text"):
            words, _, hashed, _ = postings(raw(part.column("text")))
            n[0] += np.count_nonzero(words)
            n[1] += words.sum()
            if len(sent.value):
                at = np.minimum(np.searchsorted(sent.value, hashed), len(sent.value) - 1)
                n[2:] += np.bincount(at[sent.value[at] == hashed], minlength=len(sent.value))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["slot", "n"])

    out = np.zeros(len(terms) + 2, np.int64)
    for r in map_arrow(docs.select("text"), run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # as many rows as a block has terms
        out[r.slot] = r.n
    return int(out[0]), int(out[1]), out[2:]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           block_bytes: int = BLOCK_BYTES, bits: int = SKETCH_BITS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest positive scores for every item, equal scores by ascending doc_id.

    Null and wordless texts have no terms: such documents count nowhere, such items find nothing. Every row of ``docs`` is a document and every
    row of ``items`` an item, also if ids repeat; documents without id come after others of the same score. Items are searched for in blocks of bounded size,
    each by one pass over ``docs`` for the counts and one for the search. Empty tables give no rows.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length(filled(item_text)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = items.select(F.col(item_id).alias("item_id"), filled(item_text).alias("text"))
    if blocks > 1:  # every block is read back, so rows must not change places in between
        texts = cut(texts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), blocks)))
    sent_docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), filled(text).alias("text"))
    out = None
    for b in range(blocks):
        rows = (texts.filter(F.col("block") == b) if blocks > 1 else texts).select("item_id", "text").collect()  # about ``block_bytes``
        queries = Queries([r.text for r in rows])
        if not len(queries.terms):
            continue
        queries = queries.weigh(*_statistics(sent_docs, queries.terms), bits)
        sent = spark.sparkContext.broadcast(queries)

        def run(batches, sent=sent):
            search = Search(sent.value, top)
            for part in slices(batches, "text"):
                search.read(raw(part.column("text")), part.column("doc_id").to_numpy())
            item = np.repeat(np.arange(len(search.id)), [len(x) for x in search.id])
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(np.concatenate([*search.id, np.empty(0, np.int64)])), pa.array(np.concatenate([*search.score, np.empty(0, np.int64)]))], ["item", "doc_id", "score"])

        order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")  # at most ``top`` rows of a task for an item
        best = map_arrow(sent_docs, run, "item int, doc_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], f"item int, item_id {kind}")
        part = best.join(names, "item").select("item_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")
        if blocks > 1:
            part = cut(part)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::bigint AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::bigint AS total FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM f, s GROUP BY term, docs),
p AS (SELECT item_id, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::bigint AS score
  FROM i JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
QUERIES = {"op11_lexical_search": (op11_lexical_search, SQL)}
