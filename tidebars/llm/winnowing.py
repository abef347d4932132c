"""Benchmark decontamination by winnowing.

Of every six consecutive five-word hashes the smallest is a fingerprint, so any span of ten words that a document shares with a benchmark
item has a fingerprint in common with it. Documents' fingerprints first pass a bit array of the items' fingerprints (its size is a
parameter, 2 MB, whatever the benchmark holds), then those left are joined with the items' fingerprints. Each side of the join carries
the words around its fingerprint, and a hit is extended through them and counts only where a whole window agrees word by word. So
documents are read once, and their texts are never shuffled. Items shorter than ten words are one window; their whole-text hash is
looked up among the documents' runs of as many words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import NO_ID, bit_filter, cut, documents, filled, grams, map_arrow, passes, raw, row_key, slices, stored, word_hashes

WINDOW = 10
GRAM = 5
FILTER_BITS = 24

_ANCHOR = "array<struct<h:long,size:int,at:long,back:int,words:string>>"
_ANCHOR_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("back", pa.int32()), ("words", pa.string())]))


def winnowed(hashed: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Places (in ``hashed``) that are the smallest of some ``width`` consecutive hashes of one text; the last of equal ones."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, place = hashed[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = hashed[j : j + n]
        less = other <= best
        best[less] = other[less]
        place[less] += (np.arange(n)[less] + j) - place[less]
    whole = owner[at[:n]] == owner[at[width - 1 : width - 1 + n]]
    return np.unique(place[whole])


def anchors(texts: list[bytes], window: int, gram: int, short: list[int], whole_only: bool, keep=None) -> tuple[list[list[tuple]], list[int]]:
    """For each text its fingerprints (hash, window size, first word, words carried before it, the words around it), and its word count.

    Items (``whole_only``) of fewer words than ``window`` give their whole text; documents give every run of the lengths in ``short``.
    """
    hashed, owner, start, end, low = word_hashes(texts, "alnum")
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    data = low.tobytes()
    out: list[list[tuple]] = [[] for _ in texts]

    def add(h: int, size: int, word: int, before: int, after: int) -> None:
        t = owner[word]
        a, b = max(bounds[t], word - before), min(bounds[t + 1], word + after)
        words = b" ".join(data[start[i] : end[i]] for i in range(a, b)).decode("utf-8", "replace")
        out[t].append((h, size, int(word - bounds[t]), int(word - a), words))

    g, at = grams(hashed, owner, gram)
    chosen = winnowed(g, at, owner, window - gram + 1)
    if keep is not None:
        chosen = chosen[keep(g[chosen])]
    for i in chosen.tolist():
        add(int(g[i].view(np.int64)), window, int(at[i]), window - gram, window)
    if whole_only:
        short = [n for n in np.unique(np.diff(bounds)).tolist() if 0 < n < window]
    for n in short:
        g, at = grams(hashed, owner, n)
        g = g ^ np.uint64(n)  # a run of n words is another thing than a fingerprint
        at_end = np.diff(bounds)[owner[at]] == n if whole_only else np.ones(len(at), bool)
        if keep is not None:
            at_end &= keep(g)
        for i in np.flatnonzero(at_end).tolist():
            add(int(g[i].view(np.int64)), n, int(at[i]), 0, n)
    return out, np.diff(bounds).tolist()


def _same(size: int, back_a: int, words_a: str, back_b: int, words_b: str) -> tuple[int, int] | None:
    """The agreeing words around two fingerprints, as first and past-last place from the fingerprint; None if under ``size``."""
    a, b = words_a.split(" "), words_b.split(" ")
    if a[back_a : back_a + 1] != b[back_b : back_b + 1]:
        return None
    left = right = 0
    while left < min(back_a, back_b) and a[back_a - left - 1] == b[back_b - left - 1]:
        left += 1
    while right < min(len(a) - back_a, len(b) - back_b) and a[back_a + right] == b[back_b + right]:
        right += 1
    return (-left, right) if left + right >= size else None


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated, k1 and k2 (row_key).

    Words are runs of letters, digits and any non-ASCII characters, A-Z in lower case. A null or wordless text or item has no words and
    hits nothing. Rows that share doc_id and text have the same result. A repeated item_id counts once. Empty tables are allowed.
    """
    texts = items.select(F.col(item_id).cast("string").alias("item_id"), filled(item_text).alias("text"))

    def item_rows(batches):
        for part in slices(batches, "text"):
            found, _ = anchors(raw(part.column("text")), window, gram, [], True)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(found, _ANCHOR_TYPE)], ["item_id", "anchors"])

    marks = stored(map_arrow(texts, item_rows, f"item_id string, anchors {_ANCHOR}").select("item_id", F.explode("anchors").alias("i"))
                   .select("item_id", "i.h", "i.size", F.col("i.back").alias("i_back"), F.col("i.words").alias("i_words")).distinct(), "item-marks")
    words = bit_filter(marks, "h", filter_bits)
    short = sorted(r.size for r in marks.filter(F.col("size") < window).select("size").distinct().collect())  # at most window - 1 rows

    def doc_rows(batches):
        for part in slices(batches, "text"):
            found, n = anchors(raw(part.column("text")), window, gram, short, False, lambda h: passes(words, h, filter_bits))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "doc_id")), pa.array(n, pa.int64()), pa.array(found, _ANCHOR_TYPE)], ["k1", "k2", "doc_id", "n_words", "anchors"])

    keyed = docs.select(*row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text"))
    rows = cut(map_arrow(keyed, doc_rows, f"k1 long, k2 long, doc_id long, n_words long, anchors {_ANCHOR}"))
    near = rows.select("k1", "k2", F.explode("anchors").alias("d")).select("k1", "k2", "d.h", "d.size", "d.at", F.col("d.back").alias("d_back"), F.col("d.words").alias("d_words"))
    pairs = near.join(marks, ["h", "size"]).select("k1", "k2", "at", "item_id", "size", "d_back", "d_words", "i_back", "i_words")

    def extend(batches):
        for part in batches:
            p = part.to_pydict()
            got = [_same(*x) for x in zip(p["size"], p["d_back"], p["d_words"], p["i_back"], p["i_words"], strict=True)]
            hit = [i for i, x in enumerate(got) if x]
            at = [p["at"][i] + got[i][0] for i in hit]
            upto = [p["at"][i] + got[i][1] for i in hit]
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(hit, pa.int64())) for c in ("k1", "k2", "item_id")] + [pa.array(at, pa.int64()), pa.array(upto, pa.int64())], ["k1", "k2", "item_id", "a", "b"])

    spans = map_arrow(pairs, extend, "k1 long, k2 long, item_id string, a long, b long")
    # the sets are bounded by the words of one document and the items found in it
    hits = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    covered = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
                          lambda s, x: F.struct((s.n + F.greatest(x.b - F.greatest(x.a, s.to), F.lit(0))).alias("n"), F.greatest(s.to, x.b).alias("to"))).n
    hits = hits.select("k1", "k2", covered.alias("n_hit"), "item_ids")
    none = F.array().cast("array<string>")
    return rows.drop("anchors").join(hits, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark window hits. Only the keys of hit documents, stored with their size known, meet the texts."""
    bad = stored(contamination(docs, items).filter("contaminated").select("k1", "k2").distinct(), "contaminated")
    keyed = docs.withColumns({"_k1": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "_k2": F.xxhash64(filled("text"))})
    return keyed.join(bad, (F.col("_k1") == bad.k1) & (F.col("_k2") == bad.k2), "left_anti").drop("_k1", "_k2")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
QUERIES = {"op8_winnowing": (op8_winnowing, SQL)}
