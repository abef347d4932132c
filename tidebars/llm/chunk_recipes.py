"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so: a hash of the last eight bytes falls under a threshold. Each chunk has an identifier, and a
text's recipe is the ordered list of its chunks' identifiers. Identifiers are verified first: every chunk's bytes are moved once, to the
task of their identifier, and an identifier that stands for two contents makes the run go on with wider ones. After that only recipes
(16 bytes for about 4 KB of text) are compared and moved, never documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import cut, documents, filled, map_arrow, raw, slices, stored

#: Bytes of an identifier, tried in this order until all are verified.
WIDTHS = (16, 32, 64)
LEAST, MEAN, MOST = 1024, 4096, 32768


def cuts(texts: list[bytes], least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each text. They depend on the text's own bytes alone; an empty text has no chunk."""
    joined = b"".join(texts)
    marks = np.empty(0, np.int64)
    if len(joined) > 8:
        last8 = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
        marks = np.flatnonzero(last8 * np.uint64(0x9E3779B97F4A7C15) < np.uint64((1 << 64) // mean)) + 8
    out, at = [], 0
    for text in texts:
        size, ends, begin = len(text), [], 0
        if size > least:
            own = marks[np.searchsorted(marks, at + 8) : np.searchsorted(marks, at + size)] - at
            i = 0
            while size - begin > least:
                i = int(np.searchsorted(own, begin + least))
                end = min(int(own[i]) if i < len(own) else size, begin + most, size)
                ends.append(end)
                begin = end
        if begin < size:
            ends.append(size)
        out.append(ends)
        at += size
    return out


def _name(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def chunks(docs: DataFrame, text: str, width: int, sizes: tuple[int, int, int]) -> DataFrame:
    """One row (chunk_id, chunk) for each chunk, without repeats inside a slice."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = raw(part.column("text"))
            seen = {t[a:b] for t, ends in zip(texts, cuts(texts, *sizes), strict=True) for a, b in zip([0, *ends], ends, strict=False)}
            yield pa.RecordBatch.from_arrays([pa.array([_name(c, width) for c in seen], pa.binary()), pa.array(list(seen), pa.binary())], ["chunk_id", "chunk"])

    return map_arrow(docs.select(filled(text).alias("text")), run, "chunk_id binary, chunk binary")


def colliding(found: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content."""
    return found.dropDuplicates(["chunk_id", "chunk"]).groupBy("chunk_id").count().filter("count > 1")


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTHS[0], sizes=(LEAST, MEAN, MOST)) -> DataFrame:
    """doc_id, recipe (identifiers of the text's chunks in order, joined) and text_sha256 of every row."""

    def run(batches):
        for part in slices(batches, "text"):
            texts = raw(part.column("text"))
            made = [b"".join([_name(t[a:b], width) for a, b in zip([0, *ends], ends, strict=False)]) for t, ends in zip(texts, cuts(texts, *sizes), strict=True)]
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary()), pa.array(shas)], ["doc_id", "recipe", "text_sha256"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text")), run, "doc_id long, recipe binary, text_sha256 string")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", widths=WIDTHS, sizes=(LEAST, MEAN, MOST)) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null is the empty text, whose recipe is empty. The largest doc_id of a group stays. Rows that share doc_id and text are one document
    given twice: all of them say kept. In a group without any doc_id, keep_id is null and all are kept. An empty table gives no rows.
    """
    for width in widths:
        if colliding(chunks(docs, text, width, sizes)).isEmpty():
            break
    else:
        raise ValueError("chunk identifiers of all widths collide")
    made = cut(recipes(docs, doc_id, text, width, sizes))
    # recipes that occur twice, stored: the join then has a shuffle on either side, whose large partitions Spark may split
    groups = stored(made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "repeated-recipes")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return made.join(groups, "recipe", "left").select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
QUERIES = {"op10_chunk_recipes": (op10_chunk_recipes, SQL)}
