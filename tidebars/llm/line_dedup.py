"""Line dedup: lines found in many documents stay in one of them.

Every text gives the distinct hashes of its lines' keys; those are exploded and counted by documents, with a map-side sum before the
shuffle, so that a line held by a third of all documents is one row for each task. Hashes over the threshold go back to the documents
that hold them (a plain join, whose large partitions Spark splits), and each text is put together again by position.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import cut, documents, filled, map_arrow, raw, row_key, slices, stored

LEAST_CHARS = 20
LEAST_DOCS = 3
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """128-bit hash of the line stripped and in lower case (A-Z only); None below ``least_chars`` code points."""
    key = line.strip(_BLANKS).lower()
    if len(key) < least_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """k1, k2 (as row_key makes them) and the hashes of the lines that the document loses. docs: k1, k2, doc_id, text."""

    def run(batches):
        for part in slices(batches, "text"):
            keys = [list(dict.fromkeys(k for x in t.split(b"\n") if (k := line_key(x, least_chars)))) for t in raw(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "doc_id")), pa.array(keys, pa.list_(pa.binary()))], ["k1", "k2", "doc_id", "keys"])

    held = cut(map_arrow(docs, run, "k1 long, k2 long, doc_id long, keys array<binary>")).select("k1", "k2", "doc_id", F.explode("keys").alias("key"))
    # stored, so that the join below has a shuffle on either side, whose large partitions Spark may split, or broadcasts a side known to be small
    often = stored(held.groupBy("key").agg(F.count("*").alias("holders"), F.max("doc_id").alias("last_id")).filter(F.col("holders") >= least_docs), "repeated-lines")
    lost = held.join(often, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
    return lost.groupBy("k1", "k2").agg(F.collect_set("key").alias("lost"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``text`` rebuilt, and n_lines and n_dropped (long); columns of those names are replaced.

    A text is split at \\n only; null or empty is one empty line. Keys of ``least_chars`` code points or more found in ``least_docs``
    rows or more lose all their lines, also repeated ones, except in the row with the largest doc_id that holds them. Rows that share
    doc_id and text keep or lose the same lines. A text that loses every line is empty. An empty table gives no rows.
    """
    keyed = docs.select(*row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text"))
    lost = repeated_lines(keyed, least_chars, least_docs)
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    rows = docs.select(*row_key(doc_id, text), filled(text).alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest")).join(lost, ["k1", "k2"], "left").drop("k1", "k2")

    def run(batches):
        for part in slices(batches, "text"):
            made, lines, dropped = [], [], []
            for t, gone in zip(raw(part.column("text")), part.column("lost").to_pylist(), strict=True):
                have = t.split(b"\n")
                lines.append(len(have))
                if gone:
                    drop = set(gone)
                    keep = [x for x in have if line_key(x, least_chars) not in drop]
                    dropped.append(len(have) - len(keep))
                    t = b"\n".join(keep)
                else:
                    dropped.append(0)
                made.append(t)
            yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(made, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["rest", "text", "n_lines", "n_dropped"])

    kind = rows.schema["rest"].dataType.simpleString()
    out = map_arrow(rows, run, f"rest {kind}, text string, n_lines long, n_dropped long")
    cols = [F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), often AS (SELECT key, max(doc_id) AS last_id FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, often.key IS NOT NULL AND l.doc_id <> last_id AS gone FROM l LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
QUERIES = {"op7_line_dedup": (op7_line_dedup, SQL)}
