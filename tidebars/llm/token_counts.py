"""Token counts with a digest cache.

A text is known by two digests: that of its normalised content and that of the tokenizer (file and settings). Counts found under both
in the cache are joined; of the others each distinct content is encoded once, and the new counts are appended to the cache. The digest
stage moves only digests and ids; the text of one document for each missing content moves to the task that encodes it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import NO_ID, cut, documents, filled, kept_in_worker, map_arrow, raw, shared_path, slices, stored

_CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Pieces that a worker remembers at most; beyond it starts anew.
MEMO = 400_000


def tokenizer_digest(path: str, settings: str = "") -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + settings.encode()).hexdigest()


def _library(path: str):
    """A function from texts to token counts, by the library that reads the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(texts: DataFrame, path: str, by_pieces: bool) -> DataFrame:
    """content_digest, n_tokens of each row (content_digest, text). by_pieces: tokens never span ASCII white space, and it makes none."""

    def run(batches):
        count = kept_in_worker(f"library_{path}", lambda: _library(path))
        memo = kept_in_worker(f"pieces_{path}", dict)
        for part in slices(batches, "text"):
            data = raw(part.column("text"))
            if by_pieces:
                split = [t.split() for t in data]  # of bytes: at ASCII white space only
                fresh = list({p for s in split for p in s if p not in memo})
                if len(memo) + len(fresh) > MEMO:
                    memo.clear()
                    fresh = list({p for s in split for p in s})
                memo.update(zip(fresh, count([p.decode("utf-8", "replace") for p in fresh]), strict=True))
                n = [sum(map(memo.__getitem__, s)) for s in split]
            else:
                n = count([t.decode("utf-8", "replace") for t in data])
            yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return map_arrow(texts, run, "content_digest binary, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache_path: str, doc_id: str = "doc_id", text: str = "text", normalise: Column | None = None, by_pieces: bool = False) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens of every row; new counts are appended to the table at ``cache_path``.

    ``normalise`` maps the column ``text`` to a form with the same tokens; contents are compared and encoded in that form. Null is the
    empty text, with no tokens. Missing or repeated doc_ids and equal rows each get their count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path, "pieces" if by_pieces else "")
    form = F.col("text") if normalise is None else normalise
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k1"), F.col(doc_id).cast("long").alias("doc_id"), filled(text).alias("text"))
    rows = keyed.select("k1", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(form, 256)).alias("content_digest"))
    known = cut(rows)
    spark.createDataFrame([], _CACHE).write.mode("append").parquet(cache_path)

    def cached() -> DataFrame:
        have = spark.read.schema(_CACHE).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
        return have.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = known.groupBy("content_digest").agg(F.min("k1").alias("k1")).join(cached(), "content_digest", "left_anti")
    digest = F.unhex(F.sha2("text", 256))
    texts = keyed.select("k1", form.alias("text")).join(misses, "k1").filter(F.col("content_digest") == digest).select("content_digest", "text")
    encoded(texts, path, by_pieces).withColumn("tokenizer_digest", F.lit(version)).select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache_path)
    return known.join(stored(cached(), "token-counts"), "content_digest").select("doc_id", "n_bytes", "n_tokens")


def op3_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache for each run, so that a run's work is the whole table's. Runs that share a cache are in the tests."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    spaces = F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")
    counted = token_counts(documents(spark, sf_dir), path, shared_path(spark, "token-counts"), normalise=spaces, by_pieces=True)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op3_digest_cache": (op3_digest_cache, None)}
