"""Helpers shared by the operators: bounded Arrow slices, word and shingle hashes, fixed-size filters, stored tables."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.session import checkpoint_dir, cut  # noqa: F401

#: UTF-8 bytes that one slice hands to vector code; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows without an id share this key where rows must be joined by id.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filled(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell documents apart, also where ids are missing or repeated. Equal rows share them."""
    return [F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("k1"), F.xxhash64(filled(text)).alias("k2")]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def raw(column: pa.Array) -> list[bytes]:
    """The bytes of a string column; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB where the session has Spark's own bound of 64 MB, of which a task holds several at a time, in and out. A bound that the
    caller has set stays."""
    if spark.conf.get(_BATCHES) == "67108864b":
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, and what one operator needed is not the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    owner = fn.__module__

    def run(batches):
        worker_of(owner)
        yield from fn(batches)
        give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _store() -> types.ModuleType:
    return sys.modules.setdefault("_tidebars_worker_store", types.ModuleType("_tidebars_worker_store"))


def kept_in_worker(key: str, build: Callable):
    """A value that a Python worker builds once and keeps between the tasks of one operator (see ``worker_of``)."""
    kept = vars(_store()).setdefault("_kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def worker_of(owner: str) -> None:
    """The worker's tasks are the operator's in module ``owner`` from now on: what an earlier one kept goes back to the system."""
    store = vars(_store())
    if store.get("_owner", owner) != owner:
        store["_kept"] = {}
        give_back()
    store["_owner"] = owner


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. Its size is then known, so that Spark broadcasts it below its own threshold only."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- hashes -----------------------------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(n: int) -> np.ndarray:
    """Odd multipliers, one for each place in a shingle."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)


def lookup(word: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: what A-Z become, and whether it belongs to a word. ``word``: "spaced" or "alnum"."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, bool)
    if word == "spaced":
        inside[[32, 9, 10, 11, 12, 13]] = False
    else:
        inside[:128] = False
        inside[48:58] = inside[97:123] = inside[65:91] = True
    return lower, inside


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = kept_in_worker("powers", dict)
    if have.get("n", 0) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        base = 0xD6E8FEB86659FD93
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return have["up"][:n], have["down"][:n]


def word_hashes(texts: list[bytes], word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end (in the joined bytes) of every word of ``texts``, and those bytes in lower case.

    A word's hash is a polynomial in its bytes, taken from prefix sums, so that no loop runs over words.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lower, inside = kept_in_worker(f"lookup_{word}", lambda: lookup(word))
    low, isin = lower[joined], inside[joined]
    edge = np.flatnonzero(np.diff(isin, prepend=False))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(low) + 1)
    sums = np.empty(len(low) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_ODD))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(first, start, side="right") - 1
    return hashed, owner, start, end, low


def grams(hashed: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside one text, and the number of its first word."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, k, np.uint64)
    for w, j in zip(weights(k), range(k), strict=True):
        total += hashed[j : j + n] * w
    at = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
    return mix(total[at]), at


# --- filters of fixed size --------------------------------------------------------------------------------------------


def bit_filter(df: DataFrame, hash_column: str, bits: int) -> np.ndarray:
    """Words of a bit array of 2**bits bits with the top bits of every hash set.

    At most 2**bits / 64 rows reach the driver, whatever ``df`` holds. It may let others through and never loses one.
    """
    slot = F.shiftrightunsigned(F.col(hash_column), 64 - bits)
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = df.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def passes(filter_words: np.ndarray, hashed: np.ndarray, bits: int) -> np.ndarray:
    slot = hashed >> np.uint64(64 - bits)
    return (filter_words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
