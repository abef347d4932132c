"""Quality classifier: a sparse rule ensemble.

Boosted trees are grown on statistics of labelled texts; every path from a root to a node is a rule, a conjunction of bounds on statistics.
A lasso logistic regression over all rules keeps few of them. The kept rules and weights are compiled into one Spark column expression, so
scoring is a projection over the statistics, which are made where the text is read: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidebars.llm.common import cut, documents, filled, give_back, kept_in_worker, map_arrow, raw, slices, word_hashes, worker_of

#: Labelled rows that training reads at most, the first by a hash of their id. Every row is scored.
TRAINING_ROWS = 20_000
TREES, DEPTH, LASSO = 12, 3, 0.001
THRESHOLD = 0.7
# Characters that make a class of their own.
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "symbols": "#$%&*@^~=+<>\\/{}[]_`", "exclaims": "!", "bars": "|", "stops": ".,;:?"}
STATISTICS = ("n_words", "word_length", "distinct_words", "repeated_words", "line_words", *CLASSES)


def _tables() -> np.ndarray:
    out = np.zeros((len(CLASSES), 256), np.uint8)
    for row, chars in zip(out, CLASSES.values(), strict=True):
        row[list(chars.encode())] = 1
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS for each text. Shares are of characters (classes) or words; all are 0 for the empty text."""
    hashed, owner, _, _, _ = word_hashes(texts, "spaced")
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))

    def per_text(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[edges[1:]] - sums[edges[:-1]]).astype(float)

    n = np.diff(bounds).astype(float)
    some = np.maximum(n, 1)
    chars = per_text((joined & 0xC0) != 0x80, first) - 1
    order = np.lexsort((hashed, owner))
    h, o = hashed[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])
    cols = [n, chars / some, per_text(fresh, bounds) / some, per_text(again, bounds) / some, n / np.maximum(per_text(joined == 10, first), 1)]
    for table in kept_in_worker("character_classes", _tables):
        cols.append(per_text(table[joined], first) / np.maximum(chars, 1))
    return np.column_stack(cols)


def measured(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (those in ``carry``, if given) in a struct ``row``, and the statistics of each row."""
    carry = carry or docs.columns
    rows = docs.select(F.struct(*carry).alias("row"), *([] if text in carry else [F.col(text).alias("text")]))
    place = carry.index(text) if text in carry else None

    def run(batches):
        for batch in batches:
            # a text that is carried along is sent once
            texts = batch.column("text") if place is None else batch.column("row").field(place)
            for part in slices(iter([pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])]), "text"):
                got = statistics(raw(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, np.ascontiguousarray(got.T))], ["row", *STATISTICS])

    return map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, str, float], ...]


def paths(tree: str) -> list[Rule]:
    """The rules of a tree's description: for every node below the root, the conditions on the way to it."""
    out, way = [], []
    for line in tree.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            way = [x for x in way if x[0] < len(m[1])] + [(len(m[1]), (int(m[2]), m[3], float(m[4])))]
            out.append(tuple(sorted({x[1] for x in way})))
    return out


def condition(rule: Rule) -> Column:
    parts = [F.col(STATISTICS[k]) <= v if op == "<=" else F.col(STATISTICS[k]) > v for k, op, v in rule]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


@dataclass
class RuleEnsemble:
    """Kept rules with weights, and the intercept."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 from the columns STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: str) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> RuleEnsemble:
    """Rules from at most ``rows`` labelled documents outside the held-out fold.

    Null labels are left out; of several labels of one id the smallest counts. Without labelled rows, or with one class only, there are no
    rules and the score is the share of label 1 (one half without any).
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    few = usable.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(label).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    picked = docs.select(F.col(doc_id).cast("long").alias("id"), filled(text).alias("text")).join(F.broadcast(few), "id")  # at most ``rows`` pairs of numbers
    data = cut(measured(picked, carry=["label"]).select(F.col("row.label").alias("label"), *STATISTICS))
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        return RuleEnsemble([], math.log((share + 1e-3) / (1 - share + 1e-3)))
    data = data.coalesce(max(1, n // 5000))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(data).select("label", "features").cache()
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, seed=11, minInstancesPerNode=max(1, min(20, n // 100))).fit(vectors)
    vectors.unpersist()
    rules = list(dict.fromkeys(r for tree in boosted.trees for r in paths(tree.toDebugString)))
    if not rules:
        return RuleEnsemble([], math.log(ones / (n - ones)))
    met = data.select("label", *(condition(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    met = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(met).select("label", "features").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(met)
    met.unpersist()
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w], float(lasso.intercept))


def scored(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``, or those in ``carry``), score and predicted. Null is the empty text. Repeated rows and missing ids make no difference; an
    empty table gives no rows."""
    return measured(docs, text, carry).select("row", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@F.arrow_udf(ArrayType(DoubleType()))
def text_statistics(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``statistics`` of a string column."""
    worker_of(statistics.__module__)
    for column in texts:
        parts = [statistics(raw(part.column("text"))) for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text")]
        got = np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(got.ravel()))
    give_back()


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good. Only texts go to Python and only statistics come back; rows stay where they are."""
    model = train(docs, labels)
    whole = F.struct(*docs.columns).alias("row")
    got = docs.select(whole, text_statistics(filled()).alias("s"))
    got = got.select("row", *(F.col("s")[k].alias(name) for k, name in enumerate(STATISTICS)))
    return got.filter(model.score() >= threshold).select("row.*")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, carry=["doc_id"]).select("row.doc_id", "score", "predicted").select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {"op9_rule_ensemble": (op9_rule_ensemble, None)}
