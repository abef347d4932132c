"""The rule ensemble and the whole pipeline."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.llm import rule_ensemble as re_

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_statistics():
    got = dict(zip(re_.STATISTICS, re_.statistics([b"One two two\nTHREE! | \xc3\xa9", b"", b"  "])[0], strict=True))
    assert got["n_words"] == 6 and got["distinct_words"] == 5 / 6 and got["repeated_words"] == 1 / 6 and got["line_words"] == 3
    assert got["upper"] == 6 / 22 and got["exclaims"] == got["bars"] == 1 / 22
    assert not re_.statistics([b"", b"  "])[0].any() and np.isfinite(re_.statistics([b"", b" ", b"x"])).all()


def test_paths_and_score(spark):
    tree = "T\n  If (feature 0 <= 2.5)\n   If (feature 1 <= 0.1)\n    Predict: 1.0\n   Else (feature 1 > 0.1)\n    Predict: 0.0\n  Else (feature 0 > 2.5)\n   Predict: -1.0\n"
    rules = re_.paths(tree)
    assert rules == [((0, "<=", 2.5),), ((0, "<=", 2.5), (1, "<=", 0.1)), ((0, "<=", 2.5), (1, ">", 0.1)), ((0, ">", 2.5),)]
    model = re_.RuleEnsemble([(rules[1], 2.0), (rules[3], -1.0)], 0.5)
    rows = spark.createDataFrame([(1.0, 0.05), (1.0, 0.2), (3.0, 0.0)], "n_words double, word_length double").withColumns({s: F.lit(0.0) for s in re_.STATISTICS[2:]})
    got = [r[0] for r in rows.select(model.score()).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-z)) for z in (2.5, 0.5, -0.5)])


def test_folds(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), re_.held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert not spark.sql("select cast(null as long) as doc_id").select(re_.held_out("doc_id")).first()[0]


def test_few_or_no_labels(spark, make, odd):
    docs = make(odd)
    for labels, share in (([], 0.5), ([(4, 1), (6, 1), (None, 0), (7, None)], 1.0)):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        got = re_.scored(docs, re_.train(docs, table))
        assert got.count() == len(odd) and got.select("score").distinct().count() == 1
        assert abs(got.first().score - share) < 0.01
    assert re_.scored(make([]), re_.train(make([]), table)).count() == 0


@needs_tables
def test_held_out_accuracy(spark):
    got = re_.op9_rule_ensemble(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out and quality is not null")
    n, right = got.agg(F.count("*"), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right / n > 0.95
    assert got.filter("score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").isEmpty()


@needs_tables
def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(re_.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (re_.train(docs, t) for t in (labels, other))
    assert one.rules == two.rules and one.intercept == pytest.approx(two.intercept)


@needs_tables
def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage on what the one before kept, against plain Python on the same rows; all rows of run() over the same tables, written apart."""
    import corpus_pipeline as cp
    from test_dedup import expected_lines
    from test_matching import expected_components, expected_hits

    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_copies", "decontaminated", "tokens"]
    for table in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        rows = rows.filter("doc_id < 250") if table == "documents" else rows
        if table == "documents":  # null, empty, tied and repeated rows
            rows = rows.unionByName(rows.filter("doc_id < 5")).unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0)], rows.schema))
        rows.coalesce(2).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(cp.STAGES)
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def pairs(df):
        assert df.columns == list(cp.COLUMNS)
        return sorted((r.doc_id, r.text) for r in df.collect())

    good = stage["quality"](spark, docs, str(tmp_path)).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(good)}
    assert sum((i in kept) == bool(labels[i]) for i, _ in pairs(docs) if i in labels) / sum(i in labels for i, _ in pairs(docs)) > 0.95
    lines = stage["lines"](spark, good, FOLDER).cache()
    assert pairs(lines) == [(i, t) for i, t, _, _ in sorted(expected_lines(pairs(good)))]
    near = stage["near_copies"](spark, lines, FOLDER).cache()
    first = {i for i, _, c in expected_components(pairs(lines)) if i == c}
    assert pairs(near) == [x for x in pairs(lines) if x[0] in first]
    clean = stage["decontaminated"](spark, near, FOLDER).cache()
    hit = {r[0] for r in expected_hits(pairs(near), bench) if r[-1]}
    assert pairs(clean) == [x for x in pairs(near) if x[0] not in hit]
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    last = stage["tokens"](spark, clean, FOLDER)
    want = []
    for i, t in pairs(clean):
        ids = library.encode(t, add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, last.collect())) == sorted(want)
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).select(*last.columns).collect())) == sorted(want)
