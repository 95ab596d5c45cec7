import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from querylens.llm._spark import lookup, written


def test_stages_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {}
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == P.COLUMNS
        got[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in rows.items() if not brute.quality(t)[5]}
    assert got["quality"] == good  # no host of the sample is rejected
    order = sorted(good.items())
    cut = {i: w[2] for (i, _), w in zip(order, brute.line_dedup(order), strict=True)}
    assert got["lines"] == cut
    first = {i: t for i, t in cut.items() if brute_components(cut)[i] == i}
    assert got["near_duplicates"] == first
    clean = brute.contamination(list(first.items()), items)
    assert got["benchmarks"] == {i: t for i, t in first.items() if not clean[i][4]}
    mix = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"]: r["size"] for r in mix} == {i: brute.quality(t)[0] for i, t in got["benchmarks"].items()}
    assert sum(r["taken"] for r in mix) == pytest.approx(sum(r["size"] for r in mix), rel=0.02)


_known = {}


def brute_components(texts):
    """Components by comparing only texts that share a shingle, which all linked ones do."""
    key = id(texts)
    if key not in _known:
        by = {}
        for i, t in texts.items():
            for s in brute.shingles(t):
                by.setdefault(s, []).append(i)
        near = sorted({i for g in by.values() if len(g) > 1 for i in g})
        found = brute.components([(i, texts[i]) for i in near])
        _known[key] = {i: found[i][1] if i in found else i for i in texts}
    return _known[key]


def test_run_and_edges(spark, sf_dir, edge_docs, no_docs):
    assert P.run(spark, sf_dir).count() > 0
    for start in (edge_docs, no_docs):
        docs = start
        for name, stage in P.STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert docs.count() == 0


def test_lookup_of_hot_and_cold_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m")).filter("k != 'k5'")
    want = left.join(right, "k", "left")
    got = lookup(left, right, ["k"], "w", 5000)
    assert got.count() == 5000 and got.exceptAll(want.select(got.columns)).count() == 0
