"""Known values and invariants of the operators."""

import pytest
from pyspark.sql import functions as F

from querylens.operators import features as FE
from querylens.operators import learners as L
from querylens.operators import metrics as M
from querylens.operators import quality as Q
from querylens.operators import ranking as K
from querylens.operators import retrieval as R
from querylens.operators import sampling as S
from querylens.sources import tables as IO


def test_macro_f1_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")
    assert M.macro_f1(df).first()["macro_f1"] == 0.5


def test_threshold_search(spark):
    df = spark.createDataFrame([(1, 0.501), (1, 0.5009), (0, 0.5008), (0, 0.1)], "label int, p double")
    best = M.best_threshold(df).first()
    assert (best["threshold"], best["macro_f1"]) == (0.5009, 1.0)


def test_calibration_leaves_out_one(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.95)], "label int, p double")
    assert M.calibration(df).first()["ece"] == pytest.approx(0.025)
    assert M.calibration(df, include_right_edge=True).first()["ece"] == pytest.approx(0.475)


def test_nested_mrr(spark):
    df = spark.createDataFrame([("q1", "a", 3.0, 1), ("q1", "b", 1.0, 0), ("q2", "a", 3.0, 0), ("q2", "b", 1.0, 1)], "term_id string, item_id string, score double, label int")
    assert M.nested_cut_metrics(df, 10).first()["mrr_at_k"] == 0.75


def test_candidate_targets(spark):
    df = spark.createDataFrame([("t1", str(i)) for i in range(4)] + [("t2", str(i)) for i in range(60)], "term_id string, item_id string")
    got = {r["term_id"]: (r["total"], r["n_neg"]) for r in S.candidate_targets(df).collect()}
    assert got == {"t1": (100, 96), "t2": (120, 60)}


def test_rrf_prefers_two_good_places(spark):
    a = spark.createDataFrame([("q", "A", 1), ("q", "B", 2)], "query_id string, item_id string, rank int")
    b = spark.createDataFrame([("q", "B", 1), ("q", "C", 2), ("q", "A", 3)], "query_id string, item_id string, rank int")
    assert R.rrf([(a, 1.0), (b, 1.0)], top=1).first()["item_id"] == "B"


def context_rows(spark):
    rows = [("t1", 0.9, 0.5, 0.1, 0.3), ("t1", 0.5, 0.5, 0.2, 0.7), ("t1", 0.1, 0.5, 0.3, 0.5), ("t2", 0.2, 0.1, 0.1, 0.1), ("t2", 0.6, 0.2, 0.1, 0.2)]
    return spark.createDataFrame(rows, "term_id string, query_title_overlap double, query_title_coverage double, query_category_overlap double, tfidf_cosine double")


def test_context_features(spark):
    got = {(r["term_id"], r["query_title_overlap"]): r for r in FE.context_features(context_rows(spark)).collect()}
    assert got["t1", 0.9]["query_title_overlap_rank"] == 1.0 and got["t1", 0.1]["query_title_overlap_rank"] == 0.0
    assert got["t1", 0.5]["query_title_overlap_gap"] == pytest.approx(0.4) and got["t1", 0.5]["query_title_coverage_rank"] == 0.5


@pytest.mark.parametrize("parts", [1, 8])
def test_context_features_do_not_depend_on_partitions(spark, parts):
    want = sorted(map(str, FE.context_features(context_rows(spark).coalesce(1)).collect()))
    assert sorted(map(str, FE.context_features(context_rows(spark).repartition(parts)).collect())) == want


def catalogue(spark, n=240):
    return spark.createDataFrame([(f"i{i}", f"c{i % 2}") for i in range(n)], "item_id string, category_key string")


def positives(spark):
    return spark.createDataFrame([("t1", f"i{i}", 1) for i in range(4)] + [("t2", f"i{i}", 1) for i in range(60)], "term_id string, item_id string, label int")


def check_set(df, positives_df, quotas):
    rows = df.collect()
    assert len({(r["term_id"], r["item_id"]) for r in rows}) == len(rows)
    pos = {(r["term_id"], r["item_id"]) for r in positives_df.collect()}
    neg = [(r["term_id"], r["item_id"]) for r in rows if r["label"] == 0]
    assert not pos & set(neg)
    for term, n in quotas.items():
        assert sum(t == term for t, _ in neg) == n
    assert S.leaks(df).count() == 0
    return sorted(map(tuple, rows))


def test_random_negatives_fill_exact_quotas_and_repeat(spark):
    pos, items = positives(spark), catalogue(spark)
    a = check_set(S.training_set(pos, items, 3), pos, {"t1": 12, "t2": 180})  # all that t2 has not yet
    assert a == check_set(S.training_set(pos.repartition(7), items.repartition(3), 3), pos, {"t1": 12, "t2": 180})


def test_impossible_quota_fails_at_once(spark):
    with pytest.raises(ValueError, match="too small"):
        S.training_set(positives(spark), catalogue(spark, 100), 3)


def test_shaped_set(spark):
    pos, items = positives(spark), catalogue(spark)
    hits = spark.createDataFrame([(t, f"i{i}", i + 1) for t in ("t1", "t2") for i in range(0, 200)], "term_id string, item_id string, rank int")
    df = S.shaped_set(pos, items, hits)
    check_set(df, pos, {"t1": 96, "t2": 60})
    n = {(r["term_id"], r["neg_source"]): r["count"] for r in df.groupBy("term_id", "neg_source").count().collect()}
    assert n["t1", "bm25"] == 19 and n["t1", "category"] == 48 and n["t2", "bm25"] == 12


def test_category_negatives_are_found_among_blocked_ones(spark):
    """99 of the few free members of a category, in which few draws hit one; all of them if fewer are left."""
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit("x").alias("category_key")).union(spark.range(10_000, 40_000).select("id", F.lit("y")))
    hits = spark.createDataFrame([(1, 0, 1)], "term_id long, item_id long, rank int")
    for n_free, want in ((100, 99), (60, 60)):
        pos = spark.range(10_000 - n_free).select(F.lit(1).cast("long").alias("term_id"), F.col("id").alias("item_id"))
        df = S.shaped_set(pos, items, hits, category_share=0.01)
        check_set(df, pos, {1: 10_000 - n_free})
        assert {r["neg_source"]: r["count"] for r in df.groupBy("neg_source").count().collect()}["category"] == want


def test_shaped_set_draws_grow_with_quotas_and_not_with_categories(spark):
    """2,000 terms in 40 categories of 5,000 items: 30 draws a wanted row in each category were 192 million rows."""
    items = spark.range(200_000).select(F.col("id").alias("item_id"), (F.col("id") % 40).alias("category_key"))
    pos = spark.range(80_000).select((F.col("id") / 40).cast("long").alias("term_id"), F.col("id").alias("item_id"))
    hits = pos.limit(0).withColumn("rank", F.lit(1))
    df = S.shaped_set(pos, items, hits, min_candidates=200)
    got = df.groupBy("neg_source", "term_id").count().groupBy("neg_source", "count").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {("positive", 40, 2000), ("category", 80, 2000), ("random", 80, 2000)}
    positives, targets = pos.select(*S.PAIR), pos.select("term_id").distinct().withColumn("n_cat", F.lit(80).cast("long"))
    plan = S.category_negatives(targets, positives, items, positives.limit(0))
    assert plan.filter("neg_source <> 'category'").count() == 0 and plan.count() == 160_000


def test_shaped_set_does_not_broadcast_draws_or_large_catalogues(spark):
    """2,000 terms become 416,000 draws, which Spark takes to be as small as the terms' file; the driver built a table of them."""
    items = spark.range(200_000).select(F.col("id").alias("item_id"), (F.col("id") % 40).alias("category_key"))
    pos = spark.range(2_000).select(F.col("id").alias("term_id"), F.col("id").alias("item_id"))
    hits = pos.limit(0).withColumn("rank", F.lit(1))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
    try:
        got = S.shaped_set(pos, items, hits, min_candidates=200).groupBy("neg_source").count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert {tuple(r) for r in got} == {("positive", 2_000), ("category", 200_000), ("random", 198_000)}


def test_category_places_number_each_category(spark):
    items = spark.range(120_000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 9 < 8, "big").when(F.col("id") % 2 == 0, "small").alias("category_key"))
    member, sizes = S.category_places(items)
    got = member.groupBy("category_key").agg(F.count("*").alias("n"), F.count_distinct("_i").alias("d"), F.min("_i").alias("a"), F.max("_i").alias("z")).filter("category_key is not null").collect()
    assert len(got) == 2 and all(r["n"] == r["d"] == r["z"] + 1 and r["a"] == 0 for r in got)
    assert {r["category_key"]: r["_size"] for r in sizes.filter("category_key is not null").collect()} == {r["category_key"]: r["n"] for r in got}


def test_category_pool_sizes_count_the_rows_of_the_pool(spark):
    """Also for items under several keys, listed twice, or without key or id, and for blocked pairs outside of the pool."""
    listed = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", None), (None, "x"), (None, "y"), ("f", "x"), ("f", "z")]
    items = spark.createDataFrame(listed, "item_id string, category_key string")
    pos = spark.createDataFrame([("t1", "b"), ("t1", "b"), ("t2", "a"), ("t3", "d"), ("t3", "f"), ("t4", "e"), (None, "c"), ("t5", None), ("t6", "gone")], "term_id string, item_id string")
    other = spark.createDataFrame([("t1", "c"), ("t2", "a"), ("t2", "a"), ("t3", "a"), (None, "a"), ("t1", None)], "term_id string, item_id string")
    for blocked in (None, other):
        want = S.category_pool(pos, items, pos if blocked is None else blocked).groupBy("term_id").agg(F.count("*").alias("n"))
        assert sorted(map(str, S.category_pool_sizes(pos, items, blocked).collect())) == sorted(map(str, want.collect()))


def test_category_pool_sizes_do_not_expand_large_categories(spark):
    """A million terms times items of one category: 10^12 rows would not end."""
    items = spark.range(1_000_000).select(F.col("id").alias("item_id"), F.lit("x").alias("category_key"))
    pos = spark.range(1_000_000).select((F.col("id") % 500_000).alias("term_id"), F.col("id").alias("item_id"))
    got = S.category_pool_sizes(pos, items).groupBy("n").count().collect()
    assert [tuple(r) for r in got] == [(999_998, 500_000)]


def test_mixed_set_fills_up(spark):
    pos, items = positives(spark), catalogue(spark)
    hits = spark.createDataFrame([("t1", "i0", 1), ("t1", "i100", 2)], "term_id string, item_id string, rank int")
    check_set(S.mixed_set(pos, items, hits, 2), pos, {"t1": 8, "t2": 120})


def test_complete_groups(spark):
    pos = positives(spark)
    assert K.complete_groups(pos, "term_id", 1).count() in (4, 60) and K.complete_groups(pos, "term_id", 9).count() == 64


def test_band_override(spark):
    base = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.6), (4, 0.2)], "id int, p double")
    band = spark.createDataFrame([(3, 0.3), (4, 0.2)], "id int, p double")
    got = [r["prediction"] for r in M.band_override(base, band, 0.5, 0.5).orderBy("id").collect()]
    assert got == [0, 1, 0, 0]
    with pytest.raises(ValueError):
        M.band_override(base, spark.createDataFrame([(9, 0.3)], "id int, p double"), 0.5, 0.5)


def test_duplicate_queries(spark):
    t = spark.createDataFrame([("1", "Kırmızı  elbise "), ("2", "kırmızı elbise"), ("3", "x")], "term_id string, query string")
    assert [(r["n_ids"], r["ids"]) for r in Q.duplicate_queries(t).collect()] == [(2, ["1", "2"])]


def test_pool(spark):
    pairs = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "b")], "term_id string, item_id string")
    pool = Q.pool_insert(spark.createDataFrame([], Q.POOL), pairs, "bm25", "now")
    pool = Q.pool_insert(pool, pairs, "other", "later")
    assert pool.count() == 2 and pool.filter("source = 'other'").count() == 0
    v = spark.createDataFrame([("t", "a", "VERIFIED_NEGATIVE", "x", "me", "")], "term_id string, item_id string, status string, verified_at string, annotator_id string, notes string")
    assert [r["item_id"] for r in Q.verified_negatives(Q.pool_verify(pool, v)).collect()] == ["a"]


def test_folds_keep_groups_whole(spark):
    df = spark.range(400).select((F.col("id") % 37).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    for folded in (M.hash_folds(df, "g"), M.balanced_folds(df, "g")):
        assert folded.count() == 400 and folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_table_contracts(spark):
    ok = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    IO.check_table(ok, ["k"], ["v"])
    for bad in (ok.limit(0), ok.union(ok), spark.createDataFrame([(None, 1)], "k string, v int")):
        with pytest.raises(ValueError):
            IO.check_table(bad, ["k"])
    with pytest.raises(ValueError):
        IO.require_values(spark.createDataFrame([(1.5,)], "p double"), "p", "probability")


def test_scan_rejects_pointers_and_wrong_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("version https://git-lfs.github.com/spec/v1\noid x\n")
    (tmp_path / "w.csv").write_text("query,term_id\nq,t\n")
    (tmp_path / "t.csv").write_text("term_id,query\nt1,red dress\n")
    for bad in ("p.csv", "w.csv"):
        with pytest.raises(ValueError):
            IO.load_terms(spark, str(tmp_path / bad))
    assert IO.load_terms(spark, str(tmp_path / "t.csv")).first()["query"] == "red dress"


def test_publish_leaves_nothing_after_a_failure(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, prediction int")
    IO.publish(df, str(tmp_path / "out"), lambda w: None)
    assert (tmp_path / "out").exists()

    def refuse(w):
        raise ValueError("no")

    with pytest.raises(ValueError):
        IO.publish(df, str(tmp_path / "other"), refuse)
    assert not list(tmp_path.glob("other*"))


def test_submission_qa(spark):
    sample = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx int, id string")
    good = spark.createDataFrame([(0, "a", 1), (1, "b", 0)], "row_idx int, id string, prediction int")
    assert IO.submission_qa(good, sample).first()["valid"] is True
    for bad in ([(0, "b", 1), (1, "a", 0)], [(0, "a", 2), (1, "b", 0)], [(0, "a", 1)], [(0, "a", 1), (1, "a", 0)]):
        assert IO.submission_qa(spark.createDataFrame(bad, "row_idx int, id string, prediction int"), sample).first()["valid"] is False


def test_runs(spark):
    ok = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "i int, g string")
    bad = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "i int, g string")
    assert K.runs_are_contiguous(ok, "g", "i") and not K.runs_are_contiguous(bad, "g", "i")


def test_model_boundary(spark):
    df = spark.range(20).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 20.0).alias("x"))
    got = L.injected_scores(df, lambda b: b["x"] * 2, ["x"]).filter("abs(score - 2 * x) > 1e-9").count()
    assert got == 0
    t = spark.createDataFrame([("q", "p", ["n1", "n2"])], "query string, positive_doc string, hard_negatives array<string>")
    assert [(r["doc"], r["label"]) for r in L.expanded_triplets(t).collect()] == [("p", 1), ("n1", 0), ("n2", 0)]


def test_ivf_finds_itself(spark):
    v = spark.createDataFrame([(i, [float(i % 7 == k) + 0.01 * i * (k == 0) for k in range(7)]) for i in range(70)], "vec_id int, embedding array<float>")
    model, index = L.ivf_assign(v, 4)
    q = v.filter("vec_id = 69").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    exact = [r["vec_id"] for r in R.dense_top(q, v, 3).orderBy("rank").collect()]
    assert [r["vec_id"] for r in L.ivf_search(model, index, q, 3, probes=4).orderBy("rank").collect()] == exact


def test_gbt_scores_every_event(spark, sf_dir):
    from querylens.plans import adapters, catalog

    want = adapters.scored(spark, sf_dir).select("item_id", "label")
    got = catalog.queries()["gbt_score"](spark, sf_dir).select("item_id", "label")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_publish_keeps_the_old_target_until_the_new_one_stands(spark, tmp_path):
    path = f"{tmp_path}/out"
    IO.publish(spark.createDataFrame([(1,)], "a int"), path, lambda df: None)
    IO.publish(spark.createDataFrame([(2,)], "a int"), path, lambda df: None)

    def wrong(df):
        raise ValueError("bad")

    with pytest.raises(ValueError, match="bad"):
        IO.publish(spark.createDataFrame([(3,)], "a int"), path, wrong)
    assert [r["a"] for r in spark.read.option("header", True).csv(path).collect()] == ["2"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]


def test_freeze_names_files_of_one_name_apart(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "x.csv").write_text("a,b\n" + "1,2\n" * k)
    entries = [{"path": f"{tmp_path}/{k}/x.csv", "bytes": 4 + 4 * k, "rows": k, "columns": ["a", "b"], "sha256": IO.sha256_file(f"{tmp_path}/{k}/x.csv")} for k in (1, 2)]
    IO.verify_freeze(spark, entries)
    with pytest.raises(ValueError, match="2/x.csv: rows; .*2/x.csv: columns"):
        IO.verify_freeze(spark, [entries[0], entries[1] | {"rows": 5, "columns": ["a"]}])
