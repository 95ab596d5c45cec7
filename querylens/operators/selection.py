"""Choosing among scored models, and evaluating whole retrieval and reranking runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.operators import metrics as M


def rank_candidates(df: DataFrame, limit: int = 2) -> DataFrame:
    """(name, score, selected) by falling score; the selected one first on ties, then by name."""
    return df.orderBy(F.col("score").desc(), F.col("selected").desc(), "name").limit(limit)


def candidate_predictions(df: DataFrame, a: str, b: str, weight_a: float, weight_b: float, threshold: float) -> DataFrame:
    """0/1 of one candidate's blend; its weights must sum to 1."""
    if abs(weight_a + weight_b - 1) > 1e-12:
        raise ValueError("weights must sum to 1")
    return df.withColumn("prediction", (weight_a * F.col(a) + weight_b * F.col(b) >= threshold).cast("int"))


def nearest_thresholds(table: DataFrame, deployed: float, n: int = 11) -> DataFrame:
    """The n rows of a threshold table nearest to the deployed threshold, in order."""
    return table.orderBy(F.round(F.abs(F.col("threshold") - deployed), 9), "threshold").limit(n).orderBy("threshold")


def placeholder_score(df: DataFrame, rank: str = "bm25_rank") -> DataFrame:
    """1 / (1 + rank) where there is a positive rank, else 0.5: for checking tables, not a metric."""
    r = F.coalesce(F.col(rank), F.lit(0))
    return df.withColumn("score", F.when(r > 0, 1 / (1 + r)).otherwise(0.5))


def model_selection(df: DataFrame, folds: list[int], weights: list[float], a: str = "a", b: str = "b", label: str = "label") -> DataFrame:
    """(name, score, selected): cross-fitted macro F1 of both models and their blend; on exact ties the blend, then the name."""

    def score(fitted: DataFrame, name: str) -> DataFrame:
        return fitted.agg(F.round(F.avg("macro_f1"), 12).alias("score")).select(F.lit(name).alias("name"), "score")

    rows = score(M.cross_fitted_threshold(df, folds, label, a), "a").unionByName(score(M.cross_fitted_threshold(df, folds, label, b), "b")).unionByName(score(M.cross_fitted_blend(df, folds, weights, label, a, b), "blend"))
    best = rows.agg(F.max_by("name", F.struct("score", (F.col("name") == "blend").alias("x"), "name")).alias("best"))
    return rows.join(F.broadcast(best), F.lit(True)).select("name", "score", (F.col("name") == F.col("best")).alias("selected"))


def comparison_rows(report: DataFrame) -> DataFrame:
    """One row a candidate of (candidates: array<struct<name, folds: array<double>>>) with the mean and deviation of its folds."""
    c = report.select(F.explode("candidates").alias("c")).select("c.name", F.posexplode("c.folds").alias("fold", "score"))
    return c.groupBy("name").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n_folds"))


def retrieval_evaluation(runs: dict[str, DataFrame], positives: DataFrame, ks: list[int] = (5, 10, 50, 100), group: str = "query_id", item: str = "item_id") -> DataFrame:
    """(run, recall at each k, mrr) of ranked runs (group, item, rank) over queries with known positives."""
    n = positives.groupBy(group).agg(F.count("*").alias("n_pos"))
    out = None
    for name, hits in runs.items():
        found = hits.join(positives.select(group, item), [group, item]).groupBy(group).agg(F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("long")).alias(f"h_{k}") for k in ks])
        q = n.join(found, group, "left")
        row = q.agg(*[F.avg(F.coalesce(F.col(f"h_{k}"), F.lit(0)) / F.col("n_pos")).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")).withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def staged_benchmark(df: DataFrame, stages: list[str], raw: str, calibrated: str, k: int = 10) -> DataFrame:
    """Ranking metrics of each stage's score, and calibration of the raw and the calibrated one."""
    rank = M.ablation(df, stages).select("variant", "recall_50", f"ndcg_{k}", "mrr")
    tall = df.select("label", F.col(raw).cast("double").alias(raw), F.col(calibrated).cast("double").alias(calibrated)).unpivot(["label"], [raw, calibrated], "variant", "p")
    return rank.join(M.calibration(tall, keys=["variant"]).select("variant", "ece", "mce"), "variant", "full_outer")
