"""Logical tables of the engine over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.text import match_form


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "lang", "source").alias("category"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), match_form(F.col("text")).alias("query"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from parts; the first word of the name stands for a colour."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.concat_ws("/", "p_type", F.split("p_name", " ")[1]).alias("category"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("renk: "), F.split("p_name", " ")[0], F.lit(", beden: "), F.col("p_size").cast("string")).alias("attributes"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (term_id, item_id) of the order lines: term is the supplier, item the part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("term_id"), F.col("l_partkey").alias("item_id")).distinct().withColumn("label", F.lit(1))


def pair_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts for the suppliers: the name of the part with the same number."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("term_id")).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.concat_ws(" ", "p_brand", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(" beden"))).alias("query")), "term_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_id, item_id, label, p, q, fold): events as scored pairs; q is a second model's probability."""
    e = table(spark, sf_dir, "events")
    p = F.round(F.least(F.col("value") / 100.0, F.lit(1.0)), 6)
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("term_id"), F.col("event_id").alias("item_id"), (F.col("event_type") == "purchase").cast("int").alias("label"), p.alias("p"), F.round(F.least(F.greatest(k / 100.0, F.lit(0.0)), F.lit(1.0)), 6).alias("q"),
        (F.col("user_id") % 5).cast("int").alias("fold"), "ts", "value", "event_type",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term_id, item_id, label, score) over labelled documents: group by source, score by length."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return d.join(l, "doc_id").select(F.col("source").alias("term_id"), F.col("doc_id").alias("item_id"), F.col("quality").alias("label"), F.round(1 - 1 / (1 + F.col("n_chars") / 1000.0), 6).alias("score"), F.concat_ws("/", "lang", "source").alias("item_category"), F.col("text").alias("query_text"))
