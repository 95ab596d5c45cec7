"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, and source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Decisions are by doc_id: where rows
share one, the decision on any of them holds for all; rows with a null doc_id are never rejected, and keep their lines.

Edge cases: a null or empty text fails the quality rules, so it goes; a text whose lines all go to another document is
empty and stays; rows equal in id and text (exact copies with one doc_id) all stay or all go, and of copies with different
ids the smallest stays, so there are no ties; texts of any length are taken whole; further columns than COLUMNS are
dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.llm._spark import written
from querylens.llm.decontaminate import decontaminate
from querylens.llm.line_dedup import line_dedup
from querylens.llm.mixing import mix_report, mixed
from querylens.llm.ngram_join import ngram_join
from querylens.llm.quality_rules import quality_rules
from querylens.sources.scratch import spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Most ids of rejected documents that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the documents in ``rejected`` (doc_id)."""
    ids = written(rejected.select("doc_id").distinct(), "rejected")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return without(docs, quality_rules(docs).filter("not kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a text that loses all lines is empty."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return without(docs, ngram_join(docs).filter("component_id != doc_id"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_report(*mixed(docs))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("mixture", mixture)]

#: The mix is drawn by keyed hashes, which SQL on another engine does not have; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
