"""The boundary to models: Spark ML learners, injected scorers, calibrators and vector indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.functions.numeric import dot, logit
from querylens.operators.metrics import best_threshold
from querylens.operators.ranking import top_k


def gbt_scores(df: DataFrame, features: list[str], label: str = "label", fold: str = "fold", folds: list[int] = (0, 1, 2, 3, 4), **params) -> DataFrame:
    """Out-of-fold probabilities of gradient-boosted trees, one model a held-out fold."""
    assembled = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)
    out = None
    for f in folds:
        model = GBTClassifier(featuresCol="_x", labelCol=label, seed=42, **{"maxIter": 20, "maxDepth": 4} | params).fit(assembled.filter(F.col(fold) != f))
        part = model.transform(assembled.filter(F.col(fold) == f)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def injected_scores(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], columns: list[str], name: str = "score") -> DataFrame:
    """A column from any model: ``scorer`` gets Arrow batches of ``columns`` as frames."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(scorer(b)).astype("float64")

    return df.withColumn(name, run(F.struct(*columns)))


def fold_mean(df: DataFrame, columns: list[str], name: str = "p") -> DataFrame:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return df.withColumn(name, total / len(columns))


def encoded(df: DataFrame, encoder: Callable[[pd.Series], list], text: str, name: str = "embedding") -> DataFrame:
    """``name`` as array<float> of an injected text encoder."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(encoder(b)))

    return df.withColumn(name, run(F.col(text)))


def platt(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """``calibrated`` by a logistic model on the log odds."""
    x = df.withColumn("_x", array_to_vector(F.array(logit(F.col(p)))))
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1e-3 / max(df.count(), 1), maxIter=200).fit(x)
    return model.transform(x).withColumn("calibrated", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def isotonic(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    x = df.withColumn("_y", F.col(label).cast("double"))
    model = IsotonicRegression(featuresCol=p, labelCol="_y", predictionCol="calibrated").fit(x)
    return model.transform(x).withColumn("calibrated", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0))).drop("_y")


def category_thresholds(df: DataFrame, category: str, default: float = 0.5, bounds: tuple[float, float] = (0.1, 0.9), label: str = "label", p: str = "p") -> DataFrame:
    """The probability with the best positive-class F1 for each category; without positives, or any in bounds, the default."""
    best = best_threshold(df, [category], "positive_f1", label, p, bounds)
    pos = df.groupBy(category).agg(F.max(label).alias("_any"))
    return pos.join(best, category, "left").select(category, F.when(F.col("_any") == 1, F.coalesce("threshold", F.lit(default))).otherwise(default).alias("threshold"))


def expanded_triplets(df: DataFrame) -> DataFrame:
    """(query, doc, label) of (query, positive_doc, hard_negatives)."""
    docs = F.concat(F.array(F.struct(F.col("positive_doc").alias("doc"), F.lit(1).alias("label"))), F.transform("hard_negatives", lambda d: F.struct(d.alias("doc"), F.lit(0).alias("label"))))
    return df.select("query", F.explode(docs).alias("x")).select("query", "x.doc", "x.label")


def ivf_assign(vectors: DataFrame, cells: int = 256, key: str = "vec_id", seed: int = 42):
    """(model, vectors with ``cell``): an inverted-file index by k-means cells; write it partitioned by cell."""
    x = vectors.withColumn("_x", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(featuresCol="_x", predictionCol="cell", k=cells, seed=seed, maxIter=10).fit(x)
    return model, model.transform(x).drop("_x")


def ivf_search(model, index: DataFrame, queries: DataFrame, k: int, probes: int = 32, key: str = "vec_id") -> DataFrame:
    """The k nearest by inner product among the ``probes`` cells nearest to each (query_id, qv)."""
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    table = F.array(*[F.struct(F.lit(i).alias("cell"), F.array(*map(F.lit, c)).alias("c")) for i, c in enumerate(centres)])
    near = F.slice(F.array_sort(F.transform(table, lambda t: F.struct((dot(t["c"], t["c"]) - 2 * dot(t["c"], F.col("qv"))).alias("d"), t["cell"].alias("cell")))), 1, probes)
    asked = queries.select("query_id", "qv", F.explode(F.transform(near, lambda t: t["cell"])).alias("cell"))
    scored = asked.join(index, "cell").select("query_id", key, F.round(dot(F.col("qv"), F.col("embedding")), 6).alias("score"))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col(key)], k)


def reduced(df: DataFrame, tokens: str, size: int = 50_000, k: int = 384) -> DataFrame:
    """``embedding``: truncated SVD of TF-IDF rows through Spark's PCA on hashed features, L2-normalised.

    Signs and rotation are not fixed by the decomposition.
    """
    from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer

    tf = HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=size).transform(df)
    weighted = IDF(inputCol="_tf", outputCol="_w").fit(tf).transform(tf)
    short = PCA(k=k, inputCol="_w", outputCol="_p").fit(weighted).transform(weighted)
    return Normalizer(inputCol="_p", outputCol="_n").transform(short).withColumn("embedding", vector_to_array("_n", "float32")).drop("_tf", "_w", "_p", "_n")
