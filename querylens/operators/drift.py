"""Drift between a reference and a current sample of a numeric column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_edges(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Distinct inner quantiles of the reference."""
    row = df.agg(F.percentile(column, [i / n_bins for i in range(n_bins + 1)])).first()[0]
    return sorted(set(row))[1:-1] if row else []


def psi(reference: DataFrame, current: DataFrame, column: str, n_bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over the reference's quantile bins (equal edges collapse, ends are open)."""
    edges = quantile_edges(reference, column, n_bins)
    bins = len(edges) + 1

    def binned(df: DataFrame, side: str) -> DataFrame:
        b = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(column))) if edges else F.lit(0)
        return df.filter(F.col(column).isNotNull()).select(b.alias("bin"), F.lit(side).alias("side"))

    counts = binned(reference, "r").unionByName(binned(current, "c")).groupBy("bin").agg(F.sum((F.col("side") == "r").cast("long")).alias("r"), F.sum((F.col("side") == "c").cast("long")).alias("c"))
    total = counts.agg(F.sum("r"), F.sum("c")).first()
    n_r, n_c = total[0] or 0, total[1] or 0
    # Bins without rows on either side contribute nothing: both shares are eps / (N + eps * B) only when N is equal.
    empty = bins - counts.count()
    r, c = (F.col("r") + eps) / (n_r + eps * bins), (F.col("c") + eps) / (n_c + eps * bins)
    r0, c0 = eps / (n_r + eps * bins), eps / (n_c + eps * bins)
    rest = empty * (c0 - r0) * math.log(c0 / r0)
    return counts.agg((F.coalesce(F.sum((c - r) * F.log(c / r)), F.lit(0.0)) + F.lit(rest)).alias("psi"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Two-sided asymptotic p-value."""
    if not n or not m:
        return 1.0
    x = d * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(statistic, n_reference, n_current): the largest distance of the two distribution functions.

    Values are counted, then summed up in buckets of quantiles and inside them, so no task holds all values.
    """
    both = reference.select(F.col(column).cast("double").alias("x"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    points = both.filter("x is not null").groupBy("x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    cuts = points.agg(F.percentile_approx("x", [i / 256 for i in range(1, 256)], 10_000)).first()[0] or []
    b = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda e: e < F.col("x"))) if cuts else F.lit(0)
    points = points.withColumn("b", b)
    one = Window.partitionBy(F.lit(0))
    sums = points.groupBy("b").agg(F.sum("r").alias("br"), F.sum("c").alias("bc"))
    before = one.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("b", F.coalesce(F.sum("br").over(before), F.lit(0)).alias("pr"), F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("pc"), F.sum("br").over(one).alias("n"), F.sum("bc").over(one).alias("m"))
    inside = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = points.select("b", F.sum("r").over(inside).alias("ir"), F.sum("c").over(inside).alias("ic")).join(F.broadcast(offsets), "b")
    gap = F.abs((F.col("pr") + F.col("ir")) / F.col("n") - (F.col("pc") + F.col("ic")) / F.col("m"))
    return run.agg(F.max(gap).alias("statistic"), F.max("n").alias("n_reference"), F.max("m").alias("n_current"))


def severity(value: Column) -> Column:
    return F.when(value >= 0.25, "CRITICAL").when(value >= 0.1, "WARNING").otherwise("OK")


def drift_report(reference: DataFrame, current: DataFrame, columns: list[str], threshold: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """psi, ks statistic and p-value, severity and verdict of each column."""
    out = None
    for c in columns:
        k = ks(reference, current, c).first()
        p = ks_p_value(k["statistic"] or 0.0, k["n_reference"] or 0, k["n_current"] or 0)
        row = psi(reference, current, c).select(F.lit(c).alias("column"), "psi", F.lit(float(k["statistic"] or 0.0)).alias("ks"), F.lit(p).alias("p_value"))
        row = row.withColumns({"severity": severity(F.col("psi")), "drift": (F.col("psi") >= threshold) | (F.col("p_value") < alpha)})
        out = row if out is None else out.unionByName(row)
    return out


def quantile_distance(reference: DataFrame, candidate: DataFrame, column: str) -> DataFrame:
    """Mean absolute difference of 101 quantiles over the reference's population deviation."""
    qs = [i / 100 for i in range(101)]
    a = reference.agg(F.percentile(column, qs).alias("q"), F.stddev_pop(column).alias("s")).first()
    b = candidate.agg(F.percentile(column, qs).alias("q2"))
    mean = F.aggregate(F.zip_with(F.array(*map(F.lit, a["q"])), F.col("q2"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 101
    return b.select((mean / max(a["s"] or 0.0, 1e-12)).alias("distance"))


def shift_rows(df: DataFrame, features: list[str], by: str) -> DataFrame:
    """Mean and share of zeros of each feature for each value of ``by``."""
    tall = df.select(by, *[F.col(c).cast("double").alias(c) for c in features]).unpivot([by], features, "feature", "x")
    return tall.groupBy(by, "feature").agg(F.avg("x").alias("mean"), F.avg((F.col("x") == 0).cast("double")).alias("zero_rate"))


def shift_summary(reference: DataFrame, candidates: DataFrame, features: list[str], by: str) -> DataFrame:
    """(by, mean_distance, max_distance, rank): how far each value's rows lie from the reference; the best is first.

    The distance of a feature is that of ``quantile_distance``; all values and features are one aggregation.
    """
    qs = [i / 100 for i in range(101)]
    ref = reference.agg(*[F.percentile(c, qs).alias(f"q_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    g = candidates.groupBy(by).agg(*[F.percentile(c, qs).alias(c) for c in features])

    def distance(c: str) -> Column:
        apart = F.zip_with(F.array(*map(F.lit, ref[f"q_{c}"])), F.col(c), lambda x, y: F.abs(x - y))
        return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / 101 / max(ref[f"s_{c}"] or 0.0, 1e-12)

    every = F.array(*[distance(c) for c in features])
    out = g.select(by, (F.aggregate(every, F.lit(0.0), lambda s, x: s + x) / len(features)).alias("mean_distance"), F.array_max(every).alias("max_distance"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("mean_distance", by)))
