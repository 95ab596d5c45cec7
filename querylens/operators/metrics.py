"""Classification, ranking, calibration and threshold metrics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions.numeric import edge_bin
from querylens.operators.ranking import place


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    d = 2 * tp + fp + fn
    return F.when(d > 0, 2.0 * tp / d).otherwise(F.lit(0.0))


def confusion(y: Column, p: Column) -> list[Column]:
    def n(a: int, b: int) -> Column:
        return F.coalesce(F.sum(((y == a) & (p == b)).cast("long")), F.lit(0))

    return [n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn")]


def macro_of(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Mean F1 of the fixed labels 0 and 1; a label without rows and predictions has F1 0."""
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2


def macro_f1(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    c = df.agg(*confusion(F.col(label), F.col(predicted)))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select("tp", "tn", "fp", "fn", macro_of(tp, tn, fp, fn).alias("macro_f1"), f1(tp, fp, fn).alias("positive_f1"))


def macro_f1_at(df: DataFrame, threshold: float = 0.5, label: str = "label", p: str = "p") -> DataFrame:
    return macro_f1(df.select(F.col(label).alias("label"), (F.col(p) >= threshold).cast("int").alias("predicted")))


def curve(df: DataFrame, keys: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """For each distinct probability as an inclusive threshold: tp, fp, fn, tn.

    Rows are first counted by probability. Running sums are taken by a coarse bucket of the probability and then inside
    it, so that no window holds all probabilities; buckets are a fixed number.
    """
    keys = keys or []
    points = df.groupBy(*keys, F.col(p).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    points = points.withColumn("_b", F.floor(F.least(F.greatest(F.col("threshold"), F.lit(0.0)), F.lit(1.0)) * 1024).cast("int"))
    sums = points.groupBy(*keys, "_b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    of = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    above = of.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_b", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.sum("bp").over(of).alias("P"), F.sum("bn").over(of).alias("N"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = points.select(*keys, "_b", "threshold", F.sum("pos").over(inside).alias("ip"), F.sum("n").over(inside).alias("in_")).join(before, [*keys, "_b"])
    tp, taken = F.col("ap") + F.col("ip"), F.col("an") + F.col("in_")
    return run.select(*keys, "threshold", tp.alias("tp"), (taken - tp).alias("fp"), (F.col("P") - tp).alias("fn"), (F.col("N") - F.col("P") - (taken - tp)).alias("tn"))


def with_macro(counts: DataFrame) -> DataFrame:
    return counts.withColumn("macro_f1", F.round(macro_of(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")), 12))


def best_threshold(df: DataFrame, keys: list[str] | None = None, objective: str = "macro_f1", label: str = "label", p: str = "p", bounds: tuple[float, float] | None = None) -> DataFrame:
    """The threshold with the best score for each key: ties go to the one nearest 0.5, then the smaller.

    Scores are rounded to 12 places, which is the tolerance of a tie.
    """
    c = with_macro(curve(df, keys, label, p)).withColumn("positive_f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 12))
    if bounds:
        c = c.filter(F.col("threshold").between(*bounds))
    key = F.struct(F.col(objective).alias("s"), (-F.abs(F.col("threshold") - 0.5)).alias("d"), (-F.col("threshold")).alias("t"))
    best = c.groupBy(*(keys or [])).agg(F.max_by(F.struct("threshold", objective), key).alias("x"))
    return best.select(*(keys or []), "x.threshold", F.col(f"x.{objective}").alias(objective))


def threshold_table(df: DataFrame, thresholds: list[float], label: str = "label", p: str = "p") -> DataFrame:
    """Scores and counts at each of a given list of thresholds, in one pass."""
    y, q = F.col(label), F.col(p)
    rows = df.select(y.alias("y"), F.explode(F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), (q >= t).cast("int").alias("hat")))).alias("x"))
    c = rows.groupBy("x.threshold").agg(*confusion(F.col("y"), F.col("x.hat")))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return c.select(
        "threshold", macro_of(tp, tn, fp, fn).alias("macro_f1"), f1(tp, fp, fn).alias("f1_positive"), f1(tn, fn, fp).alias("f1_negative"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        "tn", "fp", "fn", "tp", share(tp + fp, tp + fp + tn + fn).alias("positive_rate"),
    )


def ranked(df: DataFrame, group: str = "term_id", item: str = "item_id", score: str = "score") -> DataFrame:
    return df.withColumn("rn", place([group], F.col(score).desc(), F.col(item)))


def ideal_gain(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))).otherwise(0.0)


def per_query(df: DataFrame, ks: list[int], group: str = "term_id", item: str = "item_id", score: str = "score", label: str = "label", extra: list[str] | None = None) -> DataFrame:
    """One row a query: hits and gain up to each k, positives, place of the first positive. One sort, one aggregation."""
    y, rn = F.col(label), F.col("rn")
    made = [F.sum(y.cast("long")).alias("n_pos"), F.min(F.when(y == 1, rn)).alias("first_pos"), F.count("*").alias("n_items")]
    for k in ks:
        made += [F.sum(F.when(rn <= k, y).otherwise(0).cast("long")).alias(f"hits_{k}"), F.sum(F.when((rn <= k) & (y == 1), 1 / F.log2(rn + 1.0)).otherwise(0.0)).alias(f"gain_{k}")]
    return ranked(df, group, item, score).groupBy(group, *(extra or [])).agg(*made)


def report_columns(ks: list[int]) -> list[Column]:
    """recall and ndcg over queries with positives (0 without any), precision and mrr over all queries."""
    some = F.col("n_pos") > 0
    out = []
    for k in ks:
        ideal = ideal_gain(F.least(F.col("n_pos"), F.lit(k)))
        out += [
            F.coalesce(F.avg(F.when(some, F.col(f"hits_{k}") / F.col("n_pos"))), F.lit(0.0)).alias(f"recall_{k}"), F.avg(F.col(f"hits_{k}") / F.lit(k)).alias(f"precision_{k}"),
            F.coalesce(F.avg(F.when(some, F.col(f"gain_{k}") / ideal)), F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return [*out, F.avg(F.coalesce(1 / F.col("first_pos"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n_queries")]


def ranking_report(df: DataFrame, ks: list[int] = (1, 5, 10, 20, 50, 100), by: list[str] | None = None, **names: str) -> DataFrame:
    q = per_query(df, list(ks), extra=by, **names)
    return (q.groupBy(*by) if by else q.groupBy()).agg(*report_columns(list(ks)))


def nested_cut_metrics(df: DataFrame, k: int, group: str = "term_id", item: str = "item_id", score: str = "score", label: str = "label") -> DataFrame:
    """MRR and NDCG cut at k over all queries; those without positives count 0."""
    q = per_query(df, [k], group, item, score, label)
    ideal = ideal_gain(F.least(F.col("n_pos"), F.lit(k)))
    return q.agg(F.avg(F.when(F.col("first_pos") <= k, 1 / F.col("first_pos")).otherwise(0.0)).alias("mrr_at_k"), F.avg(F.when(F.col("n_pos") > 0, F.col(f"gain_{k}") / ideal).otherwise(0.0)).alias("ndcg_at_k"))


def calibration(df: DataFrame, n_bins: int = 10, keys: list[str] | None = None, label: str = "label", p: str = "p", include_right_edge: bool = False) -> DataFrame:
    """ece, mce, avg_confidence, avg_accuracy, bias. p = 1 is in no bin unless ``include_right_edge``, but counts in N."""
    keys = keys or []
    b = edge_bin(F.col(p), n_bins)
    rows = df.select(*keys, F.col(label).cast("double").alias("y"), F.col(p).alias("q"), (F.least(b, F.lit(n_bins - 1)) if include_right_edge else b).alias("bin"))
    bins = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("q").alias("sq"))
    gap = F.when(F.col("bin") < n_bins, F.abs(F.col("sy") - F.col("sq")))
    out = bins.groupBy(*keys).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("g"), F.sum("n").alias("N"), F.coalesce(F.max(gap / F.col("n")), F.lit(0.0)).alias("mce"), F.sum("sy").alias("SY"), F.sum("sq").alias("SQ"))
    n = F.col("N")
    return out.select(*keys, (F.col("g") / n).alias("ece"), "mce", (F.col("SQ") / n).alias("avg_confidence"), (F.col("SY") / n).alias("avg_accuracy"), ((F.col("SQ") - F.col("SY")) / n).alias("bias"))


def hinge_loss(pairs: DataFrame, positive: str = "pos_score", negative: str = "neg_score", margin: float = 1.0) -> DataFrame:
    return pairs.agg(F.avg(F.greatest(F.lit(0.0), margin - (F.col(positive) - F.col(negative)))).alias("loss"))


def listnet_loss(df: DataFrame, group: str = "term_id", score: str = "score", label: str = "label") -> DataFrame:
    """Mean over groups of the cross entropy between the softmax of labels and of scores."""
    w = Window.partitionBy(group)
    z = F.col(score) - F.max(score).over(w)
    y = F.col(label) - F.max(label).over(w)
    rows = df.select(group, z.alias("z"), y.cast("double").alias("y"))
    target = F.exp("y") / F.sum(F.exp("y")).over(w)
    return rows.select(group, (-target * (F.col("z") - F.log(F.sum(F.exp("z")).over(w)))).alias("l")).groupBy(group).agg(F.sum("l").alias("l")).agg(F.avg("l").alias("loss"))


def disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.sum((F.col(a) != F.col(b)).cast("long")).alias("rows"), F.avg((F.col(a) != F.col(b)).cast("double")).alias("rate"))


def class_balance(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.col(predicted).cast("long")).alias("n_positive"), F.avg(F.col(predicted).cast("double")).alias("positive_rate"))


def fold_importance(df: DataFrame) -> DataFrame:
    """(feature, gain, split) of folds -> mean and population deviation, gain share, folds in use; best first."""
    g = df.groupBy("feature").agg(F.avg("gain").alias("gain_mean"), F.stddev_pop("gain").alias("gain_std"), F.avg("split").alias("split_mean"), F.stddev_pop("split").alias("split_std"), F.sum((F.col("gain") > 0).cast("long")).alias("non_zero_folds"))
    total = g.agg(F.sum("gain_mean")).first()[0] or 0.0
    return g.withColumn("gain_share", F.col("gain_mean") / F.lit(total) if total else F.lit(0.0)).orderBy(F.col("gain_mean").desc(), "feature")


def long_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of a wide table."""
    values = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "metric", "value")


def ablation(df: DataFrame, scores: list[str], group: str = "term_id", item: str = "item_id", label: str = "label") -> DataFrame:
    """Ranking and calibration of several score columns; ece is null where a variant's scores leave [0, 1]."""
    tall = df.select(group, item, label, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot([group, item, label], scores, "variant", "score")
    rank = rank_by_variant(tall, group, item, label)
    inside = tall.groupBy("variant").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    ece = calibration(tall, 10, ["variant"], label, "score").select("variant", "ece")
    return rank.join(ece, "variant").join(inside, "variant").withColumn("ece", F.when((F.col("lo") >= 0) & (F.col("hi") <= 1), F.col("ece"))).drop("lo", "hi")


def rank_by_variant(tall: DataFrame, group: str, item: str, label: str) -> DataFrame:
    ks = [10, 50, 100]
    both = tall.withColumn("_g", F.concat_ws("\x01", "variant", F.col(group).cast("string")))
    q = per_query(both, ks, "_g", item, "score", label, extra=["variant"])
    return q.groupBy("variant").agg(*report_columns(ks)).select("variant", "recall_50", "recall_100", "precision_10", "ndcg_10", "mrr")


# --- Cross-fitted selection -----------------------------------------------------------------------------------------


def hash_folds(df: DataFrame, group: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` by a hash of the group, which keeps groups whole."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(n)).cast("int"))


def balanced_folds(df: DataFrame, group: str, label: str = "label", n: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` with whole groups and about equal rows and positives.

    Groups are dealt in a snake by falling number of positives and rows; the order is over groups, not rows.
    """
    sizes = df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("rows"))
    # Groups of one size class are interchangeable, so dealing within a class needs no global sort.
    cls = Window.partitionBy("pos", "rows").orderBy(F.xxhash64(F.lit(seed), group), group)
    dealt = sizes.withColumn("_k", F.row_number().over(cls) - 1 + F.pmod(F.xxhash64(F.lit(seed), "pos", "rows"), F.lit(n)))
    fold = F.when(F.floor(F.col("_k") / n) % 2 == 0, F.col("_k") % n).otherwise(n - 1 - F.col("_k") % n)
    return df.join(dealt.select(group, fold.cast("int").alias("fold")), group)


def leave_one_out(df: DataFrame, folds: list[int]) -> DataFrame:
    """Each row once for every fold that it is not in, as ``held``."""
    return df.withColumn("held", F.explode(F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col("fold"))))


def cross_fitted_threshold(df: DataFrame, folds: list[int], label: str = "label", p: str = "p") -> DataFrame:
    """For each held fold: the threshold chosen on the others, and the macro F1 it gives on the fold."""
    chosen = best_threshold(leave_one_out(df, folds), ["held"], label=label, p=p).withColumnRenamed("macro_f1", "fit_f1")
    marked = df.join(F.broadcast(chosen.select(F.col("held").alias("fold"), "threshold")), "fold").select("fold", F.col(label).alias("y"), (F.col(p) >= F.col("threshold")).cast("int").alias("hat"))
    scores = with_macro(marked.groupBy("fold").agg(*confusion(F.col("y"), F.col("hat")))).select(F.col("fold").alias("held"), "macro_f1")
    return chosen.join(scores, "held")


def cross_fitted_blend(df: DataFrame, folds: list[int], weights: list[float], label: str = "label", a: str = "a", b: str = "b") -> DataFrame:
    """For each held fold: weight and threshold chosen on the others (ties: weight, then threshold, nearest 0.5)."""
    w = F.explode(F.array(*map(F.lit, weights)))
    grid = leave_one_out(df, folds).withColumn("weight", w).withColumn("p", F.round(F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b), 9))
    each = best_threshold(grid, ["held", "weight"], label=label, p="p")
    key = F.struct(F.col("macro_f1").alias("s"), (-F.round(F.abs(F.col("weight") - 0.5), 9)).alias("w"), (-F.abs(F.col("threshold") - 0.5)).alias("t"), (-F.col("weight")).alias("x"))
    chosen = each.groupBy("held").agg(F.max_by(F.struct("weight", "threshold", "macro_f1"), key).alias("c")).select("held", "c.weight", "c.threshold", F.col("c.macro_f1").alias("fit_f1"))
    rows = df.join(F.broadcast(chosen.select(F.col("held").alias("fold"), "weight", "threshold")), "fold")
    hat = (F.round(F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b), 9) >= F.col("threshold")).cast("int")
    scores = with_macro(rows.select("fold", F.col(label).alias("y"), hat.alias("hat")).groupBy("fold").agg(*confusion(F.col("y"), F.col("hat")))).select(F.col("fold").alias("held"), "macro_f1")
    return chosen.join(scores, "held")


def global_blend(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Columns scaled to [0, 1] over all rows (constant: 1), then blended."""
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in parts for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()

    def scaled(c: str) -> Column:
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        return F.lit(1.0) if lo is None or hi == lo else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)

    total = F.lit(0.0)
    for c, w in parts.items():
        total = total + w * scaled(c)
    return df.withColumn("blend", F.round(total, 9))


def band_override(base: DataFrame, band: DataFrame, base_threshold: float, band_threshold: float, key: str = "id") -> DataFrame:
    """0/1 of ``base`` (key, p), but of ``band`` (key, p) wherever it has a finite score; band keys must all be in base."""
    lost = band.join(base, key, "left_anti").limit(1).count()
    if lost or band.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("band keys must be unique and in the base")
    joined = base.select(key, F.col("p").alias("_p")).join(band.select(key, F.col("p").alias("_q")), key, "left")
    gated = F.col("_q").isNotNull() & ~F.isnan("_q")
    return joined.select(key, F.when(gated, (F.col("_q") >= band_threshold).cast("int")).otherwise((F.col("_p") >= base_threshold).cast("int")).alias("prediction"))
