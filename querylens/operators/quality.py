"""Data quality, error and segment reports, and the negative pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions import numeric as N
from querylens.functions import text as X
from querylens.operators import metrics as M
from querylens.operators.ranking import capped_top, top_k

# What an attribute text must hold to count as naming a colour, a size or a material.
COVERAGE = {
    "renk_coverage": r"renk\s*[:\|]?\s*\w+",
    "beden_coverage": r"(?:beden|numara|size)\s*[:\|]?\s*[\w,]+",
    "materyal_coverage": r"(?:materyal|kumaş|malzeme)\s*[:\|]?\s*\w+",
}
#: How nulls read as text; such attributes and brands count as none.
NONE = ("", "nan", "None")


def duplicate_queries(terms: DataFrame) -> DataFrame:
    """(normal, n_ids, ids): queries that several ids share after lower-casing and spacing."""
    g = terms.select("term_id", X.spaced_form(F.col("query")).alias("normal")).groupBy("normal").agg(F.count_distinct("term_id").alias("n_ids"), F.array_sort(F.collect_set("term_id")).alias("ids"))
    return g.filter("n_ids > 1")


def coverage_columns(attributes: Column) -> list[Column]:
    text = F.coalesce(attributes, F.lit("nan"))
    filled = F.avg((~text.isin(*NONE)).cast("double")).alias("non_null_rate")
    return [filled, *[F.avg(text.rlike(f"(?iU){p}").cast("double")).alias(name) for name, p in COVERAGE.items()]]


def attribute_coverage(items: DataFrame, least: int = 10) -> DataFrame:
    """Over all items (category null) and for each first level with at least ``least`` items, in one pass."""
    l1 = F.trim(F.split(F.coalesce("category", F.lit("")), "/")[0]).alias("category_l1")
    g = items.select(l1, "attributes").groupingSets([["category_l1"], []], "category_l1").agg(F.grouping_id().alias("_g"), F.count("*").alias("n_items"), *coverage_columns(F.col("attributes")))
    return g.filter((F.col("_g") == 1) | (F.col("n_items") >= least)).drop("_g")


def label_consistency(pairs: DataFrame) -> DataFrame:
    """(n_pairs, n_conflicts, n_duplicates)."""
    g = pairs.groupBy("term_id", "item_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_pairs"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("n_conflicts"), F.sum((F.col("n") > 1).cast("long")).alias("n_duplicates"))


def metadata_report(items: DataFrame) -> DataFrame:
    """One row: brands (null is one of them), null rates, and depths of the category path over raw ``/`` splits."""
    depth = F.size(F.split(F.coalesce("category", F.lit("nan")), "/"))
    brand = F.coalesce(F.col("brand"), F.lit("nan"))
    made = [
        F.count("*").alias("n_items"), F.count_distinct(brand).alias("n_brands"), F.avg(brand.isin(*NONE).cast("double")).alias("brand_null_rate"),
        F.avg(depth.cast("double")).alias("depth_mean"), F.min(depth).alias("depth_min"), F.max(depth).alias("depth_max"),
    ]
    if "gender" in items.columns:  # a null counts by itself and as the text that it reads as
        gender = F.col("gender")
        reads = F.lower(F.coalesce(gender, F.lit("nan"))).isin("nan", "none", "")
        made.append((F.avg(gender.isNull().cast("double")) + F.avg(reads.cast("double"))).alias("gender_null_rate"))
    return items.agg(*made)


def depth_distribution(items: DataFrame) -> DataFrame:
    """(depth, n): items by the depth of their category path."""
    depth = F.size(F.split(F.coalesce("category", F.lit("nan")), "/")).alias("depth")
    return items.groupBy(depth).agg(F.count("*").alias("n"))


def value_shares(items: DataFrame, column: str) -> DataFrame:
    """Shares of a column's folded values, blanks as unknown, rounded to 4 places."""
    v = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    counts = items.groupBy(F.when(v.isin("", "nan", "none"), "unknown").otherwise(v).alias("value")).agg(F.count("*").alias("n"))
    total = items.count()
    return counts.withColumn("share", F.round(F.col("n") / F.lit(max(total, 1)), 4))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def full_report(terms: DataFrame, items: DataFrame, pairs: DataFrame) -> dict:
    """All sections as rows; a section that fails gives its error and leaves the others."""
    out = {}
    for name, make in (
        ("duplicate_queries", lambda: duplicate_queries(terms).orderBy("normal").limit(10)), ("attribute_coverage", lambda: attribute_coverage(items)), ("label_consistency", lambda: label_consistency(pairs)), ("metadata", lambda: metadata_report(items)),
    ):
        try:
            out[name] = [r.asDict() for r in make().collect()]
        except Exception as e:  # noqa: BLE001 - the report shows what went wrong
            out[name] = {"error": str(e).splitlines()[0]}
    return out


# --- Errors -----------------------------------------------------------------------------------------------------------


def error_split(df: DataFrame, threshold: float = 0.5, label: str = "label", p: str = "p") -> DataFrame:
    hat, y = F.col(p) >= threshold, F.col(label) == 1
    return df.withColumn("error_type", F.when(y & hat, "TP").when(~y & ~hat, "TN").when(~y & hat, "FP").otherwise("FN"))


def error_signal() -> Column:
    """The first of eight signals that applies."""
    return (
        F.when(F.col("query_model_token_conflict") == 1, "MODEL_CODE_CONFLICT").when(F.col("demographic_conflict") == 1, "DEMOGRAPHIC_CONFLICT").when(F.col("query_color_match") == -1, "COLOR_CONFLICT")
        .when(F.col("query_size_match") == -1, "SIZE_CONFLICT").when(F.col("query_material_match") == -1, "MATERIAL_CONFLICT").when((F.col("query_title_overlap") == 0) & (F.col("query_category_overlap") == 0), "NO_LEXICAL_EVIDENCE")
        .when((F.col("label") == 0) & (F.col("query_title_coverage") >= 0.5), "LEXICAL_DECOY").otherwise("OTHER")
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def confident_errors(df: DataFrame, n: int = 10, p: str = "p", key: str = "item_id") -> DataFrame:
    """The n false positives with the largest and the n false negatives with the smallest probability."""
    fp = df.filter("error_type = 'FP'").orderBy(F.col(p).desc(), key).limit(n)
    fn = df.filter("error_type = 'FN'").orderBy(F.col(p), key).limit(n)
    return fp.unionByName(fn)


def error_patterns(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column for false positives and for false negatives."""
    g = df.filter(F.col("error_type").isin("FP", "FN")).groupBy("error_type", F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return top_k(g, ["error_type"], [F.col("n").desc(), F.col("value")], n)


def describe_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max of each column, rounded to 3 places."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "x")
    r = lambda c: F.round(c, 3)
    return tall.groupBy("feature").agg(F.count("x").alias("count"), r(F.avg("x")).alias("mean"), r(F.stddev_samp("x")).alias("std"), r(F.min("x")).alias("min"), r(F.percentile("x", 0.25)).alias("q25"), r(F.median("x")).alias("q50"), r(F.percentile("x", 0.75)).alias("q75"), r(F.max("x")).alias("max"))


# --- Segments ---------------------------------------------------------------------------------------------------------


def error_report(df: DataFrame, by: list[str], top: int = 10, p: str = "p", key: str = "item_id") -> DataFrame:
    """(section, name, n, share) of rows with ``error_type``: outcomes, the errors' values of ``by``, and the surest errors.

    Shares are of all rows, of all errors of the kind, and for the surest errors (n is their rank) the probability.
    """
    total = Window.partitionBy("section")
    outcomes = df.groupBy(F.lit("outcome").alias("section"), F.col("error_type").alias("name")).agg(F.count("*").alias("n"))
    wrong = df.filter("error_type in ('FP', 'FN')")
    tall = wrong.select("error_type", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in by])).alias("x"))
    patterns = tall.groupBy(F.concat("error_type", F.lit("_by_"), "x.c").alias("section"), F.col("x.v").alias("name")).agg(F.count("*").alias("n"))
    counts = outcomes.unionByName(patterns).withColumn("share", F.col("n") / F.sum("n").over(total))
    out = counts
    for kind, first in (("FP", F.col(p).desc()), ("FN", F.col(p).asc())):
        surest = top_k(wrong.filter(F.col("error_type") == kind).withColumn("section", F.lit(f"top_{kind}")), ["section"], [first, F.col(key)], top)
        out = out.unionByName(surest.select("section", F.col(key).cast("string").alias("name"), F.col("rank").cast("long").alias("n"), F.col(p).cast("double").alias("share")))
    return out


def segment_report(df: DataFrame, levels: Column, query: dict[str, Column]) -> DataFrame:
    """``segment_breakdown`` of five families at once: first category level, length class, and the flags that hold.

    ``query``: length_class and boolean flags of the row's query, as ``query_segments`` of the features makes them.
    """
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in query.items() if name != "length_class"]
    every = F.array(F.concat(F.lit("category="), X.category_level(levels, 1)), F.concat(F.lit("length="), query["length_class"]), *flags)
    tall = df.withColumn("segment_", F.explode(F.filter(every, lambda x: x.isNotNull())))
    return segment_breakdown(tall, "segment_")


def mean_separation(df: DataFrame, scores: list[str], label: str = "label") -> DataFrame:
    """(score, separation): the mean of positives less the mean of others, for each score column; largest first."""
    tall = df.select(label, *[F.col(c).cast("double").alias(c) for c in scores]).unpivot([label], scores, "score", "x")
    g = tall.groupBy("score").agg((F.avg(F.when(F.col(label) == 1, F.col("x"))) - F.avg(F.when(F.col(label) != 1, F.col("x")))).alias("separation"))
    return g.orderBy(F.col("separation").desc(), "score")


def pipeline_checks(pairs: DataFrame, terms: DataFrame, items: DataFrame, sample: DataFrame, submission: DataFrame) -> DataFrame:
    """One row that says what is wrong with the tables: counts, repeats, labels, dangling references, order of ids.

    ``sample`` and ``submission``: (row_idx, id), in the order of their files.
    """
    def dangling(df: DataFrame, to: DataFrame, key: str) -> int:
        return df.join(to.select(key).distinct(), key, "left_anti").count()

    repeats = pairs.groupBy("term_id", "item_id").count().filter("count > 1").count()
    about = pairs.agg(F.count("*").alias("n_pairs"), F.sum((F.coalesce("label", F.lit(0)) != 1).cast("long")).alias("n_not_positive"))
    both = sample.select("row_idx", F.col("id").alias("a")).join(submission.select("row_idx", F.col("id").alias("b")), "row_idx", "full_outer")
    row = about.select(
        "n_pairs", F.lit(terms.count()).alias("n_terms"), F.lit(items.count()).alias("n_items"), F.lit(repeats).alias("n_repeated_pairs"), F.coalesce("n_not_positive", F.lit(0)).alias("n_not_positive"),
        F.lit(terms.count() - terms.select("term_id").distinct().count()).alias("n_repeated_terms"), F.lit(items.count() - items.select("item_id").distinct().count()).alias("n_repeated_items"),
        F.lit(dangling(pairs, terms, "term_id")).alias("n_lost_terms"), F.lit(dangling(pairs, items, "item_id")).alias("n_lost_items"), F.lit(both.filter(~F.col("a").eqNullSafe(F.col("b"))).count()).alias("n_misplaced"),
    )
    wrong = sum((F.col(c) for c in ("n_repeated_pairs", "n_not_positive", "n_repeated_terms", "n_repeated_items", "n_lost_terms", "n_lost_items", "n_misplaced")), F.lit(0))
    return row.withColumn("valid", wrong == 0)


def segment_breakdown(df: DataFrame, segment: str, ks: int = 10, p: str = "score", n_bins: int = 10) -> DataFrame:
    """recall, ndcg, mrr and ece for each value of ``segment``; queries are ranked within it."""
    both = df.withColumn("_g", F.concat_ws("\x01", segment, F.col("term_id").cast("string")))
    q = M.per_query(both, [ks], "_g", extra=[segment]).groupBy(segment).agg(*M.report_columns([ks]), F.sum("n_items").alias("n_pairs"))
    return q.join(M.calibration(df, n_bins, [segment], "label", p).select(segment, "ece"), segment).select(F.col(segment).alias("segment"), "n_queries", "n_pairs", f"recall_{ks}", f"ndcg_{ks}", "mrr", "ece")


# --- Uncertainty ------------------------------------------------------------------------------------------------------


def uncertainty(df: DataFrame, p: str = "p") -> DataFrame:
    c = F.col(p)
    return df.withColumns({"entropy": N.entropy_bits(c), "margin": N.margin(c), "least_conf": N.least_confidence(c)}).withColumn("hybrid", (F.col("entropy") + F.col("margin") + F.col("least_conf")) / 3)


def uncertain_pairs(df: DataFrame, n: int, strategy: str = "entropy", per_query: int = 5, p: str = "p") -> DataFrame:
    scored = uncertainty(df, p).withColumn("uncertainty", F.round(F.col(strategy), 9))
    return capped_top(scored, ["term_id"], [F.col("uncertainty").desc(), F.col("term_id"), F.col("item_id")], per_query, n)


# --- Pool -------------------------------------------------------------------------------------------------------------

POOL = "term_id string, item_id string, source string, status string, added_at string, verified_at string, annotator_id string, notes string"


def pool_insert(pool: DataFrame, new: DataFrame, source: str, now: str) -> DataFrame:
    """The pool with those pairs of ``new`` that it lacks; existing rows win and repeats count once."""
    keys = ["term_id", "item_id"]
    fresh = new.select(*keys).dropDuplicates(keys).join(pool.select(*keys), keys, "left_anti")
    blank = F.lit(None).cast("string")
    return pool.unionByName(fresh.select(*keys, F.lit(source).alias("source"), F.lit("UNVERIFIED").alias("status"), F.lit(now).alias("added_at"), blank.alias("verified_at"), blank.alias("annotator_id"), blank.alias("notes")))


def pool_verify(pool: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``verdicts`` (term_id, item_id, status, verified_at, annotator_id, notes) applied; blank notes leave the old ones."""
    keys = ["term_id", "item_id"]
    v = verdicts.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in ("status", "verified_at", "annotator_id", "notes")])
    j = pool.join(v, keys, "left")

    def pick(c: str) -> Column:
        return F.when(F.col("_hit"), F.coalesce(F.nullif(F.col("_notes"), F.lit("")), F.col("notes")) if c == "notes" else F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return j.select(*keys, "source", pick("status"), "added_at", pick("verified_at"), pick("annotator_id"), pick("notes"))


def verified_negatives(pool: DataFrame) -> DataFrame:
    return pool.filter("status = 'VERIFIED_NEGATIVE'")


def false_negatives(pool: DataFrame) -> DataFrame:
    return pool.filter("status = 'FALSE_NEGATIVE_POS'")


def pool_summary(pool: DataFrame) -> DataFrame:
    return pool.groupBy("source", "status").agg(F.count("*").alias("n"))


def require_status(df: DataFrame, accepted: list[str], column: str = "label_status") -> DataFrame:
    if df.filter(F.col(column).isNotNull() & ~F.col(column).isin(accepted)).limit(1).count():
        raise ValueError(f"{column} holds values outside {accepted}")
    return df
