"""Pair features: the lexical and structured projection, the 40-column table, and features relative to a pair's group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions import attributes as A
from querylens.functions import numeric as N
from querylens.functions import text as X
from querylens.operators.ranking import average_rank

# The names of the features.
LEXICAL = (
    "query_title_overlap", "query_title_coverage", "query_title_precision", "query_title_phrase", "query_category_overlap", "query_category_coverage",
    "query_model_token_match", "query_model_token_conflict", "query_brand_match", "query_cat_l1_overlap", "title_len", "query_len", "title_token_count",
    "query_token_count", "gender_match", "age_group_match", "demographic_conflict", "query_cat_l2_overlap", "query_cat_l3_overlap", "cat_depth",
    "query_color_match", "query_size_match", "query_material_match",
)
CONTEXT = (
    "candidate_count_log1p", "query_title_overlap_rank", "query_title_overlap_gap", "query_title_overlap_delta_mean", "query_title_coverage_rank",
    "query_category_overlap_rank", "tfidf_cosine_rank", "tfidf_cosine_gap", "tfidf_cosine_delta_mean",
)
MODEL = (*LEXICAL, "tfidf_cosine", *CONTEXT)


def with_defaults(df: DataFrame) -> DataFrame:
    for name, value in (("gender", "unknown"), ("age_group", "unknown"), ("attributes", ""), ("brand", "")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def item_side(items: DataFrame, literals: bool = True) -> DataFrame:
    """What depends on the item alone, once an item and not once a pair."""
    items = with_defaults(items)
    attributes = A.attribute_map(F.col("attributes"), literals)
    levels = X.category_levels(F.col("category"))
    base = items.withColumns({"_tt": X.token_set(F.col("title")), "_ct": X.token_set(F.col("category")), "_levels": levels, "_map": attributes})
    return base.withColumns({
        "_tm": X.model_tokens(F.col("_tt")), "cat_depth": F.size("_levels"), "title_len": F.length(F.coalesce("title", F.lit(""))),
        **{f"_l{i}": X.token_set(X.category_level(F.col("_levels"), i)) for i in (1, 2, 3)},
        "_colour": A.item_colour(F.col("_map")), "_size": A.item_size(F.col("_map")), "_material": A.item_material(F.col("_map")),
    }).drop("_map", "_levels")


def term_side(terms: DataFrame) -> DataFrame:
    q = F.col("query")
    base = terms.withColumn("_qt", X.token_set(q))
    return base.withColumns({
        "_qm": X.model_tokens(F.col("_qt")), "query_len": F.length(F.coalesce(q, F.lit(""))), "_qcolours": A.query_colours(q), "_qsizes": A.query_sizes(q), "_qmaterials": A.query_materials(q),
    })


def lexical_columns() -> dict[str, Column]:
    """The 23 features over joined ``term_side`` and ``item_side`` columns."""
    qt, tt, ct = F.col("_qt"), F.col("_tt"), F.col("_ct")
    gender, age = A.gender_match(F.col("query"), F.col("gender")), A.age_match(F.col("query"), F.col("age_group"))
    made = {
        "query_title_overlap": X.jaccard(qt, tt), "query_title_coverage": X.share_of_first(qt, tt), "query_title_precision": X.share_of_first(tt, qt),
        "query_title_phrase": X.holds_phrase(F.col("title"), F.col("query")).cast("int"),
        "query_category_overlap": X.jaccard(qt, ct), "query_category_coverage": X.share_of_first(qt, ct),
        "query_model_token_match": X.any_shared(F.col("_qm"), F.col("_tm")), "query_model_token_conflict": X.both_but_disjoint(F.col("_qm"), F.col("_tm")),
        "query_brand_match": X.holds_phrase(F.col("query"), F.col("brand")).cast("int"),
        "query_cat_l1_overlap": X.jaccard(qt, F.col("_l1")), "query_cat_l2_overlap": X.jaccard(qt, F.col("_l2")), "query_cat_l3_overlap": X.jaccard(qt, F.col("_l3")),
        "title_len": F.col("title_len"), "query_len": F.col("query_len"), "title_token_count": F.size(tt), "query_token_count": F.size(qt), "cat_depth": F.col("cat_depth"),
        "gender_match": gender, "age_group_match": age, "demographic_conflict": ((gender == -1) | (age == -1)).cast("int"),
        "query_color_match": A.three_way(F.col("_qcolours"), F.col("_colour")), "query_size_match": A.three_way(F.col("_qsizes"), F.col("_size")),
        "query_material_match": A.three_way(F.col("_qmaterials"), F.col("_material")),
    }
    return {name: made[name].cast("float") for name in LEXICAL}


def lexical_features(pairs: DataFrame, terms: DataFrame, items: DataFrame, literals: bool = True) -> DataFrame:
    """``pairs`` with the 23 features; token arrays are made before the join, and dropped after it."""
    joined = pairs.join(term_side(terms), "term_id", "left").join(item_side(items, literals), "item_id", "left")
    return joined.select(*[F.col(c) for c in pairs.columns], *[c.alias(n) for n, c in lexical_columns().items()])


def context_features(df: DataFrame, group: str = "term_id") -> DataFrame:
    """Nine features of a pair relative to all pairs of its group: one shuffle by group serves every window."""
    require(df, [group, "query_title_overlap", "query_title_coverage", "query_category_overlap", "tfidf_cosine"])
    all_rows = Window.partitionBy(group)
    n = F.count("*").over(all_rows)

    def rank(c: str) -> Column:
        return 1 - (average_rank([group], c) - 1) / F.greatest(n - 1, F.lit(1))

    made = {"candidate_count_log1p": F.log1p(n)}
    for c in ("query_title_overlap", "query_title_coverage", "query_category_overlap", "tfidf_cosine"):
        made[f"{c}_rank"] = rank(c)
    for c in ("query_title_overlap", "tfidf_cosine"):
        made[f"{c}_gap"] = F.max(c).over(all_rows) - F.col(c)
        made[f"{c}_delta_mean"] = F.col(c) - F.avg(c).over(all_rows)
    return df.select("*", *[made[c].alias(c) for c in CONTEXT])


def model_matrix(df: DataFrame) -> DataFrame:
    require(df, MODEL)
    return df.select(*[F.col(c).cast("float").alias(c) for c in MODEL])


# The names of the 40 columns, in four blocks of ten.
WIDE = (
    "exact_brand_match", "brand_levenshtein_sim", "brand_jaccard_sim", "char_1gram_jaccard", "char_2gram_jaccard", "char_3gram_jaccard", "word_overlap_ratio", "title_length_ratio", "query_word_count", "title_word_count",
    "color_match_score", "size_match_score", "material_match_score", "attribute_conflict_penalty", "has_color_in_query", "has_size_in_query", "has_material_in_query", "color_jaccard", "size_jaccard", "material_jaccard",
    "category_depth_overlap", "category_exact_match", "bm25_score", "dense_cosine_sim", "bm25_rank", "dense_rank", "rrf_fusion_score", "bm25_rank_reciprocal", "dense_rank_reciprocal", "is_top5_hybrid",
    "cross_encoder_score", "cross_encoder_prob_sigmoid", "cross_encoder_x_bm25", "cross_encoder_x_dense", "score_rank_diff", "score_ratio_bm25_dense", "bm25_normalized", "dense_normalized", "hybrid_blend_score", "final_confidence_signal",
)


def wide_term_side(terms: DataFrame) -> DataFrame:
    """What the 40 features need of ``query`` alone, once a term and not once a pair."""
    form = terms.withColumn("_q", X.search_form(F.col("query")))
    form = form.withColumns({"_qw": X.words(F.col("_q")), "_qc": X.char_codes(F.col("_q")), "_ql": F.trim(X.search_form(F.col("_q")))})
    return form.withColumns({"_qd": F.array_distinct("_qw"), "_qn": F.size("_qw"), **{f"_q{n}": X.gram_codes(F.col("_qc"), n) for n in (1, 2, 3)}}).drop("_qc", "_qw")


def wide_item_side(items: DataFrame) -> DataFrame:
    """What they need of title, brand, category and attributes (``Key: value | Key: value``) alone, once an item."""
    attributes = F.col("attributes")
    size = F.coalesce(F.nullif(A.piped_value(attributes, "beden"), F.lit("")), A.piped_value(attributes, "numara"))
    raw = {"_colour": A.piped_value(attributes, "renk"), "_size": size, "_material": A.piped_value(attributes, "materyal")}
    form = items.withColumns({f"_{c[0]}": X.search_form(F.col(c)) for c in ("title", "brand", "category")} | raw)
    form = form.withColumn("_cl", F.filter(F.transform(F.split(F.coalesce(F.col("category").cast("string"), F.lit("")), "/"), lambda x: F.trim(X.search_form(x))), lambda x: x != ""))
    clean = {f"{c}_form": X.search_form(F.col(c)) for c in raw}
    form = form.withColumns({"_tw": X.words(F.col("_t")), "_c1": F.coalesce(F.get("_cl", 0), F.lit("")), "_cn": F.size("_cl"), "_bt": F.contains(F.col("_t"), F.col("_b")), **clean})
    form = form.withColumns({f"{c}_codes": X.char_codes(F.col(c)) for c in ("_t", "_b", *clean)})
    grams = {f"_t{n}": X.gram_codes(F.col("_t_codes"), n) for n in (1, 2, 3)} | {"_b3": X.gram_codes(F.col("_b_codes"), 3)} | {f"{c}_2": X.gram_codes(F.col(f"{c}_form_codes"), 2) for c in raw}
    return form.withColumns(grams).drop("_cl", "_t_codes", "_b_codes", *[f"{c}_codes" for c in clean])


def wide_pairs(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the 40 features over joined ``wide_term_side`` and ``wide_item_side`` columns."""

    def given(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)

    bm, de, rb, rd, ce = given("bm25_score", 0.0), given("dense_score", 0.0), given("bm25_rank", 200.0), given("dense_rank", 200.0), given("cross_encoder_score", 0.0)
    prob = N.sigmoid(ce)
    q, t, brand, tw = (F.col(c) for c in ("_q", "_t", "_b", "_tw"))
    # A lambda keeps this projection out of whole-stage code, whose one method would be too long for the JIT compiler.
    shared = F.size(F.filter("_qd", lambda w: F.array_contains(tw, w)))
    made: dict[str, Column] = {
        "exact_brand_match": (brand != "") & (F.col("_bt") | F.contains(q, brand)), "brand_levenshtein_sim": F.when((brand == "") | (q == ""), F.lit(0.0)).otherwise(X.levenshtein_similarity(brand, q)), "brand_jaccard_sim": X.set_jaccard(F.col("_b3"), F.col("_q3")),
        **{f"char_{n}gram_jaccard": X.set_jaccard(F.col(f"_q{n}"), F.col(f"_t{n}")) for n in (1, 2, 3)},
        "word_overlap_ratio": X.ratio(shared, F.col("_qn")), "title_length_ratio": F.length(t) / F.greatest(F.length(q), F.lit(1)), "query_word_count": F.col("_qn"), "title_word_count": F.size(tw),
    }
    scores = []
    for name, own in (("color", "_colour"), ("size", "_size"), ("material", "_material")):
        value = F.col(own)
        score = F.when(value == "", 0.5).when(F.contains(q, F.col(f"{own}_form")), 1.0).otherwise(0.0)
        scores.append(score)
        made |= {f"{name}_match_score": score, f"has_{name}_in_query": value != "", f"{name}_jaccard": X.set_jaccard(F.col(f"{own}_2"), F.col("_q2"))}
    rrf = 1 / (60 + rb) + 1 / (60 + rd)
    # A query's form has no slash, so it is one level of a category at most.
    depth = F.when((F.col("_ql") != "") & (F.col("_ql") == F.col("_c1")), F.lit(1.0) / F.col("_cn")).otherwise(F.lit(0.0))
    made |= {
        "attribute_conflict_penalty": F.least(*scores) == 0, "category_depth_overlap": depth, "category_exact_match": F.contains(q, F.col("_c")),
        "bm25_score": bm, "dense_cosine_sim": de, "bm25_rank": rb, "dense_rank": rd, "rrf_fusion_score": rrf, "bm25_rank_reciprocal": 1 / F.greatest(rb, F.lit(1.0)), "dense_rank_reciprocal": 1 / F.greatest(rd, F.lit(1.0)), "is_top5_hybrid": (rb <= 5) | (rd <= 5),
        "cross_encoder_score": ce, "cross_encoder_prob_sigmoid": prob, "cross_encoder_x_bm25": prob * bm, "cross_encoder_x_dense": prob * de, "score_rank_diff": F.abs(rb - rd), "score_ratio_bm25_dense": bm / F.greatest(de, F.lit(1e-5)),
        "bm25_normalized": F.least(bm / 20, F.lit(1.0)), "dense_normalized": F.least(de, F.lit(1.0)), "hybrid_blend_score": 0.5 * bm + 0.5 * de, "final_confidence_signal": 0.6 * prob + 0.4 * rrf,
    }
    return df.select(*keep, *[made[c].cast("double").alias(c) for c in WIDE])


def wide_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all of the input that are no result) and the 40 features WIDE.

    Input: query, title, brand, category, attributes (``Key: value | Key: value``), bm25_score, dense_score,
    cross_encoder_score, bm25_rank, dense_rank; missing scores are 0 and missing ranks 200. Where terms and items are
    tables of their own, join ``wide_term_side`` and ``wide_item_side`` to the pairs and take ``wide_pairs``.
    """
    keep = [c for c in df.columns if c not in WIDE] if keep is None else keep
    return wide_pairs(wide_item_side(wide_term_side(df)), keep)


def item_text(df: DataFrame, with_attributes: bool = True) -> Column:
    """Title, the brand unless the title has it, flat category and flat attributes, in single-spaced lower case."""
    title, brand = F.coalesce(F.col("title"), F.lit("")), F.trim(F.coalesce(F.col("brand"), F.lit("")))
    shown = F.when((brand != "") & ~F.contains(F.lower(title), F.lower(brand)), brand)
    parts = [title, shown, X.flat_category(F.col("category"))]
    if with_attributes and "attributes" in df.columns:
        parts.append(A.flat_text(A.attribute_map(F.col("attributes"), False)))
    return X.spaced_form(F.concat_ws(" ", *parts))


def search_text() -> Column:
    return X.search_form(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "category", "brand", "attributes")]))


def index_text() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), X.flat_category(F.col("category")), F.coalesce("brand", F.lit("")))


def cross_encoder_text(missing: str = "Belirtilmemiş", given: tuple[str, ...] = ()) -> Column:
    """The fixed document template of the cross encoder; attributes are ``Key: value | Key: value``.

    ``given`` names those of the columns color, size and material that the table has: they come before the attributes.
    A size may stand under beden or numara, a material under materyal or kumaş.
    """
    src = F.col("attributes")

    def shown(*values: Column) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.coalesce(v, F.lit(""))), F.lit("")) for v in values], F.lit(missing))

    def said(column: str, *keys: str) -> Column:
        return shown(*[F.col(column).cast("string")] * (column in given), *[A.piped_value(src, k) for k in keys])

    title, category = (F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "category"))
    return F.format_string(
        "[TITLE] %s [SEP] [CAT] %s [SEP] [ATTR] Marka: %s | Renk: %s | Beden: %s | Materyal: %s",
        title, category, shown(F.col("brand")), said("color", "renk"), said("size", "beden", "numara"), said("material", "materyal", "kumaş"),
    )


def query_segments(q: Column) -> dict[str, Column]:
    """Length class by distinct words, and whether the query names a colour, a size, a material or a model."""
    tokens = X.token_set(q)
    n = F.size(tokens)
    colours, materials = ([w for words in g.values() for w in words if " " not in w] for g in (A.COLOURS, A.MATERIALS))
    sizes = "xs s m l xl xxl 3xl beden numara size".split()
    return {
        "length_class": F.when(n == 1, "Head").when(n.between(2, 3), "Medium").otherwise("Tail"),
        "has_color": F.arrays_overlap(tokens, F.array(*map(F.lit, colours))), "has_size": F.arrays_overlap(tokens, F.array(*map(F.lit, sizes))),
        "has_material": F.arrays_overlap(tokens, F.array(*map(F.lit, materials))), "has_model_code": F.exists(tokens, lambda x: x.rlike("[0-9]")),
    }
