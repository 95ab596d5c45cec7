"""Known values of the column functions."""

import pytest
from pyspark.sql import functions as F

from querylens.functions import attributes as A
from querylens.functions import numeric as N
from querylens.functions import text as X
from querylens.operators import features as FE


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_turkish_lower(spark):
    assert value(spark, X.turkish_lower(F.col("x")), x="İSTANBUL IŞIKLARI") == "istanbul ışıkları"


def test_normal_forms_differ(spark):
    assert value(spark, X.match_form(F.col("x")), x=" Straße,  A-B_c² ") == "strasse a b_c²"
    assert value(spark, X.spaced_form(F.col("x")), x=" A-B   c ") == "a-b c"
    assert value(spark, X.search_form(F.col("x")), x="I.phone  (X)") == "ı phone x"
    assert value(spark, X.match_form(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(("text", "phrase", "found"), [("kirmizi elbise", "elbise", True), ("elbiseler", "elbise", False), ("a b", "", False), ("Nike-Air", "nike air", True)])
def test_phrases_are_whole_words(spark, text, phrase, found):
    assert value(spark, X.holds_phrase(F.col("t"), F.col("p")), t=text, p=phrase) is found


def test_model_tokens(spark):
    q, match, clash = (X.token_set(F.lit(x)) for x in ("iphone 13 a52", "galaxy a52 kılıf", "galaxy b77"))
    m = [X.model_tokens(t) for t in (q, match, clash)]
    assert value(spark, X.any_shared(m[0], m[1])) == 1 and value(spark, X.both_but_disjoint(m[0], m[1])) == 0
    assert value(spark, X.any_shared(m[0], m[2])) == 0 and value(spark, X.both_but_disjoint(m[0], m[2])) == 1


def test_similarities_at_the_edges(spark):
    assert value(spark, X.levenshtein_similarity(F.lit(""), F.lit(""))) == 1.0
    assert value(spark, X.levenshtein_similarity(F.lit(""), F.lit("abc"))) == 0.0
    assert value(spark, X.char_ngram_jaccard(F.lit("ab"), F.lit("ab"))) == 1.0
    assert value(spark, X.jaccard(X.token_set(F.lit("")), X.token_set(F.lit("")))) == 0.0
    assert value(spark, X.category_overlap(F.lit("a/b/c"), F.lit("A/b/d"))) == pytest.approx(2 / 3)


def test_attribute_maps(spark):
    flat = value(spark, A.attribute_map(F.col("x")), x="Renk: Siyah, Not: saat 10:30, RENK: Beyaz, : x")
    assert flat == {"renk": "beyaz", "not": "saat 10:30"}
    assert value(spark, A.attribute_map(F.col("x")), x='{"Renk": "Mavi", "n": 3}') == {"renk": "mavi", "n": "3"}
    assert value(spark, A.attribute_map(F.col("x")), x="{'Renk': 'Mavi', 'beden': None}") == {"renk": "mavi", "beden": "none"}
    assert value(spark, A.attribute_map(F.col("x")), x="{broken") == {}
    assert value(spark, A.attribute_map(F.lit(None).cast("string"))) == {}
    assert value(spark, A.piped_value(F.col("x"), "Renk"), x="Beden: M | renk: Açık Mavi; x") == "Açık Mavi"


def test_first_phrase_keeps_lexicon_order(spark):
    assert value(spark, X.first_phrase_value(F.lit("red and black"), A.lexicon(A.COLOURS))) == "siyah"


def test_sizes_and_three_way(spark):
    assert set(value(spark, A.query_sizes(F.lit("42 numara bot xl 37,5 beden 120 cm")))) == {"42", "xl", "37.5", "120"}
    m = A.attribute_map(F.lit("beden: 37,5"))
    assert value(spark, A.three_way(A.query_sizes(F.lit("37.5 numara")), A.item_size(m))) == 1
    assert value(spark, A.three_way(A.query_colours(F.lit("mavi")), F.lit("siyah"))) == -1
    assert value(spark, A.three_way(A.query_colours(F.lit("elbise")), F.lit("siyah"))) == 0


def test_demographics(spark):
    assert value(spark, A.gender_match(F.lit("kadın bot"), F.lit("Kadın"))) == 1
    assert value(spark, A.gender_match(F.lit("kadın bot"), F.lit("erkek"))) == -1
    assert value(spark, A.gender_match(F.lit("kadın erkek"), F.lit("erkek"))) == 0
    assert value(spark, A.age_match(F.lit("kids bot"), F.lit("çocuk"))) == 1


def test_bins_follow_the_edges(spark):
    assert [value(spark, N.edge_bin(F.lit(p), 10)) for p in (0.0, 0.3, 0.6, 0.7, 1.0)] == [0, 2, 5, 6, 10]


def test_thresholds_by_length(spark):
    assert value(spark, N.adaptive_threshold(F.lit(0.9), F.lit("a b"))) == pytest.approx(0.775)
    assert value(spark, N.sigmoid(F.lit(-1000.0))) == pytest.approx(0, abs=1e-20)


def test_cross_encoder_template(spark):
    df = spark.createDataFrame([("T", "a/b", "B", "Renk: Mavi | Materyal: Deri")], "title string, category string, brand string, attributes string")
    assert df.select(FE.cross_encoder_text().alias("v")).first()["v"] == "[TITLE] T [SEP] [CAT] a/b [SEP] [ATTR] Marka: B | Renk: Mavi | Beden: Belirtilmemiş | Materyal: Deri"


def test_lexicon_keeps_first_places_and_last_values(spark):
    assert value(spark, A.item_colour(A.attribute_map(F.lit("renk: krem mavi")))) == "bej"
    assert value(spark, A.item_colour(A.attribute_map(F.lit("renk: Turkuaz Neon")))) == "turkuaz neon"
    assert value(spark, A.item_colour(A.attribute_map(F.lit("beden: 38")))) == ""
    assert value(spark, A.three_way(A.query_colours(F.lit("mavi elbise")), A.item_colour(A.attribute_map(F.lit("renk: turkuaz"))))) == -1
    assert value(spark, A.item_material(A.attribute_map(F.lit("materyal: Bambu")))) == "bambu"
    assert value(spark, A.query_colours(F.lit("krem"))) == ["bej"]


def test_sizes_as_the_patterns_have_them(spark):
    assert value(spark, A.query_sizes(F.lit("xxxl mont"))) == ["xxxl"] and value(spark, A.query_sizes(F.lit("xxs mont"))) == []
    assert value(spark, A.query_sizes(F.lit("beden: 37,5"))) == ["37.5"] and value(spark, A.query_sizes(F.lit("42 numara"))) == ["42"]
    for said, want in (("XL", "xl"), ("37,5 EU", "37.5"), ("std", "std"), ("M/38", "38"), ("", "")):
        assert value(spark, A.item_size(A.attribute_map(F.lit(f"beden: {said}")))) == want


def test_wide_features_of_the_fixture(spark):
    from querylens.operators import features as FE

    columns = ["query", "title", "brand", "category", "attributes", "bm25_score", "dense_score", "bm25_rank", "dense_rank", "cross_encoder_score"]
    rows = [
        ("derimod 38 numara siyah deri kadın babet", "Siyah Deri Kadın Babet Ayakkabı", "Derimod", "Ayakkabı / Kadın Ayakkabı / Babet", "Renk: Siyah | Beden: 38 | Materyal: Deri", 8.5, 0.91, 1, 1, 4.2),
        ("38 numara siyah deri kadın babet", "Erkek Spor Ayakkabı", "Nike", "Ayakkabı / Erkek Ayakkabı", "Renk: Beyaz | Beden: 42", 1.2, 0.40, 15, 20, -3.1),
        (None, None, None, None, None, None, None, None, None, None),
    ]
    out = FE.wide_features(spark.createDataFrame(rows, "query string, title string, brand string, category string, attributes string, bm25_score double, dense_score double, bm25_rank int, dense_rank int, cross_encoder_score double"))
    assert out.columns == [*[c for c in columns if c not in FE.WIDE], *FE.WIDE] and len(FE.WIDE) == 40
    a, b, c = out.collect()
    assert (a["exact_brand_match"], a["color_match_score"], a["size_match_score"], a["material_match_score"], a["attribute_conflict_penalty"]) == (1, 1, 1, 1, 0)
    assert a["word_overlap_ratio"] == 4 / 7 and a["is_top5_hybrid"] == 1 and a["category_exact_match"] == 0
    assert (b["exact_brand_match"], b["color_match_score"], b["size_match_score"], b["material_match_score"], b["attribute_conflict_penalty"], b["score_rank_diff"]) == (0, 0, 0, 0.5, 1, 5)
    assert abs(b["rrf_fusion_score"] - (1 / 75 + 1 / 80)) < 1e-12 and abs(b["bm25_normalized"] - 0.06) < 1e-12
    assert (c["bm25_rank"], c["color_match_score"], c["char_3gram_jaccard"], c["cross_encoder_prob_sigmoid"]) == (200, 0.5, 0, 0.5)


def test_wide_sides_are_made_before_the_join(spark):
    """Rows are those of the joined table; what is left to a pair has no regular expressions and no character grams."""
    from querylens.operators import features as FE

    texts = ["", None, "a", "Siyah  Deri/Kadın!", "I\u0307STANBUL İPEK", "çağ\U0001f600ğ ç", "38 numara siyah deri", "deri"]
    terms = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "term_id int, query string")
    items = spark.createDataFrame(
        [(i, x, texts[-i], "a" if i % 2 else x, ["Renk: Siyah | Beden: 38 | Materyal: Deri", "renk: !; numara: 38", "", None][i % 4]) for i, x in enumerate(texts)],
        "item_id int, title string, brand string, category string, attributes string",
    )
    pairs = terms.select("term_id").crossJoin(items.select("item_id"))
    whole = FE.wide_features(pairs.join(terms, "term_id").join(items, "item_id"), ["term_id", "item_id"])
    split = FE.wide_pairs(pairs.join(FE.wide_item_side(items), "item_id").join(FE.wide_term_side(terms), "term_id"), ["term_id", "item_id"])
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    both = pairs.join(terms, "term_id").join(items, "item_id").withColumns({f"_{c[0]}": X.search_form(F.col(c)) for c in ("query", "title", "brand", "category")})
    plain = {"char_3gram_jaccard": X.char_ngram_jaccard(F.col("_q"), F.col("_t"), 3), "brand_jaccard_sim": X.char_ngram_jaccard(F.col("_b"), F.col("_q"), 3), "category_depth_overlap": X.category_overlap(F.col("_q"), F.col("category"), X.search_form)}
    want = both.select("term_id", "item_id", *[c.alias(n) for n, c in plain.items()])
    assert sorted(map(str, split.select(want.columns).collect())) == sorted(map(str, want.collect()))
    per_pair = split._jdf.queryExecution().optimizedPlan().expressions().mkString(" ").lower()
    assert "array_intersect" in per_pair and "regexp" not in per_pair and "split(" not in per_pair


def test_gram_codes_are_equal_where_grams_are(spark):
    texts = ["", "a", "ab", "abc", "abcabc", "çağ\U0001f600ğ ç", "\U0001f600", "\x00", "\x00\x00", "a\x00", "\U0010ffff\U0010ffff\U0010ffff\U0010ffff", "line\nbreak"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for n in (1, 2, 3):
        codes = [X.gram_codes(X.char_codes(F.col(c)), n) for c in "ab"]
        assert df.filter(X.set_jaccard(*codes) != X.char_ngram_jaccard(F.col("a"), F.col("b"), n)).count() == 0
        assert df.filter((F.size(codes[0]) != F.size(X.char_ngrams(F.col("a"), n))) | F.exists(codes[0], lambda x: x <= 0)).count() == 0


def test_quick_nudge_rounds_as_the_plain_one(spark):
    from querylens.plans import catalog

    values = [0.0, -0.0, 1.0, -2.0, 0.5, 1 / 3, 2.0000005, 0.1234565, -1e-9, -0.3333335, 960000.0, 123456.7890125, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x, x) for x in values], "a double, b double")
    got = catalog.nudged(df, "a").select("a", catalog.quickly_nudged(F.col("b")).alias("b")).collect()
    assert [str(r["a"]) for r in got] == [str(r["b"]) for r in got]


def test_cross_encoder_text_prefers_columns_and_falls_back(spark):
    from querylens.operators import features as FE

    rows = [(" T ", "a/b", None, "Numara: 38 | Kumaş: Keten", "Mavi", "")]
    df = spark.createDataFrame(rows, "title string, category string, brand string, attributes string, color string, size string")
    got = df.select(FE.cross_encoder_text(given=("color", "size")).alias("v")).first()["v"]
    assert got == "[TITLE] T [SEP] [CAT] a/b [SEP] [ATTR] Marka: Belirtilmemiş | Renk: Mavi | Beden: 38 | Materyal: Keten"


def test_character_grams_of_short_and_long_texts(spark):
    def grams(x, n):
        return ({x[i : i + n] for i in range(len(x) - n + 1)} if len(x) >= n else {x}) if x else set()

    texts = ["", "a", "ab", "abc", "abcabc", "çağ\U0001f600ğ ç", "line\nbreak here", "xyz " * 5000]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    for n in (1, 2, 3):
        got = df.select("a", "b", X.char_ngram_jaccard(F.col("a"), F.col("b"), n).alias("v")).collect()
        for r in got:
            x, y = grams(r["a"], n), grams(r["b"], n)
            assert r["v"] == (len(x & y) / len(x | y) if x | y else 0.0)
