"""Lexical, dense and fused retrieval for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions.numeric import dot
from querylens.operators.ranking import top_k
from querylens.sources.scratch import saved, spread

#: Query rows (words of all queries) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def postings(docs: DataFrame, tokens: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, token, tf, dl): the inverted index."""
    counted = spread(docs).select(doc, tokens.alias("_t")).select(doc, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    return counted.groupBy(doc, "token", "dl").agg(F.count("*").alias("tf"))


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bm25(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, idf: str = "okapi", k1: float = 1.5, b: float = 0.75, max_df_ratio: float | None = None, doc: str = "doc_id", query: str = "query_id", top: int = 50) -> DataFrame:
    """(query, doc, score, rank): the best ``top`` documents of each query, score 0 or less left out.

    idf: "okapi" ln((N-n+.5)/(n+.5)+1); "floored" ln(N-n+.5)-ln(n+.5) with a quarter of its mean over all tokens in
    place of negative values, and "eligible" the same with the mean over the indexed tokens. Tokens in more than
    ``max_df_ratio`` of the documents are left out of the index.
    """
    n = docs.count()
    if not n:
        return docs.select(F.lit(None).cast("long").alias(query), doc, F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank")).limit(0)
    words = queries.select(query, F.explode(query_tokens).alias("token")).groupBy(query, "token").agg(F.count("*").alias("qtf"))
    words = saved(words, "query-words")
    # Texts are normalised and split once: the written postings serve every count and the scores.
    index = saved(postings(docs, doc_tokens, doc), "postings")
    average = (index.agg(F.sum("tf")).first()[0] or 0) / n
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    if idf == "okapi":  # no mean over all tokens is asked for
        df = index.join(small_or_not(words.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    cut = n * max_df_ratio if max_df_ratio is not None else n
    limit = F.col("df") <= (int(cut) if idf == "eligible" else F.lit(float(cut)))
    if idf == "okapi":
        weights = df.filter(limit).withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    else:
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        base = df.filter(limit) if idf == "eligible" else df
        mean = base.agg(F.avg(raw)).first()[0] or 0.0
        weights = df.filter(limit).withColumn("idf", F.when(raw < 0, F.lit(0.25 * mean)).otherwise(raw))
    asked = saved(words.join(weights, "token"), "asked")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(max(average, 1e-9))))
    scored = index.join(small_or_not(asked), "token").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")
    return top_k(scored, [query], [F.col("score").desc(), F.col(doc)], top)


def rank_decay(hits: DataFrame, k: int) -> DataFrame:
    """Score (k - (rank - 1)) / k in place of the model's."""
    return hits.withColumn("score", (k - (F.col("rank") - 1)) / F.lit(float(k)))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", item: str = "vec_id", max_queries: int = 4096) -> DataFrame:
    """Exact inner-product neighbours: each block of queries is broadcast against all vectors and cut to k at once.

    ``queries`` (query, qv) is a stated query set; its blocks hold at most ``max_queries`` rows.
    """
    blocks = -(-queries.count() // max_queries) or 1
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64(query), F.lit(blocks)))
    out = None
    for i in range(blocks):
        block = F.broadcast(dealt.filter(F.col("_block") == i).drop("_block"))
        scored = vectors.join(block, F.lit(True)).select(query, item, F.round(dot(F.col("qv"), F.col("embedding")), 6).alias("score"))
        best = top_k(scored, [query], [F.col("score").desc(), F.col(item)], k)
        out = best if out is None else out.unionByName(best)
    return out


def rrf(lists: list[tuple[DataFrame, float]], k: int = 60, top: int | None = None, group: str = "query_id", item: str = "item_id") -> DataFrame:
    """Weighted reciprocal rank fusion of (group, item, rank) lists."""
    every = None
    for ranked, weight in lists:
        part = ranked.select(group, item, (F.lit(float(weight)) / (k + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy(group, item).agg(F.round(F.sum("s"), 9).alias("rrf_score"))
    return fused if top is None else top_k(fused, [group], [F.col("rrf_score").desc(), F.col(item)], top)


def linear_fusion(bm25_hits: DataFrame, dense_hits: DataFrame, weight: float = 0.5, group: str = "query_id", item: str = "item_id") -> DataFrame:
    """Blend of min-max scaled scores; absent sides are 0; a constant list is 1 (BM25: only if above 0)."""

    def scaled(df: DataFrame, name: str, flat: Column) -> DataFrame:
        w = Window.partitionBy(group)
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select(group, item, F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(flat).alias(name))

    a = scaled(bm25_hits, "b", F.when(F.col("score") > 0, 1.0).otherwise(0.0))
    d = scaled(dense_hits, "d", F.lit(1.0))
    both = a.join(d, [group, item], "full_outer")
    return both.select(group, item, F.round(weight * F.coalesce("b", F.lit(0.0)) + (1 - weight) * F.coalesce("d", F.lit(0.0)), 9).alias("score"))


def hybrid(bm25_hits: DataFrame, dense_hits: DataFrame, k: int = 60, weights: tuple[float, float] = (0.5, 0.5), top: int = 100, group: str = "query_id", item: str = "item_id") -> DataFrame:
    """Fused hits with each side's score and rank, null where a side lacks the item."""
    b = bm25_hits.select(group, item, F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    d = dense_hits.select(group, item, F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    both = b.join(d, [group, item], "full_outer")
    part = F.coalesce(F.lit(weights[0]) / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(F.lit(weights[1]) / (k + F.col("dense_rank")), F.lit(0.0))
    return top_k(both.withColumn("rrf_score", F.round(part, 9)), [group], [F.col("rrf_score").desc(), F.col(item)], top)


def minmax_rerank(df: DataFrame, weight: float = 0.5, group: str = "term_id") -> DataFrame:
    """Blend of per-group min-max scaled ``score`` and ``rerank_score``; constant groups scale to 1."""
    w = Window.partitionBy(group)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(1.0)

    return df.withColumn("combined", F.round(weight * scaled("score") + (1 - weight) * scaled("rerank_score"), 9))


# --- TF-IDF ---------------------------------------------------------------------------------------------------------

# Latin letters whose accents do not decompose in Spark's built-ins, and what they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}", "")


def tfidf_tokens(c: Column, n: int = 1) -> Column:
    """Words of two or more word characters, and their runs of up to n words."""
    low = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    base = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " "), " "), lambda x: F.length(x) >= 2)
    out = base
    for k in range(2, n + 1):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(base) - (k - 1), F.lit(1))), lambda i, k=k: F.array_join(F.slice(base, i, k), " "))
        out = F.concat(out, F.when(F.size(base) >= k, grams).otherwise(F.array().cast("array<string>")))
    return out


def tfidf_vocabulary(docs: DataFrame, text: str = "text", size: int = 10_000, min_df: int = 2, n: int = 1) -> DataFrame:
    """(token, cf, df, idf): the ``size`` most frequent tokens in at least ``min_df`` texts; ties by token."""
    total = docs.count()
    once = spread(docs).select(tfidf_tokens(F.col(text), n).alias("t")).withColumn("_id", F.monotonically_increasing_id())
    counts = once.select("_id", F.explode("t").alias("token")).groupBy("_id", "token").agg(F.count("*").alias("tf")).groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    kept = counts.filter(F.col("df") >= min_df).orderBy(F.col("cf").desc(), "token").limit(size)
    return kept.withColumn("idf", F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)


def tfidf_weights(docs: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", n: int = 1) -> DataFrame:
    """(key, token, w): sublinear, L2-normalised weights. ``vocabulary`` has a bounded size and is broadcast."""
    tf = spread(docs).select(key, F.explode(tfidf_tokens(F.col(text), n)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    raw = tf.join(F.broadcast(vocabulary.select("token", "idf")), "token").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    return raw.select(key, "token", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).alias("w"))


def tfidf_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``pairs`` with ``tfidf_cosine``: weights of each side packed once a text, so a pair is one row throughout."""
    a = left.groupBy(left_key).agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("_a"))
    b = right.groupBy(right_key).agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("_b"))
    joined = pairs.join(a, left_key, "left").join(b, right_key, "left")
    value = F.aggregate(F.map_entries("_a"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("_b"), e["key"]), F.lit(0.0)))
    return joined.withColumn("tfidf_cosine", F.round(F.coalesce(value, F.lit(0.0)), 6)).drop("_a", "_b")


def strict_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``embedding_cosine`` of each pair; raises if any id has no vector."""
    for ids, have, key in ((pairs, left, left_key), (pairs, right, right_key)):
        lost = ids.select(key).distinct().join(have.select(key), key, "left_anti").limit(6).collect()
        if lost:
            raise KeyError(f"{key} without vector, e.g. {[r[0] for r in lost[:5]]}")
    joined = pairs.join(left.withColumnRenamed("embedding", "_a"), left_key).join(right.withColumnRenamed("embedding", "_b"), right_key)
    return joined.withColumn("embedding_cosine", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")

