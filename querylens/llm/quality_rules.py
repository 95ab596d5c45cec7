"""Host-level quality rules (native).

Each document is measured against per-document rules: ``base`` (too few words, or too many in repeated windows), which
rejects by itself, and ``symbols`` and ``dup_lines``, which only count against the host. Failures are counted by host, each
host's rate of a rule is shrunk towards the corpus with an empirical beta prior, and a host whose worst shrunk rate
exceeds ``reject_rate`` takes all its documents along. The hosts' verdicts are joined back.

Edge cases: a null or empty text has no words, so it fails ``base``; repeated rows are judged one by one and all count; a
null host gets no host verdict; a rate equal to ``reject_rate`` (a tie) does not reject; texts of any length are
measured whole, though the words of one text are one array; null ids are kept; an empty table gives an empty result;
further input columns are ignored. Windows of three words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import BROADCAST_ROWS, lookup, written
from querylens.sources.scratch import spread

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
RULES = ("base", "symbols", "dup_lines")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parts = base.select("doc_id", "host", F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    counted = parts.select(
        "doc_id", "host", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 4, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("g"),
    )
    some = counted.withColumn("again", F.size("g") > F.size(F.array_distinct("g")))
    # Only texts in which some window occurs twice pay for sorting: equal hashes become neighbours.
    placed = some.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = placed.withColumn(
        "p", F.when(F.col("again"), F.filter(F.transform("s", lambda x, k: F.when((x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("p", lambda i: F.array(i, i + 1, i + 2)))))
    return twice.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def host_rates(measures: DataFrame) -> DataFrame:
    """Per host: n_docs and, for each rule, the shrunk rate of failing documents.

    The prior of a rule is a beta distribution fitted by moments: its mean is the corpus rate, its strength what
    the variance between hosts beyond sampling noise leaves.
    """
    per_host = measures.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES])
    hosts = written(per_host, "hosts")
    totals = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES]).first()
    n = totals["n"] or 0
    if not n:
        return hosts.select("host", "n", *[F.lit(0.0).alias(f"rate_{r}") for r in RULES])
    mean = {r: totals[f"f_{r}"] / n for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.lit(mean[r]), 2)).alias(r) for r in RULES]).first()
    rate = []
    for r in RULES:
        noise = mean[r] * (1 - mean[r])
        between = spread[r] / n - noise * totals["hosts"] / n
        strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 and noise > 0 else 1e6
        rate.append(((F.col(f"f_{r}") + F.lit(mean[r] * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{r}"))
    return hosts.select("host", "n", *rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10, max_dup_line_pct: int = 30, reject_rate: float = 0.5) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` per document; ``host_rate`` is the host's worst shrunk rate, rounded."""
    m = measured(docs, id_col, text_col, host_col)
    m = m.withColumns({
        "fail_base": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")),
        "fail_symbols": 100 * F.col("n_symbols") > max_symbol_pct * F.col("word_chars"),
        "fail_dup_lines": 100 * F.col("n_dup_lines") > max_dup_line_pct * F.col("n_lines"),
    })
    m = written(m, "measures")
    rates = written(host_rates(m).select("host", "n", F.greatest(*[f"rate_{r}" for r in RULES]).alias("host_rate")), "rates")
    if rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = m.join(F.broadcast(rates.drop("n")), "host", "left")
    else:
        out = lookup(m, rates, ["host"], "n", m.count(), "left").drop("n")
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("fail_base").alias("base_failed"),
        (~F.col("fail_base") & ~F.coalesce(F.col("host_rate") > reject_rate, F.lit(False))).alias("kept"), F.round("host_rate", 6).alias("host_rate"),
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("host")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
r AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM p WHERE len(w) >= 4),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM r),
k AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c >= 2) GROUP BY doc_id),
m AS (SELECT p.doc_id, source AS host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words
      FROM p LEFT JOIN k ON p.doc_id = k.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 10 * word_chars AS f2,
             100 * n_dup_lines > 30 * n_lines AS f3 FROM m),
h AS (SELECT host, count(*) AS n, sum(f1::INT)::DOUBLE AS a1, sum(f2::INT)::DOUBLE AS a2, sum(f3::INT)::DOUBLE AS a3 FROM f WHERE host IS NOT NULL GROUP BY host),
long AS (SELECT host, n, 1 AS r, a1 AS a FROM h UNION ALL SELECT host, n, 2, a2 FROM h UNION ALL SELECT host, n, 3, a3 FROM h),
mu AS (SELECT r, sum(a) / sum(n) AS mu, sum(n) AS n, count(*) AS hosts FROM long GROUP BY r),
va AS (SELECT r, any_value(mu) AS mu, any_value(mu) * (1 - any_value(mu)) AS noise,
              sum(long.n * pow(a / long.n - mu, 2)) / any_value(mu.n) - any_value(mu) * (1 - any_value(mu)) * any_value(hosts) / any_value(mu.n) AS between_
       FROM long JOIN mu USING (r) GROUP BY r),
st AS (SELECT r, mu, CASE WHEN between_ > 0 AND noise > 0 THEN least(greatest(noise / between_ - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM va),
rates AS (SELECT host, max((a + mu * s) / (n + s)) AS rate FROM long JOIN st USING (r) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed,
       NOT f1 AND NOT coalesce(rate > 0.5, false) AS kept, round(rate, 6) AS host_rate
FROM f LEFT JOIN rates ON f.host = rates.host
"""
