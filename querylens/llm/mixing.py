"""Mixing sources to target weights (native): a multivariate-hypergeometric splitting tree over source blocks.

A source's documents stand in a keyed random order, and their words in that order are cut into at most BLOCKS blocks of
equal length (but for one word). The source's target in whole words is its quota: whole passes over all blocks, and for
the rest the first blocks of one more pass, the last of them cut to the word. Each pass takes the blocks in an own keyed
random order. The numbers of blocks that a pass draws go down a binary tree whose leaves are the output shards: a node
sends to each side as many of each source's blocks as a draw without replacement of that side's share of the node would
(the multivariate hypergeometric law, drawn exactly source by source), so each leaf has an exact quota, and the leaves of a
pass hold disjoint ranks of the permuted blocks. ``place`` orders the pieces of a shard at random, and ``shard_rows``
deals and sorts them so.

The tree works on one number per source and shard; rows never leave the executors. The list of sources is collected
(sources are what weights are given for); ``max_sources`` bounds it and more raise an error. Keys are hashes of doc_id, text
and source, so the mix does not depend on how the rows are partitioned.

Edge cases: null or empty texts have size 0 and are taken 0 times; null source is a source of its own, last in order;
a source of size 0 has target 0; a source of few words has blocks of one word; repeated rows count one by one, and rows
equal in doc_id, text and source are interchangeable; null ids are allowed; texts of any length are cut at block bounds; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylens.llm._spark import written
from querylens.sources.scratch import spread

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one bucket of a source's random order: what one task sums up in sequence.
BUCKET_ROWS = 2_000
MAX_TIMES = 3
#: Most blocks of a source, which a pass orders in one task, and about the most of all sources, which the tree draws from.
BLOCKS, ALL_BLOCKS = 16_384, 2_000_000
#: Most rows of the table of blocks that are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 500_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float = MAX_TIMES) -> list[float]:
    """Shares of ``total`` by weight; what exceeds ``cap`` times a size is shared again among the others."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        open_ -= set(over)
        left = float(total) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad without replacement are good, drawn one by one from the smaller side."""
    n = good + bad
    if 2 * draws > n:  # what is left behind is a draw too
        return good - hypergeometric(rng, good, bad, n - draws)
    if 2 * good > n:
        return draws - hypergeometric(rng, bad, good, draws)
    if good < draws:  # good and drawn change parts
        return hypergeometric(rng, draws, n - draws, good)
    got = 0
    for k in range(draws):
        got += rng.random() * (n - k) < good - got
    return got


def split_tree(quotas: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """quotas[i] blocks of source i over the shards: rows are shards, each row has its blocks of every source."""
    if shards == 1:
        return [list(quotas)]
    left_shards = shards // 2
    total = sum(quotas)
    draws = total * left_shards // shards
    left, rest, remaining = [], draws, total
    for q in quotas:
        take = hypergeometric(rng, q, remaining - q, rest)
        left.append(take)
        rest -= take
        remaining -= q
    return split_tree(left, left_shards, rng) + split_tree([q - x for q, x in zip(quotas, left, strict=True)], shards - left_shards, rng)


def block_table(made: DataFrame, seed: int) -> DataFrame:
    """(s, pass, block, rank, take): the blocks that each pass draws, in its random order, and how many words of each.

    ``made``: s, source_size, blocks, quota. At most BLOCKS rows of a source and pass are ordered in one task.
    """
    every = made.select("s", "source_size", "blocks", "quota", F.explode(F.sequence(F.lit(0), F.lit(MAX_TIMES - 1))).alias("pass"))
    # A pass takes what the passes before have left of the quota, all words of the source at most.
    every = every.withColumn("left", F.least("source_size", F.col("quota") - F.col("pass") * F.col("source_size"))).filter("left > 0")
    blocks = every.select("s", "pass", "left", "source_size", "blocks", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    blocks = blocks.withColumn("words", F.expr("(block + 1) * source_size div blocks - block * source_size div blocks"))
    order = Window.partitionBy("s", "pass").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "s", "pass", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = blocks.select("s", "pass", "block", "words", "left", F.row_number().over(order).alias("rank"), before.alias("before"))
    return ranked.filter("before < left").select("s", "pass", "block", (F.col("rank") - 1).alias("rank"), F.least("words", F.col("left") - F.col("before")).alias("take"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), shards: int = 8, seed: int = 7, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents).

    pieces: doc_id, row, source, shard, pass, block, start, words, place; the words [start, start + words) of a document
    that a shard takes in a pass, in order of place. documents: doc_id, row, source, size, source_size, target.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), text).alias("key"))
    # ``row`` only tells rows of one key apart; it is fixed once written.
    thin = written(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    rows = thin.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["size"] or 0) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], float(sum(sizes)))
    most = max(64, min(BLOCKS, ALL_BLOCKS // max(1, len(rows))))
    made = [
        {"source": r["source"], "s": i, "source_size": size, "target": float(target), "blocks": min(most, size), "quota": min(round(target), MAX_TIMES * size), "buckets": max(1, -(-r["n"] // BUCKET_ROWS))}
        for i, (r, size, target) in enumerate(zip(rows, sizes, targets, strict=True))
    ]
    schema = "array<struct<source:string,s:int,source_size:bigint,target:double,blocks:bigint,quota:bigint,buckets:int>>"
    params = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), schema)))
    drawn = written(block_table(params, seed), "blocks")
    numbers = {(r["s"], r["pass"]): r["n"] for r in drawn.groupBy("s", "pass").agg(F.count("*").alias("n")).collect()}
    rng, ends = random.Random(seed), []
    for p in range(MAX_TIMES):
        tree = split_tree([numbers.get((i, p), 0) for i in range(len(rows))], shards, rng)
        # The ranks of a pass at which the shards' shares of a source end.
        ends += [{"s": i, "pass": p, "ends": list(accumulate(leaf[i] for leaf in tree))} for i in range(len(rows))]
    shares = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(ends)), "array<struct<s:int,pass:int,ends:array<bigint>>>")))
    dealt = drawn.join(F.broadcast(shares), ["s", "pass"]).select("s", "pass", "block", "take", F.expr("size(filter(ends, e -> e <= rank))").alias("shard"))
    dealt = F.broadcast(dealt) if sum(numbers.values()) <= BROADCAST_BLOCKS else dealt
    same = thin["source"].eqNullSafe(params["source"])
    keyed = thin.join(F.broadcast(params.select("source", "s", "source_size", "target", "blocks", "buckets")), same).drop(params["source"])
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.col("buckets").cast("long")).cast("int"))
    documents = keyed.select("doc_id", "row", "source", "size", "source_size", "target")
    # Prefix sums in two steps: over the buckets of a source (a few sums), then inside each bucket.
    sums = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("sum"))
    before = sums.select("s", "bucket", F.coalesce(F.sum("sum").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("s", "bucket").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    some = keyed.filter("size > 0")
    placed = some.withColumn("end", F.sum("size").over(order)).join(before, ["s", "bucket"]).withColumn("a", F.col("before") + F.col("end") - F.col("size"))
    # A block holds the words from block * source_size div blocks on.
    spans = placed.select("doc_id", "row", "key", "source", "s", "size", "a", "source_size", "blocks", F.expr("explode(sequence(((a + 1) * blocks - 1) div source_size, ((a + size) * blocks - 1) div source_size))").alias("block"))
    met = spans.join(dealt, ["s", "block"]).withColumn("from", F.expr("block * source_size div blocks"))
    start, end = F.greatest(F.lit(0), F.col("from") - F.col("a")), F.least("size", F.col("from") + F.col("take") - F.col("a"))
    place = F.xxhash64(F.lit(seed), F.lit("place"), "shard", "pass", "block", "key", "row").alias("place")
    pieces = met.select("doc_id", "row", "source", "shard", "pass", "block", start.alias("start"), (end - start).alias("words"), place).filter("words > 0")
    return pieces, documents


def shard_rows(pieces: DataFrame) -> DataFrame:
    """``pieces`` dealt to their shards and shuffled within each: ranges of (shard, place), many tasks to a shard."""
    return pieces.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    pieces, documents = mixed(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "source"))
    return mix_report(pieces, documents)


def mix_report(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    took = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(took, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
