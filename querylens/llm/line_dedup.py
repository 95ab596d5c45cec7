"""Line dedup with levelled sorted runs (native).

Line keys lie in a table of one partition a batch, in batches of falling doc_id. A batch's keys are merge-anti-joined with
the runs of the batches before: a key that no run holds is new, its holder is the largest doc_id of this batch that has
it, and it goes into the batch's own run; the rows of keys that a run holds, and rows of a new key outside its holder, are
repeats. FAN runs of a level are merged into one of the next. Runs are bucketed by key and sorted within buckets, so a
batch is shuffled to them and they are not shuffled again. A line is dropped where it is a repeat and its key has repeats in
``min_docs`` - 1 documents or more, as its holder is one more.

Edge cases: null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; rows that share a
doc_id are one document, and all that share the largest one keep the line; rows with a null doc_id keep all lines and do
not count; repeats of a key inside its holder stay, elsewhere all go; texts of any length are taken whole, though the
lines of one text are one array; an empty table gives an empty result; the input's other columns stay, but for those
named like a result. Keys are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import dropped, lookup, shared_dir, written
from querylens.sources.scratch import spread

FAN = 4
#: Most batches: each is a few jobs, and a partition of the table of lines.
MOST_BATCHES = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_keys(text: Column, min_chars: int) -> Column:
    """A struct of two hashes for each line; null where the key is too short."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        return F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))

    return F.transform(F.split(ascii_lower(text), "\n"), key)


class LineRuns:
    """Levelled runs: rows (h1, h2, n, first, last, seen), bucketed by key and sorted; ``seen`` keys stand in an older run."""

    def __init__(self, spark, fan: int = FAN):
        self.spark, self.fan, self.levels, self.tables = spark, fan, [], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add one batch of (doc_id, h1, h2), which must come by falling doc_id.

        Returns its keys: n rows in the batch from doc_id first to last, and whether an older run has the key.
        """
        keys = batch.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        for k, r in enumerate(self.runs()):
            keys = keys.join(r.filter("not seen").select("h1", "h2", F.lit(True).alias(f"in{k}")), ["h1", "h2"], "left")
        seen = F.coalesce(*[F.col(f"in{k}") for k in range(len(self.runs()))], F.lit(False))
        run = self._sorted(keys.select("h1", "h2", "n", "first", "last", seen.alias("seen")))
        self._put(0, run)
        return run

    def _sorted(self, run: DataFrame) -> DataFrame:
        """``run`` as a table in the shared folder, dealt to buckets as a shuffle by its key deals it."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"querylens_run_{uuid.uuid4().hex}"
        run.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/querylens/{name}").format("parquet").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Delete all runs, which no later plan may read."""
        for name in self.tables:
            dropped(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            out = None
            for r in self.levels[level]:  # no key is new in two runs
                own = r.filter("not seen")
                out = own if out is None else out.unionByName(own)
            self.levels[level] = []
            self._put(level + 1, self._sorted(out.repartition("h1", "h2")))


def batched(docs: DataFrame, own: DataFrame, batch_bytes: int, least: int) -> tuple[DataFrame, int]:
    """The written table of lines (doc_id, h1, h2, batch) and the number of its batches; batch 0 has the largest ids."""
    about = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_BATCHES, max(least, math.ceil(about / batch_bytes)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0)).alias("batch")
    lines = own.select("doc_id", batch, F.explode("k").alias("k")).select("doc_id", "k.h1", "k.h2", "batch")
    path = f"{shared_dir(docs.sparkSession)}/querylens/lines-{uuid.uuid4().hex}"
    lines.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(lines.schema).parquet(path), len(cuts) + 1


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batch_bytes: int = 1 << 32, least_batches: int = 3) -> DataFrame:
    """All columns of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).filter("doc_id is not null")
    own = thin.select("doc_id", F.array_distinct(F.filter(line_keys(F.col("text"), min_chars), lambda k: k.isNotNull())).alias("k"))
    lines, n = batched(thin, own, batch_bytes, least_batches)
    runs, repeats = LineRuns(docs.sparkSession), []
    for number in range(n):
        batch = lines.filter(F.col("batch") == number).drop("batch")
        keys = runs.add(batch)
        total = keys.agg(F.sum("n")).first()[0] or 0
        again = keys.filter("seen or first < last").select("h1", "h2", "n", F.when(~F.col("seen"), F.col("last")).alias("holder"))
        rows = lookup(batch, again, ["h1", "h2"], "n", total, "inner").filter("holder is null or doc_id < holder")
        repeats.append(written(rows.select("doc_id", "h1", "h2"), "repeats"))
    runs.close()
    dropped(lines)
    every = repeats[0]
    for r in repeats[1:]:
        every = every.unionByName(r)
    # Rows that share a doc_id are one document.
    common = every.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("rows")).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("rows").alias("n"))
    common = written(common.filter(F.col("docs") >= min_docs - 1).select("h1", "h2", "n"), "common")
    hits = lookup(every, common, ["h1", "h2"], "n", every.count(), "inner")
    drops = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))
    # The rows' own columns travel in one struct, so that none can clash with those made here.
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(id_col).alias("_doc"), text.alias("_text")).join(drops.withColumnRenamed("doc_id", "_doc"), "_doc", "left")
    joined = joined.withColumn("_lines", F.split("_text", "\n")).withColumn("_keys", F.when(F.col("_drops").isNotNull(), line_keys(F.col("_text"), min_chars)))
    left = F.zip_with("_lines", "_keys", lambda x, k: F.when(~F.coalesce(F.array_contains(F.col("_drops"), k), F.lit(False)), x))
    kept = F.when(F.col("_drops").isNull(), F.col("_lines")).otherwise(F.filter(left, lambda x: x.isNotNull()))
    out = joined.select("_row", F.size("_lines").cast("long").alias("_n"), kept.alias("_kept"))
    return out.select(*[F.col("_row")[c].alias(c) for c in cols], F.col("_n").alias("n_lines"), (F.col("_n") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("kept_text"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS holder FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, c.holder IS NOT NULL AND doc_id < c.holder AS gone FROM k LEFT JOIN c ON k.k = c.k)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
