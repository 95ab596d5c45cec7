"""Typed scans of the base tables with their constraints, sinks, and digests of files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


TERMS = _strings("term_id", "query")
ITEMS = _strings("item_id", "title", "category", "brand", "gender", "age_group", "attributes")
TRAINING_PAIRS = _strings("id", "term_id", "item_id").add("label", T.ByteType())
SUBMISSION_PAIRS = _strings("id", "term_id", "item_id")
SAMPLE_SUBMISSION = _strings("id").add("prediction", T.IntegerType())
POINTER = "version https://git-lfs.github.com/spec/v1"


def refuse_pointer(spark: SparkSession, path: str) -> None:
    """Raise if the file is missing or only points to large-file storage."""
    first = spark.read.text(path).limit(1).collect()
    if first and first[0][0].startswith(POINTER):
        raise ValueError(f"{path} is a pointer, not data")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV scan whose header must hold exactly the schema's columns in order."""
    refuse_pointer(spark, path)
    header = spark.read.option("header", True).csv(path).columns
    if header != schema.names:
        raise ValueError(f"{path}: columns {header}, expected {schema.names}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)


def check_table(df: DataFrame, key: list[str], not_null: list[str] | None = None, name: str = "table") -> DataFrame:
    """Non-empty, unique non-null key and no nulls in ``not_null``: one aggregation over the table."""
    not_null = not_null or []
    row = df.agg(F.count("*").alias("n"), F.count_distinct(*key).alias("d"), *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in dict.fromkeys([*key, *not_null])]).first()
    if not row["n"]:
        raise ValueError(f"{name} is empty")
    nulls = [c for c in dict.fromkeys([*key, *not_null]) if row[f"null_{c}"]]
    if nulls:
        raise ValueError(f"{name}: nulls in {', '.join(nulls)}")
    if row["d"] != row["n"]:
        raise ValueError(f"{name}: {row['n'] - row['d']} repeated keys")
    return df


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    return check_table(scan_csv(spark, path, TERMS), ["term_id"], ["query"], "terms")


def load_items(spark: SparkSession, path: str) -> DataFrame:
    return check_table(scan_csv(spark, path, ITEMS), ["item_id"], ["title", "category"], "items").fillna({"brand": ""})


def load_pairs(spark: SparkSession, path: str, training: bool) -> DataFrame:
    df = scan_csv(spark, path, TRAINING_PAIRS if training else SUBMISSION_PAIRS)
    check_table(df, ["id"], ["term_id", "item_id"], "pairs")
    check_table(df, ["term_id", "item_id"], name="pairs")
    if training and df.filter(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).limit(1).count():
        raise ValueError("labels must be 0 or 1")
    return df


def star_join(pairs: DataFrame, terms: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with their term's and item's columns; both sides must have unique keys and resolve every reference."""
    for dim, key in ((terms, "term_id"), (items, "item_id")):
        check_table(dim, [key], name=key)
        lost = pairs.join(dim.select(key), key, "left_anti").limit(1).count()
        if lost:
            raise ValueError(f"pairs refer to unknown {key}")
    return pairs.join(terms, "term_id", "left").join(items, "item_id", "left")


def bad_values(df: DataFrame, column: str, rule: str) -> DataFrame:
    """Rows that break a rule: finite, probability or binary."""
    c = F.col(column)
    broken: dict[str, Column] = {"finite": c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), "probability": c.isNull() | F.isnan(c) | ~c.between(0, 1), "binary": c.isNull() | ~c.isin(0, 1)}
    return df.filter(broken[rule])


def require_values(df: DataFrame, column: str, rule: str) -> DataFrame:
    if bad_values(df, column, rule).limit(1).count():
        raise ValueError(f"{column} must be {rule}")
    return df


def only_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    return df.join(terms.select("term_id").distinct(), "term_id", "left_semi")


def census(df: DataFrame) -> tuple[int, list[str]]:
    return df.count(), df.columns


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of whole files, computed on the executors. Files beyond 2 GB do not fit this reader."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_freeze(spark: SparkSession, expected: list[dict]) -> None:
    """Compare bytes, digests, rows and columns with what is written down, and report all differences at once.

    Each entry has ``path`` and any of bytes, sha256, rows and columns; the last two are read as CSV with a header.
    """
    found = {r["path"].split(":", 1)[-1].lstrip("/"): r for r in file_digests(spark, [e["path"] for e in expected]).collect()}
    wrong = []
    for e in expected:
        r = found.get(e["path"].split(":", 1)[-1].lstrip("/"))
        wrong += [f"{e['path']}: {k}" for k in ("bytes", "sha256") if k in e and (r is None or r[k] != e[k])]
        if r is not None and ("rows" in e or "columns" in e):
            table = spark.read.option("header", True).csv(e["path"])
            wrong += [f"{e['path']}: rows"] if "rows" in e and table.count() != e["rows"] else []
            wrong += [f"{e['path']}: columns"] if "columns" in e and table.columns != list(e["columns"]) else []
    if wrong:
        raise ValueError("; ".join(wrong))


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def ordered_id_digest(ids) -> str:
    """SHA-256 over ids in order, each after its length in four little-endian bytes."""
    h = hashlib.sha256()
    for x in ids:
        raw = str(x).encode()
        h.update(len(raw).to_bytes(4, "little"))
        h.update(raw)
    return h.hexdigest()


def id_fingerprint(df: DataFrame, column: str) -> DataFrame:
    """An order-free fingerprint of a column: rows and the sum of two hashes, combined on the executors."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(column).cast("decimal(38,0)")).alias("sum64"), F.sum(F.crc32(F.col(column).cast("string"))).alias("sum32"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_candidates(df: DataFrame, path: str) -> None:
    df.select("term_id", "item_id", "label", "neg_source").write.mode("overwrite").option("header", True).csv(path)


def write_annotation_sheet(df: DataFrame, path: str) -> None:
    """A sheet for annotators with two empty label columns; readers of spreadsheets need the byte-order mark."""
    sheet = df.withColumns({"label_1": F.lit(""), "label_2": F.lit("")})
    marked = sheet.withColumnRenamed(sheet.columns[0], "﻿" + sheet.columns[0])
    marked.write.mode("overwrite").option("header", True).csv(path)


def unfinished(all_ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return all_ids.join(done.select(key), key, "left_anti")


def publish(df: DataFrame, path: str, check) -> None:
    """Write beside the target, check what was written, then rename; the old target stands aside until that is done.

    A failure leaves the target as it was, and nothing else.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged, aside, final = (jvm.org.apache.hadoop.fs.Path(path + x) for x in (".staging", ".before", ""))
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(final):  # an earlier call ended between its renames
        fs.rename(aside, final)
    try:
        df.write.mode("overwrite").option("header", True).csv(path + ".staging")
        check(spark.read.option("header", True).csv(path + ".staging"))
        fs.delete(aside, True)
        held = fs.exists(final)
        if held and not fs.rename(final, aside):
            raise OSError(f"could not set {path} aside")
        if not fs.rename(staged, final):
            if held:
                fs.rename(aside, final)
            raise OSError(f"could not rename to {path}")
        fs.delete(aside, True)
    finally:
        fs.delete(staged, True)


def submission_qa(out: DataFrame, sample: DataFrame) -> DataFrame:
    """One row of checks of (row_idx, id, prediction) against the sample (row_idx, id), and the verdict."""
    p = out.agg(
        F.count("*").alias("n_rows"), F.sum((F.col("id").isNull() | F.col("prediction").isNull()).cast("long")).alias("n_null"), (F.count("*") - F.count_distinct("id")).alias("n_repeated"),
        F.sum((~F.coalesce(F.col("prediction").isin(0, 1), F.lit(False))).cast("long")).alias("n_not_binary"),
    )
    both = out.select("row_idx", F.col("id").alias("a")).join(sample.select("row_idx", F.col("id").alias("b")), "row_idx", "full_outer")
    order = both.agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("n_misplaced"), F.count("b").alias("n_expected"))
    row = p.join(order, F.lit(True))
    return row.withColumn("valid", (F.col("n_rows") == F.col("n_expected")) & (F.col("n_null") + F.col("n_repeated") + F.col("n_not_binary") + F.col("n_misplaced") == 0))
