"""Manifests beside written artefacts, and what they promise: JSON on the driver, checks on the executors."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.functions.numeric import dot
from querylens.sources.tables import check_table, sha256_file


def read_config(path: str) -> dict:
    """JSON, or YAML where a reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def append_log(path: str, entry: dict) -> None:
    """Add an entry to a JSON list; the file is replaced in one step."""
    p = Path(path)
    entries = json.loads(p.read_text(encoding="utf-8")) if p.exists() else []
    replace_text(path, json.dumps([*entries, entry], ensure_ascii=False, indent=1))


def replace_text(path: str, text: str) -> None:
    staged = Path(path + ".staging")
    staged.write_text(text, encoding="utf-8")
    os.replace(staged, path)


def inside(root: str, path: str) -> Path:
    """The path under ``root``; one that leaves it is an error."""
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} lies outside {root}")
    return full


def write_manifest(root: str, name: str, kind: str, version: int, files: list[str], **facts) -> dict:
    """A manifest of files under ``root`` with sizes and digests."""
    listed = {f: {"bytes": inside(root, f).stat().st_size, "sha256": sha256_file(str(inside(root, f)))} for f in files}
    manifest = {"kind": kind, "schema_version": version, "files": listed, **facts}
    replace_text(str(inside(root, name)), json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=1))
    return manifest


def verify_manifest(root: str, name: str, kind: str, version: int, tolerance: float = 1e-12, **facts) -> dict:
    """The manifest, if kind, version, files and facts all hold; otherwise an error that lists all that does not."""
    m = json.loads(inside(root, name).read_text(encoding="utf-8"))
    wrong = [k for k, want in (("kind", kind), ("schema_version", version)) if m.get(k) != want]
    for f, want in m.get("files", {}).items():
        p = inside(root, f)
        if not p.exists() or p.stat().st_size != want["bytes"] or sha256_file(str(p)) != want["sha256"]:
            wrong.append(f)
    for k, want in facts.items():
        have = m.get(k)
        near = isinstance(want, float) and isinstance(have, (int, float)) and abs(want - have) <= tolerance
        if have != want and not near:
            wrong.append(k)
    if wrong:
        raise ValueError(f"{name}: {', '.join(wrong)}")
    return m


def candidate_facts(df: DataFrame) -> dict:
    """What a candidate set must repeat when it is rebuilt: terms, rows, positives and rows by source."""
    row = df.agg(F.count_distinct("term_id").alias("terms"), F.count("*").alias("rows"), F.sum(F.col("label").cast("long")).alias("positives")).first().asDict()
    return row | {"sources": {r["neg_source"]: r["count"] for r in df.groupBy("neg_source").count().orderBy("neg_source").collect()}}


def check_vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding", unit: bool = True, tolerance: float = 1e-3) -> DataFrame:
    """Unique ids, one dimension, no nulls, finite values and, if asked, unit length."""
    check_table(df, [key], [column], "vectors")
    length = dot(F.col(column), F.col(column))
    row = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b"), F.sum((F.isnan(length) | (length == float("inf"))).cast("long")).alias("bad"), F.max(F.abs(F.sqrt(length) - 1)).alias("off")).first()
    if row["a"] != row["b"] or row["bad"] or (unit and row["off"] > tolerance):
        raise ValueError(f"vectors: dimensions {row['a']}..{row['b']}, {row['bad']} not finite, length off by {row['off']}")
    return df
