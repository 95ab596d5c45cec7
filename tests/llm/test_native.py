"""Quality rules, line dedup and mixing."""

import hashlib
import random
from collections import Counter

import brute
import pytest
from parity import same
from pyspark.sql import functions as F

from querylens.llm import line_dedup as L
from querylens.llm import mixing as M
from querylens.llm import quality_rules as Q


@pytest.mark.parametrize("module", [Q, L])
def test_sql(spark, sf_dir, module):
    query = Q.op10_quality_rules if module is Q else L.op9_line_dedup
    same(spark, sf_dir, query, module.SQL)


def test_quality_edges(edge_docs, edge_rows, no_docs):
    got = Q.quality_rules(edge_docs).collect()
    assert len(got) == len(edge_rows)
    want = {r[0]: brute.quality(r[1]) for r in edge_rows}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], r["doc_id"]
        assert not (r["kept"] and r["base_failed"])
    assert Q.quality_rules(no_docs).count() == 0


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = "clean words here " + " ".join(f"a{i}" for i in range(80)), "### $$$ %%% &&& " * 5
    rows = [(i, good, f"h{i % 5}") for i in range(200)] + [(1000 + i, bad + " ".join(f"b{i}x{k}" for k in range(60)) if i % 10 else good, "spam") for i in range(100)] + [(5000, good, None)]
    got = {r["doc_id"]: r["kept"] for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_symbol_pct=3).collect()}
    assert all(got[i] for i in range(200)) and got[5000]
    assert not any(got[1000 + i] for i in range(100))


def test_host_rates_are_those_of_the_sql(spark, tmp_path, monkeypatch):
    """Hosts of 1 to 400 documents, some bad, with the prior at work; by a broadcast and by a shuffle."""
    import duckdb

    good, bad = " ".join(f"a{i}" for i in range(80)), "### $$$ %%% &&& " * 5
    rng, rows = random.Random(2), []
    for host, n, share in (("a", 400, 0.01), ("b", 100, 0.6), ("c", 3, 1.0), ("d", 1, 1.0), ("e", 60, 0.52), ("f", 60, 0.45), (None, 5, 1.0)):
        rows += [(len(rows) + k, (bad if rng.random() < share else "") + good.replace("a1 ", f"x{rng.random()} "), host) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = {tuple(r) for r in c.sql(f"SELECT doc_id, kept, host_rate FROM ({Q.SQL})").fetchall()}
    assert len({r[2] for r in want}) == 7 and 0 < sum(r[1] for r in want) < len(rows)
    for most in (Q.BROADCAST_ROWS, 2):
        monkeypatch.setattr(Q, "BROADCAST_ROWS", most)
        assert {(r["doc_id"], r["kept"], r["host_rate"]) for r in Q.quality_rules(df).collect()} == want


def test_line_dedup_edges(spark, edge_docs, edge_rows, no_docs):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in L.line_dedup(edge_docs).collect())
    want = Counter((r[0], *w) for r, w in zip(edge_rows, brute.line_dedup([(r[0], r[1]) for r in edge_rows]), strict=True))
    assert got == want
    assert L.line_dedup(no_docs).count() == 0


def shared_lines(n=300):
    rng = random.Random(3)
    return [(i, "\n".join(f"shared line number {rng.randrange(30 + i):04d} of the set" for _ in range(6))) for i in range(n)]


@pytest.mark.parametrize("batch_bytes", [1 << 32, 3000])
def test_line_runs_compact_by_levels(spark, batch_bytes):
    """Few batches or many, with merged levels; ids that occur twice are one document, null ids none."""
    rows = shared_lines()
    rows += [(5, rows[7][1]), (299, rows[3][1]), (None, rows[9][1]), (None, rows[10][1]), (4, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in L.line_dedup(df, batch_bytes=batch_bytes).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute.line_dedup(rows), strict=True))


def test_runs_hold_each_key_once_and_answer_later_batches(spark):
    runs = L.LineRuns(spark, fan=2)
    rows = [(9, [1, 2, 2]), (8, [2, 3]), (7, [1, 4])]
    seen = []
    for doc, keys in rows:
        out = runs.add(spark.createDataFrame([(doc, k, k) for k in keys], "doc_id long, h1 long, h2 long"))
        seen.append({r["h1"]: r["seen"] for r in out.collect()})
    assert seen == [{1: False, 2: False}, {2: True, 3: False}, {1: True, 4: False}]
    held = [r["h1"] for run in runs.runs() for r in run.filter("not seen").collect()]
    assert sorted(held) == [1, 2, 3, 4] and [len(x) for x in runs.levels] == [1, 1]


def test_water_fill():
    assert M.water_fill([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    out = M.water_fill([10, 1000, 0], [3, 1, 2], 1010)
    assert out[0] == 30 and out[2] == 0 and abs(sum(out) - 1010) < 1e-9
    assert M.water_fill([], [], 0) == []


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_split_tree_is_exact(shards):
    quotas = [17, 0, 1000, 5000, 3]
    parts = M.split_tree(quotas, shards, random.Random(1))
    assert len(parts) == shards and [sum(p[i] for p in parts) for i in range(5)] == quotas and min(map(min, parts)) >= 0
    totals = [sum(p) for p in parts]
    assert max(totals) - min(totals) <= shards


def test_hypergeometric_mean():
    rng = random.Random(5)
    for good, bad, n in ((30, 70, 20), (70, 30, 80), (20, 80, 30), (8000, 2000, 5000), (0, 5, 3), (5, 0, 3)):
        draws = [M.hypergeometric(rng, good, bad, n) for _ in range(1000 if good < 1000 else 50)]
        assert abs(sum(draws) / len(draws) - n * good / (good + bad)) <= 0.02 * n
        assert max(0, n - bad) <= min(draws) and max(draws) <= min(good, n)


def test_mixing_edges(spark, edge_docs, edge_rows, no_docs):
    pieces, documents = M.mixed(edge_docs)
    got = M.mix_report(pieces, documents).collect()
    assert len(got) == len(edge_rows)
    size = {r[0]: brute.quality(r[1])[0] for r in edge_rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
    assert M.mix_report(*M.mixed(no_docs)).count() == 0
    again = M.mix_report(*M.mixed(edge_docs))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_mixing_meets_targets_with_disjoint_pieces(spark):
    rows = [(i, " ".join(["x"] * (1 + i * 37 % 500)), f"s{i % 7 if i % 3 else 0}") for i in range(900)]
    pieces, documents = M.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4)
    report = M.mix_report(pieces, documents).join(spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "source"), "doc_id")
    by = report.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("ss"), F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    total = sum(r["size"] for r in by)
    assert sum(r["t"] for r in by) == pytest.approx(total)
    for r in by:
        assert r["size"] == r["ss"] and abs(r["k"] - r["t"]) <= 0.5 and r["t"] <= 3 * r["size"] + 1e-6
    spans = [(r["row"], r["pass"], r["start"], r["start"] + r["words"], r["shard"]) for r in pieces.collect()]
    seen = {}
    for row, p, a, b, _ in spans:
        assert a < b and all(b <= x or y <= a for x, y in seen.setdefault((row, p), []))
        seen[row, p].append((a, b))
    loads = Counter()
    for *_, a, b, s in [(r, p, a, b, s) for r, p, a, b, s in spans]:
        loads[s] += b - a
    assert len(loads) == 4 and max(loads.values()) < 1.2 * min(loads.values())
    # Full passes take every word once, the others less.
    words = Counter()
    for row, p, a, b, _ in spans:
        words[row, p] += b - a
    assert all(n <= 500 for n in words.values())
    shard = [(r["shard"], r["place"]) for r in M.shard_rows(pieces).collect()]
    assert sorted(shard) == shard and len(shard) == len(spans)


@pytest.mark.parametrize("sizes", [[17], [5], [33, 1000], [1, 2, 3, 50, 49, 7, 20, 1, 1], [20, 19, 400], [40_000, 3, 90_000]])
def test_small_sources_come_near_their_targets(spark, sizes):
    """Taken words equal the target, rounded, for sources of few words and of more words than blocks."""
    rows = []
    for s, n in enumerate(sizes):
        while n > 0:  # texts of up to 7000 words
            k = min(n, 1 + len(rows) * 3 % 7000)
            rows.append((len(rows), " ".join(["x"] * k), f"s{s}"))
            n -= k
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces, documents = M.mixed(df)
    want = M.water_fill(sizes, [1 + i % 3 for i in range(len(sizes))], sum(sizes))
    got = {r["source"]: (r["t"], r["k"]) for r in M.mix_report(pieces, documents).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()}
    for s, t in enumerate(want):
        assert got[f"s{s}"] == (pytest.approx(t), min(round(t), 3 * sizes[s]))


def test_mix_does_not_depend_on_partitions(spark, edge_docs):
    rows = [(i % 70, " ".join(["x"] * (i * 37 % 400)), f"s{i % 4}") for i in range(150)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, source string"), edge_docs):
        got = [Counter(map(tuple, M.mix_report(*M.mixed(x)).collect())) for x in (df.coalesce(1), df.repartition(5, "doc_id"), df.repartition(8))]
        assert got[0] == got[1] == got[2]


def test_hash_of_kept_text(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert L.line_dedup(df).select(F.sha2("kept_text", 256)).first()[0] == hashlib.sha256(b"").hexdigest()
