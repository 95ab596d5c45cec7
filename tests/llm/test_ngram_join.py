import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from querylens.llm import ngram_join as J


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_edges(edge_docs, edge_rows, no_docs):
    got = J.ngram_join(edge_docs)
    assert got.count() == len(edge_rows)
    assert result(got) == brute.components(sorted({(r[0], r[1]) for r in edge_rows}, key=str))
    assert J.ngram_join(no_docs).count() == 0
    assert result(J.ngram_join(edge_docs.withColumn("text", F.lit(None).cast("string")))) == {r[0]: (0, r[0]) for r in edge_rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    """Edited copies whose similarities spread around the threshold, chains, and a passage that all texts share."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    passage, rows = word(60), []
    for size in (8, 12, 30, 60, 150, 400):
        base = word(size)
        for _ in range(14):
            w = list(base)
            for k in rng.integers(0, size, rng.integers(0, max(2, size // 18) + 1)):
                w[k] = word(1)[0]
            rows.append(" ".join(w))
        chain = list(base)
        for k in range(0, size, max(1, size // 20)):
            chain[k] = word(1)[0]
            rows.append(" ".join(chain))
        rows += [" ".join([*word(size), *passage, *word(size // 3)]) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(J.ngram_join(df)) == brute.components(rows)


def test_signatures_of_pairs_at_the_limit_meet():
    """Random pairs exactly at the threshold share a signature, for set sizes over all bands."""
    rng = np.random.default_rng(7)
    for union in (4, 8, 16, 20, 40, 80, 160, 400, 1200):
        for _ in range(60):
            f = np.sort(rng.choice(1 << 54, union, replace=False).astype(np.uint64))
            order = rng.permutation(union)
            d, only_a = union // 4, rng.integers(0, union // 4 + 1)
            a, b = np.delete(f, order[:only_a]), np.delete(f, order[only_a:d])
            s, owner = J.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 3, 4)
            assert np.intersect1d(s[owner == 0], s[owner == 1]).size


@pytest.mark.parametrize(("block", "features", "size"), [(1024, 500_000, 4096), (3, 500_000, 4096), (1024, 300, 4096), (1024, 500_000, 2)])
def test_group_ties(spark, monkeypatch, block, features, size):
    """Members of groups in different components are tied as all pairs would tie them, in one block or in several."""
    for name, value in (("BLOCK", block), ("BLOCK_FEATURES", features), ("BIN", size)):
        monkeypatch.setattr(J, name, value)
    rng = np.random.default_rng(5)
    texts = []
    for k in range(4):  # families whose members lie around the threshold
        base = [f"t{k}x{x}" for x in range(40)]
        for _ in range(9):
            w = list(base)
            for at in rng.integers(0, 40, rng.integers(0, 4)):
                w[at] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = J.written(docs.mapInArrow(J.described(5), "doc_id long, n long, name long, cells binary").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    names = {r["name"]: (r["rep"], r["n"]) for r in classes.collect()}
    groups = spark.createDataFrame([(-1, x, n) for x, (_, n) in names.items()] + [(-2, x, n) for x, (i, n) in names.items() if i % 2], "a long, b long, nb long")
    labels = spark.createDataFrame([], "name long, label long")
    got = [tuple(r) for r in J.group_ties(groups, labels, docs, classes, 5, 3, 4).collect()]
    sets = {x: brute.shingles(texts[i]) for x, (i, _) in names.items()}
    assert got and all(4 * len(sets[x] & sets[y]) >= 3 * len(sets[x] | sets[y]) for x, y in got)
    assert block < 1024 or features < 1000 or len(got) < 2 * len(names)
    found = {r["name"]: r["label"] for r in J.components(spark.createDataFrame(got, "a long, b long")).collect()}
    want = brute.components(list(enumerate(texts)))
    groups_of = lambda label: sorted(sorted(names[x][0] for x in names if label(x) == k) for k in {label(x) for x in names})
    assert groups_of(lambda x: found.get(x, x)) == groups_of(lambda x: want[names[x][0]][1])


def test_labels_of_forests_and_further_links(spark):
    forest = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(50, 60), (50, 70)], "a long, b long")
    labels = J.rooted(forest)
    assert {tuple(r) for r in labels.collect()} == {(k, 1) for k in range(1, 21)} | {(50, 50), (60, 50), (70, 50)}
    more = spark.createDataFrame([(60, 90), (15, 70), (100, 101), (60, 70)], "a long, b long")
    want = {(k, 1) for k in [*range(1, 21), 50, 60, 70, 90]} | {(100, 100), (101, 100)}
    assert {tuple(r) for r in J.merged(labels, more).collect()} == want


def test_bounds_never_part_linked_sets():
    """Sets of different sizes and so of histograms of different lengths: what links always passes."""
    rng = np.random.default_rng(3)
    for union in (20, 500, 540, 700, 1100, 5000):
        f = np.sort(rng.choice(1 << 54, union, replace=False).astype(np.uint64))
        order = rng.permutation(union)
        a, b = np.delete(f, order[: union // 4]), np.delete(f, order[union // 4 : union // 4])
        ha, hb = (np.frombuffer(J.histograms(x, np.array([0, len(x)]))[0], dtype=np.uint8)[None] for x in (a, b))
        c = min(ha.shape[1], hb.shape[1])
        assert J.may_link(np.array([len(a)]), J.folded(ha, c), np.array([len(b)]), J.folded(hb, c), 3, 4)[0]


@pytest.mark.parametrize("miss", [J.MISS, 0.0])
def test_edited_texts_near_the_threshold(spark, miss):
    """Contiguous edits, which are not random differences: texts with a run of words replaced, from 0.6 to 0.9."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"u{x}" for x in rng.integers(0, 10**7, n)]
    rows = []
    for size in (30, 90, 250, 700):
        base = word(size)
        for share in np.linspace(0.02, 0.25, 12):
            w, at = list(base), int(rng.integers(0, size // 2))
            w[at : at + int(size * share)] = word(int(size * share))
            rows.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(rows)]
    got = result(J.ngram_join(spark.createDataFrame(rows, "doc_id int, text string").repartition(4), miss=miss))
    assert got == brute.components(rows)
