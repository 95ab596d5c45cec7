import brute
import pytest
from conftest_words import words
from parity import same

from querylens.llm import decontaminate as D


def test_sql(spark, sf_dir):
    same(spark, sf_dir, D.op2_decontaminate, D.SQL)


ITEMS = [(3, " ".join(words(120, 1)[10:45])), (10, "One, TWO; three!"), (2, None), (7, ""), (11, "w1"), (12, " ".join(words(30_000, 5)[700:730])), (3, "x y z"), (21, " ".join(words(120, 1)[10:20])), (30, "é àÉ ßtraße 数据 данные é àÉ ßtraße 数据 данные")]


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


@pytest.mark.parametrize(("slice_words", "buffer"), [(1_000_000, 1 << 20), (20, 1 << 20), (20, 1000)])
def test_edges(spark, edge_docs, edge_rows, no_docs, monkeypatch, slice_words, buffer):
    monkeypatch.setattr(D, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(D, "BUFFER", buffer)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.decontaminate(edge_docs, items)
    assert got.count() == len(edge_rows)
    assert result(got) == brute.contamination([(r[0], r[1]) for r in edge_rows], ITEMS)
    assert D.decontaminate(no_docs, items).count() == 0
    assert not any(x[4] for x in result(D.decontaminate(edge_docs, items.limit(0))).values())


def test_suffix_buckets_select_and_bytes_confirm(monkeypatch):
    """All patterns in few buckets, few candidates at a time, and equal hashes of different words."""
    import numpy as np

    from querylens.llm._tokens import ALNUM, Words

    monkeypatch.setattr(D, "CANDIDATES", 7)
    base = words(300, 9, 6)
    held = D.Slice([(str(k), " ".join(base[k : k + 12])) for k in range(0, 200, 9)], 10)
    (p,) = held.patterns
    assert sorted(p.bucket.tolist()) == list(range(len(p.at))) and p.begin[-1] == len(p.at)
    data = " ".join(base).encode()
    w = Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), ALNUM)
    place, which = p.find(w)
    text = lambda q: [x.decode() for x in held.text(int(p.at[q]), 10)]
    want = {(i, tuple(base[i : i + 10])) for i in range(291) for q in range(len(p.at)) if base[i : i + 10] == text(q)}
    assert {(i, tuple(text(q))) for i, q in zip(place.tolist(), which.tolist())} == want and want
    held.data = held.data.replace(b"w1", b"v1")  # as if other words had these hashes
    assert all("v1" not in text(q) for q in p.find(w)[1])
