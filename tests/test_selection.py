import json

import pytest

from querylens.operators import selection as C
from querylens.sources import manifests as MF


def test_rank_candidates(spark):
    df = spark.createDataFrame([("b", 0.5, False), ("a", 0.5, False), ("c", 0.5, True), ("d", 0.1, True)], "name string, score double, selected boolean")
    assert [r["name"] for r in C.rank_candidates(df, 3).collect()] == ["c", "a", "b"]


def test_candidate_predictions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.9)], "a double, b double")
    assert [r["prediction"] for r in C.candidate_predictions(df, "a", "b", 0.5, 0.5, 0.5).collect()] == [1, 0]
    with pytest.raises(ValueError):
        C.candidate_predictions(df, "a", "b", 0.5, 0.6, 0.5)


def test_comparison_rows(spark):
    df = spark.createDataFrame([([("a", [1.0, 0.0]), ("b", [0.5])],)], "candidates array<struct<name: string, folds: array<double>>>")
    got = {r["name"]: (r["mean"], r["std"], r["n_folds"]) for r in C.comparison_rows(df).collect()}
    assert got == {"a": (0.5, 0.5, 2), "b": (0.5, 0.0, 1)}


def test_manifest_round_trip_and_tampering(tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    MF.write_manifest(str(tmp_path), "m.json", "oof", 3, ["x.bin"], rows=7, score=0.25)
    MF.verify_manifest(str(tmp_path), "m.json", "oof", 3, rows=7, score=0.25 + 1e-13)
    for wrong in ({"kind": "other"}, {"version": 4}, {"rows": 8}, {"score": 0.26}):
        with pytest.raises(ValueError):
            MF.verify_manifest(str(tmp_path), "m.json", **({"kind": "oof", "version": 3} | wrong))
    (tmp_path / "x.bin").write_bytes(b"abd")
    with pytest.raises(ValueError, match="x.bin"):
        MF.verify_manifest(str(tmp_path), "m.json", "oof", 3)
    with pytest.raises(ValueError, match="outside"):
        MF.inside(str(tmp_path), "../y")


def test_log_appends(tmp_path):
    p = str(tmp_path / "log.json")
    MF.append_log(p, {"a": 1})
    MF.append_log(p, {"b": "ü"})
    assert json.loads((tmp_path / "log.json").read_text()) == [{"a": 1}, {"b": "ü"}] and MF.read_config(p)[0] == {"a": 1}


def test_vector_checks(spark):
    MF.check_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>"))
    for bad in ([(1, [1.0, 0.0]), (1, [0.0, 1.0])], [(1, [1.0]), (2, [0.0, 1.0])], [(1, [float("nan"), 0.0])], [(1, [2.0, 0.0])]):
        with pytest.raises(ValueError):
            MF.check_vectors(spark.createDataFrame(bad, "vec_id int, embedding array<double>"))
