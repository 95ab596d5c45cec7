import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0, pool=5000):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{(x >> 33) % pool}")
    return out


def edge_texts():
    """Texts that every operator must take: nulls, empty, blank, short, repeated, very long, several scripts."""
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    line = "A line that several of the documents share, word for word."
    return [
        None, "", " \t\n\x0b\r ", "one", "One two three", "one two three", " ".join(base), " ".join(base), " ".join(near), " ".join(words(40, 2)), f"{line}\n{' '.join(words(60, 3))}\n\n{line.upper()}  \nshort",
        f"{' '.join(words(70, 4))}\n  {line}\r\n", f"\n{line}\n", "é ÀÉ ßtraße 数据 данные\n" * 30, " ".join(words(30_000, 5)), "x" * 100_000, "## $$ %% | <a> & " * 40, "a b c " * 60, "MIT License\ncc-by nd, Licensed under the MIT License.",
        "tab\tsep\x00nul \x1f unit nbsp  em", " ".join([*words(20, 6), *base[10:45], *words(20, 7)]),
    ]


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, "en", [None, "s1", "s2", "S"][i % 4], len(t or "")) for i, t in enumerate(edge_texts())]
    return [*rows, (rows[6][0], rows[6][1], "en", "s1", 5)]  # one row twice


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge texts with further columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(edge_rows, SCHEMA)
    extra = ("n_words", "row", "name", "host", "component_id", "words", "size", "kept", "h1", "label", "score", "n", "_drops")
    return df.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
