"""Compare a query's rows with those of its SQL on DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    """A value that both engines give alike: numbers as floats, every kind of null as an empty string."""
    if pd.api.types.is_scalar(x) and pd.isna(x):
        return ""
    number = isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb"
    return round(float(x), 7) if number else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(plain(x) for x in r))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def same(spark, sf_dir, query, sql):
    a, b = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    wrong = [(p, q) for p, q in zip(x, y, strict=True) if any(abs(m - n) > 2e-6 if isinstance(m, float) and isinstance(n, float) else m != n for m, n in zip(p, q, strict=True))]
    assert not wrong, wrong[:3]
