"""Holds a Spark result against DuckDB's, in any order of rows."""

import duckdb
import pandas as pd

from lodestrata.session import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple("NULL" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row))
    return sorted(out)


def compare(spark_frame, duck_frame):
    got, want = spark_frame.toPandas(), duck_frame
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b), (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:3]
