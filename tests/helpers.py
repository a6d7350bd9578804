"""What the tests share."""

import os
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def same_rows(spark_df, sql: str, data: Path = DATA) -> None:
    """A Spark result and a DuckDB result hold the same rows, columns by name, in any order."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for p in sorted(data.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = spark_df.toPandas(), con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, float | int) else x
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
