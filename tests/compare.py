"""Result comparison against DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def oracle(sql: str, sf: str = SF) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    if "line" in df:
        df["line"] = df["line"].astype("Int64")
    df = df.astype(object).where(df.notna(), None).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, sql: str) -> int:
    got, want = normal(spark_df.toPandas()), normal(oracle(sql))
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)
    return len(got)
