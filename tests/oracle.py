"""Compare a query with its DuckDB counterpart."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame):
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        if hasattr(v, "dtype") and "int" in str(v.dtype):
            return str(int(v))
        return str(v)

    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def duck(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def agree(spark, sf, query, sql):
    mine, theirs = query(spark, sf).toPandas(), duck(sf, sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)
