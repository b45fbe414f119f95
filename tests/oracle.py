"""A query's rows beside those of its SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    v = v.item() if hasattr(v, "item") else v
    return repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)


def normal(rows, columns):
    return sorted("|".join(_text(r[c]) for c in columns) for r in rows)


def by_sql(sf_dir: str, sql: str) -> tuple[list[str], list[dict]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    table = con.execute(sql).fetch_arrow_table() if hasattr(con, "fetch_arrow_table") else con.sql(sql).arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    return table.column_names, table.to_pylist()


def same(df, sf_dir: str, sql: str) -> None:
    columns, expected = by_sql(sf_dir, sql)
    got = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == sorted(columns)
    columns = sorted(columns)
    assert normal(got, columns) == normal(expected, columns)
