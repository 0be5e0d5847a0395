"""Run a query in Spark and its SQL in DuckDB over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None else round(v, 6) if isinstance(v, float) else str(v)


def same(spark, con, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    con.execute(sql)
    columns, types = [c[0] for c in con.description], dict(df.dtypes)
    assert sorted(columns) == sorted(df.columns)
    assert {c[0]: str(c[1]) for c in con.description if c[0] in types} == {c: TYPES[types[c]] for c in columns}
    want = sorted((tuple(map(plain, r)) for r in con.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == want
