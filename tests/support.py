"""Comparison of a query with its statement on the smallest tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def statement(sql):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def check_query(spark, query, sql):
    df = query(spark, SF)
    got = df.collect()
    if sql is None:
        assert got
        return
    names, expected = statement(sql)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of(names, expected)
