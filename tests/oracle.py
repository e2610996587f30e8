"""Compare a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x != x:
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(r[c]) for c in names) for r in frame.to_dict("records"))


def assert_same(spark, con, sf_dir, name, query, sql):
    found = [tuple(r) for r in query(spark, sf_dir).collect()]
    columns = query(spark, sf_dir).columns
    cursor = con.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    assert sorted(columns) == sorted(wanted_columns), name
    order, other = [columns.index(c) for c in sorted(columns)], [wanted_columns.index(c) for c in sorted(columns)]
    a = sorted(tuple(cell(r[i]) for i in order) for r in found)
    b = sorted(tuple(cell(r[i]) for i in other) for r in wanted)
    assert a == b, name
