"""Compare a query with its SQL: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(tuple(repr(x) for x in r) for r in frame.select(*names).collect())


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in cursor.fetchall())
