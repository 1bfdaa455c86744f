"""Compare queries with their SQL, as the driver does."""

import math

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return repr(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, sf_dir):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    rows = done.fetchall()
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in rows)
