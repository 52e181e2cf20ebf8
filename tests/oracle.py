"""Runs a query and its SQL side by side, as the driver does."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings dp1_objects des_sources tmpl_catalog partition_info cut_targets eval_items".split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        # no result may hold a NaN: comparisons elsewhere don't take NaN for equal to NaN
        assert not math.isnan(value)
        return repr(value + 0.0)
    return str(value)


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted(tuple(plain(r[c]) for c in order) for r in df.collect())


def sql_rows(con, sql):
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
