"""Compares queries with their SQL: same columns, same rows in any order."""

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda c: names[c])
    return sorted(tuple(_plain(row[c]) for c in order) for row in rows)


def compare(spark, con, folder, make, sql):
    """None if equal, else what differs. Also seconds of both sides."""
    began = time.time()
    df = make(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        return "the plan has a cross join", (0.0, 0.0)
    ours = _rows(df.columns, df.collect())
    middle = time.time()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = _rows(names, result.fetchall())
    seconds = (middle - began, time.time() - middle)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}", seconds
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows", seconds
    odd = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return (f"{len(odd)} of {len(ours)} rows differ, first {odd[0]}" if odd else None), seconds
