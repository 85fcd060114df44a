"""Comparison helpers: round doubles the same way on the Spark and DuckDB side,
and compare a Spark result with a DuckDB query on the same parquet tables."""
from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
PLACES = 6


def round_doubles(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every double column (comparison layer only, never inside an operator)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name))
        elif t == "int" or t == "smallint" or t == "tinyint":
            out.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def round_sql(sql: str, doubles: list[str], places: int = PLACES) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f'round("{c}", {places}) AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


def duckdb_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            return 0.0
        return round(v, PLACES)
    return v


def compare(spark_df: DataFrame, sql: str, sf_dir: str, con=None) -> dict:
    """Row count, column names and order-insensitive values of both sides."""
    con = con or duckdb_connect(sf_dir)
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    res = {"rows_spark": len(srows), "rows_oracle": len(drows),
           "cols_match": sorted(scols) == sorted(dcols)}
    if res["cols_match"]:
        order = sorted(range(len(scols)), key=lambda i: scols[i])
        dorder = [dcols.index(scols[i]) for i in order]
        s = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=repr)
        d = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=repr)
        res["values_match"] = s == d
        if not res["values_match"]:
            diff = [(a, b) for a, b in zip(s, d) if a != b][:3]
            res["first_diffs"] = diff
    else:
        res["values_match"] = False
        res["cols"] = (scols, dcols)
    return res
