"""Base table access and the fixture views the tests and queries share.

Each view exists twice: a DataFrame builder (what the library runs) and the
same rows as DuckDB SQL text (what the oracle runs). Integer outputs are cast
to bigint on both sides so widths agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _first_int(props: Column) -> Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("double")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scored answer: (row_id, split, uq, bertscore_f1, rougeL)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("bigint").alias("row_id"),
        F.when(F.col("event_type") == "error", "d01")
         .when(F.col("event_type") == "purchase", "d02")
         .otherwise("test").alias("split"),
        F.col("value").cast("double").alias("uq"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / 1000).alias("bertscore_f1"),
        (_first_int(F.col("props")) / 100).alias("rougeL"),
    )


def fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation front rows (seed, gen, idx, f1, f2, x0..x5); every tenth row repeated."""
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    b = ev.select(
        (F.col("user_id") % 5 + 1).cast("bigint").alias("seed"),
        F.dayofmonth("ts").cast("bigint").alias("gen"),
        eid.cast("bigint").alias("idx"),
        (F.lit(0.1) - F.col("value") / 600).alias("f1"),
        (F.lit(0.1) - _first_int(F.col("props")) / 120).alias("f2"),
        (5 + (eid % 31).cast("double") / 2).alias("x0"),
        (1 + (eid % 20).cast("double")).alias("x1"),
        ((eid % 50).cast("double") / 100).alias("x2"),
        (5 + (eid % 61).cast("double") / 2).alias("x3"),
        ((eid % 3).cast("double") / 2).alias("x4"),
        F.lit(0.0).alias("x5"),
    )
    dup = b.filter(F.col("idx") % 10 == 0).withColumn("idx", F.col("idx") + 1000000000)
    return b.unionByName(dup)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (seed, gen) hypervolume series."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy((F.col("user_id") % 5 + 1).cast("bigint").alias("seed"),
                       F.dayofmonth("ts").cast("bigint").alias("gen"))
              .agg((F.max("value") / 600).alias("hv")))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn and the next assistant turn: (row_id, question, model_answer)."""
    c = read_table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("model_answer"))
    return (u.join(a, ["conv_id", "turn"])
             .select((F.col("conv_id") * 100 + F.col("turn")).cast("bigint").alias("row_id"),
                     "question", "model_answer"))


def emb(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """Embedding rows (row_id, label, split, v array<double>).

    Each label is moved by 2 along its own axis so clusters exist; ``raw`` keeps
    the unit-norm noise vectors (the all-noise case).
    """
    e = read_table(spark, sf_dir, "embeddings")
    split = (F.when(F.col("label") == 8, "d01").when(F.col("label") == 9, "d02")
              .when(F.col("vec_id") % 5 < 4, "train").otherwise("test"))
    if raw:
        v = F.transform("embedding", lambda x: x.cast("double"))
    else:
        v = F.expr("transform(embedding, (x, i) -> CAST(x AS DOUBLE) + "
                   "CASE WHEN i = label THEN 2e0 ELSE 0e0 END)")
    return e.select(F.col("vec_id").cast("bigint").alias("row_id"),
                    F.col("label").cast("bigint").alias("label"), split.alias("split"), v.alias("v"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-state rows (row_id, pos, mask, vec) with a prefix mask."""
    from pyspark.sql import Window
    e = read_table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    t = e.select(F.col("label").cast("bigint").alias("row_id"),
                 (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "embedding")
    return t.select("row_id", "pos",
                    F.when(F.col("pos") < 20 + F.col("row_id"), 1).otherwise(0).cast("bigint").alias("mask"),
                    F.col("embedding").alias("vec"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment result grid, unique per (layer, method, reduction, dimensionality)."""
    li = read_table(spark, sf_dir, "lineitem")
    from ..functions.stats import safe_pearson_raw
    return (li.groupBy(
                F.col("l_linenumber").cast("bigint").alias("layer"),
                F.when(F.col("l_suppkey") % 4 == 3, "TS").when(F.col("l_returnflag") == "N", "MCD")
                 .when(F.col("l_returnflag") == "R", "KNN").otherwise("KDE").alias("method"),
                F.when(F.col("l_linestatus") == "O", "PCA").otherwise("SVD").alias("reduction"),
                F.when(F.col("l_partkey") % 2 == 0, 128).otherwise(256).cast("bigint").alias("dimensionality"))
              .agg(safe_pearson_raw("l_quantity", "l_discount").alias("pearson_bertscore"),
                   safe_pearson_raw("l_quantity", "l_tax").alias("pearson_meteor")))


def rank_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid with rank correlations: Pearson over tie-averaged ranks in each cell."""
    from ..functions.stats import safe_pearson_raw
    from ..operators.order import average_rank
    key = ["layer", "method", "reduction", "dimensionality"]
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("layer"),
        F.when(F.col("l_suppkey") % 4 == 3, "TS").when(F.col("l_returnflag") == "N", "MCD")
         .when(F.col("l_returnflag") == "R", "KNN").otherwise("KDE").alias("method"),
        F.when(F.col("l_linestatus") == "O", "PCA").otherwise("SVD").alias("reduction"),
        F.when(F.col("l_partkey") % 2 == 0, 128).otherwise(256).cast("bigint").alias("dimensionality"),
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    for c in ("q", "d", "t"):
        li = average_rank(li, c, key, f"r{c}")
    return li.groupBy(*key).agg(safe_pearson_raw("rq", "rd").alias("spearman_bertscore"),
                                safe_pearson_raw("rq", "rt").alias("spearman_meteor"))


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL, for oracle queries (WITH-clause bodies).
SQL = {
    "scores": """
SELECT event_id AS row_id,
       CASE event_type WHEN 'error' THEN 'd01' WHEN 'purchase' THEN 'd02' ELSE 'test' END AS split,
       value AS uq,
       CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS bertscore_f1,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS rougeL
FROM events""",
    "fronts": """
WITH b AS (
  SELECT CAST(user_id % 5 + 1 AS BIGINT) AS seed, CAST(day(ts) AS BIGINT) AS gen, event_id AS idx,
         0.1e0 - value / 600 AS f1,
         0.1e0 - CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 120 AS f2,
         5 + CAST(event_id % 31 AS DOUBLE) / 2 AS x0, 1 + CAST(event_id % 20 AS DOUBLE) AS x1,
         CAST(event_id % 50 AS DOUBLE) / 100 AS x2,   5 + CAST(event_id % 61 AS DOUBLE) / 2 AS x3,
         CAST(event_id % 3 AS DOUBLE) / 2 AS x4,      0e0 AS x5
  FROM events)
SELECT * FROM b
UNION ALL
SELECT seed, gen, idx + 1000000000, f1, f2, x0, x1, x2, x3, x4, x5 FROM b WHERE idx % 10 = 0""",
    "progress": """
SELECT CAST(user_id % 5 + 1 AS BIGINT) AS seed, CAST(day(ts) AS BIGINT) AS gen, max(value) / 600 AS hv
FROM events GROUP BY user_id % 5 + 1, day(ts)""",
    "qa": """
SELECT u.conv_id * 100 + u.turn AS row_id, u.text AS question, a.text AS model_answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "emb": """
SELECT vec_id AS row_id, CAST(label AS BIGINT) AS label,
  CASE WHEN label = 8 THEN 'd01' WHEN label = 9 THEN 'd02'
       WHEN vec_id % 5 < 4 THEN 'train' ELSE 'test' END AS split,
  list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i = label + 1 THEN 2 ELSE 0 END) AS v
FROM embeddings""",
    "tokens": """
SELECT row_id, pos, CAST(CASE WHEN pos < 20 + row_id THEN 1 ELSE 0 END AS BIGINT) AS mask, embedding AS vec
FROM (SELECT CAST(label AS BIGINT) AS row_id,
             CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS pos, embedding
      FROM embeddings) t""",
    "results": """
SELECT CAST(l_linenumber AS BIGINT) AS layer,
       CASE WHEN l_suppkey % 4 = 3 THEN 'TS' WHEN l_returnflag = 'N' THEN 'MCD'
            WHEN l_returnflag = 'R' THEN 'KNN' ELSE 'KDE' END AS method,
       CASE l_linestatus WHEN 'O' THEN 'PCA' ELSE 'SVD' END AS reduction,
       CAST(CASE WHEN l_partkey % 2 = 0 THEN 128 ELSE 256 END AS BIGINT) AS dimensionality,
       CASE WHEN count(*) < 3 OR var_pop(l_discount) = 0 OR var_pop(l_quantity) = 0 THEN 0e0
            ELSE covar_pop(l_quantity, l_discount) / sqrt(var_pop(l_quantity) * var_pop(l_discount)) END AS pearson_bertscore,
       CASE WHEN count(*) < 3 OR var_pop(l_tax) = 0 OR var_pop(l_quantity) = 0 THEN 0e0
            ELSE covar_pop(l_quantity, l_tax) / sqrt(var_pop(l_quantity) * var_pop(l_tax)) END AS pearson_meteor
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "rank_results": """
SELECT layer, method, reduction, dimensionality,
       CASE WHEN count(*) < 3 OR var_pop(rd) = 0 OR var_pop(rq) = 0 THEN 0e0
            ELSE covar_pop(rq, rd) / sqrt(var_pop(rq) * var_pop(rd)) END AS spearman_bertscore,
       CASE WHEN count(*) < 3 OR var_pop(rt) = 0 OR var_pop(rq) = 0 THEN 0e0
            ELSE covar_pop(rq, rt) / sqrt(var_pop(rq) * var_pop(rt)) END AS spearman_meteor
FROM (SELECT layer, method, reduction, dimensionality,
        rank() OVER (PARTITION BY layer, method, reduction, dimensionality ORDER BY l_quantity)
          + (count(*) OVER (PARTITION BY layer, method, reduction, dimensionality, l_quantity) - 1) / 2e0 AS rq,
        rank() OVER (PARTITION BY layer, method, reduction, dimensionality ORDER BY l_discount)
          + (count(*) OVER (PARTITION BY layer, method, reduction, dimensionality, l_discount) - 1) / 2e0 AS rd,
        rank() OVER (PARTITION BY layer, method, reduction, dimensionality ORDER BY l_tax)
          + (count(*) OVER (PARTITION BY layer, method, reduction, dimensionality, l_tax) - 1) / 2e0 AS rt
      FROM (SELECT CAST(l_linenumber AS BIGINT) AS layer,
              CASE WHEN l_suppkey % 4 = 3 THEN 'TS' WHEN l_returnflag = 'N' THEN 'MCD'
                   WHEN l_returnflag = 'R' THEN 'KNN' ELSE 'KDE' END AS method,
              CASE l_linestatus WHEN 'O' THEN 'PCA' ELSE 'SVD' END AS reduction,
              CAST(CASE WHEN l_partkey % 2 = 0 THEN 128 ELSE 256 END AS BIGINT) AS dimensionality,
              l_quantity, l_discount, l_tax FROM lineitem))
GROUP BY ALL""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle query with the fixture views it names, as CTEs."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}" if names else body
