"""Flagship slice: embeddings -> kNN uncertainty (F1) -> calibration split (H1)
-> thresholds (H2) -> labels (H3) -> AUROC / AURC / rejection accuracy (H4-H7).

The embedding table carries no answer quality, so two quality columns are
derived from the row id by a fixed rule (the same rule in the SQL twin).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selective as S
from ..operators.score import knn_uncertainty
from ..sources import tables as T
from .materialize import materialize

K = 5


def scored_embeddings(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    e = T.emb(spark, sf_dir)
    train = e.filter(F.col("split") == "train")
    ev = e.filter(F.col("split") != "train")
    uq = knn_uncertainty(train, ev, k)
    rid = F.col("row_id")
    return (ev.select("row_id", "split").join(uq, "row_id")
              .select("row_id", "split", "uq",
                      (((rid * 7919) % 1000).cast("double") / 1000).alias("bertscore_f1"),
                      (((rid * 104729) % 100).cast("double") / 100).alias("rougeL")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(scored_embeddings(spark, sf_dir))
    split = S.calib_split(scored, "split", ("test",), 0.30, 42)
    return S.evaluate_schemes(split)


EMB_SCORES_SQL = f"""
tr AS (SELECT row_id, v FROM emb WHERE split = 'train'),
ev AS (SELECT row_id, split, v FROM emb WHERE split <> 'train'),
pairs AS (SELECT e.row_id, e.split, t.row_id AS tid, list_distance(e.v, t.v) AS dist FROM ev e, tr t),
nn AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, tid) AS rk FROM pairs),
knn AS (SELECT row_id, split, avg(dist) AS uq FROM nn WHERE rk <= {K} GROUP BY row_id, split)"""

FLAGSHIP_SCORES_SQL = EMB_SCORES_SQL + """,
scores AS (SELECT row_id, split, uq, CAST((row_id * 7919) % 1000 AS DOUBLE) / 1000 AS bertscore_f1,
                  CAST((row_id * 104729) % 100 AS DOUBLE) / 100 AS rougeL FROM knn)"""
