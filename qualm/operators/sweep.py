"""Configuration sweeps (I2, H11) with shared stages.

Every configuration that differs only in k reuses one kNN pass at the largest
k: a configuration's score is the mean of the first k distances of each row.
Configurations are a table; the sweep is a join of that table with the shared
neighbour table, so adding configurations adds rows, not jobs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nan_to_num, safe_corr
from .blocks import knn

PENALTY = 1e3


def knn_scores_for_configs(train: DataFrame, evals: DataFrame, configs: DataFrame, k_col: str = "n_neighbors",
                           vec: str = "v", id_col: str = "row_id") -> DataFrame:
    """(config..., row_id, uq) for every configuration: mean distance to its k nearest."""
    ks = sorted(r[0] for r in configs.select(F.col(k_col).cast("int")).distinct().collect())  # at most the largest k of them
    nn = knn(evals, train, ks[-1], qid=id_col, pid=id_col, vec=vec)
    # each row's means for the wanted k, once; configurations meet them by k
    own = nn.groupBy(F.col("q_id").alias(id_col)).agg(F.sort_array(F.collect_list("dist")).alias("_d"))
    total = lambda k: F.aggregate(F.slice("_d", 1, k), F.lit(0.0), lambda acc, x: acc + x)
    means = own.select(id_col, F.explode(F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: F.struct(
        k.alias("_k"), (total(k) / F.least(k, F.size("_d"))).alias("uq")))).alias("_m")).select(id_col, "_m._k", "_m.uq")
    return means.join(configs, F.col("_k") == F.col(k_col)).select(*configs.columns, id_col, "uq")


def objectives(scored: DataFrame, config_cols, bert: str = "bertscore_f1", rouge: str = "rougeL",
               configs: DataFrame | None = None) -> DataFrame:
    """I2 objectives per configuration: (corr(uq, BERTScore), corr(uq, ROUGE-L)),
    non-finite scores and qualities guarded to 0 first; a failed or non-finite objective -> penalty,
    as for a row of ``configs`` without scored rows."""
    guarded = scored.withColumns({"_u": nan_to_num("uq"), "_b": nan_to_num(bert), "_r": nan_to_num(rouge)})
    g = guarded.groupBy(*config_cols).agg(safe_corr("_u", "_b").alias("f1"), safe_corr("_u", "_r").alias("f2"))
    if configs is not None:
        g = configs.select(*config_cols).distinct().join(g, list(config_cols), "left")
    fin = lambda c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)).otherwise(F.lit(PENALTY))
    return g.select(*config_cols, F.coalesce(fin("f1"), F.lit(PENALTY)).alias("f1"),
                    F.coalesce(fin("f2"), F.lit(PENALTY)).alias("f2"))
