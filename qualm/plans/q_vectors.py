"""Queries over embedding tables: F-rows (scoring), D-rows (reduction), E-rows (clustering)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.score import knn_uncertainty
from ..sources import tables as T
from . import flagship as FL
from .catalog import register
from .q_eval import eval_sql, split_sql, thr_sql

EMB = "WITH emb AS (" + T.SQL["emb"] + "\n),"


@register("f1_knn_uncertainty", EMB + FL.EMB_SCORES_SQL + "\nSELECT row_id, split, uq FROM knn",
          doubles=["uq"])
def f1_knn_uncertainty(spark, sf):
    e = T.emb(spark, sf)
    uq = knn_uncertainty(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), FL.K)
    return e.filter(F.col("split") != "train").select("row_id", "split").join(uq, "row_id")


@register("flagship_knn_selective", EMB + FL.FLAGSHIP_SCORES_SQL + "," + split_sql(None) + ",\n" + thr_sql("")
          + "," + eval_sql("") + "\nSELECT * FROM res",
          doubles=["p_bert", "p_rouge", "tau_bert", "tau_rouge", "acc_joint", "err_joint", "auroc", "aurc",
                   "acc_at_80", "acc_at_90", "acc_at_95", "acc_at_100"])
def flagship_knn_selective(spark, sf):
    return FL.flagship(spark, sf)


# ------------------------------------------------------------------------------- D rows
from ..operators import reduce as R  # noqa: E402
from ..operators import cluster as C  # noqa: E402
from ..operators import score as SC  # noqa: E402

TOK = "WITH tokens AS (" + T.SQL["tokens"] + "\n),\nu AS (SELECT row_id, pos, mask, CAST(unnest(vec) AS DOUBLE) AS x, " \
      "generate_subscripts(vec, 1) - 1 AS d FROM tokens)"


@register("d2_mean_pooling", TOK + """
SELECT row_id, CAST(d AS BIGINT) AS d, sum(x * mask) / greatest(sum(mask), 1e-9) AS value FROM u GROUP BY row_id, d""",
          doubles=["value"])
def d2_mean_pooling(spark, sf):
    return R.explode_vector(R.mean_pooling(T.tokens(spark, sf)), "pooled", ["row_id"])


@register("d3_cls_pooling", TOK + "\nSELECT row_id, CAST(d AS BIGINT) AS d, x AS value FROM u WHERE pos = 0",
          doubles=["value"])
def d3_cls_pooling(spark, sf):
    return R.explode_vector(R.cls_pooling(T.tokens(spark, sf)), "pooled", ["row_id"]).withColumn(
        "value", F.col("value").cast("double"))


@register("d4_last_token", TOK + """,
t AS (SELECT row_id, greatest(sum(mask) - 1, 0) AS tp FROM tokens GROUP BY row_id)
SELECT u.row_id, CAST(d AS BIGINT) AS d, x AS value FROM u JOIN t ON u.row_id = t.row_id AND u.pos = t.tp""",
          doubles=["value"])
def d4_last_token(spark, sf):
    return R.explode_vector(R.last_token_pooling(T.tokens(spark, sf)), "pooled", ["row_id"]).withColumn(
        "value", F.col("value").cast("double"))


EMB_LONG = EMB + """
u AS (SELECT row_id, split, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM emb)"""


@register("d5_standard_scaler", EMB_LONG + """,
m AS (SELECT d, avg(x) AS mu, stddev_pop(x) AS sd FROM u GROUP BY d)
SELECT row_id, CAST(u.d AS BIGINT) AS d, (x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS value
FROM u JOIN m ON u.d = m.d""", doubles=["value"])
def d5_standard_scaler(spark, sf):
    e = T.emb(spark, sf)
    tr, ev, _ = R.standard_scale(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"))
    return R.explode_vector(tr.unionByName(ev), "v", ["row_id"])


SQUARINGS, AXES = 24, 8


def _reduced(spark, sf, method, k=AXES):
    e = T.emb(spark, sf)
    tr, ev = R.reduce_dimensionality(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"),
                                     k, method)
    return R.explode_vector(tr.unionByName(ev), "r", ["row_id"])


def axes_sql(centre: bool) -> str:
    """Projections on the first AXES right singular vectors of the train rows, less their mean if ``centre``.

    An axis is found by squaring the Gram matrix SQUARINGS times, which leaves its first eigenvector's outer product, and is
    then taken out of the matrix. Its largest loading is positive."""
    shift = "avg(x) OVER (PARTITION BY d)" if centre else "0"
    ctes = [EMB.replace("WITH", "WITH RECURSIVE", 1) + f"""
long AS MATERIALIZED (SELECT row_id, split, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM emb),
tu AS (SELECT row_id, d, x - {shift} AS x FROM long WHERE split = 'train'),
means AS (SELECT d, avg(x) AS m FROM long WHERE split = 'train' GROUP BY d),
rows AS MATERIALIZED (SELECT row_id, list(x - {'m' if centre else 0} ORDER BY d) AS v FROM long JOIN means USING (d) GROUP BY row_id),
cols AS MATERIALIZED (SELECT d, list(x ORDER BY row_id) AS c FROM tu GROUP BY d),
g0 AS MATERIALIZED (SELECT a.d AS i, list(list_dot_product(a.c, b.c) ORDER BY b.d) AS r FROM cols a, cols b GROUP BY a.d)"""]
    for c in range(AXES):
        ctes.append(f"""
p{c} AS (SELECT 0 AS s, i, list_transform(r, lambda x: x / t) AS r FROM g{c}, (SELECT sum(r[i]) AS t FROM g{c}) q
  UNION ALL SELECT s + 1, i, list_transform(r, lambda x: x / t) FROM (SELECT s, i, r, sum(r[i]) OVER () AS t FROM (
    SELECT a.s, a.i, list(list_dot_product(a.r, b.r) ORDER BY b.i) AS r FROM p{c} a, p{c} b WHERE a.s < {SQUARINGS} GROUP BY a.s, a.i) q) q),
m{c} AS (SELECT r, list_transform(r, lambda x: abs(x)) AS size FROM p{c} WHERE s = {SQUARINGS} ORDER BY r[i] DESC LIMIT 1),
w{c} AS MATERIALIZED (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * sign(r[list_position(size, list_max(size))])) AS w FROM m{c}),
g{c + 1} AS MATERIALIZED (SELECT i, list_transform(r, lambda x, j: x - lam * w[i] * w[j]) AS r
  FROM g{c}, w{c}, (SELECT sum(w[i] * list_dot_product(r, w)) AS lam FROM g{c}, w{c}) q)""")
    picks = "\nUNION ALL ".join(f"SELECT row_id, CAST({c} AS BIGINT) AS d, list_dot_product(v, w) AS value FROM rows, w{c}" for c in range(AXES))
    return ",".join(ctes) + "\n" + picks


@register("d6_pca", axes_sql(True), doubles=["value"])
def d6_pca(spark, sf):
    return _reduced(spark, sf, "PCA")


@register("d7_svd", axes_sql(False), doubles=["value"])
def d7_svd(spark, sf):
    return _reduced(spark, sf, "SVD")


@register("d8_tucker", axes_sql(False), doubles=["value"])
def d8_tucker(spark, sf):
    return _reduced(spark, sf, "TUCKER")


@register("d10_mahalanobis_filter", """
WITH s AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, var_samp(l_quantity) AS a,
                  covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS c FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
             sqrt(greatest(0e0, ((l_quantity - mq) ^ 2 * c - 2 * (l_quantity - mq) * (l_discount - md) * b
                   + (l_discount - md) ^ 2 * a) / (a * c - b * b))) AS mahalanobis FROM lineitem, s)
SELECT * FROM x WHERE mahalanobis < (SELECT quantile_cont(mahalanobis, 0.95) FROM x)""",
          doubles=["l_quantity", "l_discount", "mahalanobis"])
def d10_mahalanobis_filter(spark, sf):
    li = T.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return R.mahalanobis_filter(li, ["l_quantity", "l_discount"], 95.0)


# ------------------------------------------------------------------------------- E rows
@register("e1_kmeans")  # seeded k-means|| start: checked by properties in tests
def e1_kmeans(spark, sf):
    e = T.emb(spark, sf)
    tr, ev, _ = C.kmeans_fit_predict(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), 8)
    return tr.unionByName(ev).select("row_id", "split", "cluster")


def _given_labels(spark, sf):
    """Train rows with their label; label 7 rows with row_id % 8 = 0 form a small cluster 17."""
    e = T.emb(spark, sf).filter(F.col("split") == "train")
    return e.withColumn("cl", F.when((F.col("label") == 7) & (F.col("row_id") % 8 == 0), F.lit(17))
                        .otherwise(F.col("label")).cast("bigint"))


GIVEN_SQL = EMB + """
g AS (SELECT row_id, v, CAST(CASE WHEN label = 7 AND row_id % 8 = 0 THEN 17 ELSE label END AS BIGINT) AS cl
      FROM emb WHERE split = 'train'),
gu AS (SELECT cl, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM g),
cen AS (SELECT cl, d, avg(x) AS c FROM gu GROUP BY cl, d),
sz AS (SELECT cl, count(*) AS n FROM g GROUP BY cl),
pr AS (SELECT s.cl AS small, l.cl AS large, sqrt(sum((a.c - b.c) ^ 2)) AS dist
       FROM sz s JOIN sz l ON s.n < 10 AND l.n >= 10
       JOIN cen a ON a.cl = s.cl JOIN cen b ON b.cl = l.cl AND b.d = a.d GROUP BY s.cl, l.cl),
mp AS (SELECT small, first(large ORDER BY dist, large) AS large FROM pr GROUP BY small)
SELECT row_id, cl, coalesce(mp.large, cl) AS merged FROM g LEFT JOIN mp ON g.cl = mp.small"""


@register("e2_merge_small_clusters", GIVEN_SQL)
def e2_merge_small_clusters(spark, sf):
    g = _given_labels(spark, sf)
    return C.merge_small_clusters(g, "cl", 10, out="merged").select("row_id", "cl", "merged")


@register("e4_core_distance", EMB + f"""
tr AS (SELECT row_id, v FROM emb WHERE split = 'train'),
pr AS (SELECT a.row_id, list_distance(a.v, b.v) AS dist,
              row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.v, b.v), b.row_id) AS rk
       FROM tr a JOIN tr b ON a.row_id <> b.row_id)
SELECT row_id, dist AS core_dist FROM pr WHERE rk = 5""", doubles=["core_dist"])
def e4_core_distance(spark, sf):
    e = T.emb(spark, sf).filter(F.col("split") == "train")
    return C.core_distances(e, 5)


# ------------------------------------------------------------------------------- F rows
@register("f3_kmeans_uq")
def f3_kmeans_uq(spark, sf):
    e = T.emb(spark, sf)
    return SC.kmeans_uq(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), 8, 5)


@register("f7_kde_fixed_bandwidth", EMB + """
tr AS (SELECT row_id, v FROM emb WHERE split = 'train'),
ev AS (SELECT row_id, split, v FROM emb WHERE split <> 'train'),
a AS (SELECT e.row_id, -(list_distance(e.v, t.v) ^ 2) / 2e0 AS a FROM ev e, tr t),
l AS (SELECT row_id, max(a) + ln(sum(exp(a - (SELECT max(a) FROM a a2 WHERE a2.row_id = a.row_id)))) AS lse,
             count(*) AS n FROM a GROUP BY row_id)
SELECT row_id, -(lse - ln(n) - 32 * ln(2 * pi())) AS uq FROM l""", doubles=["uq"])
def f7_kde_fixed_bandwidth(spark, sf):
    e = T.emb(spark, sf)
    return SC.kde_neg_log_density(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), 1.0)


@register("f2_kmeans_knn")
def f2_kmeans_knn(spark, sf):
    e = T.emb(spark, sf)
    return SC.kmeans_knn_uncertainty(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), 8, 5)


@register("f8_kmeans_kde")
def f8_kmeans_kde(spark, sf):
    e = T.emb(spark, sf)
    return SC.kmeans_kde_uncertainty(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"),
                                     8, 10)


@register("d1_embed_default", "WITH qa AS (" + T.SQL["qa"] + """),
b AS (SELECT row_id, list_transform(list_filter(string_split(regexp_replace(lower(coalesce(model_answer, '')), '[^a-z0-9]+', ' ', 'g'), ' '),
             lambda t: t <> ''), lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64) AS b FROM qa),
c AS (SELECT row_id, unnest(range(0, 64)) AS d, b FROM b),
n AS (SELECT row_id, d, CAST(len(list_filter(b, lambda x: x = d)) AS DOUBLE) AS x FROM c)
SELECT row_id, CAST(d AS BIGINT) AS d, coalesce(x / nullif(sqrt(sum(x * x) OVER (PARTITION BY row_id)), 0), 0) AS value FROM n""",
          doubles=["value"])
def d1_embed_default(spark, sf):
    from ..operators.embed import embed_column
    return R.explode_vector(embed_column(T.qa(spark, sf), "model_answer"), "v", ["row_id"])


# ------------------------------------------------------------------------------- HDBSCAN rows
from ..operators import hdbscan as HD  # noqa: E402

HDB = {"min_cluster_size": 10, "min_samples": 5, "epsilon": 0.0, "n_neighbors": 5}


@register("e5_hdbscan_spanning_tree")  # exact tree: checked against a single-machine build in tests
def e5_hdbscan_spanning_tree(spark, sf):
    from .materialize import materialize
    e = T.emb(spark, sf).filter(F.col("split") == "train").select("row_id", "v")
    return HD.spanning_tree(materialize(e), HDB["min_samples"]).select("lo", "hi", "w")


@register("e6_hdbscan_labels")
def e6_hdbscan_labels(spark, sf):
    e = T.emb(spark, sf).filter(F.col("split") == "train")
    return HD.hdbscan_labels(e, HDB["min_cluster_size"], HDB["min_samples"], HDB["epsilon"])


@register("f4_hdbscan_knn")
def f4_hdbscan_knn(spark, sf):
    e = T.emb(spark, sf)
    return SC.hdbscan_knn_uncertainty(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"),
                                      HDB["min_cluster_size"], HDB["min_samples"], HDB["epsilon"],
                                      HDB["n_neighbors"])


@register("f5_hdbscan_min_cluster_knn")
def f5_hdbscan_min_cluster_knn(spark, sf):
    e = T.emb(spark, sf)
    return SC.hdbscan_min_cluster_uncertainty(e.filter(F.col("split") == "train"),
                                              e.filter(F.col("split") != "train"), HDB["min_cluster_size"],
                                              HDB["min_samples"], HDB["epsilon"], HDB["n_neighbors"])


@register("d9_isomap")  # landmark Isomap on the raw (connected) embedding; checked by properties in tests
def d9_isomap(spark, sf):
    e = T.emb(spark, sf, raw=True)
    tr, ev = R.landmark_isomap(e.filter(F.col("split") == "train"), e.filter(F.col("split") != "train"), 8)
    return R.explode_vector(tr.select("row_id", "r").unionByName(ev.select("row_id", "r")), "r", ["row_id"])


E3_SQL = GIVEN_SQL.replace(
    "CAST(CASE WHEN label = 7 AND row_id % 8 = 0 THEN 17 ELSE label END AS BIGINT) AS cl",
    "CAST(CASE WHEN label = 7 AND row_id % 8 = 0 THEN -1 WHEN label = 6 AND row_id % 8 = 0 THEN 16 "
    "ELSE label END AS BIGINT) AS cl")


@register("e3_merge_small_with_noise", E3_SQL)
def e3_merge_small_with_noise(spark, sf):
    """Noise (-1) counts as a cluster: small noise is absorbed into the nearest large cluster."""
    e = T.emb(spark, sf).filter(F.col("split") == "train")
    g = e.withColumn("cl", F.when((F.col("label") == 7) & (F.col("row_id") % 8 == 0), F.lit(-1))
                     .when((F.col("label") == 6) & (F.col("row_id") % 8 == 0), F.lit(16))
                     .otherwise(F.col("label")).cast("bigint"))
    return C.merge_small_clusters(g, "cl", 10, include_noise=True, out="merged").select("row_id", "cl", "merged")
