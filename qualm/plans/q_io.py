"""Write-then-read-back queries for the sources and sinks (A1, A4-A8) and the
evaluation-log analysis (I19)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pareto as P
from ..sources import io as IO
from ..sources import tables as T
from .catalog import register
from .q_sweep import DECODE_SQL, EARLY_SQL, GEN_STATS_SQL


@register("a1_read_delimited_dir", "WITH qa AS (" + T.SQL["qa"] + """)
SELECT row_id, question, model_answer FROM qa
UNION ALL SELECT -1, 'no answer', NULL""")
def a1_read_delimited_dir(spark, sf):
    folder = IO.scratch_dir(spark, "answers")
    qa = T.qa(spark, sf).select("row_id", "question", "model_answer")
    # files with the columns in another order and with one more between them
    other = qa.filter("row_id % 2 = 1").select("model_answer", F.lit("x").alias("note"), "question", "row_id")
    for part in (qa.filter("row_id % 2 = 0"), other):
        part.write.mode("append").option("header", True).option("sep", "|").option("quote", '"').option("escape", '"').csv(folder)
    # a file with a short row, and one that is skipped: its second row has more fields than its header
    for lines in (["-1|no answer"], ["1|a|b", "2|a|b|c"]):
        rows = spark.createDataFrame([(x,) for x in lines], "`row_id|question|model_answer` string").coalesce(1)
        rows.write.mode("append").option("header", True).option("sep", "\t").csv(folder)
    good, _ = IO.read_delimited_dir(spark, folder, ["row_id", "question", "model_answer"])
    return good.select(F.col("row_id").cast("bigint").alias("row_id"), "question", "model_answer")


@register("a4_a5_fronts_roundtrip", T.with_views("SELECT * FROM fronts", "fronts"),
          doubles=["f1", "f2", "x0", "x1", "x2", "x3", "x4", "x5"])
def a4_a5_fronts_roundtrip(spark, sf):
    path = IO.scratch_dir(spark, "fronts")
    IO.write_fronts(T.fronts(spark, sf), path)
    back = IO.read_fronts(spark, path)
    return back.select(F.col("seed").cast("bigint").alias("seed"), F.col("gen").cast("bigint").alias("gen"),
                       "idx", "f1", "f2", *P.X_COLS)


def _progress_rows(spark, sf):
    es = P.early_stop(T.progress(spark, sf))
    gs = P.generation_stats(T.fronts(spark, sf))
    return es.join(gs, ["seed", "gen"]).select("seed", "gen", "best_obj_bert", "best_obj_rouge", "best_combined",
                                               "mean_obj_bert", "mean_obj_rouge", "mean_combined", "hv",
                                               "hv_smooth", "hv_best_smooth", "hv_rel_improve",
                                               "earlystop_no_improve", "stopped")


PROGRESS_DOUBLES = IO.PROGRESS_COLS[1:-1]


@register("a6_progress_roundtrip", EARLY_SQL + ",\nfronts AS (" + T.SQL["fronts"] + "),\n" + GEN_STATS_SQL + """
SELECT es.seed, es.gen, best_obj_bert, best_obj_rouge, best_combined, mean_obj_bert, mean_obj_rouge, mean_combined,
       hv, hv_smooth, hv_best_smooth, hv_rel_improve, CAST(earlystop_no_improve AS DOUBLE) AS earlystop_no_improve, stopped
FROM es JOIN gs ON es.seed = gs.seed AND es.gen = gs.gen""", doubles=PROGRESS_DOUBLES)
def a6_progress_roundtrip(spark, sf):
    path = IO.scratch_dir(spark, "progress")
    IO.write_progress(_progress_rows(spark, sf), path)
    return IO.read_progress(spark, path)


def _eval_log_rows(spark, sf):
    f = T.fronts(spark, sf)
    total = F.when(F.col("idx") % 97 == 0, F.lit("error")).otherwise((F.col("x3") / 10).cast("string"))
    return f.select(
        F.col("idx").alias("eval_id"), F.array("f1", "f2").alias("F"),
        F.struct(F.struct(F.col("f1").alias("bert"), F.col("f2").alias("rouge")).alias("all")).alias("corr_bundle"),
        F.create_map(F.lit("scaling"), (F.col("x0") / 100).cast("string"), F.lit("reduction"),
                     F.col("x2").cast("string"), F.lit("total"), total).alias("timings_s"),
        F.create_map(F.lit("min_cluster_size"), F.col("x0"), F.lit("min_samples"), F.col("x1")).alias("hdb_params"),
        F.create_map(F.lit("dimension"), F.col("x4")).alias("emb_params"),
        F.lit("PCA").alias("reduction_method"))


def _eval_log(spark, sf):
    path = IO.scratch_dir(spark, "evallog")
    IO.append_eval_log(_eval_log_rows(spark, sf), path)
    return IO.read_eval_log(spark, path)


@register("a7_eval_log_roundtrip", T.with_views("""
SELECT idx AS eval_id, f1, f2, f1 AS corr_bert, x4 AS dimension, x3 / 10 AS total_sec FROM fronts""", "fronts")
          .replace("x3 / 10 AS total_sec", "CASE WHEN idx % 97 = 0 THEN NULL ELSE x3 / 10 END AS total_sec"),
          doubles=["f1", "f2", "corr_bert", "dimension", "total_sec"])
def a7_eval_log_roundtrip(spark, sf):
    log = _eval_log(spark, sf)
    return log.select("eval_id", F.col("F")[0].alias("f1"), F.col("F")[1].alias("f2"),
                      F.col("corr_bundle.all.bert").alias("corr_bert"), F.col("emb_params")["dimension"].alias("dimension"),
                      F.expr("try_cast(timings_s['total'] AS DOUBLE)").alias("total_sec"))


X_DOUBLES = [f"x{i}" for i in range(6)]


@register("a8_best_solution", T.with_views(f"""
SELECT gen AS generation, x0, x1, x2, x3, x4, x5, f1 AS obj_bert, f2 AS obj_rouge, (f1 + f2) * 0.5e0 AS combined_mean, f1 AS corr_bert,
       CAST(min_cluster_size AS DOUBLE) AS min_cluster_size, CAST(n_neighbors AS DOUBLE) AS knn_min_samples,
       CAST(emb_dim AS DOUBLE) AS dimension, reduction AS reduction_method, x0 / 100 AS scaling_sec
FROM (SELECT *, {DECODE_SQL} FROM fronts WHERE isfinite(f1) AND isfinite(f2))
ORDER BY (f1 + f2) * 0.5e0, seed, gen, idx LIMIT 1""", "fronts"),
          doubles=[*X_DOUBLES, "obj_bert", "obj_rouge", "combined_mean", "corr_bert", "min_cluster_size", "knn_min_samples", "dimension",
                   "scaling_sec"])
def a8_best_solution(spark, sf):
    f = P.finite_filter(T.fronts(spark, sf)).withColumn("combined", (F.col("f1") + F.col("f2")) * 0.5)
    best = f.agg(F.min_by(F.struct(*f.columns), F.struct("combined", "seed", "gen", "idx")).alias("b")).select("b.*")
    best = P.decode_x(best.withColumn("x_star", F.array(*X_DOUBLES)))
    number = lambda **names: F.map_from_entries(F.array(*[
        F.struct(F.lit(k), F.col(c).cast("double")) for k, c in names.items()]))
    record = best.select(
        F.col("gen").alias("generation"), "x_star", F.array("f1", "f2").alias("F"), F.col("f1").alias("obj_bert"),
        F.col("f2").alias("obj_rouge"), F.col("combined").alias("combined_mean"),
        F.struct(F.struct(F.col("f1").alias("bert"), F.col("f2").alias("rouge")).alias("all")).alias("corr_details"),
        number(min_cluster_size="min_cluster_size", min_samples="min_samples", cluster_selection_epsilon="cluster_selection_epsilon",
               knn_min_samples="n_neighbors").alias("hdb_params"),
        number(dimension="emb_dim").alias("embedding_params"), F.col("reduction").alias("reduction_method"),
        F.create_map(F.lit("scaling"), F.col("x_star")[0] / 100).alias("timings_s"))
    path = IO.scratch_dir(spark, "best")
    IO.write_best_solution(record, path)
    back = spark.read.schema(record.schema).json(path)
    return back.select(
        "generation", *[F.col("x_star")[i].alias(x) for i, x in enumerate(X_DOUBLES)], "obj_bert", "obj_rouge", "combined_mean",
        F.col("corr_details.all.bert").alias("corr_bert"), F.col("hdb_params")["min_cluster_size"].alias("min_cluster_size"),
        F.col("hdb_params")["knn_min_samples"].alias("knn_min_samples"), F.col("embedding_params")["dimension"].alias("dimension"),
        "reduction_method", F.col("timings_s")["scaling"].alias("scaling_sec"))


@register("i19_eval_log_analysis", T.with_views("""
SELECT block, count(*) AS n, count(*) FILTER (WHERE sec IS NULL) AS n_non_numeric, avg(sec) AS mean_sec,
       quantile_cont(sec, 0.5) AS median_sec, quantile_cont(sec, 0.9) AS p90_sec, max(sec) AS max_sec
FROM (SELECT 'scaling' AS block, x0 / 100 AS sec FROM fronts
      UNION ALL SELECT 'reduction', x2 FROM fronts
      UNION ALL SELECT 'total', CASE WHEN idx % 97 = 0 THEN NULL ELSE x3 / 10 END FROM fronts) GROUP BY block""",
                                                         "fronts"),
          doubles=["mean_sec", "median_sec", "p90_sec", "max_sec"])
def i19_eval_log_analysis(spark, sf):
    return IO.eval_log_analysis(_eval_log(spark, sf))


# ------------------------------------------------------------------ remaining A, B, C, D rows
from ..sources import answers as AN  # noqa: E402

QA_SQL = "WITH qa AS (" + T.SQL["qa"] + ")"


@register("a2_load_random", QA_SQL + """
SELECT row_id, question, model_answer FROM qa
ORDER BY md5('1:' || CAST(row_id AS VARCHAR)), row_id LIMIT 30""")
def a2_load_random(spark, sf):
    """Exactly 30 rows without replacement (the sampling operator: the limit is the feature;
    30 fits the smallest fixture, and more rows than exist is an error, as in the reference)."""
    return IO.load_random(T.qa(spark, sf), 30, seed=1)


SOURCE_SIZES = {"train": 12, "test": 6, "distant01": 3, "distant02": 3}
_QUALITY = "CAST(row_id % 7 AS VARCHAR) AS meteor_evals, CAST(row_id % 11 AS VARCHAR) AS bertscore_f1, '1.5' AS perplexities, '0.5' AS TS09_uq_values, '0.25' AS mcd_uq_value"
_SOURCE_ROWS = {
    "train": "CAST(row_id AS VARCHAR) AS train_questions_id, model_answer AS train_model_answers, question AS train_best_answers, question AS train_questions",
    "test": f"question, model_answer AS test_model_answers, question AS test_best_answers, {_QUALITY}",
    "distant01": f"question, model_answer AS distant_model_answers, question AS distant_true_answers, {_QUALITY}",
    "distant02": f"question, model_answer AS distant_model_answers, question AS distant_true_answers, {_QUALITY}",
}


def _sources_sql():
    parts = []
    for i, (name, rows) in enumerate(_SOURCE_ROWS.items()):
        columns = IO.SOURCE_COLUMNS[name]
        content = "concat_ws('|', " + ", ".join(columns) + ")"
        number = "bertscore_f1::DOUBLE" if name != "train" else "NULL::DOUBLE"
        parts.append(f"""SELECT '{name}' AS source, {columns[0]} AS key, {columns[1]} AS answer, {number} AS bertscore_f1,
       CAST({SOURCE_SIZES[name]} AS BIGINT) AS n_source FROM (SELECT {rows} FROM qa WHERE row_id % 4 = {i}) ORDER BY md5('1:' || {content}), {content} LIMIT {SOURCE_SIZES[name]}""")
    return QA_SQL + "\n" + "\nUNION ALL\n".join(f"(SELECT * FROM ({p}))" for p in parts)


@register("a2_load_random_sources", _sources_sql(), doubles=["bertscore_f1"])
def a2_load_random_sources(spark, sf):
    """Four sources written from the answer table, read back and each cut to its exact number of rows, with the counts that came out."""
    qa, folders = T.qa(spark, sf), {}
    for i, (name, rows) in enumerate(_SOURCE_ROWS.items()):
        folders[name] = IO.scratch_dir(spark, name)
        qa.filter(f"row_id % 4 = {i}").selectExpr(*rows.replace("VARCHAR", "STRING").split(", ")).write.option("header", True).option("sep", "|").option(
            "quote", '"').option("escape", '"').csv(folders[name])
    out = None
    for name, df in IO.load_random_sources(spark, folders, SOURCE_SIZES).items():
        columns = IO.SOURCE_COLUMNS[name]
        part = df.select(F.lit(name).alias("source"), F.col(columns[0]).alias("key"), F.col(columns[1]).alias("answer"),
                         (F.col("bertscore_f1") if name != "train" else F.lit(None).cast("double")).alias("bertscore_f1"))
        out = part if out is None else out.unionByName(part)
    return out.join(out.groupBy("source").agg(F.count(F.lit(1)).alias("n_source")), "source")


@register("a3_read_results", T.with_views("""
SELECT method AS "Method", reduction AS "Dimensionality Reduction", dimensionality AS "Dimensionality",
       layer AS "Layer", pearson_bertscore AS "p_BERTScore_mean", pearson_bertscore AS "pearson_p_BERTScore_mean",
       pearson_meteor AS "p_METEOR_mean", pearson_meteor AS "pearson_p_METEOR_mean" FROM results""", "results"),
          doubles=["p_BERTScore_mean", "pearson_p_BERTScore_mean", "p_METEOR_mean", "pearson_p_METEOR_mean"])
def a3_read_results(spark, sf):
    r = T.results(spark, sf)
    out = r.select(F.col("method").alias("Method"), F.col("reduction").alias("Dimensionality Reduction"),
                   F.col("dimensionality").alias("Dimensionality"), F.col("layer").alias("Layer"),
                   F.col("pearson_bertscore").alias("p_BERTScore_mean"),
                   F.col("pearson_bertscore").alias("pearson_p_BERTScore_mean"),
                   F.col("pearson_meteor").alias("p_METEOR_mean"), F.col("pearson_meteor").alias("pearson_p_METEOR_mean"))
    path = IO.scratch_dir(spark, "results")
    out.write.option("header", True).csv(path)
    return IO.read_results(spark, path)


def _report(spark, sf, which: int, prefix: str):
    """A report table of the repeated evaluation, written as CSV and read back."""
    from ..operators import selective as S
    from .q_eval import h10_summarize_repeats
    table = S.report_tables(h10_summarize_repeats(spark, sf), "events")[which]
    back = spark.read.option("header", True).csv(IO.write_report(table, IO.scratch_dir(spark, "report"), prefix))
    return back.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields])


def _report_twin(which):
    from .q_eval import REPEATS, _summary_sql, full_sql, report_sql
    sums = full_sql(REPEATS, ", " + _summary_sql("res"), by="repeat").replace("\n, long AS", ",\nlong AS")
    return f"WITH sums AS ({sums})\n" + report_sql("sums", "events", which)


def _raw_doubles():
    from .q_eval import RAW_DOUBLES
    return RAW_DOUBLES


@register("a9_report_csv", _report_twin(0))
def a9_report_csv(spark, sf):
    return _report(spark, sf, 0, "main_")


@register("a9_report_calibration_csv", _report_twin(1))
def a9_report_calibration_csv(spark, sf):
    return _report(spark, sf, 1, "calib_")


@register("a9_report_raw_csv", _report_twin(2), doubles=_raw_doubles())
def a9_report_raw_csv(spark, sf):
    return _report(spark, sf, 2, "raw_")


@register("b10_carry_columns", QA_SQL + "\nSELECT row_id, model_answer FROM qa")
def b10_carry_columns(spark, sf):
    return AN.carry_columns(T.qa(spark, sf), "row_id", "model_answer", test=False)


@register("b11_baseline_tables", T.with_views("""
SELECT split, bertscore_f1, rougeL FROM scores""", "scores"), doubles=["bertscore_f1", "rougeL"])
def b11_baseline_tables(spark, sf):
    views = AN.baseline_tables(T.scores(spark, sf), cols=("bertscore_f1", "rougeL"))
    return views["test"].unionByName(views["d01"]).unionByName(views["d02"])


@register("b13_train_text", QA_SQL + """
SELECT row_id, coalesce(question, '') || ' ' || coalesce(model_answer, '') AS train_text FROM qa""")
def b13_train_text(spark, sf):
    q = T.qa(spark, sf)
    return AN.train_text(q, "best_with_question", question_col="question", best_col="model_answer") \
        .select("row_id", "train_text")


@register("c2_quality_columns", T.with_views("""
SELECT row_id, CAST(bertscore_f1 AS DOUBLE) AS bertscore_f1, CAST(rougeL AS DOUBLE) AS rougeL FROM scores""",
                                             "scores"), doubles=["bertscore_f1", "rougeL"])
def c2_quality_columns(spark, sf):
    s = T.scores(spark, sf)
    out = s.select("row_id", F.col("bertscore_f1").cast("double"), F.col("rougeL").cast("double"))
    assert dict(out.dtypes)["bertscore_f1"] == "double" and dict(out.dtypes)["rougeL"] == "double"
    return out


@register("d11_float32_cast", "WITH emb AS (" + T.SQL["emb"] + """)
SELECT row_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS d, CAST(CAST(unnest(v) AS FLOAT) AS DOUBLE) AS value
FROM emb""", doubles=["value"])
def d11_float32_cast(spark, sf):
    from ..operators.reduce import explode_vector
    e = T.emb(spark, sf).select("row_id", F.transform("v", lambda x: x.cast("float")).alias("v32"))
    return explode_vector(e, "v32", ["row_id"]).withColumn("value", F.col("value").cast("double"))
