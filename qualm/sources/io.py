"""Sources and sinks (A1-A9) with explicit schemas.

Scratch output goes under the session's shared ``spark.checkpoint.dir`` so
files written by one task are visible to all executors.
"""
from __future__ import annotations

import csv
import re
import uuid
from functools import reduce
from io import StringIO
from typing import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

CORRUPT = "_corrupt_record"
X_WIDTH = 6


def scratch_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/qualm-io/{name}-{uuid.uuid4().hex[:12]}"


# -- A1 / A2 / A3 ------------------------------------------------------------------
def files_by_header(spark: SparkSession, folder: str, sep: str) -> dict[tuple[str, ...], list[str]]:
    """The ``*.csv`` files of a folder by the names in their first line that is not blank. Files are listed and read in tasks; a line
    a file reaches the driver. A file of blank lines only has no header and no rows."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder).select(
        "value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), F.col("_metadata.file_path").alias("file"))
    first = lines.where(F.col("value").rlike("\\S")).groupBy("file").agg(F.min_by("value", "at").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in first.orderBy("file").toLocalIterator():
        header = tuple(next(csv.reader([r.line.removeprefix("\ufeff").rstrip("\r")], delimiter=sep)))
        found.setdefault(header, []).append(r.file)
    return found


def is_header(header: Sequence[str]) -> Column:
    """Whether a row holds the names of its columns. Headers are read as rows, since blank lines may stand before them."""
    same = [(F.when(F.lit(i == 0), F.regexp_replace(f"_c{i}", "^\ufeff", "")).otherwise(F.col(f"_c{i}"))).eqNullSafe(F.lit(h or None)) for i, h in enumerate(header)]
    return reduce(lambda a, b: a & b, same)


def _longer_than_header(sep: str):
    @F.pandas_udf("boolean")
    def longer(record: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([len(next(csv.reader(StringIO(r), delimiter=sep), [])) > n for r, n in zip(record, width)], dtype=bool)
    return longer


def read_delimited_dir(spark: SparkSession, folder: str, columns: Sequence[str], sep: str = "|"):
    """A1: every ``*.csv`` in a folder, listed columns found by the names in each file's header, files concatenated.

    Blank lines are left out, also before the header. Short rows are padded with nulls. A file with a row of more fields than its header is skipped as a whole (as the
    reference skips a file that fails to parse); a file without one of the columns is an error. Returns (rows,
    skipped files)."""
    from ..plans.materialize import materialize
    raw = None
    for header, files in files_by_header(spark, folder, sep).items():
        if missing := [c for c in columns if c not in header]:
            raise ValueError(f"{files[0]} misses columns {missing}")
        full = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))]
                            + [T.StructField(CORRUPT, T.StringType())])
        # without column pruning, so that the width of a row is seen
        part = (spark.read.schema(full).option("sep", sep).option("header", False).option("multiLine", True)
                .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnPruning", False)
                .option("columnNameOfCorruptRecord", CORRUPT).csv(files)
                .where(~is_header(header) & ~(F.col(CORRUPT).isNotNull() & ~F.col(CORRUPT).rlike("\\S")))
                .select(*[F.col(f"_c{header.index(c)}").alias(c) for c in columns], CORRUPT,
                        F.lit(len(header)).alias("_width"), F.col("_metadata.file_path").alias("_file")))
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        raise ValueError(f"no csv files in {folder}")
    # Spark refuses to query the corrupt-record column alone on a raw scan:
    # parse once into a checkpoint, then split good and bad files from it.
    raw = materialize(raw)
    odd = raw.filter(F.col(CORRUPT).isNotNull()).select("_file", _longer_than_header(sep)(CORRUPT, "_width").alias("longer"))
    bad = odd.filter("longer").select("_file").distinct()
    good = raw.join(bad, "_file", "left_anti").select(*columns)
    return good, bad


def load_random(df: DataFrame, n: int, seed: int = 1, id_col: str = "row_id") -> DataFrame:
    """A2: exactly n rows without replacement (n smallest md5(seed:id)); error if n > rows."""
    from ..operators.order import pick_first_n
    total = df.count()
    if n > total:
        raise ValueError(f"cannot take {n} rows from {total}")
    return pick_first_n(df.withColumn("_n_rows", F.lit(n)), "_n_rows", seed, id_col=id_col, out_col="_pick") \
        .filter("_pick").drop("_pick", "_n_rows")


#: The sources of an experiment, each with the columns that its files hold.
SOURCE_COLUMNS = {
    "train": ("train_questions_id", "train_model_answers", "train_best_answers", "train_questions"),
    "test": ("question", "test_model_answers", "test_best_answers", "meteor_evals", "bertscore_f1", "perplexities", "TS09_uq_values", "mcd_uq_value"),
    "distant01": ("question", "distant_model_answers", "distant_true_answers", "meteor_evals", "bertscore_f1", "perplexities", "TS09_uq_values", "mcd_uq_value"),
    "distant02": ("question", "distant_model_answers", "distant_true_answers", "meteor_evals", "bertscore_f1", "perplexities", "TS09_uq_values", "mcd_uq_value"),
}
NUMBERS = ("meteor_evals", "bertscore_f1", "perplexities", "TS09_uq_values", "mcd_uq_value")


def load_random_sources(spark: SparkSession, folders: Mapping[str, str], sizes: Mapping[str, int], columns: Mapping[str, Sequence[str]] = SOURCE_COLUMNS,
                        seed: int = 1, sep: str = "|") -> dict[str, DataFrame]:
    """A2: every source read from its folder (A1) and cut to exactly its number of rows, without replacement; a source of fewer rows is an error.

    Files carry no row number, so a row is known by its content: the pick takes the smallest md5(seed:content), where content is
    the listed columns joined by ``|``, and equal rows are interchangeable. Quality columns are numbers."""
    from ..plans.materialize import materialize
    out = {}
    for name, folder in folders.items():
        rows, _ = read_delimited_dir(spark, folder, columns[name], sep)
        rows = materialize(rows.withColumn("_content", F.concat_ws("|", *columns[name])))
        picked = load_random(rows, sizes[name], seed, id_col="_content").drop("_content")
        out[name] = picked.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in NUMBERS else F.col(c) for c in columns[name]])
    return out


RESULTS_SCHEMA = T.StructType([
    T.StructField("Method", T.StringType()), T.StructField("Dimensionality Reduction", T.StringType()),
    T.StructField("Dimensionality", T.LongType()), T.StructField("Layer", T.LongType()),
    T.StructField("p_BERTScore_mean", T.DoubleType()), T.StructField("pearson_p_BERTScore_mean", T.DoubleType()),
    T.StructField("p_METEOR_mean", T.DoubleType()), T.StructField("pearson_p_METEOR_mean", T.DoubleType())])


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULTS_SCHEMA) -> DataFrame:
    """A3: experiment results CSV, columns found by the names in its header, whatever their order."""
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"results miss columns {missing}")
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields])


# -- A4 / A5 -----------------------------------------------------------------------
def write_fronts(df: DataFrame, path: str) -> None:
    """A5: one folder per (seed, generation) holding that generation's rows."""
    df.write.mode("append").partitionBy("seed", "gen").parquet(path)


def read_fronts(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A4: all generations, seed and gen from the folder names.

    With ``check``, rows pass once through a written table whose scan observes them: both objectives must be there (a point is
    two numbers), a decision vector must be whole, and either every point or none has one. Raises ValueError otherwise. Columns
    x0 to x5 that no file has stay absent."""
    raw = spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)
    if not check:
        return raw
    if missing := [c for c in ("f1", "f2") if c not in raw.columns]:
        raise ValueError(f"fronts miss {missing}: a point is two objectives")
    xs = [c for c in raw.columns if re.fullmatch(r"x\d+", c)]
    if xs and (missing := [f"x{i}" for i in range(X_WIDTH) if f"x{i}" not in xs]):
        raise ValueError(f"decision vectors miss {missing}")
    there = [F.col(c).isNotNull() for c in xs] or [F.lit(False)]
    whole, some = reduce(lambda a, b: a & b, there), reduce(lambda a, b: a | b, there)
    seen = Observation(f"fronts-{uuid.uuid4().hex[:8]}")
    from ..plans.materialize import materialize
    rows = materialize(raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("f1").isNull() | F.col("f2").isNull()).alias("shape"),
                                   F.count_if(some & ~whole).alias("part"), F.count_if(whole).alias("whole")))
    found = seen.get
    if found["shape"]:
        raise ValueError(f"{found['shape']} points have fewer than two objectives")
    if found["part"]:
        raise ValueError(f"{found['part']} decision vectors are not whole")
    if found["whole"] not in (0, found["rows"]):
        raise ValueError(f"{found['whole']} of {found['rows']} points have decision vectors; all or none must")
    return rows


# -- A6 --------------------------------------------------------------------------------
PROGRESS_COLS = ["gen", "best_obj_bert", "best_obj_rouge", "best_combined", "mean_obj_bert", "mean_obj_rouge",
                 "mean_combined", "hv", "hv_smooth", "hv_best_smooth", "hv_rel_improve", "earlystop_no_improve", "stopped"]


def write_progress(df: DataFrame, path: str) -> None:
    """A6 append: rows of another width, with columns missing or left over, are rejected before writing. The
    generation that stopped its run is marked."""
    known = ["seed", *PROGRESS_COLS]
    missing, extra = [c for c in known if c not in df.columns], [c for c in df.columns if c not in known]
    if missing or extra:
        raise ValueError(f"progress rows miss columns {missing} or have more: {extra}")
    df.select("seed", *PROGRESS_COLS).write.mode("append").option("header", True).csv(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A6 read: text columns, numeric coercion by try_cast, rows without gen dropped."""
    raw = spark.read.option("header", True).csv(path)
    out = raw.select(F.expr("try_cast(seed AS BIGINT)").alias("seed"),
                     F.expr("try_cast(gen AS BIGINT)").alias("gen"),
                     *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in PROGRESS_COLS[1:-1]],
                     F.expr("try_cast(stopped AS BOOLEAN)").alias("stopped"))
    return out.filter(F.col("gen").isNotNull())


# -- A7 / A8 / A9 ---------------------------------------------------------------------
EVAL_LOG_SCHEMA = T.StructType([
    T.StructField("eval_id", T.LongType()), T.StructField("F", T.ArrayType(T.DoubleType())),
    T.StructField("corr_bundle", T.StructType([T.StructField("all", T.StructType([
        T.StructField("bert", T.DoubleType()), T.StructField("rouge", T.DoubleType())]))])),
    T.StructField("timings_s", T.MapType(T.StringType(), T.StringType())),
    T.StructField("hdb_params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("emb_params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("reduction_method", T.StringType()), T.StructField("ts", T.DoubleType())])

#: The fields of the best-solution document, all of them required.
BEST_FIELDS = ["generation", "x_star", "F", "obj_bert", "obj_rouge", "combined_mean", "corr_details", "hdb_params",
               "embedding_params", "reduction_method", "timings_s"]


def append_eval_log(df: DataFrame, path: str) -> None:
    """One JSON object per evaluated candidate, with a write timestamp."""
    df.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def read_eval_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_LOG_SCHEMA).json(path)


def write_best_solution(df: DataFrame, path: str) -> None:
    """The current best candidate as a one-row JSON document; more than one row is an error, as is a missing field."""
    missing = [c for c in BEST_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"the best solution misses {missing}")
    if len(df.take(2)) > 1:
        raise ValueError("the best solution is one row")
    df.coalesce(1).write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, prefix: str = "") -> str:
    """A report table as CSV with a header, sorted by model and scheme."""
    out = f"{path.rstrip('/')}/{prefix}table"
    df.orderBy("Model", "Scheme").write.mode("overwrite").option("header", True).csv(out)
    return out


def eval_log_analysis(log: DataFrame) -> DataFrame:
    """Per timing block: entries, non-numeric entries, mean, median, p90, max."""
    t = log.select(F.explode("timings_s").alias("block", "raw"))
    t = t.withColumn("sec", F.expr("try_cast(raw AS DOUBLE)"))
    from ..operators.quantile import exact_quantiles
    from ..plans.materialize import materialize
    t = materialize(t.drop("raw"))
    sums = t.groupBy("block").agg(
        F.count("*").alias("n"), F.count_if(F.col("sec").isNull()).cast("bigint").alias("n_non_numeric"),
        F.avg("sec").alias("mean_sec"), F.max("sec").alias("max_sec"))
    asked = t.sparkSession.createDataFrame([("median_sec", 0.5), ("p90_sec", 0.9)], "stat string, q double")
    at = exact_quantiles(t, "sec", asked, ["block"]).groupBy("block").agg(
        *[F.max(F.when(F.col("stat") == c, F.col("value"))).alias(c) for c in ("median_sec", "p90_sec")])
    return sums.join(at, "block", "left").select("block", "n", "n_non_numeric", "mean_sec", "median_sec", "p90_sec", "max_sec")
