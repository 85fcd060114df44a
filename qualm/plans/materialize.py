"""Lineage cuts. ``materialize`` writes the frame as parquet into the shared
folder the session names in ``spark.checkpoint.dir`` (set only for local runs
when unset) and reads it back, so later stages read files instead of
recomputing, and a lost executor costs a re-read, not a replay of the whole
lineage. One write job per cut (a reliable RDD checkpoint would compute the
frame twice unless it were also cached)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/qualm-cut/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
