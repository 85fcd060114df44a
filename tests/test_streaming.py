"""The streaming log job agrees with the batch analysis on the same appended files."""
from qualm.plans.q_io import _eval_log_rows
from qualm.sources import io as IO
from qualm.streaming.progress_stream import run_available
from tests.conftest import SMALL


def test_stream_matches_batch(spark):
    path = IO.scratch_dir(spark, "evallog-stream")
    rows = _eval_log_rows(spark, SMALL)
    IO.append_eval_log(rows, path)
    IO.append_eval_log(rows, path)  # a second append: the stream sees both
    got = {r["block"]: (r["n"], r["n_non_numeric"]) for r in run_available(spark, path, "evlog_t").collect()}
    exp = {r["block"]: (r["n"], r["n_non_numeric"])
           for r in IO.eval_log_analysis(IO.read_eval_log(spark, path)).collect()}
    assert got == exp and len(got) == 3
