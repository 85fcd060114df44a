"""Answer-text cleaning as column expressions.

Everything is a native Spark expression except the Python-literal fallback of
B1, which only the rows that look like a list and fail JSON parsing take.
"""
from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed patterns (same meaning as the cleaning rules they mirror).
LIST_LIKE = r"^\s*\[[\s\S]*\]\s*$"
WRAPPER = r"(?i)<\|\s*(begin|end)_of_text\s*\|>"
# One pass in one pattern: a leading "prompt:" block through the first
# "completion:" if there is one, else the prompt line. The first alternative
# matches exactly when "completion:" occurs, so the alternation is the branch.
PROMPT_PASS = r"(?i)^prompt\s*:(?:(?s:.*?)\bcompletion\s*:\s*|\s*[^\r\n]*\r?\n?)"
COMPLETION_LABEL = r"(?i)\bcompletion\s*:\s*"
MEDICINE_PREFIX = "in medicine:"
MAX_PROMPT_PASSES = 5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lstrip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"^(?U)\s+", "")


def clean_whitespace(c) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _python_list_join(s: pd.Series) -> pd.Series:
    """Lists with items other than texts, spelled as Python prints them; null where nothing is asked."""
    def one(t):
        for read in (json.loads, ast.literal_eval):
            try:
                items = read(t.strip())
            except Exception:  # any text may stand here: what neither reads stays as it is
                continue
            if isinstance(items, list):
                return "\n".join(map(str, filter(lambda x: x is not None, items)))
        return t
    return s.map(lambda t: None if t is None else one(t))


def to_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """B1: NULL -> ''; a list-looking string is parsed (JSON first, then a Python
    literal) and its non-null items joined by newlines; anything else unchanged.
    An array column is joined directly. JSON lists of texts and nulls are joined
    by expressions; only other lists reach the Python kernel, in the same pass."""
    out = out or col
    dt = df.schema[col].dataType.simpleString()
    c = F.col(col)
    if dt.startswith("array"):
        items = F.filter(c, lambda x: x.isNotNull()).cast("array<string>")
        if dt == "array<boolean>":
            items = F.transform(items, F.initcap)
        return df.withColumn(out, F.coalesce(F.array_join(items, "\n"), F.lit("")))
    looks = c.rlike(LIST_LIKE)
    base = df.withColumn("_items", F.when(looks, F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")))
    texts = F.forall("_items", lambda x: F.schema_of_variant(x).isin("STRING", "VOID"))
    base = base.withColumn("_texts", F.when(F.coalesce(texts, F.lit(False)), F.transform(
        "_items", lambda x: F.try_variant_get(x, "$", "string")))).drop("_items")
    base = base.withColumn("_py", _python_list_join(F.when(looks & F.col("_texts").isNull(), c)))
    return base.withColumn(out, F.when(c.isNull(), F.lit("")).when(~looks, c)
                           .otherwise(F.coalesce(F.array_join("_texts", "\n"), "_py"))).drop("_texts", "_py")


def strip_wrappers(c) -> Column:
    """B2: begin/end-of-text markers -> space, any case."""
    return F.regexp_replace(_c(c), WRAPPER, " ")


def _prompt_pass(out: Column) -> Column:
    # references the text once, so unrolled passes stay linear in plan size
    return F.regexp_replace(out, PROMPT_PASS, "")


def strip_leading_prompt_blocks(df: DataFrame, col: str, out: str | None = None,
                                max_passes: int = MAX_PROMPT_PASSES) -> DataFrame:
    """Up to N passes of (strip wrappers, left-trim, drop a leading
    'prompt: ... completion:' block or, lacking 'completion:', the prompt line).
    Passes after the first non-prompt text change nothing, so unrolling is exact.
    Each pass is its own projection so the expression never nests N deep."""
    out = out or col
    d = df.withColumn(out, F.col(col))
    for _ in range(max_passes):
        d = d.withColumn(out, lstrip_ws(strip_wrappers(F.col(out))))
        d = d.withColumn(out, _prompt_pass(F.col(out)))
    return d


def drop_question_prefix(ans: Column, question: Column) -> Column:
    """Remove the (whitespace-cleaned) question once from the start of the answer,
    case-insensitively, optionally after 'in medicine:'; then following whitespace."""
    q = clean_whitespace(question)
    t = lstrip_ws(ans)
    ql = F.length(q)
    med = F.lower(t).startswith(MEDICINE_PREFIX)
    t_after_med = lstrip_ws(t.substr(F.lit(len(MEDICINE_PREFIX) + 1), F.length(t)))
    starts = lambda s: F.lower(s.substr(F.lit(1), ql)) == F.lower(q)
    rest = lambda s: lstrip_ws(s.substr(ql + 1, F.length(s)))
    return (F.when(med & starts(t_after_med), rest(t_after_med))
             .when(starts(t), rest(t))
             .otherwise(ans))


def normalize_record(df: DataFrame, question: str, answer: str, out: str = "model_answer_cleaned") -> DataFrame:
    """B1, B2, B3, drop leftover 'completion:' labels, drop a repeated
    question at the start, collapse whitespace."""
    d = to_text(df, answer, "_ma")
    d = d.withColumn("_ma", strip_wrappers(F.col("_ma")))
    d = strip_leading_prompt_blocks(d, "_ma")
    d = d.withColumn("_ma", F.regexp_replace(F.col("_ma"), COMPLETION_LABEL, ""))
    d = d.withColumn("_ma", drop_question_prefix(F.col("_ma"),
                                                 F.coalesce(F.col(question).cast("string"), F.lit("None"))))
    return d.withColumn(out, clean_whitespace(F.col("_ma"))).drop("_ma")


def truncate_by_min_length(pred, ref) -> tuple[Column, Column]:
    """Cut both texts to the shorter length (NULL -> '')."""
    p, r = F.coalesce(_c(pred), F.lit("")), F.coalesce(_c(ref), F.lit(""))
    n = F.least(F.length(p), F.length(r))
    return p.substr(F.lit(1), n), r.substr(F.lit(1), n)


def concat_columns(c1, c2, sep: str = " ") -> Column:
    """Row-wise join of two text columns."""
    return F.concat(F.coalesce(_c(c1).cast("string"), F.lit("")), F.lit(sep),
                    F.coalesce(_c(c2).cast("string"), F.lit("")))


def to_text_scalar(c) -> Column:
    """NULL or NaN -> '', else the value as text."""
    x = _c(c)
    return F.coalesce(x.cast("string"), F.lit(""))


def to_text_double(c) -> Column:
    x = _c(c)
    return F.when(x.isNull() | F.isnan(x), F.lit("")).otherwise(x.cast("string"))
