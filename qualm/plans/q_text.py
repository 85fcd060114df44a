"""Queries for the text rows B1-B7 and C1 over the ``qa`` view.

The data has no prompt wrappers, so ``wrapped_qa`` adds them by a fixed rule:
row_id % 4 = 0 prefixes a prompt/completion block, 1 repeats the question,
2 wraps the answer as a JSON list, 3 leaves it alone.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.rouge import rouge_l
from ..sources import tables as T
from .catalog import register


def wrapped_qa(spark, sf):
    q = T.qa(spark, sf)
    r = F.col("row_id") % 4
    raw = (F.when(r == 0, F.concat(F.lit("<|begin_of_text|>prompt: "), F.col("question"), F.lit(" completion: "),
                                   F.col("model_answer")))
            .when(r == 1, F.concat(F.col("question"), F.lit(" "), F.col("model_answer")))
            .when(r == 2, F.to_json(F.array(F.col("model_answer"))))
            .otherwise(F.col("model_answer")))
    return q.withColumn("raw", raw)


WRAPPED_SQL = "WITH qa AS (" + T.SQL["qa"] + """
),
w AS (SELECT *, CASE row_id % 4
    WHEN 0 THEN '<|begin_of_text|>prompt: ' || question || ' completion: ' || model_answer
    WHEN 1 THEN question || ' ' || model_answer
    WHEN 2 THEN to_json([model_answer])::VARCHAR
    ELSE model_answer END AS raw FROM qa)"""

WRAP_RE = r"(?i)<\|\s*(begin|end)_of_text\s*\|>"


def _b1_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '^\\s*\\[[\\s\\S]*\\]\\s*$') "
            f"THEN array_to_string(list_filter(from_json({x}, '[\"VARCHAR\"]'), lambda e: e IS NOT NULL), chr(10)) "
            f"ELSE {x} END")


def _b2_sql(x):
    return f"regexp_replace({x}, '{WRAP_RE}', ' ', 'g')"


def _b3_ctes(src: str, col: str, passes: int = 5) -> tuple[str, str]:
    ctes, prev = [], src
    for i in range(passes):
        x = f"regexp_replace({_b2_sql(col)}, '^\\s+', '')"
        step = (f"CASE WHEN NOT regexp_matches({col}, '(?i)^prompt\\s*:') THEN {col} "
                f"WHEN regexp_matches({col}, '(?i)\\bcompletion\\s*:') "
                f"THEN regexp_replace({col}, '(?is)^prompt\\s*:.*?\\bcompletion\\s*:\\s*', '') "
                f"ELSE regexp_replace({col}, '(?i)^prompt\\s*:\\s*[^\\r\\n]*\\r?\\n?', '') END")
        ctes.append(f"p{i}a AS (SELECT * REPLACE ({x} AS {col}) FROM {prev}),\n"
                    f"p{i} AS (SELECT * REPLACE ({step} AS {col}) FROM p{i}a)")
        prev = f"p{i}"
    return ",\n".join(ctes), prev


@register("b1_to_text", WRAPPED_SQL + f"\nSELECT row_id, {_b1_sql('raw')} AS text FROM w")
def b1_to_text(spark, sf):
    return TX.to_text(wrapped_qa(spark, sf), "raw", "text").select("row_id", "text")


@register("b2_strip_wrappers", WRAPPED_SQL + f"\nSELECT row_id, {_b2_sql('raw')} AS text FROM w")
def b2_strip_wrappers(spark, sf):
    return wrapped_qa(spark, sf).select("row_id", TX.strip_wrappers("raw").alias("text"))


_B3_CTES, _B3_LAST = _b3_ctes("w", "raw")


@register("b3_strip_prompt_blocks", WRAPPED_SQL + ",\n" + _B3_CTES + f"\nSELECT row_id, raw AS text FROM {_B3_LAST}")
def b3_strip_prompt_blocks(spark, sf):
    return TX.strip_leading_prompt_blocks(wrapped_qa(spark, sf), "raw", "text").select("row_id", "text")


def _b4_sql():
    ctes, last = _b3_ctes("t1", "raw")
    qn = "trim(regexp_replace(question, '\\s+', ' ', 'g'))"
    return WRAPPED_SQL + f""",
t0 AS (SELECT row_id, question, {_b1_sql('raw')} AS raw FROM w),
t1 AS (SELECT row_id, question, {_b2_sql('raw')} AS raw FROM t0),
{ctes},
t2 AS (SELECT row_id, {qn} AS q, regexp_replace(raw, '(?i)\\bcompletion\\s*:\\s*', '', 'g') AS raw FROM {last}),
t3 AS (SELECT row_id, q, raw, regexp_replace(raw, '^\\s+', '') AS t FROM t2),
t4 AS (SELECT *, regexp_replace(substr(t, 13), '^\\s+', '') AS tm FROM t3),
t5 AS (SELECT row_id, CASE
    WHEN starts_with(lower(t), 'in medicine:') AND lower(substr(tm, 1, length(q))) = lower(q)
      THEN regexp_replace(substr(tm, length(q) + 1), '^\\s+', '')
    WHEN lower(substr(t, 1, length(q))) = lower(q) THEN regexp_replace(substr(t, length(q) + 1), '^\\s+', '')
    ELSE raw END AS x FROM t4)
SELECT row_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS model_answer_cleaned FROM t5"""


@register("b4_normalize_record", _b4_sql())
def b4_normalize_record(spark, sf):
    return TX.normalize_record(wrapped_qa(spark, sf), "question", "raw").select("row_id", "model_answer_cleaned")


@register("b5_truncate_min_length", "WITH qa AS (" + T.SQL["qa"] + """)
SELECT row_id, substr(coalesce(model_answer, ''), 1, least(length(coalesce(model_answer, '')), length(coalesce(question, '')))) AS pred,
       substr(coalesce(question, ''), 1, least(length(coalesce(model_answer, '')), length(coalesce(question, '')))) AS ref
FROM qa""")
def b5_truncate_min_length(spark, sf):
    p, r = TX.truncate_by_min_length("model_answer", "question")
    return T.qa(spark, sf).select("row_id", p.alias("pred"), r.alias("ref"))


@register("b6_concat_question", "WITH qa AS (" + T.SQL["qa"] + """)
SELECT row_id, coalesce(question, '') || ' ' || coalesce(model_answer, '') AS model_answer_question FROM qa""")
def b6_concat_question(spark, sf):
    return T.qa(spark, sf).select("row_id", TX.concat_columns("question", "model_answer").alias("model_answer_question"))


@register("b7_to_text_scalar", "WITH qa AS (" + T.SQL["qa"] + """)
SELECT row_id, coalesce(CASE WHEN row_id % 5 = 0 THEN NULL ELSE question END, '') AS text FROM qa""")
def b7_to_text_scalar(spark, sf):
    q = T.qa(spark, sf)
    return q.select("row_id", TX.to_text_scalar(F.when(F.col("row_id") % 5 != 0, F.col("question"))).alias("text"))


def _tokens_sql(x):
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


# The twin walks the table of the longest common subsequence one prediction token at a time.
_C1_SQL = f"""
WITH RECURSIVE cleaned AS ({_b4_sql()}),
qa0 AS ({T.SQL["qa"]}),
tok AS (SELECT row_id, {_tokens_sql("model_answer_cleaned")} AS tp, {_tokens_sql("question")} AS tr FROM cleaned JOIN qa0 USING (row_id)),
dp AS (
  SELECT row_id, 0 AS i, j, 0 AS v FROM (SELECT row_id, unnest(range(0, len(tr) + 1)) AS j FROM tok)
  UNION ALL
  SELECT row_id, i + 1, j, max(c) OVER (PARTITION BY row_id ORDER BY j)
  FROM (SELECT d.row_id, d.i, d.j, greatest(d.v, CASE WHEN d.j > 0 AND t.tr[d.j] = t.tp[d.i + 1]
               THEN lag(d.v) OVER (PARTITION BY d.row_id ORDER BY d.j) + 1 ELSE 0 END) AS c
        FROM dp d JOIN tok t USING (row_id) WHERE d.i < len(t.tp))),
l AS (SELECT row_id, len(tp) AS np, len(tr) AS nr, v FROM dp JOIN tok USING (row_id) WHERE i = len(tp) AND j = len(tr))
SELECT row_id, CASE WHEN v = 0 THEN 0.0 ELSE 2.0 * (v / np) * (v / nr) / (v / np + v / nr) END AS "rougeL" FROM l"""


@register("c1_rouge_l", _C1_SQL, doubles=["rougeL"])
def c1_rouge_l(spark, sf):
    w = TX.normalize_record(wrapped_qa(spark, sf), "question", "raw")
    return rouge_l(w, "model_answer_cleaned", "question").select("row_id", "rougeL")


@register("c1_rouge_l_stemmed")  # no stemmer in SQL: stems are tested against published examples
def c1_rouge_l_stemmed(spark, sf):
    w = TX.normalize_record(wrapped_qa(spark, sf), "question", "raw")
    return rouge_l(w, "model_answer_cleaned", "question", use_stemmer=True).select("row_id", "rougeL")
