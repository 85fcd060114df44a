"""Operator 8: line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites (sources) it appears on; sketches merge by aggregation, so a
hot line leaves each task as one sketch. Lines whose estimate is near the threshold get exact distinct counts. A line
spread over ``min_sites`` sites is boilerplate: its first occurrence (smallest doc_id, then line number) stays, the
others go. Short lines, of under SHORT_WORDS words and SHORT_CHARS characters, repeat by chance more often and must be on
SHORT_SITES sites (or ``min_sites``, if that is more). Every line with a character that is not white space is counted.

Defined results: null text stays null; empty texts have one empty line, which stays; a null source is a site of its
own; a null doc_id comes after all others. Rows that repeat a document (same doc_id and text) are one document, so all
of them keep its first occurrence. A document that loses all lines keeps its row, with the empty text.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, text_of, unpack, whole_row

MIN_SITES, SHORT_SITES, SHORT_WORDS, SHORT_CHARS, LOG2_REGISTERS, SALTS = 3, 8, 3, 16, 8, 16


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def needed(line: Column, min_sites: int) -> Column:
    """The sites that make a line boilerplate."""
    short = (F.length(line) < SHORT_CHARS) & (F.size(F.split(F.trim(line), r"\s+")) < SHORT_WORDS)
    return F.when(short, max(SHORT_SITES, min_sites)).otherwise(min_sites)


def occurrences(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """(doc, version, line, h1, h2, least, site) of each line that may be boilerplate. Hashes only; two of 64 bits a line."""
    text = text_of("text")
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("version"),
                       F.concat(F.lit("="), F.col(site).cast("string")).alias("site"), F.posexplode(lines(text)).alias("line", "q_text"))
    return (rows.where(F.col("q_text").rlike(r"[^\x20\x09-\x0D]"))
            .select("doc", "version", "line", F.xxhash64("q_text").alias("h1"), F.xxhash64("q_text", F.lit(1)).alias("h2"),
                    needed(F.col("q_text"), min_sites).alias("least"), F.coalesce("site", F.lit("")).alias("site")))


def place() -> Column:
    """Where a line occurs; the smallest is its first occurrence."""
    return F.struct(F.col("doc").isNull().alias("n"), F.col("doc"), F.col("version"), F.col("line"))


def met(seen: DataFrame, found: DataFrame) -> DataFrame:
    """Occurrences of the lines in ``found``, which has each line once: a hot line's occurrences are spread over SALTS tasks."""
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (seen.withColumn("salt", F.pmod(F.xxhash64("doc", "version", "line"), F.lit(SALTS)).cast("int"))
            .join(salted, ["h1", "h2", "salt"]).drop("salt"))


def boilerplate(seen: DataFrame, log2_registers: int = LOG2_REGISTERS) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``least`` distinct sites."""
    error = 3 * 1.04 / math.sqrt(2 ** log2_registers)
    spread = (seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", log2_registers).alias("sketch"), F.min("site").alias("a"), F.max("least").alias("least"),
                                           F.max("site").alias("b"), F.min(place()).alias("first"))
              .where(F.col("a") != F.col("b")).select("h1", "h2", "first", "least", F.hll_sketch_estimate("sketch").alias("sites")))
    spread = cut(spread.where(F.col("sites") >= F.floor(F.col("least") * (1 - error))))
    sure = F.col("sites") > F.ceil(F.col("least") * (1 + error))
    near = spread.where(~sure).select("h1", "h2", "first", F.col("least").alias("need"))
    exact = (met(seen, near).groupBy("h1", "h2", "site").agg(F.min("first").alias("first"), F.max("need").alias("need"))
             .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"), F.min("first").alias("first"), F.max("need").alias("need")).where(F.col("sites") >= F.col("need")))
    return spread.where(sure).select("h1", "h2", "first").union(exact.select("h1", "h2", "first"))


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, version, gone): the line numbers that go, for documents that lose any."""
    seen = cut(occurrences(docs, site, min_sites))
    gone = met(seen, boilerplate(seen)).where(place() != F.col("first"))
    return gone.groupBy("doc", "version").agg(F.collect_set("line").alias("gone"))


def lines_left(all_lines: Column, gone: Column) -> Column:
    """The lines whose numbers are not in ``gone``: the runs between them, in time linear in both."""
    marks = F.concat(F.array(F.lit(-1)), F.array_sort(gone), F.array(F.size(all_lines)))
    runs = lambda z: F.flatten(F.transform(F.sequence(F.lit(1), F.size(z["m"]) - 1),
                                           lambda j: F.slice(z["l"], z["m"][j - 1] + 2, z["m"][j] - z["m"][j - 1] - 1)))
    return F.transform(F.array(F.struct(all_lines.alias("l"), marks.alias("m"))), runs)[0]  # bound once, not for each run


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(q_row, q_text, q_lines, q_gone): each row, its text without boilerplate, its lines and how many of them went."""
    left = docs.select(whole_row(docs).alias("q_row"), F.col("doc_id").alias("q_doc"), F.xxhash64(text_of("text")).alias("q_version"))
    text = F.col("q_row.text")
    found = removals(docs, site, min_sites)
    joined = left.join(found, F.col("q_doc").eqNullSafe(F.col("doc")) & (F.col("q_version") == F.col("version")), "left")
    kept = lines_left(lines(text), F.col("gone"))
    return joined.select("q_row", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("q_text"),
                         F.size(lines(text_of(text))).alias("q_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("q_gone"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents, all columns kept, with boilerplate lines taken out of ``text``."""
    done = without_boilerplate(docs, site, min_sites).withColumn("q_row", F.col("q_row").withField("text", F.col("q_text")))
    return unpack(done, docs.columns)


def line_report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the text that stays."""
    return (without_boilerplate(docs, site, min_sites)
            .select(F.col("q_row.doc_id").alias("doc_id"), F.col("q_lines").cast("long").alias("n_lines"),
                    F.col("q_gone").cast("long").alias("n_removed"), F.md5(text_of("q_text")).alias("kept_md5")))


REPORT_SQL = f"""
WITH l AS (
  SELECT doc_id, text, coalesce('=' || source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
o AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
b AS (SELECT line FROM o GROUP BY line HAVING count(DISTINCT site) >=
      CASE WHEN length(line) < {SHORT_CHARS} AND len(regexp_split_to_array(trim(line, ' '), '\\s+')) < {SHORT_WORDS} THEN {SHORT_SITES} ELSE {MIN_SITES} END),
g AS (SELECT doc_id, n FROM (SELECT o.doc_id, o.n, row_number() OVER (PARTITION BY o.line ORDER BY o.doc_id, o.n) AS k
                             FROM o JOIN b USING (line)) WHERE k > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_removed,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL), '')) AS kept_md5
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id
"""
