"""Operator 3: SimHash fingerprints, in DataFrame functions only.

Terms are the five-word shingles of a text (a shorter text: all its words as one), weighted by how often they occur.
Each occurrence votes with its 64-bit hash: two bits a counter, so 32 sums make the votes; a bit is set if more than
half of the weight has it. Near fingerprints are found by permuted block tables: the 64 bits are cut into BLOCKS
blocks, and each choice of BLOCKS - radius of them, moved to the front, keys one table; two fingerprints within the
radius agree on at least one key. Only distinct fingerprints enter the tables, and only pairs within the radius leave
the join, so copies make no pairs.

Defined results: null texts are empty; texts without words have the fingerprint 0; a tied bit is 0. Rows are ordered by
descending doc_id, null last, equal ids by the text's hash; a lone document is its own next one. Rows that repeat a
document follow each other and have the same fingerprint.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, partitions, text_of

WORDS, RADIUS, BLOCKS = 5, 3, 6
OWN, GHOST, WRAP = 0, 1, 2


def padded_words(text: Column, size: int = WORDS) -> Column:
    """The lower-case words of a text; a short text is padded to ``size``, a wordless one is empty."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w).between(1, size - 1), F.concat(w, F.array_repeat(F.lit(""), size - F.size(w))))
                       .otherwise(w))[0]


def terms(words: Column, size: int = WORDS) -> Column:
    """An array of structs of ``size`` consecutive words, from a column of padded words: one that is computed already, as it is
    read ``size`` times."""
    n = F.greatest(F.lit(0), F.size(words) - size + 1)
    return F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(size)])


def term_hash(term: Column, size: int = WORDS) -> Column:
    return F.when(term.isNotNull(), F.xxhash64(*[term.getField(f"w{i}") for i in range(size)]))


def votes(h: Column) -> list[Column]:
    """32 sums, each of bit s in its low half and bit s + 32 in its high half."""
    return [F.sum(F.shiftrightunsigned(h, s).bitwiseAND(F.lit(0x0000000100000001))).alias(f"v{s}") for s in range(32)]


def decided(total: Column) -> Column:
    """The fingerprint of the 32 sums and the number of votes."""
    bits = []
    for s in range(32):
        v = F.col(f"v{s}")
        bits += [F.when(2 * v.bitwiseAND(F.lit(0xFFFFFFFF)) > total, F.shiftleft(F.lit(1).cast("long"), s)).otherwise(F.lit(0).cast("long")),
                 F.when(2 * F.shiftrightunsigned(v, 32) > total, F.shiftleft(F.lit(1).cast("long"), s + 32)).otherwise(F.lit(0).cast("long"))]
    while len(bits) > 1:  # a balanced tree keeps the expression shallow
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def ordered(docs: DataFrame) -> DataFrame:
    """(bucket, pos, kind, doc_id, text) in descending doc_id within buckets of ids; each bucket ends with copies of the row that
    follows it, so that a row's next one is in its bucket. Bucket edges are ids of the table, as many as tasks."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    n = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("e"), F.max("doc_id").alias("top")).first()
    edges, top = sorted(set(cuts["e"] or [])), cuts["top"]
    step = max(1, int(len(edges) ** 0.5))
    own = F.lit(0)
    if edges:  # number of edges below the id, found in two steps
        d, whole = F.col("doc_id"), F.array(*[F.lit(e) for e in edges])
        coarse = F.size(F.filter(F.array(*[F.lit(e) for e in edges[::step]]), lambda e: e < d))
        start = F.greatest(coarse - 1, F.lit(0)) * step
        fine = start + F.size(F.filter(F.slice(whole, start + 1, F.lit(step)), lambda e: e < d))
        own = F.when(d.isNull(), F.lit(0)).otherwise(fine)
        ghost = F.when(F.array_contains(whole, d), F.array(F.struct((own + 1).alias("bucket"), F.lit(GHOST).alias("kind"))))
        wrap = F.when(d == F.lit(top), F.array(F.struct(F.lit(0).alias("bucket"), F.lit(WRAP).alias("kind"))))
        none = F.array().cast("array<struct<bucket:int,kind:int>>")
        at = F.concat(F.array(F.struct(own.alias("bucket"), F.lit(OWN).alias("kind"))), F.coalesce(ghost, none), F.coalesce(wrap, none))
    else:
        at = F.array(F.struct(own.alias("bucket"), F.lit(OWN).alias("kind")))
    rows = rows.select("doc_id", "text", F.inline(at))
    order = Window.partitionBy("bucket").orderBy(F.col("kind") == WRAP, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "kind")
    return rows.select("bucket", "kind", "doc_id", "text", F.row_number().over(order).alias("pos"),
                       F.coalesce(F.lead("text").over(order), F.first("text").over(order)).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, f, edited_f, next_f: fingerprints of each text, its edited text and the next text."""
    rows = ordered(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"),
                      F.expr("substring(next_text, 1, cast(floor(n_chars / 2) as int))"))
    rows = rows.withColumn("edited", F.when(F.col("kind") == OWN, F.when(half > 0, edited).otherwise(F.col("text"))))
    key = ["bucket", "pos", "kind", "doc_id", "n_chars", "edited_sha256", "which"]
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    exploded = (rows.select("bucket", "pos", "kind", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.inline(texts))
                .where(F.col("t").isNotNull()).select(*key, padded_words(F.col("t")).alias("words"))
                .select(*key, F.explode_outer(terms(F.col("words"))).alias("w")).select(*key, term_hash(F.col("w")).alias("h")))
    # rows are already dealt by bucket: neither the sums nor the windows below shuffle again
    summed = exploded.groupBy(*key).agg(*votes(F.col("h")), F.count("h").alias("total"))
    marked = summed.select(*key, decided(F.col("total")).alias("f"))
    order = Window.partitionBy("bucket").orderBy("pos", "which")
    # a row's own fingerprint (which 0) is followed by its edited one (1); the next row's own one precedes that row's
    paired = marked.select("*", F.lead("f", 1).over(order).alias("edited_f"), F.lead("f", 2).over(order).alias("third"),
                           F.first("f").over(order).alias("first_f"))
    return (paired.where((F.col("which") == 0) & (F.col("kind") == OWN))
            .select("doc_id", "n_chars", "edited_sha256", "f", "edited_f", F.coalesce("third", "first_f").alias("next_f")))


def near_pairs(fingerprint: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b) distinct fingerprints, a < b, within ``radius`` bits, from distinct values in column f."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    tables = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(tables)])
    filed = fingerprint.select("f", F.inline(keys))
    a, b = (filed.select(F.col("f").alias(x), F.col("t").alias(f"{x}_t"), F.col("key").alias(f"{x}_key")) for x in "ab")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    same = (F.col("a_t") == F.col("b_t")) & (F.col("a_key") == F.col("b_key"))
    # a pair that agrees in several tables is taken from the first of them
    earlier = reduce(lambda x, y: x | y, [(F.lit(t) < F.col("a_t")) & (F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(signed(m))) == 0)
                                           for t, m in enumerate(tables)])
    return a.join(b, same & (F.col("a") < F.col("b")) & close & ~earlier).select("a", "b")


def fingerprint_report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and near_docs: documents with
    another fingerprint within the radius."""
    done = cut(fingerprints(docs))
    copies = done.groupBy("f").agg(F.count(F.lit(1)).alias("copies"))
    pairs = near_pairs(copies.select("f"), radius)
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(copies, F.col("b") == F.col("f")).groupBy("a").agg(F.sum("copies").alias("near_docs"))
    return (done.join(near, F.col("f") == F.col("a"), "left")
            .select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("f")).alias("fingerprint"),
                    as_hex(F.col("edited_f")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("edited_f")).alias("near_edited"),
                    likeness(F.col("f"), F.col("next_f")).alias("near_next"), F.coalesce("near_docs", F.lit(0).cast("long")).alias("near_docs")))
