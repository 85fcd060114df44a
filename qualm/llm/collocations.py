"""Operator 13: phrase collocation mining by best-first branch and bound.

Texts become rows of word codes once (``encode``): a word is the 64-bit hash of its bytes seeded by its language, 0 stands
between pieces and for words under ``least`` occurrences, which no candidate can hold. Growth starts from single words. Every
cut score of a phrase x = w1..wk at its first word is 1000 a n / (f(w1) r) with a <= r, so 1000 n / f(w1) bounds all phrases of
the prefix w1: rare first words come first. Each round opens the prefixes of the next range of f(w1), in the languages still open,
and grows them a word at a time; a phrase is counted only if its prefix reached ``least``. A language is settled when its
``top``-th surviving score is above the bound of all prefixes not opened (ties keep it open), or when none is left.

A task reads rows of at most ROW words and emits counts added up by numpy. Hash filters say which prefixes go on: a bitmap of 2**BITS bits
(4 MB at most to the driver and each task, whatever the corpus). A bit that is set by chance lets more phrases be counted, never
fewer, and phrases are counted by their word hashes, so counts stay exact (words of one language would have to share 64 bits).
A candidate is dropped if one word stands before all its occurrences, or after all: such a longer phrase has the same count, and any
longer phrase of equal count holds one of these. Scores are taken in 38 digits.

Defined results: null text is empty; null lang is ``und``; repeated rows count each; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

LEAST, LONGEST, TOP = 100, 5, 2000
BITS, ROW, WORDS_HELD, STEP = 25, 1 << 18, 200_000, 16
PIECES = re.compile(rb"[.,;:!?\x0A-\x0D]+")
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no power of it vanishes

WORDS = "lang string, word string, h long, n long"
CODED = "lang string, words array<long>, codes binary"
GRAMS = "lang string, w array<long>, n long, before long, before_min long, before_max long, after long, after_min long, after_max long"


def words_of(text: str | None) -> list[list[bytes]]:
    """The words of each piece; only ASCII letters are lower-cased and only ASCII white space separates."""
    return [p.split() for p in PIECES.split((text or "").encode("utf-8", "replace").lower())]


def hasher(lang: str):
    """Word hashes of a language: signed, never 0."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    return lambda word: (xxhash.xxh64_intdigest(word, seed) or 1) - (1 << 63) or 1


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[str, str | None]]:
    lang, text = batch.column("lang"), batch.column("text")
    return ((lang[i].as_py(), text[i].as_py()) for i in range(batch.num_rows))


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, h, n of every word; a task holds at most WORDS_HELD distinct words before it passes their counts on."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held = {}

        def passed():
            for lang, counts in held.items():
                hash_of = hasher(lang)
                rows = ((lang, w.decode("utf-8", "replace"), hash_of(w), n) for w, n in counts.items())
                while some := list(islice(rows, 20_000)):
                    yield arrow(some, schema)
            held.clear()

        for b in batches:
            for lang, text in rows_of(b):
                counts = held.setdefault(lang, Counter())
                for piece in words_of(text):
                    counts.update(piece)
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield from passed()
        yield from passed()

    return texts(docs).mapInArrow(run, WORDS).groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class Filter:
    """A bitmap over the high bits of 64-bit hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) >> np.uint64(64 - BITS)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def filter_of(hashes: DataFrame):
    """A broadcast Filter of the column ``key``: bitmaps are joined in the tasks and after them."""
    at = (F.shiftrightunsigned("key", 64 - BITS) + 1).alias("at")  # bitmap functions number positions from 1
    found = (hashes.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())  # at most 2**(BITS - 15) rows of 4 KB
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in found:
        bits[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def encode(docs: DataFrame, kept) -> DataFrame:
    """Rows (lang, words, codes) of at most ROW words and one text: ``codes`` are places in ``words``, whose first is 0, of two bytes each
    unless a row has too many distinct words. Breaks in a row are one break."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("codes", pa.binary())])

    class Codes(dict):
        def __init__(self, lang, bits):
            self.bits = bits
            self.words, self.hash_of, self.text = [0], hasher(lang), []

        def __missing__(self, word):
            h = self.hash_of(word)
            at = (h & (1 << 64) - 1) >> 64 - BITS
            if self.bits[at >> 3] >> (at & 7) & 1:
                self.words.append(h)
                self[word] = len(self.words) - 1
            else:
                self[word] = 0
            return self[word]

    def run(batches):
        bits, held = kept.value.tobytes(), {}

        def row(lang):
            c = held.pop(lang)
            text = np.array(c.text, "<u2" if len(c.words) <= 1 << 16 else "<u4")
            return arrow([(lang, c.words, text[(text != 0) | (np.roll(text, 1) != 0)].tobytes())], schema)

        for b in batches:
            for lang, text in rows_of(b):
                if lang not in held:
                    held[lang] = Codes(lang, bits)
                c = held[lang]
                for piece in words_of(text):
                    c.text += [c[w] for w in piece]
                    c.text.append(0)
                if len(c.text) >= ROW:
                    yield row(lang)
                if sum(len(c.text) for c in held.values()) >= 4 * ROW:  # many languages
                    yield from map(row, list(held))
        yield from map(row, list(held))

    return texts(docs).mapInArrow(run, CODED)


def sliding(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At each place the hash of the k words from there, and whether all of them are words of one piece."""
    n = len(h) - k + 1
    key, good = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        key = key * BASE + h[j:n + j].view(np.uint64)
        good &= h[j:n + j] != 0
    return key, good


def grams(h: np.ndarray, at: np.ndarray, k: int, lang: str) -> list[tuple]:
    """Counts of the k-word phrases at the places ``at``, by their words, with the words before and after them."""
    if not len(at):
        return []
    padded = np.concatenate([[0], h, [0]])
    columns = [h[at + j] for j in range(k)]
    order = np.lexsort(columns[::-1])
    at, columns = at[order], [c[order] for c in columns]
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    out = [np.stack([c[first] for c in columns], axis=1).tolist(), n.tolist()]
    for side in (padded[at], padded[at + k + 1]):
        out += [np.add.reduceat((side != 0).astype(np.int64), first).tolist(), np.minimum.reduceat(side, first).tolist(), np.maximum.reduceat(side, first).tolist()]
    return [(lang, *r) for r in zip(*out)]


def coded_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """lang, the words' hashes and the codes of each row."""
    lang, words, codes = (batch.column(c) for c in ("lang", "words", "codes"))
    for i in range(batch.num_rows):
        known = words[i].values.to_numpy()
        yield lang[i].as_py(), known, np.frombuffer(codes[i].as_buffer(), "<u2" if len(known) <= 1 << 16 else "<u4")


def count_next(coded: DataFrame, k: int, opened, prefixes=None) -> DataFrame:
    """(key, n): counts by hash of the phrases of k + 1 words whose first word ``opened`` holds and whose first k words ``prefixes`` holds."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        first, held = Filter(opened.value), Filter(prefixes.value) if prefixes else None
        for b in batches:
            for _, words, codes in coded_rows(b):
                h = words[codes]
                key, at = starts(h, k, first.has(words)[codes], held)
                at = at[at + k < len(h)]
                at = at[h[at + k] != 0]
                keys, n = np.unique(key[at] * BASE + h[at + k].view(np.uint64), return_counts=True)
                for i in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 200_000].view(np.int64)), pa.array(n[i:i + 200_000])], schema=schema)

    return coded.mapInArrow(run, "key long, n long")


def starts(h: np.ndarray, k: int, first: np.ndarray | None, held: Filter | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k words from each place, and the places where a phrase starts that may count."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, good = sliding(h, k)
    if first is not None:
        good &= first[:len(good)]
    if held:
        good[good] = held.has(key[good])
    return key, np.flatnonzero(good)


def count_exact(coded: DataFrame, sizes: list[int], opened, likely) -> DataFrame:
    """Counts by words of the phrases of ``sizes`` words that ``likely`` holds and, if given, whose first word ``opened`` holds."""
    schema = pa.schema([("lang", pa.string()), ("w", pa.list_(pa.int64()))]
                       + [(c, pa.int64()) for c in ("n", "before", "before_min", "before_max", "after", "after_min", "after_max")])

    def run(batches):
        first, held = Filter(opened.value) if opened else None, Filter(likely.value)
        for b in batches:
            for lang, words, codes in coded_rows(b):
                h = words[codes]
                may = first.has(words)[codes] if first else None
                for k in sizes:
                    found = grams(h, starts(h, k, may, held)[1], k, lang)
                    for i in range(0, len(found), 20_000):
                        yield arrow(found[i:i + 20_000], schema)

    return coded.mapInArrow(run, GRAMS)


def summed(found: DataFrame) -> DataFrame:
    """lang, w, n and whether a longer phrase has the same count."""
    total = found.groupBy("lang", "w").agg(*[F.sum(c).alias(c) for c in ("n", "before", "after")], *[F.min(c).alias(c) for c in ("before_min", "after_min")],
                                           *[F.max(c).alias(c) for c in ("before_max", "after_max")])
    held = lambda side: (F.col(side) == F.col("n")) & (F.col(f"{side}_min") == F.col(f"{side}_max"))
    return total.select("lang", "w", "n", (held("before") | held("after")).alias("held"))


def grow(coded: DataFrame, opened, least: int) -> DataFrame:
    """(lang, w, n, held), written: the phrases of 2 to LONGEST words from opened first words, of ``least`` occurrences or more."""
    found, prefixes = [], None
    for k in range(2, LONGEST + 1):
        likely = count_next(coded, k - 1, opened, prefixes).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        prefixes = filter_of(likely)
        found.append(count_exact(coded, [k], opened, prefixes))
    return cut(summed(reduce(DataFrame.unionByName, found)).where(F.col("n") >= least))


def suffixes(phrases: DataFrame) -> DataFrame:
    """(w, key) of the last 2 to LONGEST - 1 words of longer phrases that are not counted yet."""
    schema = pa.schema([("w", pa.list_(pa.int64())), ("key", pa.int64())])

    def run(batches):
        for b in batches:
            if rows := [(w, int(sliding(np.array(w, np.int64), len(w))[0].view(np.int64)[0])) for w in b.column(0).to_pylist()]:
                yield arrow(rows, schema)

    ends = phrases.select(F.explode(F.expr("transform(sequence(2, size(w)), i -> slice(w, i, size(w) - i + 1))")).alias("w")).where("size(w) > 1").distinct()
    return ends.join(phrases.select("w"), "w", "left_anti").mapInArrow(run, "w array<long>, key long")


def count_suffixes(coded: DataFrame, phrases: DataFrame) -> DataFrame:
    """(w, n) of the suffixes that no opened prefix has counted."""
    wanted = cut(suffixes(phrases))
    found = count_exact(coded, list(range(2, LONGEST)), None, filter_of(wanted))
    return summed(found).select("w", "n").join(wanted.select("w"), "w", "left_semi")


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, w, a, l, r, n, score of the phrases that no longer one holds: the lowest cut, ties to the smallest k."""
    cuts = (phrases.where(~F.col("held") | (F.size("w") == LONGEST)).select("lang", "w", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
            .select("*", F.expr("slice(w, 1, k)").alias("lw"), F.expr("slice(w, k + 1, size(w) - k)").alias("rw")))
    left, right = (counts.select(F.col("w").alias(f"{x}w"), F.col("n").alias(x)) for x in "lr")
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    rows = cuts.join(left, "lw").join(right, "rw").join(totals, "lang").withColumn("score", score.cast("long"))
    best = rows.groupBy("lang", "w").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "w", "b.a", "b.l", "b.r", "b.n", "b.score")


def spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with ``phrase``: the words of ``w``, joined by spaces."""
    each = rows.select("w", F.posexplode("w").alias("i", "h")).join(words.select("h", "word"), "h")
    text = each.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return rows.join(text, "w")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, step: int = STEP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` by score, count and phrase."""
    counted = cut(word_counts(docs))
    totals = cut(counted.groupBy("lang").agg(F.sum("n").alias("n")))  # a row per language
    words = cut(counted.where(F.col("n") >= least))
    coded = cut(encode(docs, filter_of(words.select(F.col("h").alias("key")))))
    singles = words.select(F.array("h").alias("w"), "n")
    still, low, tables, ends, best = totals.select("lang"), least, [], [], None
    while best is None or not still.isEmpty():
        high = low * step
        first = words.where((F.col("n") >= low) & (F.col("n") < high)).join(still, "lang", "left_semi")
        tables.append(grow(coded, filter_of(first.select(F.col("h").alias("key"))), least))
        phrases = reduce(DataFrame.unionByName, tables).dropDuplicates(["w"])
        known = reduce(DataFrame.unionByName, [phrases.select("w", "n"), *ends])
        ends.append(cut(count_suffixes(coded, known)))
        counts = reduce(DataFrame.unionByName, [singles, known, ends[-1]]).dropDuplicates(["w"])
        ranked = scored(phrases, counts, totals).withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))))
        best = cut(ranked.where(F.col("place") <= top))
        settled = best.groupBy("lang").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("last"))
        left = words.where(F.col("n") >= high).groupBy("lang").agg(F.min("n").alias("rarest")).join(totals, "lang").join(settled, "lang", "left")
        bound = F.expr("cast(1000 as decimal(38,0)) * cast(n as decimal(38,0)) div cast(rarest as decimal(38,0))")
        still = cut(left.where(F.col("found").isNull() | (F.col("found") < top) | (F.col("last") <= bound)).select("lang"))
        low = high
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (spelled(best, words).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


COLLOCATIONS_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM s),
f AS (SELECT lang, ws[i:i + k - 1] AS w, k, count(*) AS a FROM i, (SELECT unnest(range(1, {LONGEST} + 1)) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
inside AS (
  SELECT lang, w[x:x + m - 1] AS w, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k + 1)) AS x FROM c), (SELECT unnest(range(2, {LONGEST})) AS m)
  WHERE m < k AND x + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, w) WHERE longer IS NULL OR longer < a),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
scores AS (
  SELECT q.lang, q.w, q.j, q.a, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * q.a * n.n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts q JOIN f l ON l.lang = q.lang AND l.w = q.w[1:q.j] JOIN f r ON r.lang = q.lang AND r.w = q.w[q.j + 1:q.k] JOIN n ON n.lang = q.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {TOP}
"""
