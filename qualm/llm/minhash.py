"""Operator 9: near-duplicates by b-bit MinHash.

A text is lower-cased in A-Z and cut into words at ASCII white space; its set holds the hashes of its distinct word
shingles (a shorter text: its whole word sequence as one). Texts of equal word sequence are one class, and one of each
class goes on. ``PERMUTATIONS`` minima are cut into bands; texts that share a band are candidates, gathered into
groups by stars around the least of each bucket, never as pairs. Within a group, the low ``BITS`` bits of the minima,
packed into words, give a similarity by bit counts, corrected for chance collisions; what is near the threshold or
above is confirmed on the full sets. A group too large for one task is dealt into blocks, and each pair of blocks
meets in one task, so every link is tested whatever the group's size, while only a spanning forest of links leaves a
task.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing. Rows that share a
doc_id count as one document. A null doc_id takes part, but cannot name a component: its component_id is the
smallest doc_id reached, or null. doc_id is below 2^62. Ties cannot arise: a component is named by its minimum.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, text_of, unpack, whole_row
from .components import components

PERMUTATIONS, BITS, MISSED = 192, 4, 1e-6
PIECE_BYTES, BLOCK_DOCS, BLOCK_BYTES = 1 << 20, 2048, 8 << 20
NAMELESS = 1 << 62

U = np.uint64
_rng = np.random.default_rng(20)
BYTE_CODE = _rng.integers(1, 2 ** 64, 256, dtype=U) | U(1)
MULTIPLIER, OFFSET = (_rng.integers(0, 2 ** 64, PERMUTATIONS, dtype=U)[:, None] for _ in range(2))
MULTIPLIER |= U(1)
BASE, POSITION = U(0x9E3779B97F4A7C15), _rng.integers(0, 2 ** 64, 64, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of one piece: polynomial over byte codes, mixed."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=U)
    length = ends - starts
    at = np.arange(len(raw)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    power = np.full(int(length.max()) + 1, BASE, dtype=U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = BYTE_CODE[LOWER[raw]] * power[np.minimum(at, len(power) - 1)]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts) + length.astype(U))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words, in pieces of bounded size cut at white space."""
    if len(text) <= PIECE_BYTES:
        return _words(text)
    found, at = [], 0
    while at < len(text):
        end = min(at + PIECE_BYTES, len(text))
        while end < len(text) and IS_WORD[text[end]]:
            end += 1
        found.append(_words(text[at:end]))
        at = end
    return np.concatenate(found)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a word sequence."""
    n = len(words)
    if not n:
        return words
    if n < size:
        with np.errstate(over="ignore"):
            return mix(np.array([sequence_hash(words)[0] + U(n)], dtype=U))
    total = np.zeros(n - size + 1, dtype=U)
    for i in range(size):
        total += words[i:n - size + 1 + i] * POSITION[i % 64]
    return np.unique(mix(total))


def sequence_hash(words: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a word sequence, as two numbers."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(words) + 1, dtype=U) * BASE)
        return mix(np.array([(words * (place | U(1))).sum(dtype=U)]))[0], (mix(words ^ place)).sum(dtype=U)


def minima(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of 32 bits."""
    least = np.full(PERMUTATIONS, np.uint32(0xFFFFFFFF), dtype=U)
    for at in range(0, len(hashes), 4096):
        values = MULTIPLIER * hashes[None, at:at + 4096]
        values += OFFSET
        least = np.minimum(least, values.min(axis=1) >> U(32))
    return least


def rows_per_band(threshold: float) -> int:
    """The most rows for which a link at the threshold misses every band with probability below MISSED."""
    return max(r for r in range(1, PERMUTATIONS + 1) if r == 1 or (1 - threshold ** r) ** (PERMUTATIONS // r) < MISSED)


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    bands = PERMUTATIONS // rows
    m = least[:bands * rows].reshape(bands, rows) * POSITION[None, :rows]
    return mix(m.sum(axis=1, dtype=U) + mix(np.arange(1, bands + 1, dtype=U)))


def packed(least: np.ndarray) -> bytes:
    """The low BITS bits of the minima, 64 // BITS to a word."""
    low = (least & U((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=U) * U(BITS))).sum(axis=1, dtype=U).astype("<u8").tobytes()


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard similarity from packed signatures: equal lanes by bit counts, less those equal by chance."""
    differ = many ^ one
    for shift in (2, 1) if BITS == 4 else range(BITS // 2, 0, -1):
        differ = differ | (differ >> U(shift))
    lane = U(sum(1 << i for i in range(0, 64, BITS)))
    unequal = np.bitwise_count(differ & lane).sum(axis=1)
    chance = 2.0 ** -BITS
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def margin(threshold: float) -> float:
    """Five standard errors of the estimate at the threshold."""
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * threshold
    return 5 * float(np.sqrt(p * (1 - p) / PERMUTATIONS)) / (1 - chance)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a version that tells texts under one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.xxhash64(F.col("text")).alias("version"))


def sign(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, version, n, h1, h2, n_bytes, bands, sig of every document; no text, no set."""
    rows = rows_per_band(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b, out = batch.slice(lo, 1000), []
                for doc_id, text, version in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    words = word_hashes(data)
                    s = shingles(words, size)
                    if not len(s):
                        out.append((doc_id, version, 0, 0, 0, len(data), [], b""))
                        continue
                    least = minima(s)
                    h1, h2 = np.array(sequence_hash(words), dtype=U).view(np.int64).tolist()
                    out.append((doc_id, version, len(s), h1, h2, len(data), band_keys(least, rows).view(np.int64), packed(least)))
                types = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["doc_id", "version", "n", "h1", "h2", "n_bytes", "bands", "sig"])

    return keyed_texts(docs).mapInArrow(
        run, "doc_id long, version long, n long, h1 long, h2 long, n_bytes long, bands array<long>, sig binary")


def forest(n: int, linked: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the relation ``linked`` (row i -> positions). Rows of the largest component need no call
    of their own: a link from it to another component is found from the other side."""
    label, links = np.arange(n), []
    done = np.zeros(n, dtype=bool)
    while True:
        sizes = np.bincount(label, minlength=n)
        todo = np.flatnonzero(~done & (label != sizes.argmax())) if done.any() else np.arange(min(n, 1))
        if not len(todo):
            return links
        for i in todo.tolist():
            done[i] = True
            near = linked(i)
            own, first = np.unique(label[near], return_index=True)
            for c, j in zip(own.tolist(), near[first].tolist()):
                if c != label[i]:
                    links.append((i, j))
                    label[label == c] = label[i]
            if len(todo) > 64 and (label == label[i]).sum() > n // 2 and sizes.max() <= n // 2:
                break  # a largest component has formed: its rows can be passed over


def group_links(texts: list[bytes], sigs: np.ndarray, size: int, percent: int) -> list[tuple[int, int]]:
    """Links of one group: estimate first, then 100 * intersection >= percent * union on the full sets."""
    sets = [shingles(word_hashes(t), size) for t in texts]
    low = percent / 100 - margin(percent / 100)
    counts = np.array([len(s) for s in sets])

    def linked(i: int) -> np.ndarray:
        short, long = np.minimum(counts, counts[i]), np.maximum(counts, counts[i])
        near = np.flatnonzero((similarity(sigs[i], sigs) >= low) & (100 * short >= percent * long))
        good = []
        for j in near.tolist():
            both = int(np.isin(sets[j], sets[i], assume_unique=True, kind="sort").sum()) if j != i else 0
            if j != i and 100 * both >= percent * (counts[i] + counts[j] - both):
                good.append(j)
        return np.array(good, dtype=np.int64)

    return forest(len(sets), linked)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = cut(sign(docs, size, percent))
    full = signed.where("n > 0")
    first = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last())
    classes = (full.withColumn("k", F.row_number().over(first)).where("k = 1")  # limited in each task before the shuffle
               .withColumn("node", F.coalesce("doc_id", F.col("h1").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))))
    classes = cut(classes.select("node", "doc_id", "version", "h1", "h2", "n_bytes", "bands", "sig"))

    keys = classes.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    stars = keys.join(least, "key").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = components(stars).withColumnRenamed("label", "grp")

    members = groups.join(classes.select("node", "doc_id", "version", "n_bytes", "sig"), "node")
    sized = members.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_bytes").alias("bytes"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES))
    dealt = sized.select("grp", blocks.cast("int").alias("blocks"))
    members = (members.join(dealt, "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .where((F.col("blocks") == 1) | (F.col("own") != F.col("other")))  # each pair of blocks meets once
               .select("node", F.col("doc_id").alias("id"), "version", "sig", "grp",
                       F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    rows = (members.join(keyed_texts(docs).withColumnRenamed("version", "v"),
                         F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("version") == F.col("v")))
            .select("grp", "i", "j", "node", "version", "sig", "text"))

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "version"])  # repeated rows of a document
        nodes, sigs = pdf["node"].to_numpy(), np.stack([np.frombuffer(s, dtype="<u8") for s in pdf["sig"]])
        links = group_links(pdf["text"].tolist(), sigs, size, percent)
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in links], columns=["a", "b"], dtype="int64")

    links = rows.groupBy("grp", "i", "j").applyInPandas(confirm, "a long, b long")
    named_classes = (classes.select("node", "h1", "h2").join(components(links), "node", "left")
                     .select("h1", "h2", F.coalesce("label", "node").alias("label")))
    joined = signed.select("doc_id", "n", "h1", "h2").join(named_classes, ["h1", "h2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("label") < NAMELESS, F.col("label"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, all columns kept; repeated rows of a kept doc_id count as copies.
    Rows without doc_id cannot be named by one and stay."""
    named = F.col("q_doc").isNotNull()
    found = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("q_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("q_doc"), whole_row(docs).alias("q_row"))
    joined = rows.where(named).join(found, F.col("q_doc") == F.col("q_id"), "left_semi")
    first = Window.partitionBy("q_doc").orderBy(F.xxhash64("q_row.text"))
    kept = joined.withColumn("q_k", F.row_number().over(first)).where("q_k = 1").drop("q_k").union(rows.where(~named))
    return unpack(kept, docs.columns)


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
