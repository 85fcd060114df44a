"""Operator 7: mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, are cut into blocks. With a source's exact share w of the weights, its j-th block in
a phase is released at floor(j / w) and due at ceil((j + 1) / w), and the earliest deadline among released blocks goes
first. At every slot each source is less than one block away from its share, however long the phase. When a source runs
out, the rest go on with their weights in a new phase. The schedule is sequential: one task streams it from a row per
source, holds a heap of the sources and never the blocks; a block is one step, a document is none. Blocks meet their
slots by a shuffle over (source, block), and documents meet those in their hash-range bucket.

Defined results: every document is placed, none is repeated. A null source is a source. Sources without a target
weight, or with one that is not positive, come last, by name. Empty tables give no row. Repeated rows and equal hashes
are ordered by doc_id and text; rows equal in both are interchangeable.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import text_of, unpack, whole_row

BLOCK, UNITS, BUCKET_ROWS, SEED, STREAMED = 32, 1000, 4096, 7, 50_000


def units_of(weights: dict, units: int) -> dict:
    """Whole units near ``units`` times the share, at least one."""
    total = sum(weights.values())
    found = {s: max(1, round(units * w / total)) for s, w in weights.items()}
    shared = math.gcd(*found.values())
    return {s: u // shared for s, u in found.items()}


def stream(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, slot, first slot of the phase) in slot order, by exact shares. Memory of a few numbers a source."""
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (s is None, s or ""))
    exact = {s: Fraction(weights.get(s) or 0) for s in names}
    left, t = {s: blocks[s] for s in names}, 0
    while active := [s for s in names if left[s] and exact[s] > 0]:
        scale = math.lcm(*(exact[s].denominator for s in active))
        units = [int(exact[s] * scale) for s in active]
        total, start, ready = sum(units), t, []
        # (release, deadline, number in active, block in the phase)
        pending = [(0, -(-total // u), k, 0) for k, u in enumerate(units)]
        while True:
            while pending and pending[0][0] <= t - start:
                heapq.heappush(ready, heapq.heappop(pending)[1:])
            _, k, j = heapq.heappop(ready)
            s, u = active[k], units[k]
            yield s, blocks[s] - left[s], t, start
            left[s] -= 1
            t += 1
            if not left[s]:
                break
            heapq.heappush(pending, ((j + 1) * total // u, -(-(j + 2) * total // u), k, j + 1))
    for s in names:
        start = t
        for j in range(blocks[s] - left[s], blocks[s]):
            yield s, j, t, start
            t += 1


def period(units: dict) -> dict:
    """Slots of each source in one period, earliest deadline first."""
    slots: dict = {s: [] for s in units}
    for s, _, t, _ in islice(stream({s: u + 1 for s, u in units.items()}, units), sum(units.values())):  # none runs out
        slots[s].append(t)
    return slots


def schedule(blocks: dict, weights: dict, units: int | None = None) -> dict:
    """The stream as source -> phases (first block, block after the last, first slot, slots of the phase, own slots).
    ``units``: weights are rounded to whole units first."""
    if units and (some := {s: weights[s] for s, n in blocks.items() if n and (weights.get(s) or 0) > 0}):
        weights = units_of(some, units)
    phases: dict = {s: [] for s in blocks}
    ends: dict = {}
    for s, j, t, start in stream(blocks, weights):
        if not phases[s] or phases[s][-1][2] != start:
            phases[s].append((j, j, start, []))
        first, _, _, own = phases[s][-1]
        own.append(t - start)
        phases[s][-1] = (first, j + 1, start, own)
        ends[start] = t + 1
    return {s: [(first, after, start, ends[start] - start, own) for first, after, start, own in p] for s, p in phases.items()}


def tempered(counts: dict, power: float = 0.5) -> dict:
    """Targets proportional to a power of each source's documents: small sources are raised."""
    return {s: float(n) ** power for s, n in counts.items()}


def placed(docs: DataFrame, weights: dict | None = None, source: str = "source", block: int = BLOCK, power: float = 0.5) -> DataFrame:
    """(q_row, q_source, q_rank, q_slot) of every document; (q_slot, q_rank) is the mixed order."""
    hashed = docs.select(whole_row(docs).alias("q_row"), F.col(source).cast("string").alias("q_source"), F.col("doc_id").alias("q_id"),
                         F.xxhash64(F.col("doc_id"), F.lit(SEED)).alias("q_hash"), F.xxhash64(text_of("text")).alias("q_text"))
    counts = hashed.groupBy("q_source").agg(F.count(F.lit(1)).alias("n"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {s: k for b in batches for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        steps = stream({s: -(-k // block) for s, k in n.items()}, tempered(n, power) if weights is None else weights)
        while some := list(islice(steps, STREAMED)):
            cols = zip((pa.string(), pa.int64(), pa.int64()), zip(*some))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for t, c in cols], names=["p_source", "p_block", "p_slot"])

    plan = counts.repartition(1).mapInArrow(slots, "p_source string, p_block long, p_slot long")  # reads a row per source

    # rank in the source: a row number within hash-range buckets, which split any source, plus the buckets before
    bits = max(0, math.ceil(math.log2(max(1, docs.count() / BUCKET_ROWS))))
    bucket = F.shiftright(F.col("q_hash"), 64 - bits) if bits else F.lit(0).cast("long")
    hashed = hashed.withColumn("q_bucket", bucket)
    before = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy(F.col("q_source").alias("b_source"), F.col("q_bucket").alias("b_bucket")).agg(F.count(F.lit(1)).alias("n"))
               .select("b_source", "b_bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("q_before")))
    blocks = offsets.withColumn("b_block", F.explode(F.sequence(F.floor(F.col("q_before") / block), F.floor((F.col("q_before") + F.col("n") - 1) / block))))
    offsets = (blocks.join(plan, F.col("b_source").eqNullSafe(F.col("p_source")) & (F.col("b_block") == F.col("p_block")))
               .groupBy("b_source", "b_bucket", "q_before")  # the slots of the bucket's blocks, in order
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("b_block", "p_slot"))), lambda x: x["p_slot"]).alias("q_slots")))
    order = Window.partitionBy("q_source", "q_bucket").orderBy("q_hash", "q_id", "q_text")
    ranked = (hashed.withColumn("q_n", F.row_number().over(order))
              .join(offsets, F.col("q_source").eqNullSafe(F.col("b_source")) & (F.col("q_bucket") == F.col("b_bucket")))
              .withColumn("q_rank", F.col("q_before") + F.col("q_n") - 1))
    own = F.floor(F.col("q_rank") / block) - F.floor(F.col("q_before") / block) + 1
    return ranked.select("q_row", "q_source", "q_rank", F.element_at("q_slots", own.cast("int")).alias("q_slot"))


def mix_report(docs: DataFrame, weights: dict | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, source, source_rank, block, slot, position: place in the mixed order, with gaps after short blocks."""
    light = docs.select("doc_id", F.col(source).alias("source"), F.md5(text_of("text")).alias("text"))
    at = placed(light, weights, "source", block)
    return at.select(F.col("q_row.doc_id").alias("doc_id"), F.col("q_row.source").alias("source"), F.col("q_rank").alias("source_rank"),
                     F.floor(F.col("q_rank") / block).alias("block"), F.col("q_slot").alias("slot"),
                     (F.col("q_slot") * block + F.col("q_rank") % block).alias("position"))


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """The documents, all columns kept, in mixed order."""
    return unpack(placed(docs, weights, source, block).orderBy("q_slot", "q_rank"), docs.columns)


def deviation(order: list, weights: dict) -> Fraction:
    """Largest distance of any source from its share over all prefixes of a list of slots' sources."""
    total, seen, worst = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[x] - Fraction(weights[x] * t, total)) for x in weights))
    return worst
