"""Operator 5: packing by non-negative least squares.

A document's ids (with the end id) are cut into whole windows and one rest of 1 to window - 1 ids. The rests form a
histogram by length, whose size is the window, whatever the corpus. Of the combinations that fill a window exactly,
all of two lengths are listed, and of three (a, b, c) and four (a, b, b, c) those whose b is among the commonest lengths
(at least 4, fewer the more lengths there are); non-negative least squares finds how often to repeat each; the counts are rounded down
and clipped to the supply. Rests left over are packed greedily, longest first, end to end, and cut where a window
ends, so that only the last sequence has padding. Places follow by arithmetic: a rest's number among those of its
length (counted per written partition, offsets by prefix sums) names its repeat of a combination. No text, id or
document passes through the driver: it sees the histogram alone.

``pack_in_order`` packs rows that have a place in a mixed order: within ranges of RANGE_SLOTS consecutive slots, each
planned by the same method from its own histogram in one task. Sequences are numbered range by range, in a range by the
place of their first piece, so a prefix of them holds the documents of a prefix of the order, up to one range. The last
sequence of each range may have padding. The order comes from slot and rank, not from files.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; ties between rests of one
length are settled by their place in the written table; an empty table gives no piece.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, text_of

ENCODED = "doc_id long, doc_tokens long, crcs array<long>, rest binary, rest_len int, part int, seq long"
RANGE_SLOTS = 128
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Ids of the byte-level vocabulary in a .json file, by the faster of the two public libraries that read it. Added
    tokens inside a text become their own ids, as that file's library does by default."""
    import json

    import tiktoken

    from .token_count import PIECES, byte_symbols
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte, added = byte_symbols(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=added)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(docs: DataFrame, path: str, window: int, end_id: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: checksums of its whole windows, its rest, and the rest's number among those of its length
    in this partition. ``keep``: columns of whole numbers that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(window, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                b = batch.slice(lo, 500)
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.append(enc.encode_to_numpy(text, allowed_special="all"), end_id).astype("<u4")
                    whole = len(ids) // window
                    rest = ids[whole * window:]
                    rows.append((doc_id, len(ids), [crc(ids[i * window:(i + 1) * window]) for i in range(whole)],
                                 rest.tobytes(), len(rest), part, int(seen[len(rest)])))
                    seen[len(rest)] += 1
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)] + b.columns[2:], names=[
                    "doc_id", "doc_tokens", "crcs", "rest", "rest_len", "part", "seq", *keep])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), *[F.col(c).cast("long") for c in keep])
            .mapInArrow(run, ", ".join([ENCODED, *(f"{c} long" for c in keep)])))


def combinations(hist: np.ndarray, window: int, most: int = 6000) -> list[tuple[int, ...]]:
    """Multisets of present lengths that sum to the window: all pairs; (a, b, c) and (a, b, b, c) for the commonest b only."""
    have = np.flatnonzero(hist)
    there, found = set(have.tolist()), set()
    for a in have.tolist():
        if window - a in there:
            found.add(tuple(sorted((a, window - a))))
    order = have[np.argsort(-hist[have], kind="stable")].tolist()
    for share in (2, 3):  # further lengths before the one that completes the window
        for a in order:
            for b in order[:max(4, most // (len(order) * share))]:
                if share == 2 and (c := window - a - b) in there:
                    found.add(tuple(sorted((a, b, c))))
                elif share == 3 and a + 2 * b < window and (c := window - a - 2 * b) in there:
                    found.add(tuple(sorted((a, b, b, c))))
    return sorted(found)


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |A x - target|, x >= 0, by accelerated projected gradients; column j of A counts the lengths columns[j]
    (0: none)."""
    n, size = len(columns), len(target)
    used = columns > 0

    def fill(x):
        return np.bincount(columns[used], weights=np.repeat(x, used.sum(1)), minlength=size)[:size]

    degree = np.bincount(columns[used], minlength=size)[:size].max()
    step = 1.0 / (degree * columns.shape[1])  # bounds the largest eigenvalue of A'A
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        miss = fill(y) - target
        miss[0] = 0
        new = np.maximum(0, y - step * np.where(used, miss[columns], 0).sum(1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class Plan:
    """Where the n-th rest of each length goes. Of the histogram's size."""

    def __init__(self, hist: np.ndarray, window: int, first_sequence: int):
        combos = combinations(hist, window)
        left = hist.astype(np.int64).copy()
        left[0] = 0
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        base = first_sequence
        if combos:
            wide = np.zeros((len(combos), 4), dtype=np.int64)
            for i, c in enumerate(combos):
                wide[i, :len(c)] = c
            repeats = np.floor(nnls(wide, left.astype(float)) + 1e-6).astype(np.int64)
            for i in np.argsort(-repeats, kind="stable"):
                lengths, need = np.unique(combos[i], return_counts=True)
                r = int(min(repeats[i], (left[lengths] // need).min()))
                if r <= 0:
                    continue
                at = 0
                for length, times in zip(lengths.tolist(), need.tolist()):
                    for _ in range(times):
                        first = int(hist[length] - left[length])
                        slots.setdefault(length, []).append((first, r, base, at))  # rests first .. first + r
                        left[length] -= r
                        at += length
                base += r
        self.window, self.base = window, base
        self.slots = {k: np.array(v, dtype=np.int64) for k, v in slots.items()}
        self.placed = hist - left  # from this number on, a rest is left over
        lengths = np.arange(len(hist))
        tail = (left * lengths)[::-1].cumsum()[::-1]
        self.tail = np.append(tail[1:], 0)  # ids of longer rests that are left over

    def place(self, length: int, number: int) -> tuple[int, int]:
        """(sequence, offset); a left-over rest may run over the end of its sequence."""
        if number < self.placed[length]:
            table = self.slots[length]
            first, _, base, at = table[np.searchsorted(table[:, 0], number, side="right") - 1]
            return int(base + number - first), int(at)
        pos = int(self.tail[length] + (number - self.placed[length]) * length)
        return self.base + pos // self.window, pos % self.window


def rest_pieces(plan: Plan, rest: bytes, length: int, number: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(ids before, length, ids_crc32, sequence, offset) of each piece of a rest."""
    ids = np.frombuffer(rest, dtype="<u4")
    (sequence, offset), done = plan.place(length, number), 0
    while done < length:
        take = min(length - done, plan.window - offset)
        yield done, take, crc(ids[done:done + take]), sequence, offset
        done, sequence, offset = done + take, sequence + 1, 0


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    done = cut(encode(docs, path, window, end_id))
    per_part = done.groupBy("part", "rest_len").agg(F.count(F.lit(1)).alias("n"))
    whole = done.groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    hist = np.zeros(window, dtype=np.int64)
    for r in per_part.groupBy("rest_len").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        hist[r["rest_len"]] = r["n"]
    n_whole = whole.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    plan = spark.sparkContext.broadcast(Plan(hist, window, n_whole))

    running = Window.partitionBy("rest_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbers = per_part.select("part", "rest_len", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    # whole windows: sequences are numbered by partition and document, as the rests are by partition and length
    wide = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    firsts = whole.select("part", F.coalesce(F.sum("n").over(wide), F.lit(0)).alias("first"))
    order = Window.partitionBy("part").orderBy("rest_len", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (done.where(F.size("crcs") > 0).select("part", "rest_len", "seq", F.size("crcs").alias("k"))
               .withColumn("within", F.coalesce(F.sum("k").over(order), F.lit(0)))
               .join(firsts, "part").select("part", "rest_len", "seq", (F.col("first") + F.col("within")).alias("sequence")))
    placed = (done.join(numbers, ["part", "rest_len"]).withColumn("number", F.col("before") + F.col("seq"))
              .join(offsets, ["part", "rest_len", "seq"], "left"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        for batch in batches:
            rows = []
            for doc_id, total, crcs, rest, length, number, sequence in batch.itertuples(index=False, name=None):
                key = None if doc_id is None else int(doc_id)  # sent as text: a null would turn numbers into floats
                for i, c in enumerate(crcs):
                    rows.append((key, i * window, window, int(c), total, int(sequence) + i, 0))
                if not length:
                    continue
                for before, take, c, at, offset in rest_pieces(p, rest, length, number):
                    rows.append((key, len(crcs) * window + before, take, c, total, at, offset))
            names = [c.split()[0] for c in PIECE.split(", ")]
            out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype="Int64"))
            yield out

    return placed.select(F.col("doc_id").cast("string"), "doc_tokens", "crcs", "rest", "rest_len", "number", "sequence").mapInPandas(pieces, PIECE)


def pack_in_order(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """The same rows as ``pack``, for documents with columns q_slot and q_rank."""
    slots, names = RANGE_SLOTS, [c.split()[0] for c in PIECE.split(", ")]

    def arrange(group: pa.Table) -> pa.Table:
        group = group.sort_by([("q_slot", "ascending"), ("q_rank", "ascending")])
        lengths = group["rest_len"].to_pylist()
        n_whole = sum(map(len, group["crcs"].to_pylist()))
        plan = Plan(np.bincount(lengths, minlength=window), window, n_whole)
        seen, numbers, rows, whole = np.zeros(window, dtype=np.int64), {}, [], 0
        columns = (group[c].to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "rest"))
        for doc_id, total, crcs, rest, length in zip(*columns, lengths):
            for i, c in enumerate(crcs):
                rows.append((doc_id, i * window, window, c, total, numbers.setdefault(whole, len(numbers)), 0))
                whole += 1
            if length:
                for before, take, c, at, offset in rest_pieces(plan, rest, length, int(seen[length])):
                    rows.append((doc_id, len(crcs) * window + before, take, c, total, numbers.setdefault(at, len(numbers)), offset))
                seen[length] += 1
        cols = [*zip(*rows), [group["q_range"][0].as_py()] * len(rows)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[*names, "q_range"])

    encoded = (encode(docs.withColumn("q_range", F.floor(F.col("q_slot") / slots)), path, window, end_id, ("q_slot", "q_rank", "q_range"))
               .drop("part", "seq"))
    done = cut(encoded.groupBy("q_range").applyInArrow(arrange, PIECE + ", q_range long"))
    before = Window.orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    firsts = (done.groupBy("q_range").agg((F.max("sequence_id") + 1).alias("n"))
              .select("q_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return done.join(firsts, "q_range").withColumn("sequence_id", F.col("first") + F.col("sequence_id")).select(*names)
