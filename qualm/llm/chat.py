"""Operator 10: chat formatting in budgeted windows.

Turns are marked ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline; control strings inside roles and texts are escaped
reversibly. Prefix sums of the turns' tokens choose turn-aligned windows: each holds the conversation's system turn (its
first turn, if of that role), as many whole earlier turns as ``history`` tokens allow, then new turns up to ``budget`` tokens. The
loss mask marks the texts of new assistant turns, so a repeated target is masked and each target counts once.

No conversation is one task's work: turns are dealt over ranges that cut a conversation anywhere, a range sums its own turns, and
the sums of a conversation's earlier ranges (at most one row a range) are added. The turns whose prefix sum lies in the same
SEGMENT tokens make a segment, and segments are cut into windows on their own, with the history that lies before them
and the system turn sent along; a window ends with its segment. Reading back hashes turns as they pass, one conversation
after another, as a digest of all its text needs.

Defined results: null texts and roles are empty; turns sort by number (null first), then role and text; repeated rows are
repeated turns; a null conv_id is a conversation. Rows that agree in conv_id, turn, role and the text's first 64 characters share a
range. A turn over the budget has a window of its own with the system turn. An empty
table gives no window.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, partitions, text_of

BUDGET, HISTORY, MARKS, SEGMENT = 1024, 256, 8, 65_536
START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
TURNS = "part int, conv string, role string, text string, size long, before long"
WINDOW = "conv_id long, segment long, window int, text string, n_repeated int, loss array<struct<start:long,end:long>>"
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def escape(s: str) -> str:
    """No ``<|`` and, in a role, no newline is left."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape(s: str, role: bool = False) -> str:
    return ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], s) if "\\" in s else s


def encode(s: str) -> bytes:
    return s.encode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokens_of(path: str):
    from .packing import encoder
    enc = encoder(path)
    return lambda s: len(enc.encode_ordinary(s))


def spans(before: list[int], own: int, pinned: int, system: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first held, first new, after the last new turn) of a segment's windows. ``before``: the prefix sums of its turns, then
    their end; turns before ``own`` are history only, and the first ``pinned`` (0 or 1) is the system turn, of ``system`` tokens,
    which a window holds beside the others unless it is one of its new turns."""
    at, n = own, len(before) - 1
    while at < n:
        beside = system if at or not pinned else 0
        room = max(min(history, budget - (before[at + 1] - before[at]) - beside), 0)
        held = min(at, bisect_left(before, before[at] - room, pinned))
        end = max(at + 1, bisect_right(before, before[held] + budget - beside) - 1)
        yield held, at, min(end, n)
        at = end


def window_of(system: tuple | None, repeated: list[tuple], new: list[tuple]) -> tuple[str, int, list[dict]]:
    """text, n_repeated and loss of turns (role, text)."""
    held = [*([system] if system else []), *repeated]
    out, at, loss = [], 0, []
    for i, (role, text) in enumerate([*held, *new]):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if i >= len(held) and role == "assistant":
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), len(held), loss


def counted(turns: DataFrame, path: str) -> DataFrame:
    """TURNS: the turns with their tokens and the tokens before them in their conversation (exact prefix sums)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, part, now, total = tokens_of(path), TaskContext.get().partitionId(), None, 0
        for b in batches:
            sizes, before = [], []
            for conv, role, text in zip(b["conv"], b["role"], b["text"]):
                if now != (conv,):
                    now, total = (conv,), 0
                sizes.append(count(escape_role(role)) + count(escape(text)) + MARKS)
                before.append(total)
                total += sizes[-1]
            yield b.assign(part=part, size=sizes, before=before)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.withColumn("lead", F.substring("text", 1, 64))
    keys = ["conv_id", "turn", "role", "lead"]
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys, "text")
    made = cut(dealt.select(F.col("conv_id").cast("string").alias("conv"), "role", "text").mapInPandas(run, TURNS))
    pieces = made.groupBy("conv", "part").agg(F.sum("size").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = pieces.select(F.col("conv").alias("p_conv"), F.col("part").alias("p_part"), earlier.alias("earlier")).where("earlier is not null")
    known = made.join(F.broadcast(later), F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part")), "left")  # a row a range at most
    return known.withColumn("before", F.col("before") + F.coalesce("earlier", F.lit(0))).drop("p_conv", "p_part", "earlier")


def format_windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment and window (their order), text, n_repeated (turns of earlier windows), loss (spans of characters, end
    exclusive). ``segment``: tokens a task formats on its own, more than ``history``."""
    if segment <= history:
        raise ValueError("a segment must be longer than the history")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, rows = None, [], []

        def closed():
            (conv, segment_no), system, start = now, None, 0
            if held[0][0] == 0:  # sent along from the conversation's first segment
                system, start = held[0], 1
            elif held[0][3] == 0 and held[0][1] == "system":
                system = held[0]
            body = held[start:]
            pinned, own = int(system is not None and not start), sum(t[0] < 2 for t in body)
            before = [t[3] for t in body] + [body[-1][3] + body[-1][4]] if body else [0]
            for i, (a, at, end) in enumerate(spans(before, own, pinned, system[4] if system else 0, budget, history)):
                beside = system[1:3] if system and (at or not pinned) else None
                text, n_repeated, loss = window_of(beside, [t[1:3] for t in body[a:at]], [t[1:3] for t in body[at:end]])
                rows.append((None if conv is None else int(conv), segment_no, i, text, n_repeated, loss))

        for b in batches:
            for conv, number, kind, role, text, at, size in zip(b["conv"], b["segment"], b["kind"], b["role"], b["text"], b["before"], b["size"]):
                if now != (conv, number):
                    if now:
                        closed()
                    now, held = (conv, number), []
                held.append((kind, role, text, at, size))
                if len(rows) >= 500:
                    yield frame(rows, WINDOW)
                    rows = []
        if now:
            closed()
        if rows:
            yield frame(rows, WINDOW)

    rows = counted(turns, path).select("conv", F.floor(F.col("before") / segment).alias("segment"), "role", "text", "before", "size")
    # kind 0: the system turn for later segments; 1: turns that may be history of the next segment; 2: the segment's own
    again = F.when((F.col("segment") + 1) * segment - F.col("before") <= history, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2)))
    own = rows.withColumn("kind", F.explode(again)).withColumn("segment", F.col("segment") + F.when(F.col("kind") == 1, 1).otherwise(0))
    system = rows.where((F.col("before") == 0) & (F.col("role") == "system")).drop("segment")
    later = rows.where("segment > 0").select(F.col("conv").alias("l_conv"), "segment").distinct()
    sent = system.join(later, F.col("conv").eqNullSafe(F.col("l_conv"))).drop("l_conv").withColumn("kind", F.lit(0))
    dealt = own.unionByName(sent).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "kind", "before")
    return dealt.select("conv", "segment", "kind", "role", "text", "before", "size").mapInPandas(run, WINDOW)


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(dict(zip([c.split()[0] for c in re.split(r", (?=\w+ )", schema)], zip(*rows))))
    return out.assign(conv_id=pd.array([r[0] for r in rows], dtype="Int64"))


def read_window(text: str, n_repeated: int, loss: list) -> tuple[list[tuple[str, str]], list[str]]:
    """The new turns of a window and the texts under its loss mask, unescaped."""
    turns = [(unescape(m[1], role=True), unescape(m[2])) for m in TURN.finditer(text)]
    return turns[n_repeated:], [unescape(text[s["start"]:s["end"]]) for s in loss]


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def closed():
            return [(now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])] if now else []

        for b in batches:
            for conv_id, text, n_repeated, loss in zip(b["conv_id"], b["text"], b["n_repeated"], b["loss"]):
                conv_id = None if conv_id is None else int(conv_id)
                if now is None or now[0] != conv_id:
                    rows += closed()
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns, targets = read_window(text, n_repeated, loss)
                now[1] += len(turns)
                for role, t in turns:
                    now[2].update(encode(f"{role}\n{t}\n"))
                for t in targets:
                    now[3] += len(t)
                    now[4].update(encode(t))
                now[5] += len(text)
                now[6] += 1
            if len(rows) >= 500:
                yield frame(rows, DIGEST)
                rows = []
        rows += closed()
        if rows:
            yield frame(rows, DIGEST)

    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return dealt.select(F.col("conv_id").cast("string"), "text", "n_repeated", "loss").mapInPandas(run, DIGEST)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts are control strings."""
    spark, text = turns.sparkSession, "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
