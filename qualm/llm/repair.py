"""Operator 11: conversation structure repair by a rank-convergence parallel Viterbi.

Edits of a conversation's rows (Keep, Rerole to user or assistant, Delete, Insert an empty row) must leave role initials
``(s?(ua)+)?`` at the least cost. The dynamic program has four states (nothing yet, after s, after u, after a); a row maps the
vector of costs to go behind it to the one before it, a product in (min, +).

Rows are sorted by conversation and turn over ranges, which cut a conversation anywhere, and dealt into chunks of at most ROWS
rows and CHARS characters (or one row). Every chunk runs backwards from a speculative vector, the costs at an end, and keeps the
vector at each row up to a constant (``spec``). It also runs from the four unit vectors, each only until it differs from the
speculative one by a constant: from there on all ranks have converged, and both go on alike. A conversation in one chunk is then
done. Of others, the starting vectors are stitched: a range sums its border chunks up to one response, ranges are chained on the
driver (one row a range), and each range hands the costs to its chunks. A fix-up pass reruns a chunk from its stitched vector
until it differs from ``spec`` by a constant. Tracing needs the state a chunk starts in; states are chained the same way.
Of the cheapest edits the ASCII-least is traced: at each state the least letter that keeps the cost to go.

Defined results: null roles and texts are one space; null turns come first; a null conv_id is one conversation; rows of one turn are
in order of role and text; rows that repeat a row are duplicates. Conversations that lose all rows are returned with zeros.
An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, partitions

ROWS, CHARS, SALTS = 1024, 1 << 20, 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40  # no way
NONE, BLANK, DUPLICATE, CUT_OFF = range(4)  # faults
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
#: The state that the next user or assistant row leads to, and the state that a row's own initial leads to.
NEXT = (USER, USER, ASSISTANT, USER)
OWN = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BASIS = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def inserted(costs: list[int]) -> list[int]:
    """Costs to go when rows may be inserted first; two at most, as a third leads back."""
    out = []
    for q, c in enumerate(costs):
        one = NEXT[q]
        out.append(min(c, INSERT + costs[one], 2 * INSERT + costs[NEXT[one]]))
    return out


END = tuple(inserted([0, FAR, FAR, 0]))


def options(behind: tuple[int, ...], initial: str, fault: int, q: int) -> list[tuple[int, str, int]]:
    """(cost to go, letter, next state) of the edits of one row from state ``q``."""
    found = [(DELETE + behind[q], "D", q)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT_OFF else 0
        if (own := OWN.get((initial, q))) is not None:
            found.append((KEEP + extra + behind[own], "K", own))
        found.append((REROLE + extra + behind[NEXT[q]], "R", NEXT[q]))
    return found


def levelled(v) -> tuple[int, tuple[int, ...]]:
    """A vector as its least entry and the rest above it: vectors that differ by a constant have the same rest."""
    low = min(v)
    return low, tuple(x - low if x < FAR // 2 else FAR for x in v)


@lru_cache(maxsize=100_000)
def step(behind: tuple[int, ...], initial: str, fault: int) -> tuple[int, tuple[int, ...]]:
    """The vector before a row, from the levelled one behind it."""
    return levelled(inserted([min(options(behind, initial, fault, q))[0] for q in range(4)]))


@lru_cache(maxsize=100_000)
def choice(behind: tuple[int, ...], initial: str, fault: int, q: int) -> tuple[str, int]:
    """Letters and next state of the cheapest, then ASCII-least edits of a row: insertions before it, then the row's own."""
    here = inserted([min(options(behind, initial, fault, s))[0] for s in range(4)])
    letters = ""
    while not letters or letters[-1] == "I":
        ways = options(behind, initial, fault, q) + [(INSERT + here[NEXT[q]], "I", NEXT[q])]
        letter, q = min((letter, after) for cost, letter, after in ways if cost == here[q])
        letters += letter
    return letters, q


def backwards(symbols: list[tuple[str, int]], vector, known: tuple | None = None) -> tuple[list[int], list[tuple]]:
    """Constants and levelled vectors before each row and behind the last, from the vector behind them. ``known`` is another run's
    result: once the vectors differ by a constant, the rest is taken from there."""
    low, v = levelled(vector)
    lows, rests = [0] * len(symbols) + [low], [()] * len(symbols) + [v]
    for i in range(len(symbols), 0, -1):
        if known and known[1][i] == v:
            return [x + low - known[0][i] for x in known[0][:i]] + lows[i:], known[1][:i] + rests[i:]
        up, v = step(v, *symbols[i - 1])
        low += up
        lows[i - 1], rests[i - 1] = low, v
    return lows, rests


def before(run: tuple) -> list[int]:
    """The true vector before a chunk."""
    return [run[0][0] + x if x < FAR else FAR for x in run[1][0]]


def trace(symbols: list[tuple[str, int]], rests: list[tuple], q: int) -> tuple[list[str], int]:
    """Letters of each row and the state behind the chunk, from the state before it."""
    out = []
    for symbol, behind in zip(symbols, rests[1:]):
        letters, q = choice(behind, *symbol, q)
        out.append(letters)
    return out, q


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with rows damaged by their checksum; dropped rows stay as ``gone``, so that no conversation is lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("q_k"))
    k = F.col("q_k")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1)))
    return (rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("gone"), copies.alias("q_copy"))
            .drop("q_copy"))


def fault() -> Column:
    """A row's first fault."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    whole = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    return F.when(blank, BLANK).when(F.col("again"), DUPLICATE).when(~whole, CUT_OFF).otherwise(NONE).cast("int")


def in_order(turns: DataFrame) -> DataFrame:
    """Rows with their faults, dealt and sorted by ranges of (conversation, turn, role, text). A hot text's rows meet its first one over SALTS tasks."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), name("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"),
                        name("text").alias("text"), (F.col("gone") if "gone" in turns.columns else F.lit(False)).alias("gone"))
    rows = cut(rows.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
               .withColumn("row", F.monotonically_increasing_id()))
    firsts = (rows.where(~F.col("gone")).groupBy("conv", "same").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
              .select("conv", "same", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    known = rows.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(firsts, ["conv", "same", "salt"], "left")
    known = known.withColumn("again", F.coalesce(F.col("row") != F.col("first.row"), F.lit(False)))
    known = known.select("conv_id", "conv", "turn", "role", "text", "gone", "same", "row", fault().alias("fault"), F.substring("text", 1, 64).alias("lead"))
    keys = ["conv", "turn", "role", "lead", "same", "row"]
    return known.repartitionByRange(partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys).select("conv_id", "conv", "turn", "role", "text", "gone", "fault")


CHUNK = ("part int, seq long, conv_id string, conv string, alone boolean, roles array<string>, texts array<string>, faults array<int>, rests binary, lows array<long>, "
         "response array<long>, first_turn long, last_turn long, n_turns long, illegal long")


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def symbols_of(roles, faults) -> list[tuple[str, int]]:
    return [(r[:1] if r[:1] in ("s", "u", "a") else "", int(f)) for r, f in zip(roles, faults)]


def packed(rests: list[tuple]) -> bytes:
    """Speculative vectors are small: from costs at an end, no entry is over the cost of two insertions and an edit."""
    return bytes(x for v in rests for x in v)


def unpacked(rests: bytes) -> list[tuple]:
    return [tuple(rests[i:i + 4]) for i in range(0, len(rests), 4)]


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(dict(zip(names, zip(*rows))), dtype=object) if rows else pd.DataFrame({n: pd.Series(dtype=object) for n in names})
    return out


def chunks(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Chunks of sorted rows, each run from the speculative vector and from the unit vectors until ranks converge."""

    def made(part: int, seq: int, held: list[tuple], alone: bool) -> tuple:
        conv_id, conv = held[0][:2]
        there = [r for r in held if not r[5]]
        roles, texts, faults = [r[3] for r in there], [r[4] for r in there], [int(r[6]) for r in there]
        symbols = symbols_of(roles, faults)
        spec = backwards(symbols, END)
        response = [x for e in BASIS for x in before(backwards(symbols, e, spec))] if not alone else []
        turns = [int(r[2]) for r in there if r[2] is not None]
        return (part, seq, conv_id, conv, alone, roles, texts, faults, packed(spec[1]), spec[0], response, turns[0] if turns else None, turns[-1] if turns else None,
                len(set(turns)), sum(not legal(a[:1], b[:1]) for a, b in zip(roles, roles[1:])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, seq, held, size, opened, out = TaskContext.get().partitionId(), 0, [], 0, False, []
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                new = bool(held) and row[1] != held[0][1]
                if new or len(held) >= most or held and size + len(row[4]) > CHARS:
                    # alone: it starts and ends its conversation inside this range
                    out.append(made(part, seq, held, alone=new and opened))
                    seq, held, size, opened = seq + 1, [], 0, new
                    if len(out) >= 200:
                        yield frame(out, CHUNK)
                        out = []
                held.append(row)
                size += len(row[4])
        if held:
            out.append(made(part, seq, held, alone=False))
        if out:
            yield frame(out, CHUNK)

    return rows.select("conv_id", "conv", F.col("turn").cast("string"), "role", "text", "gone", "fault").withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, CHUNK)


def through(element, vector) -> tuple[int, ...]:
    """A vector before chunks, by their response."""
    return tuple(min(min(v + element[4 * j + q] for j, v in enumerate(vector)), FAR) for q in range(4))


def onward(element, state) -> tuple[int, ...]:
    return (int(element[state[0]]),)


def stitch(chain: DataFrame, apply: Callable, basis, start, back: bool) -> DataFrame:
    """(part, seq, carried): what chunks further on in the same conversation (``back``) or earlier ones hand to each chunk of
    ``chain`` (part, seq, conv, element). Ranges first sum up their border conversation, one row each; these are chained here."""
    dealt = chain.repartition("part").sortWithinPartitions("part", F.desc("seq") if back else "seq")

    def borders(batches):
        now, rows = None, []
        for b in batches:
            for part, conv, element in zip(b["part"], b["conv"], b["element"]):
                if now and now[0] != part:
                    rows.append(now)
                if not now or now[0] != part:
                    now = [part, conv, conv, True, basis]
                if now[2] != conv:
                    now[2:] = [conv, False, basis]
                now[4] = [apply(element, x) for x in now[4]]
        rows += [now] if now else []
        yield frame([(p, a, z, one, [x for r in response for x in r]) for p, a, z, one, response in rows], "part , near , far , one , response ")

    found = dealt.select("part", "conv", "element").mapInPandas(borders, "part int, near string, far string, one boolean, response array<long>").collect()  # a row per range
    given, beyond = [], None  # beyond: (conversation, carried) at the border passed last
    for r in sorted(found, key=lambda r: -r.part if back else r.part):
        carried = beyond[1] if beyond and beyond[0] == r.near else tuple(start)
        given.append((r.part, r.near, list(carried)))
        beyond = r.far, apply(r.response, carried if r.one else tuple(start))
    hands = chain.sparkSession.createDataFrame(given, "part int, near string, given array<long>")

    def hand_out(batches):
        now, rows = None, []
        for b in batches:
            for part, seq, conv, element, near, carried in zip(*(b[c] for c in ("part", "seq", "conv", "element", "near", "given"))):
                if not now or now[0] != part:
                    now = [part, near, tuple(int(x) for x in carried)]
                if now[1] != conv:
                    now[1:] = [conv, tuple(start)]
                rows.append((part, seq, list(now[2])))
                now[2] = apply(element, now[2])
            yield frame(rows, "part , seq , carried ")
            rows = []

    joined = chain.join(F.broadcast(hands), "part").repartition("part").sortWithinPartitions("part", F.desc("seq") if back else "seq")
    return joined.mapInPandas(hand_out, "part int, seq long, carried array<long>")


PIECE = ("conv_id string, conv string, part int, seq long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
         "rows array<struct<role:string,text:string,edit:string>>, first_role string, last_role string, first_turn long, last_turn long, n_turns long")


def fixed(c, behind) -> tuple[list, list]:
    """A chunk's symbols and levelled vectors: its speculative run, rerun from the stitched vector until both differ by a constant."""
    symbols = symbols_of(c["roles"], c["faults"])
    spec = [int(x) for x in c["lows"]], unpacked(c["rests"])
    return symbols, (spec if behind is None else backwards(symbols, [int(x) for x in behind], spec))[1]


def piece(c, behind, state: int, last: bool) -> tuple:
    symbols, rests = fixed(c, behind)
    edits, q = trace(symbols, rests, state)
    rows, cost, now = [], 0, state
    for letters, role, text, (initial, f) in zip(edits, c["roles"], c["texts"], symbols):
        for x in letters:
            cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": KEEP}[x] + (TRUNCATED if x in "KR" and f == CUT_OFF else 0)
            if x == "D":
                continue
            now = OWN[initial, now] if x == "K" else NEXT[now]
            rows.append((role if x == "K" else ROLE[now], "" if x == "I" else text, x))
    tail = ""
    while last and q in (SYSTEM, USER):
        q = NEXT[q]
        rows, cost, tail = rows + [(ROLE[q], "", "I")], cost + INSERT, tail + "I"
    count = [sum(f == k for _, f in symbols) for k in (BLANK, DUPLICATE, CUT_OFF)]
    first, end = (c["roles"][0][:1], c["roles"][-1][:1]) if symbols else (None, None)
    optional = lambda x: None if pd.isna(x) else int(x)
    return (c["conv_id"], c["conv"], c["part"], c["seq"], *count, c["illegal"], cost, "".join(edits) + tail,
            [{"role": r, "text": t, "edit": e} for r, t, e in rows], first, end, optional(c["first_turn"]), optional(c["last_turn"]), c["n_turns"])


def pieces(made: DataFrame) -> DataFrame:
    """The repaired pieces of written chunks."""
    def run(batches):
        for b in batches:
            rows = b.to_dict("records")
            for i in range(0, len(rows), 200):
                yield frame([piece(c, c["behind"], START if c["state"] is None else int(c["state"][0]), c["last"]) for c in rows[i:i + 200]], PIECE)

    def states(batches):
        for b in batches:
            rows = []
            for c in b.to_dict("records"):
                symbols, rests = fixed(c, c["behind"])
                rows.append((c["part"], c["seq"], c["conv"], [trace(symbols, rests, q)[1] for q in range(4)]))
            yield frame(rows, "part , seq , conv , element ")

    chain = made.where(~F.col("alone"))
    behind = cut(stitch(chain.select("part", "seq", "conv", F.col("response").alias("element")), through, BASIS, END, back=True).withColumnRenamed("carried", "behind"))
    light = chain.select("part", "seq", "conv", "roles", "faults", "rests", "lows").withColumn("roles", F.transform("roles", lambda r: F.substring(r, 1, 1)))
    moves = cut(light.join(behind, ["part", "seq"]).mapInPandas(states, "part int, seq long, conv string, element array<long>"))
    state = stitch(moves, onward, [(q,) for q in range(4)], (START,), back=False).withColumnRenamed("carried", "state")
    # the last chunk of a conversation: ranges are in order, and so are chunks in a range
    ends = moves.groupBy("conv").agg(F.max(F.struct("part", "seq")).alias("end")).select("end.part", "end.seq", F.lit(True).alias("last"))
    rest = chain.join(behind, ["part", "seq"]).join(state, ["part", "seq"]).join(ends, ["part", "seq"], "left").withColumn("last", F.coalesce("last", F.lit(False)))
    none = F.lit(None).cast("array<long>")
    alone = made.where("alone").withColumn("behind", none).withColumn("state", none).withColumn("last", F.lit(True))
    return alone.unionByName(rest.select(alone.columns)).drop("response").mapInPandas(run, PIECE)


def repair(turns: DataFrame, most: int = ROWS) -> DataFrame:
    """Pieces of repaired conversations: ``rows`` (role, text, edit) in order of (part, seq), with ``audit`` and counts of faults."""
    return pieces(cut(chunks(in_order(turns), most)))


def repaired_turns(found: DataFrame) -> DataFrame:
    """conv_id, part, seq, pos, role, text, edit: the rows that stay, in order of (part, seq, pos)."""
    return (found.select(F.col("conv_id").cast("long").alias("conv_id"), "part", "seq", F.posexplode("rows").alias("pos", "x"))
            .select("conv_id", "part", "seq", "pos", "x.role", "x.text", "x.edit"))


REPORT = ("conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def report(found: DataFrame) -> DataFrame:
    """One row per conversation. A hash takes its bytes one after another: the pieces of a conversation pass through one task, one at a time."""

    def run(batches):
        now, rows = None, []

        def closed():
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["first"] is not None else 0
            return (now["conv_id"], gaps, *now["sums"], "".join(now["audit"]), now["hash"].hexdigest())

        for b in batches:
            for c in b.to_dict("records"):
                if now is None or now["conv"] != c["conv"]:
                    rows += [closed()] if now else []
                    now = {"conv": c["conv"], "conv_id": c["conv_id"], "sums": [0] * 5, "audit": [], "hash": hashlib.sha256(), "any": False, "role": None, "first": None, "last": None, "turns": 0}
                now["sums"] = [x + int(c[k]) for x, k in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost"))]
                if c["first_role"] is not None:
                    now["sums"][3] += now["role"] is not None and not legal(now["role"], c["first_role"])
                    now["role"] = c["last_role"]
                if not pd.isna(c["first_turn"]):
                    now["turns"] += int(c["n_turns"]) - (now["last"] == int(c["first_turn"]))
                    now["first"] = int(c["first_turn"]) if now["first"] is None else now["first"]
                    now["last"] = int(c["last_turn"])
                now["audit"].append(c["audit"])
                for r in c["rows"]:
                    now["hash"].update((("\n" if now["any"] else "") + f"{r['role']}:{r['text']}").encode("utf-8", "replace"))
                    now["any"] = True
            if len(rows) >= 500:
                yield frame(rows, REPORT)
                rows = []
        rows += [closed()] if now else []
        if rows:
            yield frame(rows, REPORT)

    done = found.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInPandas(run, REPORT)
    return done.withColumn("conv_id", F.col("conv_id").cast("long"))
