"""Operators 11 to 13 against brute force, and their defined results on odd rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from qualm.llm import collocations, exact_dedup, repair
from tests.conftest import MID, SMALL
from tests.llm.conftest import ROWS

TO = {0: 2, 1: 2, 2: 3, 3: 2}
OWN = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def shown(x):
    return " " if x is None else str(x)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(symbols):
    """Least (cost, audit) by whole strings from the end."""
    after = {q: (0, "") if q in (0, 3) else (10 ** 9, "") for q in range(4)}
    table = [None] * (len(symbols) + 1)
    for i in range(len(symbols), -1, -1):
        base = {}
        for q in range(4):
            if i == len(symbols):
                base[q] = after[q]
                continue
            (initial, fault), behind = symbols[i], table[i + 1]
            ways = [(4 + behind[q][0], "D" + behind[q][1])]
            if fault not in ("blank", "again"):
                more, own = 3 * (fault == "cut"), OWN.get((initial, q))
                ways += [(more + behind[own][0], "K" + behind[own][1])] if own is not None else []
                ways.append((3 + more + behind[TO[q]][0], "R" + behind[TO[q]][1]))
            base[q] = min(ways)
        one, two = TO, {q: TO[TO[q]] for q in TO}
        table[i] = {q: min(base[q], (3 + base[one[q]][0], "I" + base[one[q]][1]), (6 + base[two[q]][0], "II" + base[two[q]][1])) for q in range(4)}
    return table[0][0]


def repaired(rows, convs):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], shown(r[2]), shown(r[3])))
    out = {}
    for conv in convs:
        rs, seen, symbols, count = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])), set(), [], Counter()
        for _, role, text in rs:
            there = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not there else "again" if (role, text) in seen else "cut" if there[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role[:1], fault))
            count[fault] += 1
        turns = [r[0] for r in rs if r[0] is not None]
        cost, audit = cheapest(symbols)
        q, left, lines = 0, iter(rs), []
        for x in audit:
            role, text = ("", "") if x == "I" else next(left)[1:]
            if x != "D":
                q = OWN[role[:1], q] if x == "K" else TO[q]
                lines.append(f"{role if x == 'K' else ('user', 'assistant')[q - 2]}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["again"], count["cut"],
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df, most=repair.ROWS):
    return {r.conv_id: tuple(r)[1:] for r in repair.report(repair.repair(df, most)).collect()}


def odd_turns():
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "x"], ["Hi.", "ok", "", "  ", None, "a b?", "z!\n", "\u00e9."]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(60)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(100 + i, j, rng.choice(roles), str(rng.random()) + rng.choice([".", "", "?"])) for i in range(60) for j in range(rng.randrange(9))]
    rows += [(9, j, rng.choice(roles[:4]), str(rng.random()) + rng.choice([".", "", "?"])) for j in range(400)]
    rows += [(10, j, "tool", f"{j}.") for j in range(300)]  # ranks never converge
    rows += [(11, j, "tool", "same.") for j in range(300)] + [(12, None, "user", "same.") for _ in range(200)]
    return rows + [(13, 0, "user", "word " * 300_000 + "."), (13, 1, "assistant", "Yes.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair_of_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert reported(repair.damage(df)) == repaired(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("most", [1024, 7, 1])
def test_repair_in_chunks(spark, most):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, part int")
    want = {r[0] for r in rows}
    assert reported(df, most) == repaired(rows, want)
    assert reported(repair.damage(df), most) == repaired(damaged(rows), want)


def test_repaired_turns_are_legal(spark):
    found = repair.repaired_turns(repair.repair(spark.createDataFrame(odd_turns(), SCHEMA), 7)).collect()
    by = defaultdict(str)
    for r in sorted(found, key=lambda r: (r.part, r.seq, r.pos)):
        by[r.conv_id] += r.role[:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in by.values()) and by


def test_repair_of_no_rows(spark):
    assert reported(spark.createDataFrame([], SCHEMA)) == {}


def test_ranks_converge():
    """A run from another vector meets the speculative one up to a constant, and both runs give the true vector."""
    rng = random.Random(2)
    symbols = [(rng.choice("sua"), rng.choice([0, 0, 0, 1, 3])) for _ in range(500)]
    spec = repair.backwards(symbols, repair.END)
    for start in [*repair.BASIS, (5, 2, 1, 0)]:
        assert repair.backwards(symbols, start, spec) == repair.backwards(symbols, start)
    summed = [x for e in repair.BASIS for x in repair.before(repair.backwards(symbols, e, spec))]
    assert list(repair.through(summed, (9, 4, 1, 7))) == repair.before(repair.backwards(symbols, (9, 4, 1, 7)))


def copies(rows):
    by = defaultdict(list)
    for doc, text in rows:
        x = text or ""
        by[re.sub("[\x20\x09-\x0D]", "", x)].append((-len(x), doc is None, doc or 0, doc))
    return sorted(((r[3], min(g)[3], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for r in g), key=str)


@pytest.mark.parametrize("counters,most", [(exact_dedup.COUNTERS, exact_dedup.FREQUENT), (16, 2)])
def test_exact_copies(spark, odd, empty, counters, most):
    df = odd.unionByName(odd.limit(4)).repartition(7)
    found = exact_dedup.exact_copies(df, counters, most).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == copies([(r.doc_id, r.text) for r in df.collect()])
    groups = Counter(r.text_sha256 for r in found if r.kept)
    assert set(groups.values()) == {1} and set(groups) == {r.text_sha256 for r in found}
    stay = exact_dedup.drop_copies(df, counters, most)
    assert stay.columns == df.columns and stay.count() == len(groups)
    assert exact_dedup.exact_copies(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_frequent_digests_are_found(spark):
    """A digest of a third of the rows never reaches the shuffle; the summary's other finds are verified."""
    rows = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('text ', id)) as text")
    written = exact_dedup.written(rows)
    found = exact_dedup.winners(written, 64, 8).collect()
    assert [(r.h_size, r.h_first.doc) for r in found] == [(10_000, 0)]


def phrases(rows, least, top):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, out = defaultdict(Counter), []
    for lang, text in rows:
        c = counts["und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = [w for w in re.split(r"[ \t]", piece) if w]
            c.update(tuple(ws[i:i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    for lang, c in counts.items():
        n = sum(v for w, v in c.items() if len(w) == 1)
        cand = {w: v for w, v in c.items() if len(w) > 1 and v >= least}
        gone = {w[i:j] for w, v in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if w[i:j] != w and 100 * v >= 100 * cand[w[i:j]]}
        best = []
        for w, a in cand.items():
            if w not in gone:
                score, k = min((1000 * a * n // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), a, c[w[:k]], c[w[k:]], n, score))
        out += [(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top,step", [(10, 50, 4), (20, 2000, 16)])
def test_collocations(spark, least, top, step):
    df = spark.read.parquet(f"{MID}/documents.parquet")
    found = collocations.collocations(df, least, top, step).collect()
    assert sorted(map(tuple, found)) == phrases([(r.lang, r.text) for r in df.select("lang", "text").collect()], least, top)


def test_collocations_of_odd_rows(spark, odd, empty):
    more = [("a b c. " * 60, None), ("A B\tc;a b c d e f g\n" * 30, "und"), ("caf\u00c9 caf\u00c9 CAF\u00c9 " * 40, "fr"), ("x\u00a0y z " * 50, "fr")]
    df = odd.select("text", "lang", "kind").unionByName(spark.createDataFrame([(*r, "k") for r in more], "text string, lang string, kind string"))
    rows = [(r.lang, r.text) for r in df.collect()]
    for least, top in ((3, 5), (20, 2000)):
        assert sorted(map(tuple, collocations.collocations(df, least, top, 4).collect())) == phrases(rows, least, top)
    assert collocations.collocations(empty).count() == 0


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 10 ** 13
    rows = [("en", [1, 2], big + 1, False)]
    counts = spark.createDataFrame([([1], 3 * big + 7), ([2], 2 * big + 3), ([1, 2], big + 1)], "w array<long>, n long")
    found = collocations.scored(spark.createDataFrame(rows, "lang string, w array<long>, n long, held boolean"), counts,
                                spark.createDataFrame([("en", 10 ** 15 + 1)], "lang string, n long")).collect()
    assert found[0].score == 1000 * (big + 1) * (10 ** 15 + 1) // ((3 * big + 7) * (2 * big + 3))
