"""Operators 2, 5, 7, 9, 10 and the pipeline against brute force, and their defined results on odd rows."""
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from qualm.llm import ann, chat, minhash, mixing, packing, toxicity
from qualm.llm.components import components
from qualm.plans.oracle import compare, duckdb_connect
from tests.conftest import SMALL
from tests.llm.conftest import ROWS

import __spark_entry__ as E

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def exact(ids, x, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = sorted((d[j], int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])[:k]
    return out


def test_neighbours_recall(spark):
    t = spark.read.parquet(f"{SMALL[:-5]}0.1/embeddings.parquet").toPandas()
    want = exact(t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(np.float64))
    rows = ann.nearest(spark.read.parquet(f"{SMALL[:-5]}0.1/embeddings.parquet"), least=300, share=0.8).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(found[r.query_id])
    assert all(found[q] == sorted(found[q]) and len(found[q]) == 10 for q in want)
    hit = [len({v for _, v in want[q]} & {v for _, v in found[q]}) / 10 for q in want]
    assert np.mean(hit) >= 0.9


def test_neighbours_of_double_vectors_by_parts_and_shares(spark):
    x = np.random.default_rng(4).normal(size=(900, 5))
    ids = np.arange(len(x)) * 20
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    want = exact(ids, x)
    for cuts in ({}, {"part_rows": 9, "query_rows": 50}):  # leaves of up to 64 in eight parts, queries in four shares
        found = defaultdict(list)
        for r in sorted(ann.nearest(df, share=12.0, **cuts).collect(), key=lambda r: (r.query_id, r["rank"])):
            found[r.query_id].append((r.score, r.vec_id))
        assert {q: [v for _, v in f] for q, f in found.items()} == {q: [v for _, v in f] for q, f in want.items()}
        assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(found[q], want[q]))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(150)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(120)] + rows[:5]
    rows += [(2000, None), (2100, [0.0] * 4), (2200, [1.0, None, 0.0, 0.0]), (2300, [float("nan"), 1.0, 0.0, 0.0]), (None, [1.0, 1.0, 0.0, 0.0]), (2400, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, leaf string, rep int")
    good = {i: v for i, v in rows if i is not None and i < 2000}
    ids, x = np.array(list(good)), np.array([np.float32(v) for v in good.values()], dtype=np.float64)
    found = defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    assert dict(found) == exact(ids, x)
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def check_packing(df, window=1024):
    library = Tokenizer.from_file(VOCABULARY)
    ids = Counter()
    for r in df.select("doc_id", "text").collect():
        ids[r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [0])] += 1
    rows = packing.pack(df, VOCABULARY, window).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for key, n in Counter(d for d, _ in ids.elements()).items():
        own = [t for (d, t), k in ids.items() for _ in range(k) if d == key]
        if n == 1:
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0])
                assert r.ids_crc32 == zlib.crc32(np.array(own[0][at:at + r.length], dtype="<u4").tobytes())
                at += r.length
            assert at == len(own[0])
        else:
            assert sum(r.length for r in by_doc[key]) == sum(map(len, own))
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < window  # only the last sequence may have padding
    return len(by_seq)


def test_packing(docs, odd, empty, spark):
    for df in (docs, odd, empty, docs.repartition(7).union(odd.select(docs.columns))):
        check_packing(df)
    same = spark.range(700).selectExpr("id as doc_id", "repeat('word ', cast(600 + id % 2 * 420 as int)) as text")
    check_packing(same)


def test_least_squares_fills_windows():
    hist = np.zeros(1024, dtype=np.int64)
    hist[[600, 424, 300, 362, 1000]] = [500, 400, 40, 80, 3]
    plan = packing.Plan(hist, 1024, 0)
    used = Counter()
    for length in np.flatnonzero(hist).tolist():
        for n in range(hist[length]):
            s, o = plan.place(length, n)
            used[s] += length if o + length <= 1024 else 0
            assert n >= plan.placed[length] or o + length <= 1024
    assert plan.placed[600] >= 390 and plan.placed[362] >= 70


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "c": 2}, {"a": 1, "b": 1}, {"a": 0.61, "b": 0.2, "c": 0.15, "d": 0.04}])
def test_schedule_stays_within_a_block(weights):
    units = mixing.units_of(weights, 100)
    slots = mixing.period(units)
    order = {t: s for s, ts in slots.items() for t in ts}
    assert sorted(order) == list(range(sum(units.values())))
    assert mixing.deviation([order[t] for t in sorted(order)] * 2, units) < 1


def test_phases_place_every_block():
    blocks, weights = {"a": 50, "b": 7, "c": 13, None: 4, "none": 3}, {"a": 5.0, "b": 3.0, "c": 1.0, None: 1.0}
    plan = mixing.schedule(blocks, weights, 100)
    taken = []
    for s, phases in plan.items():
        for first, after, start, size, slots in phases:
            taken += [(start + (j - first) // len(slots) * size + slots[(j - first) % len(slots)], s) for j in range(first, after)]
    assert sorted(t for t, _ in taken) == list(range(sum(blocks.values())))
    assert Counter(s for _, s in taken) == Counter(blocks) and [s for _, s in sorted(taken, key=lambda x: x[0])][-3:] == ["none"] * 3


def test_mixing(docs, odd, empty):
    rows = mixing.mix_report(docs, block=4).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len({r.position for r in rows}) == len(rows) and all(r.position == r.slot * 4 + r.source_rank % 4 for r in rows)
    counts = Counter(r.source for r in rows)
    for s in counts:
        assert sorted(r.source_rank for r in rows if r.source == s) == list(range(counts[s]))
    blocks = {s: -(-n // 4) for s, n in counts.items()}
    weights = mixing.tempered(counts)
    plan = mixing.schedule(blocks, weights)
    order = [s for _, s in sorted({(r.slot, r.source) for r in rows})]
    ends = sorted({start + 0 for phases in plan.values() for _, _, start, _, _ in phases})
    active = {s for s, p in plan.items() if p[0][2] == 0}
    units = mixing.units_of({s: weights[s] for s in active}, mixing.UNITS)
    assert mixing.deviation(order[:ends[1] if len(ends) > 1 else None], units) < 1
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == len(ROWS) and mixing.mix(empty).count() == 0
    at = {r.doc_id: r.position for r in rows}
    ordered = [at[r.doc_id] for r in mixing.mix(docs, block=4).collect()]
    assert ordered == sorted(ordered)


def sets_by_hand(text, size):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def components_by_hand(rows, size, percent):
    sets = [(d, sets_by_hand(t, size)) for d, t in rows]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if (sets[i][0] is not None and sets[i][0] == sets[j][0] and a and b) or a and b and 100 * len(a & b) >= percent * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if label[j] == label[i] and sets[j][0] is not None]
        out.append((d, len(s), min(ids) if ids else None))
    return out


def near_texts():
    import random
    rng, rows = random.Random(4), []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 3, " ".join(w).upper() if g % 2 else "\n".join(w)))
    return rows + [(None, rows[0][1]), (900, ""), (901, None), (902, "one"), (903, "ONE"), (None, "all by itself now")]


@pytest.mark.parametrize("size,percent,block", [(3, 85, 2048), (5, 80, 2048), (3, 85, 5)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rows = near_texts()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, node string, grp int")
    found = minhash.near_duplicates(df, size, percent).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(components_by_hand(rows, size, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_odd_rows(spark, odd, empty, docs):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd).collect()}
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found == set(components_by_hand(rows, 3, 85)) and minhash.near_duplicates(empty).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 11]
    con = duckdb_connect(SMALL)
    r = compare(E.queries()["op9_minhash_near_dedup"](spark, SMALL), E.oracle_sql()["op9_minhash_near_dedup"], SMALL, con)
    assert r["values_match"] and r["rows_spark"] == r["rows_oracle"], r


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        got = []
        for _ in range(20):
            both, a, b = (rng.integers(0, 2 ** 63, n, dtype=np.uint64) for n in (int(2000 * share), 2000, 2000))
            one, two = (np.concatenate([both, x[len(both):]]) for x in (a, b))
            sig = [np.frombuffer(minhash.packed(minhash.minima(x)), dtype="<u8") for x in (one, two)]
            got.append(minhash.similarity(sig[0], sig[1][None])[0])
        assert abs(np.mean(got) - share / (2 - share)) < 0.04


def test_words_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = (" ".join(f"Wörd{i}" for i in range(5000)) + "\t" + "x" * 3000 + " end").encode()
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "PIECE_BYTES", 500)
    assert np.array_equal(whole, minhash.word_hashes(text)) and len(whole) == 5002


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (7, 7), (200, 201), (200, 201)]
    found = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_chat(df, **sizes):
    windows = chat.format_windows(chat.with_probe(df), VOCABULARY, **sizes).cache()
    found = {r.conv_id: r for r in chat.read_back(windows).collect()}
    convs = defaultdict(list)
    for r in chat.with_probe(df).collect():
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    assert set(found) == set(convs)
    formatted = Counter()
    for r in windows.collect():
        formatted[r.conv_id] += len(r.text)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == formatted[c]
    return windows


def test_chat(spark):
    real = spark.read.parquet(f"{SMALL}/conversations.parquet")
    check_chat(real)
    windows = check_chat(real, budget=200, history=80)
    assert windows.where("n_repeated > 0").count() > 0
    rows = [(1, 0, "system", "be\\kind <|im_end|>\n"), *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " * 40) for i in range(1, 60)],
            (2, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 1, "a\n<|im_end|>\\n", "\\<|x\\\\"), (3, 1, "user", "z" * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = check_chat(df, budget=400, history=120)
    own = [r for r in windows.collect() if r.conv_id == 1]
    assert len(own) > 5 and all(r.text.startswith("<|im_start|>system\nbe\\\\kind <\\|im_end|>") for r in own)
    assert check_chat(df.limit(0)).count() == 1


def windows_by_hand(turns, count, budget, history, segment):
    """(segment, turns, repeated) of each window, by trying turn after turn."""
    sizes = [count(chat.escape_role(r)) + count(chat.escape(t)) + chat.MARKS for r, t in turns]
    number = [sum(sizes[:i]) // segment for i in range(len(turns))]
    pinned, out, at = turns[0][0] == "system", [], 0
    while at < len(turns):
        beside = [0] if pinned and at else []
        room, held = min(history, budget - sizes[at] - sum(sizes[i] for i in beside)), []
        for i in range(at - 1, 0 if pinned else -1, -1):
            if (room := room - sizes[i]) < 0:
                break
            held.insert(0, i)
        held, new = beside + held, [at]
        while new[-1] + 1 < len(turns) and number[new[-1] + 1] == number[at] and sum(sizes[i] for i in held + new) + sizes[new[-1] + 1] <= budget:
            new.append(new[-1] + 1)
        out.append((number[at], [turns[i] for i in held + new], len(held)))
        at = new[-1] + 1
    return out


def test_chat_windows_of_a_hot_conversation(spark):
    """Windows by prefix sums are those of a turn-by-turn walk, in one conversation that lies in many ranges and segments."""
    rng = np.random.default_rng(9)
    long = lambda i: " ".join(["word"] * int(rng.choice([1, 5, 20, 60, 400], p=[.3, .3, .2, .18, .02])))
    rows = [(7, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"{i} {long(i)}") for i in range(700)]
    rows += [(8, i, "user" if i % 2 else "assistant", f"{i} {long(i)}") for i in range(150)] + [(None, i, "user", f"{i} x") for i in range(60)]
    rows += [(c, i, "user" if i % 2 else "assistant", f"hello {i}") for c in range(20, 40) for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    count, convs = chat.tokens_of(VOCABULARY), defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    ranges = chat.counted(df, VOCABULARY).where("conv = '7'").select("part").distinct().count()
    assert ranges > 1
    for budget, history, segment in ((300, 100, 1500), (120, 0, 500), (1024, 256, 65_536), (64, 60, 61)):
        check_chat(df, budget=budget, history=history, segment=segment)
        found = defaultdict(list)
        for r in chat.format_windows(df, VOCABULARY, budget, history, segment).orderBy("segment", "window").collect():
            turns = [(chat.unescape(m[1], role=True), chat.unescape(m[2])) for m in chat.TURN.finditer(r.text)]
            found[r.conv_id].append((r.segment, turns, r.n_repeated))
        for c, turns in convs.items():
            assert found[c] == windows_by_hand(turns, count, budget, history, segment), (c, budget)
        assert len(found) == len(convs)
    with pytest.raises(ValueError):
        chat.format_windows(df, VOCABULARY, 100, 100, 100)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    first = corpus_pipeline.toxicity(spark, docs, SMALL).cache()
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {d for d, s in score.items() if s < 0.5}
    second = corpus_pipeline.line_dedup(spark, first, SMALL).cache()
    assert second.columns == docs.columns and second.count() == first.count()
    third = corpus_pipeline.near_dedup(spark, second, SMALL).cache()
    by_hand = components_by_hand([(r.doc_id, r.text) for r in second.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r.doc_id for r in third.collect()) == sorted(d for d, _, c in by_hand if d == c)
    fourth = corpus_pipeline.mixing(spark, third, SMALL).cache()
    assert fourth.columns == docs.columns and sorted(map(tuple, fourth.collect())) == sorted(map(tuple, third.collect()))
    last = corpus_pipeline.packing(spark, fourth, SMALL).collect()
    want = {r.doc_id for r in fourth.collect()}
    assert {r.doc_id for r in last} == want
    pieces = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rs)
    assert pieces(corpus_pipeline.run(spark, SMALL).collect()) == pieces(last)


def test_mixing_holds_the_exact_weights():
    weights = {"hot": 9.5 ** 0.5, **{f"s{i}": 1.0 for i in range(19)}}
    plan = mixing.schedule({s: 6000 if s == "hot" else 2000 for s in weights}, weights)
    slots = {}
    for s, phases in plan.items():
        for first, after, start, size, own in phases:
            slots |= {start + (j - first) // len(own) * size + own[(j - first) % len(own)]: s for j in range(first, after)}
    end = min(p[0][3] if len(p[0][4]) == p[0][1] - p[0][0] else min(t for t in slots if slots[t] == s) for s, p in plan.items())
    order = np.array([list(weights).index(slots[t]) for t in range(min(end, 20_000))])
    share = np.array(list(weights.values())) / sum(weights.values())
    seen = (order[:, None] == np.arange(20)).cumsum(0)
    assert len(order) > 10_000 and np.abs(seen - share * np.arange(1, len(order) + 1)[:, None]).max() < 1 + 1e-6


def test_mixing_of_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 50, raising=False)
    df = spark.range(400).selectExpr("id as doc_id", "'x' as text", "if(id % 80 = 0, null, concat('s', id % 80)) as source")
    rows = mixing.mix_report(df, block=2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400)) and len({r.slot for r in rows}) == 240


def test_sequences_follow_the_mixed_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_SLOTS", 8, raising=False)
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('word ', cast(if(id % 8 = 0, 1500, 40 + id % 300) as int)) as text",
                                        "case when id % 8 = 0 then null when id % 8 < 3 then 'b' else 'a' end as source")
    mixed = corpus_pipeline.mixing(spark, docs, SMALL)
    slot = {r.doc_id: r.slot for r in mixing.mix_report(docs).collect()}
    rows = corpus_pipeline.packing(spark, mixed.repartition(5), SMALL).collect()
    by_seq, place = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        place[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert sorted(by_seq) == list(range(len(by_seq))) and set(place) == set(slot)
    for pieces in place.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]
    for pieces in by_seq.values():
        pieces.sort()
        assert all(o == sum(n for _, n in pieces[:i]) for i, (o, _) in enumerate(pieces)) and sum(n for _, n in pieces) <= 1024
    # the target shares hold on every prefix of sequences, up to one range, until the first source runs out
    counts = Counter("n" if d % 8 == 0 else "b" if d % 8 < 3 else "a" for d in slot)
    weights = mixing.tempered(counts)
    ends = min(max(t for d, t in slot.items() if (d % 8 == 0) == (s == "n") and (d % 8 in (1, 2)) == (s == "b")) for s in counts)
    seen, started = Counter(), set()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if r.doc_id not in started and len(started) < (ends - 8) * 32:
            started.add(r.doc_id)
            seen["n" if r.doc_id % 8 == 0 else "b" if r.doc_id % 8 < 3 else "a"] += 1
            assert max(abs(seen[s] - len(started) * w / sum(weights.values())) for s, w in weights.items()) <= 32 * 9
    assert len(started) > 1000
