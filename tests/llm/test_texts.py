"""Operators 1, 3, 4, 6, 8 against brute force, and their defined results on odd rows."""
import hashlib
import re
import zlib

import public_tokenizers
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from qualm.llm import line_dedup, secrets, simhash, token_count, toxicity
from qualm.plans.oracle import compare, duckdb_connect
from tests.conftest import MID, SMALL
from tests.llm.conftest import ROWS

import __spark_entry__ as E

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def check_counts(df, library):
    rows = df.collect()
    found = token_count.count_documents(df, VOCABULARY).collect()
    assert len(rows) == len(found)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids),
                   n > 512) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want


def test_token_counts(docs, odd, empty, library):
    for df in (docs, odd, empty):
        check_counts(df, library)


@pytest.mark.parametrize("text", ["", " ", "\x1c\x85 \xa0x　", "\n\n \t a", "ab" * 5000, "é" * 3000, "I'm you'LL don't", "１２ Ⅷ²",
                                  "a<|endoftext|><|endoftext|>b <|endoftext", "‍﻿", "\x00\x01", "😀👍🏽"])
def test_token_count_of_odd_texts(text, library):
    assert token_count.counter(VOCABULARY).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def fingerprint(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    if not words:
        return 0
    words += [""] * (5 - len(words))
    total, votes = len(words) - 4, [0] * 64
    for i in range(total):
        h = 42
        for w in words[i:i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def simhash_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        f, g, h = map(fingerprint, (text, edited, after))
        like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{g:016x}", like(f, g), like(f, h))
    return out


def test_simhash_matches_brute_force(docs, odd):
    for df in (docs, odd):
        rows = list(dict.fromkeys((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()))
        found = simhash.fingerprint_report(df).collect()
        assert len(found) == df.count()
        want = simhash_by_hand(rows)
        for r in found:
            if df is odd and r.doc_id == 5:  # the repeated document follows itself once
                assert r.fingerprint == want[5][2]
                continue
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[r.doc_id], r.doc_id
        fps = [(int(r.fingerprint, 16)) for r in found]
        assert [r.near_docs for r in found] == [sum(0 < bin(a ^ b).count("1") <= 3 for b in fps) for a in fps]


def test_simhash_small_tables(spark, empty, odd):
    assert simhash.fingerprint_report(empty).count() == 0
    one = simhash.fingerprint_report(odd.where("doc_id = 11")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert simhash.fingerprint_report(odd.where("doc_id is null")).count() == 1


def test_block_tables_find_every_near_pair(spark):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for x in base for b in [x, *(x ^ sum(1 << i for i in rng.sample(range(64), k)) for k in (1, 2, 3, 4, 5))]}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "f long")
    rows = simhash.near_pairs(df).collect()
    found = {frozenset((r.a % 2 ** 64, r.b % 2 ** 64)) for r in rows}
    assert found == {frozenset((a, b)) for a in fps for b in fps if 0 < bin(a ^ b).count("1") <= 3} and len(rows) == len(found)


BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def base_spans(text):
    found = []
    for k, (name, p, group, least) in enumerate(BASE):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text) if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


def check_secrets(df):
    rows = {(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()}
    want = {d: base_spans(t) for d, t in rows}
    found = secrets.scan(df).collect()
    assert len(found) == df.count()
    for r in found:
        w = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(w).encode()).hexdigest(), r
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in w) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("blob")] == w
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), ["assign", "access", "hex", "blob"].index(s.split(":")[0])))


def test_secrets_match_brute_force(spark, docs, odd, empty):
    for df in (docs, odd, empty):
        check_secrets(df)
    check_secrets(spark.read.parquet(f"{MID}/documents.parquet"))


def test_secrets_by_ownership(spark):
    live, widely = "Zx81bQ-" + "k3Jv9" * 5, "ex4mple_Token-" + "A1b2C3d4" * 2
    text = "é secret=token=\"abcdefghijkl\" API_KEY : 'abcdefgh' password=short AKIAABCDEFGHIJKL AKIAX " + "0af" * 12 + " "
    rows = [(i, f"{text}{widely} {live if i == 3 else ''}", f"s{i % 4}") for i in range(8)] + [(9, "token=\U0001f600 " + text * 50, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_secrets(df)
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert found[3].n_live == 1 and "blob" in found[3].spans and found[1].n_live == 0 and "blob" not in found[1].spans
    assert found[1].n_example == 3 and found[1].widest == 4 and found[1].most_repos == 9


def test_secrets_by_repositories_of_one_owner(spark):
    copied, own, template = "Qr71tY-" + "m4Hx2" * 5, "Uw93sE-" + "p8Kd6" * 5, "Lb27nA_" + "c5Vz3" * 5
    rows = [(i, f"token={copied} {template} {own if i < 99 else ''}", "s0") for i in range(100)]  # two in 100 repositories, one in 99
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_secrets(df)
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    base, at = f"assign:0:{6 + len(copied)}", len(f"token={copied} {template} ")
    assert (found[0].n_live, found[0].n_example, found[0].widest, found[0].most_repos) == (1, 1, 1, 100)
    assert found[0].spans == f"{base},blob:{at}:{at + len(own)}"
    assert (found[99].n_live, found[99].n_example, found[99].spans) == (0, 1, base)
    assert {r.n_live for r in secrets.scan(df, example_repos=101).collect()} == {2, 3}


def test_toxicity_held_out(spark):
    df = spark.read.parquet(f"{SMALL[:-5]}0.1/documents.parquet")
    labels = spark.read.parquet(f"{SMALL[:-5]}0.1/labels.parquet")
    rows = toxicity.score_documents(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert sum(a == b for a, b in test if a) / sum(a for a, _ in test) > 0.85  # some labels have no cause in the text


def test_toxicity_locates_sentences(spark, odd, empty):
    model = toxicity.fit(["Fine day here. You are a stupid clown today. All is well."] * 20 + ["Fine day here. All is well. You are a good person today."] * 20,
                         [1] * 20 + [0] * 20)
    text = "All is well with the day. You are a stupid clown today. Fine day here and now."
    score, _, n, start, end, _ = model.bag(text, model.scorer())
    assert score > 0.5 and n == 1 and "stupid clown" in text[start:end]
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).count() == len(ROWS)
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(empty, labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_line_dedup_matches_sql(spark):
    con = duckdb_connect(SMALL)
    r = compare(E.queries()["op8_line_dedup"](spark, SMALL), E.oracle_sql()["op8_line_dedup"], SMALL, con)
    assert r["values_match"] and r["rows_spark"] == r["rows_oracle"], r


def test_line_dedup_by_hand(spark, odd, empty):
    common, rows = "this line is on many sites", []
    for i in range(30):
        lines = [f"own line number {i}", common if i >= 4 else "filler line for one site", "ok", f"pair line {i // 2} here"]
        rows.append((i, "\n".join(lines), f"s{i % 5}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).collect()}
    assert [i for i in out if common in out[i]] == [4] and all("ok" in out[i] and f"own line number {i}" in out[i] for i in out)
    assert all(f"pair line {i // 2} here" in out[i] for i in out)
    kept = line_dedup.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [t for d, t in texts if d == 2] == [""] and line_dedup.dedup_lines(empty).count() == 0


def test_near_threshold_lines_are_counted(spark):
    rows = [(i, f"wide line number {i % 3}", f"site{i // 3}") for i in range(3 * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least, want in ((40, 3), (41, 0), (39, 3)):
        assert line_dedup.boilerplate(line_dedup.occurrences(df, "source", least), 4).count() == want


def test_short_lines_and_lines_without_spaces(spark):
    """Every line counts: one without spaces like others, a short one on more sites."""
    rows = [(i, f"\u672c\u7f51\u7ad9\u7248\u6743\u6240\u6709\u672a\u7ecf\u8bb8\u53ef\u4e0d\u5f97\u8f6c\u8f7d\u8c22\u8c22\nRead more\nGo on\n \n\nown {i}", f"s{i % 9}" if i % 3 else "s0") for i in range(30)]
    rows = [(i, t.replace("Go on", "Go on" if i % 9 < 6 else f"go {i}"), s) for i, t, s in rows]  # on five sites
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sites = lambda x: len({s for _, t, s in rows if x in t.split("\n")})
    assert sites("Read more") < line_dedup.SHORT_SITES and sum("Read more" in x for x in out.values()) == 30
    assert [i for i in out if out[i][0].startswith("\u672c")] == [0] and all(" " in out[i] and "" in out[i] for i in out)
    wide = [(i, "Read more\nown", f"s{i}") for i in range(line_dedup.SHORT_SITES)]
    for n in (line_dedup.SHORT_SITES, line_dedup.SHORT_SITES - 1):
        kept = line_dedup.dedup_lines(spark.createDataFrame(wide[:n], "doc_id long, text string, source string")).collect()
        assert sum("Read more" in r.text for r in kept) == (1 if n == line_dedup.SHORT_SITES else n)


def test_lines_of_a_long_document_go_in_linear_time(spark):
    import time
    lines = [f"boilerplate line number {i}" if i % 2 else f"own line number {i}" for i in range(60_000)]
    rows = [(i, "\n".join(x if j % 2 else f"{x} of {i}" for j, x in enumerate(lines)), f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = time.time()
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).collect()}
    assert out[0] == rows[0][1].split("\n") and out[2] == [f"{x} of 2" for x in lines[::2]]
    assert time.time() - t < 60


def test_repeated_labelled_rows_are_one_document(spark, monkeypatch):
    """300 copies of a labelled document leave the fit as it was."""
    rows = [(i, f"you are a clown number {i} and more words" if i % 2 else f"the weather is fine on day {i} again") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    fits = []
    monkeypatch.setattr(toxicity, "fit", lambda t, y: fits.append((t, y)) or toxicity.Model())
    for copies in (1, 300):
        toxicity.train(spark.createDataFrame(rows + rows[1:4] * (copies - 1), "doc_id long, text string"), labels)
    assert fits[0] == fits[1] and len(fits[0][0]) <= 40


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Whole texts of all labelled rows reach the fit here, and recall is over all held-out toxic documents."""
    df = spark.read.parquet(f"{SMALL[:-5]}0.1/documents.parquet")
    labels = spark.read.parquet(f"{SMALL[:-5]}0.1/labels.parquet")
    label = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id in label}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    fits, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda t, y: fits.append(sorted(t)) or fit(t, y))
    model = toxicity.train(df, labels)
    kinds = [sum(label[d] == y for d in texts if not out[d]) for y in (0, 1)]
    assert max(kinds) <= toxicity.SAMPLE and fits == [sorted(t for d, t in texts.items() if not out[d])]
    words = model.scorer()
    hits = [model.bag(texts[d], words)[0] >= 0.5 for d in texts if out[d] and label[d]]
    print(f"held-out recall {sum(hits)} of {len(hits)}")
    assert len(hits) == 97 and sum(hits) / len(hits) > 0.85


def test_one_rule_in_fit_and_score():
    """The passages of the fit are all windows of PASSAGE sentences, or the whole document, and give the score's noisy-or."""
    rng, sizes = np.random.default_rng(7), [1, 5, 31, 32, 33, 100, 1, 64]
    first = np.append(0, np.cumsum(sizes))
    starts, ends, begins = toxicity.passages(first)
    want = [(a + i, min(a + i + toxicity.PASSAGE, a + n)) for a, n in zip(first, sizes) for i in range(max(1, n - toxicity.PASSAGE + 1))]
    assert list(zip(starts, ends)) == want
    z = rng.normal(size=first[-1])
    before = np.append(0, np.logaddexp(0, z).cumsum())
    best = toxicity.highest(before[ends] - before[starts], begins)
    assert toxicity.highest(np.zeros(len(starts)), begins).tolist() == begins.tolist()
    model = toxicity.Model(0.0, {f"=w{i}": float(x) for i, x in enumerate(z)})
    toxic_words = {f"w{i}": float(x) for i, x in enumerate(z)}
    for d, (a, n) in enumerate(zip(first, sizes)):
        bags = [(0, 0, {f"w{i}"}) for i in range(a, a + n)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(toxicity, "sentences", lambda text: bags)
            score = model.bag("", toxic_words)[0]
        s, e = starts[best[d]], ends[best[d]]
        assert score == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z[s:e]))), abs=1e-12)


def test_toxicity_of_very_long_texts(spark):
    df = spark.read.parquet(f"{SMALL[:-5]}0.1/documents.parquet")
    labels = spark.read.parquet(f"{SMALL[:-5]}0.1/labels.parquet")
    label = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id in label}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in texts}
    model = toxicity.train(df, labels)
    words = model.scorer()
    # held-out clean texts that are kept one by one, in a row
    clean = [t for d, t in sorted(texts.items()) if out[d] and not label[d] and model.bag(t, words)[0] < 0.5]
    toxic = next(t for d, t in sorted(texts.items()) if out[d] and label[d] and model.bag(t, words)[0] > 0.9)
    row = [t[a:b] for t in clean for a, b, _ in toxicity.sentences(t)]
    row *= -(-50_000 // len(row))
    for n in (1000, 10_000, 50_000):
        assert model.bag("\n".join(row[:n]), words)[0] < 0.5, n
        assert model.bag("\n".join([*row[:n // 2], toxic, *row[n // 2:n]]), words)[0] >= 0.5, n


def test_toxicity_lower_cases_around_a_dotted_capital_i():
    text = "İstanbul is a fine old town. YOU ARE A STUPİD CLOWN today again."
    (_, _, first), (start, end, second) = toxicity.sentences(text)
    assert {"istanbul", "fine"} <= first and {"you", "stupid", "clown"} <= second
    assert text[start:end] == " YOU ARE A STUPİD CLOWN today again"[-(end - start):] and end == len(text) - 1
    import sys
    assert [c for c in map(chr, range(sys.maxunicode + 1)) if len(c.lower()) != 1] == ["İ"]
