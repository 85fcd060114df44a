"""Operator 4: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score of its words and their prefixes; the
noisy-or of some sentences is 1 - prod(1 - p). Only document labels train the weights, so the sentence scores, which
locate the offending sentences, are learned through the noisy-or. A document's probability is the highest noisy-or of its
passages, PASSAGE sentences in a row, in the fit and in the score alike: the small probabilities of very many clean
sentences must not add up. A text of up to PASSAGE sentences is one passage.

The classifier is fitted on a bounded sample of all labelled documents: at most SAMPLE of each label, the ones with the
smallest hash of doc_id; rows that repeat a doc_id are one of them, with the least of their texts. The fit reads every
sentence of their whole texts, as numbers of distinct words; only texts being read are held as strings. Scoring covers
every whole text.

Defined results: null and empty texts are one sentence without words, so they get the bias alone; a text's score is
independent of other rows, so repeated rows agree; labels that contradict each other count as toxic; null labels are
left out; without labels of both kinds every score is 0.
"""
from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of, unpack, whole_row

SAMPLE, PREFIXES, MIN_DOCS, MIN_WORDS, CACHED_WORDS = 3000, (3, 4, 5, 6), 5, 6, 400_000
PASSAGE = 32

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SCORED = ("score double, n_sentences int, n_offending int, worst_start int, worst_end int, worst_score double")


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence; one of under MIN_WORDS words joins the next. One empty
    sentence if the text has no words."""
    lower = text.replace("\u0130", "I").lower()  # the one character whose lower case is longer: offsets stay
    found, start, held = [], None, []
    for m in SENTENCE.finditer(lower):
        if words := WORD.findall(m.group()):
            start = m.start() if start is None else start
            held += words
            if len(held) >= MIN_WORDS:
                found.append((start, m.end(), set(held)))
                start, held = None, []
    if held:
        found.append((start, len(text), set(held)))
    return found or [(0, 0, set())]


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every passage, document by document, and where each document's passages begin. ``first``: the
    documents' first sentences, then the number of all sentences; every document has a sentence."""
    size = np.diff(first)
    at, end = np.arange(first[-1]), np.repeat(first[1:], size)
    starts = at[(at + PASSAGE <= end) | (at == np.repeat(first[:-1], size))]
    return starts, np.minimum(starts + PASSAGE, end[starts]), np.searchsorted(starts, first[:-1])


def highest(total: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The number of each document's passage with the highest total, the first of equals."""
    counts = np.diff(np.append(begins, len(total)))
    doc = np.repeat(np.arange(len(begins)), counts)
    top = np.flatnonzero(total == np.maximum.reduceat(total, begins)[doc])
    return top[np.append(True, np.diff(doc[top]) > 0)]


@dataclass
class Model:
    """weights: of the features that kept one. Words are looked up in a bounded cache of their sums."""
    bias: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self):
        weight = self.weights.get

        class Words(dict):
            def __missing__(self, word):
                w = sum(weight(f, 0.0) for f in features(word))
                if len(self) < CACHED_WORDS:
                    self[word] = w
                return w

        return Words()

    def bag(self, text: str | None, words) -> tuple:
        """The document's score, then what SCORED lists; spans in characters, end exclusive."""
        bag = sentences(text or "")
        z = np.array([self.bias + sum(map(words.__getitem__, w)) for _, _, w in bag])
        p, loss, k = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.logaddexp(0, z), int(z.argmax())
        n, before = min(PASSAGE, len(z)), np.append(0, loss.cumsum())
        at = int((before[n:] - before[:-n]).argmax())  # the highest passage, as in the fit
        return float(-np.expm1(-loss[at:at + n].sum())), len(bag), int((p >= 0.5).sum()), bag[k][0], bag[k][1], float(p[k])


def fit(texts: Iterable[str], labels: list[int], rounds: int = 150, rate: float = 0.05, l1: float = 3e-4) -> Model:
    """Adam on the log-likelihood of the best passages' noisy-or, with soft thresholds that leave few weights. A round's
    gradient runs through the passage that is each document's highest under the weights before it."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return Model()
    # word numbers of every sentence, in flat arrays: the texts' words are not held as strings
    words: dict[str, int] = {}
    word_of, sentence_of, in_docs, first = array("i"), array("i"), array("i"), array("q")
    n_sent = 0
    for text in texts:
        own: set[int] = set()
        first.append(n_sent)
        for _, _, found in sentences(text):
            numbers = [words.setdefault(x, len(words)) for x in sorted(found)]
            own.update(numbers)
            word_of.extend(numbers)
            sentence_of.extend([n_sent] * len(numbers))
            n_sent += 1
        in_docs.extend(sorted(own))
    word_docs = np.bincount(np.frombuffer(in_docs, dtype=np.int32), minlength=len(words))
    seen: Counter = Counter()
    for w, n in zip(words, word_docs.tolist()):
        for f in features(w):
            if n >= MIN_DOCS or f[0] != "=":
                seen[f] += n
    ids = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_DOCS))}
    of_word, of_feature = array("i"), array("i")
    for w, i in words.items():
        known = [ids[f] for f in features(w) if f in ids]
        of_feature.extend(known)
        of_word.extend([i] * len(known))
    if not of_word:
        return Model(bias=float(np.log(y.mean() / (1 - y.mean()))))
    of_word, of_feature, word_of, sentence_of = (np.frombuffer(x, dtype=np.int32) for x in (of_word, of_feature, word_of, sentence_of))
    n_words, n_docs = len(words), len(y)
    every_start, every_end, begins = passages(np.append(np.frombuffer(first, dtype=np.int64), n_sent))
    balance = np.where(y == 1, 0.4 / y.mean(), 0.6 / (1 - y.mean()))
    w, bias = np.zeros(len(ids)), -4.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, rounds + 1):
        of = np.bincount(of_word, weights=w[of_feature], minlength=n_words)
        z = bias + np.bincount(sentence_of, weights=of[word_of], minlength=n_sent)
        p, loss = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.logaddexp(0, z)
        before = np.append(0, loss.cumsum())
        total = before[every_end] - before[every_start]
        best = highest(total, begins)
        starts, clean = every_start[best], np.exp(-total[best])
        pull = balance * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) / n_docs
        # a document pulls on the sentences of its passage only
        size = every_end[best] - starts
        inside = np.repeat(starts - np.append(0, size.cumsum()[:-1]), size) + np.arange(size.sum())
        dz = np.zeros(n_sent)
        dz[inside] = p[inside] * np.repeat(pull, size)
        dw = np.bincount(word_of, weights=dz[sentence_of], minlength=n_words)
        g = np.append(np.bincount(of_feature, weights=dw[of_word], minlength=len(ids)), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        shrink = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.999 ** step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(shrink, 0.5 * rate), 0)
    return Model(float(bias), {f: float(w[i]) for f, i in ids.items() if w[i]})


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample. Only its rows reach the driver."""
    marked = (labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id")
              .agg(F.max(F.col("toxic").cast("int")).alias("q_toxic")))
    known = docs.select("doc_id").join(marked, "doc_id").dropDuplicates(["doc_id"])  # repeated rows are one document
    order = [F.xxhash64("doc_id"), F.col("doc_id")]  # each task keeps its own first rows: no label meets in one task
    of = [known.where(F.col("q_toxic") == y).orderBy(*order).limit(SAMPLE) for y in (0, 1)]
    chosen = of[0].unionByName(of[1]).select("doc_id", "q_toxic")
    rows = (docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 SAMPLE rows
            .groupBy("doc_id", "q_toxic").agg(F.min("text").alias("text"))  # of several texts with one id, one
            .toPandas().sort_values("doc_id"))
    return fit(rows["text"].tolist(), rows["q_toxic"].tolist())


def score_column(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    """A struct SCORED per text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = model.value.scorer()
        for texts in batches:
            yield pd.DataFrame([model.value.bag(t, words) for t in texts], columns=[c.split()[0] for c in SCORED.split(", ")])

    return score(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, then the sentences that offend."""
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(docs, labels, F.col("text")).alias("q"))
    return scored.select("doc_id", "held_out", "q.score", (F.col("q.score") >= 0.5).cast("int").alias("predicted"),
                         "q.n_sentences", "q.n_offending", "q.worst_start", "q.worst_end", "q.worst_score")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below ``limit``, with all their columns."""
    marked = docs.select(whole_row(docs).alias("q_row"), score_column(docs, labels, F.col("text"))["score"].alias("q_score"))
    return unpack(marked.where(F.col("q_score") < limit), docs.columns)
