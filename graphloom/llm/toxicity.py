"""Toxicity by multiple-instance learning: noisy-or over sentences, trained from document labels.

A document is toxic if at least one of its sentences is. A sentence's chance is logistic in the words it
holds and in their beginnings, and the document's is ``1 - prod(1 - p_sentence)``. Only documents are labelled; the weights of the
words are fitted by gradient ascent on the likelihood of the document labels, so the blame goes to the
sentences that tell toxic documents from others. Those sentences are then located: ``predict`` counts them and names the
worst, ``locate_all`` gives each one its row.

Fitting uses a bounded sample of labelled rows (``MAX_TRAIN_DOCS``, chosen by a hash of the id; equal rows count once) and the
``FEATURES`` of them that tell the labels apart best in it. Scoring takes every sentence of every text: the
sentences without a known word share one chance, so a text is scored from its known words and its number
of sentences, in array operations over a slice of texts.

Defined results: a null or empty text has no sentence and gets the score of the base rate of such an empty
text, ``1 - exp(-0)`` = 0. Repeated rows are scored alike. Without labelled rows, or with one class only,
every score is the share of toxic labels (0 without labels). Of several labels of one id the greatest
counts; null labels and ids are left out of training.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import extended, fold, map_arrow, named, slices, table

#: Labelled rows to fit on, at most about so many.
MAX_TRAIN_DOCS = 4_000
#: Words and beginnings with a weight.
FEATURES = 512
#: Documents whose words are counted at a time.
CHUNK_DOCS = 256
#: Lengths of the beginnings of words that are features too.
PREFIXES = (4, 5, 6, 7)
#: A feature is a candidate only if so many sampled documents hold it.
MIN_DOCS = 4
SLICE_BYTES = 4_000_000

_MARKS = string.punctuation.encode()
_END = (b".", b"!", b"?")


@dataclass
class Bag:
    """The words of some texts, by sentence."""

    words: list[bytes]  # distinct, without outer punctuation
    code: np.ndarray  # for each token, the index of its word
    sentence: np.ndarray  # for each token, its sentence (counted over all texts)
    first: np.ndarray  # index of each text's first sentence; one more at the end


def bag(texts: list[bytes]) -> Bag:
    """Sentences end at a line end or after a token that ends in ``.``, ``!`` or ``?``."""
    lists = [t.lower().replace(b"\n", b" \x01 ").split() + [b"\x01"] for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    raw, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    ends = np.fromiter((w.endswith(_END) or w == b"\x01" for w in raw), bool, len(raw))[code]
    blank = np.fromiter((w == b"\x01" for w in raw), bool, len(raw))[code]
    stripped = pa.array([w.strip(_MARKS) for w in raw], pa.binary()).dictionary_encode()
    sentence = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
    # only sentences with a word count, in order
    held = np.zeros(int(sentence[-1]) + 1 if len(sentence) else 0, bool)
    held[sentence[~blank]] = True
    number = np.cumsum(held) - 1
    text_of = np.repeat(np.arange(len(lists)), sizes)
    owner = np.zeros(len(held), np.int64)
    owner[sentence] = text_of
    first = np.searchsorted(owner[held], np.arange(len(lists) + 1))
    keep = ~blank
    return Bag(stripped.dictionary.to_pylist(), stripped.indices.to_numpy()[code[keep]], number[sentence[keep]], first)


def sentences_of(text: str) -> list[str]:
    """The sentences of one text as ``bag`` counts them, white space as single blanks."""
    out: list[str] = []
    for line in text.split("\n"):
        held: list[str] = []
        for token in line.encode("utf-8", "replace").split():
            held.append(token.decode("utf-8", "replace"))
            if token.endswith(_END):
                out.append(" ".join(held))
                held = []
        if held:
            out.append(" ".join(held))
    return out


def fold_words(sentence: str) -> set[str]:
    """The different words of a sentence as they are looked up."""
    return {w.decode("utf-8", "replace") for t in sentence.encode().lower().split() if (w := t.strip(_MARKS))}


def features_of(word: bytes) -> list[str]:
    """The word itself, and its beginnings (marked ``*``): they carry over to inflected and compound forms."""
    w = word.decode("utf-8", "replace")
    return [w, *(w[:k] + "*" for k in PREFIXES if k < len(w))] if w else []


@dataclass
class ToxicityModel:
    weight: dict[str, float]
    bias: float
    constant: float | None = None  # the score of every text, where nothing could be learnt

    def sentence_logits(self, b: Bag) -> tuple[np.ndarray, np.ndarray]:
        """Sentences that hold a known word (each word once), and their logits."""
        get = self.weight.get
        w = np.array([sum(get(f, 0.0) for f in features_of(x)) for x in b.words])
        at = np.flatnonzero(w[b.code] != 0) if len(b.code) else np.zeros(0, np.int64)
        pairs = np.unique(b.sentence[at] * len(b.words) + b.code[at]) if len(at) else at
        s = pairs // max(1, len(b.words))
        ids, inverse = np.unique(s, return_inverse=True)
        return ids, self.bias + np.bincount(inverse, w[pairs % max(1, len(b.words))], len(ids))

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text its score, how many of its sentences are toxic (chance >= 0.5), the worst of those that stand out
        by a known word (the first of equals; -1: none), and the greatest chance of a sentence."""
        none = np.full(len(texts), -1)
        if self.constant is not None:
            return np.full(len(texts), self.constant), np.zeros(len(texts), np.int64), none, np.full(len(texts), self.constant)
        b = bag(texts)
        ids, logit = self.sentence_logits(b)
        n = np.diff(b.first)
        owner = np.searchsorted(b.first, ids, "right") - 1
        known = np.bincount(owner, minlength=len(texts))
        stay = -np.logaddexp(0, self.bias) * (n - known) - np.bincount(owner, np.logaddexp(0, logit), len(texts))
        flagged = np.bincount(owner, logit >= 0, len(texts)).astype(np.int64) + (n - known) * (self.bias >= 0)
        top = np.where(n > 0, self.bias, -np.inf)
        order = np.lexsort((ids, -logit, owner))
        which, first = np.unique(owner[order], return_index=True)
        best = order[first]
        out = logit[best] > self.bias
        none[which[out]] = (ids[best] - b.first[which])[out]
        top[which] = np.where(known[which] < n[which], np.maximum(top[which], logit[best]), logit[best])
        return -np.expm1(stay), flagged, none, 1 / (1 + np.exp(-top))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.judge(texts)[0]

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, float]]:
        """``(sentence number, chance)`` of the sentences of at least that chance."""
        if self.constant is not None:
            return []
        ids, logit = self.sentence_logits(bag([text.encode()]))
        p = 1 / (1 + np.exp(-logit))
        return [(int(i), float(x)) for i, x in zip(ids, p) if x >= least]


def fit(texts: list[bytes], toxic: np.ndarray, features: int = FEATURES, min_docs: int = MIN_DOCS, rounds: int = 400, ridge: float = 0.02) -> ToxicityModel:
    """Noisy-or logistic weights by gradient ascent (Adam) on the document likelihood."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not len(toxic) or share in (0.0, 1.0):
        return ToxicityModel({}, 0.0, share)
    b = bag(texts)
    names: dict[str, int] = {}
    of_word = [[names.setdefault(f, len(names)) for f in features_of(x)] for x in b.words]
    n_of = np.fromiter(map(len, of_word), np.int64, len(of_word))
    flat = np.array([f for fs in of_word for f in fs], np.int64)
    start = np.cumsum(n_of) - n_of

    def expand(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word repeated for its features, and the features."""
        at = np.repeat(np.arange(len(word)), n_of[word])
        inner = np.arange(len(at)) - np.repeat(np.cumsum(n_of[word]) - n_of[word], n_of[word])
        return at, flat[start[word[at]] + inner]

    size = max(1, len(names))
    doc = np.searchsorted(b.first, b.sentence, "right") - 1
    df, pos = np.zeros(size), np.zeros(size)
    for lo in range(0, len(texts), CHUNK_DOCS):  # counted in chunks, as the expanded pairs are many
        tokens = slice(*np.searchsorted(doc, (lo, lo + CHUNK_DOCS)))
        pair = np.unique(doc[tokens] * len(b.words) + b.code[tokens])
        at, feature = expand(pair % max(1, len(b.words)))
        pair = np.unique((pair // max(1, len(b.words)))[at] * size + feature)
        df += np.bincount(pair % size, minlength=size)
        pos += np.bincount(pair % size, toxic[pair // size], size)
    # log-likelihood ratio of each word's presence against the labels
    n, n1 = len(texts), toxic.sum()

    def part(k: np.ndarray, m: np.ndarray, base: float) -> np.ndarray:
        q = np.clip(k / np.maximum(m, 1), 1e-12, 1 - 1e-12)
        return k * np.log(q / base) + (m - k) * np.log((1 - q) / (1 - base))

    gain = part(pos, df, share) + part(n1 - pos, n - df, share)
    gain[(df < min_docs)] = -1
    chosen = np.argsort(-gain, kind="stable")[:features]
    chosen = chosen[gain[chosen] > 0]
    slot = np.full(size, -1)
    slot[chosen] = np.arange(len(chosen))
    at, feature = expand(np.arange(len(b.words)))
    useful = np.zeros(len(b.words), bool)
    useful[at[slot[feature] >= 0]] = True
    kept = useful[b.code]
    pair = np.unique(b.sentence[kept] * max(1, len(b.words)) + b.code[kept])
    at, feature = expand(pair % max(1, len(b.words)))
    known = slot[feature] >= 0
    sent, feat = (pair // max(1, len(b.words)))[at[known]], slot[feature[known]]
    ids, row = np.unique(sent, return_inverse=True)
    owner = np.searchsorted(b.first, ids, "right") - 1
    rest = np.diff(b.first) - np.bincount(owner, minlength=n)
    name = list(names)
    w, bias = np.zeros(len(chosen)), np.log(share / (1 - share)) - np.log(max(1.0, np.diff(b.first).mean()))
    mean, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[feat], len(ids))
        stay = -np.logaddexp(0, bias) * rest - np.bincount(owner, np.logaddexp(0, z), n)
        p = np.clip(-np.expm1(stay), 1e-9, 1 - 1e-9)
        outer = np.where(toxic > 0, np.exp(stay) / p, -1.0)  # d log-likelihood / d(-stay)
        gz = outer[owner] / (1 + np.exp(-z))
        g = np.append(np.bincount(feat, gz[row], len(w)) - ridge * n * 0.01 * w, gz.sum() + (outer * rest).sum() / (1 + np.exp(-bias)))
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        step = 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
        w, bias = w + step[:-1], bias + step[-1]
    return ToxicityModel({name[c]: float(x) for c, x in zip(chosen, w)}, float(bias))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, row_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows of ``docs``, or on about ``max_docs`` of them chosen by a hash of the id.

    The sample's words are counted here on the driver, so ``max_docs`` bounds what is gathered.
    """
    known = labels.where(named(row_id).isNotNull() & named(label).isNotNull()).groupBy(named(row_id).alias("__id")).agg(F.max(named(label)).alias("__toxic"))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("__id")), F.lit(1 << 30))
    n = known.count()
    if n > max_docs:
        known = known.where(draw < int(max_docs / n * (1 << 30)))
    rows = docs.select(named(row_id).alias("__i"), named(text).alias("__t"))
    sample = rows.join(F.broadcast(known), F.col("__i") == F.col("__id"))  # about max_docs ids
    sample = sample.groupBy("__id", F.xxhash64("__t").alias("__h")).agg(F.first("__t").alias("__t"), F.first("__toxic").cast("int").alias("y"))
    texts: list[bytes] = []
    toxic: list[int] = []
    for r in sample.orderBy("__h", "__id").limit(2 * max_docs).select("__t", "y").toLocalIterator(prefetchPartitions=True):
        texts.append((r["__t"] or "").encode())
        toxic.append(int(r["y"] > 0))
    return fit(texts, np.array(toxic))


#: What ``predict`` adds besides the score: toxic sentences, the worst (from 0; null where none stands out), the greatest chance.
FOUND = {"n_flagged": "long", "worst_sentence": "long", "worst_score": "double"}


def predict(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 and the columns ``FOUND``; every other column passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES words
    kept = [f for f in docs.schema.fields if f.name not in (score, *FOUND)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text))
            parts = [(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))]
            for lo, hi in slices(texts, SLICE_BYTES):
                parts.append(shared.value.judge([x or b"" for x in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]))
            scores, flagged, worst, chance = (np.concatenate(x) for x in zip(*parts))
            worst = pa.array(worst.astype(np.int64), mask=worst < 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores), pa.array(flagged.astype(np.int64)), worst, pa.array(chance)], names=[*names, score, *FOUND])

    return map_arrow(docs.select(*map(named, names)), run, extended(kept, **{score: "double"}, **FOUND))


def locate_all(docs: DataFrame, model: ToxicityModel, row_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``(doc_id, sentence_no, sentence_text, chance)``: a row for each sentence of at least that chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, numbers, found, chances = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, p in shared.value.locate(t, least) if t else ():
                    at.append(i)
                    numbers.append(k)
                    chances.append(p)
                    found.append(sentences_of(t)[k])
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.int64()), pa.array(found, pa.string()), pa.array(chances, pa.float64())], names=["doc_id", "sentence_no", "sentence_text", "chance"])

    kind = docs.schema[row_id].dataType.simpleString()
    return map_arrow(docs.select(named(row_id), named(text)), run, f"doc_id {kind}, sentence_no bigint, sentence_text string, chance double")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = predict(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FOUND)
