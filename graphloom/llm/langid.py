"""Language identification of spans: script ranges, per-word scores, Viterbi with a switching penalty.

A word's score for a language is a naive Bayes sum over its hashed character 1- to 4-grams (with word
boundaries). The script of a word narrows the languages it may belong to. The Viterbi path over the
words of a text, with a fixed cost for each change of language, labels its spans; the text gets the
language that most of its letters carry. ``label_all`` gives each span its row.

Everything per word runs as NumPy array operations over a slice of texts. The explicit Viterbi loop is
only entered for texts where some run of words could pay for a switch; for the others one language
throughout is provably the best path.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Texts are processed
whole. Repeated rows are predicted alike. With no labelled row to learn from, every text is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.common import extended, fold, map_arrow, named, slices, table

#: log2 of the number of hashed n-gram buckets: bounds the model at 2**BITS x languages numbers.
BITS = 17
ORDERS = (1, 2, 3, 4)
#: The classifier is fitted on about this many labelled rows, chosen by a hash of id and text.
MAX_TRAIN_DOCS = 6_000
#: Cost, in nats of word score, of changing language between two words.
SWITCH = 12.0
#: A language is a candidate for a script that has at least this share of its training letters.
SCRIPT_SHARE = 0.01
SLICE_BYTES = 1_000_000

# First code point of each block from which a word's script is read; id 0 is "other".
SCRIPT_STARTS = (
    (0x0000, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0900, 7),
    (0x0980, 8), (0x0A00, 9), (0x0B80, 10), (0x0C00, 11), (0x0D80, 12), (0x0E00, 13), (0x0E80, 14), (0x0F00, 15),
    (0x10A0, 16), (0x1100, 17), (0x1200, 18), (0x13A0, 0), (0x1780, 19), (0x1800, 20), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x3040, 21), (0x3100, 22), (0x3130, 17),
    (0x3190, 22), (0x31F0, 21), (0x3200, 0), (0x3400, 22), (0xA000, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 17),
    (0xD7B0, 0), (0xF900, 22), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6),
    (0xFF00, 1), (0xFF66, 21), (0xFFA0, 17), (0xFFE0, 0), (0x20000, 22), (0x32000, 0),
)
N_SCRIPTS = 23


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, does it belong to a word (letters and marks), its script."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    letter = np.fromiter((k == "L" for k in kind), bool, len(kind))
    word = np.fromiter((k in "LM" for k in kind), bool, len(kind))
    starts, ids = (np.array(x) for x in zip(*SCRIPT_STARTS))
    script = ids[np.searchsorted(starts, np.arange(len(kind)), side="right") - 1].astype(np.uint8)
    return letter, word, script


@dataclass
class Words:
    """The words of some texts, as arrays."""

    n_letters: np.ndarray  # letters of each word
    script: np.ndarray  # script of each word's first character
    first: np.ndarray  # index of each text's first word; one more at the end
    grams: list[tuple[np.ndarray, np.ndarray]]  # for each order: the word, the bucket of the n-gram


def words_of(texts: list[bytes]) -> Words:
    letter, word, script = _tables()
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    inside = word[code]
    ends = np.cumsum([len(t) + 1 for t in low])  # position of the separator after each text
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    is_letter = letter[code]
    cum = np.concatenate([[0], np.cumsum(is_letter)])
    stops = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    c = np.where(inside, code, np.uint32(32)).astype(np.uint32)
    word_at = np.zeros(len(c), np.int32)
    word_at[starts] = 1
    word_at = np.cumsum(word_at, dtype=np.int32) - 1
    grams = []
    h = c * np.uint32(0x9E3779B1)
    for n in ORDERS:
        if n > 1:
            h = np.concatenate([h[:1], (h[:-1] ^ (c[1:] + np.uint32(n))) * np.uint32(0x85EBCA6B)])
            h ^= h >> np.uint32(15)
        ok = np.ones(len(c), bool)
        ok[: n] = False
        if n == 1:
            ok &= inside
        for back in range(1, n - 1):  # all but the two outer characters are in the word
            ok[back:] &= inside[:-back]
        if n == 2:
            ok[1:] &= inside[1:] | inside[:-1]
        at = np.flatnonzero(ok)
        bucket = (h[at] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        grams.append((word_at[at - (~inside[at])], bucket))
    return Words(cum[stops] - cum[starts], script[code[starts]], first, grams)


@dataclass
class LanguageModel:
    langs: list[str]
    weight: np.ndarray  # [2**BITS, languages] centred log-probabilities, float32
    allowed: np.ndarray  # [scripts, languages]
    switch: float = SWITCH

    def word_scores(self, w: Words) -> np.ndarray:
        n, k = len(w.script), len(self.langs)
        out = np.zeros((n, k), np.float64)
        for which, bucket in w.grams:
            if n:
                part = self.weight[bucket]
                for j in range(k):
                    out[:, j] += np.bincount(which, part[:, j], minlength=n)
        out /= len(ORDERS) / 2
        out[~self.allowed[w.script]] -= 100.0
        return out

    def spans(self, scores: np.ndarray) -> np.ndarray:
        """Best path: a language index for each word."""
        total = scores.sum(0)
        best = int(total.argmax())
        if len(self.langs) > 1:
            others = np.delete(scores, best, 1).max(1) - scores[:, best]
            run = np.concatenate([[0.0], np.cumsum(others)])
            if (run - np.minimum.accumulate(run)).max() > self.switch:
                return _viterbi(scores, self.switch)
        return np.full(len(scores), best, np.int64)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        w = words_of(texts)
        scores = self.word_scores(w) if self.langs else None
        names, values = [], []
        for i in range(len(texts)):
            lo, hi = w.first[i], w.first[i + 1]
            letters = w.n_letters[lo:hi]
            if not self.langs or letters.sum() == 0:
                names.append("und")
                values.append(0.0)
                continue
            s = scores[lo:hi]
            path = self.spans(s)
            share = np.bincount(path, letters, minlength=len(self.langs))
            top = int(share.argmax())
            total = s[path == top].sum(0)
            sure = 1.0 / np.exp(np.clip(total - total[top], -700, 50)).sum()
            names.append(self.langs[top])
            values.append(float(min(1.0, sure) * share[top] / letters.sum()))
        return names, values

    def label_spans(self, text: str) -> list[tuple[int, int, str]]:
        """``(first word, end word, language)`` runs of one text."""
        w = words_of([text.encode()])
        if not self.langs or not len(w.script):
            return []
        path = self.spans(self.word_scores(w))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        return [(int(a), int(b), self.langs[path[a]]) for a, b in zip(cut[:-1], cut[1:])]


def _viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    n, k = scores.shape
    back = np.empty((n, k), np.int32)
    stay = np.arange(k)
    here = scores[0].copy()
    for i in range(1, n):
        top = int(here.argmax())
        jump = here[top] - switch
        move = here < jump
        back[i] = np.where(move, top, stay)
        here = np.where(move, jump, here) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = here.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, text: str = "text", lang: str = "lang", row_id: str = "doc_id") -> LanguageModel:
    """Fit on the rows of ``docs`` with a label, or on about ``max_docs`` of them chosen by a hash of id and text.

    Only the n-gram counts (at most 2**BITS for each language) come to the driver.
    """
    labelled = docs.where(named(lang).isNotNull() & named(text).isNotNull()).select(
        named(lang).cast("string").alias("lang"), named(text).alias("text"), F.xxhash64(F.lit("langid"), named(row_id), named(text)).alias("draw")
    )
    n = docs.where(named(lang).isNotNull()).count()
    if n > max_docs:
        labelled = labelled.where(F.pmod("draw", F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))
    counts = (
        labelled.select("lang", "text").repartition(8)
        .mapInArrow(_count, "lang string, kind int, slot int, n bigint")
        .groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(counts["lang"].unique().tolist())
    at = counts["lang"].map({x: i for i, x in enumerate(langs)})
    table_ = np.zeros((1 << BITS, len(langs)))
    scripts = np.zeros((N_SCRIPTS, len(langs)))
    grams, letters = counts["kind"] == 0, counts["kind"] == 1
    table_[counts["slot"][grams], at[grams]] = counts["n"][grams]
    scripts[counts["slot"][letters], at[letters]] = counts["n"][letters]
    weight = np.log((table_ + 0.5) / (table_.sum(0) + 0.5 * (1 << BITS))) if langs else table_
    weight -= weight.mean(1, keepdims=True) if langs else 0
    weight[table_.sum(1) == 0] = 0
    share = scripts / np.maximum(scripts.sum(0), 1)
    allowed = share >= SCRIPT_SHARE
    allowed[~allowed.any(1)] = True
    return LanguageModel(langs, weight.astype(np.float32), allowed)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text")
        for lo, hi in slices(texts, SLICE_BYTES):
            for name in set(langs[lo:hi]):
                some = [t.encode() for x, t in zip(langs[lo:hi], texts.slice(lo, hi - lo).to_pylist()) if x == name]
                grams, scripts = total.setdefault(name, (np.zeros(1 << BITS, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                w = words_of(some)
                for _, bucket in w.grams:
                    grams += np.bincount(bucket, minlength=1 << BITS)
                scripts += np.bincount(w.script, w.n_letters, minlength=N_SCRIPTS).astype(np.int64)
    for name, kinds in total.items():
        for kind, counts in enumerate(kinds):
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(slot), pa.string()), "kind": pa.array(np.full(len(slot), kind, np.int32)),
                "slot": pa.array(slot.astype(np.int32)), "n": pa.array(counts[slot]),
            })


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1; every other column passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS x languages
    kept = [f for f in docs.schema.fields if f.name not in (label, score)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text))
            labels: list[str] = []
            scores: list[float] = []
            for lo, hi in slices(texts, SLICE_BYTES):
                part = [x or b"" for x in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                a, s = shared.value.predict(part)
                labels += a
                scores += s
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, label, score],
            )

    return map_arrow(docs.select(*map(named, names)), run, extended(kept, **{label: "string", score: "double"}))


def label_all(docs: DataFrame, model: LanguageModel, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, first_word, end_word, lang)``: a row for each span of a text in one language (words from 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = shared.value.label_spans(t) if t else []
                at += [i] * len(found)
                spans += found
            first, end, lang = zip(*spans) if spans else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(lang, pa.string())],
                names=["doc_id", "first_word", "end_word", "lang"],
            )

    kind = docs.schema[row_id].dataType.simpleString()
    return map_arrow(docs.select(named(row_id), named(text)), run, f"doc_id {kind}, first_word bigint, end_word bigint, lang string")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
