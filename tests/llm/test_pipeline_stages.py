"""Every stage of the pipeline against a plain version of it, on whole given tables."""

import itertools
import math
import os
import unicodedata

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import decontam, langid, mixing, spans

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain_language(model, text):
    """One character and one word at a time, and the usual Viterbi recursion: label and its share."""
    mask, starts = (1 << 32) - 1, [a for a, _ in langid.SCRIPT_STARTS]
    words = ["".join(g) for inside, g in itertools.groupby(text.lower(), lambda c: unicodedata.category(c)[0] in "LM") if inside]
    letters = [sum(unicodedata.category(x)[0] == "L" for x in w) for w in words]
    if not sum(letters):
        return "und", 0.0
    known = {}
    for w in set(words):
        total, c = np.zeros(len(model.langs)), [32, *map(ord, w), 32]
        for n in langid.ORDERS:
            for i in range(len(c) - n + 1):
                if n == 1 and i in (0, len(c) - 1):
                    continue
                h = c[i] * 0x9E3779B1 & mask
                for k in range(2, n + 1):
                    h = (h ^ c[i + k - 1] + k) * 0x85EBCA6B & mask
                    h ^= h >> 15
                total += model.weight[(h * 0xC2B2AE35 & mask) >> 32 - langid.BITS]
        script = langid.SCRIPT_STARTS[max(k for k, a in enumerate(starts) if a <= ord(w[0]))][1]
        known[w] = total / 2 - 100.0 * ~model.allowed[script]
    value, back = known[words[0]], []
    for w in words[1:]:
        top = int(value.argmax())
        move = value.max() - model.switch > value
        back.append([top if m else k for k, m in enumerate(move)])
        value = np.maximum(value, value.max() - model.switch) + known[w]
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(step[path[-1]])
    path.reverse()
    share = [sum(x for x, k in zip(letters, path) if k == j) for j in range(len(model.langs))]
    top = max(range(len(share)), key=share.__getitem__)
    own = sum(known[w] for w, k in zip(words, path) if k == top)
    return model.langs[top], 1 / sum(math.exp(max(-700, min(50, x - own[top]))) for x in own) * share[top] / sum(letters)


def bits(text):
    from test_text_operators import brute_fingerprint

    return brute_fingerprint(text)


def one_of_each(rows):
    prints = [bits(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return set(least.values())


def without_repeats(rows):
    from test_text_operators import brute_spans

    gone = brute_spans([(r["doc_id"], r["text"]) for r in rows])
    out = {}
    for r in rows:
        if r["doc_id"] not in gone:
            out[r["doc_id"]] = r["text"]
            continue
        raw = (r["text"] or "").encode()
        stops, _ = spans.sentences(raw)
        left = b"".join(raw[a:b] for k, (a, b) in enumerate(zip([0, *stops], stops)) if k not in gone[r["doc_id"]]).rstrip().decode()
        if left:
            out[r["doc_id"]] = left
    return out


def least_edits(item, text):
    """Word edits of a whole item against its best passage, one row of the table at a time."""
    row, at = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, x in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != x)]))
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def test_every_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        assert len(before) == docs.count()  # ids are unique here
        out = corpus_pipeline.materialise(stage(spark, docs, DIR), name)
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == out.count()
        if name == "language_id":
            model = langid.train(docs)
            found = {k: plain_language(model, r["text"] or "") for k, r in before.items()}
            assert set(got) == {k for k, (label, s) in found.items() if label != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE}
        elif name == "simhash_near_dedup":
            assert set(got) == one_of_each(list(before.values()))
        elif name == "substring_dedup":
            assert {k: r["text"] for k, r in got.items()} == without_repeats(list(before.values()))
            assert all(r["n_chars"] == len(r["text"]) for k, r in got.items() if r["text"] != before[k]["text"])
        elif name == "decontamination":
            number: dict = {}
            coded = [[number.setdefault(w, len(number)) for w in decontam.words_of(x["text"])] for x in items]
            texts = {k: np.array([number.get(w, -1) for w in decontam.words_of(r["text"])]) for k, r in before.items()}
            leaks = {k for k, t in texts.items() if any(c and least_edits(c, t) <= decontam.budget(len(c)) for c in coded)}
            assert set(got) == set(before) - leaks and leaks
        else:
            con = duckdb.connect()
            con.register("documents", docs.toPandas())
            want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP4_SQL})").fetchall()
            assert sorted(tuple(r[c] for c in ("doc_id", "size", "source_size", "taken")) for r in got.values()) == sorted((a, b, c, e) for a, b, c, _, e in want)
        if name != "mixing":
            assert out.columns == docs.columns and all(tuple(r) == tuple(before[k]) for k, r in got.items() if r["text"] == before[k]["text"])
        docs = out
