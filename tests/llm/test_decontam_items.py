"""Decontamination with short items and with items that share most of their words, against plain edit distance."""

import random
import time

import numpy as np
import pytest

from graphloom.llm import decontam

WORDS = [a + b for a in "bdfgklmnprstvz" for b in ("al", "en", "ir", "os", "um")]
PROMPT = "what is the answer to the following question about"


def least_edits(item, text):
    """Of any passage of a text against a whole item: the fewest word edits (textbook recursion)."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + (kind != 1)] = [] if kind == 0 and len(w) > 1 else [rng.choice(WORDS)]
    return w


@pytest.mark.parametrize("shared", [8, 0])
def test_short_and_prompt_like_items(spark, monkeypatch, shared):
    monkeypatch.setattr(decontam, "SHARED", shared)
    rng = random.Random(21)
    items = [(i, f"{PROMPT} " + " ".join(rng.choices(WORDS, k=rng.randint(3, 14)))) for i in range(60)]
    items += [(100 + n, " ".join(rng.sample(WORDS, n))) for n in (1, 2, 3, 4, 4, 4)] + [(200, ""), (201, "?!"), (202, items[0][1])]
    texts = []
    for k in range(160):
        w = rng.choices(WORDS, k=rng.randint(0, 20))
        source = rng.choice(items)[1].split()
        if k % 2 and source:
            at = rng.randint(0, len(w))
            w[at:at] = edited(rng, source, rng.randint(0, 5))
        if k % 5 == 0:
            w[0:0] = PROMPT.split()
        texts.append((k, " ".join(w)))
    want = {}
    for k, t in texts:
        for i, item in items:
            m = len(decontam.words_of(item))
            if m and (best := least_edits(item.split(), t.split())) <= decontam.budget(m) and item.strip("?!"):
                want[k, i] = best
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {}
    for r in decontam.matches(docs, bench, block_items=11).collect():
        key = r["doc_id"], r["item_id"]
        got[key] = min(r["edits"], got.get(key, 99))
    assert got == want and any(i >= 100 for _, i in want) and len(want) > 60
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {k for k, _ in texts} - {k for k, _ in want}


def test_a_shared_prompt_costs_little():
    rng = random.Random(22)
    names = [f"{a}{b}" for a in WORDS for b in range(60)]
    ordinary = [(i, " ".join(rng.choices(names, k=22))) for i in range(5_000)]
    alike = [(i, f"{PROMPT} " + " ".join(rng.choices(names, k=14))) for i in range(5_000)]
    texts = [" ".join([*rng.choices(names, k=60), PROMPT, *rng.choices(names, k=60)]) for _ in range(300)]

    def seconds(items):
        m = decontam.Matcher(items)
        coded = [np.array([m.vocab.get(w, 0) for w in decontam.words_of(t)], np.int64) for t in texts]
        started = time.process_time()
        for ids in coded:
            assert m.match(ids) == []
        return time.process_time() - started

    assert seconds(alike) < 4 * seconds(ordinary) + 0.3
