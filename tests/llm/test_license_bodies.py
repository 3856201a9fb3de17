"""Bodies of licenses: labels and scores against a plain count, on copies with cuts, insertions and other text around."""

import random
import re

from graphloom.llm import licenses
from graphloom.llm.license_texts import BODIES


def plain_labels(text):
    w = re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    by = {}
    for t, label, base, k, grams, q, gram in licenses.templates():
        by.setdefault((t, label, base, k, grams), []).append((q, gram.split(" ")))
    found = {}
    for (_, label, base, k, grams), own in by.items():
        diagonals = {}
        for p in range(len(w) - k + 1):
            for q, gram in own:
                if w[p : p + k] == gram:
                    diagonals.setdefault(p - q, set()).add(q)
        spans, last = [], None
        for d in sorted(diagonals):
            if base:
                spans.append(diagonals[d] if len(diagonals[d]) == grams else set())
            elif last is not None and d - last <= max(licenses.NEAR, grams // licenses.NEAR_SHARE):
                spans[-1] = spans[-1] | diagonals[d]
            else:
                spans.append(set(diagonals[d]))
            last = d
        cover = max((len(s) / grams for s in spans), default=0)
        if cover == 1 if base else cover >= licenses.COVER:
            found[label] = cover
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def test_bodies(spark):
    rng = random.Random(41)
    fill = lambda n: " ".join(rng.choice("some other words that stand around it in any file of code".split()) for _ in range(n))
    rows, named = [], {}
    for label, body in BODIES:
        w = body.split()
        cases = [body, " ".join(w[12:]), " ".join(w[: len(w) // 2]), body.replace("copyright holder", "the regents of some university press").replace("THE AUTHORS", "JANE Q PUBLIC AND FRIENDS")]
        cut = list(w)
        for at in sorted(rng.sample(range(len(w)), len(w) // 25), reverse=True):
            cut[at : at + 1] = rng.choice([[], ["odd"], [cut[at], "odd"]])
        cases += [" ".join(cut), " ".join(rng.sample(w, len(w))), fill(40) + "\n" + body + "\n" + fill(40) + body]
        for kind, text in enumerate(cases):
            named[len(rows)] = label, kind
            rows.append((len(rows), fill(rng.randint(0, 9)) + " " + text))
    rows += [(1000, None), (1001, ""), (1002, fill(200))]
    docs = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id bigint, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, text in rows:
        labels, score = plain_labels(text)
        assert (got[i]["labels"], round(got[i]["score"], 9)) == (labels, round(score, 9)), (i, named.get(i))
    for i, (label, kind) in named.items():
        if kind in (0, 1, 3, 4, 6):  # whole, without its first words, with another holder, with changes, twice among other text
            assert label in got[i]["labels"].split(","), (label, kind)
        if kind == 5:
            assert label not in got[i]["labels"].split(",")
