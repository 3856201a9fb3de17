"""Corpus operators on small tables, against brute force and with awkward rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import decontam, langid, licenses, mixing, ngram_lm, simhash, spans, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed string, score string, fp string, row int, place int"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]), with extra columns whose names clash with the operators' own."""
    full = [(*r, *([None] * (4 - len(r))), None, "keep", "keep", "keep", 1, 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n, words):
    out = []
    for _ in range(n):
        k = rng.randint(4, 10)
        out.append(" ".join(rng.choice(words) for _ in range(k)).capitalize() + ".")
    return " ".join(out)


WORDS = [a + b for a in ("ka", "lo", "mi", "re", "su", "ta", "vo", "ne") for b in ("n", "rt", "ss", "l", "ma", "pi", "do", "")]
ODD = [(None, None), (None, ""), (900, None), (901, ""), (902, " \n\t "), (903, "x"), (904, "... !!!"), (905, "w " * 30_000)]


# op1


def brute_spans(rows):
    first, cut = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        _, words = spans.sentences((text or "").encode())
        for i in range(len(words)):
            j, n = i, 0
            while j < len(words) and (j - i < spans.RUN or n < spans.MIN_WORDS):
                n += len(words[j])
                j += 1
            if j - i >= spans.RUN and n >= spans.MIN_WORDS:
                key = tuple(map(tuple, words[i:j]))
                if first.setdefault(key, (doc, i)) != (doc, i):
                    cut.setdefault(doc, set()).update(range(i, j))
    return cut


def test_spans_against_brute_force(spark):
    rng = random.Random(1)
    passage = prose(rng, 9, WORDS)
    rows = [(i, prose(rng, 12, WORDS)) for i in range(30)]
    for i in (3, 7, 11):  # pasted mid-sentence
        rows[i] = (i, rows[i][1][:97] + " " + passage + " " + rows[i][1][97:])
    rows[20] = (20, rows[20][1] + "\n" + passage + "\n" + passage)
    rows[21] = (21, rows[5][1])
    want = brute_spans(rows)
    got = {r["doc_id"]: r for r in spans.dedup(docs(spark, rows)).collect()}
    assert {d: len(c) for d, c in want.items()} == {d: r["n_removed"] for d, r in got.items() if r["n_removed"]}
    assert got[3]["text"] == rows[3][1] and got[21]["text"] == "" and got[0]["text"] == rows[0][1]
    inner = passage[len(passage) // 3 : 2 * len(passage) // 3]
    assert [d for d, r in got.items() if inner in r["text"]] == [3]
    assert got[7]["fp"] == "keep" and got[7]["row"] == 1


def test_spans_odd_rows(spark):
    rng = random.Random(2)
    text = prose(rng, 10, WORDS)
    rows = [*ODD, (1, text), (1, text), (2, "ä " + text)]
    got = spans.dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["text"] is None and by[901]["text"] == "" and by[902]["text"] == " \n\t "
    assert all(r["text"] == text for r in got if r["doc_id"] == 1)  # one document, twice
    assert 0 < by[2]["n_removed"] < by[2]["n_sentences"]
    assert spans.dedup(docs(spark, [])).count() == 0


def test_runs_do_not_depend_on_their_place():
    rng = random.Random(3)
    text = prose(rng, 20, WORDS).encode()
    _, words = spans.sentences(text)
    h, end = spans.runs(words)
    again, _ = spans.runs(words[5:])
    assert (h[5:] == again).all() and len(set(h.tolist())) == len(h)
    stops, _ = spans.sentences(text)
    assert b"".join(text[a:b] for a, b in zip([0, *stops], stops)) == text


def test_every_passage_of_51_words_is_found():
    rng = random.Random(5)

    def text(n, stop):
        return " ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" + ("." if rng.random() < stop else "") for _ in range(n))

    for _ in range(600):
        passage = text(51, rng.choice([0, 0.07, 0.15]))
        a, b = ({*spans.runs(spans.sentences(f"{text(30, s)} {passage} {text(30, s)}".encode())[1])[0].tolist()} for s in (rng.random() / 5, rng.random() / 5))
        assert a & b
    han = "".join(chr(0x4E00 + rng.randrange(5_000)) + ("\u3002" if i % 17 == 16 else "") for i in range(60))
    a, b = ({*spans.runs(spans.sentences(f"{x}{han}{x}".encode())[1])[0].tolist()} for x in ("\u4e00\u4e8c", "\u4e09"))
    assert a & b


# op2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_myers_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        m = rng.randint(1, 70)
        p, t = [rng.randint(0, 5) for _ in range(m)], [rng.randint(0, 5) for _ in range(rng.randint(1, 90))]
        got = decontam.myers(decontam.bits_of(p), m, t)
        column = list(range(m + 1))  # the best passage may start anywhere
        for k, c in enumerate(t):
            last, column[0] = column[0], 0
            for i in range(1, m + 1):
                last, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, last + (p[i - 1] != c))
            assert got[k] == column[m]


def test_leaks_within_the_budget(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(25))) for i in range(6)]
    fill = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for d in range(40):
        item, edits = items[d % 6], d % 9
        w = item[1].upper().split()
        for e in rng.sample(range(25), edits):
            w[e] = "changed"
        if d % 2:
            del w[0:1]
        rows.append((d, fill(30) + ". " + ", ".join(w) + "\n" + fill(10)))
        found = decontam.words_of(rows[-1][1])
        target = decontam.words_of(item[1])
        best = min(edit_distance(target, found[i : i + n]) for i in range(len(found)) for n in range(20, 31))
        if best <= decontam.budget(25):
            want[d, item[0]] = best
    got = decontam.matches(docs(spark, [*rows, *ODD]), spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id bigint, text string"), block_items=4)
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got.collect()} == want
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontam.decontaminate(docs(spark, [*rows, *ODD]), bench)
    assert kept.count() == len(rows) + len(ODD) - len(want) and kept.columns == docs(spark, []).columns
    assert decontam.matches(docs(spark, []), bench).count() == 0
    assert decontam.matches(docs(spark, rows), bench.limit(0)).count() == 0


def test_a_place_is_reported_exactly(spark):
    item = "one two three four five six seven eight nine ten"
    text = "zero zero one two three FOUR five six sevn eight nine ten end end"
    got = decontam.matches(docs(spark, [(1, text), (2, text + " " + text)]), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["edits"]) for r in got) == [(1, 2, 12, 1), (2, 2, 12, 1), (2, 16, 26, 1)]


# op3


def test_lm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 3_000)
    rng = random.Random(6)
    rows = [*((i, prose(rng, 8, WORDS)) for i in range(60)), *((100 + i, "Again AGAIN the same words here") for i in range(20)), *ODD[:5]]
    f = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    part = ngram_lm.fold("doc_id", 5)
    out = ngram_lm.score(docs(spark, rows), part != 1, part == 2).collect()
    assert len(out) == len(rows)
    toks = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]

    def counts(keep):
        c1, c2 = collections.Counter(), collections.Counter()
        for i, w in toks:
            if keep(f(i)):
                c1.update(w)
                c2.update(zip([b""] + w[:-1], w))
        return c1, c2, sum(c1.values()), len(c1)

    c1, c2, n, v = counts(lambda x: x != 1)
    r1, r2, rn, rv = counts(lambda x: x not in (1, 2))
    # EM by hand on the held-out fold
    bucket = lambda c: c.bit_length()
    data = collections.defaultdict(list)
    for i, w in toks:
        if f(i) == 2:
            for a, b in zip([b""] + w[:-1], w):
                p1 = (r1[b] + 0.5) / (rn + 0.5 * (rv + 1))
                data[bucket(r1[a])].append((r2[a, b] / r1[a] if r1[a] else 0.0) / p1)
    weight = {}
    for k, ratios in data.items():
        x = 0.0 if k == 0 else 0.5
        for _ in range(400):
            x = sum(x * r / (x * r + 1 - x) for r in ratios) / len(ratios)
        weight[k] = min(x, 1 - 1e-6)
    for k in range(1, 20):  # a bucket that the held-out fold lacks takes after the rarer one
        weight.setdefault(k, weight.get(k - 1, 0.0))
    want = collections.defaultdict(list)
    for i, w in toks:
        base = total = 0.0
        for a, b in zip([b""] + w[:-1], w):
            p1 = (c1[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p1)
            x = weight.get(bucket(c1[a]), 0.0)
            total += math.log10(x * (c2[a, b] / c1[a] if c1[a] else 0.0) + (1 - x) * p1)
        want[i].append((len(w), sum(c1[x] > 0 for x in w), base, total))
    for r in out:
        same = [x for x in want[r["doc_id"]] if x[0] == r["n_tokens"] and abs(x[2] - r["base_score"]) < 1e-9]
        assert same and same[0][1] == r["n_known"] and r["train_tokens"] == n and r["held_out"] == (f(r["doc_id"]) == 1)
        assert r["score"] == pytest.approx(same[0][3], rel=2e-3)  # EM works on binned ratios
    for limit in (0, 10):  # with a step between, and groups of two blocks
        monkeypatch.setattr(ngram_lm, "ROWS", limit)
        monkeypatch.setattr(ngram_lm, "STEPS", 3)
        monkeypatch.setattr(ngram_lm, "GROUP", 2)
        again = ngram_lm.score(docs(spark, rows).repartition(3), part != 1, part == 2).collect()
        key = lambda x: (str(x["doc_id"]), round(x["base_score"], 9), round(x["score"], 3))
        assert sorted(map(key, again)) == sorted(map(key, out)) and {x["train_tokens"] for x in again} == {n}
    assert ngram_lm.score(docs(spark, []), part != 1, part == 2).count() == 0
    only_held_out = ngram_lm.score(docs(spark, [(1, "a b")]), F.lit(False), F.lit(False)).first()
    assert (only_held_out["train_tokens"], only_held_out["n_known"]) == (0, 0)


def test_packing_round_trip():
    rng = np.random.default_rng(7)
    x = np.sort(rng.integers(0, 1 << 56, 1_000).astype(np.uint64))
    assert (ngram_lm.unpack(ngram_lm.pack(x, True), True) == x).all()
    assert len(ngram_lm.unpack(ngram_lm.pack(x[:0], True), True)) == 0
    y = np.exp(rng.normal(0, 8, 500))
    assert np.allclose(ngram_lm.restored(ngram_lm.rounded(y)), y, rtol=1 / 16_000) and len(ngram_lm.restored(ngram_lm.rounded(y[:0]))) == 0


# op4


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 12), WORDS), None, rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(500, "one tiny source", None, "z"), (501, None, None, "empty"), (502, "", None, "a"), (502, "w " * 40, None, "a"), (7, rows[7][1], None, rows[7][3]), (None, "no id here", None, "b")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    sizes = collections.Counter()
    for i, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 24 + 0.03 * target[s]
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_plan_takes_each_block_once_a_pass(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 30, WORDS), None, "ab"[i % 2]) for i in range(60)]
    sizes = mixing.measured(docs(spark, rows))
    goals = mixing.targets(sizes)
    plan = mixing.plan(mixing.stream(sizes, goals), goals)
    slots = plan.select("place", "slot", "block").distinct().join(goals.select("place", "blocks"), "place").withColumn("pass", F.expr("slot div blocks"))
    assert slots.groupBy("place", "pass", "block").count().where("count > 1").count() == 0
    assert plan.groupBy("place", "slot").agg(F.sum("n_words").alias("n")).where(f"n > {mixing.BLOCK}").count() == 0


def test_permutations_are_permutations_and_even(spark):
    for n in (1, 2, 3, 5, 16, 97, 1_000, 20_002):
        rows = spark.range(n).withColumn("n", F.lit(n).cast("bigint"))
        got = [r["y"] for r in mixing.permute(rows, F.col("id"), F.col("n"), F.lit("a key"), "y").orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        if n > 10_000:  # what a pass that ends after a quarter has taken is spread over the whole
            part = np.bincount(np.array(got[: n // 4]) * 10 // n, minlength=10)
            assert (np.abs(part - n / 40) < 5 * (n / 40) ** 0.5).all()
            assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.03 and len(set(np.diff(got).tolist())) > n / 3


def test_shard_counts_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    slots = [700, 200, 90, 10]
    rows = [(k, n, sum(slots[:k]), 1_000) for k, n in enumerate(slots)]
    goals = spark.createDataFrame(rows, "place bigint, slots bigint, slots_before bigint, all_slots bigint")
    got = mixing.shard_counts(goals).orderBy("place", "shard").collect()
    by_shard, seen = collections.Counter(), collections.Counter()
    for r in got:
        assert r["first"] == seen[r["place"]]  # slots are numbered along the shards
        seen[r["place"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert [seen[k] for k in range(4)] == slots and set(by_shard.values()) == {50} and len(by_shard) == 20
    n0 = [r["n"] for r in got if r["place"] == 0]
    assert 1 < np.var(n0) < 25  # 50 * 0.7 * 0.3 * 950 / 999 = 10 are expected


def test_mix_takes_any_ids_and_many_copies(spark):
    rows = [("id-%d" % (i % 7), "w " * (i % 40 + 1), "a") for i in range(300)] + [("copy", "these words again " * 9, "a")] * 400 + [(None, "w " * (i % 5), "b") for i in range(50)]
    df = spark.createDataFrame(rows, "`a.id` string, text string, source string").repartition(6)
    got = mixing.mix(df, row_id="a.id").collect()
    assert len(got) == len(rows) and sum(r["taken"] for r in got if r["source"] == "b") == 3 * sum(i % 5 for i in range(50))
    again = mixing.mix(df.repartition(3), row_id="a.id").collect()
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, again))
    assert 100 < sum(r["taken"] > 0 for r in got if r["doc_id"] == "copy") <= 400


# op5


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_brute_force(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, prose(rng, 3, WORDS)) for i in range(60)]
    for i in range(60, 120):
        w = rows[i % 20][1].split() * 12
        w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    rows += [*ODD, (5, rows[5][1]), (300, rows[5][1].upper())]
    want = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = {f: f for _, f in want}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in want:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    expected = sorted((str(i), f, str(least.get(find(f)))) for i, f in want)
    for rows_in_a_group in (2_048, 3):  # and with every group dealt out again
        monkeypatch.setattr(simhash, "GROUP_ROWS", rows_in_a_group)
        got = simhash.components(docs(spark, rows)).collect()
        assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == expected
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert len(kept) == len({find(f) for _, f in want}) and {r["doc_id"] for r in kept} == {least.get(find(f)) for _, f in want}
    assert simhash.components(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_trie_join_is_exact():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 40, 40)
    x = np.unique(np.concatenate([base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 40, (8, 2))])).astype(np.uint64)
    i, j = simhash.trie_pairs(x, np.zeros(len(x), int), 40)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a] ^ x[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) and want


# op6


def toxic_corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        s = [" ".join(rng.choice(WORDS) for _ in range(7)) + "." for _ in range(rng.randint(1, 12))]
        if bad:
            at = rng.randrange(len(s))
            s[at] = "You " + rng.choice(["vilify", "vilified", "grubby"]) + " " + s[at]
        rows.append((i, " ".join(s)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_corpus(random.Random(12), 800)
    d, lab = docs(spark, [*rows, *ODD]), spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(d.where("doc_id < 600"), lab)
    out = toxicity.predict(d, model)
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert out.count() == len(rows) + len(ODD) and out.columns[-4:] == ["score", *toxicity.FOUND] and all(0 <= x <= 1 for x in got.values())
    hit = sum((got[i] >= 0.5) == bool(t) for i, _, t in labels if i >= 600)
    assert hit / 200 > 0.97
    text = "Kan lort misse. " * 5 + "You vilify kan. Lort misse."
    assert [s for s, _ in model.locate(text)] == [5]
    assert toxicity.sentences_of(text)[5] == "You vilify kan."
    assert got[900] == got[901] == 0.0
    found = {r["doc_id"]: r for r in out.collect()}
    located = collections.defaultdict(list)
    for r in toxicity.locate_all(d.withColumnRenamed("row", "sentence"), model).collect():
        located[r["doc_id"]].append((r["sentence_no"], r["sentence_text"]))
    for i, t in rows:
        mine = [(k, x) for k, x in enumerate(toxicity.sentences_of(t)) if toxicity.fold_words(x) & {"vilify", "vilified", "grubby"}]
        assert found[i]["n_flagged"] == len(located[i]) and (not mine or found[i]["worst_sentence"] in [k for k, _ in located[i]] or found[i]["n_flagged"] == 0)
        if i >= 600 and mine and found[i]["n_flagged"]:
            assert set(mine) <= set(located[i])


def test_noisy_or_against_its_definition():
    rng = random.Random(21)
    rows, labels = toxic_corpus(rng, 300)
    model = toxicity.fit([t.encode() for _, t in rows], np.array([y for _, _, y in labels]))
    score, n_flagged, worst, chance = model.judge([t.encode() for _, t in rows])
    for k, (_, t) in enumerate(rows):
        p = []
        for x in toxicity.sentences_of(t):
            logit = model.bias + sum(model.weight.get(f, 0.0) for w in toxicity.fold_words(x) for f in toxicity.features_of(w.encode()))
            p.append(1 / (1 + math.exp(-logit)))
        assert score[k] == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-9) and n_flagged[k] == sum(x >= 0.5 for x in p)
        if max(p) > 1 / (1 + math.exp(-model.bias)) + 1e-9:
            assert p[worst[k]] == pytest.approx(max(p)) and chance[k] == pytest.approx(max(p))


def test_repeated_rows_do_not_swell_the_training_sample(spark):
    rows, labels = toxic_corpus(random.Random(22), 60)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    once = toxicity.train(docs(spark, rows), lab)
    many = toxicity.train(docs(spark, rows + rows[:1] * 500), lab)
    assert once.weight == pytest.approx(many.weight)


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a b."), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.predict(d, toxicity.train(d, none)).collect()} == {0.0}
    assert toxicity.predict(docs(spark, []), toxicity.train(d, none)).count() == 0


# op7


def brute_places(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for label, phrase in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), out


def test_license_places(spark):
    texts = [
        "Released under the MIT License. mit-license, MIT LICENSE", "GNU general public license! apache license cc by gnu general public licenses", "cc by cc by", "CC-BYé ccé by",
        "This work is licensed under the GNU very General Public License, version 3.", "nothing at all", "license", "mit", "All rights reserved.",
        "x " * 5_000 + "Apache License " + "y " * 5_000, "Permission is hereby granted, free of charge, to any person obtaining copies of this software and its associated documentation files",
    ]
    rows = [*enumerate(texts), *ODD, (0, texts[0]), (None, texts[1])]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        n, places = brute_places(t)
        at = [p for p, _ in places]
        want[i, n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[4]["labels"] == "gpl-3" and 0.6 <= by[4]["score"] < 1 and by[8]["labels"] == "all-rights-reserved" and by[10]["labels"] == "mit-text"
    assert by[5]["score"] == 0 and by[5]["labels"] == "" and by[5]["first_word"] is None
    assert licenses.scan(docs(spark, [])).count() == 0


# op8


LANGS = {"aa": ["kan", "lort", "misse", "the", "then"], "bb": ["żółć", "łąka", "ćma", "węże", "się"], "cc": ["привет", "мир", "это", "слово", "да"]}


def test_language_spans_and_odd_rows(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice(LANGS[x]) for _ in range(rng.randint(5, 40))), x) for i in range(300) for x in [rng.choice(list(LANGS))]]
    d = docs(spark, [*rows, (950, "hello", None), *((i, t, "aa") for i, t in ODD)])
    model = langid.train(d.where("doc_id < 200"))
    assert model.langs == ["aa", "bb", "cc"]
    out = langid.predict(d, model).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) + 1 + len(ODD) and got[1]["row"] == 1
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows if i >= 200) >= 98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 904)) and got[905]["lang_pred"] in LANGS
    mixed = "kan lort misse the then kan lort привет мир это слово да это мир żółć łąka ćma węże się łąka"
    assert model.label_spans(mixed) == [(0, 7, "aa"), (7, 14, "cc"), (14, 20, "bb")]
    spans_ = langid.label_all(docs(spark, [(1, mixed), (2, None), (3, "123")]), model).orderBy("first_word").collect()
    assert [tuple(r) for r in spans_] == [(1, 0, 7, "aa"), (1, 7, 14, "cc"), (1, 14, 20, "bb")]
    assert langid.predict(docs(spark, []), model).count() == 0
    empty = langid.train(docs(spark, [(1, "text", None)]))
    assert langid.predict(d, empty).where("lang_pred <> 'und'").count() == 0


def brute_language(model, text):
    """Words, their scores, the best path and the result, one character and one path at a time."""
    import itertools
    import unicodedata

    mask, starts = (1 << 32) - 1, [a for a, _ in langid.SCRIPT_STARTS]
    words = ["".join(g) for inside, g in itertools.groupby(text.lower(), lambda c: unicodedata.category(c)[0] in "LM") if inside]
    scores, letters = [], []
    for w in words:
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
        scores.append(total / 2 - 100.0 * ~model.allowed[script])
        letters.append(sum(unicodedata.category(x)[0] == "L" for x in w))
    if not sum(letters):
        return "und", 0.0
    best = max(itertools.product(range(len(model.langs)), repeat=len(words)), key=lambda p: sum(s[k] for s, k in zip(scores, p)) - model.switch * sum(a != b for a, b in zip(p, p[1:])))
    share = [sum(x for x, k in zip(letters, best) if k == j) for j in range(len(model.langs))]
    top = max(range(len(share)), key=share.__getitem__)
    own = sum(s for s, k in zip(scores, best) if k == top)
    return model.langs[top], 1 / sum(math.exp(max(-700, min(50, x - own[top]))) for x in own) * share[top] / sum(letters)


def test_languages_against_brute_force(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(LANGS[x]) for _ in range(20)), x) for i, x in enumerate(["aa", "bb", "cc"] * 20)]
    model = langid.train(docs(spark, rows))
    texts = ["", "12 !", "kan", "the ćma 7 мир", "kan lort misse привет мир это", "żółć łąka, węże; then", "x-y zażółć", "мир the слово"]
    for _ in range(25):
        texts.append(" ".join(rng.choice(LANGS[rng.choice("abc") * 2]) for _ in range(rng.randint(1, 7))))
    names, values = model.predict([t.encode() for t in texts])
    for t, name, value in zip(texts, names, values):
        want = brute_language(model, t)
        assert name == want[0] and value == pytest.approx(want[1], rel=1e-6, abs=1e-9), t


def test_constant_path_is_the_viterbi_path():
    rng = np.random.default_rng(14)
    model = langid.LanguageModel(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), switch=6.0)
    for n in (1, 2, 30):
        for _ in range(60):
            s = rng.normal(0, 2, (n, 3)) + rng.normal(0, 1, 3)
            value = lambda p: s[np.arange(n), p].sum() - 6.0 * (np.diff(p) != 0).sum()
            assert value(model.spans(s)) == pytest.approx(value(langid._viterbi(s, 6.0)))


# names and ids


def test_awkward_names_and_ids(spark):
    rng = random.Random(20)
    text, leak = prose(rng, 9, WORDS), " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(25))
    rows = [("a", text), ("b", text), (None, text), (None, leak), ("c", leak + " " + text[:40]), ("c", leak + " " + text[:40]), ("d", None)]
    names = ["__row", "__id", "__n", "__starts", "__leak", "a.b", "fp", "row", "__KEY"]
    df = spark.createDataFrame([(*r, *("x" * (k + 1) for k in range(len(names)))) for r in rows], f"`doc.id` string, text string, {', '.join(f'`{n}` string' for n in names)}")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", leak, "too short", leak])], "item_id bigint, text string")
    outs = {
        "cut": spans.dedup(df, row_id="doc.id"), "one": simhash.keep_one(df, row_id="doc.id"), "clean": decontam.decontaminate(df, bench, row_id="doc.id"),
    }
    got = {k: v.collect() for k, v in outs.items()}
    assert [len(got[k]) for k in outs] == [7, 4, 4]
    for k, v in outs.items():
        assert v.columns[: len(df.columns)] == df.columns or k == "cut"
        assert all(r["__row"] == "x" and r["a.b"] == "x" * 6 and r["__leak"] == "x" * 5 for r in got[k])
    assert {r["doc.id"]: r["text"] for r in got["cut"] if r["text"] == text} == {None: text}  # a null id sorts first
    found = decontam.matches(df, bench, row_id="doc.id", block_items=1).collect()
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in found) == {(None, 2): 1, (None, 4): 1, ("c", 2): 2, ("c", 4): 2}
    assert licenses.scan(df, row_id="doc.id").count() == 7 and len(simhash.components(df, row_id="doc.id").collect()) == 7


def test_leak_words_of_other_scripts():
    assert decontam.words_of("Größe „quoted“ — x_y") == ["größe".encode(), b"quoted", b"x", b"y"]
    assert decontam.words_of("Plain, ASCII_text!") == [b"plain", b"ascii", b"text"] and decontam.words_of(None) == []
