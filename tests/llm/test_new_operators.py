"""Byte-level BPE, conversation repair and source divergence, against other implementations and with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from graphloom.llm import bytepair, divergence, turns

ALPHABET = "'''  \n\t\r  \x1c　stmdrevlaA1٣²!?.é中́😀ᲊ0\0'"


@pytest.fixture(scope="module")
def tokens():
    return bytepair.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(tokens):
    ranks = {t: i for i, t in enumerate(tokens) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(rng, n):
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", "'", " ", "  ", " '", "'re'll'd'x", "don't  stop", "w" * 5_000, "ab" * 3_000 + " " * 70, "\n\n\n x", "a \n" * 900]


def test_encoding_as_the_library(spark, tokens, library):
    texts = texts_of(random.Random(3), 3_000)
    rows = [(i, t, "x", 1) for i, t in enumerate([*texts, None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids_ string, `st.arts` int").repartition(3)
    coded = bytepair.encode(docs, tokens)
    back = bytepair.decode(coded, tokens)
    assert coded.columns == ["doc_id", "text", "ids_", "st.arts", "ids", "starts"]
    for r in back.collect():
        text = r["text"] or ""
        assert r["ids"] == library.encode_ordinary(text), text
        assert bytes(r["decoded"]) == text.encode()
        raw, stops = text.encode(), [*r["starts"][1:], len(text.encode())]
        assert [raw[a:b] for a, b in zip(r["starts"], stops)] == [tokens[i] for i in r["ids"]]


def test_every_code_point_has_the_pattern_class(tokens):
    """One piece or two, for each code point behind a letter, a number and another sign."""
    ranks = {bytes([i]): i for i in range(256)}
    for lead in b"a1!":
        for i in range(256):
            ranks.setdefault(bytes([lead, i]), len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds = bytepair.classes()
    for lo in range(0, 0x110000, 4_096):
        points = [c for c in range(lo, lo + 4_096) if not 0xD800 <= c < 0xE000]
        for lead, kind in (("a", bytepair.LETTER), ("1", bytepair.NUMBER), ("!", bytepair.OTHER)):
            n = [len(chr(c).encode()) for c in points]
            got = probe.encode_ordinary("\n".join(lead + chr(c) for c in points))
            want = sum(n) + len(n) + len(n) - 1 - sum(int(kinds[c] == kind) for c in points)
            assert abs(len(got) - want) <= (lo == 0) * 2, (hex(lo), lead)  # the separator itself is one of the first


def test_long_texts_are_cut_where_it_makes_no_difference(library, tokens):
    merges = bytepair._merges(tuple(tokens))
    for text in texts_of(random.Random(5), 300):
        parts = bytepair.windows(text * 6, 50)
        assert "".join(parts) == text * 6
        ids = list(itertools.chain.from_iterable(bytepair.encode_slice([p], merges)[0].tolist() for p in parts))
        assert ids == library.encode_ordinary(text * 6)


def test_cache_that_overflows(library, tokens, monkeypatch):
    monkeypatch.setattr(bytepair, "CACHE_PIECES", 10)
    merges = bytepair.Merges(tuple(tokens))
    for text in texts_of(random.Random(6), 200):
        assert bytepair.encode_slice([text], merges)[0].tolist() == library.encode_ordinary(text)


def test_decoding_of_unknown_ids(spark, tokens):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [10**6]), (4, []), (5, [-1]), (6, [5, None])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bytepair.decode(rows.coalesce(1), tokens).collect()}
    assert bytes(got[1]) == tokens[0] + tokens[1] and bytes(got[4]) == b"" and got[2] is got[3] is got[5] is got[6] is None


def test_op11_digests(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = bytepair.op11_byte_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


# op12


def edits(symbols, state_roles):
    """All edit strings of few turns with few inserts, by brute force: the cheapest, then the least."""
    best = None
    n = len(symbols)
    for extra in range(0, 4):
        for labels in set(itertools.permutations("I" * extra + "x" * n)) if n + extra <= 7 else ():
            for kinds in itertools.product("KRD", repeat=n):
                it = iter(kinds)
                audit = "".join("I" if x == "I" else next(it) for x in labels)
                cost, roles, at, ok = 0, "", 0, True
                for label in audit:
                    expected = "a" if roles.endswith("u") else "u"
                    if label == "I":
                        cost, roles = cost + 2, roles + expected
                        continue
                    role, fault = symbols[at]
                    at += 1
                    if label == "D":
                        cost += 3
                        continue
                    ok &= fault not in (turns.BLANK, turns.DUPLICATE)
                    cost += 2 * (label == "R") + (fault == turns.TRUNCATED)
                    roles += expected if label == "R" else role or "x"
                if ok and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_shortest_paths_against_all_edits():
    rng = random.Random(7)
    for _ in range(120):
        symbols = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 4))]
        got = turns.shortest(bytes(turns.symbol(r, f) for r, f in symbols))
        assert got == edits(symbols, None), symbols


CONV = "conv_id bigint, turn bigint, role string, text string, sym string, digest int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "keep", 1) for r in rows], CONV)


def plain(rows):
    """The operator on rows ``(conv, turn, role, text)``, without Spark."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(
            ((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv),
            key=lambda k: (*k[:3], hashlib.sha256(k[3].encode()).digest()),
        )
        seen, symbols, faults = set(), [], [0] * 4
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            symbols.append((role[:1], fault))
            faults[fault] += 1
        cost, audit = turns.shortest(bytes(turns.symbol(r, f) for r, f in symbols))
        made, it, last = [], iter(own), ""
        for label in audit:
            expected = "assistant" if last == "u" else "user"
            if label == "I":
                made.append((expected, ""))
            else:
                _, _, role, text = next(it)
                if label != "D":
                    made.append((role if label == "K" else expected, text))
            last = made[-1][0][:1] if made else ""
        known = [t for has, t, _, _ in own if has]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(symbols, symbols[1:]))
        joined = "\n".join(f"{r}:{x}" for r, x in made)
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, hashlib.sha256(joined.encode()).hexdigest()), made
    return out


ROWS = [
    (1, 0, "system", "Hi."), (1, 1, "user", "What?"), (1, 2, "assistant", "This."), (2, 0, "user", "a."), (2, 0, "user", "a."), (2, 5, "user", "a."),
    (3, None, "user", "x"), (3, None, None, None), (3, 2, "assistant", " \n"), (None, 1, "assistant", "ok."), (None, 2, "user", "ok."),
    (None, 2, "user", "ok."), (4, 1, "", "..."), (4, -3, "Assistant", "é. \t"), (5, 1, "user", None),
]


def test_repair_of_awkward_rows(spark):
    rng = random.Random(8)
    more = [(rng.randint(6, 40), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a.", "b", "c!", "", " ", "d?"])) for _ in range(400)]
    rows = ROWS + more
    frame = conversations(spark, rows)
    want = plain(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.audit(frame).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    made = {}
    for r in sorted(turns.repair(frame).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"])):
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert made == {k: v[1] for k, v in want.items() if v[1]}


def test_repair_of_one_large_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 3 == 0], f"turn {i % 4000}" + "." * (i % 5 > 0)) for i in range(12_000)]
    got = turns.audit(conversations(spark, rows)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {k: v[0] for k, v in plain(rows).items()}


def test_gone_rows_and_empty_table(spark):
    frame = conversations(spark, [(1, 0, "user", "a."), (2, 0, "user", "b.")])
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.audit(frame, gone=F.col("conv_id") == 1).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2][5:7] == (2, "KI")
    empty = frame.where("false")
    assert turns.audit(empty).count() == turns.repair(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "Well! So?") for c in range(40) for t in [None, *range(6)]]
    got = sorted((r["conv_id"], r["turn"] is not None, r["turn"] or 0, r["role"], r["text"], r["gone"]) for r in turns.damage(conversations(spark, rows)).collect())
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t is not None, t or 0, "user" if k == 4 else role, "" if k == 1 else "Well So" if k == 2 else text, k == 0)
        want += [row] * (2 if k == 3 else 1)
    assert got == sorted(want)


# op13


def test_divergence_against_sql(spark, monkeypatch):
    rng = random.Random(9)
    words = ["Alpha", "beta", "Élan", "élan", "x", "straße", "中文", "d'or", "a1b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", None, "s3"])) for i in range(400)]
    rows += [(500, None, None, None), (501, "", "zz", "a"), (502, "rare words", "zz", "b"), (503, "...", "yy", "a"), (503, "...", "yy", "a"), (None, "x " * 40_000, "en", "s1")]
    frame = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id bigint, text string, lang string, source string, term string, n int")
    monkeypatch.setattr(divergence, "SHARD_ROWS", 7)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 500)
    got = divergence.audit(frame.repartition(3))
    con = duckdb.connect()
    documents = frame.toPandas()
    con.register("documents", documents)
    columns = "lang, source, part, item, value, rank"
    want = con.execute(f"SELECT {columns} FROM ({divergence.OP13_SQL})").fetchall()
    assert len(want) > 50 and sorted(map(tuple, got.select(*columns.split(", ")).collect())) == sorted(want)
    assert {r["value"] for r in got.where("lang = 'zz'").collect()} == {0}
    assert divergence.audit(frame.where("false")).count() == 0
