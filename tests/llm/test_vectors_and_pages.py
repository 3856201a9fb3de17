"""Nearest neighbours and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import ann

# op9


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score string")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3_000, 24)).astype(np.float32)
    x[100:400] = x[100]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5_000, None), (5_050, []), (5_100, [0.0] * 24), (5_150, [float("nan")] * 24), (5_200, [1.0, None] * 12), (5_250, [1.0] * 7), (None, [1.0] * 24)]
    out = ann.search(vectors(spark, [*rows, *odd]), F.col("id") % 50 == 0).toPandas()
    q = np.arange(0, 3_000, 50)
    s = x.astype(float)
    s /= np.linalg.norm(s, axis=1)[:, None]
    hits = 0
    for i in q:
        got = out[out["query_id"] == i].sort_values("rank")
        assert got["rank"].tolist() == [1, 2, 3, 4, 5] and i not in set(got["vec_id"])
        exact = s @ s[i]
        assert np.allclose(got["score"], exact[got["vec_id"]], atol=1e-12)
        exact[i] = -9
        best = np.lexsort((np.arange(3_000), -np.round(exact, 12)))[:5]
        hits += len(set(best) & set(got["vec_id"]))
    assert set(out["query_id"]) == set(q) and hits / (5 * len(q)) >= 0.9
    copies = out[out["query_id"] == 150].sort_values("rank")
    assert copies["vec_id"].tolist() == [100, 101, 102, 103, 104]


@pytest.mark.parametrize("shape", ["cone", "clusters"])
def test_recall_on_narrow_and_clustered_vectors(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6_000, 24))
    x = x / 20 + rng.normal(size=24) if shape == "cone" else x / 10 + rng.normal(size=(3, 24))[rng.integers(3, size=6_000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = ann.search(vectors(spark, rows), F.col("id") % 50 == 0).toPandas().groupby("query_id")["vec_id"].agg(set)
    s = x.astype(np.float32).astype(float)
    s /= np.linalg.norm(s, axis=1)[:, None]
    near = s[::50] @ s.T
    near[np.arange(120), np.arange(0, 6_000, 50)] = -9
    assert np.mean([len(got[50 * i] & set(np.argsort(-near[i])[:5])) / 5 for i in range(120)]) >= 0.9


def test_footrule_against_its_definition():
    rng = np.random.default_rng(7)
    index = ann.Index(rng.normal(size=(100, 8)), np.zeros(8))
    order = index.order(rng.normal(size=(20, 8)))
    heads, places = order[:, : index.prefix], index.places(order)

    def by_hand(a, b):
        n = index.prefix
        return sum(abs((a.index(p) if p in a else n) - (b.index(p) if p in b else n)) for p in {*a, *b})

    for i in range(20):
        assert ann.footrule(places[i], heads).tolist() == [by_hand(heads[i].tolist(), h.tolist()) for h in heads]


def test_the_index_saves_most_of_the_work(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 4))
    x = np.concatenate([c + rng.normal(size=(200, 4)) / 3 for c in centre]) @ rng.normal(size=(4, 32))
    chosen, inner = [], ann.settings

    def settings(posted, index, trials, k):
        chosen.append((*inner(posted, index, trials, k), len(index.pivots)))
        return chosen[-1][:2]

    monkeypatch.setattr(ann, "settings", settings)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = ann.search(vectors(spark, rows), F.col("id") % 50 == 0).toPandas().groupby("query_id")["vec_id"].agg(set)
    s = x.astype(np.float32).astype(float)
    s /= np.linalg.norm(s, axis=1)[:, None]
    near = s[::50] @ s.T
    near[np.arange(len(near)), np.arange(0, len(x), 50)] = -9
    assert np.mean([len(got[50 * i] & set(np.argsort(-near[i])[:5])) / 5 for i in range(len(near))]) >= 0.9
    probes, share, pivots = chosen[0]
    assert probes * ann.POSTED / pivots <= 0.2 and share < 1  # pairs touched, and those reranked


def test_few_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (0, [1.0, 0.0])]
    out = ann.search(vectors(spark, rows), F.col("id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in out] == [(2, 1.0), (1, 0.0), (3, -1.0)]
    assert ann.search(vectors(spark, []), F.col("id") == 0).count() == 0
    assert ann.search(vectors(spark, [(0, [1.0])]), F.col("id") == 0).count() == 0


def test_chunks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))]
    kw = {"probes": 64, "rerank": 1.0}
    one = sorted(map(tuple, ann.search(vectors(spark, rows), F.col("id") % 50 == 0, **kw).collect()))
    monkeypatch.setattr(ann, "CHUNK", 3)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 2)
    assert sorted(map(tuple, ann.search(vectors(spark, rows), F.col("id") % 50 == 0, **kw).collect())) == one


# the pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, d), name)
        if name != "mixing":
            assert out.columns == docs.columns
        n.append(out.count())
        docs = out
    assert n == sorted(n, reverse=True) and n[-1] == n[-2] > 100
    assert corpus_pipeline.run(spark, d).count() == n[-1]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
    rows = [(1, None, "en", "s", 0, "e"), (2, "", None, None, 0, "e"), (None, "some words stand here", "en", "s", 21, "e"), (4, "other words here again", "en", None, None, "e"), (4, "other words here again", "en", None, None, "e")]
    spark.createDataFrame([(1, "an item that nobody has copied anywhere")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert {r["doc_id"] for r in docs.collect()} == ({None, 4} if some else set())
        assert docs.count() == (2 if some else 0)
