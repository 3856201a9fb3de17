"""Files in and out, and the streaming job."""

import json
import random

from pyspark.sql import functions as F

from graphloom.operators import partitions, snapshots
from graphloom.sources import readers, writers
from graphloom.streaming import peaks


def pairs(df):
    return sorted((r["src"], r["dst"]) for r in df.collect())


def test_edge_lists(spark, tmp_path):
    (tmp_path / "h.txt").write_text("4 4\n1 2\n2  1\n\n3 3\n2 9\n3 4\n")
    v, e = readers.header_edges(spark, str(tmp_path / "h.txt"))
    assert [r["node"] for r in v.orderBy("node").collect()] == [1, 2, 3, 4] and pairs(e) == [(1, 2), (3, 4)]
    (tmp_path / "p.txt").write_text("# comment\n0,3\n3 0\n\n1\t2\n2 2\nx y\n")
    v, e = readers.plain_edges(spark, str(tmp_path / "p.txt"))
    assert v.count() == 4 and pairs(e) == [(0, 3), (1, 2)]
    assert pairs(readers.plain_edges(spark, str(tmp_path / "p.txt"), multigraph=True)[1]) == [(0, 3), (0, 3), (1, 2)]
    writers.edge_list(e, str(tmp_path / "out"))
    assert pairs(readers.plain_edges(spark, str(tmp_path / "out"))[1]) == [(0, 3), (1, 2)]
    (tmp_path / "empty.txt").write_text("")
    assert readers.plain_edges(spark, str(tmp_path / "empty.txt"))[0].count() == 0
    again, ids = writers.reindexed(spark.createDataFrame([(10, 30), (20, 30)], "src bigint, dst bigint"))
    assert pairs(again) == [(1, 3), (2, 3)]


def test_header_file_in_parts(spark, tmp_path):
    """Parts in the order of their names make one file; they and blocks break it between the ends of a pair, within the head too."""
    rng = random.Random(3)
    e = [(rng.randint(1, 500), rng.randint(1, 500)) for _ in range(3000)]
    want = sorted({(min(p), max(p)) for p in e if p[0] != p[1]})
    tokens = ["500", "3000", *(str(x) for p in e for x in p)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        for name, cuts in (("a", [1, 2, 5, 5, 1000, 1001]), ("b", [3, 4]), ("c", [2500])):
            (tmp_path / name).mkdir()
            for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(tokens)])):
                text = "".join(t + rng.choice(["\n", " ", "\t", "\n\n "]) for t in tokens[lo:hi])
                (tmp_path / name / f"part-{i:05d}").write_text(text)
            v, got = readers.header_edges(spark, str(tmp_path / name))
            assert pairs(got) == want and v.count() == 500
            few = readers.header_edges(spark, str(tmp_path / name), multigraph=True)[1]
            assert pairs(few) == sorted((min(p), max(p)) for p in e if p[0] != p[1])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "part-0").write_text("")
    v, got = readers.header_edges(spark, str(tmp_path / "empty"))
    assert v.count() == 0 and pairs(got) == []


def test_header_file_written_in_parallel(spark, tmp_path):
    """Every task writes its own part; the head stands first."""
    e = spark.range(1, 101, 1, 4).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    writers.header_edge_list(e, 101, str(tmp_path / "h"))
    parts = sorted(p for p in (tmp_path / "h").iterdir() if p.name.startswith("part-"))
    assert len(parts) > 2 and parts[0].read_text().split("\n")[0] == "101 100"
    assert pairs(readers.header_edges(spark, str(tmp_path / "h"))[1]) == [(i, i + 1) for i in range(1, 101)]


def test_plain_vertices_when_asked_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "BLOCK", 7)
    (tmp_path / "p.txt").write_text("0 3\n3 50\n")
    v, e = readers.plain_edges(spark, str(tmp_path / "p.txt"))
    assert sorted(r["node"] for r in v.collect()) == list(range(51)) and pairs(e) == [(0, 3), (3, 50)]
    (tmp_path / "p.txt").write_text("# none\n")
    assert readers.plain_edges(spark, str(tmp_path / "p.txt"))[0].collect() == []


def test_citations(spark, tmp_path):
    (tmp_path / "c").write_text("p1 0 1 0 ai\np2 1 0 0 db\np3 0 0 1 ai\n")
    (tmp_path / "l").write_text("p1 p2\np2 p1\np3 p3\np1 unknown\n")
    g = readers.citation_graph(spark, str(tmp_path / "c"), str(tmp_path / "l"))
    assert pairs(g["edges"]) == [(0, 1)]
    assert [(r["ext_id"], r["label_id"]) for r in g["vertices"].orderBy("node").collect()] == [("p1", 0), ("p2", 1), ("p3", 0)]
    assert g["features"].where("node = 1").first()["vector"] == [1.0, 0.0, 0.0]
    assert readers.citation_graph(spark, None, str(tmp_path / "l"))["vertices"].count() == 4


def test_clusters_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node bigint, cluster_id bigint")
    scores = spark.createDataFrame([(0, 2.5)], "cluster_id bigint, score double")
    rows = writers.clusters(p, scores)
    writers.clusters_json(rows, str(tmp_path / "json"), {"eps": "1"})
    back = partitions.last_wins(readers.clusters_json(spark, str(tmp_path / "json")))
    assert sorted(map(tuple, back.collect())) == [(1, 0), (2, 0), (3, 1)]
    (tmp_path / "m.json").write_text(json.dumps({"meta": {"a": "b"}, "clusters": [{"cluster_id": 7, "members": [4, 5]}]}))
    assert {r["cluster_id"] for r in readers.clusters_json(spark, str(tmp_path / "m.json")).collect()} == {7}
    writers.seeds_text(rows.where("score IS NOT NULL").withColumn("rank", F.lit(1)), str(tmp_path / "seeds"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "seeds")).collect()] == ["# seed 0, score=2.5", "1 2"]


def test_result_files(spark, tmp_path):
    for eps in ("1.0e-06", "1.0e+06"):
        (tmp_path / f"t,eps={eps}.csv").write_text("Method,F1\nx,0.5\n")
    got = readers.results_csv(spark, str(tmp_path / "t,eps=*.csv"), r"eps=([0-9.e+-]+)\.csv")
    assert {float(r["parameter"]) for r in got.collect()} == {1e-6, 1e6}
    writers.results_csv(got, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, s, s + 1, (s * 7 + c) % 5, 0) for c in range(3) for s in range(6)]
    df = spark.createDataFrame(rows, "component bigint, sid bigint, nc bigint, q bigint, x int").drop("x")
    for k in range(3):  # three files, so several batches
        df.where(F.col("sid") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r["component"]: (r["sid"], r["nc"]) for r in snapshots.peak_per_component(df, snapshots.score(1.0)).collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = peaks.track_peaks(stream, 1.0).writeStream.outputMode("complete").format("memory").queryName("built").option("checkpointLocation", str(tmp_path / "built")).trigger(availableNow=True).start()
    q.awaitTermination()
    best = {}
    for r in spark.table("built").collect():
        best[r["component"]] = max(best.get(r["component"], (-1.0,)), (r["score"], r["nc"], -r["sid"]))
    assert {c: (-b[2], b[1]) for c, b in best.items()} == want


def test_keyed_state_is_kept_over_a_restart(spark, tmp_path):
    rows = [(c if c else None, s, s + 1, (s * 7 + (c or 0)) % 5) for c in range(4) for s in range(9)]
    df = spark.createDataFrame([*rows, (9, 1, None, 1), (9, 2, 5, None), (8, 0, 1, 0)], "component bigint, sid bigint, nc bigint, q bigint")
    files, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(part):
        df.where(part).coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(files)
        peaks.follow(stream, 1.0, out, state).awaitTermination()
        return {r["component"]: (r["sid"], r["nc"], r["score"]) for r in peaks.latest(spark, out).collect()}

    def want(part):
        best = {}
        for c, s, nc, q in (r for r in rows if part(r[1])):
            if nc > 1:
                best[c] = max(best.get(c, (-1.0,)), (nc / (q + 1.0), nc, -s))
        return {c: (-b[2], b[1], b[0]) for c, b in best.items()}

    assert run("sid < 4") == want(lambda s: s < 4)
    assert run("sid >= 4 AND sid < 7") == want(lambda s: s < 7)  # another query, from the same checkpoint
    assert run("sid >= 7") == want(lambda s: True)
    assert run("false") == want(lambda s: True)
