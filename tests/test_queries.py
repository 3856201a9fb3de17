"""The driver's queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from graphloom.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
SOME = [
    "supplier_pairs", "subgraph_density", "connected_components", "kcore_k", "core_sweep", "peel_order", "snapshot_stats", "energy_best",
    "best_partition", "uncovered_singletons", "seed_rank", "charikar_density", "diameter_2sweep", "nearest_seed_owner", "compress_partition_k",
    "topk_degree_partition", "merge_tiny_clusters_one_round", "macro_f1_all", "column_profile", "upper_median", "gcn_propagate_once",
    "header_file_edges", "plain_file_edges", "reindexed_edges", "citation_file_vertices", "cluster_file", "result_files", "seed_text_file",
    "citation_seeds_to_pools", "set_lambda2", "calibrated_best", "nms_coverage_select", "ranked_seed_nearest_eval", "seed_sweep",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
