"""The list index: what it finds against brute force, and blocks of any size."""

import numpy as np
import pytest

from tidemark.operators import vector
from tidemark.plans.catalog import QUERIES


def test_registered_index_finds_nine_tenths_of_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    near = {(r["query_id"], r["id"]) for r in QUERIES["knn_exact"](spark, sf).collect()}
    found = QUERIES["ann_ivf"](spark, sf)
    assert found.columns == ["query_id", "rank", "id", "score"]
    assert len(near & {(r["query_id"], r["id"]) for r in found.collect()}) >= 0.9 * len(near)


@pytest.mark.parametrize("batch, share", [(2_048, 1 << 20), (3, 7)])
def test_all_lists_are_brute_force_in_blocks_of_any_size(spark, monkeypatch, batch, share):
    x = np.random.default_rng(0).normal(size=(120, 6)).round(2)
    x[7] = 0.0
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 8 = 0 OR vec_id = 7").selectExpr("vec_id AS query_id", "embedding AS vector")
    want = sorted(map(tuple, vector.knn(rows, queries, 5).collect()))
    monkeypatch.setattr(vector, "QUERY_BATCH", batch)
    monkeypatch.setattr(vector, "SHARE", share)
    index, c = vector.ivf_index(rows, 4)
    assert sorted(map(tuple, vector.ivf_search(index, c, queries, 5, 4).collect())) == want
    assert sorted(map(tuple, vector.knn(rows, queries, 5).collect())) == want


def test_probes_follow_recall(spark):
    x = np.random.default_rng(1).normal(size=(400, 8))
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    index, c = vector.ivf_index(rows, 10)
    fitted = [vector.ivf_probes(index, c, queries, 5, recall=r) for r in (0.3, 0.9, 1.0)]
    assert fitted == sorted(fitted) and 1 <= fitted[0] < fitted[-1] <= 10
    want = {(r["query_id"], r["id"]) for r in vector.knn(rows, queries, 5).collect()}
    assert {(r["query_id"], r["id"]) for r in vector.ivf_search(index, c, queries, 5, fitted[-1]).collect()} == want
    assert vector.ivf_probes(index, c, queries.limit(0), 5, least=3) == 3
