"""Recall of the hyperplane index against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import vector


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_at_ten(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    name = next(f.name for f in pq.read_schema(path) if str(f.type).startswith(("list", "fixed")))
    nodes = spark.read.parquet(path).select(F.col(name).cast("array<double>").alias("vector"))
    index = vector.HyperplaneIndex()
    rows = index.build(nodes, 64).collect()
    x, signature = np.array([r["vector"] for r in rows]), np.array([r["signature"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    for q in range(0, len(x), len(x) // 200):
        near = np.bitwise_count(signature ^ signature[q]).min(axis=1) <= index.flips
        found.append(near[np.argsort(-(x @ x[q]))[:10]].mean())
    assert np.mean(found) >= 0.9
