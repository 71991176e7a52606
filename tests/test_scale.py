"""Crowds at one point, programs met cell by cell, and more programs than genes, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import factor, programs, spatial, topology


@pytest.mark.parametrize("radius", [0.0, 1.2])
def test_topology_by_site_equals_topology_by_pair(spark, radius):
    rng = np.random.default_rng(3)
    places = rng.integers(0, 6, (90, 2)).astype(float)
    rows = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(places)]
    cells = spark.createDataFrame(rows + rows[:5], "sample_id string, cell_id long, x double, y double")  # some come twice
    fractions = spark.createDataFrame([("s", i, int(p), float(rng.random())) for i in range(90) for p in rng.choice(3, rng.integers(0, 3), replace=False)],
                                      "sample_id string, cell_id long, program_id int, frac double")
    blocks, near = topology.spatial_blocks(cells, 20), spatial.radius_sites(cells, radius)
    pairs = spatial.radius_join(cells, radius)
    assert near.pairs.count() < pairs.count()
    got = lambda t, c: {(r.i, r.j): round(r[c], 9) for r in t.collect()}
    assert got(topology.interaction_matrix(near, fractions), "value") == got(topology.interaction_matrix(pairs, fractions), "value")
    assert got(topology.block_null_mean(near, blocks, fractions), "expected") == got(topology.block_null_mean(pairs, blocks, fractions), "expected")


def test_crowd_at_one_point_needs_no_pairs(spark):
    cells = spark.range(3000).select(F.lit("s").alias("sample_id"), F.col("id").alias("cell_id"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    near = spatial.radius_sites(cells, 0.0)
    assert near.pairs.count() == 0 and near.members.count() == 3000
    w = cells.select("sample_id", "cell_id", F.lit(0).alias("program_id"), F.lit(1.0).alias("frac"))
    assert topology.interaction_matrix(near, w).first().value == 3 * 1000 * 999


def test_reconstruct_with_nulls_and_rows_that_come_twice(spark):
    f = spark.createDataFrame([("s", 1, 0, 0.5), ("s", 1, 0, 0.5), ("s", 1, 1, None), ("s", 2, 2, 1.0), ("s", 3, None, 1.0), ("s", 4, 1, None)],
                              "sample_id string, cell_id long, program_id int, frac double")
    p = spark.createDataFrame([(0, "a", 2.0), (0, "a", 1.0), (1, "b", 1.0), (2, "a", None), (2, None, 4.0), (None, "c", 1.0)], "program_id int, gene string, weight double")
    t = programs.reconstruct(f, p)
    assert {(r.cell_id, r.gene): r.expected for r in t.collect()} == {(1, "a"): 3.0, (1, "b"): None, (2, "a"): None, (2, None): 4.0, (4, "b"): None}
    assert "HashAggregate(keys=[sample_id" not in t._jdf.queryExecution().executedPlan().toString().replace("ObjectHashAggregate", "")


def test_more_programs_than_genes_sum_genes_only(spark):
    rng = np.random.default_rng(5)
    x, h = rng.random((40, 4)), rng.random((9, 4)) + 0.1
    e = spark.createDataFrame([("s", i, f"g{j}", float(x[i, j])) for i in range(40) for j in range(4)], "sample_id string, cell_id long, gene string, value double")
    packed = factor.pack(e, factor.vocabulary(e), "value").withColumn("is_train", F.col("cell_id") % 4 > 0)
    w = np.full((40, 9), 1.0) * (x.sum(1, keepdims=True) + 1e-12) / (np.full((40, 9), 1.0) @ h.sum(1, keepdims=True) + 1e-12)
    for _ in range(30):
        w *= (x @ h.T) / (w @ (h @ h.T) + 1e-12)
    train = w[np.arange(40) % 4 > 0]
    wx, pull, *_ = factor.split_sums(packed, 4, h)
    assert wx.shape == pull.shape == (9, 4)
    assert np.allclose(pull, train.T @ train @ h) and np.allclose(wx, train.T @ x[np.arange(40) % 4 > 0])
