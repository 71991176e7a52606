"""Messages along edges against a plain version: rows that come twice, null items, hubs, and no rows of edges x items."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import blocks, graph

FEATURES = "sample_id string, cell_id long, gene string, h double"
EDGES = "sample_id string, src long, dst long, weight double"


def plain(features, edges, rounds, alpha):
    """What joining edges with features and then with the base rows gives."""
    rows = [(s, c, g, h) for s, c, g, h in features]
    for _ in range(rounds):
        sent = {}
        for s, a, b, w in edges:
            for t, c, g, h in rows:
                if s is not None and (s, a) == (t, c):
                    sent[s, b, g] = sent.get((s, b, g), 0.0) + (h or 0.0) * (w or 0.0)
        met = {(s, c, g) for s, c, g, _ in features if g is not None}
        rows = [(s, c, g, (1 - alpha) * (sent.get((s, c, g), 0.0) if g is not None else 0.0) + alpha * (h or 0.0)) for s, c, g, h in features]
        rows += [(*k, (1 - alpha) * m) for k, m in sent.items() if k not in met]
    return rows


def close(got, want):
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])


@pytest.mark.parametrize("with_cells", [True, False])
def test_propagate_equals_plain_joins(spark, monkeypatch, with_cells):
    monkeypatch.setattr(blocks, "SLAB", 7)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 4)  # small blocks, dealt to several parts, and a hub's list cut
    monkeypatch.setattr(blocks, "UNIT_EDGES", 5)
    rng = np.random.default_rng(2)
    features = [("s", int(c), f"g{g}", float(rng.random())) for c in range(15) for g in rng.choice(4, rng.integers(0, 4), replace=False)]
    features += features[:3] + [("s", 3, None, 1.5), ("s", 3, None, 0.5), ("s", 4, "g1", None), (None, 1, "g0", 2.0), ("t", 1, "g0", 1.0)]
    edges = [("s", int(a), int(b), float(rng.random())) for a in range(15) for b in rng.choice(15, 3)] + [("s", a, 7, 0.25) for a in range(14)]
    edges += [("s", 3, 5, None), (None, 1, 2, 1.0), ("s", 99, 1, 1.0), ("s", 3, 50, 1.0)]
    cells = spark.createDataFrame([("s", i, float(i), 0.0) for i in range(15)] + [("s", 0, 9.0, 0.0)], "sample_id string, cell_id long, x double, y double")
    t = graph.propagate(spark.createDataFrame(features, FEATURES), spark.createDataFrame(edges, EDGES), 2, 0.3, attention=False, cells=cells if with_cells else None)
    assert t.columns == ["sample_id", "cell_id", "gene", "h"]
    close([tuple(r) for r in t.collect()], plain(features, edges, 2, 0.3))
    assert graph.propagate(spark.createDataFrame(features, FEATURES), spark.createDataFrame(edges, EDGES), 0, 0.3).count() == len(features)


def test_propagate_makes_no_rows_of_edges_and_items(spark):
    cells = spark.range(300).select(F.lit("s").alias("sample_id"), F.col("id").alias("cell_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    features = cells.select("sample_id", "cell_id", F.explode(F.array(*[F.lit(f"g{i}") for i in range(20)])).alias("gene"), F.lit(1.0).alias("h"))
    edges = cells.select("sample_id", F.col("cell_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i")).select(
        "sample_id", "src", ((F.col("src") + F.col("i")) % 300).alias("dst"), F.lit(0.1).alias("weight"))
    t = graph.propagate(features, edges, 1, 0.5, attention=False, cells=cells)
    assert {round(r.h, 9) for r in t.collect()} == {1.0} and t.count() == 6000
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sum(" not in plan


def test_normalised_edges_and_softmax_are_computed_once(spark):
    cells = spark.createDataFrame([("s", i, 0.0, 0.0) for i in (1, 2, 3)] + [(None, 4, 0.0, 0.0)], "sample_id string, cell_id long, x double, y double")
    edges = spark.createDataFrame([("s", 1, 2, 0.5), ("s", 2, 3, 2.0), ("s", 1, 9, 1.0), (None, 4, 5, 1.0)], EDGES)
    g = graph.symmetric_normalize(cells, edges)
    degree = {1: 2.5, 2: 3.5, 3: 3.0, 9: 1.0}
    both = [(1, 2, 0.5), (2, 1, 0.5), (2, 3, 2.0), (3, 2, 2.0), (1, 9, 1.0), (9, 1, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    want = {(a, b): w / math.sqrt(degree[a] * degree[b]) for a, b, w in both}
    assert {(r.src, r.dst): round(r.weight, 9) for r in g.collect()} == {k: round(w, 9) for k, w in want.items()}
    soft = graph.edge_softmax(g, "weight")
    total = {b: sum(math.exp(w) for (_, d), w in want.items() if d == b) for _, b in want}
    assert {(r.src, r.dst): round(r.attention, 6) for r in soft.collect()} == {(a, b): round(math.exp(w) / (total[b] + 1e-9), 6) for (a, b), w in want.items()}
    plan = soft._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Join") == 1


def test_edge_cosines_of_hubs_and_edges_that_come_twice(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 4)
    monkeypatch.setattr(blocks, "UNIT_EDGES", 5)
    rng = np.random.default_rng(4)
    x = rng.random((15, 4)) * (rng.random((15, 4)) > 0.4)
    e = [("s", int(i), f"g{j}", float(x[i, j])) for i, j in np.argwhere(x > 0)]
    edges = [("s", int(a), int(b), float(rng.random())) for a in range(14) for b in rng.choice(14, 2)] + [("s", 3, b, 0.5) for b in range(15)] + [("s", 3, 20, None), (None, 1, 2, 0.0)]
    edges += edges[:2]
    cells = spark.createDataFrame([("s", i, float(i % 4), float(i // 4)) for i in range(15)], "sample_id string, cell_id long, x double, y double")
    t = graph.edge_cosine(cells, spark.createDataFrame(edges, "sample_id string, src long, dst long, dist double"), spark.createDataFrame(e, "sample_id string, cell_id long, gene string, lognorm double"))
    assert t.columns == ["sample_id", "src", "dst", "dist", "sim"]
    x = np.vstack([x, np.zeros((10, 4))])
    norm = np.where((x ** 2).sum(1) > 0, np.sqrt((x ** 2).sum(1)), 1e-9)
    want = [(s, a, b, d, round(x[a] @ x[b] / norm[a] / norm[b], 9) + 0.0) for s, a, b, d in edges if s]
    assert sorted(((*r[:4], round(r.sim, 9)) for r in t.collect()), key=str) == sorted(want, key=str)
    lists = blocks.edge_lists(spark.createDataFrame(edges, "sample_id string, src long, dst long, dist double"), "src")
    assert lists.filter("src = 3").count() > 1 and lists.filter("src = 4").count() == 1
