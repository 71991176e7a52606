"""Hand-computed statistics."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.functions import scalar, simplex
from cellweft.operators import features, meta, ordering, sampling, topology


def test_student_t_tail(spark):
    # table values: two-sided p of these t is 0.05
    rows = [(12.706, 1), (4.303, 2), (3.182, 3), (2.776, 4), (2.262, 9), (2.228, 10)]
    df = spark.createDataFrame(rows, "t double, df int")
    for r in df.select(scalar.t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect():
        assert abs(r.p - 0.05) < 1e-4


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = spark.createDataFrame([(f"i{i}", v) for i, v in enumerate(p)], "Interface string, p_value double")
    q = {r.Interface: r.q for r in meta.bh_fdr(df).collect()}
    want = [0.025, 0.05, 0.05, 0.025, 0.5]
    assert all(abs(q[f"i{i}"] - w) < 1e-12 for i, w in enumerate(want))


def test_meta_with_one_two_and_three_patients(spark):
    rows = [("p1", "a<->b", 1.0), ("p1", "a<->c", 1.0), ("p2", "a<->c", 2.0),
            ("p1", "b<->c", 1.0), ("p2", "b<->c", 1.01), ("p3", "b<->c", 0.99)]
    t = spark.createDataFrame(rows, "Sample string, Interface string, Log2_Enrichment double")
    got = {r.Interface: r for r in meta.meta_topology(t).collect()}
    assert (got["a<->b"].LOPO_Robustness, got["a<->b"].Cross_Patient_SE, got["a<->b"].FDR_q) == ("1/1", 0.0, 1.0)
    assert got["a<->c"].LOPO_Robustness == "2/2"
    assert got["b<->c"].LOPO_Robustness == "3/3"
    assert got["b<->c"].Pooled_Log2_Enrichment == 1.0


def test_moran_on_a_square(spark):
    cells = spark.createDataFrame([("s", i, float(i % 2), float(i // 2)) for i in range(4)],
                                  "sample_id string, cell_id long, x double, y double")
    expr = spark.createDataFrame([("s", 0, "g", 1.0), ("s", 1, "g", 1.0)], "sample_id string, cell_id long, gene string, lognorm double")
    edges = spark.createDataFrame([("s", 0, 1), ("s", 2, 3), ("s", 0, 2), ("s", 1, 3)], "sample_id string, src long, dst long")
    m = features.morans_i(cells, expr, edges).first().moran
    # (4/4) * (0.25 + 0.25 - 0.25 - 0.25) / 1
    assert abs(m) < 1e-6
    two = edges.filter("dst = src + 1")
    assert abs(features.morans_i(cells, expr, two).first().moran - 1.0) < 1e-6
    assert features.morans_i(cells, expr, edges.limit(0)).first().moran == 0.0


def test_simplex_rows(spark):
    rows = [(0, [2.0, 1.0, 0.1]), (1, [0.0, 0.0]), (2, [3.0])]
    df = spark.createDataFrame(rows, "i int, s array<double>")
    got = {r.i: r for r in df.select("i", simplex.sparsemax_array(F.col("s")).alias("sp"), simplex.entmax_array(F.col("s"), 1.5).alias("e")).collect()}
    assert np.allclose(got[0].sp, [1.0, 0.0, 0.0]) and np.allclose(got[1].sp, [0.5, 0.5]) and np.allclose(got[2].e, [1.0])
    for r in got.values():
        assert abs(sum(r.e) - 1) < 1e-6
    assert np.allclose(got[1].e, [0.5, 0.5], atol=1e-6)
    # 1.5-entmax of (2, 1, 0.1): p = ((z/2 - tau)_+)^2 on the first two entries
    tau = (1.5 - math.sqrt(2 - 0.25)) / 2
    assert np.allclose(got[0].e, [(1.0 - tau) ** 2, (0.5 - tau) ** 2, 0.0], atol=1e-5)


def test_ranks_and_quantiles_do_not_depend_on_bucket_size(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 2 as string) as k", "cast((id * 37) % 101 as double) as v")
    a = {(r.k, r.id): r.rn for r in ordering.hash_rank(df, ["k"], "id", 1).collect()}
    b = {(r.k, r.id): r.rn for r in ordering.hash_rank(df, ["k"], "id", 1, bucket_rows=9).collect()}
    assert a == b and sorted(v for (k, _), v in a.items() if k == "0") == list(range(1, 251))
    q = {r.k: r for r in ordering.exact_quantiles(df, ["k"], "v", {"m": 0.5, "h": 0.99}).collect()}
    for k in ("0", "1"):
        v = [float((i * 37) % 101) for i in range(500) if str(i % 2) == k]
        assert abs(q[k].m - np.percentile(v, 50)) < 1e-9 and abs(q[k].h - np.percentile(v, 99)) < 1e-9


def test_batches_repeat_a_patient_only_if_they_must(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {f"p{i}": rng.randrange(1, 9) for i in range(rng.randrange(1, 9))}
        batch = rng.randrange(2, 6)
        rows = [(p, f"{p}#{i}") for p, n in sizes.items() for i in range(n)]
        got = sampling.stratified_batches(spark.createDataFrame(rows, "patient_id string, chunk_key string"), batch).collect()
        batches = -(-len(rows) // batch)
        assert sorted((r.patient_id, r.chunk_key) for r in got) == sorted(rows)
        assert max(Counter(r.batch_id for r in got).values()) <= batch and {r.batch_id for r in got} == set(range(batches))
        for (patient, _), n in Counter((r.patient_id, r.batch_id) for r in got).items():
            assert n <= -(-sizes[patient] // batches)


def test_permutation_sd_of_large_values(spark):
    """A large mean must not swallow the spread: scaling the fractions scales the deviation."""
    cells = [("s", i, float(i % 6), float(i // 6)) for i in range(36)]
    blocks = spark.createDataFrame([("s", i, i // 18, 18) for i in range(36)], "sample_id string, cell_id long, block int, n_block long")
    pairs = spark.createDataFrame([("s", a[1], b[1]) for a in cells for b in cells if a[1] < b[1] and abs(a[2] - b[2]) + abs(a[3] - b[3]) == 1],
                                  "sample_id string, src long, dst long")
    rng = random.Random(9)
    rows = [("s", i, p, 1e5 + rng.random()) for i in range(36) for p in (0, 1)]
    frac = spark.createDataFrame(rows, "sample_id string, cell_id long, program_id int, frac double")
    got = {(r.i, r.j): r.sd for r in topology.block_null_sd(pairs, blocks, frac, 12, batch=5).collect()}
    md5 = lambda c, s: hashlib.md5(f"{c}:{s}".encode()).hexdigest()
    values = {k: [] for k in got}
    for perm in range(1, 13):
        moved = {}
        for block in (0, 1):
            members = range(18 * block, 18 * block + 18)
            fixed = sorted(members, key=lambda c: md5(c, "base"))
            drawn = sorted(members, key=lambda c: md5(c, perm))
            moved.update(dict(zip(fixed, drawn, strict=True)))
        f = {(i, p): v - 1e5 for _, i, p, v in rows}
        for i, j in values:  # exact in fractions less 1e5: the constant part adds the same to every permutation, the linear parts are kept
            deg = Counter()
            for r in pairs.collect():
                deg[r.src] += 1
                deg[r.dst] += 1
            cross = sum(f[moved[r.src], i] * f[moved[r.dst], j] + f[moved[r.dst], i] * f[moved[r.src], j] for r in pairs.collect())
            linear = sum(deg[c] * (f[moved[c], i] + f[moved[c], j]) for c in range(36)) * 1e5
            values[i, j].append(cross + linear)
    for k, v in values.items():
        assert got[k] == pytest.approx(np.std(v), rel=1e-3)
