"""Shuffled sums tile by tile against joins of every permutation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.operators import shuffled, spatial, topology


@pytest.fixture(scope="module")
def near(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(x), float(y)) for s, n in (("a", 700), ("b", 60), ("c", 90)) for i, (x, y) in enumerate(rng.random((n, 2)) * 10)]
    rows += [("a", 1000 + i, 4.0, 4.0) for i in range(9)] + [("b", 100, 1.0, 1.0), ("b", 100, 1.0, 1.0), ("b", None, 1.0, 2.0), ("a", 2000, None, 1.0)]
    rows += [("c", 5, 0.0, 0.0), ("c", 5, 10.0, 10.0)]  # an id in two blocks
    cells = spark.createDataFrame(rows, "sample_id string, cell_id long, x double, y double")
    fr = [(s, i, int(p), float(v)) for s, i, *_ in rows if i is not None for p, v in zip(rng.choice(4, 2, replace=False), rng.random(2), strict=True)]
    fr += [("a", 1, 7, 0.0), ("b", 2, 9, None), ("a", 1003, 8, 0.5)]
    fractions = spark.createDataFrame(fr, "sample_id string, cell_id long, program_id int, frac double")
    return spatial.radius_sites(cells, 0.8), topology.spatial_blocks(cells).localCheckpoint(), fractions.localCheckpoint()


@pytest.mark.parametrize("tile,most", [(32_768, 400_000), (60, 400_000), (60, 300)])
def test_tiles_equal_joins(spark, monkeypatch, near, tile, most):
    monkeypatch.setattr(shuffled, "TILE_CELLS", tile)
    monkeypatch.setattr(shuffled, "MOST_CELLS", most)
    pairs, blocks, fractions = near
    expected = topology.block_null_mean(pairs, blocks, fractions).localCheckpoint()
    rows = lambda t: {(r.sample_id, r.i, r.j): r.sd for r in t.collect()}
    got = rows(topology.block_null_sd(pairs, blocks, fractions, 5, expected))
    want = rows(topology._joined_null_sd(pairs, blocks, fractions, 5, expected, 20))
    assert set(got) == set(want) and len({s for s, *_ in got}) == 3
    assert np.allclose([got[k] for k in want], [*want.values()], rtol=1e-9, atol=1e-9)
    odd = {r[0] for r in shuffled.shuffled_sums(pairs, blocks, fractions, 1)[1].collect()}
    assert odd == ({"c", "a"} if most == 300 else {"c"})


def test_no_rows_of_cells_and_permutations(spark, near, monkeypatch):
    """Cells are not joined with permutations: nothing is ranked or moved row by row."""
    monkeypatch.setattr(topology, "hash_rank", lambda *a, **k: pytest.fail("cells are ranked in every permutation"))
    pairs, blocks, fractions = near
    some = [t.filter(F.col("sample_id") != "c") for t in (*pairs, blocks, fractions)]
    assert topology.block_null_sd(spatial.Near(*some[:2]), *some[2:], 3).count() > 0
