"""The whole run on a small cohort whose samples have awkward names."""

import random

import pytest

from cellweft.config import CohortConfig
from cellweft.plans.cohort import run_cohort, settings_key

NAMES = ["001", "1", "2024-01-01"]
CFG = CohortConfig.for_mode("PUBLISH", top_n_genes=12, n_dict_components=3, dict_rounds=2, fit_rounds=2, k_hops=1, k_neighbors=5, moran_k=4, unsupervised=True,
                            n_perms_entropy=5, n_perms_topo=3, use_sketching=False, min_vocabulary_overlap=1, entropy_pruning=False)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(1)
    genes = [f"GENE{i}X" for i in range(16)]
    manifest = spark.createDataFrame([(s, s, f"p{i}", "d", True, True) for i, s in enumerate(NAMES)],
                                     "filepath string, sample_id string, patient_id string, dataset_id string, discovery boolean, projection boolean")
    cells = spark.createDataFrame([(s, i, rng.random() * 10, rng.random() * 10) for s in NAMES for i in range(70)], "sample_id string, cell_id long, x double, y double")
    rows = [(s, i, g, float(rng.randrange(1, 9))) for s in NAMES for i in range(70) for k, g in enumerate(genes) if rng.random() < 0.4 + 0.4 * (k % 4 == i % 4)]
    return manifest, cells, spark.createDataFrame(rows, "sample_id string, cell_id long, gene string, value double")


def test_run_keeps_every_cell_and_name_and_resumes(spark, cohort, tmp_path):
    tables = run_cohort(spark, *cohort, str(tmp_path), cfg=CFG)
    for name in ("cells", "edges", "fractions", "expression"):
        assert {r[0] for r in tables[name].select("sample_id").distinct().collect()} == set(NAMES), name
    assert tables["cells"].count() == 3 * 70
    linked = tables["edges"].select("sample_id", "src").union(tables["edges"].select("sample_id", "dst")).distinct().count()
    assert linked == 3 * 70
    assert {r[0] for r in tables["domains"].select("Patient").distinct().collect()} == set(NAMES) and tables["domains"].count() == 3 * 70
    assert {r[0] for r in tables["topology"].select("Sample").distinct().collect()} == set(NAMES)
    assert tables["status"].count() == 0 and tables["refinement"].count() > 0
    rounded = lambda t: sorted((r.Sample, r.Interface, round(r.Continuous_Observed, 6)) for r in t.collect())
    before = rounded(tables["topology"])
    again = run_cohort(spark, *cohort, str(tmp_path), cfg=CFG, redo=["topology"])
    assert rounded(again["topology"]) == before
    assert settings_key(CFG, False) != settings_key(CohortConfig(), False)
    with pytest.raises(ValueError):
        run_cohort(spark, *cohort, str(tmp_path), cfg=CFG, redo=["gene"])
