"""Queries that once did less than their names say."""

import duckdb
import numpy as np

import __spark_entry__ as entry
from catalog import fits
from cellweft.config import CohortConfig
from cellweft.operators import factor, priors, trend
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"


def test_interface_stats_has_z_against_permutations(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()["interface_stats"](spark, SF).toPandas(), con.execute(entry.oracle_sql()["interface_stats"]).df()
    assert {"Spatial_Z_Score", "z_exact"} <= set(got.columns) and set(got.columns) == set(want.columns)
    assert len(got) and got.Spatial_Z_Score.abs().max() > 0 and repr(canonical(got)) == repr(canonical(want))


def test_run_cohort_fits_as_long_as_its_preset(monkeypatch):
    """The held-out loss is judged over a window of rounds; a query that allows fewer never judges it."""
    asked = []
    monkeypatch.setattr(fits.cohort, "run_cohort", lambda *a: asked.append(a[-1]) or {"topology": type("T", (), {"drop": lambda *_: None})})
    monkeypatch.setattr(fits, "ensure_checkpoint_dir", lambda _: None)
    monkeypatch.setattr(fits, "V", type("V", (), {"__getattr__": lambda *_: lambda *_: None})())
    context = type("C", (), {"getCheckpointDir": lambda *_: "/nowhere"})()
    fits.run_cohort(type("S", (), {"sparkContext": context})(), SF)
    preset = CohortConfig.for_mode("DISCOVERY")
    for name in ("fit_rounds", "dict_rounds", "n_perms_entropy", "n_perms_topo"):
        assert getattr(asked[0], name) == getattr(preset, name), name
    assert asked[0].fit_rounds > trend.plateau_step.__defaults__[0]


def test_a_round_of_the_fit_is_few_jobs(spark):
    """The checks of a round read a few numbers: they are one job, not several with a shuffle each."""
    rng = np.random.default_rng(3)
    expression = spark.createDataFrame([("s", i, f"g{j}", float(v)) for i in range(80) for j, v in enumerate(rng.random(6))], "sample_id string, cell_id long, gene string, lognorm double")
    split = expression.select("sample_id", "cell_id").distinct().withColumn("is_train", expression.cell_id % 5 > 0)
    prior = spark.createDataFrame([(0, "g0"), (0, "g1"), (1, "g3")], "program_id int, gene string")
    genes, jobs = factor.vocabulary(expression), []
    context = spark.sparkContext
    for rounds in (9, 13):
        context.setJobGroup(f"fit{rounds}", "")
        fit = priors.validated_programs(expression, split, genes, prior, rounds, window=9, drop=-1e9)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"fit{rounds}")))
        assert fit.reason == "rounds" and fit.history.count() == rounds
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 4 * 4
