"""Input parsing, invariants of the iterative jobs, sampling sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import views as V
from cellweft.operators import factor, graph, priors, programs, qc, sampling
from cellweft.plans.cohort import limit_cells
from cellweft.config import CohortConfig
from cellweft.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_noise_names(spark):
    names = ["MT-CO1", "RPL13", "ACTB", "ZEB1-AS1", "malat1", "CD8A", "SOX2", "ACTA2"]
    kept = {r.gene for r in qc.noise_filter(spark.createDataFrame([(n,) for n in names], "gene string")).collect()}
    assert kept == {"CD8A", "SOX2", "ACTA2"}


def test_signature_lists(spark):
    raw = spark.createDataFrame([("a", "['CD8A','SOX2']"), ("b", "CD8A, SOX2"), ("c", ""), ("d", None)], "Cell_type string, Genes string")
    got = {(r.lineage, r.gene) for r in readers.parse_signatures(raw).collect()}
    assert got == {(k, g) for k in "ab" for g in ("CD8A", "SOX2")}


def test_manifest_checks(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("filepath , discovery, projection\n/x/a_graph.h5 ,True,no\n/x/b.h5, 1,yes\n")
    rows = {r.sample_id: r for r in readers.read_manifest(spark, str(p)).collect()}
    assert rows["a"].discovery and not rows["a"].projection and rows["b"].projection and rows["b"].dataset_id == "Unknown"
    with pytest.raises(ValueError):
        readers.clean_manifest(spark.createDataFrame([("x",)], "filepath string"))


def test_vocabulary_forms(spark):
    raw = spark.createDataFrame([('["B","A"]',)], "value string")
    assert [tuple(r) for r in readers.parse_vocabulary(raw).collect()] == [(0, "B"), (1, "A")]
    raw = spark.createDataFrame([('{"genes": ["X"]}',)], "value string")
    assert [tuple(r) for r in readers.parse_vocabulary(raw).collect()] == [(0, "X")]


def test_unknown_mode():
    with pytest.raises(ValueError):
        CohortConfig.for_mode("FAST")
    assert CohortConfig.for_mode("DEV").max_samples == 2


def test_dictionary_loss_never_rises_and_finds_parts(spark):
    rng = np.random.default_rng(0)
    parts = np.kron(np.eye(3), np.ones((1, 5)))
    x = rng.random((60, 3)) @ parts
    rows = [("s", i, f"g{j:02d}", float(x[i, j])) for i in range(60) for j in range(15)]
    e = spark.createDataFrame(rows, "sample_id string, cell_id long, gene string, value double")
    genes = factor.vocabulary(e)
    h, losses = factor.factorize(factor.pack(e, genes, "value"), 15, rng.random((3, 15)) + 0.1, 12)
    assert all(b <= a for a, b in zip(losses, losses[1:])) and losses[-1] < 0.2 * losses[0]


def test_linkage_merges_close_sets_only(spark):
    sets = {1: "abcdefghij", 2: "abcdefghik", 3: "mnopqrstuv", 4: "mnopqrstuw", 5: "xyz"}
    s = spark.createDataFrame([(k, g) for k, v in sets.items() for g in v], "lineage long, gene string")
    got = {r.lineage: r.cluster for r in priors.average_linkage(s, 0.60).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len({got[1], got[3], got[5]}) == 3
    nouns = priors.consensus_markers(s, priors.average_linkage(s, 0.60)).collect()
    assert {r.cluster for r in nouns} == {got[1], got[3]}  # the three-gene set is too thin


def plain_linkage(sets, n_clusters):
    """Average linkage, one merge at a time."""
    groups = [[k] for k in sorted(sets)]
    far = lambda a, b: 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    while len(groups) > n_clusters:
        d, i, j = min((round(sum(far(a, b) for a in x for b in y) / (len(x) * len(y)), 12), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_by_count_takes_the_lowest_merges(spark):
    sets = {1: set(range(100)), 2: set(range(100)), 3: set(range(20, 100)) | set(range(200, 220)), 4: set(range(300, 400)), 5: set(range(383, 483)),
            6: set(range(500, 530)), 7: set(range(505, 540))}
    s = spark.createDataFrame([(k, str(g)) for k, v in sets.items() for g in v], "lineage long, gene string")
    for n in (3, 5):
        found = {}
        for r in priors.average_linkage(s, None, n).collect():
            found.setdefault(r.cluster, set()).add(r.lineage)
        got = {frozenset(g) for g in found.values()}
        assert len(got) == n
        assert got == plain_linkage(sets, n)
    assert len({r.cluster for r in priors.average_linkage(s, None, 1).collect()}) == 1


def test_stored_samples_keep_their_names(spark, tmp_path):
    names = ["001", "1", "2024-01-01", "A/B", "a b"]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample_id string, n int")
    writers.write_by_sample(df, f"{tmp_path}/t")
    writers.write_by_sample(df.filter("sample_id = '001'").withColumn("n", F.lit(7)), f"{tmp_path}/t")
    got = writers.read_if_present(spark, f"{tmp_path}/t")
    assert {(r.sample_id, r.n) for r in got.collect()} == {(s, 7 if s == "001" else i) for i, s in enumerate(names)}
    assert got.dtypes == df.select("n", "sample_id").dtypes or sorted(got.dtypes) == sorted(df.dtypes)
    assert writers.read_if_present(spark, f"{tmp_path}/none") is None


def test_label_propagation_gives_every_node_one_label(spark):
    links = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1)], "a int, b int, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node int")
    got = {r.node: r.domain for r in graph.label_propagation(nodes, links).collect()}
    assert len(got) == 7 and got[0] == got[1] == got[2] and got[3] == got[4] == got[5] and got[0] != got[3]


def test_fractions_sum_to_one(spark):
    e = qc.normalize_log1p(V.expression25(spark, SF))
    f = programs.project_fractions(e, V.programs(spark, SF))
    bad = f.groupBy("sample_id", "cell_id").agg(F.sum("frac").alias("s")).filter("abs(s - 1) > 1e-6").count()
    assert bad == 0


def test_sketch_keeps_the_target(spark):
    rng = np.random.default_rng(2)
    cells = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((300, 2)))] +
                                  [("t", i, 0.1 * i, 1.0) for i in range(20)], "sample_id string, cell_id long, x double, y double")
    expr = cells.select("sample_id", "cell_id", F.concat(F.lit("g"), F.col("cell_id") % 7).alias("gene"), F.lit(3.0).alias("value"))
    expr = expr.unionByName(cells.select("sample_id", "cell_id", F.lit("h").alias("gene"), (F.col("cell_id") % 3 + 1).cast("double").alias("value")))
    n = {r.sample_id: r["count"] for r in sampling.expression_sketch(cells, expr, 60, 4).groupBy("sample_id").count().collect()}
    assert n == {"s": 60, "t": 20}
    cfg = CohortConfig.for_mode("DEV", max_cells_per_sample=50)
    n = {r.sample_id: r["count"] for r in limit_cells(cells, expr, cfg).groupBy("sample_id").count().collect()}
    assert n == {"s": 50, "t": 20}


def planted_cells(spark, shift=0.0):
    """Three programs of four genes; every cell is mostly one of them. ``shift`` changes held-out cells only."""
    rng = np.random.default_rng(3)
    rows, split = [], []
    for i in range(240):
        train = i % 5 != 0
        split.append(("s", i, train))
        for g in range(12):
            x = (4.0 if g // 4 == i % 3 else 0.0) + rng.random() * 0.4
            rows.append(("s", i, f"G{g:02d}", x if train else x + shift))
    return (spark.createDataFrame(rows, "sample_id string, cell_id long, gene string, lognorm double"),
            spark.createDataFrame(split, "sample_id string, cell_id long, is_train boolean"))


def test_fit_ends_at_its_best_held_out_loss(spark):
    expression, split = planted_cells(spark)
    genes = factor.vocabulary(expression)
    prior = spark.createDataFrame([(k, f"G{4 * k + j:02d}") for k in range(3) for j in range(2)], "program_id int, gene string")
    fit = priors.validated_programs(expression, split, genes, prior, 40)
    history = sorted(fit.history.collect(), key=lambda r: r.step)
    assert [r.step for r in history] == list(range(len(history))) and 8 <= len(history) < 40 and fit.reason in ("plateau", "overshoot")
    assert sum(r.chosen for r in history) == 1 and history[fit.step].chosen
    assert history[fit.step].val_loss == min(r.val_loss for r in history) < 0.2 * history[0].val_loss
    for k in range(3):  # every program found the genes that its prior lacked
        assert set(np.argsort(-fit.programs[k])[:4]) == set(range(4 * k, 4 * k + 4))
    short = priors.validated_programs(expression, split, genes, prior, 3)
    assert short.reason == "rounds" and short.history.count() == 3


def test_held_out_cells_leave_the_sums_alone(spark):
    """Two cohorts that differ in held-out cells only have the same training losses, and other held-out losses."""
    prior = spark.createDataFrame([(k, f"G{4 * k:02d}") for k in range(3)], "program_id int, gene string")
    histories = []
    for shift in (0.0, 2.0):
        expression, split = planted_cells(spark, shift)
        histories.append(priors.validated_programs(expression, split, factor.vocabulary(expression), prior, 4).history.orderBy("step").collect())
    assert [round(r.train_loss, 9) for r in histories[0]] == [round(r.train_loss, 9) for r in histories[1]]
    assert all(abs(a.val_loss - b.val_loss) > 1e-6 for a, b in zip(*histories, strict=True))
    nobody = split.withColumn("is_train", F.lit(True))
    alone = priors.validated_programs(expression, nobody, factor.vocabulary(expression), prior, 2).history.collect()
    assert all(r.val_loss == r.train_loss for r in alone)
