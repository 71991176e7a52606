"""The whole cohort run, phase by phase. Every phase reads and writes tables, so a run can be resumed."""

from __future__ import annotations

import hashlib
from collections.abc import Collection
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.config import CohortConfig
from cellweft.operators import (domains, factor, features, graph, meta, priors, programs, qc, sampling, topology)
from cellweft.session import settle
from cellweft.sources import readers, writers


def _kept(spark: SparkSession, path: str, make, write=None) -> DataFrame:
    """Stored table of a phase, or make it, store it and read it back."""
    found = writers.read_if_present(spark, path)
    if found is not None:
        return found
    df = make()
    if write is None:
        df.write.mode("overwrite").parquet(path)
    else:
        write(df, path)
    return writers.read_stored(spark, path)


def settings_key(cfg: CohortConfig, supervised: bool) -> str:
    """Short name of the settings; tables stored under other settings are never taken for these."""
    return hashlib.md5(repr((sorted(asdict(cfg).items()), supervised)).encode()).hexdigest()[:10]


def limit_cells(cells: DataFrame, expression: DataFrame, cfg: CohortConfig) -> DataFrame:
    """All cells, or as many per sample as the caller asks for: by sketch or by chance; small samples are whole."""
    if cfg.max_cells_per_sample is None:
        return cells
    if cfg.use_sketching:
        return sampling.expression_sketch(cells, expression, cfg.max_cells_per_sample, seed=cfg.seed)
    return qc.sample_cap(cells, cfg.max_cells_per_sample, cfg.seed)


def discover_genes(cells: DataFrame, expression: DataFrame, whitelist: DataFrame | None, cfg: CohortConfig) -> DataFrame:
    if whitelist is not None:
        qc.check_vocabulary(expression, whitelist, cfg.min_vocabulary_overlap)
    some = cells if cfg.feature_cap is None else settle(qc.sample_cap(cells, cfg.feature_cap, cfg.seed))
    part = expression if cfg.feature_cap is None else expression.join(some.select("sample_id", "cell_id"), ["sample_id", "cell_id"], "left_semi")
    hvg, moran = features.spatial_features(some, part, whitelist, cfg.moran_k)
    return readers.number_genes(features.consensus_genes(hvg, moran, cfg.top_n_genes))


def learn_priors(cells: DataFrame, raw: DataFrame, genes: DataFrame, signatures: DataFrame | None,
                 cfg: CohortConfig) -> tuple[DataFrame, DataFrame | None]:
    spark = cells.sparkSession
    weights = priors.prior_matrix(cells, raw, cfg.prior_cells_per_sample, seed=cfg.seed)
    matrix, _ = priors.program_dictionary(weights, genes, cfg.n_dict_components, cfg.dict_rounds, cfg.seed)
    dictionary = settle(factor.dictionary_table(spark, matrix, genes, 1e-6))
    if signatures is None:
        return dictionary.select("program_id", "gene", F.lit("dictionary").alias("kind")), None
    listed = signatures.join(genes, "gene", "left_semi")
    clusters, nouns = priors.marker_set_clusters(listed, None if cfg.n_noun_clusters else cfg.noun_distance, cfg.n_noun_clusters,
                                                 cfg.consensus_freq, cfg.min_genes_noun, cfg.max_genes_noun)
    accepted, stats = priors.program_candidates(dictionary, nouns, cfg.top_k_adjective_genes, cfg.max_noun_overlap,
                                                cfg.max_internal_overlap, cfg.max_prior_adjectives)
    report = priors.prior_report(clusters, nouns, accepted, dictionary, stats)
    return priors.prior_programs(nouns, dictionary, accepted, cfg.top_k_adjective_genes), report


PHASES = ("genes", "cells", "expression", "edges", "priors", "programs", "fractions", "pruning", "names", "domains", "topology")


def run_cohort(spark: SparkSession, manifest: DataFrame, cells: DataFrame, expression: DataFrame, out: str,
               signatures: DataFrame | None = None, cfg: CohortConfig | None = None, panel: DataFrame | None = None,
               redo: Collection[str] = ()) -> dict[str, DataFrame]:
    """Manifest to meta-analysis. Returns the tables it stored below ``out``, in a folder of these settings.

    ``panel(sample_id, gene)`` names the measured genes; without it, genes with a count in a sample are its panel. Tables named in
    ``redo`` (``genes``, ``cells``, ``expression``, ``edges``, ``priors``, ``programs``, ``fractions``, ``pruning``, ``names``,
    ``domains``, ``topology``) are made again, as is all that comes after the first of them.
    """
    cfg = cfg or CohortConfig()
    out = f"{out}/{settings_key(cfg, signatures is not None and not cfg.unsupervised)}"
    writers.forget(spark, out, PHASES, redo)
    discovery, projection = readers.split_roles(manifest, cfg.max_samples)
    if discovery.isEmpty():
        raise ValueError("no discovery samples in the manifest")
    if cfg.unsupervised:
        signatures = None
    expression = readers.select_expression(expression)
    used_samples = settle(discovery.select("sample_id").unionByName(projection.select("sample_id")).distinct())
    all_cells = cells.join(used_samples, "sample_id", "left_semi")
    ref_cells = all_cells.join(discovery.select("sample_id"), "sample_id", "left_semi")
    ref_expr = expression.join(discovery.select("sample_id"), "sample_id", "left_semi")
    whitelist = None if signatures is None else signatures.select("gene").distinct()
    t: dict[str, DataFrame] = {}

    # phase 1a: genes and graphs
    t["genes"] = _kept(spark, f"{out}/genes", lambda: discover_genes(ref_cells, ref_expr, whitelist, cfg))
    mapped = qc.remap_to_vocab(expression.join(used_samples, "sample_id", "left_semi"), t["genes"]).drop("gene_idx")
    t["cells"] = _kept(spark, f"{out}/cells", lambda: qc.train_val_split(limit_cells(all_cells, mapped, cfg), seed=cfg.seed),
                       writers.write_by_sample)
    held = t["cells"].select("sample_id", "cell_id")
    t["expression"] = _kept(spark, f"{out}/expression", lambda: qc.normalize_log1p(
        mapped.join(held, ["sample_id", "cell_id"], "left_semi")), writers.write_by_sample)
    t["edges"] = _kept(spark, f"{out}/edges", lambda: graph.spatial_graph(t["cells"], t["expression"], k=cfg.k_neighbors),
                       writers.write_by_sample)
    fit = discovery.select("sample_id")
    fit_cells, fit_expr, fit_edges = [x.join(fit, "sample_id", "left_semi") for x in (t["cells"], t["expression"], t["edges"])]

    # phase 1b: priors and programs
    def make_priors() -> DataFrame:
        prior, report = learn_priors(fit_cells, fit_expr.select("sample_id", "cell_id", "gene", "value"), t["genes"], signatures, cfg)
        if report is not None:
            writers.write_lines(report, f"{out}/prior_report", "section", "position")
        return prior

    t["priors"] = _kept(spark, f"{out}/priors", make_priors)

    def make_programs() -> DataFrame:
        context = priors.smooth_expression(fit_expr, fit_edges, cfg.k_hops, cells=fit_cells)
        fit = priors.validated_programs(context, fit_cells, t["genes"], t["priors"], cfg.fit_rounds, cfg.extra_programs)
        writers.write_csv(fit.history.withColumnRenamed("step", "epoch").coalesce(1).sortWithinPartitions("epoch"), f"{out}/history")
        return factor.dictionary_table(spark, fit.programs, t["genes"])

    t["programs"] = _kept(spark, f"{out}/programs", make_programs)

    # phase 2: fractions, pruning, names, domains
    # Scored in the context they were fitted in: expression smoothed over the graph.
    t["fractions"] = _kept(spark, f"{out}/fractions", lambda: programs.project_fractions(
        settle(priors.smooth_expression(t["expression"], t["edges"], cfg.k_hops, cells=t["cells"])), t["programs"], None, cfg.inference_scale, cfg.inference_alpha),
        writers.write_by_sample)
    patients = manifest.select("sample_id", "patient_id")
    mass = settle(programs.patient_mass(t["fractions"].join(fit, "sample_id", "left_semi"), patients))
    t["pruning"] = _kept(spark, f"{out}/pruning", lambda: programs.entropy_pruning(
        mass, cfg.n_perms_entropy, enabled=cfg.entropy_pruning))
    kept = t["pruning"].filter("kept")
    t["names"] = _kept(spark, f"{out}/names", lambda: programs.name_programs(t["programs"], kept))
    t["refinement"] = settle(programs.refinement_report(t["pruning"], mass, t["programs"]))
    writers.write_csv(t["refinement"].coalesce(1), f"{out}/refinement_report")
    mapping = settle(domains.program_domains(domains.program_correlation(t["cells"], t["fractions"])))
    t["domains"] = _kept(spark, f"{out}/domains", lambda: domains.smooth_domains(
        t["cells"], t["fractions"], mapping, t["edges"], cfg.self_weight), writers.write_domains)

    # phase 3: topology per sample, then the cohort
    def write_pending() -> DataFrame | None:
        stored = writers.read_if_present(spark, f"{out}/topology")
        todo = settle(topology.pending_samples(projection, stored))
        if todo.isEmpty():
            return stored
        cell_part = t["cells"].join(todo.select("sample_id"), "sample_id", "left_semi")
        measured = expression if panel is None else panel
        measured = measured.join(todo.select("sample_id"), "sample_id", "left_semi").select("sample_id", "gene").distinct()
        valid = programs.validate_panel(measured, t["programs"], t["genes"], min(1000, cfg.n_perms_entropy), cfg.panel_overlap, cfg.seed)
        w = (t["fractions"].join(valid.select("sample_id", "program_id"), ["sample_id", "program_id"], "left_semi")
                           .join(kept.select("program_id"), "program_id", "left_semi"))
        rows = topology.cohort_topology(cell_part, w, t["names"], todo, cfg.n_perms_topo, cfg.radius_multiplier, cfg.min_topic_mass)
        writers.write_topology(rows, f"{out}/topology")
        return writers.read_if_present(spark, f"{out}/topology")

    found = write_pending()
    no_rows = found if found is not None else spark.createDataFrame([], "Sample string")
    t["status"] = topology.sample_status(projection, no_rows)
    if found is not None:
        t["topology"] = found
        by_patient = found.join(manifest.select(F.col("sample_id").alias("Sample"), "patient_id"), "Sample")
        by_patient = by_patient.withColumn("Sample", F.col("patient_id")).drop("patient_id")
        t["meta"] = settle(meta.meta_topology(by_patient))
        if not t["meta"].isEmpty():
            writers.write_csv(meta.matrix_table(t["meta"]), f"{out}/matrix")
            writers.write_json_text(meta.network_payload(meta.network_links(t["meta"], cfg.fdr_threshold)), f"{out}/network", "payload")
    return t
