"""Spatial chunks, quota sampling and batches; every rank is distributed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.simplex import l2_normalize
from cellweft.operators import factor, graph, spatial
from cellweft.operators.ordering import BUCKET_ROWS, bucketed_rank, hash_key, hash_rank, hash_unit
from cellweft.session import settle

SAMPLE, CELL, GENE = "sample_id", "cell_id", "gene"


def _hash_part(rows: Column) -> Column:
    """One grid square may hold all of a group's ``rows``: cells are ordered by hash and ranked in as many parts as that needs."""
    return F.floor(hash_unit(F.col("_h")) * F.ceil(rows / F.lit(float(BUCKET_ROWS))))


def _square(boxed: DataFrame, n: Column, clipped: bool) -> DataFrame:
    return (boxed.withColumn("gx", spatial.grid_bin(F.col("x"), F.col("xmin"), F.col("xmax"), n, clipped))
                 .withColumn("gy", spatial.grid_bin(F.col("y"), F.col("ymin"), F.col("ymax"), n, clipped)))


def grid_occupancy(cells: DataFrame, bins: int) -> DataFrame:
    boxed = cells.join(spatial.extents(cells), SAMPLE)
    return _square(boxed, F.lit(bins), True).groupBy(SAMPLE, "gx", "gy").agg(F.count(F.lit(1)).alias("n"))


def spatial_chunks(cells: DataFrame, chunk_cells: int, seed: int = 42) -> DataFrame:
    """Consecutive slices of ``chunk_cells`` cells in grid order: ``(sample_id, cell_id, chunk_id)``."""
    boxed = cells.select(SAMPLE, CELL, "x", "y").join(spatial.extents(cells), SAMPLE)
    bins = F.ceil(F.sqrt(F.col("n_cells") / F.lit(float(chunk_cells)))).cast("int")
    placed = (_square(boxed, bins, False).withColumn("_h", hash_key(CELL, seed))
              .withColumn("_part", _hash_part(F.col("n_cells"))))
    ranked = bucketed_rank(placed, [SAMPLE], ["gx", "gy", "_part"], [F.col("_h"), F.col(CELL)])
    return ranked.select(SAMPLE, CELL, F.floor((F.col("rn") - 1) / chunk_cells).cast("int").alias("chunk_id"))


def halo_chunks(cells: DataFrame, edges: DataFrame, chunk_cells: int, hops: int = 2) -> DataFrame:
    """``chunk_members(sample_id, chunk_id, cell_id, is_core)``: core cells with their context."""
    core = settle(spatial_chunks(cells, chunk_cells))
    reached = graph.khop_expand(core, edges, hops)
    return reached.join(core.withColumn("is_core", F.lit(True)), [SAMPLE, "chunk_id", CELL], "left").na.fill(False, ["is_core"])


def grid_quota_sample(cells: DataFrame, target: DataFrame, bins: Column, group: tuple[str, ...] = (SAMPLE,),
                      boxes: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Even sampling over occupied squares, topped up from the rest, trimmed to the target.

    ``target`` has one row per group with column ``target``. Groups no larger than their
    target are returned whole.
    """
    keys = list(group)
    boxes = spatial.extents(cells) if boxes is None else boxes
    placed = _square(cells.join(boxes.select(SAMPLE, "xmin", "xmax", "ymin", "ymax"), SAMPLE).join(target, keys), bins, True)
    squares = placed.groupBy(*keys, "gx", "gy").agg(F.count(F.lit(1)).alias("_in"))
    per = squares.groupBy(*keys).agg(F.count(F.lit(1)).alias("_occupied"), F.sum("_in").alias("_all"))
    ranked = hash_rank(placed.join(squares, [*keys, "gx", "gy"]), [*keys, "gx", "gy"], CELL, seed, "_r", size="_in").join(per, keys)
    quota = F.greatest(F.lit(1), F.floor(F.col("target") / F.col("_occupied")))
    flagged = (ranked.withColumn("_late", F.when(F.col("_r") <= quota, 0).otherwise(1)).withColumn("_h", hash_key(CELL, seed))
                     .withColumn("_part", _hash_part(F.col("_all"))))
    order = bucketed_rank(flagged, keys, ["_late", "_part"], [F.col("_h"), F.col(CELL)], "_o")
    kept = order.filter((F.col("_o") <= F.col("target")) | (F.col("_all") <= F.col("target")))
    return kept.select(*dict.fromkeys([*keys, SAMPLE, CELL]))


def stratified_quota(sizes: DataFrame, target: int) -> DataFrame:
    """Quota per cluster: small clusters whole while the budget lasts, the rest by size.

    ``sizes(sample_id, cluster, size)`` has one row per cluster (at most 500 a sample).
    Samples no larger than the target keep every cell.
    """
    w = Window.partitionBy(SAMPLE)
    running = w.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    n_clusters, rare_cap = F.col("n_clusters"), F.greatest(F.lit(20), F.floor(F.lit(target) / F.col("n_clusters")))
    t = (sizes.withColumn("_rare", F.col("size") <= rare_cap)
              .withColumn("_rs", F.when(F.col("_rare"), F.col("size")).otherwise(F.lit(0)))
              .withColumn("_before", F.coalesce(F.sum("_rs").over(running), F.lit(0)))
              .withColumn("_rareq", F.when(F.col("_rare"), F.least(F.col("size"), F.greatest(F.lit(0), F.lit(target) - F.col("_before"))))
                          .otherwise(F.lit(0)))
              .withColumn("_left", F.lit(target) - F.sum("_rareq").over(w))
              .withColumn("_big", F.when(~F.col("_rare"), F.col("size")).otherwise(F.lit(0)))
              .withColumn("_bigsum", F.sum("_big").over(w))
              .withColumn("_share", F.when(~F.col("_rare") & (F.col("_left") > 0),
                                           F.floor(F.col("_left") * (F.col("size") / F.col("_bigsum")))).otherwise(F.lit(0)))
              .withColumn("_gap", F.greatest(F.lit(0), F.col("_left") - F.sum("_share").over(w)))
              .withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_big"), "cluster"))))
    extra = F.when(~F.col("_rare") & (F.col("_rank") == 1) & (F.col("_left") > 0), F.col("_gap")).otherwise(F.lit(0))
    whole = F.sum("size").over(w) <= target
    quota = F.when(whole, F.col("size")).when(F.col("_rare"), F.col("_rareq")).otherwise(F.col("_share") + extra)
    return t.select(SAMPLE, "cluster", "size", n_clusters, quota.cast("long").alias("quota"))


def stratified_batches(chunks: DataFrame, batch: int, seed: int = 42) -> DataFrame:
    """At most ``batch`` chunks a batch; a patient comes twice in one only if it has more chunks than there are batches.

    Patients stand in random order, each with its chunks side by side, and are dealt out to the batches in turn: chunks of one
    patient go to different batches until all have one. The window over patients has a row for each.
    """
    dealt = hash_rank(chunks, ["patient_id"], "chunk_key", seed, "deal")
    patients = chunks.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", hash_key("patient_id", seed))
    before = Window.orderBy("_h", "patient_id")
    offsets = patients.select("patient_id", (F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"),
                              F.ceil(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / batch).alias("_batches"))
    place = F.col("_before") + F.col("deal") - 1
    return dealt.join(offsets, "patient_id").select("patient_id", "chunk_key", (place % F.col("_batches")).cast("int").alias("batch_id"))


def cluster_cells(placed: DataFrame, sizes: DataFrame, rounds: int = 6, part_rows: int = 50_000,
                  seed: int = 42) -> DataFrame:
    """K-means inside every sample at once: adds ``cluster`` to ``placed(sample_id, cell_id, pc, ...)``.

    ``sizes(sample_id, n_cells, n_clusters)``. A sample is worked on in parts of bounded size; a round
    only shuffles sums per centre. Starting centres are cells picked by hash.
    """
    parts = F.ceil(F.col("n_cells") / F.lit(float(part_rows))).cast("int")
    cells = settle(placed.join(sizes.select(SAMPLE, "n_clusters", parts.alias("_parts")), SAMPLE)
                         .withColumn("_part", F.pmod(F.xxhash64(CELL), F.col("_parts")).cast("int")))
    first = hash_rank(cells, [SAMPLE], CELL, seed).filter(F.col("rn") <= F.col("n_clusters"))
    centres = settle(first.select(SAMPLE, (F.col("rn") - 1).cast("int").alias("cluster"), F.col("pc").alias("centre")))
    reach = settle(cells.select(SAMPLE, "_parts").distinct()
                        .select(SAMPLE, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")))
    slot = [SAMPLE, "_part"]

    def spread():
        t = centres.join(reach, SAMPLE).select(*slot, "cluster", "centre")
        return t.toDF("_s", "_p", "cluster", "centre").groupBy("_s", "_p")

    def nearest(left, right):
        x, c = np.stack(left["pc"].to_numpy()), np.stack(right["centre"].to_numpy())
        best = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 4096):
            b = x[i:i + 4096]
            best[i:i + 4096] = np.argmin((c * c).sum(1)[None, :] - 2.0 * b @ c.T, axis=1)
        return x, right["cluster"].to_numpy()[best]

    def totals(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"sample_id": [], "cluster": [], "n": [], "total": []})
        x, label = nearest(left, right)
        ids = np.unique(label)
        return pd.DataFrame({"sample_id": key[0], "cluster": ids, "n": [int((label == i).sum()) for i in ids],
                             "total": [x[label == i].sum(0) for i in ids]})

    def label(left, right):
        return left[[SAMPLE, CELL]].assign(cluster=nearest(left, right)[1] if len(left) else [])

    for _ in range(rounds):
        sums = (cells.groupBy(*slot).cogroup(spread())
                     .applyInPandas(totals, "sample_id string, cluster int, n long, total array<double>"))
        means = (sums.select(SAMPLE, "cluster", "n", F.posexplode("total").alias("i", "t")).groupBy(SAMPLE, "cluster", "i")
                     .agg((F.sum("t") / F.sum("n")).alias("m")).groupBy(SAMPLE, "cluster")
                     .agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("r")).select(SAMPLE, "cluster", F.col("r.m").alias("_new")))
        centres = settle(centres.join(means, [SAMPLE, "cluster"], "left")
                                .select(SAMPLE, "cluster", F.coalesce("_new", "centre").alias("centre")))
    found = (cells.groupBy(*slot).cogroup(spread())
                  .applyInPandas(label, "sample_id string, cell_id long, cluster int"))
    return settle(placed.join(found, [SAMPLE, CELL]))


def expression_sketch(cells: DataFrame, expression: DataFrame, target: int, components: int = 50,
                      seed: int = 42) -> DataFrame:
    """Cells of each large sample chosen evenly over expression clusters and space.

    log1p, unit length, uncentred singular vectors over the cohort, k-means, quotas, grid sampling.
    Samples no larger than the target are returned whole.
    """
    sizes = (cells.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_cells"))
                  .withColumn("n_clusters", F.least(F.lit(500), F.greatest(F.lit(2), F.floor(F.col("n_cells") / 20))).cast("int")))
    genes = settle(factor.vocabulary(expression))
    k = max(1, min(components, genes.count() - 1))
    logged = expression.withColumn("v", F.log1p("value"))
    unit = l2_normalize(logged, [SAMPLE, CELL], "v", "u")
    packed = settle(factor.pack(unit, genes, "u"))
    axes = factor.singular_axes(packed, genes.count(), k, seed=seed)
    zero = F.array_repeat(F.lit(0.0), axes.shape[1])
    large = sizes.filter(F.col("n_cells") > target)
    placed = settle(cells.select(SAMPLE, CELL, "x", "y").join(large.select(SAMPLE), SAMPLE, "left_semi")
                         .join(factor.project(packed, axes), [SAMPLE, CELL], "left")
                         .withColumn("pc", F.coalesce("pc", zero)))
    labelled = cluster_cells(placed, large, seed=seed).drop("pc")
    counts = (labelled.groupBy(SAMPLE, "cluster").agg(F.count(F.lit(1)).alias("size"))
                      .join(large.select(SAMPLE, "n_clusters"), SAMPLE))
    quotas = stratified_quota(counts, target).filter("quota > 0").select(SAMPLE, "cluster", F.col("quota").alias("target"))
    picked = grid_quota_sample(labelled, quotas, F.lit(max(1, int(target ** 0.5))), (SAMPLE, "cluster"),
                               spatial.extents(labelled), seed).select(SAMPLE, CELL)
    small = cells.join(large.select(SAMPLE), SAMPLE, "left_anti").select(SAMPLE, CELL)
    return cells.join(settle(picked.unionByName(small)), [SAMPLE, CELL], "left_semi")
