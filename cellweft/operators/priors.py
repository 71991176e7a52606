"""Prior programs: marker-set clusters, data-driven dictionaries and the sieve between them.

Set tables are long: ``signatures(lineage, gene)``, ``sets(set_id, gene)``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators import factor, features, graph, qc, trend
from cellweft.operators.ordering import hash_rank, top_per_group
from cellweft.operators.programs import top_genes
from cellweft.operators.sets import BLOCK_SETS, nearest_clusters, pack_sets, set_pairs
from cellweft.session import discard, settle

SAMPLE, CELL, GENE, PROGRAM = "sample_id", "cell_id", "gene", "program_id"


def jaccard_pairs(signatures: DataFrame) -> DataFrame:
    """Jaccard distance of lineage pairs that share a gene; all other pairs are at distance 1."""
    s = signatures.select(F.col("lineage").alias("a"), GENE).distinct()
    return set_pairs(s, None, "distance", lambda shared, na, nb: 1 - shared / (na + nb - shared))


def overlap_coefficients(left: DataFrame, right: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """``(a, b, overlap)`` for sets (a, gene) and (b, gene) with a common gene; without ``right``, pairs ``a < b`` of ``left``; ``least`` leaves out smaller ones."""
    return set_pairs(left, right, "overlap", lambda shared, na, nb: shared / np.minimum(na, nb), least)


def average_linkage(signatures: DataFrame, threshold: float | None = 0.60, n_clusters: int | None = None) -> DataFrame:
    """Clusters of lineages by mean Jaccard distance: ``(lineage, cluster)``.

    Pairs that are each other's nearest merge in the same round, which yields the same tree as one
    merge at a time (average linkage is reducible). No table of pairs is kept: a round looks up the nearest cluster of those only that
    merged or whose nearest one did (``sets.nearest_clusters``), as no other can have come nearer. Equal sets, at distance zero, merge first. A pair
    without a common gene is at distance one. With a threshold, merging stops there. Else the whole tree is built and its lowest
    merges are taken until ``n_clusters`` are left; clusters that share no gene then join the last in order of name.
    """
    ids = signatures.select("lineage").distinct()
    packed = pack_sets(signatures.select(F.col("lineage").alias("id"), GENE).distinct())[0]
    merges = []
    # A null counts as a gene that nothing shares, so a set that lists one is not at distance zero from its like.
    whole = (F.size("genes") > 0) & (F.col("n") == F.size("genes")) & F.lit(threshold is None or threshold > 0)
    alike = F.struct(F.when(whole, F.sha2(F.to_json(F.array_sort("genes")), 256)).alias("genes"), F.when(~whole, F.col("id")).alias("id"))
    classes = settle(packed.groupBy(alike.alias("_same")).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list("id")).alias("ids")))
    if threshold is None:
        merges.append(settle(classes.select("id", F.posexplode(F.slice("ids", 2, F.greatest(F.size("ids"), F.lit(1)))).alias("_r", "b"))
                             .orderBy("_r", "id").select(F.lit(0.0).alias("d"), F.col("id").alias("a"), "b")))
    held = settle(packed.join(classes.select("id", "copies"), "id").withColumn("cluster", F.col("id")))
    n_held = held.count()
    best = settle(nearest_clusters(held, held, n_held, n_held))
    while True:
        key = best.select("d", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"))
        mutual = key.groupBy("a", "b").agg(F.min("d").alias("d"), F.count(F.lit(1)).alias("c")).filter("c = 2").select("d", "a", "b")
        if threshold is not None:
            mutual = mutual.filter(F.col("d") < threshold)
        mutual = settle(mutual)
        if mutual.isEmpty():
            break
        merges.append(mutual)
        into = mutual.select(F.col("b").alias("cluster"), F.col("a").alias("new"))
        before, last = held, best
        held = settle(held.join(into, "cluster", "left").withColumn("cluster", F.coalesce("new", "cluster")).select(*held.columns))
        touched = mutual.select(F.explode(F.array("a", "b")).alias("me"))
        kept = best.join(touched, "me", "left_anti").join(touched.withColumnRenamed("me", "other"), "other", "left_anti").select("me", "d", "other")
        asking = held.join(kept.select(F.col("me").alias("cluster")), "cluster", "left_anti").select(*held.columns)
        best = settle(kept.unionByName(nearest_clusters(asking, held, asking.count() if n_held > BLOCK_SETS else n_held, n_held)))
        for table in (before, last):
            discard(table)
    found = classes.select("id", F.explode("ids").alias("lineage")).join(held.select("id", "cluster"), "id").select("lineage", "cluster")
    member = ids.join(found, "lineage", "left")  # a null lineage is in no cluster, but numbered as one
    if threshold is None and merges:
        member = _cut_tree(ids, reduce(DataFrame.unionByName, merges), n_clusters or 1)
    w = Window.orderBy("cluster")
    number = F.row_number().over(w) - 1
    number = number if threshold is not None else F.least(number, F.lit((n_clusters or 1) - 1))
    order = member.select("cluster").distinct().withColumn("cluster_no", number.cast("int"))
    return member.join(order, "cluster").select("lineage", F.col("cluster_no").alias("cluster"))


def _cut_tree(ids: DataFrame, merges: DataFrame, n_clusters: int) -> DataFrame:
    """``(lineage, cluster)`` after the lowest merges ``(d, a, b)``, ``b`` into ``a``, of a tree; heights never fall towards the root.

    A merge of equal height is taken after those below it. The table of merges has a row for each lineage at most.
    """
    spare = max(ids.count() - n_clusters, 0)
    low = settle(merges.withColumn("_i", F.monotonically_increasing_id()).orderBy("d", "_i").limit(spare).select(F.col("b").alias("_old"), F.col("a").alias("_new")))
    member = ids.select("lineage", F.col("lineage").alias("cluster"))
    while True:
        found = settle(member.join(low, member["cluster"] == low["_old"], "left").select("lineage", F.coalesce("_new", "cluster").alias("cluster"),
                                                                                           F.col("_new").isNotNull().alias("_moved")))
        member = found.drop("_moved")
        if found.filter("_moved").isEmpty():
            return member


def consensus_markers(signatures: DataFrame, clusters: DataFrame, frequency: float = 0.30, least: int = 10,
                      most: int = 100) -> DataFrame:
    """Marker genes per cluster: frequent genes, bounded in number; thin clusters disappear.

    Output ``(cluster, gene, n, n_children)``. The windows hold genes of one cluster.
    """
    s = signatures.select("lineage", GENE).distinct().join(clusters, "lineage")
    children = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_children"))
    freq = s.groupBy("cluster", GENE).agg(F.count(F.lit(1)).alias("n")).join(children, "cluster")
    per = Window.partitionBy("cluster")
    passing = (F.col("n_children") == 1) | (F.col("n") / F.col("n_children") >= frequency)
    t = (freq.withColumn("_pass", passing)
             .withColumn("_n_pass", F.count_if(F.col("_pass")).over(per))
             .withColumn("_n_union", F.count(F.lit(1)).over(per))
             .withColumn("_r_all", F.row_number().over(per.orderBy(F.desc("n"), GENE)))
             .withColumn("_r_pass", F.row_number().over(per.orderBy(F.desc("_pass"), F.desc("n"), GENE))))
    few = F.col("_n_pass") < least
    keep = F.when(~few, F.col("_pass") & (F.col("_r_pass") <= most)).otherwise(
        (F.col("_n_union") >= least) & (F.col("_r_all") <= least))
    return t.filter(keep).select("cluster", GENE, "n", "n_children")


def marker_set_clusters(signatures: DataFrame, threshold: float | None = 0.60, n_clusters: int | None = None,
                        frequency: float = 0.30, least: int = 10, most: int = 100) -> tuple[DataFrame, DataFrame]:
    clusters = settle(average_linkage(signatures, threshold, n_clusters))
    return clusters, settle(consensus_markers(signatures, clusters, frequency, least, most))


def top_cells_per_gene(weights: DataFrame, n: int = 2000, value: str = "tfidf") -> DataFrame:
    """Cells among the top ``n`` of any gene, picked in two salted steps because a gene may be everywhere."""
    best = top_per_group(weights, [GENE], [F.desc(F.col(value)), F.col(SAMPLE), F.col(CELL)], n, F.xxhash64(SAMPLE, CELL))
    return best.select(SAMPLE, CELL).distinct()


def prior_matrix(cells: DataFrame, expression: DataFrame, cells_per_sample: int | None = None, pool: int | None = None,
                 per_gene: int = 2000, seed: int = 42) -> DataFrame:
    """tf-idf of winsorised counts for the cells the dictionary is learned from: all of them.

    A caller may ask for fewer: ``cells_per_sample`` by chance, and beyond a ``pool`` of cells the top ``per_gene`` of each gene.
    """
    weights = settle(features.tfidf(cells, qc.winsorize(expression)))
    if cells_per_sample is None and pool is None:
        return weights
    capped = hash_rank(weights.select(SAMPLE, CELL).distinct(), [SAMPLE], CELL, seed).filter(F.col("rn") <= (cells_per_sample or 2 ** 62))
    used = settle(weights.join(capped.select(SAMPLE, CELL), [SAMPLE, CELL], "left_semi"))
    if pool is not None and used.select(SAMPLE, CELL).distinct().count() > pool:
        used = used.join(top_cells_per_gene(used, per_gene), [SAMPLE, CELL], "left_semi")
    return used


def program_dictionary(weights: DataFrame, genes: DataFrame, components: int = 100, rounds: int = 150,
                       seed: int = 42, value: str = "tfidf") -> tuple[np.ndarray, list[float]]:
    """Non-negative dictionary of the weights and its loss history."""
    packed = settle(factor.pack(weights, genes, value))
    n = genes.count()
    start = np.random.default_rng(seed).random((components, n)) + 0.1
    return factor.factorize(packed, n, start, rounds)


def seeded_start(genes: DataFrame, prior: DataFrame, extra: int = 0) -> np.ndarray:
    """The dictionary a fit starts from: genes of a program's prior set weigh e**4 times the others; ``extra`` programs are nearly flat."""
    n = genes.count()
    active = factor.dictionary_matrix(prior.withColumn("weight", F.lit(1.0)), genes) > 0
    if extra:
        active = np.vstack([active, np.zeros((extra, n), dtype=bool)])
    logits = np.where(active, 2.0, -2.0)
    if extra:
        logits[-extra:] += 0.1 * np.random.default_rng(0).standard_normal((extra, n))
    return np.exp(logits) / np.exp(logits).sum(1, keepdims=True)


def seeded_programs(expression: DataFrame, genes: DataFrame, prior: DataFrame, rounds: int, extra: int = 0,
                    value: str = "lognorm") -> tuple[np.ndarray, list[float], DataFrame]:
    """Programs that start from prior gene sets, with the packed cells they were fitted on."""
    start = seeded_start(genes, prior, extra)
    packed = settle(factor.pack(expression, genes, value))
    h, losses = factor.factorize(packed, start.shape[1], start, rounds)
    return h / (h.sum(1, keepdims=True) + 1e-9), losses, packed


class Fit(NamedTuple):
    """A dictionary (programs x genes), the round it is from, why rounds ended, and ``history(step, train_loss, val_loss, sharpness, chosen, reason)``."""

    programs: np.ndarray
    step: int
    reason: str
    history: DataFrame
    packed: DataFrame


def validated_programs(expression: DataFrame, split: DataFrame, genes: DataFrame, prior: DataFrame, rounds: int, extra: int = 0, value: str = "lognorm",
                       window: int = 8, drop: float = 0.008, tolerance: float = 0.0) -> Fit:
    """Programs that start from prior gene sets and are fitted on the training cells of ``split(sample_id, cell_id, is_train)`` only.

    Each round reads the packed cells once: training cells give the sums of the next dictionary, held-out cells are measured with the present
    one. Rounds end when the trend of the held-out loss over ``window`` rounds is flat (``trend.plateau_step``: reason ``plateau``), when that loss
    overshoots its best by more than its noise (``trend.loss_ceiling``: ``overshoot``), or after ``rounds`` (``rounds``). Of the rounds whose
    held-out loss is within ``tolerance`` of the best, the one with the least loss over root sharpness is taken (``trend.pareto_best``), so at the default
    the result is never above the best held-out loss. Cells missing from ``split`` take no part; if none is held out, the training loss
    stands in. The driver holds the dictionaries that may still be chosen, programs x genes each.
    """
    spark = expression.sparkSession
    h = np.maximum(seeded_start(genes, prior, extra), 1e-9)
    n = h.shape[1]
    packed = settle(factor.pack(expression, genes, value).join(split.select(SAMPLE, CELL, "is_train"), [SAMPLE, CELL]).filter("is_train is not null"))
    rows: list[tuple[int, float, float, float]] = []
    kept: dict[int, np.ndarray] = {}
    reason = "rounds"
    for step in range(max(rounds, 1)):
        wx, pull, train, held, sharp = factor.split_sums(packed, n, h)
        held = train if np.isnan(held) else held
        rows.append((step, train, held, sharp))
        best = min(r[2] for r in rows)
        kept[step] = h
        kept = {s: m for s, m in kept.items() if rows[s][2] <= best * (1 + tolerance)}
        if step + 1 >= window:
            # A few rows in one partition: both checks are one job of one task.
            seen = spark.createDataFrame(pa.table({"run_id": ["fit"] * len(rows), "step": pa.array([r[0] for r in rows], pa.int32()),
                                                   "value": pa.array([r[2] for r in rows], pa.float64())})).coalesce(1)
            flat = trend.plateau_step(trend.trend_window(seen, window), window, drop, rounds + 1).select(F.lit("plateau").alias("why"))
            high = trend.loss_ceiling(seen, window).filter((F.col("step") == step) & F.col("overshoot")).select(F.lit("overshoot").alias("why"))
            found = {r.why for r in flat.unionByName(high).collect()}
            if found:
                reason = "plateau" if "plateau" in found else "overshoot"
                break
        h = h * (wx / (pull + 1e-12))
    steps, *measured = zip(*rows, strict=True)
    told = spark.createDataFrame(pa.table({"run_id": ["fit"] * len(rows), "step": pa.array(steps, pa.int32())} | {
        c: pa.array(map(float, v), pa.float64()) for c, v in zip(("train_loss", "val_loss", "sharpness"), measured, strict=True)})).coalesce(1)
    eligible = F.col("step").isin(list(kept))
    chosen = trend.pareto_best(told, F.col("val_loss"), F.col("sharpness"), eligible).first().best_step
    history = told.drop("run_id").withColumn("chosen", F.col("step") == chosen).withColumn("reason", F.lit(reason))
    found = kept[chosen]
    return Fit(found / (found.sum(1, keepdims=True) + 1e-9), chosen, reason, history, packed)


def smooth_expression(expression: DataFrame, edges: DataFrame, hops: int, alpha: float = 0.5,
                      value: str = "lognorm", cells: DataFrame | None = None) -> DataFrame:
    """Expression mixed with its spatial neighbourhood, weights normalised per receiving cell."""
    total = edges.groupBy(F.col(SAMPLE).alias("_s"), F.col("dst").alias("_d")).agg(F.sum("weight").alias("_total"))
    wired = (edges.join(total, (F.col(SAMPLE) == F.col("_s")) & (F.col("dst") == F.col("_d")))
             .withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), F.col("_total")), F.lit(0.0))).drop("_s", "_d", "_total"))
    return graph.propagate(expression, wired, hops, alpha, value=value, attention=False, cells=cells)


def greedy_dedupe(candidates: DataFrame, overlaps: DataFrame, limit: float = 0.30, most: int = 8) -> DataFrame:
    """Accept by falling energy unless too close to one already accepted: ``(set_id, energy, position)``.

    One round accepts the best candidate left and removes what it makes redundant.
    """
    left = settle(candidates.select("set_id", "energy"))
    close = settle(overlaps.filter(F.col("overlap") >= limit).select("a", "b"))
    taken = None
    for position in range(most):
        best = settle(left.orderBy(F.desc("energy"), "set_id").limit(1))
        if best.isEmpty():
            break
        row = best.withColumn("position", F.lit(position))
        taken = row if taken is None else taken.unionByName(row)
        near = close.join(best.withColumnRenamed("set_id", "a"), "a", "left_semi").select(F.col("b").alias("set_id"))
        left = settle(left.join(near.unionByName(best.select("set_id")), "set_id", "left_anti"))
    return taken if taken is not None else candidates.select("set_id", "energy", F.lit(0).alias("position")).limit(0)


def program_candidates(dictionary: DataFrame, nouns: DataFrame, top_k: int = 35, noun_limit: float = 0.35,
                       inner_limit: float = 0.30, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Dictionary programs that are neither marker clusters nor one another: ``(accepted, statistics)``."""
    sets = settle(top_genes(dictionary, top_k).select(F.col(PROGRAM).alias("a"), GENE))
    energy = dictionary.groupBy(F.col(PROGRAM).alias("set_id")).agg(F.sum("weight").alias("energy"))
    near = overlap_coefficients(sets, nouns.select(F.col("cluster").alias("b"), GENE)).groupBy("a").agg(F.max("overlap").alias("top"))
    mapped = near.filter(F.col("top") >= noun_limit).select(F.col("a").alias("set_id"))
    free = settle(energy.join(mapped, "set_id", "left_anti"))
    inner = overlap_coefficients(sets, sets.withColumnRenamed("a", "b")).filter("a <> b")
    accepted = settle(greedy_dedupe(free, inner, inner_limit, most))
    n_all, n_free, n_kept = energy.count(), free.count(), accepted.count()
    blocked = (free.join(accepted, "set_id", "left_anti").withColumnRenamed("set_id", "b")
                   .join(inner.filter(F.col("overlap") >= inner_limit), "b")
                   .join(accepted.select(F.col("set_id").alias("a")), "a", "left_semi").select("b").distinct().count())
    stats = dictionary.sparkSession.createDataFrame(
        [("mapped", n_all - n_free), ("redundant", blocked), ("over_budget", n_free - n_kept - blocked), ("kept", n_kept)],
        "name string, n long")
    return accepted, stats


def prior_programs(nouns: DataFrame, dictionary: DataFrame, accepted: DataFrame, top_k: int = 35) -> DataFrame:
    """Marker clusters followed by accepted programs, renumbered: ``(program_id, gene, kind)``."""
    a = nouns.select(F.lit(0).alias("_o"), F.col("cluster").alias("_id"), GENE, F.lit("markers").alias("kind"))
    sets = top_genes(dictionary, top_k).withColumnRenamed(PROGRAM, "set_id").join(accepted, "set_id")
    b = sets.select(F.lit(1).alias("_o"), F.col("position").alias("_id"), GENE, F.lit("dictionary").alias("kind"))
    both = a.unionByName(b)
    w = Window.orderBy("_o", "_id")
    ids = both.select("_o", "_id").distinct().withColumn(PROGRAM, (F.row_number().over(w) - 1).cast("int"))
    return both.join(ids, ["_o", "_id"]).select(PROGRAM, GENE, "kind")


def prior_report(clusters: DataFrame, nouns: DataFrame, accepted: DataFrame, dictionary: DataFrame,
                 stats: DataFrame) -> DataFrame:
    """Report lines ``(section, position, line)``."""
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), GENE)
    top5 = (nouns.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").groupBy("cluster", "n_children")
                 .agg(F.array_join(F.sort_array(F.collect_list(F.struct("_r", GENE)))[GENE], ",").alias("top")))
    names = clusters.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list(F.col("lineage").cast("string"))), ",").alias("states"))
    numbered = top5.join(names, "cluster").withColumn("position", F.row_number().over(Window.orderBy("cluster")) - 1)
    a = numbered.select(F.lit("NOUNS").alias("section"), "position",
                        F.format_string("N%02d|n=%02d|top=[%s]|states=[%s]", "position", "n_children", "top", "states").alias("line"))
    s = stats.groupBy().pivot("name", ["mapped", "redundant", "over_budget", "kept"]).agg(F.first("n"))
    b = s.select(F.lit("SIEVE_STATS").alias("section"), F.lit(0).alias("position"),
                 F.format_string("mapped=%d|chimera=0|redundant=%d|intermediate=%d|kept=%d",
                                 "mapped", "redundant", "over_budget", "kept").alias("line"))
    t = (top_genes(dictionary, 10).withColumnRenamed(PROGRAM, "set_id").join(accepted, "set_id").groupBy("set_id", "position")
         .agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", GENE)))[GENE], ",").alias("top")))
    c = t.select(F.lit("ADJECTIVES").alias("section"), "position",
                 F.format_string("A%02d|raw_topic=%02d|top10=[%s]", "position", "set_id", "top").alias("line"))
    return a.unionByName(b).unionByName(c)
