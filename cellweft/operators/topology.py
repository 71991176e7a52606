"""Which programs sit next to each other more than spatial blocks explain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.scalar import EPS, interface_label, log2_enrichment
from cellweft.operators import programs as P
from cellweft.operators import qc, spatial
from cellweft.operators.ordering import hash_rank
from cellweft.operators.shuffled import shuffled_sums
from cellweft.operators.spatial import Near
from cellweft.session import discard, settle

SAMPLE, CELL, PROGRAM = "sample_id", "cell_id", "program_id"


def topology_radius(cells: DataFrame, multiplier: float = 3.33) -> DataFrame:
    near = spatial.nearest_distance_median(cells)
    return near.select(SAMPLE, (F.col("median_dist") * multiplier).alias("radius"))


def spatial_blocks(cells: DataFrame, block_cells: int = 200) -> DataFrame:
    """``(sample_id, cell_id, block, n_block)``: grid of about one square per 200 cells."""
    boxed = cells.select(SAMPLE, CELL, "x", "y").join(spatial.extents(cells), SAMPLE)
    squares = F.greatest(F.lit(2), F.floor(F.col("n_cells") / block_cells))
    bins = F.greatest(F.lit(2), F.ceil(F.sqrt(squares))).cast("int")
    placed = boxed.withColumn("_n", bins)
    gx = spatial.grid_bin(F.col("x"), F.col("xmin"), F.col("xmax"), F.col("_n"))
    gy = spatial.grid_bin(F.col("y"), F.col("ymin"), F.col("ymax"), F.col("_n"))
    placed = placed.withColumn("block", (gx - 1) * (F.col("_n") + 1) + gy - 1).select(SAMPLE, CELL, "block")
    sizes = placed.groupBy(SAMPLE, "block").agg(F.count(F.lit(1)).alias("n_block"))
    return placed.join(sizes, [SAMPLE, "block"]).select(SAMPLE, CELL, "block", "n_block")


def _pair_sums(pairs: DataFrame | Near, weights: DataFrame, extra: list[str]) -> DataFrame:
    """Sum over unordered pairs of w[src,i] * w[dst,j], both orders: ``(sample_id, *extra, i, j, value)``.

    Neighbour sums come first, so the product of programs is formed per cell, not per pair. Of cells at one point only sums are needed:
    all products of a site less those of a cell with itself.
    """
    if isinstance(pairs, Near):
        return _site_sums(pairs, weights, extra)
    w = weights.select(SAMPLE, *extra, CELL, PROGRAM, "frac")
    around = (pairs.select(SAMPLE, "src", "dst").join(w.withColumnRenamed(CELL, "dst"), [SAMPLE, "dst"])
                   .groupBy(SAMPLE, *extra, F.col("src").alias(CELL), F.col(PROGRAM).alias("j")).agg(F.sum("frac").alias("z")))
    half = (w.withColumnRenamed(PROGRAM, "i").join(around, [SAMPLE, *extra, CELL])
             .groupBy(SAMPLE, *extra, "i", "j").agg(F.sum(F.col("frac") * F.col("z")).alias("value")))
    turned = half.select(SAMPLE, *extra, F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return half.unionByName(turned).groupBy(SAMPLE, *extra, "i", "j").agg(F.sum("value").alias("value"))


def _site_sums(near: Near, weights: DataFrame, extra: list[str]) -> DataFrame:
    key = [SAMPLE, *extra, "i", "j"]
    own = settle(weights.join(near.members, [SAMPLE, CELL]).groupBy(SAMPLE, *extra, CELL, "site", PROGRAM).agg(F.sum(F.col("frac") * F.col("n")).alias("frac")))
    sums = settle(own.groupBy(SAMPLE, *extra, "site", PROGRAM).agg(F.sum("frac").alias("frac"), F.count(F.lit(1)).alias("c")))
    apart = _pair_sums(near.pairs, sums.withColumnRenamed("site", CELL), extra).withColumn("met", F.lit(1).cast("long"))
    crowded = settle(near.members.groupBy(SAMPLE, "site").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(SAMPLE, "site"))

    def products(rows: DataFrame, at: list[str], count: Column, sign: int) -> DataFrame:
        rows = rows.join(crowded, [SAMPLE, "site"], "left_semi").select(*at, PROGRAM, "frac", count.alias("c"))
        each = F.collect_list(F.struct(F.col(PROGRAM).alias("p"), "frac", "c")).alias("w")
        pair = (rows.groupBy(*at).agg(each).withColumn("a", F.explode("w")).withColumn("b", F.explode("w"))
                .select(SAMPLE, *extra, F.col("a.p").alias("i"), F.col("b.p").alias("j"), (F.col("a.frac") * F.col("b.frac")).alias("v"), (F.col("a.c") * F.col("b.c")).alias("m")))
        return pair.groupBy(*key).agg((sign * F.sum("v")).alias("value"), (sign * F.sum("m")).alias("met"))

    together = products(sums, [SAMPLE, *extra, "site"], F.col("c"), 1).unionByName(products(own, [SAMPLE, *extra, CELL, "site"], F.lit(1).cast("long"), -1))
    # No row where every product is one of a cell with itself.
    together = together.groupBy(*key).agg(F.sum("value").alias("value"), F.sum("met").alias("met")).filter("met > 0")
    return apart.unionByName(together).groupBy(*key).agg(F.sum("value").alias("value"))


def _block_links(pairs: DataFrame | Near, b: DataFrame) -> DataFrame:
    """Pairs of cells between blocks, in both orders: ``(sample_id, ba, bb, m)``."""
    if isinstance(pairs, Near):
        rows = b.join(pairs.members, [SAMPLE, CELL]).groupBy(SAMPLE, "site", "block", CELL).agg(F.sum("n").alias("n"))
        sites = settle(rows.groupBy(SAMPLE, "site", "block").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")))
        inside = (sites.filter("n * n > q").groupBy(SAMPLE, F.col("block").alias("ba"), F.col("block").alias("bb"))
                  .agg(F.sum(F.col("n") * F.col("n") - F.col("q")).alias("m")))
        pairs, b = pairs.pairs, sites.select(SAMPLE, F.col("site").alias(CELL), "block", "n")
    else:
        inside, b = None, b.withColumn("n", F.lit(1).cast("long"))
    ends = (pairs.join(b.select(SAMPLE, F.col(CELL).alias("src"), F.col("block").alias("ba"), F.col("n").alias("na")), [SAMPLE, "src"])
                 .join(b.select(SAMPLE, F.col(CELL).alias("dst"), F.col("block").alias("bb"), F.col("n").alias("nb")), [SAMPLE, "dst"]))
    one_way = ends.groupBy(SAMPLE, "ba", "bb").agg(F.sum(F.col("na") * F.col("nb")).alias("m"))
    both = one_way.unionByName(one_way.select(SAMPLE, F.col("bb").alias("ba"), F.col("ba").alias("bb"), "m"))
    return (both if inside is None else both.unionByName(inside)).groupBy(SAMPLE, "ba", "bb").agg(F.sum("m").alias("m"))


def interaction_matrix(pairs: DataFrame | Near, fractions: DataFrame) -> DataFrame:
    """W'AW per sample for the symmetric pair matrix A."""
    return _pair_sums(pairs, fractions, [])


def block_null_mean(pairs: DataFrame | Near, blocks: DataFrame, fractions: DataFrame) -> DataFrame:
    """Exact expectation of the interaction matrix when cells are shuffled inside their blocks."""
    b = blocks.select(SAMPLE, CELL, "block")
    links = settle(_block_links(pairs, b))
    w = fractions.join(blocks, [SAMPLE, CELL])
    sums = w.groupBy(SAMPLE, "block", PROGRAM, "n_block").agg(F.sum("frac").alias("s"))
    a = sums.select(SAMPLE, F.col("block").alias("ba"), F.col(PROGRAM).alias("i"), F.col("s").alias("sa"), F.col("n_block").alias("na"))
    c = sums.select(SAMPLE, F.col("block").alias("bb"), F.col(PROGRAM).alias("j"), F.col("s").alias("sb"), F.col("n_block").alias("nb"))
    # Neighbouring blocks are summed before programs are paired: K rows for each pair of blocks, K^2 for each block.
    around = (links.filter("ba <> bb").join(c, [SAMPLE, "bb"]).groupBy(SAMPLE, "ba", "j")
              .agg(F.sum(F.col("m") * F.col("sb") / F.col("nb")).alias("v")))
    apart = around.join(a, [SAMPLE, "ba"]).select(SAMPLE, "i", "j", (F.col("v") * F.col("sa") / F.col("na")).alias("e"))
    slots = F.col("na") * (F.col("na") - 1)
    inner = links.filter("ba = bb").join(a, [SAMPLE, "ba"]).join(c, [SAMPLE, "bb"])
    within = inner.filter("na > 1").select(SAMPLE, "i", "j", (F.col("m") * F.col("sa") * F.col("sb") / slots).alias("e"))
    # What a cell would add by meeting itself: scaled cell by cell, so that sums are by pair of programs only, not by block as well.
    own = links.filter("ba = bb").select(SAMPLE, F.col("ba").alias("block"), "m")
    scaled = blocks.filter("n_block > 1").join(own, [SAMPLE, "block"]).select(SAMPLE, CELL, (-F.col("m") / (F.col("n_block") * (F.col("n_block") - 1))).alias("c"))
    left = fractions.join(scaled, [SAMPLE, CELL]).select(SAMPLE, CELL, F.col(PROGRAM).alias("i"), (F.col("c") * F.col("frac")).alias("fi"))
    right = fractions.select(SAMPLE, CELL, F.col(PROGRAM).alias("j"), F.col("frac").alias("fj"))
    minus = left.join(right, [SAMPLE, CELL]).groupBy(SAMPLE, "i", "j").agg(F.sum(F.col("fi") * F.col("fj")).alias("e"))
    return (apart.unionByName(within).unionByName(minus).groupBy(SAMPLE, "i", "j").agg(F.sum("e").alias("expected")))


def block_null_sd(pairs: DataFrame | Near, blocks: DataFrame, fractions: DataFrame, n_perms: int,
                  expected: DataFrame | None = None, batch: int = 20) -> DataFrame:
    """Standard deviation (population) of the interaction matrix over block permutations.

    In permutation p the cell of fixed rank r in a block takes the fractions of the cell whose
    hash order in p is r. Tiles of blocks are shuffled in one task each (``shuffled.shuffled_sums``); samples in which a tile doesn't fit one go
    through joins, where blocks of any size are ranked in parts and permutations come in batches. Of each permutation
    only the sums per (sample, i, j) of deviations from the exact expectation (``block_null_mean``) and of their
    squares remain, so nothing cancels when values are large against their spread.
    """
    key = [SAMPLE, "i", "j"]
    expected = settle(block_null_mean(pairs, blocks, fractions) if expected is None else expected)
    if not isinstance(pairs, Near):
        return _joined_null_sd(pairs, blocks, fractions, n_perms, expected, batch)
    sums, odd = shuffled_sums(pairs, blocks, fractions, n_perms)
    off = F.col("value") - F.coalesce("expected", F.lit(0.0))
    sums = sums.join(expected, key, "left").groupBy(*key).agg((F.sum(off) / n_perms).alias("s"), (F.sum(off * off) / n_perms).alias("q"))
    sd = sums.select(*key, F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s"), F.lit(0.0))).alias("sd"))
    if odd.isEmpty():
        return sd
    some = [t.join(odd, SAMPLE, "left_semi") for t in (blocks, fractions, expected, *pairs)]
    return sd.unionByName(_joined_null_sd(Near(*some[3:]), *some[:2], n_perms, some[2], batch))


def _joined_null_sd(pairs: DataFrame | Near, blocks: DataFrame, fractions: DataFrame, n_perms: int, expected: DataFrame, batch: int) -> DataFrame:
    """The same by joins: a row for each permutation and fraction."""
    key = [SAMPLE, "i", "j"]
    slot = [SAMPLE, "block"]
    fixed = settle(hash_rank(blocks, slot, CELL, "base", "rank", size="n_block")).select(*slot, CELL, "rank")
    batches = []
    for first in range(1, n_perms + 1, batch):
        perms = blocks.withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(min(first + batch - 1, n_perms)))))
        drawn = hash_rank(perms, [*slot, "perm"], CELL, F.col("perm"), "rank", size="n_block")
        moved = settle(drawn.select(*slot, "perm", "rank", F.col(CELL).alias("donor")).join(fixed, [*slot, "rank"])
                       .join(fractions.withColumnRenamed(CELL, "donor"), [SAMPLE, "donor"])
                       .select(SAMPLE, "perm", CELL, PROGRAM, "frac"))
        off = F.col("value") - F.coalesce("expected", F.lit(0.0))
        batches.append(settle(_pair_sums(pairs, moved, ["perm"]).join(expected, key, "left").groupBy(*key)
                              .agg(F.count(F.lit(1)).alias("_n"), F.sum(off).alias("_s"), F.sum(off * off).alias("_q"))))
        discard(moved)
    sums = reduce(DataFrame.unionByName, batches).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("_n", "_s", "_q")]).join(expected, key, "left")
    # A permutation without a row for a program pair has the value 0 there.
    gone, mean = n_perms - F.col("_n"), F.coalesce("expected", F.lit(0.0))
    s, q = (F.col("_s") - gone * mean) / n_perms, (F.col("_q") + gone * mean * mean) / n_perms
    return sums.select(*key, F.sqrt(F.greatest(q - s * s, F.lit(0.0))).alias("sd"))


def interface_stats(observed: DataFrame, expected: DataFrame, sd: DataFrame | None, mass: DataFrame,
                    names: DataFrame, least_mass: float = 0.01) -> DataFrame:
    """One row per unordered program pair of enough mass in a sample."""
    active = mass.filter(F.col("mass") > least_mass).join(names, PROGRAM)
    a = active.select(SAMPLE, F.col(PROGRAM).alias("i"), F.col("name").alias("_na"))
    b = active.select(SAMPLE, F.col(PROGRAM).alias("j"), F.col("name").alias("_nb"))
    pairs = a.join(b, SAMPLE).filter("i < j")
    t = (pairs.join(observed, [SAMPLE, "i", "j"], "left").join(expected, [SAMPLE, "i", "j"], "left"))
    obs, exp = 2 * F.coalesce("value", F.lit(0.0)), 2 * F.coalesce("expected", F.lit(0.0))
    cols = [F.col(SAMPLE).alias("Sample"), interface_label(F.col("_na"), F.col("_nb")).alias("Interface"),
            obs.alias("Continuous_Observed"), exp.alias("Continuous_Expected_Mean"),
            log2_enrichment(obs, exp).alias("Log2_Enrichment")]
    if sd is not None:
        t = t.join(sd, [SAMPLE, "i", "j"], "left")
        s = F.coalesce("sd", F.lit(0.0)) + EPS
        cols += [((obs - exp) / (F.sqrt(2 * s * s) + EPS)).alias("Spatial_Z_Score"), ((obs - exp) / (2 * s)).alias("z_exact")]
    return t.select(*cols)


def cohort_topology(cells: DataFrame, fractions: DataFrame, names: DataFrame, samples: DataFrame,
                    n_perms: int = 0, multiplier: float = 3.33, least_mass: float = 0.01,
                    least_cells: int = 50, pairs: DataFrame | Near | None = None) -> DataFrame:
    """Topology rows of all samples at once; ``n_perms = 0`` leaves the z columns out."""
    cells = settle(qc.min_cells_guard(cells.select(SAMPLE, CELL, "x", "y"), least_cells))
    fractions = settle(fractions.join(cells.select(SAMPLE, CELL), [SAMPLE, CELL], "left_semi")
                                .select(SAMPLE, CELL, PROGRAM, "frac"))
    if pairs is None:
        pairs = spatial.radius_sites(cells, settle(topology_radius(cells, multiplier)))
    blocks = settle(spatial_blocks(cells))
    expected = settle(block_null_mean(pairs, blocks, fractions))
    sd = block_null_sd(pairs, blocks, fractions, n_perms, expected) if n_perms else None
    stats = interface_stats(interaction_matrix(pairs, fractions), expected, sd,
                            P.topic_mass(cells, fractions), names, least_mass)
    meta = samples.select(F.col(SAMPLE).alias("Sample"), F.col("dataset_id").alias("Dataset"))
    return stats.join(meta, "Sample")


def sample_status(samples: DataFrame, results: DataFrame, reason: str = "no result") -> DataFrame:
    """Samples without a result; one failing sample does not stop the others."""
    done = results.select(F.col("Sample").alias(SAMPLE)).distinct()
    return samples.select(SAMPLE).join(done, SAMPLE, "left_anti").withColumn("reason", F.lit(reason))


def pending_samples(samples: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Samples not yet in the stored topology."""
    if stored is None:
        return samples
    return samples.join(stored.select(F.col("Sample").alias(SAMPLE)).distinct(), SAMPLE, "left_anti")


__all__ = ["topology_radius", "spatial_blocks", "interaction_matrix", "block_null_mean", "block_null_sd",
           "interface_stats", "cohort_topology", "sample_status", "pending_samples"]
