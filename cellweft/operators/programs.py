"""Programs ``(program_id, gene, weight)``: naming, scoring, fractions, panels and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions import simplex
from cellweft.functions.scalar import EPS
from cellweft.operators import qc
from cellweft.operators.ordering import bucketed_rank, exact_quantiles, hash_key, hash_rank
from cellweft.session import settle

SAMPLE, CELL, GENE, PROGRAM = "sample_id", "cell_id", "gene", "program_id"


def ids_of(programs: DataFrame) -> list[int]:
    """Program ids as plain numbers (a few hundred at most)."""
    return sorted(r[0] for r in programs.select(PROGRAM).distinct().collect())


def each_program(df: DataFrame, ids: list[int]) -> DataFrame:
    """Every row once per program id."""
    return df.withColumn(PROGRAM, F.explode(F.array(*[F.lit(i) for i in ids])))


def top_genes(programs: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(PROGRAM).orderBy(F.desc("weight"), GENE)
    return programs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def name_programs(programs: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """``"{position}_{g1}_{g2}_{g3}"`` for kept programs, positions from 1 in program order."""
    best = programs if kept is None else programs.join(kept.select(PROGRAM), PROGRAM, "left_semi")
    names = (top_genes(best, 3).groupBy(PROGRAM)
             .agg(F.sort_array(F.collect_list(F.struct("rank", GENE))).alias("_g"))
             .withColumn("position", F.row_number().over(Window.orderBy(PROGRAM))))
    return names.select(PROGRAM, F.concat_ws("_", F.col("position").cast("string"), F.col("_g.gene")).alias("name"))


def topic_mass(cells: DataFrame, fractions: DataFrame) -> DataFrame:
    """Mean fraction per sample and program over all cells."""
    return (fractions.groupBy(SAMPLE, PROGRAM).agg(F.sum("frac").alias("_s")).join(qc.sample_sizes(cells), SAMPLE)
                     .select(SAMPLE, PROGRAM, (F.col("_s") / F.col("n_cells")).alias("mass")))


def program_similarity(expression: DataFrame, programs: DataFrame, value: str = "lognorm") -> DataFrame:
    """Cosine of every cell with every program it shares a gene with."""
    v = F.col(value)
    norms = expression.groupBy(SAMPLE, CELL).agg(F.sqrt(F.sum(v * v)).alias("_nc"))
    unit = simplex.l2_normalize(programs, [PROGRAM], "weight", "_u").select(PROGRAM, GENE, "_u")
    dots = expression.join(unit, GENE).groupBy(SAMPLE, CELL, PROGRAM).agg(F.sum(v * F.col("_u")).alias("_d"))
    return dots.join(norms, [SAMPLE, CELL]).select(
        SAMPLE, CELL, PROGRAM, F.when(F.col("_nc") > 0, F.col("_d") / F.col("_nc")).otherwise(F.lit(0.0)).alias("similarity"))


def fractions_from_scores(scores: DataFrame, programs: DataFrame, scale: float = 16.0, alpha: float = 1.65,
                          score: str = "similarity") -> DataFrame:
    """Row-normalised entmax of scaled scores; programs without a score count as 0."""
    ids = F.array(*[F.lit(i) for i in ids_of(programs)])
    packed = scores.groupBy(SAMPLE, CELL).agg(F.map_from_entries(F.collect_list(F.struct(PROGRAM, F.col(score)))).alias("_m"))
    full = packed.withColumn("_ids", ids).withColumn("_s", F.transform("_ids", lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)) * scale))
    prob = full.withColumn("_p", simplex.entmax_array(F.col("_s"), alpha))
    rows = prob.select(SAMPLE, CELL, F.explode(F.arrays_zip(F.col("_ids").alias("i"), F.col("_p").alias("p"))).alias("_z"))
    return rows.filter("_z.p > 0").select(SAMPLE, CELL, F.col("_z.i").alias(PROGRAM), F.col("_z.p").alias("frac"))


def scale_by_total(fractions: DataFrame, expression: DataFrame, value: str = "lognorm") -> DataFrame:
    totals = expression.groupBy(SAMPLE, CELL).agg(F.sum(value).alias("_t"))
    return fractions.join(totals, [SAMPLE, CELL]).withColumn("frac", F.col("frac") * F.col("_t")).drop("_t")


def project_fractions(expression: DataFrame, programs: DataFrame, keep: DataFrame | None = None,
                      scale: float = 16.0, alpha: float = 1.65) -> DataFrame:
    """Fractions of the chosen programs for normalised expression, without refitting."""
    raw = scale_by_total(fractions_from_scores(program_similarity(expression, programs), programs, scale, alpha), expression)
    norm = simplex.row_normalize(raw, [SAMPLE, CELL], "frac", "frac")
    return norm if keep is None else norm.join(keep.select(PROGRAM), PROGRAM, "left_semi")


def reconstruct(fractions: DataFrame, programs: DataFrame) -> DataFrame:
    """Sum of frac * weight for every gene that a cell's programs list. A cell's fractions stay one row; genes meet them there, so no sum is shuffled."""
    f = (fractions.filter(F.col(PROGRAM).isNotNull()).groupBy(SAMPLE, CELL).agg(F.collect_list(F.struct(F.col(PROGRAM).alias("p"), F.col("frac").cast("double").alias("f"))).alias("_f")))
    listed = programs.filter(F.col(PROGRAM).isNotNull()).groupBy(GENE, PROGRAM).agg(F.sum("weight").cast("double").alias("w"))
    profile = settle(listed.groupBy(GENE).agg(F.map_from_entries(F.collect_list(F.struct(PROGRAM, "w"))).alias("_w")))

    def add(total: Column, x: Column) -> Column:
        part = x["f"] * F.element_at("_w", x["p"])
        return F.coalesce(total + part, total, part)

    met = f.crossJoin(profile).filter(F.exists("_f", lambda x: F.map_contains_key("_w", x["p"])))
    return met.select(SAMPLE, CELL, GENE, F.aggregate("_f", F.lit(None).cast("double"), add).alias("expected"))


def empirical_baseline(expression: DataFrame) -> DataFrame:
    """Cohort mean profile: share of each gene. The window holds one row per gene."""
    sums = expression.groupBy(GENE).agg(F.sum("value").alias("_s"))
    return sums.select(GENE, (F.col("_s") / (F.sum("_s").over(Window.partitionBy()) + EPS)).alias("baseline"))


def background_mix(expected: DataFrame, baseline: DataFrame, totals: DataFrame, gamma: float) -> DataFrame:
    """(gamma * baseline + (1-gamma) * expected) * total for every gene of cells' reconstruction."""
    g = min(max(gamma, 0.05), 0.45)
    return (expected.join(settle(baseline), GENE).join(totals.hint("shuffle_hash"), [SAMPLE, CELL])
                    .withColumn("mixed", (g * F.col("baseline") + (1 - g) * F.col("expected")) * F.col("total")))


def validate_panel(panel: DataFrame, programs: DataFrame, vocabulary: DataFrame, n_perms: int = 1000,
                   cover: float = 0.80, seed: int = 42) -> DataFrame:
    """Programs a sample's gene panel can support: ``(sample_id, program_id, mass, p_value, n_top)``.

    All programs when the panel covers enough of the vocabulary. Else a program stays when its mass
    on the panel beats the share of genes and random panels of that size, or three of its 50
    heaviest genes are measured. Random panels are hash orders of the vocabulary, one per permutation.
    """
    genes = vocabulary.select(GENE).distinct()
    known = panel.select(SAMPLE, GENE).distinct().join(genes, GENE, "left_semi")
    n_all, ids = genes.count(), ids_of(programs)
    size = known.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("m"))
    w = simplex.row_normalize(programs, [PROGRAM], "weight", "w").select(PROGRAM, GENE, "w")
    mass = known.join(w, GENE).groupBy(SAMPLE, PROGRAM).agg(F.sum("w").alias("mass"))
    top = (top_genes(programs, 50).select(PROGRAM, GENE).join(known, GENE)
           .groupBy(SAMPLE, PROGRAM).agg(F.count(F.lit(1)).alias("n_top")))
    perms = genes.select(GENE, F.explode(F.sequence(F.lit(1), F.lit(n_perms))).alias("perm"))
    order = Window.partitionBy("perm").orderBy(hash_key(GENE, F.col("perm")), GENE)
    ranked = perms.withColumn("rank", F.row_number().over(order))
    running = Window.partitionBy("perm", PROGRAM).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    dense = each_program(genes, ids).join(w, [PROGRAM, GENE], "left").na.fill(0.0)
    null = (ranked.join(dense, GENE).withColumn("null_mass", F.sum("w").over(running))
                  .join(size.select(F.col("m").alias("rank")).distinct(), "rank"))
    base = each_program(size, ids).join(mass, [SAMPLE, PROGRAM], "left").join(top, [SAMPLE, PROGRAM], "left").na.fill(0.0, ["mass"]).na.fill(0, ["n_top"])
    beaten = (base.join(null.withColumnRenamed("rank", "m"), ["m", PROGRAM])
                  .groupBy(SAMPLE, PROGRAM).agg(F.count_if(F.col("null_mass") >= F.col("mass") - 1e-12).alias("_ge")))
    t = base.join(beaten, [SAMPLE, PROGRAM]).withColumn("p_value", (F.col("_ge") + 1.0) / (n_perms + 1.0))
    share = F.col("m") / n_all
    keep = (share >= cover) | ((F.col("p_value") < 0.05) & (F.col("mass") > share)) | (F.col("n_top") >= 3)
    return t.filter(keep).select(SAMPLE, PROGRAM, "mass", "p_value", "n_top")


def patient_mass(fractions: DataFrame, patients: DataFrame) -> DataFrame:
    return (fractions.groupBy(SAMPLE, PROGRAM).agg(F.sum("frac").alias("mass"))
                     .join(patients.select(SAMPLE, "patient_id"), SAMPLE)
                     .groupBy("patient_id", PROGRAM).agg(F.sum("mass").alias("mass")))


def _entropy(mass: DataFrame, keys: list[str]) -> DataFrame:
    p = simplex.row_normalize(mass, keys, "mass", "_p")
    return p.groupBy(*keys).agg(F.sum(-F.col("_p") * F.log(F.col("_p") + EPS)).alias("entropy"))


def program_entropy(mass: DataFrame) -> DataFrame:
    return _entropy(mass, [PROGRAM])


def full_mass(mass: DataFrame) -> DataFrame:
    """Patients x programs with explicit zeros; both are small."""
    grid = each_program(mass.select("patient_id").distinct(), ids_of(mass))
    return grid.join(mass, ["patient_id", PROGRAM], "left").na.fill(0.0, ["mass"])


def entropy_pruning(mass: DataFrame, n_perms: int, quantile: float = 0.01, enabled: bool = True) -> DataFrame:
    """Programs whose entropy over patients exceeds the low quantile of shuffled mass matrices.

    Output ``(program_id, entropy, threshold, kept)``. A permutation re-pairs the cells of the
    flattened matrix by hash order. Ranks are taken in parts, so no task holds all patients.
    """
    full = full_mass(mass).withColumn("_at", F.concat_ws(":", "patient_id", F.col(PROGRAM).cast("string")))
    fixed = bucketed_rank(full.withColumn("_all", F.lit(0)), ["_all"], [PROGRAM], [F.col("patient_id")], "rank").select(PROGRAM, "rank")
    perms = full.select("_at", "mass", F.explode(F.sequence(F.lit(1), F.lit(n_perms))).alias("perm"))
    drawn = hash_rank(perms, ["perm"], "_at", F.col("perm"), "rank")
    null = settle(_entropy(drawn.join(fixed, "rank").select("perm", PROGRAM, "mass"), ["perm", PROGRAM]))
    one = F.lit(1).alias("_one")
    limit = exact_quantiles(null.select(one, "entropy"), ["_one"], "entropy", {"threshold": quantile})
    true = program_entropy(full.select("patient_id", PROGRAM, "mass"))
    kept = (F.col("entropy") > F.col("threshold")) if enabled else F.lit(True)
    return true.select("*", one).join(limit, "_one").select(PROGRAM, "entropy", "threshold", kept.alias("kept"))


def refinement_report(pruned: DataFrame, mass: DataFrame, programs: DataFrame) -> DataFrame:
    """One row per program: state, share of its largest patient, ten heaviest genes."""
    total = mass.groupBy(PROGRAM).agg((F.max("mass") / (F.sum("mass") + EPS) * 100).alias("_top"))
    genes = (top_genes(programs, 10).groupBy(PROGRAM)
             .agg(F.sort_array(F.collect_list(F.struct("rank", F.format_string("%s|%.3f", GENE, "weight").alias("t")))).alias("_g"))
             .select(PROGRAM, F.array_join(F.col("_g.t"), ", ").alias("top_genes")))
    t = pruned.join(total, PROGRAM).join(genes, PROGRAM, "left")
    return t.select(PROGRAM, "kept", F.format_string("%.1f%%", "_top").alias("top_patient_share"), "top_genes")
