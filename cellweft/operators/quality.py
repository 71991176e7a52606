"""Quality of fitted programs and fractions, as one table of metrics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions import simplex
from cellweft.functions.scalar import EPS, clamp, log_cosh
from cellweft.operators import programs as P

SAMPLE, CELL, GENE, PROGRAM = "sample_id", "cell_id", "gene", "program_id"


def recon_loss(expression: DataFrame, expected: DataFrame, n_cells: int, n_genes: int,
               nonzero_weight: float | None = None, zero_rate: float = 0.05) -> DataFrame:
    """Weighted asymmetric log-cosh loss over all cell x gene entries.

    Entries that neither the data nor the reconstruction reaches all cost the same, so they are
    added as a count instead of being built.
    """
    both = (expression.select(SAMPLE, CELL, GENE, "value").join(expected, [SAMPLE, CELL, GENE], "full_outer")
                      .select(F.coalesce("value", F.lit(0.0)).alias("x"), F.coalesce("expected", F.lit(0.0)).alias("r")))
    on, delta = F.col("x") > 0, F.col("r") - F.col("x")
    scaled = clamp(delta * F.when(on & (delta < 0), F.lit(3.0)).otherwise(F.lit(1.0)), -30.0, 30.0)
    cost = log_cosh(scaled + 1e-6)
    entries = float(n_cells) * float(n_genes)
    t = both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(on).alias("pos"),
                 F.sum(F.when(on, cost).otherwise(0.0)).alias("on"), F.sum(F.when(on, 0.0).otherwise(cost)).alias("off"))
    weight = F.lit(float(nonzero_weight)) if nonzero_weight is not None else (
        (F.lit(entries) - F.col("pos")) / F.greatest(F.lit(1.0), F.col("pos")))
    idle = (F.lit(entries) - F.col("rows")) * math.log(math.cosh(1e-6))
    total = weight * F.coalesce("on", F.lit(0.0)) + zero_rate * (F.coalesce("off", F.lit(0.0)) + idle)
    return t.select((total / max(1.0, entries)).alias("recon_loss"))


def _unit(programs: DataFrame) -> DataFrame:
    return simplex.l2_normalize(programs, [PROGRAM], "weight", "u").select(PROGRAM, GENE, "u")


def program_gram(programs: DataFrame) -> DataFrame:
    """Cosine of every ordered pair of programs sharing a gene."""
    u = _unit(programs)
    return (u.select(F.col(PROGRAM).alias("i"), GENE, F.col("u").alias("ui"))
             .join(u.select(F.col(PROGRAM).alias("j"), GENE, F.col("u").alias("uj")), GENE)
             .groupBy("i", "j").agg(F.sum(F.col("ui") * F.col("uj")).alias("cos")))


def dictionary_overlap(programs: DataFrame, limit: float = 0.15) -> DataFrame:
    k = float(len(P.ids_of(programs)))
    off = program_gram(programs).filter("i <> j")
    over = F.greatest(F.col("cos") - limit, F.lit(0.0))
    sums = off.agg(F.max("cos").alias("m"), F.sum("cos").alias("s"), F.sum(F.col("cos") * F.col("cos")).alias("q"),
                   F.sum(over * over).alias("p")).na.fill(0.0)
    pairs = max(1.0, k * (k - 1))
    return sums.select(F.greatest("m", F.lit(0.0)).alias("max_overlap"), (F.col("s") / pairs).alias("mean_overlap"),
                       (F.col("p") / max(1.0, k) + 0.1 * F.col("q") / pairs).alias("overlap_penalty"))


def dictionary_entropy(programs: DataFrame) -> DataFrame:
    per = programs.groupBy(PROGRAM).agg(F.sum(-F.col("weight") * F.log(F.col("weight") + EPS)).alias("e"))
    return per.agg(F.avg("e").alias("gene_entropy"))


def dictionary_drift(programs: DataFrame, initial: DataFrame, peak: float = 0.50) -> DataFrame:
    """1 - mean cosine to the initial programs, and the penalty on single dominant genes."""
    a, b = _unit(programs), _unit(initial).withColumnRenamed("u", "v")
    k = float(len(P.ids_of(programs)))
    cos = a.join(b, [PROGRAM, GENE]).agg(F.coalesce(F.sum(F.col("u") * F.col("v")), F.lit(0.0)).alias("c"), F.lit(1).alias("_j"))
    excess = F.greatest(F.col("weight") - peak, F.lit(0.0))
    pen = programs.agg(F.sum(excess * excess).alias("p"), F.lit(1).alias("_j"))
    return cos.join(pen, "_j").select((1.0 - F.col("c") / k).alias("drift"), (F.col("p") / k).alias("collapse_penalty"))


def sharpness(fractions: DataFrame, programs: DataFrame) -> DataFrame:
    pw = fractions.groupBy(SAMPLE, CELL).agg(F.max("frac").alias("m")).agg((100 * F.avg("m")).alias("p_w"), F.lit(1).alias("_j"))
    gw = programs.groupBy(PROGRAM).agg(F.max("weight").alias("m")).agg((100 * F.avg("m")).alias("g_w"), F.lit(1).alias("_j"))
    return pw.join(gw, "_j").drop("_j")


def dead_programs(fractions: DataFrame, programs: DataFrame, least: float = 1e-4) -> DataFrame:
    mass = fractions.groupBy(PROGRAM).agg(F.sum("frac").alias("m"))
    t = programs.select(PROGRAM).distinct().join(mass, PROGRAM, "left")
    return t.agg(F.count_if(F.coalesce("m", F.lit(0.0)) < least).alias("n_dead"), F.count(F.lit(1)).alias("n_programs"))


def core_mass(programs: DataFrame, core: DataFrame) -> DataFrame:
    """Mean weight that stays on the prior genes, per cent."""
    k = float(len(P.ids_of(programs)))
    kept = programs.join(core.select(PROGRAM, GENE).distinct(), [PROGRAM, GENE], "left_semi")
    return kept.agg((100 * F.coalesce(F.sum("weight"), F.lit(0.0)) / k).alias("core_mass"))


def effective_rank(programs: DataFrame) -> float:
    """exp(entropy of singular values), from the programs x programs products (a small matrix)."""
    a = programs.select(F.col(PROGRAM).alias("i"), GENE, F.col("weight").alias("a"))
    b = programs.select(F.col(PROGRAM).alias("j"), GENE, F.col("weight").alias("b"))
    gram = a.join(b, GENE).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).toPandas()
    ids = {p: n for n, p in enumerate(sorted(set(gram["i"])))}
    m = np.zeros((len(ids), len(ids)))
    m[gram["i"].map(ids), gram["j"].map(ids)] = gram["g"]
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0.0))
    if s.sum() <= 1e-9:
        return 0.0
    p = s / s.sum()
    p = p[p > 1e-9]
    return float(np.exp(-(p * np.log(p)).sum()))


def usage(fractions: DataFrame, n_cells: int, alpha: float = 1.5, previous: DataFrame | None = None) -> DataFrame:
    """Mean use of programs: entropy, collapse ratio, divergence from the balancing target, row Tsallis entropy.

    The target lifts rarely used programs: 2/K minus the average use so far, floored and renormalised.
    """
    ids = P.ids_of(fractions)
    k = float(len(ids))
    mean = fractions.groupBy(PROGRAM).agg((F.sum("frac") / float(n_cells)).alias("p"))
    past = mean.withColumnRenamed("p", "ema") if previous is None else previous.select(PROGRAM, "ema")
    t = mean.join(past, PROGRAM, "left").withColumn("c", F.greatest(F.lit(2.0 / k) - F.coalesce("ema", F.lit(0.0)), F.lit(1e-5)))
    t = t.withColumn("target", F.col("c") / F.sum("c").over(Window.partitionBy()))
    p = clamp(F.col("p"), 1e-5, 1.0)
    sums = t.agg(F.sum(-F.col("p") * F.log(F.col("p") + EPS)).alias("usage_entropy"),
                 F.sum(p * (F.log(p + EPS) - F.log(F.greatest("target", F.lit(1e-5)) + EPS))).alias("usage_kl"), F.lit(1).alias("_j"))
    # programs absent from a cell count as the floor value
    f = clamp(F.col("frac"), 1e-5, 1.0)
    floor = 1e-5 ** alpha
    rows = fractions.agg(F.sum(F.pow(f, F.lit(alpha)) - floor).alias("s"), F.lit(1).alias("_j"))
    tsallis = (1.0 - (F.col("s") / float(n_cells) + k * floor)) / (alpha - 1.0)
    return sums.join(rows, "_j").select(
        "usage_entropy", "usage_kl", clamp(1.0 - F.col("usage_entropy") / math.log(k), 0.0, 1.0).alias("collapse_ratio"),
        tsallis.alias("tsallis_entropy"))


def quality_report(expression: DataFrame, fractions: DataFrame, programs: DataFrame, initial: DataFrame,
                   n_cells: int, n_genes: int) -> DataFrame:
    """``metrics(name, value)`` of everything above; each part is one aggregate."""
    parts = [recon_loss(expression, P.reconstruct(fractions, programs), n_cells, n_genes), dictionary_overlap(programs),
             dictionary_entropy(programs), dictionary_drift(programs, initial), sharpness(fractions, programs),
             dead_programs(fractions, programs), core_mass(programs, initial), usage(fractions, n_cells)]
    out = None
    for part in parts:
        long = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                               for c in part.columns])).alias("m")).select("m.*")
        out = long if out is None else out.unionByName(long)
    return out
