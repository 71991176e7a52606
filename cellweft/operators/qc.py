"""Quality control and normalisation of ``expression(sample_id, cell_id, gene, value)``.

Zeros have no rows, so every count over cells takes N from the cells table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.noise import is_noise
from cellweft.functions.scalar import clip_negative
from cellweft.operators.ordering import exact_quantiles, hash_key, hash_rank, hash_unit

SAMPLE, CELL, GENE = "sample_id", "cell_id", "gene"


def noise_filter(genes: DataFrame, gene: str = GENE) -> DataFrame:
    return genes.filter(~is_noise(F.col(gene)))


def whitelist_filter(expression: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Keep listed genes; no list means no filter."""
    return expression if whitelist is None else expression.join(whitelist.select(GENE).distinct(), GENE, "left_semi")


def vocabulary_overlap(expression: DataFrame, whitelist: DataFrame) -> DataFrame:
    genes = expression.select(SAMPLE, GENE).distinct().join(whitelist.select(GENE).distinct(), GENE, "left_semi")
    return genes.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_overlap"))


def check_vocabulary(expression: DataFrame, whitelist: DataFrame, least: int = 50) -> None:
    """Stop when a sample names fewer than ``least`` listed genes."""
    per = expression.select(SAMPLE).distinct().join(vocabulary_overlap(expression, whitelist), SAMPLE, "left")
    poor = per.filter(F.coalesce("n_overlap", F.lit(0)) < least).select(SAMPLE).orderBy(SAMPLE).take(5)
    if poor:
        raise ValueError(f"fewer than {least} listed genes in: {[r[0] for r in poor]}")


def sample_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_cells"))


def min_cells_guard(cells: DataFrame, least: int = 50) -> DataFrame:
    return cells.join(sample_sizes(cells).filter(F.col("n_cells") >= least).select(SAMPLE), SAMPLE, "left_semi")


def cell_totals(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """Total per cell; cells without rows have total 0."""
    totals = expression.groupBy(SAMPLE, CELL).agg(F.sum("value").alias("total"))
    return cells.select(SAMPLE, CELL).join(totals, [SAMPLE, CELL], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def gene_detection(expression: DataFrame) -> DataFrame:
    return expression.groupBy(SAMPLE, GENE).agg(F.count_if(F.col("value") > 0).alias("n_detected"))


def qc_cells(cells: DataFrame, expression: DataFrame, least: float = 10, upper: float = 0.99) -> DataFrame:
    totals = cell_totals(cells, expression)
    limits = exact_quantiles(totals, [SAMPLE], "total", {"cap": upper})
    kept = totals.join(limits, SAMPLE).filter((F.col("total") >= least) & (F.col("total") <= F.col("cap")))
    return cells.join(kept.select(SAMPLE, CELL), [SAMPLE, CELL], "left_semi")


def qc_genes(cells: DataFrame, expression: DataFrame, low: float = 0.001, high: float = 0.95) -> DataFrame:
    n = F.col("n_cells")
    return (gene_detection(expression).join(sample_sizes(cells), SAMPLE)
            .filter(F.col("n_detected").between(F.floor(n * low), F.floor(n * high))).select(SAMPLE, GENE))


def normalize_log1p(expression: DataFrame, target: float = 1e4, out: str = "lognorm") -> DataFrame:
    total = F.sum("value").over(Window.partitionBy(SAMPLE, CELL))
    return expression.withColumn(out, F.log1p(F.col("value") * (F.lit(target) / F.when(total == 0, 1.0).otherwise(total))))


def remap_to_vocab(expression: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Inner join with ``genes(gene_idx, gene)``; genes outside the list disappear, absent ones are zero."""
    return expression.withColumn("value", clip_negative(F.col("value"))).join(vocabulary.select("gene_idx", GENE), GENE)


def winsorize(expression: DataFrame, upper: float = 0.95) -> DataFrame:
    caps = exact_quantiles(expression.filter(F.col("value") != 0), [SAMPLE], "value", {"cap": upper})
    return expression.join(caps, SAMPLE).withColumn("value", F.least(clip_negative(F.col("value")), F.col("cap"))).drop("cap")


def train_val_split(cells: DataFrame, share: float = 0.85, seed: int = 42) -> DataFrame:
    """Exactly floor(share * N) training cells per sample."""
    ranked = hash_rank(cells.join(sample_sizes(cells), SAMPLE), [SAMPLE], CELL, seed, size="n_cells")
    return ranked.withColumn("is_train", F.col("rn") <= F.floor(F.lit(share) * F.col("n_cells"))).drop("rn", "n_cells")


def sample_cap(cells: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    ranked = hash_rank(cells.join(sample_sizes(cells), SAMPLE), [SAMPLE], CELL, seed, size="n_cells")
    return ranked.filter(F.col("rn") <= cap).drop("rn", "n_cells")


def edge_sample(edges: DataFrame, drop: float = 0.40, seed: int = 42) -> DataFrame:
    """Keep an edge with probability ``1 - drop``; decided by its key, so a retry keeps the same edges."""
    return edges.filter(hash_unit(hash_key(["src", "dst"], seed)) > drop)
