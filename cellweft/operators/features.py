"""Variable and spatially patterned genes, and their consensus over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalar import EPS
from cellweft.operators import blocks, qc, spatial

SAMPLE, CELL, GENE = "sample_id", "cell_id", "gene"


def gene_moments(cells: DataFrame, expression: DataFrame, value: str = "lognorm") -> DataFrame:
    v = F.col(value)
    sums = expression.groupBy(SAMPLE, GENE).agg(F.sum(v).alias("sum_x"), F.sum(v * v).alias("sum_x2"))
    return sums.join(qc.sample_sizes(cells), SAMPLE).withColumn("mean", F.col("sum_x") / F.col("n_cells"))


def highly_variable_genes(cells: DataFrame, expression: DataFrame, bins: int = 20) -> DataFrame:
    """Dispersion (log variance/mean of back-transformed values) standardised inside bins of the mean.

    The bin windows hold genes, never cells.
    """
    m = gene_moments(cells, expression.withColumn("_raw", F.expm1("lognorm")), "_raw")
    var = (F.col("sum_x2") - F.col("sum_x") * F.col("sum_x") / F.col("n_cells")) / (F.col("n_cells") - 1)
    m = (m.filter(F.col("n_cells") > 1).withColumn("_var", var).filter((F.col("_var") > 0) & (F.col("mean") > 0))
          .withColumn("dispersion", F.log(F.col("_var") / F.col("mean"))).withColumn("log_mean", F.log1p("mean")))
    per = Window.partitionBy(SAMPLE)
    m = m.withColumn("bin", spatial.grid_bin(F.col("log_mean"), F.min("log_mean").over(per),
                                             F.max("log_mean").over(per), bins, clipped=True))
    w = Window.partitionBy(SAMPLE, "bin")
    alone = F.count(F.lit(1)).over(w) == 1
    mean = F.when(alone, F.lit(0.0)).otherwise(F.avg("dispersion").over(w))
    sd = F.when(alone, F.col("dispersion")).otherwise(F.stddev_samp("dispersion").over(w))
    scored = m.withColumn("hvg_score", F.try_divide(F.col("dispersion") - mean, sd))
    return scored.filter(F.col("hvg_score").isNotNull()).select(SAMPLE, GENE, "bin", "dispersion", "hvg_score")


def morans_i(cells: DataFrame, expression: DataFrame, edges: DataFrame, value: str = "lognorm") -> DataFrame:
    """Moran's I per sample and gene over undirected ``edges``, expanded so zeros need no rows; sums over edges come block by block."""
    moments = gene_moments(cells, expression, value)
    sums = blocks.edge_gene_sums(cells, edges, expression, value)
    n_edges = edges.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_edges"))
    t = (moments.join(sums, [SAMPLE, GENE], "left").join(n_edges, SAMPLE, "left")
                .na.fill(0.0, ["sum_uv", "sum_deg"]).na.fill(0, ["n_edges"]))
    mean, n, e = F.col("mean"), F.col("n_cells"), F.col("n_edges")
    denom = F.col("sum_x2") - 2 * mean * F.col("sum_x") + n * mean * mean + EPS
    numer = F.col("sum_uv") - mean * F.col("sum_deg") + e * mean * mean
    score = F.when(e == 0, F.lit(0.0)).otherwise((n / (e + EPS)) * (numer / denom))
    return t.select(SAMPLE, GENE, score.alias("moran"))


def moran_edges(cells: DataFrame, k: int = 7) -> DataFrame:
    """Distinct undirected edges to the k-1 nearest cells."""
    return spatial.undirected_distinct(spatial.knn_join(cells, k - 1))


def avg_rank_desc(df: DataFrame, value: str, out: str) -> DataFrame:
    """Descending rank over the whole table, ties share the average. Meant for gene-sized tables."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(value))
    return df.withColumn(out, F.rank().over(Window.orderBy(F.desc(value))) + (ties - 1) / 2)


def merge_scores(hvg: DataFrame, moran: DataFrame) -> DataFrame:
    """Sum each score over samples; genes missing on one side count 0 there."""
    h = hvg.groupBy(GENE).agg(F.sum("hvg_score").alias("hvg_sum"))
    m = moran.groupBy(GENE).agg(F.sum("moran").alias("moran_sum"))
    return h.join(m, GENE, "full_outer").select(GENE, F.coalesce("hvg_sum", F.lit(0.0)).alias("hvg_sum"),
                                                F.coalesce("moran_sum", F.lit(0.0)).alias("moran_sum"))


def rank_genes(scores: DataFrame, decimals: int | None = None) -> DataFrame:
    """Add both descending ranks. ``decimals`` makes ties independent of summation order."""
    def r(c: str) -> Column:
        return F.col(c) if decimals is None else F.round(c, decimals)
    t = scores.withColumn("hvg_sum", r("hvg_sum")).withColumn("moran_sum", r("moran_sum"))
    t = avg_rank_desc(avg_rank_desc(t, "hvg_sum", "_rh"), "moran_sum", "_rm")
    return t.withColumn("score", F.col("_rh") + F.col("_rm")).drop("_rh", "_rm")


def consensus_genes(hvg: DataFrame, moran: DataFrame, top_n: int, decimals: int | None = None) -> DataFrame:
    """The top_n genes by summed rank; all genes when there are no more than that."""
    return rank_genes(merge_scores(hvg, moran), decimals).orderBy("score", GENE).limit(top_n)


def spatial_features(cells: DataFrame, expression: DataFrame, whitelist: DataFrame | None = None,
                     k: int = 7) -> tuple[DataFrame, DataFrame]:
    """Per-sample gene scores after quality control: ``(variable genes, Moran scores)``."""
    from cellweft.session import settle
    listed = settle(qc.whitelist_filter(expression.select(SAMPLE, CELL, GENE, "value"), whitelist))
    kept = settle(qc.qc_cells(cells, listed))
    genes = qc.qc_genes(cells, listed)
    clean = settle(qc.normalize_log1p(listed.join(genes, [SAMPLE, GENE], "left_semi")
                                            .join(kept.select(SAMPLE, CELL), [SAMPLE, CELL], "left_semi")))
    return highly_variable_genes(kept, clean), morans_i(kept, clean, settle(moran_edges(kept, k)))


def tfidf(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """(1 + ln tf) * (ln((1+n)/(1+df)) + 1) with idf per sample, each cell scaled to length one."""
    df_ = expression.filter("value > 0").groupBy(SAMPLE, GENE).agg(F.count(F.lit(1)).alias("df"))
    n = qc.sample_sizes(cells)
    t = (expression.filter("value > 0").join(df_.join(n, SAMPLE), [SAMPLE, GENE])
         .withColumn("_w", (1 + F.log("value")) * (F.log((1 + F.col("n_cells")) / (1 + F.col("df"))) + 1)))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(SAMPLE, CELL)))
    return t.select(SAMPLE, CELL, GENE, F.when(norm > 0, F.col("_w") / norm).otherwise(F.lit(0.0)).alias("tfidf"))
