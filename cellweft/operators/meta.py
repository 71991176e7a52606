"""Across patients: pooled effects, leave-one-out robustness, false discovery, network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalar import (EPS, interface_ends, leading_number, matrix_cell, node_label,
                                       t_two_sided_p)


def patient_means(topology: DataFrame) -> DataFrame:
    numbers = [c for c in ("Continuous_Observed", "Continuous_Expected_Mean", "Spatial_Z_Score", "Log2_Enrichment")
               if c in topology.columns]
    return topology.groupBy(F.col("Sample").alias("Patient_ID"), "Interface").agg(*[F.avg(c).alias(c) for c in numbers])


def _t_test(mean: Column, sd: Column, k: Column) -> tuple[Column, Column]:
    se = sd / (F.sqrt(k) + EPS)
    return se, t_two_sided_p(mean / (se + EPS), (k - 1).cast("int"))


def meta_effect(means: DataFrame) -> DataFrame:
    """Mean effect per interface over patients with its standard error and two-sided p."""
    t = (means.filter(F.col("Log2_Enrichment").isNotNull()).groupBy("Interface")
              .agg(F.count(F.lit(1)).alias("k"), F.avg("Log2_Enrichment").alias("effect"),
                   F.stddev_samp("Log2_Enrichment").alias("sd")))
    se, p = _t_test(F.col("effect"), F.col("sd"), F.col("k"))
    many = F.col("k") > 1
    return t.select("Interface", "k", "effect", F.when(many, se).otherwise(F.lit(0.0)).alias("se"),
                    F.when(many, p).otherwise(F.lit(1.0)).alias("p_value"))


def leave_one_out(means: DataFrame) -> DataFrame:
    """How many patients can be left out with the sign kept and p < 0.05, from sums only."""
    x = F.col("Log2_Enrichment")
    sums = (means.filter(x.isNotNull()).groupBy("Interface")
                 .agg(F.count(F.lit(1)).alias("k"), F.sum(x).alias("s"), F.sum(x * x).alias("q")))
    t = means.filter(x.isNotNull()).join(sums, "Interface")
    m = (F.col("s") - x) / (F.col("k") - 1)
    t = t.filter("k > 1").withColumn("m", m).withColumn(
        "var", F.greatest(F.lit(0.0), F.try_divide(F.col("q") - x * x - (F.col("s") - x) * F.col("m"), F.col("k") - 2)))
    _, p = _t_test(F.col("m"), F.sqrt("var"), F.col("k") - 1)
    same = F.col("m") * (F.col("s") / F.col("k")) > 0
    ok = same & F.when(F.col("k") == 2, F.lit(True)).otherwise(p < 0.05)
    some = t.groupBy("Interface").agg(F.count_if(ok).alias("kept"))
    return (sums.join(some, "Interface", "left")
                .select("Interface", F.concat(F.when(F.col("k") == 1, F.lit(1)).otherwise(F.col("kept")).cast("string"),
                                              F.lit("/"), F.col("k").cast("string")).alias("LOPO_Robustness")))


def bh_fdr(df: DataFrame, p: str = "p_value", ident: str = "Interface", out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values. One window over all rows: meant for interface-sized tables."""
    w = Window.orderBy(p, ident)
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    raw = F.col(p) * F.col("_n") / F.col("_r")
    back = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(raw).over(back))).drop("_r", "_n")


def meta_topology(topology: DataFrame) -> DataFrame:
    """``Interface, Pooled_Log2_Enrichment, Cross_Patient_SE, LOPO_Robustness, FDR_q``."""
    means = patient_means(topology)
    t = bh_fdr(meta_effect(means)).join(leave_one_out(means), "Interface")
    # a small negative effect rounds to minus zero and is printed with its sign
    effect = F.when((F.col("effect") < 0) & (F.round("effect", 3) == 0), F.lit(-0.0)).otherwise(F.round("effect", 3))
    return t.select("Interface", effect.alias("Pooled_Log2_Enrichment"),
                    F.round("se", 3).alias("Cross_Patient_SE"), "LOPO_Robustness", F.round("q", 4).alias("FDR_q"))


def program_order(topology: DataFrame) -> DataFrame:
    """Programs named by any interface, ordered by their leading number."""
    names = topology.select(F.explode(interface_ends(F.col("Interface"))).alias("program")).distinct()
    w = Window.orderBy(leading_number(F.col("program")), "program")
    return names.withColumn("position", F.row_number().over(w) - 1)


def matrix_cells(meta: DataFrame) -> DataFrame:
    """Lower triangle as rows ``(row_program, col_program, text)``."""
    order = program_order(meta)
    ends = meta.withColumn("_e", interface_ends(F.col("Interface")))
    t = (ends.withColumn("a", F.col("_e")[0]).withColumn("b", F.col("_e")[1])
             .join(order.select(F.col("program").alias("a"), F.col("position").alias("pa")), "a")
             .join(order.select(F.col("program").alias("b"), F.col("position").alias("pb")), "b").filter("pa <> pb"))
    text = matrix_cell(F.col("Pooled_Log2_Enrichment"), F.col("LOPO_Robustness"), F.col("FDR_q"))
    low = F.col("pa") > F.col("pb")
    return t.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("row_program"),
                    F.when(low, F.col("b")).otherwise(F.col("a")).alias("col_program"), text.alias("text"))


def matrix_table(meta: DataFrame) -> DataFrame:
    """The square text matrix; column names are the programs (a few hundred at most)."""
    order = program_order(meta)
    names = [r.program for r in order.orderBy("position").collect()]
    wide = matrix_cells(meta).groupBy("row_program").pivot("col_program", names).agg(F.first("text"))
    full = order.withColumnRenamed("program", "row_program").join(wide, "row_program", "left").orderBy("position").drop("position")
    return full.na.fill("")


def network_links(meta: DataFrame, fdr: float = 0.05) -> DataFrame:
    kept = meta.filter((F.col("FDR_q") < fdr) & F.col("Interface").contains("<->")).withColumn("_e", interface_ends(F.col("Interface")))
    return kept.select(F.col("_e")[0].alias("source"), F.col("_e")[1].alias("target"),
                       F.abs("Pooled_Log2_Enrichment").alias("weight"), F.col("Pooled_Log2_Enrichment").alias("effect"),
                       F.col("LOPO_Robustness").alias("lopo"), F.col("FDR_q").alias("fdr"))


def network_nodes(links: DataFrame) -> DataFrame:
    """Nodes with a link, and their degree."""
    ends = links.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), F.lit(1).alias("_one"))
    return (ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
                .select("id", node_label(F.col("id")).alias("label"), "degree"))


def links_between(links: DataFrame, selected: DataFrame) -> DataFrame:
    s = selected.select("id")
    return (links.join(s.withColumnRenamed("id", "source"), "source", "left_semi")
                 .join(s.withColumnRenamed("id", "target"), "target", "left_semi"))


def shared_neighbours(links: DataFrame, selected: DataFrame, least: int = 2) -> DataFrame:
    """Nodes outside the selection linked to at least ``least`` selected nodes."""
    s = selected.select(F.col("id").alias("a"))
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(
        links.select(F.col("target").alias("a"), F.col("source").alias("b")))
    return (both.join(s, "a", "left_semi").join(s.withColumnRenamed("a", "b"), "b", "left_anti")
                .groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("n_shared")).filter(F.col("n_shared") >= least))


def network_payload(links: DataFrame) -> DataFrame:
    """One JSON row ``{"nodes": [...], "links": [...]}``; its size is bounded by the number of interfaces."""
    nodes = network_nodes(links).agg(F.sort_array(F.collect_list(F.struct("id", "label", "degree"))).alias("nodes"))
    edges = links.agg(F.sort_array(F.collect_list(F.struct("source", "target", "weight", "effect", "lopo", "fdr"))).alias("links"))
    one = F.lit(1).alias("_j")
    both = nodes.select(one, "nodes").join(edges.select(one, "links"), "_j")
    return both.select(F.to_json(F.struct("nodes", "links")).alias("payload"))
