"""Queries over spatial joins, graphs and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog import views as V
from catalog.registry import query, rounded
from cellweft.functions import scalar
from cellweft.operators import domains, graph, meta, ordering, programs, qc, sampling, spatial, topology
from cellweft.session import settle

KEYS = ["sample_id", "src", "dst"]


@query(V.oracle("SELECT sample_id, src, dst, rank, round(dist, 6) AS dist FROM near", "cells", steps={"near": Q.knn(10)}))
def knn_join(spark, sf):
    return rounded(spatial.knn_join(V.points(spark, sf), 10), "dist")


RADIUS = {k: Q.TOPOLOGY[k] for k in ("nn", "rad", "pairs")}


@query(V.oracle("SELECT * FROM pairs", "cells", steps=RADIUS))
def radius_join(spark, sf):
    c = V.points(spark, sf)
    return spatial.radius_join(c, topology.topology_radius(c)).select(*KEYS)


@query(V.oracle("SELECT sample_id, round(median(dist), 6) AS median_dist FROM nn GROUP BY 1", "cells", steps=RADIUS))
def nearest_distance_median(spark, sf):
    return rounded(spatial.nearest_distance_median(V.points(spark, sf)), "median_dist")


@query(V.oracle("SELECT * FROM e", "cells", steps={"near": Q.knn(6), "e": Q.distinct_edges("near")}))
def undirected_distinct(spark, sf):
    return spatial.undirected_distinct(spatial.knn_join(V.points(spark, sf), 6))


DENSE = {"cells": "SELECT * FROM dense_cells", "near": Q.knn(10)}
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]*z[2]))"
GRAPH = {
    **DENSE,
    "sim": f"""SELECT n.*, {DOT.format(a='s.vec', b='d.vec')} / (CASE WHEN {DOT.format(a='s.vec', b='s.vec')} = 0 THEN 1e-9 ELSE sqrt({DOT.format(a='s.vec', b='s.vec')}) END
        * CASE WHEN {DOT.format(a='d.vec', b='d.vec')} = 0 THEN 1e-9 ELSE sqrt({DOT.format(a='d.vec', b='d.vec')}) END) AS sim
        FROM near n JOIN dense_cells s ON s.sample_id = n.sample_id AND s.cell_id = n.src JOIN dense_cells d ON d.sample_id = n.sample_id AND d.cell_id = n.dst""",
    "z": """SELECT *, (sim - avg(sim) OVER (PARTITION BY sample_id, src)) / (stddev_pop(sim) OVER (PARTITION BY sample_id, src) + 1e-9) AS z FROM sim""",
    "kept": "SELECT * FROM z WHERE z > -0.5",
    "bw": "SELECT sample_id, median(dist) + 1e-9 AS bandwidth FROM kept GROUP BY 1",
    "wt": "SELECT sample_id, src, dst, exp(-dist*dist/(2*bandwidth*bandwidth))*sim AS weight FROM kept JOIN bw USING (sample_id)",
    "und": "SELECT sample_id, least(src, dst) AS src, greatest(src, dst) AS dst, min(weight) AS weight FROM wt GROUP BY 1, 2, 3",
    "adj": """SELECT sample_id, src, dst, weight FROM und UNION ALL SELECT sample_id, dst, src, weight FROM und
        UNION ALL SELECT sample_id, cell_id, cell_id, 1.0 FROM dense_cells""",
    "deg": "SELECT sample_id, src AS cell_id, sum(weight) AS degree FROM adj GROUP BY 1, 2",
    "graph": """SELECT a.sample_id, src, dst, weight * CASE WHEN s.degree > 0 THEN 1/sqrt(s.degree) ELSE 0 END * CASE WHEN d.degree > 0 THEN 1/sqrt(d.degree) ELSE 0 END AS weight
        FROM adj a JOIN deg s ON s.sample_id = a.sample_id AND s.cell_id = src JOIN deg d ON d.sample_id = a.sample_id AND d.cell_id = dst""",
}


def _near(spark, sf):
    return spatial.knn_join(V.dense_cells(spark, sf), 10).drop("rank")


def _scored(spark, sf):
    return graph.edge_cosine_packed(_near(spark, sf), V.dense_cells(spark, sf))


@query(V.oracle("SELECT sample_id, src, dst, round(sim, 6) AS sim FROM sim", "dense_cells", steps=GRAPH))
def cosine_per_edge(spark, sf):
    return rounded(_scored(spark, sf).select(*KEYS, "sim"), "sim")


@query(V.oracle("""SELECT n.sample_id, n.src, n.dst, round(coalesce(dot, 0)/(coalesce(nullif(a.n, 0), 1e-9)*coalesce(nullif(b.n, 0), 1e-9)), 6) AS sim
    FROM near n LEFT JOIN dots USING (sample_id, src, dst) LEFT JOIN norms a ON a.sample_id = n.sample_id AND a.cell_id = n.src
    LEFT JOIN norms b ON b.sample_id = n.sample_id AND b.cell_id = n.dst""", "expression", steps={
    "ln": Q.LOGNORM, "near": Q.knn(10), "norms": "SELECT sample_id, cell_id, sqrt(sum(lognorm*lognorm)) AS n FROM ln GROUP BY 1, 2",
    "dots": """SELECT n.sample_id, src, dst, sum(a.lognorm*b.lognorm) AS dot FROM near n JOIN ln a ON a.sample_id = n.sample_id AND a.cell_id = src
        JOIN ln b ON b.sample_id = n.sample_id AND b.cell_id = dst AND a.gene = b.gene GROUP BY 1, 2, 3"""}))
def cosine_per_edge_sparse(spark, sf):
    c = V.points(spark, sf)
    near = spatial.knn_join(c, 10).drop("rank")
    return rounded(graph.edge_cosine(c, near, qc.normalize_log1p(V.expression(spark, sf))).select(*KEYS, "sim"), "sim")


@query(V.oracle("SELECT sample_id, cell_id, round(sqrt(sum(value*value)), 6) AS norm FROM expression GROUP BY 1, 2", "expression"))
def l2_norm(spark, sf):
    return rounded(graph.cell_norms(V.expression(spark, sf), "value"), "norm")


@query(V.oracle("SELECT sample_id, src, dst, round(z, 6) AS z FROM kept", "dense_cells", steps=GRAPH))
def edge_zscore_prune(spark, sf):
    return rounded(graph.zscore_prune(_scored(spark, sf)).select(*KEYS, "z"), "z")


@query(V.oracle("SELECT sample_id, round(bandwidth, 6) AS bandwidth FROM bw", "dense_cells", steps=GRAPH))
def bandwidth_median(spark, sf):
    return rounded(graph.bandwidth(graph.zscore_prune(_scored(spark, sf))), "bandwidth")


@query(V.oracle("SELECT sample_id, src, dst, round(weight, 6) AS weight FROM wt", "dense_cells", steps=GRAPH))
def gaussian_decay(spark, sf):
    return rounded(graph.decay_weights(settle(graph.zscore_prune(_scored(spark, sf)))).select(*KEYS, "weight"), "weight")


@query(V.oracle("SELECT sample_id, src, dst, round(weight, 6) AS weight FROM graph", "dense_cells", steps=GRAPH))
def spatial_graph(spark, sf):
    c = V.dense_cells(spark, sf)
    return rounded(graph.spatial_graph(c, vectors=c), "weight")


SPARSE_GRAPH = {
    "ln": Q.LOGNORM, "near": Q.knn(10), "norms": "SELECT sample_id, cell_id, sqrt(sum(lognorm*lognorm)) AS n FROM ln GROUP BY 1, 2",
    "dots": """SELECT n.sample_id, src, dst, sum(a.lognorm*b.lognorm) AS dot FROM near n JOIN ln a ON a.sample_id = n.sample_id AND a.cell_id = src
        JOIN ln b ON b.sample_id = n.sample_id AND b.cell_id = dst AND a.gene = b.gene GROUP BY 1, 2, 3""",
    "sim": """SELECT n.*, coalesce(dot, 0)/(coalesce(nullif(a.n, 0), 1e-9)*coalesce(nullif(b.n, 0), 1e-9)) AS sim
        FROM near n LEFT JOIN dots USING (sample_id, src, dst) LEFT JOIN norms a ON a.sample_id = n.sample_id AND a.cell_id = n.src
        LEFT JOIN norms b ON b.sample_id = n.sample_id AND b.cell_id = n.dst""",
    **{k: GRAPH[k].replace("dense_cells", "cells") for k in ("z", "kept", "bw", "wt", "und", "adj", "deg", "graph")}}


@query(V.oracle("SELECT sample_id, src, dst, round(weight, 5) AS weight FROM graph", "expression", steps=SPARSE_GRAPH))
def spatial_graph_sparse(spark, sf):
    """The graph of a cohort run: neighbours weighted by the cosine of sparse expression."""
    c = V.points(spark, sf)
    return rounded(graph.spatial_graph(c, qc.normalize_log1p(V.expression(spark, sf))), "weight", digits=5)


UNIT = {"near": Q.knn(6), "und": "SELECT sample_id, least(src, dst) AS src, greatest(src, dst) AS dst, min(1/(1+dist)) AS weight FROM near GROUP BY 1, 2, 3",
        "adj": GRAPH["adj"].replace("dense_cells", "cells"), "deg": GRAPH["deg"], "graph": GRAPH["graph"]}


def _unit_edges(spark, sf):
    near = spatial.knn_join(V.points(spark, sf), 6).withColumn("weight", 1 / (1 + F.col("dist")))
    return spatial.undirected_distinct(near, "weight")


@query(V.oracle("SELECT sample_id, src, dst, round(weight, 6) AS weight FROM graph", "cells", steps=UNIT))
def sym_normalize(spark, sf):
    return rounded(graph.symmetric_normalize(V.points(spark, sf), _unit_edges(spark, sf)), "weight")


@query(V.oracle("SELECT sample_id, src AS cell_id, round(sum(weight), 6) AS degree FROM und GROUP BY 1, 2", "cells", steps=UNIT))
def degree(spark, sf):
    return rounded(graph.weighted_degree(_unit_edges(spark, sf)), "degree")


@query(V.oracle("""SELECT u.sample_id, src, dst, s.x AS x_src, d.x AS x_dst FROM und u JOIN cells s ON s.sample_id = u.sample_id AND s.cell_id = src
    JOIN cells d ON d.sample_id = u.sample_id AND d.cell_id = dst""", "cells", steps=UNIT))
def edge_attribute_join(spark, sf):
    return graph.attach_attributes(_unit_edges(spark, sf).drop("weight"), V.points(spark, sf), "x")


@query(V.oracle("""SELECT sample_id, src, dst, round(exp(least(greatest(weight, -60), 60)) / (sum(exp(least(greatest(weight, -60), 60)))
    OVER (PARTITION BY sample_id, dst) + 1e-9), 6) AS attention FROM graph""", "cells", steps=UNIT))
def edge_softmax(spark, sf):
    g = graph.symmetric_normalize(V.points(spark, sf), _unit_edges(spark, sf))
    return rounded(graph.edge_softmax(g, "weight").drop("weight"), "attention")


@query(V.oracle("""SELECT sample_id, src, dst FROM near WHERE CAST('0x' || substr(md5(CAST(src AS VARCHAR) || ':' || CAST(dst AS VARCHAR) || ':42'), 1, 8) AS BIGINT)
    / 4294967296.0::DOUBLE > 0.4""", "cells", steps={"near": Q.knn(6)}))
def edge_sample(spark, sf):
    return qc.edge_sample(spatial.knn_join(V.points(spark, sf), 6)).select(*KEYS)


@query(V.oracle(f"""SELECT g.sample_id, src, dst, round(weight * exp(-ln(1+exp(1.0)) * list_sum(list_transform(list_zip(s.vec, d.vec),
    lambda z: (z[1]-z[2])*(z[1]-z[2])))), 6) AS weight FROM graph g JOIN dense_cells s ON s.sample_id = g.sample_id AND s.cell_id = src
    JOIN dense_cells d ON d.sample_id = g.sample_id AND d.cell_id = dst""", "dense_cells", steps=GRAPH))
def bilateral_decay(spark, sf):
    c = V.dense_cells(spark, sf)
    g = graph.spatial_graph(c, vectors=c)
    return rounded(graph.bilateral_weights(g, c.withColumnRenamed("vec", "b")), "weight")


PROPAGATE = {
    **UNIT,
    "att": """SELECT sample_id, src, dst, exp(weight) / (sum(exp(weight)) OVER (PARTITION BY sample_id, dst) + 1e-9) AS w FROM graph""",
    "h0": "SELECT sample_id, cell_id, gene, value AS h FROM expression6",
}
for _i in (1, 2):
    PROPAGATE[f"h{_i}"] = f"""SELECT sample_id, cell_id, gene, 0.7*coalesce(m, 0) + 0.3*coalesce(b.h, 0) AS h FROM
        (SELECT a.sample_id, a.dst AS cell_id, gene, sum(h*w) AS m FROM att a JOIN h{_i - 1} p ON p.sample_id = a.sample_id AND p.cell_id = a.src GROUP BY 1, 2, 3)
        FULL JOIN h0 b USING (sample_id, cell_id, gene)"""


@query(V.oracle("SELECT sample_id, cell_id, gene, round(h, 6) AS h FROM h2", "expression6", steps=PROPAGATE))
def graph_propagate(spark, sf):
    c = V.points(spark, sf)
    g = graph.symmetric_normalize(c, _unit_edges(spark, sf))
    return rounded(graph.propagate(V.expression6(spark, sf).withColumnRenamed("value", "h"), g, 2, 0.3, cells=c), "h")


@query(V.oracle(f"""SELECT sample_id, cell_id, pos, round(sum(att*v), 6) AS value FROM (
    SELECT e.sample_id, e.dst AS cell_id, unnest(vec) AS v, unnest(range(64)) AS pos, e.att FROM
      (SELECT *, e / (sum(e) OVER (PARTITION BY sample_id, dst) + 1e-9) AS att FROM (SELECT *, exp(least(greatest(sc, -60), 60)) AS e FROM
        (SELECT l.*, s.vec, {DOT.format(a='s.vec', b='d.vec')}/sqrt(64) AS sc FROM l JOIN dense_cells s ON s.sample_id = l.sample_id AND s.cell_id = l.src
         JOIN dense_cells d ON d.sample_id = l.sample_id AND d.cell_id = l.dst))) e) GROUP BY 1, 2, 3""", "dense_cells", steps={
    **DENSE, "l": "SELECT sample_id, src, dst FROM near UNION ALL SELECT sample_id, cell_id, cell_id FROM dense_cells"}))
def neighbour_attention(spark, sf):
    c = V.dense_cells(spark, sf)
    qkv = c.select("sample_id", "cell_id", F.col("vec").alias("q"), F.col("vec").alias("k"), F.col("vec").alias("v"))
    return rounded(graph.neighbour_attention(c, _near(spark, sf), qkv), "value")


from catalog.inputs import CHUNKS  # noqa: E402

HALO = {
    "near": Q.knn(6), "und": Q.distinct_edges("near"),
    "twoway": "SELECT sample_id, src, dst FROM und UNION SELECT sample_id, dst, src FROM und", **CHUNKS,
    "r1": """SELECT sample_id, chunk_id, cell_id FROM chunks UNION SELECT c.sample_id, chunk_id, b.dst FROM chunks c JOIN twoway b
        ON b.sample_id = c.sample_id AND b.src = c.cell_id""",
    "r2": """SELECT sample_id, chunk_id, cell_id FROM r1 UNION SELECT c.sample_id, chunk_id, b.dst FROM r1 c JOIN twoway b
        ON b.sample_id = c.sample_id AND b.src = c.cell_id""",
}


def _halo_edges(spark, sf):
    return settle(spatial.undirected_distinct(spatial.knn_join(V.points(spark, sf), 6)).withColumn("weight", F.lit(1.0)))


@query(V.oracle("SELECT * FROM r2", "cells", steps=HALO))
def khop_expand(spark, sf):
    return graph.khop_expand(sampling.spatial_chunks(V.points(spark, sf), 100), _halo_edges(spark, sf), 2)


@query(V.oracle("SELECT r2.*, c.cell_id IS NOT NULL AS is_core FROM r2 LEFT JOIN chunks c USING (sample_id, chunk_id, cell_id)", "cells", steps=HALO))
def halo_chunks(spark, sf):
    return sampling.halo_chunks(V.points(spark, sf), _halo_edges(spark, sf), 100, 2)


@query(V.oracle("""SELECT u.sample_id, a.chunk_id, src, dst FROM und u JOIN r1 a ON a.sample_id = u.sample_id AND a.cell_id = src
    JOIN r1 b ON b.sample_id = u.sample_id AND b.cell_id = dst AND b.chunk_id = a.chunk_id""", "cells", steps=HALO))
def induced_subgraph(spark, sf):
    e = _halo_edges(spark, sf)
    members = settle(graph.khop_expand(sampling.spatial_chunks(V.points(spark, sf), 100), e, 1))
    return graph.induced_subgraph(members, e).select("sample_id", "chunk_id", "src", "dst")


# topology


@query(V.oracle("SELECT sample_id, i, j, round(value, 6) AS value FROM inter", *Q.TOPOLOGY_VIEWS, steps=Q.TOPOLOGY))
def interaction_matrix(spark, sf):
    c = V.points(spark, sf)
    pairs = spatial.radius_sites(c, settle(topology.topology_radius(c)))
    return rounded(topology.interaction_matrix(pairs, V.fractions(spark, sf)), "value")


@query(V.oracle("SELECT sample_id, i, j, round(expected, 6) AS expected FROM nullmean", *Q.TOPOLOGY_VIEWS, steps=Q.TOPOLOGY))
def block_null_mean(spark, sf):
    c = V.points(spark, sf)
    pairs = spatial.radius_sites(c, settle(topology.topology_radius(c)))
    return rounded(topology.block_null_mean(pairs, settle(topology.spatial_blocks(c)), settle(V.fractions(spark, sf))), "expected")


N_PERMS = 20
NULL_SD = {
    **Q.TOPOLOGY,
    "fixed": """SELECT sample_id, block, cell_id, row_number() OVER (PARTITION BY sample_id, block
        ORDER BY md5(CAST(cell_id AS VARCHAR) || ':base'), cell_id) AS r FROM blk""",
    "drawn": f"""SELECT sample_id, block, perm, cell_id AS donor, row_number() OVER (PARTITION BY sample_id, block, perm
        ORDER BY md5(CAST(cell_id AS VARCHAR) || ':' || CAST(perm AS VARCHAR)), cell_id) AS r FROM blk, range(1, {N_PERMS + 1}) p(perm)""",
    "moved": """SELECT d.sample_id, perm, f.cell_id, w.program_id, w.frac FROM drawn d JOIN fixed f USING (sample_id, block, r)
        JOIN fractions w ON w.sample_id = d.sample_id AND w.cell_id = donor""",
    "each": """SELECT a.sample_id, u.perm, u.program_id AS i, v.program_id AS j, sum(u.frac*v.frac) AS value FROM adj a
        JOIN moved u ON u.sample_id = a.sample_id AND u.cell_id = a.src
        JOIN moved v ON v.sample_id = a.sample_id AND v.cell_id = a.dst AND v.perm = u.perm GROUP BY 1, 2, 3, 4""",
    "sds": f"""SELECT sample_id, i, j, sqrt(greatest(sum(value*value)/{N_PERMS} - (sum(value)/{N_PERMS})*(sum(value)/{N_PERMS}), 0)) AS sd FROM each GROUP BY 1, 2, 3""",
}


@query(V.oracle("SELECT sample_id, i, j, round(sd, 6) AS sd FROM sds", *Q.TOPOLOGY_VIEWS, steps=NULL_SD))
def block_null_sd(spark, sf):
    c = V.points(spark, sf)
    pairs = spatial.radius_sites(c, settle(topology.topology_radius(c)))
    sd = topology.block_null_sd(pairs, settle(topology.spatial_blocks(c)), settle(V.fractions(spark, sf)), N_PERMS)
    return rounded(sd, "sd")


WITH_Z = """SELECT t.* EXCLUDE (i, j, "Continuous_Observed", "Continuous_Expected_Mean", "Log2_Enrichment"),
    round("Continuous_Observed", 5) AS "Continuous_Observed", round("Continuous_Expected_Mean", 5) AS "Continuous_Expected_Mean",
    round("Log2_Enrichment", 5) AS "Log2_Enrichment",
    round(("Continuous_Observed" - "Continuous_Expected_Mean") / (sqrt(2*(coalesce(sd,0)+1e-9)*(coalesce(sd,0)+1e-9)) + 1e-9), 5) AS "Spatial_Z_Score",
    round(("Continuous_Observed" - "Continuous_Expected_Mean") / (2*(coalesce(sd,0)+1e-9)), 5) AS z_exact
    FROM topo t LEFT JOIN sds s ON s.sample_id = "Sample" AND s.i = t.i AND s.j = t.j"""


def _topology(spark, sf, n_perms=0):
    return settle(topology.cohort_topology(V.points(spark, sf), V.fractions(spark, sf), V.program_names(spark, sf), V.manifest(spark, sf), n_perms))


@query(V.oracle(WITH_Z, *Q.TOPOLOGY_VIEWS, steps=NULL_SD))
def sample_topology(spark, sf):
    t = topology.cohort_topology(V.points(spark, sf), V.fractions(spark, sf), V.program_names(spark, sf), V.manifest(spark, sf), N_PERMS)
    return rounded(t, "Continuous_Observed", "Continuous_Expected_Mean", "Log2_Enrichment", "Spatial_Z_Score", "z_exact", digits=5)


@query(V.oracle(WITH_Z, *Q.TOPOLOGY_VIEWS, steps=NULL_SD))
def interface_stats(spark, sf):
    """Observed and expected contacts of programs, their enrichment, and z against block permutations."""
    t = _topology(spark, sf, N_PERMS)
    return rounded(t, "Continuous_Observed", "Continuous_Expected_Mean", "Log2_Enrichment", "Spatial_Z_Score", "z_exact", digits=5)


ALL_META = {**Q.TOPOLOGY, **Q.META}


def _meta_query(body: str):
    return query(V.oracle(body, *Q.TOPOLOGY_VIEWS, steps=ALL_META))


@_meta_query("""SELECT "Patient_ID", "Interface", round("Continuous_Observed", 5) AS "Continuous_Observed",
    round("Continuous_Expected_Mean", 5) AS "Continuous_Expected_Mean", round("Log2_Enrichment", 5) AS "Log2_Enrichment" FROM pm""")
def patient_interface_mean(spark, sf):
    return rounded(meta.patient_means(_topology(spark, sf)), "Continuous_Observed", "Continuous_Expected_Mean", "Log2_Enrichment", digits=5)


@_meta_query("""SELECT "Interface", k, round(effect, 6) AS effect, round(se, 6) AS se, round(p_value, 6) AS p_value FROM eff""")
def meta_effect(spark, sf):
    return rounded(meta.meta_effect(meta.patient_means(_topology(spark, sf))), "effect", "se", "p_value")


@_meta_query("""SELECT * FROM loo""")
def leave_one_out(spark, sf):
    return meta.leave_one_out(meta.patient_means(_topology(spark, sf)))


@_meta_query("""SELECT "Interface", round(q, 6) AS q FROM fdr""")
def bh_fdr(spark, sf):
    return rounded(meta.bh_fdr(meta.meta_effect(meta.patient_means(_topology(spark, sf)))).select("Interface", "q"), "q")


@_meta_query("SELECT * FROM meta")
def meta_topology(spark, sf):
    return meta.meta_topology(_topology(spark, sf))


@_meta_query("SELECT program, pos AS position FROM meta_pos")
def canonical_order(spark, sf):
    return meta.program_order(meta.meta_topology(_topology(spark, sf)))


MATRIX = """SELECT CASE WHEN pa.pos > pb.pos THEN a ELSE b END AS row_program, CASE WHEN pa.pos > pb.pos THEN b ELSE a END AS col_program,
    printf('Eff:%.3f | %s | %.3f', "Pooled_Log2_Enrichment", "LOPO_Robustness", "FDR_q") AS text
    FROM (SELECT *, split_part("Interface", '<->', 1) AS a, split_part("Interface", '<->', 2) AS b FROM meta)
    JOIN meta_pos pa ON pa.program = a JOIN meta_pos pb ON pb.program = b"""


@_meta_query(MATRIX)
def write_matrix(spark, sf):
    return meta.matrix_cells(meta.meta_topology(_topology(spark, sf)))


LINKS = """SELECT split_part("Interface", '<->', 1) AS source, split_part("Interface", '<->', 2) AS target, abs("Pooled_Log2_Enrichment") AS weight,
    "Pooled_Log2_Enrichment" AS effect, "LOPO_Robustness" AS lopo, "FDR_q" AS fdr FROM meta WHERE "FDR_q" < 0.997"""
NODES = f"""SELECT id, split_part(id, '_', 1) AS label, count(*) AS degree FROM (SELECT source AS id FROM ({LINKS})
    UNION ALL SELECT target FROM ({LINKS})) GROUP BY 1"""


def _links(spark, sf):
    return settle(meta.network_links(meta.meta_topology(_topology(spark, sf)), 0.997))


@_meta_query(LINKS)
def fdr_filter(spark, sf):
    return _links(spark, sf)


@_meta_query(NODES)
def network_degree(spark, sf):
    return meta.network_nodes(_links(spark, sf))


@_meta_query(f"""SELECT n.id AS id, count(*) AS n_shared FROM ({NODES}) n JOIN (SELECT source AS a, target AS b FROM ({LINKS})
    UNION ALL SELECT target, source FROM ({LINKS})) e ON e.b = n.id JOIN ({NODES}) s ON s.id = e.a
    WHERE s.label <= '3' AND n.label > '3' GROUP BY 1 HAVING count(*) >= 2""")
def topology_network(spark, sf):
    links = _links(spark, sf)
    return meta.shared_neighbours(links, meta.network_nodes(links).filter("label <= '3'"))


@_meta_query(f"""SELECT * FROM ({LINKS}) WHERE source IN (SELECT id FROM ({NODES}) WHERE label <= '3')
    AND target IN (SELECT id FROM ({NODES}) WHERE label <= '3')""")
def links_between(spark, sf):
    links = _links(spark, sf)
    return meta.links_between(links, meta.network_nodes(links).filter("label <= '3'"))


@_meta_query(f"""SELECT 'node' AS kind, id AS a, label AS b, CAST(degree AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS fdr FROM ({NODES})
    UNION ALL SELECT 'link', source, target, round(weight, 6), round(fdr, 6) FROM ({LINKS})""")
def network_tables(spark, sf):
    """The network's JSON text, read back."""
    shape = ("struct<nodes: array<struct<id: string, label: string, degree: long>>, "
             "links: array<struct<source: string, target: string, weight: double, fdr: double>>>")
    read = meta.network_payload(_links(spark, sf)).select(F.from_json("payload", shape).alias("p"))
    nodes = read.select(F.explode("p.nodes").alias("n")).select(
        F.lit("node").alias("kind"), F.col("n.id").alias("a"), F.col("n.label").alias("b"), F.col("n.degree").cast("double").alias("weight"),
        F.lit(None).cast("double").alias("fdr"))
    links = read.select(F.explode("p.links").alias("l")).select(
        F.lit("link").alias("kind"), F.col("l.source").alias("a"), F.col("l.target").alias("b"), F.round("l.weight", 6).alias("weight"), F.round("l.fdr", 6).alias("fdr"))
    return nodes.unionByName(links)


@query(V.oracle("""SELECT a.program_id AS i, b.program_id AS j, a.name || '<->' || b.name AS "Interface" FROM program_names a
    JOIN program_names b ON a.program_id < b.program_id""", "program_names"))
def pairwise_self_join(spark, sf):
    n = V.program_names(spark, sf)
    a = n.select(F.col("program_id").alias("i"), F.col("name").alias("na"))
    b = n.select(F.col("program_id").alias("j"), F.col("name").alias("nb"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", scalar.interface_label(F.col("na"), F.col("nb")).alias("Interface"))


@query(V.oracle("""SELECT DISTINCT unnest(string_split("Interface", '<->')) AS program FROM (SELECT a.name || '<->' || b.name AS "Interface"
    FROM program_names a JOIN program_names b ON a.program_id < b.program_id)""", "program_names"))
def interface_label(spark, sf):
    return pairwise_self_join(spark, sf).select(F.explode(scalar.interface_ends(F.col("Interface"))).alias("program")).distinct()


@query(V.oracle("SELECT name, split_part(name, '_', 1) AS label FROM program_names", "program_names"))
def node_label(spark, sf):
    return V.program_names(spark, sf).select("name", scalar.node_label(F.col("name")).alias("label"))


@query(V.oracle("""SELECT sample_id, program_id, mass FROM (SELECT sample_id, program_id, round(sum(frac)/any_value(n_cells), 6) AS mass
    FROM fractions JOIN ext USING (sample_id) GROUP BY 1, 2) WHERE mass > 0.16""", "fractions", steps={"ext": Q.EXTENTS}))
def min_mass_filter(spark, sf):
    return rounded(programs.topic_mass(V.points(spark, sf), V.fractions(spark, sf)), "mass").filter("mass > 0.16")


@query("""SELECT l_orderkey, l_linenumber, round(log2((l_extendedprice+1e-9)/(l_quantity+1e-9)), 6) AS enrichment FROM lineitem""")
def log2_enrichment(spark, sf):
    li = V.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(li.select("l_orderkey", "l_linenumber", scalar.log2_enrichment(F.col("l_extendedprice"), F.col("l_quantity")).alias("enrichment")), "enrichment")


@query(f"""SELECT event_id, round({Q.t_p('(value/20)', '(1 + event_id % 40)')}, 6) AS p FROM events""")
def t_two_sided_p(spark, sf):
    e = V.table(spark, sf, "events", "event_id", "value")
    return rounded(e.select("event_id", scalar.t_two_sided_p(F.col("value") / 20, (1 + F.col("event_id") % 40).cast("int")).alias("p")), "p")


@query("""SELECT page_id, replace(regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1), '_graph', '') AS stem FROM pages""")
def file_stem(spark, sf):
    return V.table(spark, sf, "pages", "page_id", "url").select("page_id", scalar.file_stem(F.col("url")).alias("stem"))


@query("""SELECT o_orderkey, round(0.5*(1-cos(pi()*p)), 9) AS progress, round(8 + 8*pow(p, 0.8), 9) AS scale,
    round(0.3 + 1.2*pow(1-p, 1.5), 9) AS temperature, round(1.2 + 0.5*p, 9) AS alpha
    FROM (SELECT o_orderkey, least(o_totalprice/500000, 1) AS p FROM orders)""")
def cosine_ramp(spark, sf):
    o = V.table(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumn("p", F.least(F.col("o_totalprice") / 500000, F.lit(1.0)))
    p = F.col("p")
    return rounded(o.select("o_orderkey", scalar.cosine_ramp(p).alias("progress"), scalar.scale_ramp(p, 8.0, 16.0).alias("scale"),
                            scalar.temperature_ramp(p, 1.5, 0.3).alias("temperature"), scalar.alpha_ramp(p, 1.2, 1.7).alias("alpha")),
                   "progress", "scale", "temperature", "alpha", digits=9)


# domains

CORR = """SELECT a.program_id AS i, b.program_id AS j, CASE WHEN a.program_id = b.program_id THEN 1.0
    ELSE least(greatest(CASE WHEN isnan(corr(a.f, b.f)) THEN 0 ELSE coalesce(corr(a.f, b.f), 0) END, -1), 1) END AS corr
    FROM full_f a JOIN full_f b USING (sample_id, cell_id) GROUP BY 1, 2"""
FULL_F = """SELECT c.sample_id, c.cell_id, p.program_id, coalesce(frac, 0) AS f FROM cells c CROSS JOIN program_ids p
    LEFT JOIN fractions fr ON fr.sample_id = c.sample_id AND fr.cell_id = c.cell_id AND fr.program_id = p.program_id"""


@query(V.oracle("SELECT i, j, round(corr, 6) AS corr FROM c", "fractions", steps={"full_f": FULL_F, "c": CORR}))
def program_correlation(spark, sf):
    return rounded(domains.program_correlation(V.points(spark, sf), settle(V.fractions(spark, sf))), "corr")


MAPPING = "SELECT program_id, CAST(program_id // 2 AS INTEGER) AS domain FROM program_ids"
DOMAIN = {
    "mapping": MAPPING, "near": Q.knn(6), "und": Q.distinct_edges("near"),
    "g": """SELECT sample_id, src, dst FROM und UNION ALL SELECT sample_id, dst, src FROM und UNION ALL SELECT sample_id, cell_id, cell_id FROM cells""",
    "dm": "SELECT sample_id, cell_id, domain, sum(frac) AS mass FROM fractions JOIN mapping USING (program_id) GROUP BY 1, 2, 3",
    "micro": """SELECT sample_id, cell_id, program_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, cell_id ORDER BY round(frac, 9) DESC, program_id) AS r FROM fractions) WHERE r = 1""",
    "macro": """SELECT c.sample_id, c.cell_id, coalesce(domain, 0) AS label FROM cells c LEFT JOIN (SELECT *, row_number() OVER
        (PARTITION BY sample_id, cell_id ORDER BY round(mass, 9) DESC, domain) AS r FROM dm) d ON d.sample_id = c.sample_id AND d.cell_id = c.cell_id AND r = 1""",
    "votes": """SELECT sample_id, cell_id, label, sum(v) AS votes FROM (SELECT g.sample_id, g.src AS cell_id, label, 1.0::DOUBLE AS v FROM g
        JOIN macro m ON m.sample_id = g.sample_id AND m.cell_id = g.dst UNION ALL SELECT sample_id, cell_id, label, 0.1::DOUBLE FROM macro) GROUP BY 1, 2, 3""",
    "smooth": """SELECT sample_id, cell_id, label FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, cell_id ORDER BY round(votes, 6) DESC, label) AS r FROM votes) WHERE r = 1""",
}


def _mapping(spark, sf):
    return V.program_ids(spark, sf).select("program_id", F.floor(F.col("program_id") / 2).cast("int").alias("domain"))


def _voting_graph(spark, sf):
    c = V.points(spark, sf)
    e = spatial.both_directions(spatial.undirected_distinct(spatial.knn_join(c, 6)))
    return settle(e.unionByName(c.select("sample_id", F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"))))


@query(V.oracle("SELECT sample_id, cell_id, domain, round(mass, 6) AS mass FROM dm", "fractions", steps=DOMAIN))
def domain_mass(spark, sf):
    return rounded(domains.domain_mass(V.fractions(spark, sf), _mapping(spark, sf)), "mass")


@query(V.oracle("SELECT sample_id, cell_id, program_id AS label FROM micro", "fractions", steps=DOMAIN))
def argmax_label(spark, sf):
    return domains.argmax_by(V.fractions(spark, sf), ["sample_id", "cell_id"], "program_id", F.round("frac", 9), "label")


def _macro(spark, sf):
    mass = domains.domain_mass(V.fractions(spark, sf), _mapping(spark, sf))
    best = domains.argmax_by(mass, ["sample_id", "cell_id"], "domain", F.round("mass", 9), "label")
    return settle(domains.every_cell(V.points(spark, sf), best, "label"))


@query(V.oracle("SELECT sample_id, cell_id, label, round(votes, 6) AS votes FROM votes", "fractions", steps=DOMAIN))
def neighbour_vote(spark, sf):
    return rounded(domains.neighbour_vote(_macro(spark, sf), _voting_graph(spark, sf)), "votes")


@query(V.oracle("""SELECT c.sample_id AS "Patient", c.cell_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS "X", CAST(CAST(y AS FLOAT) AS DOUBLE) AS "Y",
    coalesce(mi.program_id, 0) AS "Raw_GNN_MicroState", ma.label AS "Raw_Macro_Domain", s.label AS "Smoothed_Macro_Domain" FROM cells c
    LEFT JOIN micro mi USING (sample_id, cell_id) JOIN macro ma USING (sample_id, cell_id) JOIN smooth s USING (sample_id, cell_id)""",
                "fractions", steps=DOMAIN))
def smooth_domains(spark, sf):
    t = domains.smooth_domains(V.points(spark, sf), settle(V.fractions(spark, sf)), _mapping(spark, sf), _voting_graph(spark, sf))
    return t.withColumn("X", F.col("X").cast("double")).withColumn("Y", F.col("Y").cast("double"))


@query()
def program_domains(spark, sf):
    return domains.program_domains(domains.program_correlation(V.points(spark, sf), settle(V.fractions(spark, sf))))


@query(V.oracle("""SELECT sample_id, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.99) AS q99 FROM cells GROUP BY 1""", "cells"))
def exact_quantiles(spark, sf):
    return ordering.exact_quantiles(V.points(spark, sf), ["sample_id"], "x", {"q1": 0.25, "q2": 0.5, "q99": 0.99})
