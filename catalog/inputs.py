"""Queries over sources and quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog import views as V
from catalog.registry import query, rounded
from cellweft.config import CohortConfig
from cellweft.functions import scalar
from cellweft.operators import features, programs, qc, sampling, spatial, topology
from cellweft.session import settle
from cellweft.sources import readers

RAW_MANIFEST = """SELECT ' /data/' || n_name || '_graph.parquet ' AS filepath,
    CASE n_nationkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' 1' WHEN 2 THEN 'yes' WHEN 3 THEN 'T' ELSE 'no' END AS discovery,
    CASE WHEN n_nationkey % 2 = 0 THEN 'false' ELSE 'TRUE ' END AS projection, r_name AS dataset_id
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


def raw_manifest(spark, sf):
    m = V.manifest(spark, sf)
    k = F.col("n_nationkey") % 5
    return m.select(F.concat(F.lit(" /data/"), "sample_id", F.lit("_graph.parquet ")).alias("filepath"),
                    F.when(k == 0, "True").when(k == 1, " 1").when(k == 2, "yes").when(k == 3, "T").otherwise("no").alias(" discovery"),
                    F.when(F.col("n_nationkey") % 2 == 0, "false").otherwise("TRUE ").alias("projection"), "dataset_id")


CLEAN = """SELECT trim(filepath) AS filepath, replace(regexp_extract(trim(filepath), '([^/]+?)(\\.[^./]*)?$', 1), '_graph', '') AS sample_id,
    replace(regexp_extract(trim(filepath), '([^/]+?)(\\.[^./]*)?$', 1), '_graph', '') AS patient_id, dataset_id,
    lower(trim(discovery)) IN ('true', '1', 'yes', 't') AS discovery, lower(trim(projection)) IN ('true', '1', 'yes', 't') AS projection FROM raw"""


@query(V.oracle("SELECT * FROM clean", steps={"raw": RAW_MANIFEST, "clean": CLEAN}))
def read_manifest(spark, sf):
    return readers.clean_manifest(raw_manifest(spark, sf))


@query(V.oracle("""SELECT 'discovery' AS role, sample_id FROM clean WHERE discovery
    UNION ALL SELECT 'projection', sample_id FROM clean WHERE projection""", steps={"raw": RAW_MANIFEST, "clean": CLEAN}))
def split_roles(spark, sf):
    d, p = readers.split_roles(readers.clean_manifest(raw_manifest(spark, sf)))
    return d.select(F.lit("discovery").alias("role"), "sample_id").unionByName(p.select(F.lit("projection").alias("role"), "sample_id"))


@query(V.oracle("""SELECT 'discovery' AS role, sample_id FROM (SELECT * FROM clean WHERE discovery ORDER BY filepath LIMIT 2)
    UNION ALL SELECT 'projection', sample_id FROM (SELECT * FROM clean WHERE projection ORDER BY filepath LIMIT 2)""",
                steps={"raw": RAW_MANIFEST, "clean": CLEAN}))
def dev_slice(spark, sf):
    d, p = readers.split_roles(readers.clean_manifest(raw_manifest(spark, sf)), CohortConfig.for_mode("DEV").max_samples)
    return d.select(F.lit("discovery").alias("role"), "sample_id").unionByName(p.select(F.lit("projection").alias("role"), "sample_id"))


@query("SELECT r_name AS dataset_id, n_name AS sample_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def cell_metadata_join(spark, sf):
    n = V.table(spark, sf, "nation", "n_name", "n_regionkey")
    r = V.table(spark, sf, "region", "r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("dataset_id"), F.col("n_name").alias("sample_id"))


@query(V.oracle("""SELECT sample_id, cell_id, gene, value FROM expression WHERE gene IN (SELECT gene FROM signatures)
    AND sample_id IN (SELECT sample_id FROM manifest WHERE discovery)""", "expression", "signatures"))
def read_expression(spark, sf):
    raw = V.expression(spark, sf).withColumn("gene", F.concat(F.lit("  "), F.lower("gene")))
    return readers.select_expression(raw, V.signatures(spark, sf), V.manifest(spark, sf).filter("discovery"))


@query(V.oracle("SELECT lineage, gene FROM signatures", "signatures"))
def read_signatures(spark, sf):
    s = V.signatures(spark, sf)
    joined = s.groupBy("lineage").agg(F.sort_array(F.collect_list("gene")).alias("g"))
    quoted = F.concat(F.lit("['"), F.array_join("g", "', '"), F.lit("']"))
    text = F.when(F.col("lineage") % 2 == 0, quoted).otherwise(F.array_join("g", " , "))
    return readers.parse_signatures(joined.select(F.col("lineage").alias("Cell_type"), text.alias("Genes")))


@query(V.oracle("SELECT CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_idx, gene FROM (SELECT DISTINCT gene FROM expression)",
                "expression"))
def gene_vocab(spark, sf):
    text = readers.vocabulary_json(readers.number_genes(V.expression(spark, sf).select("gene").distinct()))
    return readers.parse_vocabulary(text)


GENE_NAMES = """SELECT CASE s_suppkey % 8 WHEN 0 THEN 'KRT' WHEN 1 THEN 'HIST' WHEN 2 THEN 'rab' WHEN 3 THEN 'CD' WHEN 4 THEN 'SOX'
    WHEN 5 THEN 'MT-CO' WHEN 6 THEN 'ZEB1-AS' ELSE 'TRIM' END || CAST(s_suppkey AS VARCHAR) AS gene FROM supplier"""


@query(None)
def noise_filter(spark, sf):
    return qc.noise_filter(gene_names(spark, sf))


def gene_names(spark, sf):
    k = F.col("s_suppkey") % 8
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("KRT", "HIST", "rab", "CD", "SOX", "MT-CO", "ZEB1-AS", "TRIM")]), (k + 1).cast("int"))
    return V.table(spark, sf, "supplier", "s_suppkey").select(F.concat(prefix, F.col("s_suppkey").cast("string")).alias("gene"))


def _noise_sql() -> str:
    from cellweft.functions.noise import NOISE_PATTERNS
    tests = " OR ".join("regexp_matches(gene, '{}', 'i')".format(p.replace("'", "''")) for p in NOISE_PATTERNS)
    return f"SELECT gene FROM ({GENE_NAMES}) WHERE NOT ({tests})"


from catalog.registry import ORACLES  # noqa: E402

ORACLES["noise_filter"] = _noise_sql()


@query(f"SELECT upper(trim(gene)) AS gene FROM ({GENE_NAMES})")
def canonical_gene(spark, sf):
    return gene_names(spark, sf).select(scalar.canonical_gene(F.concat(F.lit(" "), "gene")).alias("gene"))


@query(V.oracle("SELECT * FROM expression WHERE gene IN (SELECT gene FROM common_genes)", "expression", "common_genes"))
def whitelist_filter(spark, sf):
    return qc.whitelist_filter(V.expression(spark, sf), V.common_genes(spark, sf))


@query(V.oracle("""SELECT sample_id, count(DISTINCT gene) AS n_overlap FROM expression WHERE gene IN (SELECT gene FROM signatures)
    GROUP BY 1""", "expression", "signatures"))
def vocab_preflight(spark, sf):
    return qc.vocabulary_overlap(V.expression(spark, sf), V.signatures(spark, sf))


TOTALS = "SELECT c.sample_id, c.cell_id, coalesce(sum(value), 0) AS total FROM cells c LEFT JOIN expression USING (sample_id, cell_id) GROUP BY 1, 2"


@query(V.oracle(TOTALS, "expression"))
def cell_totals(spark, sf):
    return qc.cell_totals(V.points(spark, sf), V.expression(spark, sf))


@query(V.oracle("SELECT sample_id, gene, count(*) FILTER (WHERE value > 0) AS n_detected FROM expression GROUP BY 1, 2", "expression"))
def gene_detection(spark, sf):
    return qc.gene_detection(V.expression(spark, sf))


QC_STEPS = {
    "totals": TOTALS,
    "caps": "SELECT sample_id, quantile_cont(CAST(total AS DOUBLE), 0.99) AS cap FROM totals GROUP BY 1",
    "kept": "SELECT sample_id, cell_id FROM totals JOIN caps USING (sample_id) WHERE total >= 10 AND total <= cap",
    "sizes": Q.SIZES,
    "good": """SELECT sample_id, gene FROM (SELECT sample_id, gene, count(*) FILTER (WHERE value > 0) AS d FROM expression GROUP BY 1, 2)
        JOIN sizes USING (sample_id) WHERE d BETWEEN floor(n_cells * 0.001::DOUBLE) AND floor(n_cells * 0.95::DOUBLE)""",
}


@query(V.oracle("SELECT * FROM kept", "expression", steps=QC_STEPS))
def qc_cells(spark, sf):
    return qc.qc_cells(V.points(spark, sf), V.expression(spark, sf)).select("sample_id", "cell_id")


@query(V.oracle("SELECT * FROM good", "expression", steps=QC_STEPS))
def qc_genes(spark, sf):
    return qc.qc_genes(V.points(spark, sf), V.expression(spark, sf))


@query("SELECT o_orderkey AS cell_id, greatest(o_totalprice - 250000, 0) AS value FROM orders")
def clip_negative(spark, sf):
    o = V.table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return o.select(F.col("o_orderkey").alias("cell_id"), scalar.clip_negative(F.col("o_totalprice") - 250000).alias("value"))


@query(V.oracle("SELECT sample_id, cell_id, gene, round(lognorm, 6) AS lognorm FROM ln", "expression", steps={"ln": Q.LOGNORM}))
def normalize_log1p(spark, sf):
    return rounded(qc.normalize_log1p(V.expression(spark, sf)).drop("value"), "lognorm")


VOCAB = "SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_idx FROM common_genes"


@query(V.oracle("SELECT sample_id, cell_id, gene, greatest(value, 0) AS value, gene_idx FROM expression JOIN vocab USING (gene)",
                "expression", "common_genes", steps={"vocab": VOCAB}))
def remap_to_vocab(spark, sf):
    vocab = readers.number_genes(V.common_genes(spark, sf))
    return qc.remap_to_vocab(V.expression(spark, sf), vocab)


@query(V.oracle("""SELECT sample_id, cell_id, gene, least(value, cap) AS value FROM expression JOIN
    (SELECT sample_id, quantile_cont(value, 0.95) AS cap FROM expression WHERE value <> 0 GROUP BY 1) USING (sample_id)""", "expression"))
def winsorize(spark, sf):
    return qc.winsorize(V.expression(spark, sf))


HASHED = "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(CAST(cell_id AS VARCHAR) || ':42'), cell_id) AS rn FROM cells"


@query(V.oracle("SELECT h.sample_id, cell_id, rn <= floor(0.85::DOUBLE * n_cells) AS is_train FROM h JOIN sizes USING (sample_id)",
                "cells", steps={"h": HASHED, "sizes": Q.SIZES}))
def train_val_split(spark, sf):
    return qc.train_val_split(V.points(spark, sf)).select("sample_id", "cell_id", "is_train")


@query(V.oracle("SELECT sample_id, cell_id FROM h WHERE rn <= 100", "cells", steps={"h": HASHED}))
def sample_cap(spark, sf):
    return qc.sample_cap(V.points(spark, sf), 100).select("sample_id", "cell_id")


@query(V.oracle("SELECT * FROM (SELECT sample_id FROM cells GROUP BY 1 HAVING count(*) >= 590)", "cells"))
def min_cells_guard(spark, sf):
    return qc.min_cells_guard(V.points(spark, sf), 590).select("sample_id").distinct()


@query(V.oracle("""SELECT DISTINCT sample_id, gene FROM expression WHERE gene IN (SELECT gene FROM common_genes)""",
                "expression", "common_genes"))
def panel_intersection(spark, sf):
    panel = V.expression(spark, sf).select("sample_id", "gene").distinct()
    return panel.join(V.common_genes(spark, sf), "gene", "left_semi")


@query(V.oracle("""SELECT gene FROM (SELECT gene FROM expression INTERSECT SELECT gene FROM common_genes)""", "expression", "common_genes"))
def intersect_genes(spark, sf):
    return V.expression(spark, sf).select("gene").intersect(V.common_genes(spark, sf))


@query(V.oracle("""SELECT sample_id FROM manifest WHERE sample_id NOT IN (SELECT sample_id FROM cells GROUP BY 1 HAVING count(*) >= 590)""", "cells"))
def set_difference(spark, sf):
    done = qc.min_cells_guard(V.points(spark, sf), 590).select(F.col("sample_id").alias("Sample")).distinct()
    return topology.pending_samples(V.manifest(spark, sf), done).select("sample_id")


@query(V.oracle("""SELECT sample_id, 'too few cells' AS reason FROM manifest WHERE sample_id NOT IN
    (SELECT sample_id FROM cells GROUP BY 1 HAVING count(*) >= 590)""", "cells"))
def sample_errors(spark, sf):
    done = qc.min_cells_guard(V.points(spark, sf), 590).select(F.col("sample_id").alias("Sample")).distinct()
    return topology.sample_status(V.manifest(spark, sf), done, "too few cells")


@query(V.oracle("""SELECT sample_id, gene, sum(value) AS value FROM (SELECT sample_id, cell_id, gene, value FROM expression
    UNION ALL SELECT sample_id, cell_id, gene, value FROM expression6) GROUP BY 1, 2""", "expression", "expression6"))
def union_all(spark, sf):
    both = V.expression(spark, sf).unionByName(V.expression6(spark, sf))
    return both.groupBy("sample_id", "gene").agg(F.sum("value").alias("value"))


# features


@query(V.oracle("""SELECT sample_id, gene, round(sum(lognorm), 6) AS sum_x, round(sum(lognorm*lognorm), 6) AS sum_x2, any_value(n_cells) AS n_cells,
    round(sum(lognorm)/any_value(n_cells), 6) AS mean FROM ln JOIN sizes USING (sample_id) GROUP BY 1, 2""", "expression",
                steps={"ln": Q.LOGNORM, "sizes": Q.SIZES}))
def gene_moments(spark, sf):
    m = features.gene_moments(V.points(spark, sf), qc.normalize_log1p(V.expression(spark, sf)))
    return rounded(m, "sum_x", "sum_x2", "mean")


@query(V.oracle("SELECT sample_id, gene, bin, round(dispersion, 6) AS dispersion, round(hvg_score, 6) AS hvg_score FROM hvg", "expression",
                steps={"ln": Q.LOGNORM, **Q.hvg("cells", "ln")}))
def highly_variable_genes(spark, sf):
    h = features.highly_variable_genes(V.points(spark, sf), qc.normalize_log1p(V.expression(spark, sf)))
    return rounded(h, "dispersion", "hvg_score")


MORAN_STEPS = {"ln": Q.LOGNORM, "near": Q.knn(6), "edges": Q.distinct_edges("near"), **Q.moran("cells", "ln", "edges")}


@query(V.oracle("SELECT sample_id, gene, round(moran, 6) AS moran FROM moran", "expression", steps=MORAN_STEPS))
def morans_i(spark, sf):
    c = V.points(spark, sf)
    logged = settle(qc.normalize_log1p(V.expression(spark, sf)))
    return rounded(features.morans_i(c, logged, settle(features.moran_edges(c, 7))), "moran")


@query(V.oracle("""SELECT sample_id, gene, round(moran, 6) AS moran, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY sample_id ORDER BY round(moran, 6) DESC, gene) AS rank FROM moran) WHERE rank <= 10""", "expression", steps=MORAN_STEPS))
def spatially_patterned_genes(spark, sf):
    m = morans_i(spark, sf).withColumnRenamed("sample_id", "program_id").withColumnRenamed("moran", "weight")
    return programs.top_genes(m, 10).withColumnRenamed("program_id", "sample_id").withColumnRenamed("weight", "moran")


CONSENSUS_STEPS = {
    **QC_STEPS,
    "clean": """SELECT e.sample_id, e.cell_id, e.gene, value FROM expression e JOIN kept USING (sample_id, cell_id) JOIN good USING (sample_id, gene)""",
    "ln": Q.LOGNORM.replace("FROM expression", "FROM clean"),
    "kc": "SELECT c.* FROM cells c JOIN kept USING (sample_id, cell_id)",
    "near": Q.knn(6, "kc"), "edges": Q.distinct_edges("near"),
    **Q.moran("kc", "ln", "edges"), **Q.hvg("kc", "ln"),
    "sums": """SELECT gene, round(coalesce(h, 0), 6) AS hvg_sum, round(coalesce(m, 0), 6) AS moran_sum FROM
        (SELECT gene, sum(hvg_score) AS h FROM hvg GROUP BY 1) FULL JOIN (SELECT gene, sum(moran) AS m FROM moran GROUP BY 1) USING (gene)""",
    "ranks": """SELECT *, rank() OVER (ORDER BY hvg_sum DESC) + (count(*) OVER (PARTITION BY hvg_sum) - 1)/2
        + rank() OVER (ORDER BY moran_sum DESC) + (count(*) OVER (PARTITION BY moran_sum) - 1)/2 AS score FROM sums""",
}


@query(V.oracle("SELECT gene, hvg_sum, moran_sum, score FROM ranks ORDER BY score, gene LIMIT 40", "expression", steps=CONSENSUS_STEPS))
def consensus_genes(spark, sf):
    h, m = features.spatial_features(V.points(spark, sf), V.expression(spark, sf))
    return features.consensus_genes(h, m, 40, decimals=6)


@query(V.oracle("""SELECT sample_id, gene, round(hvg_score, 6) AS hvg_score, round(moran, 6) AS moran FROM hvg FULL JOIN moran USING (sample_id, gene)""",
                "expression", steps=CONSENSUS_STEPS))
def spatial_features(spark, sf):
    h, m = features.spatial_features(V.points(spark, sf), V.expression(spark, sf))
    t = h.select("sample_id", "gene", "hvg_score").join(m, ["sample_id", "gene"], "full_outer")
    return rounded(t, "hvg_score", "moran")


SCORES = {
    "h": "SELECT gene, sum(value) AS v FROM expression JOIN common_genes USING (gene) GROUP BY 1",
    "m": "SELECT gene, max(value) AS v FROM expression WHERE value > 60 GROUP BY 1",
    "u": "SELECT gene, coalesce(h.v, 0) AS hvg_sum, coalesce(m.v, 0) AS moran_sum FROM h FULL JOIN m USING (gene)",
}


def _two_scores(spark, sf):
    e = V.expression(spark, sf)
    h = e.join(V.common_genes(spark, sf), "gene", "left_semi").select("gene", F.col("value").alias("hvg_score"))
    m = e.filter("value > 60").groupBy("gene").agg(F.max("value").alias("moran"))
    return features.merge_scores(h, m)


@query(V.oracle("SELECT * FROM u", "expression", "common_genes", steps=SCORES))
def score_full_outer(spark, sf):
    return _two_scores(spark, sf)


@query(V.oracle("SELECT gene, moran_sum, rank() OVER (ORDER BY moran_sum DESC) + (count(*) OVER (PARTITION BY moran_sum) - 1)/2 AS r FROM u",
                "expression", "common_genes", steps=SCORES))
def avg_rank_desc(spark, sf):
    return features.avg_rank_desc(_two_scores(spark, sf), "moran_sum", "r").select("gene", "moran_sum", "r")


TFIDF = {
    "n": "SELECT sample_id, count(DISTINCT cell_id) AS n FROM doc_terms GROUP BY 1",
    "d": "SELECT sample_id, gene, count(*) AS df FROM doc_terms GROUP BY 1, 2",
    "w": "SELECT t.sample_id, t.cell_id, gene, (1+ln(value))*(ln((1+n)/(1+df))+1) AS w FROM doc_terms t JOIN n USING (sample_id) JOIN d USING (sample_id, gene)",
}


def _doc_cells(spark, sf):
    return V.doc_terms(spark, sf).select("sample_id", "cell_id").distinct()


@query(V.oracle("SELECT sample_id, cell_id, gene, round(w / sqrt(sum(w*w) OVER (PARTITION BY sample_id, cell_id)), 6) AS tfidf FROM w",
                "doc_terms", steps=TFIDF))
def tfidf(spark, sf):
    return rounded(features.tfidf(_doc_cells(spark, sf), V.doc_terms(spark, sf)), "tfidf")


@query(V.oracle("""SELECT DISTINCT sample_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY
    round(w / s, 9) DESC, sample_id, cell_id) AS rn FROM (SELECT *, sqrt(sum(w*w) OVER (PARTITION BY sample_id, cell_id)) AS s FROM w)) WHERE rn <= 3""",
                "doc_terms", steps=TFIDF))
def top_cells_per_gene(spark, sf):
    from cellweft.operators import priors
    t = features.tfidf(_doc_cells(spark, sf), V.doc_terms(spark, sf))
    return priors.top_cells_per_gene(t.withColumn("tfidf", F.round("tfidf", 9)), 3)


# grids, chunks and samples


@query(V.oracle(f"""SELECT sample_id, CAST(least({Q.grid('x', 'xmin', 'xmax', '8')}, 8) AS INTEGER) AS gx,
    CAST(least({Q.grid('y', 'ymin', 'ymax', '8')}, 8) AS INTEGER) AS gy, count(*) AS n FROM cells JOIN ext USING (sample_id) GROUP BY ALL""",
                "cells", steps={"ext": Q.EXTENTS}))
def grid_occupancy(spark, sf):
    return sampling.grid_occupancy(V.points(spark, sf), 8)


@query(V.oracle(f"""SELECT sample_id, cell_id, CAST({Q.grid('x', 'xmin', 'xmax', '8')} AS INTEGER) AS open_bin,
    CAST(least({Q.grid('x', 'xmin', 'xmax', '8')}, 8) AS INTEGER) AS closed_bin FROM cells JOIN ext USING (sample_id)""",
                "cells", steps={"ext": Q.EXTENTS}))
def grid_bin(spark, sf):
    c = V.points(spark, sf)
    t = c.join(spatial.extents(c), "sample_id")
    b = [F.col("x"), F.col("xmin"), F.col("xmax"), 8]
    return t.select("sample_id", "cell_id", spatial.grid_bin(*b).alias("open_bin"), spatial.grid_bin(*b, clipped=True).alias("closed_bin"))


CHUNKS = {
    "ext": Q.EXTENTS,
    "boxed": "SELECT *, ceil(sqrt(n_cells / 100.0::DOUBLE)) AS nb FROM cells JOIN ext USING (sample_id)",
    "sq": f"SELECT *, {Q.grid('x', 'xmin', 'xmax', 'nb')} AS gx, {Q.grid('y', 'ymin', 'ymax', 'nb')} AS gy FROM boxed",
    "chunks": """SELECT sample_id, cell_id, CAST((row_number() OVER (PARTITION BY sample_id ORDER BY gx, gy,
        md5(CAST(cell_id AS VARCHAR) || ':42'), cell_id) - 1) // 100 AS INTEGER) AS chunk_id FROM sq""",
}


@query(V.oracle("SELECT * FROM chunks", "cells", steps=CHUNKS))
def spatial_chunks(spark, sf):
    return sampling.spatial_chunks(V.points(spark, sf), 100)


@query(V.oracle(f"""SELECT sample_id, cell_id FROM o WHERE rn <= 120 OR al <= 120""", "cells", steps={
    "ext": Q.EXTENTS,
    "sq": f"""SELECT *, least({Q.grid('x', 'xmin', 'xmax', '7')}, 7) AS gx, least({Q.grid('y', 'ymin', 'ymax', '7')}, 7) AS gy,
        md5(CAST(cell_id AS VARCHAR) || ':42') AS h FROM cells JOIN ext USING (sample_id)""",
    "r": """SELECT *, row_number() OVER (PARTITION BY sample_id, gx, gy ORDER BY h, cell_id) AS r, count(*) OVER (PARTITION BY sample_id) AS al FROM sq""",
    "occ": "SELECT sample_id, count(*) AS occ FROM (SELECT DISTINCT sample_id, gx, gy FROM sq) GROUP BY 1",
    "o": """SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN r <= greatest(1, floor(120/occ)) THEN 0 ELSE 1 END, h, cell_id) AS rn
        FROM r JOIN occ USING (sample_id)"""}))
def grid_quota_sample(spark, sf):
    c = V.points(spark, sf)
    target = c.select("sample_id").distinct().withColumn("target", F.lit(120))
    return sampling.grid_quota_sample(c, target, F.lit(7))


SIZES_SQL = """SELECT sample_id, CAST(value AS INTEGER) AS cluster, count(*) AS size FROM expression6 GROUP BY 1, 2"""


@query(V.oracle("""SELECT sample_id, cluster, size, n_clusters, CAST(CASE WHEN al <= 800 THEN size WHEN rare THEN rq
    ELSE share + CASE WHEN rnk = 1 AND lft > 0 THEN greatest(0, lft - sum(share) OVER (PARTITION BY sample_id)) ELSE 0 END END AS BIGINT) AS quota FROM d""",
                "expression6", steps={
    "s": SIZES_SQL,
    "a": """SELECT *, CAST(count(*) OVER (PARTITION BY sample_id) AS INTEGER) AS n_clusters, sum(size) OVER (PARTITION BY sample_id) AS al FROM s""",
    "b": "SELECT *, size <= greatest(20, floor(800 / n_clusters)) AS rare FROM a",
    "b2": """SELECT *, coalesce(sum(CASE WHEN rare THEN size ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY cluster
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM b""",
    "c": "SELECT *, CASE WHEN rare THEN least(size, greatest(0, 800 - bef)) ELSE 0 END AS rq FROM b2",
    "c2": """SELECT *, 800 - sum(rq) OVER (PARTITION BY sample_id) AS lft, sum(CASE WHEN rare THEN 0 ELSE size END) OVER (PARTITION BY sample_id) AS bs,
        row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN rare THEN 0 ELSE size END DESC, cluster) AS rnk FROM c""",
    "d": "SELECT *, CASE WHEN NOT rare AND lft > 0 THEN floor(lft * (size / bs)) ELSE 0 END AS share FROM c2"}))
def stratified_quota(spark, sf):
    e = V.expression6(spark, sf)
    s = e.groupBy("sample_id", F.col("value").cast("int").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    n = s.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n_clusters"))
    return sampling.stratified_quota(s.join(n, "sample_id"), 800)


@query(V.oracle("""SELECT patient_id, chunk_key, CAST((before + deal - 1) % ceil((SELECT count(*) FROM keys) / 5.0) AS INTEGER) AS batch_id
    FROM dealt JOIN patients USING (patient_id)""", "cells", steps={
        **CHUNKS,
        "keys": "SELECT DISTINCT sample_id AS patient_id, sample_id || '#' || CAST(chunk_id AS VARCHAR) AS chunk_key FROM chunks",
        "dealt": "SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY md5(chunk_key || ':42'), chunk_key) AS deal FROM keys",
        "sizes": "SELECT patient_id, count(*) AS n, md5(patient_id || ':42') AS h FROM keys GROUP BY 1",
        "patients": "SELECT patient_id, sum(n) OVER (ORDER BY h, patient_id) - n AS before FROM sizes"}))
def stratified_batches(spark, sf):
    c = sampling.spatial_chunks(V.points(spark, sf), 100)
    keys = c.select(F.col("sample_id").alias("patient_id"), F.concat("sample_id", F.lit("#"), F.col("chunk_id").cast("string")).alias("chunk_key")).distinct()
    return sampling.stratified_batches(keys, 5)


@query()
def expression_sketch(spark, sf):
    kept = sampling.expression_sketch(V.points(spark, sf), V.expression(spark, sf), 200, components=20)
    return kept.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_kept"))
