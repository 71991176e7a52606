"""Queries over programs, priors, quality and trends."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import sql as Q
from catalog import views as V
from catalog.registry import query, rounded
from cellweft.config import CohortConfig
from cellweft.functions import simplex
from cellweft.operators import factor, graph, priors, programs, qc, quality, spatial, trend
from cellweft.plans import cohort
from cellweft.session import ensure_checkpoint_dir, settle

# simplex maps


@query(V.oracle(f"SELECT program_id, gene, round(p, 6) AS p FROM ({Q.softmax('programs', 'program_id', 'weight', 0.25, 'p', 'program_id, gene')})", "programs"))
def softmax(spark, sf):
    return rounded(simplex.softmax_by(V.programs(spark, sf), ["program_id"], "weight", "p", 0.1).drop("weight"), "p")


@query(V.oracle("""SELECT program_id, gene, round(ln(1+exp(weight)) / (sum(ln(1+exp(weight))) OVER (PARTITION BY program_id) + 1e-9), 6) AS p FROM programs""", "programs"))
def softplus_normalize(spark, sf):
    return rounded(simplex.softplus_normalize(V.programs(spark, sf), ["program_id"], "weight", "p").drop("weight"), "p")


@query(V.oracle("""SELECT sample_id, cell_id, program_id, round(frac*3 / (sum(frac*3) OVER (PARTITION BY sample_id, cell_id) + 1e-9), 6) AS p FROM fractions""", "fractions"))
def row_normalize(spark, sf):
    f = V.fractions(spark, sf).withColumn("frac", F.col("frac") * 3)
    return rounded(simplex.row_normalize(f, ["sample_id", "cell_id"], "frac", "p").drop("frac"), "p")


@query(V.oracle("""SELECT program_id, gene, round(weight / sqrt(sum(weight*weight) OVER (PARTITION BY program_id)), 6) AS u FROM programs""", "programs"))
def l2_normalize(spark, sf):
    return rounded(simplex.l2_normalize(V.programs(spark, sf), ["program_id"], "weight", "u").drop("weight"), "u")


SPARSEMAX = {
    "s": "SELECT sample_id, cell_id, program_id, frac*3 AS z FROM fractions",
    "r": """SELECT *, row_number() OVER w AS k, sum(z) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s
        WINDOW w AS (PARTITION BY sample_id, cell_id ORDER BY z DESC, program_id)""",
    "t": "SELECT sample_id, cell_id, arg_max((cum-1)/k, k) FILTER (WHERE 1 + k*z > cum) AS tau FROM r GROUP BY 1, 2",
}


@query(V.oracle("SELECT sample_id, cell_id, program_id, round(greatest(z - tau, 0), 6) AS p FROM s JOIN t USING (sample_id, cell_id)", "fractions", steps=SPARSEMAX))
def sparsemax(spark, sf):
    f = V.fractions(spark, sf).withColumn("z", F.col("frac") * 3)
    return rounded(simplex.sparsemax_by(f, ["sample_id", "cell_id"], "z", "program_id", "p").drop("frac", "z"), "p")


@query(V.oracle("SELECT sample_id, cell_id, unnest(i) AS program_id, round(unnest(p), 5) AS p FROM ent JOIN sc USING (sample_id, cell_id)", "fractions", steps={
    "sc": "SELECT sample_id, cell_id, list(program_id ORDER BY program_id) AS i, list(frac*4 ORDER BY program_id) AS s FROM fractions GROUP BY 1, 2",
    **Q.entmax("sc", "sample_id, cell_id", 1.5)}))
def entmax(spark, sf):
    f = V.fractions(spark, sf).withColumn("z", F.col("frac") * 4)
    return rounded(simplex.entmax_by(f, ["sample_id", "cell_id"], "program_id", "z", "p", 1.5), "p", digits=5)


CORE = {
    "core": "SELECT *, weight*100 AS z, weight >= 0.04 AS is_core FROM programs",
    "pc": Q.softmax("(SELECT *, CASE WHEN is_core THEN z ELSE -50 END AS zc FROM core)", "program_id", "zc", 0.5, "pc", "program_id, gene"),
    "pf": Q.softmax("core", "program_id", "z", 0.5, "pf", "program_id, gene"),
}


@query(V.oracle("SELECT program_id, gene, round(0.97*pc + 0.03*pf, 6) AS p FROM pc JOIN pf USING (program_id, gene)", "programs", steps=CORE))
def core_protected_weights(spark, sf):
    p = V.programs(spark, sf).withColumn("z", F.col("weight") * 100).withColumn("is_core", F.col("weight") >= 0.04)
    return rounded(simplex.blended_core_softmax(p, ["program_id"], "z", "is_core", "p", 0.6).select("program_id", "gene", "p"), "p")


# programs and fractions

TOP = """SELECT program_id, gene, row_number() OVER (PARTITION BY program_id ORDER BY weight DESC, gene) AS rank, weight FROM programs"""


@query(V.oracle(f"SELECT program_id, gene, rank FROM ({TOP}) WHERE rank <= 10", "programs"))
def top_genes(spark, sf):
    return programs.top_genes(V.programs(spark, sf), 10).select("program_id", "gene", "rank")


NAMES = f"""SELECT program_id, CAST(row_number() OVER (ORDER BY program_id) AS VARCHAR) || '_' || string_agg(gene, '_' ORDER BY rank) AS name
    FROM ({TOP}) WHERE rank <= 3 GROUP BY 1"""


@query(V.oracle(NAMES, "programs"))
def name_programs(spark, sf):
    return programs.name_programs(V.programs(spark, sf))


@query(V.oracle("SELECT sample_id, program_id, round(sum(frac)/any_value(n_cells), 6) AS mass FROM fractions JOIN ext USING (sample_id) GROUP BY 1, 2",
                "fractions", steps={"ext": Q.EXTENTS}))
def topic_mass(spark, sf):
    return rounded(programs.topic_mass(V.points(spark, sf), V.fractions(spark, sf)), "mass")


SIM = {
    "ln": Q.LOGNORM.replace("FROM expression", "FROM expression25"),
    "un": "SELECT program_id, gene, weight / sqrt(sum(weight*weight) OVER (PARTITION BY program_id)) AS u FROM programs",
    "nc": "SELECT sample_id, cell_id, sqrt(sum(lognorm*lognorm)) AS nc, sum(lognorm) AS tot FROM ln GROUP BY 1, 2",
    "sim": """SELECT sample_id, cell_id, program_id, sum(lognorm*u)/any_value(nc) AS similarity FROM ln JOIN un USING (gene)
        JOIN nc USING (sample_id, cell_id) GROUP BY 1, 2, 3""",
    "sc": "SELECT sample_id, cell_id, list(program_id ORDER BY program_id) AS i, list(similarity*16 ORDER BY program_id) AS s FROM sim GROUP BY 1, 2",
    **Q.entmax("sc", "sample_id, cell_id", 1.65),
    "fr": "SELECT sample_id, cell_id, unnest(i) AS program_id, unnest(p) AS p FROM ent JOIN sc USING (sample_id, cell_id)",
}


def _lognorm25(spark, sf):
    return settle(qc.normalize_log1p(V.expression25(spark, sf)))


@query(V.oracle("SELECT sample_id, cell_id, program_id, round(similarity, 6) AS similarity FROM sim", "expression25", "programs", steps=SIM))
def program_similarity(spark, sf):
    return rounded(programs.program_similarity(_lognorm25(spark, sf), V.programs(spark, sf)), "similarity")


@query(V.oracle("SELECT sample_id, cell_id, program_id, round(p*tot, 3) AS frac FROM fr JOIN nc USING (sample_id, cell_id) WHERE p > 1e-4", "expression25", "programs", steps=SIM))
def fractions_from_scores(spark, sf):
    e, p = _lognorm25(spark, sf), settle(V.programs(spark, sf))
    raw = programs.fractions_from_scores(programs.program_similarity(e, p), p).filter("frac > 1e-4")
    return rounded(programs.scale_by_total(raw, e), "frac", digits=3)


@query(V.oracle("SELECT sample_id, cell_id, program_id, round(p*tot/(sum(p*tot) OVER (PARTITION BY sample_id, cell_id)+1e-9), 5) AS frac FROM fr JOIN nc USING (sample_id, cell_id) QUALIFY frac > 1e-3",
                "expression25", "programs", steps=SIM))
def project_fractions(spark, sf):
    f = programs.project_fractions(_lognorm25(spark, sf), settle(V.programs(spark, sf)))
    return rounded(f, "frac", digits=5).filter("frac > 1e-3")


RECON = "SELECT sample_id, cell_id, gene, sum(frac*weight) AS expected FROM fractions JOIN programs USING (program_id) GROUP BY 1, 2, 3"


@query(V.oracle("SELECT sample_id, cell_id, gene, round(expected, 6) AS expected FROM recon", "fractions", "programs", steps={"recon": RECON}))
def reconstruct(spark, sf):
    return rounded(programs.reconstruct(V.fractions(spark, sf), V.programs(spark, sf)), "expected")


BASE = "SELECT gene, sum(value)/(sum(sum(value)) OVER () + 1e-9) AS baseline FROM expression25 GROUP BY 1"


@query(V.oracle("SELECT gene, round(baseline, 9) AS baseline FROM b", "expression25", steps={"b": BASE}))
def empirical_baseline(spark, sf):
    return rounded(programs.empirical_baseline(V.expression25(spark, sf)), "baseline", digits=9)


@query(V.oracle("""SELECT sample_id, cell_id, gene, round((0.22*baseline + (1-0.22)*expected)*total, 6) AS mixed FROM recon JOIN b USING (gene)
    JOIN (SELECT sample_id, cell_id, sum(value) AS total FROM expression25 GROUP BY 1, 2) USING (sample_id, cell_id)""", "fractions", "programs", "expression25",
                steps={"b": BASE, "recon": RECON}))
def background_mix(spark, sf):
    e = V.expression25(spark, sf)
    t = programs.background_mix(programs.reconstruct(V.fractions(spark, sf), V.programs(spark, sf)), programs.empirical_baseline(e),
                                e.groupBy("sample_id", "cell_id").agg(F.sum("value").alias("total")), 0.22)
    return rounded(t.select("sample_id", "cell_id", "gene", "mixed"), "mixed")


MASS = {"pmass": "SELECT patient_id, program_id, sum(frac) AS mass FROM fractions JOIN manifest USING (sample_id) GROUP BY 1, 2"}


def _mass(spark, sf):
    return settle(programs.patient_mass(V.fractions(spark, sf), V.manifest(spark, sf)))


@query(V.oracle("SELECT patient_id, program_id, round(mass, 5) AS mass FROM pmass", "fractions", steps=MASS))
def patient_mass(spark, sf):
    return rounded(_mass(spark, sf), "mass", digits=5)


ENT = {**MASS,
       "pp": "SELECT *, mass/(sum(mass) OVER (PARTITION BY program_id)+1e-9) AS p FROM pmass",
       "en": "SELECT program_id, sum(-p*ln(p+1e-9)) AS entropy FROM pp GROUP BY 1"}


@query(V.oracle("SELECT program_id, round(entropy, 6) AS entropy FROM en", "fractions", steps=ENT))
def program_entropy(spark, sf):
    return rounded(programs.program_entropy(_mass(spark, sf)), "entropy")


PRUNE = {**ENT,
         "full0": """SELECT p.patient_id, k.program_id, coalesce(mass, 0) AS mass, p.patient_id || ':' || CAST(k.program_id AS VARCHAR) AS slot_key
            FROM (SELECT DISTINCT patient_id FROM pmass) p CROSS JOIN (SELECT DISTINCT program_id FROM pmass) k LEFT JOIN pmass m
            ON m.patient_id = p.patient_id AND m.program_id = k.program_id""",
         "fixed": "SELECT program_id, row_number() OVER (ORDER BY program_id, patient_id) AS r FROM full0",
         "drawn": "SELECT perm, mass, row_number() OVER (PARTITION BY perm ORDER BY md5(slot_key || ':' || CAST(perm AS VARCHAR)), slot_key) AS r FROM full0, range(1, 101) q(perm)",
         "sh": "SELECT perm, program_id, mass/(sum(mass) OVER (PARTITION BY perm, program_id)+1e-9) AS p FROM drawn JOIN fixed USING (r)",
         "nul": "SELECT perm, program_id, sum(-p*ln(p+1e-9)) AS e FROM sh GROUP BY 1, 2",
         "thr": "SELECT quantile_cont(e, 0.01) AS threshold FROM nul"}


@query(V.oracle("SELECT program_id, round(entropy, 6) AS entropy, round(threshold, 6) AS threshold, entropy > threshold AS kept FROM en, thr", "fractions", steps=PRUNE))
def entropy_pruning(spark, sf):
    return rounded(programs.entropy_pruning(_mass(spark, sf), 100), "entropy", "threshold")


@query(V.oracle(f"""SELECT program_id, kept, printf('%.1f%%', top) AS top_patient_share, genes AS top_genes FROM (SELECT program_id, entropy > threshold AS kept FROM en, thr)
    JOIN (SELECT program_id, max(mass)/(sum(mass)+1e-9)*100 AS top FROM pmass GROUP BY 1) USING (program_id)
    JOIN (SELECT program_id, string_agg(printf('%s|%.3f', gene, weight), ', ' ORDER BY rank) AS genes FROM ({TOP}) WHERE rank <= 10 GROUP BY 1) USING (program_id)""",
                "fractions", "programs", steps=PRUNE))
def refinement_report(spark, sf):
    m = _mass(spark, sf)
    return programs.refinement_report(programs.entropy_pruning(m, 100), m, V.programs(spark, sf))


PANEL = {
    "panel": """SELECT DISTINCT sample_id, gene FROM (SELECT sample_id, gene, sum(value) AS v, avg(sum(value)) OVER (PARTITION BY sample_id) AS a
        FROM expression25 GROUP BY 1, 2) WHERE v >= a""",
    "vocab": "SELECT DISTINCT gene FROM programs",
    "sz": "SELECT sample_id, count(*) AS m FROM panel JOIN vocab USING (gene) GROUP BY 1",
    "w": "SELECT program_id, gene, weight/(sum(weight) OVER (PARTITION BY program_id)+1e-9) AS w FROM programs",
    "obs": "SELECT sample_id, program_id, sum(w) AS mass FROM panel JOIN w USING (gene) GROUP BY 1, 2",
    "top": f"SELECT sample_id, program_id, count(*) AS n_top FROM ({TOP}) JOIN panel USING (gene) WHERE rank <= 50 GROUP BY 1, 2",
    "rk": "SELECT perm, gene, row_number() OVER (PARTITION BY perm ORDER BY md5(gene || ':' || CAST(perm AS VARCHAR)), gene) AS r FROM vocab, range(1, 101) p(perm)",
    "nm": "SELECT m, perm, program_id, sum(w) AS null_mass FROM (SELECT DISTINCT m FROM sz) JOIN rk ON r <= m JOIN w USING (gene) GROUP BY 1, 2, 3",
    "pv": """SELECT o.sample_id, o.program_id, mass, sz.m, (count(*) FILTER (WHERE null_mass >= mass - 1e-12) + 1.0)/101.0::DOUBLE AS p_value FROM obs o JOIN sz USING (sample_id)
        JOIN nm ON nm.m = sz.m AND nm.program_id = o.program_id GROUP BY 1, 2, 3, 4""",
}


@query(V.oracle("""SELECT sample_id, program_id, round(mass, 6) AS mass, round(p_value, 6) AS p_value, coalesce(n_top, 0) AS n_top FROM pv LEFT JOIN top USING (sample_id, program_id)
    WHERE m/(SELECT count(*) FROM vocab) >= 0.8 OR (p_value < 0.05 AND mass > m/(SELECT count(*) FROM vocab)) OR n_top >= 3""", "expression25", "programs", steps=PANEL))
def panel_validation(spark, sf):
    e = V.expression25(spark, sf).groupBy("sample_id", "gene").agg(F.sum("value").alias("v"))
    mean = e.groupBy("sample_id").agg(F.avg("v").alias("a"))
    panel = settle(e.join(mean, "sample_id").filter("v >= a").select("sample_id", "gene"))
    p = settle(V.programs(spark, sf))
    return rounded(programs.validate_panel(panel, p, p.select("gene").distinct(), 100), "mass", "p_value")


# priors

SHARED = {
    "sig": "SELECT DISTINCT lineage, gene FROM signatures",
    "n": "SELECT lineage, count(*) AS n FROM sig GROUP BY 1",
    "sh": "SELECT a.lineage AS a, b.lineage AS b, count(*) AS shared FROM sig a JOIN sig b ON a.gene = b.gene AND a.lineage < b.lineage GROUP BY 1, 2",
}


@query(V.oracle("SELECT a, b, round(1 - shared/(x.n + y.n - shared), 9) AS distance FROM sh JOIN n x ON x.lineage = a JOIN n y ON y.lineage = b", "signatures", steps=SHARED))
def jaccard_distance(spark, sf):
    return rounded(priors.jaccard_pairs(V.signatures(spark, sf)), "distance", digits=9)


@query(V.oracle("SELECT a, b, round(shared/least(x.n, y.n), 9) AS overlap FROM sh JOIN n x ON x.lineage = a JOIN n y ON y.lineage = b", "signatures", steps=SHARED))
def overlap_coefficient(spark, sf):
    s = V.signatures(spark, sf)
    return rounded(priors.overlap_coefficients(s.withColumnRenamed("lineage", "a")), "overlap", digits=9)


MARKERS = {
    "cl": "SELECT DISTINCT lineage, CAST(lineage // 8 AS INTEGER) AS cluster FROM signatures",
    "ch": "SELECT cluster, count(*) AS n_children FROM cl GROUP BY 1",
    "fq": "SELECT cluster, gene, count(*) AS n, any_value(n_children) AS n_children FROM signatures JOIN cl USING (lineage) JOIN ch USING (cluster) GROUP BY 1, 2",
    "pa": """SELECT *, n_children = 1 OR n/n_children >= 0.4 AS pass FROM fq""",
    "rk": """SELECT *, count(*) FILTER (WHERE pass) OVER (PARTITION BY cluster) AS np, count(*) OVER (PARTITION BY cluster) AS nu,
        row_number() OVER (PARTITION BY cluster ORDER BY n DESC, gene) AS ra,
        row_number() OVER (PARTITION BY cluster ORDER BY pass DESC, n DESC, gene) AS rp FROM pa""",
    "nouns": "SELECT cluster, gene, n, n_children FROM rk WHERE CASE WHEN np >= 10 THEN pass AND rp <= 30 ELSE nu >= 10 AND ra <= 10 END",
}


def _nouns(spark, sf):
    s = V.signatures(spark, sf)
    clusters = s.select("lineage", F.floor(F.col("lineage") / 8).cast("int").alias("cluster")).distinct()
    return clusters, priors.consensus_markers(s, clusters, 0.4, 10, 30)


@query(V.oracle("SELECT * FROM nouns", "signatures", steps=MARKERS))
def consensus_markers(spark, sf):
    return _nouns(spark, sf)[1]


@query(V.oracle("""SELECT 'NOUNS' AS section, row_number() OVER (ORDER BY cluster) - 1 AS position,
    printf('N%02d|n=%02d|top=[%s]|states=[%s]', CAST(row_number() OVER (ORDER BY cluster) - 1 AS INTEGER), CAST(n_children AS INTEGER), top, states) AS line FROM
    (SELECT cluster, any_value(n_children) AS n_children, string_agg(gene, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, gene) AS r FROM nouns) WHERE r <= 5 GROUP BY 1)
    JOIN (SELECT cluster, string_agg(CAST(lineage AS VARCHAR), ',' ORDER BY CAST(lineage AS VARCHAR)) AS states FROM cl GROUP BY 1) USING (cluster)""", "signatures", steps=MARKERS))
def prior_report(spark, sf):
    clusters, nouns = _nouns(spark, sf)
    p = settle(V.programs(spark, sf))
    accepted = settle(p.groupBy(F.col("program_id").alias("set_id")).agg(F.sum("weight").alias("energy")).withColumn("position", F.col("set_id")))
    stats = spark.createDataFrame([("mapped", 0), ("redundant", 0), ("over_budget", 0), ("kept", 6)], "name string, n long")
    return priors.prior_report(settle(clusters), settle(nouns), accepted, p, stats).filter("section = 'NOUNS'")


@query()
def marker_set_clusters(spark, sf):
    clusters, nouns = priors.marker_set_clusters(settle(V.signatures(spark, sf)), 0.85)
    return nouns


def _dictionary(spark, sf, components=8, rounds=6):
    e = settle(V.expression(spark, sf))
    genes = settle(factor.vocabulary(e))
    weights = priors.prior_matrix(V.points(spark, sf), e)
    matrix, losses = priors.program_dictionary(weights, genes, components, rounds)
    return genes, factor.dictionary_table(spark, matrix, genes, 1e-6), losses


@query()
def program_dictionary(spark, sf):
    return _dictionary(spark, sf)[1]


@query()
def program_candidates(spark, sf):
    _, dictionary, _ = _dictionary(spark, sf)
    _, nouns = _nouns(spark, sf)
    return priors.program_candidates(settle(dictionary), settle(nouns), 20, 0.7, 0.6)[0]


GREEDY = {
    "can": "SELECT lineage AS set_id, CAST(count(*) AS DOUBLE) AS energy FROM signatures GROUP BY 1",
    "sh": "SELECT a.lineage AS a, b.lineage AS b, count(*) AS c FROM signatures a JOIN signatures b ON a.gene = b.gene AND a.lineage <> b.lineage GROUP BY 1, 2",
    "clo": """SELECT a, list(b) AS near FROM sh JOIN can x ON x.set_id = a JOIN can y ON y.set_id = b WHERE c / least(x.energy, y.energy) >= 0.30 GROUP BY 1""",
    "cand": "SELECT set_id, energy, list_prepend(set_id, coalesce(near, [])) AS out FROM can LEFT JOIN clo ON a = set_id",
    "gre": """WITH RECURSIVE g AS (
        SELECT 0 AS position, (SELECT arg_min(set_id, (-energy, set_id)) FROM cand) AS set_id, CAST([] AS BIGINT[]) AS before
        UNION ALL SELECT position + 1, (SELECT arg_min(c.set_id, (-c.energy, c.set_id)) FROM cand c WHERE NOT list_contains(list_concat(g.before, d.out), c.set_id)),
            list_concat(g.before, d.out) FROM g JOIN cand d ON d.set_id = g.set_id WHERE position < 7)
        SELECT CAST(position AS INTEGER) AS position, set_id FROM g WHERE set_id IS NOT NULL""",
}


@query(V.oracle("SELECT set_id, energy, position FROM gre JOIN can USING (set_id)", "signatures", steps=GREEDY))
def greedy_dedupe(spark, sf):
    s = settle(V.signatures(spark, sf))
    energy = s.groupBy(F.col("lineage").alias("set_id")).agg(F.count(F.lit(1)).cast("double").alias("energy"))
    o = priors.overlap_coefficients(s.withColumnRenamed("lineage", "a"), s.withColumnRenamed("lineage", "b"), 0.30).filter("a <> b")
    return priors.greedy_dedupe(energy, o, 0.30, 8)


@query()
def prior_programs(spark, sf):
    _, dictionary, _ = _dictionary(spark, sf)
    dictionary = settle(dictionary)
    nouns = settle(_nouns(spark, sf)[1])
    accepted, _stats = priors.program_candidates(dictionary, nouns, 20, 0.7, 0.6)
    return priors.prior_programs(nouns, dictionary, accepted, 20)


@query()
def seeded_programs(spark, sf):
    e = settle(qc.normalize_log1p(V.expression(spark, sf)))
    genes = settle(factor.vocabulary(e))
    nouns = settle(_nouns(spark, sf)[1])
    near = spatial.knn_join(V.points(spark, sf), 6).withColumn("weight", 1 / (1 + F.col("dist")))
    wired = graph.symmetric_normalize(V.points(spark, sf), spatial.undirected_distinct(near, "weight"))
    context = priors.smooth_expression(e, settle(wired), 1, cells=V.points(spark, sf))
    prior = nouns.select(F.col("cluster").alias("program_id"), "gene")
    fitted, _losses, packed = priors.seeded_programs(context, genes, prior, 5)
    weights = factor.cell_weights(packed, fitted)
    return weights.groupBy("sample_id", "program_id").agg(F.sum("weight").alias("mass"))


@query()
def fit_history(spark, sf):
    """Losses of training and held-out cells by round, the round chosen and why rounds ended."""
    e = settle(qc.normalize_log1p(V.expression(spark, sf)))
    prior = _nouns(spark, sf)[1].select(F.col("cluster").alias("program_id"), "gene")
    split = settle(qc.train_val_split(V.points(spark, sf)))
    return rounded(priors.validated_programs(e, split, settle(factor.vocabulary(e)), settle(prior), 30).history, "train_loss", "val_loss", "sharpness", digits=5)


# quality

LOSS = {"recon": RECON,
        "en": """SELECT coalesce(value, 0) AS x, coalesce(expected, 0) AS r FROM (SELECT sample_id, cell_id, gene, value FROM cells CROSS JOIN (SELECT DISTINCT gene FROM programs) g
            LEFT JOIN expression25 USING (sample_id, cell_id, gene)) LEFT JOIN recon USING (sample_id, cell_id, gene)""",
        "el": """SELECT x, least(greatest((r-x)*CASE WHEN x > 0 AND r < x THEN 3 ELSE 1 END, -30), 30) + 1e-6 AS d FROM en"""}


@query(V.oracle("""SELECT round(sum(ln(cosh(d)) * CASE WHEN x > 0 THEN (SELECT count(*) FILTER (WHERE x = 0)/count(*) FILTER (WHERE x > 0) FROM en) ELSE 0.05 END)/count(*), 5) AS recon_loss FROM el""",
                "expression25", "fractions", "programs", steps=LOSS))
def recon_loss(spark, sf):
    p = settle(V.programs(spark, sf))
    expected = programs.reconstruct(V.fractions(spark, sf), p)
    n_cells = V.points(spark, sf).count()
    return rounded(quality.recon_loss(V.expression25(spark, sf), expected, n_cells, p.select("gene").distinct().count()), "recon_loss", digits=5)


GRAM = {"un": SIM["un"],
        "gr": "SELECT a.program_id AS i, b.program_id AS j, sum(a.u*b.u) AS c FROM un a JOIN un b ON a.gene = b.gene AND a.program_id <> b.program_id GROUP BY 1, 2",
        "kk": "SELECT count(DISTINCT program_id) AS k FROM programs"}


@query(V.oracle("""SELECT round(max(c), 6) AS max_overlap, round(sum(c)/(any_value(k)*(any_value(k)-1)), 6) AS mean_overlap,
    round(sum(greatest(c-0.15, 0)*greatest(c-0.15, 0))/any_value(k) + 0.1*sum(c*c)/(any_value(k)*(any_value(k)-1)), 6) AS overlap_penalty FROM gr, kk""", "programs", steps=GRAM))
def dictionary_overlap(spark, sf):
    return rounded(quality.dictionary_overlap(settle(V.programs(spark, sf))), "max_overlap", "mean_overlap", "overlap_penalty")


@query(V.oracle("SELECT round(avg(e), 6) AS gene_entropy FROM (SELECT program_id, sum(-weight*ln(weight+1e-9)) AS e FROM programs GROUP BY 1)", "programs"))
def dictionary_entropy(spark, sf):
    return rounded(quality.dictionary_entropy(V.programs(spark, sf)), "gene_entropy")


@query(V.oracle("""SELECT round(1 - (SELECT sum(a.u*b.u) FROM un a JOIN un2 b USING (program_id, gene))/6, 6) AS drift,
    round((SELECT sum(greatest(weight-0.04, 0)*greatest(weight-0.04, 0)) FROM programs)/6, 9) AS collapse_penalty""", "programs", steps={
    **GRAM, "un2": "SELECT program_id, gene, sqrt(weight) / sqrt(sum(weight) OVER (PARTITION BY program_id)) AS u FROM programs"}))
def dictionary_drift(spark, sf):
    p = settle(V.programs(spark, sf))
    t = quality.dictionary_drift(p, p.withColumn("weight", F.sqrt("weight")), 0.04)
    return rounded(rounded(t, "drift"), "collapse_penalty", digits=9)


@query(V.oracle("""SELECT round((SELECT 100*avg(m) FROM (SELECT max(frac) AS m FROM fractions GROUP BY sample_id, cell_id)), 5) AS p_w,
    round((SELECT 100*avg(m) FROM (SELECT max(weight) AS m FROM programs GROUP BY program_id)), 5) AS g_w""", "fractions", "programs"))
def sharpness(spark, sf):
    return rounded(quality.sharpness(V.fractions(spark, sf), V.programs(spark, sf)), "p_w", "g_w", digits=5)


@query(V.oracle("""SELECT count(*) FILTER (WHERE coalesce(m, 0) < 2400) AS n_dead, count(*) AS n_programs FROM (SELECT DISTINCT program_id FROM programs)
    LEFT JOIN (SELECT program_id, sum(frac) AS m FROM fractions GROUP BY 1) USING (program_id)""", "fractions", "programs"))
def dead_programs(spark, sf):
    return quality.dead_programs(V.fractions(spark, sf), V.programs(spark, sf), 2400)


@query(V.oracle("SELECT round(100*sum(weight)/6, 5) AS core_mass FROM programs WHERE weight >= 0.04", "programs"))
def core_mass(spark, sf):
    p = settle(V.programs(spark, sf))
    return rounded(quality.core_mass(p, p.filter("weight >= 0.04")), "core_mass", digits=5)


@query()
def effective_rank(spark, sf):
    return spark.createDataFrame([(quality.effective_rank(V.programs(spark, sf)),)], "effective_rank double")


USAGE = {
    "nn": "SELECT count(*) AS n FROM cells", "kk": "SELECT count(DISTINCT program_id) AS k FROM fractions",
    "pm": "SELECT program_id, sum(frac)/any_value(n) AS p FROM fractions, nn GROUP BY 1",
    "tg": "SELECT program_id, p, greatest(2.0::DOUBLE/k - p, 1e-5) AS c FROM pm, kk",
    "us": """SELECT sum(-p*ln(p+1e-9)) AS e, sum(least(greatest(p,1e-5),1)*(ln(least(greatest(p,1e-5),1)+1e-9) - ln(greatest(c/s,1e-5)+1e-9))) AS kl
        FROM tg, (SELECT sum(c) AS s FROM tg)""",
    "full_f": """SELECT c.sample_id, c.cell_id, p.program_id, coalesce(frac, 0) AS f FROM cells c CROSS JOIN (SELECT DISTINCT program_id FROM fractions) p
        LEFT JOIN fractions fr ON fr.sample_id = c.sample_id AND fr.cell_id = c.cell_id AND fr.program_id = p.program_id""",
    "ts": "SELECT (1 - sum(pow(least(greatest(f, 1e-5), 1), 1.5))/any_value(n))/0.5 AS t FROM full_f, nn",
}


@query(V.oracle("""SELECT round(e, 6) AS usage_entropy, round(kl, 6) AS usage_kl, round(least(greatest(1 - e/ln(k), 0), 1), 6) AS collapse_ratio,
    round(t, 6) AS tsallis_entropy FROM us, kk, ts""", "fractions", steps=USAGE))
def usage_divergence(spark, sf):
    t = quality.usage(settle(V.fractions(spark, sf)), V.points(spark, sf).count())
    return rounded(t, "usage_entropy", "usage_kl", "collapse_ratio", "tsallis_entropy")


@query()
def program_quality_report(spark, sf):
    p = settle(V.programs(spark, sf))
    f = settle(V.fractions(spark, sf))
    e = V.expression25(spark, sf)
    return quality.quality_report(e, f, p, p.filter("weight >= 0.04"), V.points(spark, sf).count(), p.select("gene").distinct().count())


# trends

TREND = {
    "tw": """SELECT run_id, step, value, count(*) OVER w AS n, regr_slope(value, CAST(step AS DOUBLE)) OVER w AS b, avg(value) OVER w AS m,
        regr_syy(value, CAST(step AS DOUBLE)) OVER w AS syy, regr_sxy(value, CAST(step AS DOUBLE)) OVER w AS sxy FROM metrics
        WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "tr": """SELECT run_id, step, value, n, CASE WHEN n < 3 THEN 0 ELSE b END AS slope, CASE WHEN n < 3 THEN value ELSE m END AS mean,
        CASE WHEN n < 3 THEN 0.01 ELSE sqrt(greatest(0, syy - b*sxy)/greatest(1, n-2)) END AS residual_sd FROM tw""",
    "rb": "SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM tr",
}


@query(V.oracle("SELECT run_id, step, n, round(slope, 6) AS slope, round(mean, 6) AS mean, round(residual_sd, 5) AS residual_sd FROM tr", "metrics", steps=TREND))
def trend_window(spark, sf):
    t = rounded(trend.trend_window(V.metrics(spark, sf)).drop("value"), "slope", "mean")
    return rounded(t, "residual_sd", digits=5)


@query(V.oracle("""SELECT run_id, min(step) AS plateau_step FROM tr WHERE n >= 8 AND (step >= 20 OR -slope*8/greatest(1e-5, mean) < 0.008) GROUP BY 1""", "metrics", steps=TREND))
def plateau_detect(spark, sf):
    return trend.plateau_step(trend.trend_window(V.metrics(spark, sf)))


@query(V.oracle("""SELECT run_id, step, best, round(best + greatest(best*0.1, 2.5*residual_sd), 5) AS ceiling,
    value > best + greatest(best*0.1, 2.5*residual_sd) AS overshoot FROM rb""", "metrics", steps=TREND))
def running_best(spark, sf):
    t = trend.loss_ceiling(V.metrics(spark, sf))
    return rounded(t.select("run_id", "step", "best", "ceiling", "overshoot"), "ceiling", digits=5)


@query(V.oracle("""SELECT run_id, round(list_reduce(list(value ORDER BY step), lambda a, x: 0.9 * a + 0.1 * x), 6) AS ema FROM metrics
    WHERE step % 3 <> 1 GROUP BY 1""", "metrics"))
def ema(spark, sf):
    return rounded(trend.ema(V.metrics(spark, sf).filter("step % 3 <> 1"), 0.1), "ema")


@query(V.oracle("""SELECT run_id, arg_min(step, (score, step)) AS best_step, round(min(score), 6) AS best_score FROM
    (SELECT *, value / sqrt(greatest(1e-3, step % 100)/100) AS score FROM metrics WHERE step % 100 >= 40) GROUP BY 1""", "metrics"))
def pareto_score(spark, sf):
    t = trend.pareto_best(V.metrics(spark, sf), F.col("value"), (F.col("step") % 100).cast("double"), F.col("step") % 100 >= 40)
    return rounded(t, "best_score")


@query(V.oracle("SELECT run_id, max(step) AS steps, round(arg_max(value, step), 4) AS final_value FROM metrics GROUP BY 1", "metrics"))
def metrics_summary(spark, sf):
    return rounded(trend.last_scorecard(V.metrics(spark, sf)), "final_value", digits=4)


@query(V.oracle('SELECT run_id, step AS "Epoch", value AS train_loss, best AS val_loss FROM rb', "metrics", steps=TREND))
def metrics_history(spark, sf):
    t = trend.running_best(V.metrics(spark, sf))
    return t.select("run_id", F.col("step").alias("Epoch"), F.col("value").alias("train_loss"), F.col("best").alias("val_loss"))


# whole run


@query()
def run_cohort(spark, sf):
    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/cohort-{uuid.uuid4().hex}"
    # Rounds of the fits and permutations are those of the preset: with a few rounds the held-out loss is never judged.
    cfg = CohortConfig.for_mode("DISCOVERY", top_n_genes=60, n_dict_components=6, k_hops=1,
                                min_genes_noun=5, use_sketching=False, max_noun_overlap=0.7)
    t = cohort.run_cohort(spark, V.manifest(spark, sf), V.points(spark, sf), V.expression(spark, sf), out, V.signatures(spark, sf), cfg)
    return t["topology"].drop("Dataset")
