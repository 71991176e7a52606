"""SQL text shared by several oracles."""

from __future__ import annotations

LOGNORM = """SELECT sample_id, cell_id, gene, value,
    ln(1 + value * (1e4 / sum(value) OVER (PARTITION BY sample_id, cell_id))) AS lognorm FROM expression"""

SIZES = "SELECT sample_id, count(*) AS n_cells FROM cells GROUP BY 1"


def knn(k: int, cells: str = "cells") -> str:
    return f"""SELECT sample_id, src, dst, rn AS rank, sqrt(d2) AS dist FROM (
        SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d2,
            row_number() OVER (PARTITION BY a.sample_id, a.cell_id
                ORDER BY (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y), b.cell_id) AS rn
        FROM {cells} a JOIN {cells} b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id) WHERE rn <= {k}"""


def distinct_edges(source: str) -> str:
    return f"SELECT DISTINCT sample_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM {source}"


def moran(cells: str, expr: str, edges: str) -> dict[str, str]:
    """Steps that end in ``moran(sample_id, gene, moran)``."""
    return {
        "m_n": f"SELECT sample_id, count(*) AS n FROM {cells} GROUP BY 1",
        "m_e": f"SELECT sample_id, count(*) AS e FROM {edges} GROUP BY 1",
        "m_s": f"""SELECT sample_id, gene, sum(lognorm) AS sx, sum(lognorm*lognorm) AS sx2, sum(lognorm)/any_value(n) AS mean,
            any_value(n) AS n FROM {expr} JOIN m_n USING (sample_id) GROUP BY 1, 2""",
        "m_uv": f"""SELECT e.sample_id, a.gene, sum(a.lognorm*b.lognorm) AS uv FROM {edges} e
            JOIN {expr} a ON a.sample_id = e.sample_id AND a.cell_id = e.src
            JOIN {expr} b ON b.sample_id = e.sample_id AND b.cell_id = e.dst AND a.gene = b.gene GROUP BY 1, 2""",
        "m_deg": f"""SELECT sample_id, cell_id, count(*) AS deg FROM (SELECT sample_id, src AS cell_id FROM {edges}
            UNION ALL SELECT sample_id, dst FROM {edges}) GROUP BY 1, 2""",
        "m_w": f"""SELECT x.sample_id, gene, sum(lognorm*deg) AS sd FROM {expr} x JOIN m_deg USING (sample_id, cell_id) GROUP BY 1, 2""",
        "moran": """SELECT sample_id, gene, CASE WHEN coalesce(e, 0) = 0 THEN 0 ELSE (n/(e+1e-9)) *
            ((coalesce(uv,0) - mean*coalesce(sd,0) + e*mean*mean) / (sx2 - 2*mean*sx + n*mean*mean + 1e-9)) END AS moran
            FROM m_s LEFT JOIN m_uv USING (sample_id, gene) LEFT JOIN m_w USING (sample_id, gene) LEFT JOIN m_e USING (sample_id)""",
    }


def hvg(cells: str, expr: str) -> dict[str, str]:
    """Steps that end in ``hvg(sample_id, gene, bin, dispersion, hvg_score)``."""
    return {
        "h_n": f"SELECT sample_id, count(*) AS n FROM {cells} GROUP BY 1",
        "h_s": f"""SELECT sample_id, gene, sum(exp(lognorm)-1) AS sx, sum((exp(lognorm)-1)*(exp(lognorm)-1)) AS sx2, any_value(n) AS n
            FROM {expr} JOIN h_n USING (sample_id) GROUP BY 1, 2""",
        "h_v": """SELECT sample_id, gene, sx/n AS mean, (sx2 - sx*sx/n)/(n-1) AS var FROM h_s WHERE n > 1""",
        "h_d": """SELECT sample_id, gene, ln(var/mean) AS d, ln(1+mean) AS m FROM h_v WHERE var > 0 AND mean > 0""",
        "h_r": """SELECT *, min(m) OVER (PARTITION BY sample_id) AS lo, max(m) OVER (PARTITION BY sample_id) AS hi FROM h_d""",
        "h_b": """SELECT *, least(CASE WHEN hi > lo THEN least(floor((m-lo)/(hi-lo)*20), 20)+1 ELSE 1 END, 20) AS bin FROM h_r""",
        "hvg": """SELECT sample_id, gene, CAST(bin AS INTEGER) AS bin, d AS dispersion, CASE WHEN c = 1 THEN (d - 0)/d ELSE (d - a)/nullif(s, 0) END AS hvg_score
            FROM (SELECT *, count(*) OVER w AS c, avg(d) OVER w AS a, stddev_samp(d) OVER w AS s FROM h_b
                  WINDOW w AS (PARTITION BY sample_id, bin)) WHERE CASE WHEN c = 1 THEN d <> 0 ELSE s > 0 END""",
    }


def grid(x: str, lo: str, hi: str, n: str) -> str:
    """1-based bin, n+1 at the upper end, 1 on a flat axis."""
    return f"(CASE WHEN {hi} > {lo} THEN least(floor(({x}-{lo})/({hi}-{lo})*{n}), {n}) ELSE 0 END + 1)"


EXTENTS = """SELECT sample_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, count(*) AS n_cells
    FROM cells GROUP BY 1"""

TOPOLOGY = {
    "nn": "SELECT sample_id, min(sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))) AS dist FROM cells a JOIN cells b USING (sample_id) "
          "WHERE a.cell_id <> b.cell_id GROUP BY sample_id, a.cell_id",
    "rad": "SELECT sample_id, median(dist) * 3.33 AS r FROM nn GROUP BY 1",
    "pairs": """SELECT a.sample_id, a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b ON a.sample_id = b.sample_id
        AND a.cell_id < b.cell_id JOIN rad ON rad.sample_id = a.sample_id
        WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= r*r""",
    "ext": EXTENTS,
    "blk_n": "SELECT *, greatest(2, ceil(sqrt(greatest(2, floor(n_cells/200))))) AS nb FROM ext",
    "blk": f"""SELECT sample_id, cell_id, ({grid('x', 'xmin', 'xmax', 'nb')}-1)*(nb+1) + {grid('y', 'ymin', 'ymax', 'nb')} - 1 AS block
        FROM cells JOIN blk_n USING (sample_id)""",
    "adj": "SELECT sample_id, src, dst FROM pairs UNION ALL SELECT sample_id, dst, src FROM pairs",
    "inter": """SELECT a.sample_id, u.program_id AS i, v.program_id AS j, sum(u.frac*v.frac) AS value FROM adj a
        JOIN fractions u ON u.sample_id = a.sample_id AND u.cell_id = a.src
        JOIN fractions v ON v.sample_id = a.sample_id AND v.cell_id = a.dst GROUP BY 1, 2, 3""",
    "b_n": "SELECT sample_id, block, count(*) AS n FROM blk GROUP BY 1, 2",
    "b_m": """SELECT a.sample_id, s.block AS ba, d.block AS bb, count(*) AS m FROM adj a
        JOIN blk s ON s.sample_id = a.sample_id AND s.cell_id = a.src
        JOIN blk d ON d.sample_id = a.sample_id AND d.cell_id = a.dst GROUP BY 1, 2, 3""",
    "b_w": "SELECT f.sample_id, f.cell_id, program_id, frac, block FROM fractions f JOIN blk USING (sample_id, cell_id)",
    "b_s": "SELECT sample_id, block, program_id, sum(frac) AS s FROM b_w GROUP BY 1, 2, 3",
    "b_q": """SELECT a.sample_id, a.block, a.program_id AS i, b.program_id AS j, sum(a.frac*b.frac) AS q FROM b_w a
        JOIN b_w b ON a.sample_id = b.sample_id AND a.cell_id = b.cell_id GROUP BY 1, 2, 3, 4""",
    "nullmean": """SELECT sample_id, i, j, sum(e) AS expected FROM (
        SELECT m.sample_id, a.program_id AS i, b.program_id AS j, m*a.s/na.n*b.s/nb.n AS e FROM b_m m
            JOIN b_s a ON a.sample_id = m.sample_id AND a.block = ba JOIN b_s b ON b.sample_id = m.sample_id AND b.block = bb
            JOIN b_n na ON na.sample_id = m.sample_id AND na.block = ba JOIN b_n nb ON nb.sample_id = m.sample_id AND nb.block = bb
            WHERE ba <> bb
        UNION ALL
        SELECT m.sample_id, a.program_id, b.program_id, m*(a.s*b.s - coalesce(q, 0))/(n.n*(n.n-1)) FROM b_m m
            JOIN b_s a ON a.sample_id = m.sample_id AND a.block = ba JOIN b_s b ON b.sample_id = m.sample_id AND b.block = ba
            JOIN b_n n ON n.sample_id = m.sample_id AND n.block = ba
            LEFT JOIN b_q g ON g.sample_id = m.sample_id AND g.block = ba AND g.i = a.program_id AND g.j = b.program_id
            WHERE ba = bb AND n.n > 1) GROUP BY 1, 2, 3""",
    "mass": """SELECT sample_id, program_id, sum(frac)/any_value(n_cells) AS mass FROM fractions JOIN ext USING (sample_id) GROUP BY 1, 2""",
    "topo": """SELECT a.sample_id AS "Sample", dataset_id AS "Dataset", na.name || '<->' || nb.name AS "Interface",
            2*coalesce(value, 0) AS "Continuous_Observed", 2*coalesce(expected, 0) AS "Continuous_Expected_Mean",
            log2((2*coalesce(value,0)+1e-9)/(2*coalesce(expected,0)+1e-9)) AS "Log2_Enrichment", a.program_id AS i, b.program_id AS j
        FROM mass a JOIN mass b ON a.sample_id = b.sample_id AND a.program_id < b.program_id
        JOIN program_names na ON na.program_id = a.program_id JOIN program_names nb ON nb.program_id = b.program_id
        JOIN manifest m ON m.sample_id = a.sample_id
        LEFT JOIN inter o ON o.sample_id = a.sample_id AND o.i = a.program_id AND o.j = b.program_id
        LEFT JOIN nullmean e ON e.sample_id = a.sample_id AND e.i = a.program_id AND e.j = b.program_id
        WHERE a.mass > 0.01 AND b.mass > 0.01 AND a.sample_id IN (SELECT sample_id FROM ext WHERE n_cells >= 50)""",
}
TOPOLOGY_VIEWS = ("cells", "fractions", "program_names")


def t_p(t: str, n: str) -> str:
    """Two-sided Student-t p for whole degrees of freedom, by gamma-function coefficients."""
    th = f"atan(abs({t})/sqrt({n}))"
    odd = (f"2/pi()*({th} + sin({th})*cos({th})*coalesce(list_sum(list_transform(range(0, CAST(({n}-1)//2 AS BIGINT)), "
           f"lambda j: pow(cos({th}), 2*j)*exp(lgamma(j+1)+lgamma(1.5)-lgamma(j+1.5)))), 0))")
    even = (f"sin({th})*coalesce(list_sum(list_transform(range(0, CAST({n}//2 AS BIGINT)), "
            f"lambda j: pow(cos({th}), 2*j)*exp(lgamma(j+0.5)-lgamma(0.5)-lgamma(j+1)))), 0)")
    return f"greatest(1 - CASE WHEN {n} % 2 = 1 THEN {odd} ELSE {even} END, 0)"


META = {
    "pm": """SELECT "Sample" AS "Patient_ID", "Interface", avg("Continuous_Observed") AS "Continuous_Observed",
        avg("Continuous_Expected_Mean") AS "Continuous_Expected_Mean", avg("Log2_Enrichment") AS "Log2_Enrichment" FROM topo GROUP BY 1, 2""",
    "eff0": """SELECT "Interface", count(*) AS k, avg("Log2_Enrichment") AS effect, stddev_samp("Log2_Enrichment") AS sd FROM pm GROUP BY 1""",
    "eff1": """SELECT *, CASE WHEN k > 1 THEN sd/(sqrt(k)+1e-9) ELSE 0 END AS se FROM eff0""",
    "eff": f"""SELECT "Interface", k, effect, se, CASE WHEN k > 1 THEN {t_p('(effect/(se+1e-9))', '(k-1)')} ELSE 1 END AS p_value FROM eff1""",
    "fdr0": """SELECT *, row_number() OVER (ORDER BY p_value, "Interface") AS r, count(*) OVER () AS n FROM eff""",
    "fdr": """SELECT *, least(1, min(p_value*n/r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM fdr0""",
    "loo0": """SELECT a."Interface", a."Patient_ID", avg(b."Log2_Enrichment") AS m, stddev_samp(b."Log2_Enrichment") AS sd, count(*) AS c
        FROM pm a JOIN pm b ON a."Interface" = b."Interface" AND a."Patient_ID" <> b."Patient_ID" GROUP BY 1, 2""",
    "loo1": f"""SELECT l."Interface", count(*) FILTER (WHERE m*effect > 0 AND (c = 1 OR
            {t_p('(m/(l.sd/(sqrt(c)+1e-9)+1e-9))', '(c-1)')} < 0.05)) AS kept FROM loo0 l JOIN eff0 USING ("Interface") GROUP BY 1""",
    "loo": """SELECT "Interface", CASE WHEN k = 1 THEN '1/1' ELSE CAST(kept AS VARCHAR) || '/' || CAST(k AS VARCHAR) END AS "LOPO_Robustness"
        FROM eff0 LEFT JOIN loo1 USING ("Interface")""",
    "meta": """SELECT "Interface", round (effect, 3) AS "Pooled_Log2_Enrichment", round (se, 3) AS "Cross_Patient_SE",
        "LOPO_Robustness", round (q, 4) AS "FDR_q" FROM fdr JOIN loo USING ("Interface")""",
    "meta_pos": """SELECT program, row_number() OVER (ORDER BY CAST(regexp_extract(program, '^(\\d+)', 1) AS INTEGER), program) - 1 AS pos
        FROM (SELECT DISTINCT unnest(string_split("Interface", '<->')) AS program FROM meta)""",
}


def softmax(table: str, key: str, score: str, t: float, out: str, keep: str) -> str:
    return f"""SELECT {keep}, e / sum(e) OVER (PARTITION BY {key}) AS {out} FROM (SELECT *, exp({score}/{t} -
        max({score}/{t}) OVER (PARTITION BY {key})) AS e FROM {table})"""


def entmax(source: str, keys: str, alpha: float) -> dict[str, str]:
    """Steps over ``source(keys, s list)`` ending in ``ent(keys, p list)``."""
    a1, pw = alpha - 1.0, 1.0 / (alpha - 1.0)
    f = f"list_sum(list_transform(s, lambda x: pow(greatest({a1}::DOUBLE*(x-(lo+hi)/2), 0), {pw}::DOUBLE)))"
    return {
        "rec_ent": f"""SELECT {keys}, s, list_max(s) - {1.0 / a1}::DOUBLE AS lo, list_max(s) AS hi, 0 AS step FROM {source}
            UNION ALL SELECT {keys}, s, CASE WHEN f < 1 THEN lo ELSE (lo+hi)/2 END, CASE WHEN f < 1 THEN (lo+hi)/2 ELSE hi END, step+1
            FROM (SELECT *, {f} AS f FROM rec_ent WHERE step < 25)""",
        "ent_v": f"""SELECT {keys}, list_transform(s, lambda x: pow(greatest({a1}::DOUBLE*(x-(lo+hi)/2), 0), {pw}::DOUBLE)) AS v
            FROM rec_ent WHERE step = 25""",
        "ent": f"SELECT {keys}, list_transform(v, lambda q: q/(list_sum(v)+1e-9)) AS p FROM ent_v",
    }
