"""Fixture views: the shapes the engine works on, derived from the given tables.

Every view exists twice, as a DataFrame and as SQL text, so each registered query
can be checked against an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweft.operators.ordering import bucketed_rank


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def manifest(spark, sf):
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region", "r_regionkey", "r_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_name").alias("sample_id"), F.col("r_name").alias("dataset_id"),
                     F.col("n_name").alias("patient_id"), (F.col("n_nationkey") % 2 == 0).alias("discovery"),
                     F.lit(True).alias("projection"), "n_nationkey"))


def cells(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    m = manifest(spark, sf)
    return (o.join(c, o.o_custkey == c.c_custkey).join(m, c.c_nationkey == m.n_nationkey)
             .select("sample_id", "dataset_id", F.col("o_orderkey").alias("cell_id"),
                     (F.col("o_totalprice") / 1000).alias("x"),
                     F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("double").alias("y")))


def points(spark, sf):
    return cells(spark, sf).drop("dataset_id")


def _counts(spark, sf, gene, keep):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf, "part", "p_partkey", *keep)
    per = (li.join(p, li.l_partkey == p.p_partkey)
             .groupBy(F.col("l_orderkey").alias("cell_id"), gene.alias("gene")).agg(F.sum("l_quantity").alias("value")))
    return per.join(cells(spark, sf).select("sample_id", "cell_id"), "cell_id").select("sample_id", "cell_id", "gene", "value")


def expression(spark, sf):
    gene = F.concat(F.upper("p_type"), F.lit("-"), F.regexp_replace("p_brand", "Brand#", "B"))
    return _counts(spark, sf, gene, ["p_type", "p_brand"])


def expression6(spark, sf):
    return _counts(spark, sf, F.upper("p_type"), ["p_type"])


def expression25(spark, sf):
    return _counts(spark, sf, F.col("p_brand"), ["p_brand"])


def program_ids(spark, sf):
    types = table(spark, sf, "part", "p_type").select(F.upper("p_type").alias("gene")).distinct()
    return types.select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).alias("program_id"))


def fractions(spark, sf):
    e = expression6(spark, sf).join(program_ids(spark, sf), "gene")
    total = F.sum("value").over(Window.partitionBy("sample_id", "cell_id"))
    return e.select("sample_id", "cell_id", "program_id", (F.col("value") / total).alias("frac"))


def programs(spark, sf):
    li = table(spark, sf, "lineitem", "l_partkey", "l_quantity")
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_brand")
    q = (li.join(p, li.l_partkey == p.p_partkey).groupBy(F.upper("p_type").alias("t"), F.col("p_brand").alias("gene"))
           .agg(F.sum("l_quantity").alias("q")))
    q = q.join(program_ids(spark, sf).withColumnRenamed("gene", "t"), "t")
    return q.select("program_id", "gene", (F.col("q") / F.sum("q").over(Window.partitionBy("program_id"))).alias("weight"))


def program_names(spark, sf):
    return program_ids(spark, sf).select("program_id", F.concat((F.col("program_id") + 1).cast("string"),
                                                                F.lit("_"), "gene").alias("name"))


def signatures(spark, sf):
    li = table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, sf, "part", "p_partkey", "p_type", "p_brand")
    gene = F.concat(F.upper("p_type"), F.lit("-"), F.regexp_replace("p_brand", "Brand#", "B"))
    return (li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_suppkey").alias("lineage"), gene.alias("gene"))
              .agg(F.sum("l_quantity").alias("q")).filter("q >= 150").select("lineage", "gene"))


def common_genes(spark, sf):
    """Genes that more than an average number of lineages list."""
    n = signatures(spark, sf).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))
    return n.filter("n >= 22").select("gene")


def dense_cells(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("label").cast("string").alias("sample_id"), F.col("vec_id").alias("cell_id"),
                    F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
                    F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def dense_expression(spark, sf):
    return (dense_cells(spark, sf).select("sample_id", "cell_id", F.posexplode("vec").alias("g", "value"))
            .select("sample_id", "cell_id", F.concat(F.lit("G"), F.lpad("g", 2, "0")).alias("gene"),
                    F.abs("value").alias("value")))


def doc_terms(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "source", "text")
    return (d.select("doc_id", "source", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("gene"))
             .filter("gene <> ''").groupBy(F.col("source").alias("sample_id"), F.col("doc_id").alias("cell_id"), "gene")
             .agg(F.count(F.lit(1)).cast("double").alias("value")))


def metrics(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "value")
    day = F.floor(F.unix_timestamp("ts") / 86400)
    ranked = bucketed_rank(e.withColumn("_day", day), ["user_id"], ["_day"], [F.col("ts"), F.col("event_id")], "rn")
    return ranked.select(F.col("user_id").alias("run_id"), (F.col("rn") - 1).alias("step"), "value")


GENE150 = "upper(p_type) || '-' || replace(p_brand, 'Brand#', 'B')"

SQL = {
    "manifest": """SELECT n_name AS sample_id, r_name AS dataset_id, n_name AS patient_id,
        n_nationkey % 2 = 0 AS discovery, true AS projection, n_nationkey
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cells": """SELECT sample_id, dataset_id, o_orderkey AS cell_id, o_totalprice / 1000 AS x,
        CAST(date_diff('day', date '1970-01-01', CAST(o_orderdate AS date)) AS DOUBLE) AS y
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN manifest ON c_nationkey = n_nationkey""",
    "expression": f"""SELECT sample_id, cell_id, {GENE150} AS gene, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cells ON l_orderkey = cell_id GROUP BY ALL""",
    "expression6": """SELECT sample_id, cell_id, upper(p_type) AS gene, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cells ON l_orderkey = cell_id GROUP BY ALL""",
    "expression25": """SELECT sample_id, cell_id, p_brand AS gene, sum(l_quantity) AS value
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN cells ON l_orderkey = cell_id GROUP BY ALL""",
    "program_ids": """SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS program_id
        FROM (SELECT DISTINCT upper(p_type) AS gene FROM part)""",
    "fractions": """SELECT sample_id, cell_id, program_id,
        value / sum(value) OVER (PARTITION BY sample_id, cell_id) AS frac
        FROM expression6 JOIN program_ids USING (gene)""",
    "programs": """SELECT program_id, q.gene, q / sum(q) OVER (PARTITION BY program_id) AS weight
        FROM (SELECT upper(p_type) AS t, p_brand AS gene, sum(l_quantity) AS q
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) q
        JOIN program_ids i ON i.gene = q.t""",
    "program_names": """SELECT program_id, CAST(program_id + 1 AS VARCHAR) || '_' || gene AS name FROM program_ids""",
    "signatures": f"""SELECT l_suppkey AS lineage, {GENE150} AS gene FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY ALL HAVING sum(l_quantity) >= 150""",
    "common_genes": "SELECT gene FROM signatures GROUP BY 1 HAVING count(*) >= 22",
    "dense_cells": """SELECT CAST(label AS VARCHAR) AS sample_id, vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x,
        CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
    "dense_expression": """SELECT sample_id, cell_id, 'G' || lpad(CAST(g AS VARCHAR), 2, '0') AS gene, abs(v) AS value
        FROM (SELECT sample_id, cell_id, unnest(vec) AS v, unnest(range(len(vec))) AS g FROM dense_cells)""",
    "doc_terms": """SELECT source AS sample_id, doc_id AS cell_id, gene, CAST(count(*) AS DOUBLE) AS value
        FROM (SELECT source, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS gene FROM documents)
        WHERE gene <> '' GROUP BY ALL""",
    "metrics": """SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value
        FROM events""",
}

NEEDS = {
    "cells": ["manifest"], "expression": ["cells"], "expression6": ["cells"], "expression25": ["cells"],
    "fractions": ["expression6", "program_ids"], "programs": ["program_ids"], "program_names": ["program_ids"],
    "dense_expression": ["dense_cells"], "common_genes": ["signatures"],
}


def oracle(body: str, *views: str, steps: dict[str, str] | None = None) -> str:
    """A full query: fixture views as CTEs, then named steps, then the body."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for v in views:
        add(v)
    ctes = [f"{v} AS MATERIALIZED ({SQL[v]})" for v in done]
    ctes += [f"{n} AS {'' if n.startswith('rec_') else 'MATERIALIZED '}({q})" for n, q in (steps or {}).items()]
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body
