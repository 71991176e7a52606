"""One query for each operator: it maps the given tables to the operator's records and the result back. SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm.common import SPACE, WORD
from cellweft.llm.contamination import shared_with_projection
from cellweft.llm.exact import equal_signatures
from cellweft.llm.identifiers import personal_identifiers
from cellweft.llm.language import score_signatures
from cellweft.llm.licences import file_licences
from cellweft.llm.mixing import mix_datasets
from cellweft.llm.near import near_signatures
from cellweft.llm.passages import cut_repeated_passages
from cellweft.llm.quality import signature_quality
from cellweft.llm.repeats import longest_run, repeated_gene_runs
from cellweft.llm.similar import most_similar_cells
from cellweft.llm.spelling import gene_spelling_variants
from cellweft.llm.training_order import write_training_order
from cellweft.session import ensure_checkpoint_dir

#: Place of the public vocabulary; the same on all machines.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_signatures(docs: DataFrame, *more: Column) -> DataFrame:
    """Documents as signature rows."""
    return docs.select(F.col("doc_id").alias("lineage"), F.col("text").alias("genes"), *more)


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def learning_labels(labels: DataFrame) -> DataFrame:
    """Quality labels that may be learnt from: those of rows that are not held out."""
    return labels.filter(remainder(5) != 0).select(F.col("doc_id").alias("lineage"), F.col("quality").alias("label"))


def as_cells(docs: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Documents as cells: their words are the total, their source the dataset; labelled quality makes them likelier or less likely."""
    graded = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("total"), *more)
    return sized.join(graded, "doc_id", "left").select(F.col("source").alias("dataset_id"), F.col("doc_id").alias("cell_id"), "total", weight.alias("weight"), *more)


def shard_folder(spark: SparkSession) -> str:
    """A new folder in the place that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/training-order-{uuid.uuid4().hex}"


def op1_personal_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("filepath"))
    return personal_identifiers(docs).withColumnRenamed("sample_id", "doc_id")


def op2_near_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_signatures(as_signatures(table(spark, sf_dir, "documents"))).withColumnRenamed("lineage", "doc_id")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeated_passages(as_signatures(table(spark, sf_dir, "documents"))).withColumnRenamed("lineage", "doc_id")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = write_training_order(as_signatures(table(spark, sf_dir, "documents")), VOCABULARY, shard_folder(spark))
    return placed.withColumnRenamed("lineage", "doc_id")


def op5_signature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = signature_quality(as_signatures(table(spark, sf_dir, "documents")), learning_labels(table(spark, sf_dir, "labels")))
    return scored.withColumnRenamed("lineage", "doc_id").select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_mix_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_datasets(as_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return mixed.select(F.col("cell_id").alias("doc_id"), F.col("total").alias("size"), "source_size", "target", "taken")


def op7_shared_with_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("lineage"), F.col("text").alias("genes"))
    return shared_with_projection(as_signatures(table(spark, sf_dir, "documents")), items).withColumnRenamed("lineage", "doc_id")


def op8_score_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_signatures(as_signatures(docs, (remainder(7) != 2).alias("is_train")))
    return scored.withColumnRenamed("lineage", "doc_id").select(
        "doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_equal_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = equal_signatures(as_signatures(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("lineage", "doc_id").withColumnRenamed("keep_lineage", "keep_id")


def op10_file_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), path.alias("filepath"), F.col("text").alias("header"))
    found = file_licences(files).withColumn("similarity", F.round("similarity", 6))
    return found.withColumnRenamed("sample_id", "doc_id")


def op11_most_similar_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("sample_id"), F.col("vec_id").alias("cell_id"), F.col("embedding").alias("vec"))
    found = most_similar_cells(cells, F.col("cell_id") % 50 == 0)
    return found.select(F.col("cell_id").alias("query_id"), "rank", F.col("like_cell_id").alias("vec_id"), "score")


def with_repeats(docs: DataFrame) -> DataFrame:
    """One document in ten with its words from some place on replaced by repeats of the first of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    n, g = F.size("_w"), F.col("_g")
    docs = docs.withColumn("_a", F.when(n > 0, F.pmod(g, n))).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    repeated = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")) + 1).cast("int"))))
    return docs.select("doc_id", F.when(F.size("_w") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_repeated_gene_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_gene_runs(as_signatures(with_repeats(table(spark, sf_dir, "documents"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", longest_run())
    return best.select(F.col("lineage").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
                       F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
                       F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def misspelt_names(docs: DataFrame) -> DataFrame:
    """Runs of Latin letters as gene names, in ASCII lower case; one in 97 of a document's words lacks a letter."""
    word = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z\u00C0-\u00FF]+)"), F.lit(1)))
    low = F.translate("_w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select("doc_id", word.alias("_w")).select("doc_id", low.alias("_w"))
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "_w"))
    at = F.pmod(h, F.length("_w")).cast("int")
    less = F.concat(F.substring("_w", F.lit(1), at), F.substring("_w", at + 2, F.length("_w")))
    return words.select(F.when(h % 97 == 0, less).otherwise(F.col("_w")).alias("gene"), F.lit(1).alias("n"))


def op13_gene_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gene_spelling_variants(misspelt_names(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("gene", "word")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_personal_identifiers, op2_near_signatures, op3_repeated_passages, op4_training_order, op5_signature_quality,
                            op6_mix_datasets, op7_shared_with_projection, op8_score_signatures, op9_equal_signatures, op10_file_licences, op11_most_similar_cells,
                            op12_repeated_gene_runs, op13_gene_spelling_variants)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda x: x <> '')"
_KEPT_CASE = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
_ALNUM = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _crc32(text: str) -> str:
    """The crc32 of an ASCII or Latin-1 text by its definition, bit by bit; code points from 128 on are two bytes of UTF-8."""
    code = "lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)::UBIGINT] ELSE [(192 + (ord(s) >> 6))::UBIGINT, (128 + (ord(s) & 63))::UBIGINT] END"
    step = "list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({text}, ''), {code}))), lambda c, b: {step}), 4294967295::UBIGINT)::BIGINT"


ORACLES = {
    "op2_near_signatures": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM g LEFT JOIN n USING (doc_id)""",
    "op6_mix_datasets": f"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
d AS (SELECT doc_id, source, len({_WORDS}) AS size, CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight,
      (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE AS u
      FROM documents LEFT JOIN q USING (doc_id)),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
b AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS share FROM a),
c AS (SELECT *, 2.0::DOUBLE * source_size / share AS level FROM b),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY level, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY level, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fair FROM c),
h AS (SELECT fair FROM f WHERE level > fair ORDER BY level, fair DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level > h.fair THEN h.fair * share ELSE 2.0::DOUBLE * source_size END AS target FROM f LEFT JOIN h ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size) AS budget,
      coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, u, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(budget - before, 0)))::BIGINT AS taken FROM k""",
    "op7_shared_with_projection": f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT d.doc_id, d.w, z.n, unnest(range(1, len(w) - z.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM i) z WHERE len(w) >= z.n)),
h AS (SELECT DISTINCT doc_id, i.item_id, x.i, x.n FROM x JOIN i ON x.n = i.n AND x.s = i.s),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op9_equal_signatures": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept,
    sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t ORDER BY length(text) DESC, doc_id)""",
    "op11_most_similar_cells": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op12_repeated_gene_runs": f"""
WITH o AS (SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h, {_KEPT_CASE} AS w FROM documents),
o2 AS (SELECT *, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
o3 AS (SELECT *, 1 + (len(w) - a) // (3 + g % 8) AS p FROM o2),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM o3),
x AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) AS i FROM d WHERE len(w) >= 12)),
m AS (SELECT a.doc_id, a.i - b.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.s = b.s AND b.i < a.i),
t AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
f AS (SELECT doc_id, q, min(i) - q AS s, max(i) + 6 AS e FROM t GROUP BY doc_id, q, k),
r AS (SELECT doc_id, s, e - s AS n, min(q) AS q FROM f WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e),
c AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, n := n, q := q), struct_pack(n := -n, s := s, q := q)) AS best,
    string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs, flatten(list(range(s + q, s + n))) AS gone FROM r GROUP BY 1),
j AS (SELECT doc_id, array_to_string(CASE WHEN n_runs IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(len(w))), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ') AS collapsed
    FROM (SELECT doc_id, w, n_runs, list_distinct(gone) AS gone FROM d LEFT JOIN c USING (doc_id)))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
    sha256(coalesce(runs, '')) AS runs_sha256, sha256(collapsed) AS collapsed_sha256 FROM d LEFT JOIN c USING (doc_id) JOIN j USING (doc_id)""",
    "op13_gene_spelling_variants": f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS t FROM documents),
e AS (SELECT doc_id, t, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT t, n, {_crc32("(coalesce(doc_id::VARCHAR || ':', '') || t)")} AS h FROM e),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(t, h % length(t)) || substr(t, h % length(t) + 2) ELSE t END AS word, n FROM h)
      GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
x AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
l AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.rest = b.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, struct_pack(n := -n, w := near)) AS near, max(n) AS near_n FROM l GROUP BY 1),
f AS MATERIALIZED (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
g AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word)""",
}
