"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import duckdb
import plain_versions as plain
import pytest
from check import TABLES, canonical
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cellweft.llm import queries
from cellweft.llm.quality import signature_quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert repr(canonical(got)) == repr(canonical(want))


@pytest.mark.parametrize("name", ["op1_personal_identifiers", "op3_repeated_passages"])
def test_query_matches_plain_version(spark, name):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES[name](spark, SF)
    if name.startswith("op3"):
        assert sorted(map(tuple, got.collect())) == sorted(plain.cut(docs))
    else:
        assert {r.doc_id: r.base_sha256 for r in got.collect()} == {i: plain.sha(",".join(plain.base_spans(t))) for i, t in docs}


def test_stages(spark):
    """Each stage keeps what a plain version of it keeps, on all that came before."""
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    scored = signature_quality(queries.as_signatures(docs), queries.learning_labels(queries.table(spark, SF, "labels"))).collect()
    first = pipeline.keep(pipeline.drop_low_quality(spark, docs, SF))
    assert first.columns == columns
    assert {r.doc_id for r in first.collect()} == {r.lineage for r in scored if r.score >= 0.3}

    second = pipeline.keep(pipeline.drop_near_duplicates(spark, first, SF))
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, _, _, kept in plain.near(rows) if kept)

    third = pipeline.keep(pipeline.drop_contaminated(spark, second, SF))
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(r.doc_id for r in third.collect()) == sorted(r[0] for r in plain.shared(rows, items) if not r[5])

    fourth = pipeline.keep(pipeline.mix_sources(spark, third, SF))
    assert fourth.columns == columns and fourth.dtypes == third.dtypes
    words = lambda t: plain.WORD.findall(t or "")
    mixed = {r.cell_id: r.taken for r in queries.mix_datasets(queries.as_cells(third, queries.table(spark, SF, "labels"))).collect()}
    given = {r.doc_id: r.text for r in third.collect()}
    taken = {}
    for r in fourth.collect():
        assert words(r.text) == words(given[r.doc_id])[:len(words(r.text))]
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    assert taken == {k: v for k, v in mixed.items() if v}

    last = pipeline.write_tokens(spark, fourth, SF).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id for r in last} == set(taken)


def test_stages_handle_odd_rows(spark):
    """Null ids, texts and sources, repeated rows and no rows at all."""
    schema = queries.table(spark, SF, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, "s", 0), (-2, "word " * 30, "en", None, 150), (-2, "word " * 30, "en", None, 150)], schema)
    for rows in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, rows, SF).count() >= 0


def test_rejected_rows_go_and_others_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "doc_id long, text string")
    outcome = spark.createDataFrame([(1, True), (2, False), (None, False)], "lineage long, gone boolean")
    assert {r.text for r in pipeline.without(docs, outcome, F.col("gone")).collect()} == {"b", "c", "d"}


def test_rows_without_an_id_and_repeated_ids_are_judged_each(spark, monkeypatch):
    """Null and repeated ids, rejected rows next to clean ones, and repeated rows, in each stage."""
    schema = queries.table(spark, SF, "documents").schema
    frame = lambda rows: spark.createDataFrame([tuple({"doc_id": i, "text": t, "source": "s"}.get(c) for c in schema.names) for i, t in rows], schema)
    texts = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    a, b, c = words("a", 30), words("b", 30), words("c", 30)

    item = queries.table(spark, SF, "benchmark").filter("length(text) > 200").first().text
    got = pipeline.drop_contaminated(spark, frame([(None, item), (None, a), (7, item), (7, b), (8, c), (8, c)]), SF)
    assert texts(got) == [(0, a), (7, b), (8, c), (8, c)]

    got = pipeline.drop_near_duplicates(spark, frame([(None, a), (None, b), (5, a), (7, c), (7, c), (4, words("d", 30)), (7, words("d", 30)), (None, ""), (None, "")]), SF)
    assert texts(got) == sorted([(0, b), (0, ""), (0, ""), (4, words("d", 30)), (5, a), (7, c)])

    def scores(signatures, labels, carry=(), **more):
        return signatures.select("lineage", *carry, F.lit(0.5).alias("score"), F.when(F.col("genes").startswith("a"), 0).otherwise(1).alias("predicted"))
    monkeypatch.setattr(pipeline, "signature_quality", scores)
    assert texts(pipeline.drop_low_quality(spark, frame([(None, a), (None, b), (7, a), (7, c)]), SF)) == [(0, b), (7, c)]

    rows = frame([(None, words("e", 10)), (None, words("f", 90)), (9, words("g", 5)), (9, words("h", 60)), (9, words("h", 60)), (10, words("k", 33))])
    mixed = queries.mix_datasets(queries.as_cells(rows, queries.table(spark, SF, "labels"))).agg(F.sum("taken")).first()[0]
    assert sum(len(t.split()) for _, t in texts(pipeline.mix_sources(spark, rows, SF))) == mixed


def test_names_of_rows_do_not_follow_splits(spark):
    """A row has one name, read in one split or in many: executors that come or go change the splits."""
    docs = pipeline.keep(queries.table(spark, SF, "documents").repartition(3))

    def named(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows, row = pipeline.numbered(docs)
        return sorted((r[0], r[1]) for r in rows.select("doc_id", row).collect())

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        few, many = named("128m"), named("20k")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert few == many and len({name for _, name in few}) == len(few) > 0


def test_columns_with_the_names_that_stages_use(spark):
    docs = queries.table(spark, SF, "documents").limit(12).withColumns({n: F.lit(n) for n in ("_row", "_size", "_taken", "_time", "_gone", "place", "label")})
    for stage in (pipeline.drop_near_duplicates, pipeline.drop_contaminated, pipeline.mix_sources):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert {(r["_row"], r["_size"], r["_taken"], r["_time"], r["place"]) for r in got.collect()} <= {("_row", "_size", "_taken", "_time", "place")}
