"""Exact and near duplicates, repeated passages and shared passages against plain versions."""

import random

import plain_versions as plain
import pytest
from pyspark.sql import functions as F

from cellweft.llm import near, passages
from cellweft.llm.contamination import shared_with_projection
from cellweft.llm.exact import equal_signatures
from cellweft.llm.linking import connected
from cellweft.llm.near import near_signatures
from cellweft.llm.passages import cut_repeated_passages
from cellweft.llm.queries import QUERIES

GENES = ["CD8A", "sox2", "ACTA2", "Vim,", "ñandú", "EPCAM", "MKI67", "KRT5", "PECAM1", "cd4", "Foxp3", "GZMB", "LUM", "DCN", "ßeta"]
SCHEMA = "lineage long, genes string, row string, node int, _text string, keys int"


def rows_of(spark, rows):
    """Signature rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(a, b, "x", 1, None, 2) for a, b in rows], SCHEMA)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sentence(rng, n):
    return " ".join(rng.choice(GENES) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats in one text, short, empty, null and very long texts, repeated rows."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 4, 5, 6, 40, 120, 300)]
    rows = list(enumerate([*base, None, "", "   \n\t", "CD8A", "cd8a", "CD8A\v"]))
    for text in base[3:]:
        words = text.split(" ")
        for share in (0.01, 0.03, 0.05, 0.2):
            edited = [rng.choice(GENES) if rng.random() < share else w for w in words]
            rows.append((len(rows), " ".join(edited)))
        rows.append((len(rows), text.replace(" ", "\n")))
        rows.append((len(rows), text.upper() + "\t"))
    passage = sentence(rng, 90)
    for i in range(12):
        rows.append((len(rows), sentence(rng, 10 * i) + " " + passage + " " + sentence(rng, 7 * i)))
    rows.append((len(rows), passage + " " + passage))
    rows.append((len(rows), "A" * 3000))
    rows.append((len(rows), "ab" * 700 + "é" * 500))
    rows.append((len(rows), sentence(rng, 20_000)))
    return rows + [rows[5], rows[6], (None, base[5]), (None, "alone in its text"), (None, None), (-3, passage)]


def test_equal_signatures(spark, texts):
    got = listed(equal_signatures(rows_of(spark, texts), digit=4, growth=3), "lineage", "keep_lineage", "group_size", "kept", "text_sha256")
    assert got == sorted(plain.equal(texts), key=repr)


def test_near_signatures(spark, texts):
    got = listed(near_signatures(rows_of(spark, texts)), "lineage", "n_shingles", "component_id", "kept")
    assert got == sorted(plain.near(texts), key=repr)


def test_near_signatures_in_crowds(spark, monkeypatch):
    """Many copies of one text, some far from it: the same groups, with tables and groups cut into small blocks."""
    monkeypatch.setattr(near, "BLOCK", 7)
    rng = random.Random(11)
    base = [sentence(rng, 1) for _ in range(150)]
    rows = []
    for i in range(160):
        share = rng.choice([0.005, 0.01, 0.02, 0.04, 0.06, 0.09])
        rows.append((i, " ".join(sentence(rng, 1) if rng.random() < share else w for w in base)))
    got = listed(near_signatures(rows_of(spark, rows)), "lineage", "n_shingles", "component_id", "kept")
    assert got == sorted(plain.near(rows), key=repr)
    assert len({r[2] for r in got}) > 5


def test_near_signatures_over_bridges(spark):
    """Two close pairs with a single link at the limit between them: it is no best partner, and marks of unequal keys agree by chance."""
    words = lambda i, kind, n: [f"{kind}{i}_{j}" for j in range(n)]
    rows = []
    for i in range(1200):
        a = words(i, "a", 200)
        b = a[:173] + words(i, "b", 27)
        for text in (a, words(i, "c", 4) + a[4:], b, words(i, "d", 5) + b[5:]):
            rows.append((len(rows), " ".join(text)))
    got = {r.lineage: r.component_id for r in near_signatures(rows_of(spark, rows)).collect()}
    assert [k for k, v in sorted(got.items()) if v != k - k % 4] == []


def test_near_signatures_of_unlinked_crowds(spark, monkeypatch):
    """Texts that are all alike, few of them linked: written rows grow as the texts do, and candidates don't become rows."""
    rng, written = random.Random(4), {}

    def crowd(n):
        base = [f"g{i}" for i in range(400)]
        for i in range(n):
            words = list(base)
            for j in rng.sample(range(400), 16):
                words[j] = f"v{i}_{j}"
            yield i, " ".join(words)
        yield n, " ".join(base)

    rows = {n: list(crowd(n)) for n in (120, 240)}
    plain_keep = near.keep
    for n, texts in rows.items():
        sizes = written[n] = []

        def counted(df, *more, sizes=sizes):
            table = plain_keep(df, *more)
            sizes.append(table.count())
            return table

        monkeypatch.setattr(near, "keep", counted)
        got = listed(near_signatures(rows_of(spark, texts)), "lineage", "n_shingles", "component_id", "kept")
        assert got == sorted(plain.near(texts), key=repr)
    assert sum(written[240]) < 2.6 * sum(written[120])


def test_near_signatures_without_names(spark):
    """A third of all rows have no lineage: each text is judged by itself, and texts are read again once each."""
    rng = random.Random(8)
    rows = []
    for i in range(90):
        words = sentence(rng, 60).split(" ")
        rows += [(None, " ".join(words)), (3 * i, " ".join(words[1:])), (3 * i + 1, sentence(rng, 60))]
    rows += [(None, "one text without a name " * 3)] * 40
    got = listed(near_signatures(rows_of(spark, rows)), "lineage", "n_shingles", "component_id", "kept")
    assert got == sorted(plain.near(rows), key=repr)


def test_near_signatures_find_links_at_the_limit(spark):
    """Of 1 500 pairs, all 1 200 of similarity 0.75 to 0.79 are found."""
    rows = []
    for i in range(1500):
        a = [f"a{i}_{j}" for j in range(154)]
        n = 22 - i % 5
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:150 - n + 4] + [f"b{i}_{j}" for j in range(n)]))]
    got = {r.lineage: r.component_id for r in near_signatures(rows_of(spark, rows)).collect()}
    near_pairs = [k for k in range(0, 3000, 2) if 100 * (150 - (22 - k // 2 % 5)) >= 75 * (150 + (22 - k // 2 % 5))]
    missed = [k for k in near_pairs if got[k + 1] != k]
    assert len(near_pairs) == 1200 and not missed


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7), (300, 300)]
    got = {r.node: r.group for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 140), 200]}, 300: 300}


@pytest.mark.parametrize("batches", [1, 4])
def test_cut_repeated_passages(spark, texts, batches):
    got = listed(cut_repeated_passages(rows_of(spark, texts), batches), "lineage", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(plain.cut(texts), key=repr)


def test_query_of_repeated_passages(spark):
    folder = "/root/testdata/sf0.001"
    documents = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = listed(QUERIES["op3_repeated_passages"](spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(plain.cut(documents), key=repr) and any(row[2] for row in got)


def test_repeated_passages_split_a_crowded_surrounding(spark, texts, monkeypatch):
    """Texts of one repeated byte: nearly all rows have one ``hull``; Spark deals them to several tasks of the join."""
    plans, write = [], passages.keep

    def keep(df):
        if "open" in df.columns:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(passages, "keep", keep)
    small = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "8", "files.openCostInBytes": "1k", "files.maxPartitionBytes": "4k",
             "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k",
             "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in small}
    rows = texts[:40] + [(1000 + i, "A" * 1500) for i in range(24)]
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = listed(cut_repeated_passages(rows_of(spark, rows), 1), "lineage", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert got == sorted(plain.cut(rows), key=repr)
    assert len(plans) == 1 and "SortMergeJoin(skew=true)" in plans[0]


def test_shared_with_projection(spark, texts):
    rng = random.Random(3)
    words = texts[6][1].split(" ")
    items = [(1, " ".join(words[20:60])), (2, "x " * 4 + " ".join(words[100:109]) + " y"), (10, " ".join(words[5:14])), (11, "cd8a"), (12, None), (13, "--"),
             (None, " ".join(words[200:212])), (1, " ".join(words[250:280])), (14, sentence(rng, 30)), (15, "CD8A"), (16, "ñandú1 " * 3)]
    got = listed(shared_with_projection(rows_of(spark, texts), rows_of(spark, items)),
                 "lineage", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(plain.shared(texts, items), key=repr)


def test_empty_tables(spark, texts):
    none, some = rows_of(spark, []), rows_of(spark, texts[:6])
    for operator in (equal_signatures, near_signatures, cut_repeated_passages):
        assert operator(none).count() == 0
    assert shared_with_projection(none, some).count() == 0
    assert shared_with_projection(some, none).filter("contaminated").count() == 0


def test_names_of_any_type(spark, texts):
    named = rows_of(spark, texts[:25]).withColumn("lineage", F.format_string("T cell %03d", "lineage"))
    want = {f"T cell {a:03d}": f"T cell {b:03d}" for a, _, b, _ in plain.near(texts[:25])}
    assert {r.lineage: r.component_id for r in near_signatures(named).collect()} == want
