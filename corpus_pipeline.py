"""A training corpus from raw documents: quality, near duplicates, benchmark passages, mixing, token shards.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. Stages that need it name each row by its place
in its file, and outcomes hold for a row by that name: rows with no id or a repeated one are judged each on its own. Stages return
the columns they were given, whatever further ones there are; the last returns where each document's tokens are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.llm.common import SPACE, drop_table, keep
from cellweft.llm.contamination import shared_with_projection
from cellweft.llm.mixing import mix_datasets
from cellweft.llm.near import near_signatures
from cellweft.llm.quality import signature_quality
from cellweft.llm.queries import VOCABULARY, as_cells, as_signatures, learning_labels, shard_folder, table
from cellweft.llm.training_order import write_training_order


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of ``docs`` has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column that names each row, and that column's name.

    The name is the row's file and its place there, so it stays the same however often the table is read, in whatever splits and by however
    many executors. A table that doesn't lie in Parquet files as it is gets written once.
    """
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    stored = docs if plan.startswith("Relation [") and plan.endswith("parquet") else keep(docs)
    row, place = unused(docs, "_row")[0], stored.metadataColumn("_metadata")
    name = F.concat_ws(":", F.hex(F.xxhash64(place["file_path"])), place["row_index"].cast("string"))
    return stored.select("*", name.alias(row)), row


def by_row(rows: DataFrame, row: str) -> DataFrame:
    """Signature rows named by their place."""
    return rows.select(F.col(row).alias("lineage"), F.col("text").alias("genes"))


def without(docs: DataFrame, outcome: DataFrame, drop: Column, key: str = "doc_id") -> DataFrame:
    """``docs`` less those whose name ``key`` is that of a row of ``outcome(lineage, ...)`` that is to go; nothing else of the documents changes.

    The names that go are a written table of known size: Spark sends them to all tasks below its broadcast threshold, and sorts both sides beyond.
    """
    gone = keep(outcome.filter(drop).select(F.col("lineage").alias("_gone")).distinct())
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone"]), "left_anti")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes to be of quality 0 go.

    Every row is judged by its own whole text, null as empty; ids, ties and repeated rows play no part. No rows give none.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_document"))
    scored = signature_quality(as_signatures(whole, F.col("_document")), learning_labels(table(spark, sf_dir, "labels")), carry=("_document",))
    return scored.filter(F.col("predicted") != 0).select("_document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, one with the smallest id; rows without an id are last choice.

    Repeated rows are near duplicates of each other. Rows whose text is null or has no words stay, each as a group of its own; texts of any
    length are compared whole. No rows give none.
    """
    rows, row = numbered(docs)
    groups = near_signatures(by_row(rows, row)).select(F.col("lineage").alias("place"), "component_id")
    names = rows.select(F.col(row).alias("place"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "place"))
    stays = keep(names.join(groups, "place").groupBy("component_id").agg(first.alias("m")).select(F.col("m.place").alias(row)))
    return rows.join(stays.hint("merge"), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Rows with no id or a repeated one are judged each by its own text; null and empty texts have no words and stay; long texts are searched
    whole. Without items all rows stay; no rows give none.
    """
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("lineage"), F.col("text").alias("genes"))
    rows, row = numbered(docs)
    return without(rows, shared_with_projection(by_row(rows, row), items), F.col("contaminated"), row).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; where a source's budget ends within a document, its first words are taken.

    A null source is a source. Texts that are null or have no words have size 0 and are taken no times. Ties in the order of drawing go
    by id, then by place; repeated rows are drawn each on its own. No rows give none.
    """
    rows, row = numbered(docs)
    size, taken, time = unused(docs, "_size", "_taken", "_time")
    cells = as_cells(rows, table(spark, sf_dir, "labels"), row)
    mixed = mix_datasets(cells, carry=(row,)).select(row, F.col("total").alias(size), F.col("taken").alias(taken)).filter(F.col(taken) > 0)
    rest = (F.col(taken) % F.col(size)).cast("int")
    first_words = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE), 1, rest), " ")
    times = F.ceil(F.col(taken) / F.col(size)).cast("int")
    each = rows.join(mixed.hint("merge"), row).withColumn(time, F.explode(F.sequence(F.lit(1), times)))
    cut = (F.col(time) == times) & (rest > 0)
    text = F.when(cut, first_words).otherwise(F.col("text"))
    chars = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return each.withColumn("text", text).withColumn("n_chars", chars).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; returns where each document's tokens stand.

    Null texts are empty; repeated rows are written each; places are drawn by a permutation, so no ties arise. No rows give none.
    """
    return write_training_order(as_signatures(docs), VOCABULARY, shard_folder(spark)).withColumnRenamed("lineage", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", drop_low_quality), ("MinHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources), ("token-ID / binary output", write_tokens)]

#: The classifier and the shards have no SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each writes what it keeps before the next reads it."""
    docs, own = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        if own is not None:
            drop_table(own)
        own = docs
    return STAGES[-1][1](spark, docs, sf_dir)
