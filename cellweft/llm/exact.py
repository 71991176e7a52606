"""Exact duplicates by most-significant-digit radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import SPACE, drop_table, keep, signature_rows

#: Bytes looked at in the first round; each later round looks at ``GROWTH`` times as many.
DIGIT, GROWTH = 64, 8


def equal_signatures(signatures: DataFrame, digit: int = DIGIT, growth: int = GROWTH) -> DataFrame:
    """Which ``signatures(lineage, genes)`` have the same text once white space is taken out, and which row of each group stays.

    Rows are split by their first ``digit`` bytes, the parts by the next ``digit * growth`` bytes, and so on, until a part has one row or
    its texts have ended; all rows of an ended part are equal, byte by byte. A round groups by (part, digit) with map-side sums, so a part
    that holds a third of all rows is only counted, never gathered. Only rows whose part is still open reach the next round. Tables
    of parts grow with the rows, so they are never broadcast; the joins are sort-merge joins whose skewed sides Spark splits.

    Returns ``lineage, keep_lineage, group_size, kept, text_sha256``, a row for each input row. The longest original (in code
    points) stays, then the smallest lineage (null first). The sha256 is for the reader and tells rows of one lineage apart; groups
    don't come from it.

    Null text is empty; empty texts are equal to each other. Rows that repeat lineage and text share one outcome; a lineage that comes
    with several texts has a row for each. An empty table gives an empty result; extra columns are left out.
    """
    text = F.encode(F.regexp_replace("genes", SPACE, ""), "utf-8")
    rows = (signature_rows(signatures).select("lineage", F.length("genes").alias("_size"), text.alias("_text"))
            .select("lineage", "_size", F.sha2("_text", 256).alias("_sha"), "_text"))
    left, width, found = rows.withColumn("_part", F.lit(0).cast("long")), digit, []
    while True:
        cut = left.select("_part", "lineage", "_size", "_sha", F.substring("_text", 1, width).alias("_digit"),
                          F.expr(f"substring(_text, {width + 1})").alias("_text"))
        longest = F.min(F.struct((-F.col("_size")).alias("size"), F.col("lineage").alias("lineage"))).alias("_best")
        parts = keep(cut.groupBy("_part", "_digit").agg(F.count(F.lit(1)).alias("_n"), longest).filter("_n > 1")
                     .withColumn("_next", F.monotonically_increasing_id()))
        ended = F.octet_length("_digit") < width
        here = cut.join(parts.filter(ended).hint("merge"), ["_part", "_digit"])
        found.append(keep(here.groupBy("lineage", "_sha").agg(F.first("_best").alias("_best"), F.first("_n").alias("_n"))))
        growing = parts.filter(~ended)
        done = growing.isEmpty()
        after = None if done else keep(cut.join(growing.hint("merge"), ["_part", "_digit"])
                                       .select(F.col("_next").alias("_part"), "lineage", "_size", "_sha", "_text"))
        drop_table(parts)
        if width > digit:
            drop_table(left)
        if done:
            break
        left, width = after, width * growth
    groups = reduce(DataFrame.unionByName, found).withColumnRenamed("lineage", "_lineage").withColumnRenamed("_sha", "_name")
    alone = F.col("_n").isNull()
    return (rows.drop("_text").join(groups.hint("merge"), F.col("lineage").eqNullSafe(F.col("_lineage")) & (F.col("_sha") == F.col("_name")), "left")
            .select("lineage", F.when(alone, F.col("lineage")).otherwise(F.col("_best.lineage")).alias("keep_lineage"),
                    F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
                    (alone | (F.col("_best.lineage").eqNullSafe(F.col("lineage")) & (-F.col("_best.size") == F.col("_size")))).alias("kept"),
                    F.col("_sha").alias("text_sha256")))
