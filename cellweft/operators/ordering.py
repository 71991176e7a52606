"""Exact ranks and quantiles that never put a whole key group into one task.

A sample, a gene or a grid square may hold a third of all rows, so a plain
``row_number() OVER (PARTITION BY sample ...)`` would sort that third in one
task. Here a group is first cut into buckets that follow the ordering, bucket
sizes are counted with a map-side combine, and only the (small) bucket table is
summed per group. Rank = rows in earlier buckets + rank inside the bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# One bucket is ranked inside one task; this is the size it is aimed at.
BUCKET_ROWS = 200_000
HISTOGRAM_BINS = 1024


def hash_key(ident: Sequence[str] | str, seed: int | str | Column) -> Column:
    """Portable random key: md5 of ``id:seed`` (same text in any engine)."""
    cols = [ident] if isinstance(ident, str) else list(ident)
    tail = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in cols], tail.cast("string")))


def hash_unit(key: Column) -> Column:
    """First 32 bits of a hex key as a fraction of one; monotone in the key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def bucketed_rank(df: DataFrame, keys: Sequence[str], buckets: Sequence[str],
                  order: Sequence[Column], out: str = "rn") -> DataFrame:
    """``row_number()`` within ``keys`` ordered by ``buckets`` then ``order``."""
    keys, buckets = list(keys), list(buckets)
    slot = keys + buckets
    sizes = df.groupBy(*slot).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*slot, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*slot).orderBy(*order))
    return (df.withColumn(out, local).join(offsets, slot)
              .withColumn(out, F.col(out) + F.col("_before")).drop("_before"))


def hash_rank(df: DataFrame, keys: Sequence[str], ident: Sequence[str] | str, seed: int | str | Column,
              out: str = "rn", size: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rank of a random order within ``keys``; groups beyond ``bucket_rows`` are ranked in parts."""
    keys = list(keys)
    ids = [ident] if isinstance(ident, str) else list(ident)
    keyed = df.withColumn("_h", hash_key(ids, seed))
    if size is None:
        size = "_size"
        keyed = keyed.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size)), keys)
    parts = F.ceil(F.col(size) / F.lit(bucket_rows))
    keyed = keyed.withColumn("_part", F.floor(hash_unit(F.col("_h")) * parts).cast("int"))
    ranked = bucketed_rank(keyed, keys, ["_part"], [F.col("_h"), *[F.col(c) for c in ids]], out)
    drop = ["_h", "_part"] + (["_size"] if size == "_size" else [])
    return ranked.drop(*drop)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  salt: Column, salts: int = 64, out: str = "rn") -> DataFrame:
    """First ``n`` rows per group in two steps: per salted part, then over the survivors."""
    keys = list(keys)
    first = (df.withColumn("_salt", F.pmod(salt, F.lit(salts)))
               .withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
               .filter(F.col(out) <= n).drop(out, "_salt"))
    return (first.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                 .filter(F.col(out) <= n))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, one output column per entry of ``probs``.

    Equal values are collapsed first (map-side combined). Two rounds of a 1024-bin
    histogram then leave about a millionth of the value range for the last, sorted
    step, whatever the size of the group.
    """
    keys, named = list(keys), list(probs.items())
    slot = [*keys, "_name", "_rank"]
    counts = (df.filter(F.col(value).isNotNull())
                .groupBy(*keys, F.col(value).cast("double").alias("_v"))
                .agg(F.count(F.lit(1)).alias("_c")))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(float(p)).alias("_p"))
                                for n, p in named])).alias("_w")
    ranges = (counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
                    .select("*", asked)
                    .select(*keys, "_w._name", "_lo", "_hi", ((F.col("_n") - 1) * F.col("_w._p")).alias("_pos"))
                    .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
                    .withColumn("_left", F.col("_rank")))
    hit = (F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_c"))

    def inside(found: DataFrame) -> DataFrame:
        return counts.join(found, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    def below(order: str) -> Column:
        w = Window.partitionBy(*slot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_c").over(w), F.lit(0))

    for _ in range(2):
        width = F.col("_hi") - F.col("_lo")
        step = F.least(F.lit(HISTOGRAM_BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / width * HISTOGRAM_BINS))
        bins = (inside(ranges).withColumn("_bin", F.when(width > 0, step).otherwise(F.lit(0)))
                .groupBy(*slot, "_pos", "_left", "_bin")
                .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        ranges = (bins.withColumn("_below", below("_bin")).filter(hit)
                      .withColumn("_left", F.col("_left") - F.col("_below")).drop("_c", "_bin", "_below"))
    picked = inside(ranges).withColumn("_below", below("_v")).filter(hit)
    lower = F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_v")))
    upper = F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_v")))
    each = (picked.groupBy(*keys, "_name", "_pos").agg(lower.alias("_a"), upper.alias("_b"))
                  .withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n, _p in named])
