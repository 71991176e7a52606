"""Maps from scores to weights that sum to one.

The long forms work on one row per (row key, column) and use windows over the row
key, whose size is the number of programs or genes. The packed forms work on arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalar import EPS, clamp, softplus


def softmax_by(df: DataFrame, keys: Sequence[str], score: str, out: str, temperature: float = 1.0,
               bounds: tuple[float, float] = (0.25, 1.0)) -> DataFrame:
    w = Window.partitionBy(*keys)
    t = min(max(temperature, bounds[0]), bounds[1])
    scaled = df.withColumn("_z", F.col(score) / F.lit(t))
    exp = scaled.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return exp.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def row_normalize(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) / (F.sum(value).over(Window.partitionBy(*keys)) + EPS))


def softplus_normalize(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    return row_normalize(df.withColumn("_s", softplus(F.col(score))), keys, "_s", out).drop("_s")


def l2_normalize(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*keys)))
    return df.withColumn(out, F.when(norm > 0, F.col(value) / norm).otherwise(F.lit(0.0)))


def sparsemax_by(df: DataFrame, keys: Sequence[str], score: str, order: str, out: str) -> DataFrame:
    """Euclidean projection of a score row onto the simplex, by sorted running sums."""
    w = Window.partitionBy(*keys)
    sorted_w = w.orderBy(F.desc(score), order)
    ranked = (df.withColumn("_k", F.row_number().over(sorted_w))
                .withColumn("_cum", F.sum(score).over(sorted_w.rowsBetween(Window.unboundedPreceding, 0))))
    inside = 1 + F.col("_k") * F.col(score) > F.col("_cum")
    tau = F.max_by(F.when(inside, (F.col("_cum") - 1) / F.col("_k")), F.when(inside, F.col("_k"))).over(w)
    return ranked.withColumn(out, F.greatest(F.col(score) - tau, F.lit(0.0))).drop("_k", "_cum")


def sparsemax_array(scores: Column) -> Column:
    down = F.sort_array(scores, asc=False)
    fold = F.aggregate(
        down, F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("cum"), F.lit(0.0).alias("tau")),
        lambda a, s: F.struct((a["k"] + 1.0).alias("k"), (a["cum"] + s).alias("cum"),
                              F.when(1.0 + (a["k"] + 1.0) * s > a["cum"] + s, (a["cum"] + s - 1.0) / (a["k"] + 1.0))
                              .otherwise(a["tau"]).alias("tau")),
        lambda a: a["tau"])
    return F.transform(scores, lambda s: F.greatest(s - fold, F.lit(0.0)))


def softmax_array(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def entmax_array(scores: Column, alpha: float = 1.5, iterations: int = 25) -> Column:
    """Alpha-entmax by bisection on the threshold, renormalised; 1 is softmax, 2 is sparsemax."""
    if abs(alpha - 1.0) < 1e-4:
        return softmax_array(scores)
    if abs(alpha - 2.0) < 1e-4:
        return sparsemax_array(scores)
    a1, power = F.lit(alpha - 1.0), F.lit(1.0 / (alpha - 1.0))

    def raised(tau: Column):
        return lambda s: F.pow(F.greatest(a1 * (s - tau), F.lit(0.0)), power)

    def halve(acc: Column, _i: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        low = F.aggregate(F.transform(scores, raised(mid)), F.lit(0.0), lambda a, v: a + v) < 1.0
        return F.struct(F.when(low, acc["lo"]).otherwise(mid).alias("lo"),
                        F.when(low, mid).otherwise(acc["hi"]).alias("hi"))

    top = F.array_max(scores)
    tau = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)),
                      F.struct((top - 1.0 / (alpha - 1.0)).alias("lo"), top.alias("hi")), halve,
                      lambda acc: (acc["lo"] + acc["hi"]) / 2.0)
    # zip each score with its row's threshold once, so the search runs once per row
    v = F.transform(F.array(tau), lambda t: F.transform(scores, lambda s: F.pow(F.greatest(a1 * (s - t), F.lit(0.0)), power)))[0]
    return F.transform(F.array(v), lambda r: F.transform(
        r, lambda p: p / (F.aggregate(r, F.lit(0.0), lambda a, q: a + q) + EPS)))[0]


def entmax_by(df: DataFrame, keys: Sequence[str], item: str, score: str, out: str, alpha: float = 1.5) -> DataFrame:
    """Entmax over the rows of each key; one row holds at most as many items as there are programs."""
    packed = (df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), F.col(score).alias("s")))).alias("_r"))
                .withColumn("_p", entmax_array(F.col("_r.s"), alpha)))
    return packed.select(*keys, F.explode(F.arrays_zip(F.col("_r.i").alias("i"), F.col("_p").alias("p"))).alias("_z")).select(
        *keys, F.col("_z.i").alias(item), F.col("_z.p").alias(out))


def blended_core_softmax(df: DataFrame, keys: Sequence[str], score: str, is_core: str, out: str,
                         temperature: float, slack: float = 0.03) -> DataFrame:
    """Softmax kept mostly on the core columns, with a small share over all columns."""
    core = df.withColumn("_core", F.when(F.col(is_core), F.col(score)).otherwise(F.lit(-50.0)))
    both = softmax_by(softmax_by(core, keys, "_core", "_pc", temperature, (0.25, 0.5)),
                      keys, score, "_pf", temperature, (0.25, 0.5))
    return both.withColumn(out, (1.0 - slack) * F.col("_pc") + slack * F.col("_pf")).drop("_core", "_pc", "_pf")


__all__ = ["softmax_by", "row_normalize", "softplus_normalize", "l2_normalize", "sparsemax_by", "sparsemax_array",
           "softmax_array", "entmax_array", "entmax_by", "blended_core_softmax", "clamp"]
