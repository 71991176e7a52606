"""Mixing datasets to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.llm.common import fraction

#: Shares of the datasets, in order of their names, repeating.
SHARES = (5.0, 2.0, 1.0)
#: Rows that one task puts in order.
PART_ROWS = 2_000


def dataset_targets(cells: DataFrame, shares: Sequence[float] = SHARES, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How much each dataset of ``cells(dataset_id, total)`` gives: ``dataset_id, source_size, n_cells, mean_weight, target``.

    All datasets share ``ratio`` times all totals by weight, but none gives more than ``cap`` times its own; what it can't give is shared
    by weight among the rest, until none is above. Ordered by ``cap * size / weight``, those at their cap come first, so one
    running sum finds the level. These windows hold a row for each dataset, not for each cell.
    """
    size = F.sum("total").cast("long").alias("source_size")
    datasets = cells.groupBy("dataset_id").agg(size, F.count(F.lit(1)).alias("n_cells"), F.avg("weight").alias("mean_weight"))
    number = F.row_number().over(Window.orderBy(F.col("dataset_id").asc_nulls_last())) - 1
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (number % len(shares) + 1).cast("int"))
    by_level = Window.orderBy("_level", F.col("dataset_id").asc_nulls_last())
    before, rest, everything = (by_level.rowsBetween(Window.unboundedPreceding, -1),
                                by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.orderBy(F.lit(1)).rowsBetween(
                                    Window.unboundedPreceding, Window.unboundedFollowing))
    left = ratio * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = (datasets.withColumn("_share", share).withColumn("_level", cap * F.col("source_size") / F.col("_share"))
              .withColumn("_fair", left / F.sum("_share").over(rest)))
    free = F.min(F.when(F.col("_level") > F.col("_fair"), F.struct("_level", (-F.col("_fair")).alias("_less"))))
    fair = -F.col("_free._less")
    target = F.when(F.col("_level") > fair, fair * F.col("_share")).otherwise(
        cap * F.col("source_size"))
    return (levels.withColumn("_free", free.over(everything))
            .select("dataset_id", "source_size", "n_cells", "mean_weight",
                    F.when(F.col("_free").isNull(), cap * F.col("source_size")).otherwise(target).alias("target")))


def mix_datasets(cells: DataFrame, shares: Sequence[float] = SHARES, ratio: float = 1.5, cap: float = 2.0, seed: int = 1,
                 part_rows: int = PART_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """How much the mix takes of each of ``cells(dataset_id, cell_id, total, weight)``, repeats counted.

    A dataset is taken whole as often as its target allows (complete epochs). What is left of its budget is drawn without replacement by
    Efraimidis and Spirakis: each cell gets the key ``-ln(u) / weight``, ``u`` from the md5 of ``cell_id:seed``, and cells are
    taken in order of the key until their totals fill the budget; the cell at the edge gives only what still fits. Returns ``dataset_id,
    cell_id, total, source_size, target, taken``. Everything but the logarithm is exact, so reruns agree.

    The order of one dataset is cut into parts of about ``part_rows`` by the key itself; sums of parts come first (map-side), then each
    part is ordered on its own. So a dataset with a third of all rows is spread over many tasks.

    Null ``total`` or below 0 counts as 0, null ``weight`` as 1; a weight of 0 or less is drawn last. A null dataset is a dataset and
    comes last. Ties in the key go by ``cell_id``, then by the columns that ``carry`` names; repeated rows are rows. No cells: no rows. The
    columns of ``carry`` come last in the result; other extra columns are left out.
    """
    rows = cells.select("dataset_id", "cell_id", F.greatest(F.coalesce(F.col("total"), F.lit(0)), F.lit(0)).cast("long").alias("total"),
                        F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), *carry)
    targets = dataset_targets(rows, shares, ratio, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("_epochs", epochs).withColumn(
        "_budget", F.greatest(F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("_parts", F.ceil(F.col("n_cells") / F.lit(part_rows))).withColumnRenamed("dataset_id", "_dataset")
    keyed = (rows.withColumn("_u", fraction(["cell_id", F.lit(seed)]))
             .withColumn("_key", F.when(F.col("weight") > 0, -F.ln("_u") / F.col("weight")).otherwise(F.lit(float("inf"))))
             .join(plan, F.col("dataset_id").eqNullSafe(F.col("_dataset"))))
    # 1 - exp(-key * mean) rises with the key and is near uniform where weights are alike.
    spread = F.floor((1 - F.exp(-F.col("_key") * F.greatest("mean_weight", F.lit(1e-9)))) * F.col("_parts"))
    keyed = keyed.withColumn("_part", F.least(spread, F.col("_parts") - 1).cast("long"))
    sums = keyed.groupBy(F.col("dataset_id").alias("_d"), F.col("_part").alias("_p")).agg(F.sum("total").alias("_sum"))
    running = Window.partitionBy("_d").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_d", "_p", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_offset"))
    inside = (Window.partitionBy("dataset_id", "_part").orderBy("_key", "_u", "cell_id", *carry)
              .rowsBetween(Window.unboundedPreceding, -1))
    ordered = keyed.withColumn("_before", F.coalesce(F.sum("total").over(inside), F.lit(0)))
    joined = ordered.join(offsets, F.col("dataset_id").eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p")))
    room = F.col("_budget") - F.col("_offset") - F.col("_before")
    drawn = F.least(F.col("total"), F.greatest(room, F.lit(0)))
    return joined.select("dataset_id", "cell_id", "total", "source_size", "target",
                         (F.col("_epochs") * F.col("total") + drawn).cast("long").alias("taken"), *carry)
