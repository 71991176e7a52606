"""Spelling variants of gene names, found through variable-length grams."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import keep

#: Lengths of grams. A name is at least as long as the longest gram, so it always has two grams that share no place.
SHORTEST, LONGEST = 2, 5
#: A gram is extended if more than one place in so many starts it; so each length has fewer than ``PLACES`` such grams, whatever the input.
PLACES = 4096
#: Numbers in which the lengths of lists are added up. They only say which lists are merged; results don't depend on them.
SLOTS = 1 << 18
#: Marks of both ends; no name has them.
START, END = "\u0001", "\u0002"


def grams(name: str, frequent: set[str]) -> list[str]:
    """The gram of each place of the marked name: it grows as long as what it holds so far is frequent."""
    s, out = START + name + END, []
    for i in range(len(s) - SHORTEST + 1):
        size = SHORTEST
        while size < LONGEST and i + size < len(s) and s[i:i + size] in frequent:
            size += 1
        out.append(s[i:i + size])
    return out


def affected(places: list[tuple[int, int]]) -> int:
    """At most so many of the grams ``(place, size)`` change by one inserted, deleted or replaced code point."""
    return max(sum(i <= at < i + size for i, size in places) for at in range(max(i + size for i, size in places)))


def slot(gram: str, place: int, size: int) -> int:
    """Where the length of the list of this gram, place and size of name is added up."""
    return crc32(f"{place}:{size}:{gram}".encode()) % SLOTS


def cheapest_lists(found: list[str], size: int, lengths: np.ndarray) -> tuple[int, int]:
    """Places of the two grams with the shortest lists of all pairs that share no place, so that one edit can affect only one of them."""
    left = [sum(int(lengths[slot(g, i, size + d)]) for d in (-1, 0, 1)) for i, g in enumerate(found)]
    right = [sum(int(lengths[slot(g, i + d, size + d)]) for d in (-1, 0, 1)) for i, g in enumerate(found)]
    ends = sorted(range(len(found)), key=lambda i: i + len(found[i]))
    best, at, e = (-1, -1), -1, 0
    for j in range(len(found)):
        while e < len(ends) and ends[e] + len(found[ends[e]]) <= j:
            at = ends[e] if at < 0 or left[ends[e]] < left[at] else at
            e += 1
        if at >= 0 and (best[0] < 0 or left[at] + right[j] < left[best[0]] + right[best[1]]):
            best = (at, j)
    return best


def _lengths(frequent: set[str]):
    """The lengths of all lists, added up in ``SLOTS`` numbers by each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            total += np.bincount([slot(g, i, len(s)) for s in batch.column(0).to_pylist() for i, g in enumerate(grams(s, frequent))], minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])
    return run


def _listed(frequent: set[str]):
    """Rows of the index: every gram of a name with its place and the size of the name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, place, size, name, n = [], [], [], [], []
            for s, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = grams(s, frequent)
                gram += found
                place += range(len(found))
                size += [len(s)] * len(found)
                name += [s] * len(found)
                n += [count] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(name, pa.string()),
                                              pa.array(n, pa.int64())], names=["gram", "place", "size", "near", "near_n"])
    return run


def _sought(frequent: set[str], lengths: np.ndarray):
    """The lists to merge for a name. If the edit is right of the first gram, that gram keeps its place; if not, the second moves with the size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, place, size, name, same = [], [], [], [], []
            for s in batch.column(0).to_pylist():
                found = grams(s, frequent)
                left, right = cheapest_lists(found, len(s), lengths)
                for more in (-1, 0, 1):
                    gram += [found[left], found[right]]
                    place += [left, right + more]
                    size += [len(s) + more] * 2
                    name += [s] * 2
                    same += [s[:max(left + len(found[left]) - 1, 0)], s[right - 1:]]
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.string()), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(name, pa.string()),
                                              pa.array(same, pa.string()), pa.array([True, False] * (len(same) // 2), pa.bool_())],
                                             names=["gram", "place", "size", "gene", "same", "begins"])
    return run


def frequent_grams(names: DataFrame) -> set[str]:
    """Grams below the longest size that start at more than one in ``PLACES`` of all places of all names."""
    marked = F.concat(F.lit(START), "gene", F.lit(END))
    total = names.agg(F.sum(F.length("gene") + 1)).first()[0] or 0
    limit = total // PLACES + 1
    starts = F.sequence(F.lit(1), F.length("gene") + 1)
    pieces = [F.transform(starts, lambda i, k=k: F.substring(marked, i, F.lit(k))) for k in range(SHORTEST, LONGEST)]
    counted = names.select(F.explode(F.concat(*pieces)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return {r.gram for r in counted.collect()}


def gene_spelling_variants(genes: DataFrame, min_length: int = LONGEST, min_count: int = 3, times: float = 2.0) -> DataFrame:
    """Which gene names of ``genes(gene, n)`` are variants of more frequent ones: rows are summed by name, so ``n`` may be per sample or lineage.

    Names have at least ``min_length`` code points and ``min_count`` occurrences over all rows. Two names are near if they differ by exactly one
    inserted, deleted or replaced code point. A name's form is the near name of largest ``n`` (ties: first in code-point order), if that is at
    least ``times`` its own. Returns ``gene, form, root, n, n_near, form_n``: ``root`` follows forms to the last.

    A gram dictionary is counted over all names and pruned by frequency: a gram grows while what it holds is frequent, so frequent beginnings lead
    to longer grams. One edit changes only the grams that cover it. The bound of affected grams says how many lists of a name must be merged: of
    two grams that share no place one always stays, at its place or moved by the change of size, so two lists are merged, the shortest such
    pair. Lengths of lists are known from 262 144 sums over hashes of lists, which may count a few together. Lists are keyed by gram, place and size of the name; what they hold is verified inside the join, so only links become rows. The
    dictionary that reaches the tasks has fewer than 4 096 grams of each size; hot lists are split by Spark's skew join. Roots double the distance
    followed each round, and counts at least double with each form, so there are few rounds.

    Null names and counts are left out, as are empty and short names; an empty table gives an empty result; very long names take one row per code
    point in the index. Extra columns are left out.
    """
    if min_length < LONGEST:
        raise ValueError(f"names of fewer than {LONGEST} code points have no two grams that one edit can't both change")
    if times <= 1:
        raise ValueError("a form must be more frequent than its variant")
    names = keep(genes.select("gene", F.col("n").cast("long").alias("n")).filter(F.char_length("gene") >= min_length)
                 .groupBy("gene").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))
    frequent = frequent_grams(names)
    summed = names.select("gene").mapInArrow(_lengths(frequent), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    lengths = np.zeros(SLOTS, dtype=np.int64)
    lengths[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    listed = names.mapInArrow(_listed(frequent), "gram string, place int, size int, near string, near_n long")
    sought = names.select("gene").mapInArrow(_sought(frequent, lengths), "gram string, place int, size int, gene string, same string, begins boolean")
    a, b = sought.alias("a"), listed.hint("merge").alias("b")
    same_list = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.size") == F.col("b.size"))
    # what lies before the first gram, or after the second, is the same too; that is quickly seen
    holds = F.when(F.col("begins"), F.startswith("near", "same")).otherwise(F.endswith("near", "same"))
    links = a.join(b, same_list & F.when(holds, F.levenshtein("gene", "near", 1) == 1).otherwise(F.lit(False))).select("gene", "near", "near_n").distinct()
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("gene"))).alias("best")
    found = links.groupBy(F.col("gene").alias("_gene")).agg(F.count(F.lit(1)).alias("n_near"), best)
    heavier = -F.col("best.n") >= times * F.col("n")
    formed = keep(names.join(found.hint("merge"), F.col("gene") == F.col("_gene"), "left").select(
        "gene", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(heavier, F.col("best.gene")).alias("form"),
        F.when(heavier, -F.col("best.n")).alias("form_n")))
    paths = formed.filter("form is not null").select("gene", F.col("form").alias("root"))
    while True:
        further = paths.select(F.col("gene").alias("_from"), F.col("root").alias("_to"))
        paths = keep(paths.join(further.hint("merge"), F.col("root") == F.col("_from"), "left")
                     .select("gene", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")))
        if paths.filter("moved").isEmpty():
            break
        paths = paths.drop("moved")
    ends = paths.select(F.col("gene").alias("_gene"), "root")
    return (formed.join(ends.hint("merge"), F.col("gene") == F.col("_gene"), "left")
            .select("gene", "form", F.coalesce("root", "gene").alias("root"), "n", "n_near", "form_n"))
