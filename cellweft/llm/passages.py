"""Removal of long passages that stand more than once, with a logarithmic family of suffix indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import drop_table, gram_hashes, keep, prefix_sums, signature_rows, span_hash

#: Bytes of a repeated string; of the places at which a string's anchor may be; of the gram whose hash picks the anchor.
LENGTH, REACH, GRAM = 400, 128, 16
BATCHES = 4
_PLACE = np.uint64((1 << 31) - 1)


def anchors(text: bytes, length: int = LENGTH, reach: int = REACH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of a text, and the strings that hang on them: ``lo, hi, core, hull``.

    Each string of ``length`` bytes is anchored at the smallest gram hash of its first ``reach`` places (the first, if equal), so equal
    strings have their anchors at the same place. Anchors are far fewer than strings: one serves all strings that start at ``lo ..
    hi``. ``core`` is the hash of the suffix's first bytes, as many as all these strings surely have in common; if it stands nowhere else, no
    string of the anchor does. ``hull`` is the hash of all their bytes together; if it stands elsewhere, all of them do.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) < length:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    if len(data) > int(_PLACE):
        raise ValueError("a text has more than 2 GB")
    sums = prefix_sums(data)
    low = gram_hashes(sums, gram)[:len(data) - length + reach]
    low = (low & ~_PLACE) | np.arange(len(low), dtype=np.uint64)
    step = 1
    while step < reach:  # reach is a power of two
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    place = (low & _PLACE).astype(np.int64)
    lo = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    hi = np.append(lo[1:], len(place)) - 1
    at = place[lo]
    return lo, hi, span_hash(sums, at, at + length - reach + 1), span_hash(sums, lo, hi + length)


def _lists(columns: list[list[np.ndarray]], kinds: list[pa.DataType]) -> list[pa.Array]:
    ends = pa.array(np.cumsum([0, *map(len, columns[0])]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).astype(k.to_pandas_dtype()) if c else [], k))
            for c, k in zip(columns, kinds, strict=True)]


def _core_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cores = [anchors(t.encode())[2].view(np.int64) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(_lists([cores], [pa.int64()]), names=["cores"])


def _anchor_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(t.encode()) for t in batch.column(2).to_pylist()]
        columns = [[f[i] if i < 2 else f[i].view(np.int64) for f in found] for i in range(4)]
        lists = _lists(columns, [pa.int32(), pa.int32(), pa.int64(), pa.int64()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["lineage", "body", "lo", "hi", "core", "hull"])


def _window_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, marks, hashes = [], [], []
        for text, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            sums = prefix_sums(np.frombuffer(text.encode(), dtype=np.uint8))
            runs = [np.arange(p["lo"], p["hi"] + 1) for p in parts]
            starts.append(np.concatenate(runs))
            marks.append(np.concatenate([np.full(len(r), p["asks"]) for r, p in zip(runs, parts, strict=True)]))
            hashes.append(span_hash(sums, starts[-1], starts[-1] + LENGTH).view(np.int64))
        lists = _lists([starts, marks, hashes], [pa.int32(), pa.bool_(), pa.int64()])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["lineage", "body", "start", "asks", "hash"])


def _cut_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, names = [], [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            for r in runs or ():
                edge[r["lo"]] += 1
                edge[r["end"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            sizes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            names.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        counts = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(names, pa.string())],
                                         names=["lineage", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


class SuffixFamily:
    """Suffix indexes of sizes 1, 2, 4, ... batches: ``core, n``, how often sampled suffixes begin with these bytes.

    An index keeps its suffixes in the order of their cores (that only equal beginnings matter, not which comes first, is why the order may
    be that of a hash), so scanning two indexes is a sort-merge join, and joining two of one size makes one of twice the size.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.shared: list[DataFrame] = []

    def add(self, texts: DataFrame) -> None:
        """Index a batch ``texts(genes)``: scan it against every level, then merge levels of one size."""
        cores = texts.select("genes").mapInArrow(_core_column, "cores array<bigint>").select(F.explode("cores").alias("core"))
        batch = keep(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("core"))
        hits = [batch.filter("n > 1").select("core")] + [batch.select("core").join(old.select("core"), "core") for _, old in self.levels]
        self.shared.append(keep(reduce(DataFrame.unionByName, hits).distinct()))
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = keep(a.unionByName(b).groupBy("core").agg(F.sum("n").alias("n")).sortWithinPartitions("core"))
            drop_table(a)
            drop_table(b)
            self.levels.append((2 * size, merged))

    def close(self) -> DataFrame:
        """``core`` of all suffixes whose beginning stands more than once; the levels are given up."""
        out = keep(reduce(DataFrame.unionByName, self.shared).distinct())
        for table in [*self.shared, *[t for _, t in self.levels]]:
            drop_table(table)
        return out


def cut_repeated_passages(signatures: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Remove from the texts of ``signatures(lineage, genes)`` every byte covered by a 400-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross texts, may overlap, may be in one text, and are judged on the input. Returns ``lineage,
    n_bytes, n_removed, n_spans, kept_sha256``, a row for each input row: size, bytes removed, maximal removed runs, and the
    sha256 of the remaining bytes.

    Texts come in ``batches``. Each batch gets a sparse suffix index (about one suffix in 64), which is scanned against all earlier ones in a
    geometric family (``SuffixFamily``). Suffixes that begin alike twice come back with their texts: where a suffix's whole
    surroundings are repeated, all its strings are; for the others, each string of 400 bytes is looked up by its 64-bit hash. So all
    work is in sums by hash, linear in the texts: a passage in a third of all rows is counted, never paired.

    Null or short texts lose nothing. Repeated rows lose all that is 400 bytes or longer, like any copies. Null lineages are kept; an empty
    table gives an empty result; extra columns are left out.
    """
    rows = signature_rows(signatures).withColumn("body", F.xxhash64("genes"))
    kind = rows.schema["lineage"].dataType.simpleString()
    long_rows = rows.filter(F.octet_length("genes") >= LENGTH)
    family = SuffixFamily()
    for i in range(batches):
        family.add(long_rows.filter(F.pmod(F.xxhash64("body"), F.lit(batches)) == i) if batches > 1 else long_rows)
    shared = family.close()
    name = ["lineage", "body"]
    sampled = long_rows.select("lineage", "body", "genes").mapInArrow(
        _anchor_columns, f"lineage {kind}, body bigint, lo array<int>, hi array<int>, core array<bigint>, hull array<bigint>")
    each = sampled.select(*name, F.explode(F.arrays_zip("lo", "hi", "core", "hull")).alias("a")).select(*name, "a.*")
    found = keep(each.join(shared, "core", "left_semi"))
    # Sums by hash are written before they are joined: Spark splits a crowded key of a join only if no sum stands between it and the shuffle.
    hulls = keep(found.groupBy("hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("body", "lo")).alias("first")).filter("n > 1"))
    marked = keep(found.join(hulls, "hull", "left").withColumn("open", F.col("n").isNull()))
    drop_table(found)
    drop_table(hulls)
    # Open suffixes ask for each of their strings. Whole repeated surroundings answer once, if they share a core with an open one.
    asked = keep(marked.filter("open").select("core").distinct())
    one = ~F.col("open") & (F.struct("body", "lo") == F.col("first"))
    part = marked.filter(F.col("open") | one).join(asked, "core", "left_semi").select(*name, "lo", "hi", F.col("open").alias("asks"))
    lists = part.groupBy(F.col("lineage").alias("_l"), F.col("body").alias("_b")).agg(F.collect_list(F.struct("lo", "hi", "asks")).alias("parts"))
    same = F.col("lineage").eqNullSafe(F.col("_l")) & (F.col("body") == F.col("_b"))
    strings = keep(long_rows.join(lists.hint("merge"), same).select(*name, "genes", "parts").mapInArrow(
        _window_columns, f"lineage {kind}, body bigint, start array<int>, asks array<boolean>, hash array<bigint>"))
    drop_table(asked)
    twice = keep(strings.select(F.explode("hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    asking = (strings.select(*name, F.explode(F.arrays_zip("start", "asks", "hash")).alias("s")).filter("s.asks")
              .select(*name, F.col("s.start").alias("lo"), F.col("s.hash").alias("hash")))
    single = asking.join(twice, "hash", "left_semi").select(*name, "lo", (F.col("lo") + LENGTH).alias("end"))
    whole = marked.filter(~F.col("open")).select(*name, "lo", (F.col("hi") + LENGTH).alias("end"))
    gone = keep(whole.unionByName(single).groupBy(F.col("lineage").alias("_l"), F.col("body").alias("_b"))
                .agg(F.collect_list(F.struct("lo", "end")).alias("runs")))
    for table in (strings, marked, twice):
        drop_table(table)
    return rows.join(gone.hint("merge"), same, "left").select("lineage", "genes", "runs").mapInArrow(
        _cut_columns, f"lineage {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
