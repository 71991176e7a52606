"""Near duplicates: minhash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import drop_table, gaps, keep, mix64, signature_rows, sliding_hash, word_hashes
from cellweft.llm.linking import connected

#: Words in a shingle; collections on each side and minhashes in each. A table key joins one collection of the left side with one of the
#: right: 16 x 16 tables need 96 minhashes, not 1536. A pair of similarity 0.75 has no common key with probability 0.0003.
SHINGLE, COLLECTIONS, MINHASHES = 5, 16, 3
#: A pair is worth confirming if so many of the 96 minhashes agree; at similarity 0.75 fewer agree with probability 0.00002.
AGREEING = 54
#: Rows of one table key, and shingles of their sets, that are compared in one task; larger groups are compared block by block.
BLOCK, BLOCK_ITEMS = 1000, 1_000_000
#: Shingles of candidates with which a row is compared at once.
COMPARED = 50_000

_GAP = gaps("space")
_TOTAL = 2 * COLLECTIONS * MINHASHES
#: Of eight bytes, all bits but the highest of each.
_LOW_BITS = np.uint64(0x7F7F7F7F7F7F7F7F)
_FACTORS = mix64(np.arange(1, _TOTAL + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; with fewer words, of the whole sequence; without words, none."""
    words = word_hashes(text.encode().lower(), _GAP)
    return np.unique(sliding_hash(words, min(n, len(words))) + np.uint64(min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def minhashes(items: np.ndarray) -> np.ndarray:
    low = np.full(_TOTAL, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), 4096):
        np.minimum(low, (items[i:i + 4096, None] * _FACTORS[None, :]).min(axis=0), out=low)
    return low


def collection_keys(low: np.ndarray) -> np.ndarray:
    """One key for each collection; keys of different collections differ."""
    each = low.reshape(2 * COLLECTIONS, MINHASHES)
    out = np.arange(2 * COLLECTIONS, dtype=np.uint64)
    for i in range(MINHASHES):
        out = mix64(out + each[:, i])
    return out


def _sketch_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names, keys, marks = [], [], [], []
        for text in batch.column(1).to_pylist():
            items = shingles(text)
            sizes.append(len(items))
            if not len(items):
                names.append(None)
                keys.append(None)
                marks.append(None)
                continue
            low = minhashes(items)
            names.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
            keys.append(collection_keys(low).view(np.int64))
            marks.append((mix64(low) & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
             pa.array(marks, pa.binary())], names=["lineage", "digest", "n_shingles", "set_id", "keys", "marks"])


def _set_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in batch.column(2).to_pylist()]
        right = [hashlib.blake2b(f.tobytes(), digest_size=16).digest() == s for f, s in zip(found, batch.column(1).to_pylist(), strict=True)]
        rows = np.flatnonzero(right)
        sets = pa.array([found[i].view(np.int64) for i in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), sets], names=["node", "items"])


def _by_bucket(work: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hand whole buckets to ``work``, from rows sorted by ``bucket``; no more than a batch and one bucket is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            bucket = rows["bucket"].to_numpy()
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if len(bucket) and bucket[0] != bucket[-1] else 0
            held = rows.slice(cut)
            if cut:
                yield work(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield work(held)
    return run


def _marks_of(rows: pa.Table) -> np.ndarray:
    """The marks of each row, eight to a number."""
    return np.frombuffer(b"".join(rows["marks"].to_pylist()), dtype=np.uint64).reshape(-1, _TOTAL // 8)


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many marks of rows are equal: bytes that are 0 in the difference, found eight at a time."""
    differ = a ^ b
    same = ~(((differ & _LOW_BITS) + _LOW_BITS) | differ | _LOW_BITS)
    return np.bitwise_count(same).sum(axis=1, dtype=np.int64)


def _pairs(bucket: np.ndarray, block: np.ndarray, half: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one bucket, at most some 200 000 at a time; where two different blocks meet, only pairs across."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    later = np.repeat(np.append(starts[1:], len(bucket)), np.diff(np.append(starts, len(bucket)))) - np.arange(len(bucket)) - 1
    done = 0
    while done < len(bucket):
        ends = np.cumsum(later[done:])
        n = max(1, int(np.searchsorted(ends, 200_000, side="right")))
        left = np.repeat(np.arange(done, done + n), later[done:done + n])
        first = np.repeat(ends[:n] - later[done:done + n], later[done:done + n])
        right = left + 1 + np.arange(len(left)) - first
        fits = ~half[left] | (block[left] != block[right])
        yield left[fits], right[fits]
        done += n


def _best_partners(rows: pa.Table) -> pa.RecordBatch:
    """For each row of a bucket the node that agrees with it in most minhashes, if enough do."""
    node, block, bucket = (rows[c].to_numpy() for c in ("node", "block", "bucket"))
    half, marks = rows["i"].to_numpy() != rows["j"].to_numpy(), _marks_of(rows)
    out = [np.zeros((0, 3), dtype=np.int64)]
    for x, y in _pairs(bucket, block, half):
        agree = _agreeing(marks[x], marks[y])
        good = (agree >= AGREEING) & (node[x] != node[y])
        x, y, agree = x[good], y[good], agree[good]
        both = np.stack([np.append(node[x], node[y]), np.append(node[y], node[x]), np.append(agree, agree)], axis=1)
        both = both[np.lexsort((both[:, 1], -both[:, 2], both[:, 0]))]
        out.append(both[np.append(True, both[1:, 0] != both[:-1, 0])] if len(both) else both)
    found = np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(found[:, i], pa.int64()) for i in range(3)], names=["a", "b", "agree"])


def _first_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first pair of collections in which rows agree, by the keys that tables are made of: marks may agree by chance."""
    agree = (a == b).reshape(-1, 2, COLLECTIONS).argmax(axis=2)
    return agree[:, 0] * COLLECTIONS + agree[:, 1]


def _keys_of(rows: pa.Table) -> np.ndarray:
    return rows["keys"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * COLLECTIONS)


def _to_compare(rows: pa.Table) -> pa.RecordBatch:
    """Rows of a bucket that are to be compared there: each has a candidate of another group, and this is the first table of the two."""
    label, block, bucket, table = (rows[c].to_numpy() for c in ("label", "block", "bucket", "table"))
    half, marks, keys = rows["i"].to_numpy() != rows["j"].to_numpy(), _marks_of(rows), _keys_of(rows)
    chosen = np.zeros(len(label), dtype=bool)
    for x, y in _pairs(bucket, block, half):
        other = label[x] != label[y]
        x, y = x[other], y[other]
        good = _agreeing(marks[x], marks[y]) >= AGREEING
        x, y = x[good], y[good]
        first = _first_table(keys[x], keys[y]) == table[x]
        chosen[x[first]] = chosen[y[first]] = True
    out = {"bucket": bucket, "node": rows["node"].to_numpy(), "block": block, "table": table, "half": half}
    return pa.RecordBatch.from_arrays([pa.array(v[chosen]) for v in out.values()], names=list(out))


def _forest(rows: pa.Table) -> pa.RecordBatch:
    """Links between groups, confirmed on full sets: in each bucket a spanning forest of all that hold.

    A row is compared with its candidates of other groups, some hundred at once, and each group it is linked with joins its own before the
    next ones.
    """
    node, block, bucket, table, half = (rows[c].to_numpy(zero_copy_only=False) for c in ("node", "block", "bucket", "table", "half"))
    marks, keys, items = _marks_of(rows), _keys_of(rows), rows["items"].combine_chunks()
    flat, offsets = items.values.to_numpy().view(np.uint64), items.offsets.to_numpy().astype(np.int64)
    sizes, group, found = np.diff(offsets), rows["label"].to_numpy().copy(), []

    def linked(x: int, others: np.ndarray) -> np.ndarray:
        own, begin = flat[offsets[x]:offsets[x + 1]], np.cumsum(sizes[others]) - sizes[others]
        theirs = flat[np.repeat(offsets[others] - begin, sizes[others]) + np.arange(sizes[others].sum())]
        hits = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(hits, begin, dtype=np.int64)
        return others[100 * common >= 75 * (sizes[x] + sizes[others] - common)]

    starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for start, end in zip(starts[:-1], starts[1:], strict=True):
        for x in range(start, end - 1):
            y = np.arange(x + 1, end)
            y = y[(group[y] != group[x]) & (~half[x] | (block[y] != block[x]))]
            y = y[100 * np.minimum(sizes[y], sizes[x]) >= 75 * np.maximum(sizes[y], sizes[x])]
            y = y[_agreeing(marks[y], marks[x]) >= AGREEING]
            y = y[_first_table(keys[y], keys[x]) == table[x]]
            while len(y):
                size = max(1, int(np.searchsorted(np.cumsum(sizes[y]), COMPARED)))
                for other in linked(x, y[:size]):
                    if group[other] != group[x]:
                        found.append((node[x], node[other]))
                        here = group[start:end]
                        here[here == group[other]] = group[x]
                y = y[size:]
                y = y[group[y] != group[x]]
    ends = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, i], pa.int64()) for i in range(2)], names=["a", "b"])


def in_buckets(nodes: DataFrame, by_group: bool) -> DataFrame:
    """``nodes(node, label, n_shingles, marks, keys, left, right)`` in every table key they have, block by block, sorted by ``bucket``.

    For groups, all tables are made, each left collection with each right one, and only keys with rows of two groups are left; for best
    partners, which need not be complete, tables of collections of one number do.
    """
    right = F.col("right") if by_group else F.filter("right", lambda r: r["pos"] == F.col("l.pos") + COLLECTIONS)
    given, later = (["node", "label", "n_shingles"], ["marks", "keys"]) if by_group else (["node", "label", "n_shingles", "marks"], [])
    keyed = (nodes.select(*given, F.explode("left").alias("l"), "right")
             .select(*given, "l", F.explode(right).alias("r"))
             .select(F.xxhash64("l.key", "r.key").alias("key"), (F.col("l.pos") * COLLECTIONS + F.col("r.pos") - COLLECTIONS).alias("table"), *given))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_ITEMS))
    counts = keyed.groupBy("key").agg(blocks.alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    full = keep(counts.filter(F.col("low") < F.col("high") if by_group else F.col("blocks") > 1).select("key", "blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    found = keyed.join(full.hint("merge"), "key").join(nodes.select("node", *later).hint("merge"), "node") if by_group else keyed.join(full, "key", "left")
    rows = (found.withColumn("block", F.pmod(F.xxhash64("node"), blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block", "marks", "table", *later[1:])
            .withColumn("bucket", F.xxhash64("key", "i", "j")))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "node")


def best_partners(nodes: DataFrame) -> DataFrame:
    """Of each node that has a candidate, the pair ``a, b`` with the one that agrees with it most: no more pairs than nodes."""
    each = in_buckets(nodes, by_group=False).mapInArrow(_by_bucket(_best_partners), "a bigint, b bigint, agree bigint")
    best = each.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m"))
    return best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def links_of_groups(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links ``a, b`` between nodes of different groups (``label``) that connect all groups with a link.

    Candidates never become rows: a first pass tells which nodes have one in which bucket, their sets go there, and each bucket returns
    a spanning forest of the links that hold. Rows of both passes are bounded by the rows of the buckets, however many nodes are alike.
    """
    buckets = in_buckets(nodes, by_group=True)
    needed = keep(buckets.mapInArrow(_by_bucket(_to_compare), "bucket bigint, node bigint, block bigint, table int, half boolean"))
    whole = nodes.select("node", "label", "marks", "keys").join(sets.hint("merge"), "node")
    rows = needed.hint("merge").join(whole, "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    out = keep(rows.mapInArrow(_by_bucket(_forest), "a bigint, b bigint"))
    drop_table(needed)
    return out


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar: ``100 * common >= 75 * all``."""
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    near = pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").withColumn("common", common)
    return near.filter(100 * F.col("common") >= 75 * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def near_signatures(signatures: DataFrame) -> DataFrame:
    """Groups of ``signatures(lineage, genes)`` whose texts are near duplicates, and which row of each group stays.

    A text's set holds its distinct shingles of five words (ASCII lower case, parted by white space); two texts are linked if they share
    75 % of all their shingles. Returns ``lineage, n_shingles, component_id, kept``: the size of the set, the smallest lineage
    reachable over links, and whether it is this row's own.

    Equal sets become one node first. A node has two sides of small minhash collections; nodes that share no collection on either side drop
    out, the others meet in the tables of all pairs of collections. First each node is paired with its most agreeing partner; these pairs
    are confirmed on the full sets and joined into groups. A pass over all tables then finds which nodes are alike to nodes of other groups;
    their sets go to the table keys they share, block by block, and are compared there. So the rows that are made follow the nodes and their
    table keys, not the pairs, however many texts are copies or merely alike; comparisons inside a key still grow with the square of its
    rows. No candidate is dropped. Candidates are found by minhash: a pair at the limit is missed with a probability below 0.0004.

    Texts without words have empty sets and stay on their own. Repeated rows with one lineage share one outcome. Null lineages
    are last choice as a name: ``component_id`` is null only if all rows of the group have none, and ``kept`` compares nulls as equal. Empty
    tables give empty results; extra columns are left out.
    """
    rows = signature_rows(signatures).withColumn("digest", F.xxhash64("genes"))
    kind = rows.schema["lineage"].dataType.simpleString()
    sketched = keep(rows.mapInArrow(
        _sketch_columns, f"lineage {kind}, digest bigint, n_shingles bigint, set_id binary, keys array<bigint>, marks binary"))
    # One text of each set is read again, found by its lineage and digest; rows that share both hold the same text.
    nodes = keep(sketched.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min("lineage").alias("lineage"), F.min(F.struct("lineage", "digest")).alias("source"), F.first("n_shingles").alias("n_shingles"),
        F.first("keys").alias("keys"), F.first("marks").alias("marks")).withColumn("node", F.monotonically_increasing_id()))
    each = nodes.select("node", F.posexplode("keys").alias("pos", "key"))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    sides = (each.join(common.hint("merge"), "key", "left_semi").groupBy("node")
             .agg(*[F.collect_list(F.when(c, F.struct("pos", "key"))).alias(n) for n, c in (("left", F.col("pos") < COLLECTIONS),
                                                                                 ("right", F.col("pos") >= COLLECTIONS))])
             .filter((F.size("left") > 0) & (F.size("right") > 0)))
    close = keep(nodes.select("node", "set_id", "source", "n_shingles", "marks", "keys").join(sides, "node"))
    texts = rows.select(F.col("lineage").alias("_l"), F.col("digest").alias("_d"), "genes")
    same = (F.col("source.digest") == F.col("_d")) & F.col("source.lineage").eqNullSafe(F.col("_l"))
    sets = keep(close.select("node", "set_id", "source").hint("merge").join(texts, same)
                .select("node", "set_id", "genes").mapInArrow(_set_columns, "node bigint, items array<bigint>").dropDuplicates(["node"]))
    best = keep(best_partners(close.withColumn("label", F.col("node"))))
    links = keep(confirmed(best, sets))
    groups = connected(links)
    labelled = keep(close.select("node", "n_shingles", "marks", "keys", "left", "right").join(groups, "node", "left")
                    .withColumn("label", F.coalesce("group", "node")).drop("group"))
    drop_table(groups)
    more = links_of_groups(labelled, sets)
    groups = connected(links.unionByName(more))
    named = nodes.select("node", "set_id", "lineage").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    smallest = named.groupBy("group").agg(F.min("lineage").alias("component_id"))
    out = keep(named.select("set_id", "group").join(smallest, "group").select("set_id", "component_id"))
    joined = sketched.select("lineage", "n_shingles", "set_id").join(out, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("lineage")).otherwise(F.col("component_id"))
    result = keep(joined.select("lineage", "n_shingles", component.alias("component_id")))
    for table in (sketched, nodes, close, sets, best, links, labelled, more, groups, out):
        drop_table(table)
    return result.withColumn("kept", F.col("lineage").eqNullSafe(F.col("component_id")))
