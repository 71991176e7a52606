"""Sums over near pairs while cells are shuffled inside their blocks, tile by tile.

A permutation moves what cells hold only inside a block, so a tile of neighbouring blocks, with the blocks that its pairs reach, can shuffle on its own:
order follows from the ids. Packed cells and pairs of a tile meet in one task, every permutation is made there, and what leaves it is a number for each
permutation and pair of programs. No rows of cells x permutations exist.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweft.operators import spatial
from cellweft.operators.spatial import Near
from cellweft.session import discard, settle

SAMPLE, CELL, PROGRAM = "sample_id", "cell_id", "program_id"
TILE = [SAMPLE, "tile"]
#: Cells whose blocks make a tile. What one task may hold: cells, pairs of sites, and numbers of cells x programs.
TILE_CELLS, MOST_CELLS, MOST_PAIRS, MOST_NUMBERS = 32_768, 400_000, 4_000_000, 20_000_000
#: Numbers of gathered rows held at once.
SLAB = 2_000_000


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.StructArray]:
    """Which row each entry of a list column belongs to, and the entries."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    size = np.array(whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.repeat(np.arange(len(whole)), size), whole.flatten()


def _order(texts: list[bytes], tail: str, block: np.ndarray) -> np.ndarray:
    """Cells by block and, inside it, by the md5 of ``id:tail``; an id that is null leaves only the tail."""
    end, alone = b":" + tail.encode(), tail.encode()
    keys = np.frombuffer(b"".join([md5(t + end if t else alone).digest() for t in texts]), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return np.lexsort((keys[:, 1], keys[:, 0], block))


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by place; untouched where each place has one."""
    if len(at) == n and (at == np.arange(n)).all():
        return rows
    out = np.zeros((n, rows.shape[1]))
    np.add.at(out, at, rows)
    return out


class _Tile:
    """Cells of a tile and its surroundings: what each holds, the sites it is a member of, and pairs of sites."""

    def __init__(self, cells: pa.Table, pairs: pa.Table) -> None:
        ids = cells.column(CELL).combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.texts = [b"" if v is None else b"%d" % v for v in ids.to_pylist()]
        self.block = np.unique(cells.column("block").to_numpy(), return_inverse=True)[1]
        owner, held = _flat(cells.column("held"))
        program, frac = held.flatten()
        code = program.dictionary_encode()
        self.programs, n = code.dictionary, len(ids)
        self.frac, self.there = np.zeros((n, len(self.programs))), np.zeros((n, len(self.programs)))
        at = code.indices.to_numpy(zero_copy_only=False)
        self.frac[owner, at] = frac.fill_null(0.0).to_numpy(zero_copy_only=False)
        self.there[owner, at] = 1.0
        # Rows that repeat an id are slots of their own, and their cell holds what all of them get.
        names, cell = np.unique(ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
        self.known, self.cell, self.n_cells = known, cell[known], len(names)
        row, member = _flat(cells.column("sites"))
        site, times = [c.to_numpy(zero_copy_only=False) for c in member.flatten()]
        first = np.zeros(self.n_cells, dtype=np.int64)
        first[cell[known][::-1]] = np.flatnonzero(known)[::-1]
        once = known[row] & (first[cell[row]] == row)
        row, site, times = row[once], site[once], times[once]
        places, self.site = np.unique(site, return_inverse=True)
        order = np.argsort(self.site, kind="stable")
        self.site, self.member, self.times = self.site[order], cell[row[order]], times[order].astype(np.float64)[:, None]
        self.n_sites = len(places)
        own = np.zeros(self.n_sites, dtype=bool)
        own[self.site] = cells.column("own").to_numpy()[row[order]]
        crowd = own & (np.bincount(self.site, minlength=self.n_sites) > 1)
        self.crowd, self.crowded = np.flatnonzero(crowd), crowd[self.site]
        ends = [np.searchsorted(places, pairs.column(c).to_numpy()) for c in ("src", "dst")] if len(places) else [np.zeros(0, dtype=np.int64)] * 2
        ok = np.ones(len(ends[0]), dtype=bool)
        for e, c in zip(ends, ("src", "dst"), strict=True):
            if len(places):
                e[e == len(places)] = 0
                ok &= places[e] == pairs.column(c).to_numpy()
        self.src, self.dst = [e[ok] for e in ends]

    def sums(self, donors: np.ndarray, slots: np.ndarray, what: np.ndarray, flags: bool) -> np.ndarray:
        """Over pairs of cells, both orders, of the products of what they got; of ``flags``, how many pairs of rows met."""
        moved = np.empty_like(what)
        moved[slots] = what[donors]
        held = _summed(moved[self.known], self.cell, self.n_cells)
        each = np.minimum(held, 1.0)[self.member] if flags else held[self.member] * self.times
        sites = _summed(each, self.site, self.n_sites)
        total = np.zeros((what.shape[1],) * 2)
        step = max(SLAB // max(what.shape[1], 1), 1)
        for i in range(0, len(self.src), step):
            total += sites[self.src[i:i + step]].T @ sites[self.dst[i:i + step]]
        total += total.T.copy()
        if len(self.crowd):
            total += sites[self.crowd].T @ sites[self.crowd] - each[self.crowded].T @ each[self.crowded]
        return total


def _shuffle(n_perms: int):
    def run(key: tuple, cells: pa.Table, pairs: pa.Table) -> pa.Table:
        tile = _Tile(cells, pairs)
        k = len(tile.programs)
        met, values = np.zeros((k, k), dtype=bool), np.zeros((k, k, n_perms))
        if k:
            slots = _order(tile.texts, "base", tile.block)
            for p in range(n_perms):
                donors = _order(tile.texts, str(p + 1), tile.block)
                values[:, :, p] = tile.sums(donors, slots, tile.frac, False)
                if not met.all():
                    met |= tile.sums(donors, slots, tile.there, True) > 0.5
        i, j = np.nonzero(met)
        out = [pa.array([key[0].as_py()] * len(i), pa.string()), tile.programs.take(pa.array(i)), tile.programs.take(pa.array(j)),
               pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * n_perms), pa.array(values[i, j].ravel()))]
        return pa.table(dict(zip([SAMPLE, "i", "j", "v"], out, strict=True)))
    return run


def _tiles(blocks: DataFrame) -> DataFrame:
    """``(sample_id, block, n, tile)``: blocks along a curve over their grid, cut where they hold about ``TILE_CELLS``. Numbers of blocks only guide the cut."""
    sizes = blocks.groupBy(SAMPLE, "block").agg(F.count(F.lit(1)).alias("n"))
    side = F.max("block").over(Window.partitionBy(SAMPLE))
    wide = F.ceil(F.sqrt(side + 1)) + 1
    place = spatial.curve_place(F.floor(F.col("block") / wide) / wide, F.pmod("block", wide) / wide)
    before = F.sum("n").over(Window.partitionBy(SAMPLE).orderBy("_place", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return (sizes.withColumn("_place", place).withColumn("tile", F.floor(before / TILE_CELLS).cast("int")).select(SAMPLE, "block", "n", "tile"))


def shuffled_sums(near: Near, blocks: DataFrame, fractions: DataFrame, n_perms: int) -> tuple[DataFrame, DataFrame]:
    """``(sample_id, i, j, perm, value)`` of samples whose tiles fit a task, ``perm`` from 0, and the names of the other samples.

    A key has all permutations if a product exists in any of them. A sample is left out if a tile with what its pairs reach is too large (one block may hold
    a crowd, or a radius may span many blocks), or if an id stands in several blocks.
    """
    tiles = settle(_tiles(blocks))
    n_programs = fractions.select(PROGRAM).distinct().count()
    apart = blocks.filter(F.col(CELL).isNotNull()).groupBy(SAMPLE, CELL).agg(F.min("block").alias("a"), F.max("block").alias("b"))
    homes = settle(near.members.join(apart, [SAMPLE, CELL]).groupBy(SAMPLE, "site").agg(F.min("a").alias("block")).join(tiles.select(SAMPLE, "block", "tile"), [SAMPLE, "block"]))
    pairs = settle(near.pairs.join(homes.select(SAMPLE, F.col("site").alias("src"), "tile"), [SAMPLE, "src"])
                   .join(homes.select(SAMPLE, F.col("site").alias("dst"), "block"), [SAMPLE, "dst"]).select(*TILE, "src", "dst", "block"))
    own = tiles.select(SAMPLE, "block", F.col("tile").alias("home"))
    need = settle(pairs.select(*TILE, "block").unionByName(tiles.select(*TILE, "block")).distinct()
                  .join(own, [SAMPLE, "block"]).select(*TILE, "block", (F.col("tile") == F.col("home")).alias("own")))
    load = need.join(tiles.select(SAMPLE, "block", "n"), [SAMPLE, "block"]).groupBy(*TILE).agg(F.sum("n").alias("n"))
    most = min(MOST_CELLS, MOST_NUMBERS // max(n_programs, 1))
    large = load.filter(F.col("n") > most).select(SAMPLE).unionByName(pairs.groupBy(*TILE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_PAIRS).select(SAMPLE))
    odd = settle(large.unionByName(apart.filter("a <> b").select(SAMPLE)).distinct())
    kind = fractions.schema[PROGRAM].dataType.simpleString()
    each = fractions.groupBy(SAMPLE, CELL, PROGRAM).agg(F.sum(F.col("frac").cast("double")).alias("f"))
    held = each.groupBy(SAMPLE, CELL).agg(F.collect_list(F.struct(PROGRAM, "f")).alias("held"))
    sites = near.members.groupBy(SAMPLE, CELL).agg(F.collect_list(F.struct(F.col("site").cast("long").alias("site"), F.col("n").cast("long").alias("n"))).alias("sites"))
    cells = settle(blocks.select(SAMPLE, CELL, "block").join(odd, SAMPLE, "left_anti").join(held, [SAMPLE, CELL], "left").join(sites, [SAMPLE, CELL], "left"))
    listed = cells.join(need, [SAMPLE, "block"]).select(*TILE, F.col(CELL).cast("long").alias(CELL), F.col("block").cast("long").alias("block"), "own", "held", "sites")
    ends = pairs.join(odd, SAMPLE, "left_anti").select(*TILE, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    met = listed.groupBy(*TILE).cogroup(ends.groupBy(*TILE)).applyInArrow(_shuffle(n_perms), f"{SAMPLE} string, i {kind}, j {kind}, v array<double>")
    sums = settle(met.select(SAMPLE, "i", "j", F.posexplode("v").alias("perm", "value")).groupBy(SAMPLE, "i", "j", "perm").agg(F.sum("value").alias("value")))
    for table in (tiles, homes, pairs, need, cells):
        discard(table)
    return sums, odd
