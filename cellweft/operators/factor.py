"""Matrix factorisations as rounds of distributed sums.

Cells stay packed and distributed. What the driver holds and sends to tasks is genes x
components (at most a vocabulary times a few hundred), never anything that grows with cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, CELL, GENE = "sample_id", "cell_id", "gene"
BLOCK = 512


def vocabulary(expression: DataFrame) -> DataFrame:
    """``genes(gene_idx, gene)`` in name order."""
    genes = expression.select(GENE).distinct()
    return genes.select((F.row_number().over(Window.orderBy(GENE)) - 1).cast("int").alias("gene_idx"), GENE)


def pack(expression: DataFrame, genes: DataFrame, value: str) -> DataFrame:
    """One row per cell with its gene indices and values."""
    return (expression.join(genes, GENE).groupBy(SAMPLE, CELL)
                      .agg(F.sort_array(F.collect_list(F.struct("gene_idx", F.col(value).cast("double").alias("v")))).alias("_r"))
                      .select(SAMPLE, CELL, F.col("_r.gene_idx").alias("g"), F.col("_r.v").alias("v")))


def _blocks(pdf: pd.DataFrame, n_genes: int) -> Iterator[tuple[slice, np.ndarray]]:
    g, v = pdf["g"].to_numpy(), pdf["v"].to_numpy()
    for i in range(0, len(pdf), BLOCK):
        rows = slice(i, min(i + BLOCK, len(pdf)))
        n = np.array([len(a) for a in g[rows]])
        x = np.zeros((len(n), n_genes))
        if n.sum():
            x[np.repeat(np.arange(len(n)), n), np.concatenate(g[rows])] = np.concatenate(v[rows])
        yield rows, x


def matrix_sum(packed: DataFrame, n_genes: int, shape: tuple[int, int],
               part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(block)`` over all blocks of cells; partial sums per task, then per matrix row."""
    def run(batches):
        total = np.zeros(shape)
        for pdf in batches:
            for _, x in _blocks(pdf, n_genes):
                total += part(x)
        yield pd.DataFrame({"r": np.arange(shape[0], dtype=np.int32), "vals": list(total)})

    partial = packed.select("g", "v").mapInPandas(run, "r int, vals array<double>")
    summed = partial.select("r", F.posexplode("vals").alias("c", "s")).groupBy("r", "c").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(shape)
    out[summed["r"], summed["c"]] = summed["s"]
    return out


def singular_axes(packed: DataFrame, n_genes: int, k: int, rounds: int = 4, seed: int = 42) -> np.ndarray:
    """Leading right singular vectors (genes x k), not centred, by subspace iteration."""
    wide = min(n_genes, k + 8)
    axes, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_genes, wide)))
    image = axes
    for i in range(rounds):
        image = matrix_sum(packed, n_genes, (n_genes, wide), lambda x, a=axes: x.T @ (x @ a))
        if i + 1 < rounds:
            axes, _ = np.linalg.qr(image)
    values, rotation = np.linalg.eigh(axes.T @ image)
    return axes @ rotation[:, np.argsort(values)[::-1][:k]]


def project(packed: DataFrame, axes: np.ndarray) -> DataFrame:
    """Coordinates of every cell on the axes, as array ``pc``."""
    def run(batches):
        for pdf in batches:
            pc = [row for _, x in _blocks(pdf, axes.shape[0]) for row in x @ axes]
            yield pdf[[SAMPLE, CELL]].assign(pc=pc)

    return packed.mapInPandas(run, "sample_id string, cell_id long, pc array<double>")


def _weights(x: np.ndarray, h: np.ndarray, steps: int, eps: float = 1e-12) -> np.ndarray:
    """Non-negative weights of a block for a fixed dictionary (multiplicative updates)."""
    xh = x @ h.T
    # More programs than genes: their products with each other are never formed.
    hh = None if h.shape[0] > h.shape[1] else h @ h.T
    w = np.full((x.shape[0], h.shape[0]), 1.0)
    w *= (x.sum(1, keepdims=True) + eps) / (w @ h.sum(1, keepdims=True) + eps)
    ratio = np.empty_like(w)
    for _ in range(steps):
        np.matmul(w @ h if hh is None else w, h.T if hh is None else hh, out=ratio)
        ratio += eps
        np.divide(xh, ratio, out=ratio)
        w *= ratio
    return w


def _pull(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """What ``dictionary_pull`` needs of a block, the narrower of w'w and w'(wh), and the sum of squares of wh."""
    if h.shape[0] > h.shape[1]:
        both = w.T @ (w @ h)
        return both, float((both * h).sum())
    ww = w.T @ w
    return ww, float((ww * (h @ h.T)).sum())


def dictionary_pull(total: np.ndarray, h: np.ndarray) -> np.ndarray:
    """w'w h of all cells from the summed blocks."""
    return total if h.shape[0] > h.shape[1] else total @ h


def factorize(packed: DataFrame, n_genes: int, start: np.ndarray, rounds: int, steps: int = 30,
              tolerance: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """Non-negative dictionary (components x genes) and its loss per round.

    Every round is one read of the cells: their weights follow from the dictionary, and only
    components x genes sums come back. Rounds end when the relative gain is below the
    tolerance; a round that does not improve is not kept.
    """
    h = np.maximum(start, 1e-9)
    k = h.shape[0]
    best, losses = h, []

    def part(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = _weights(x, h, steps)
        wx = w.T @ x
        ww, square = _pull(w, h)
        loss = (x * x).sum() - 2.0 * (wx * h).sum() + square
        tail = np.zeros((k, 1))
        tail[0, 0] = loss
        return np.hstack([wx, ww, tail])

    for _ in range(rounds):
        total = matrix_sum(packed, n_genes, (k, n_genes + min(k, n_genes) + 1), lambda x, h=h: part(x, h))
        loss = float(max(total[0, -1], 0.0))
        if losses and loss >= losses[-1]:
            break
        best = h
        done = bool(losses) and (losses[-1] - loss) <= tolerance * max(losses[0], 1e-12)
        losses.append(loss)
        if done:
            break
        h = h * (total[:, :n_genes] / (dictionary_pull(total[:, n_genes:-1], h) + 1e-12))
    return best, losses


def split_sums(packed: DataFrame, n_genes: int, h: np.ndarray, steps: int = 30) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """One read of ``packed(g, v, is_train)``: sums w'x and w'wh of the training cells, the errors per value of training and held-out cells, and how much
    of a training cell its largest program holds, per cent.

    Held-out cells get weights for the dictionary as it is and are only measured: nothing of them enters the sums.
    """
    k = h.shape[0]
    narrow = min(k, n_genes)
    wide = n_genes + narrow + 6

    def run(batches):
        total = np.zeros((k, wide))
        for pdf in batches:
            for train in (True, False):
                part = pdf[pdf["is_train"] == train]
                for _, x in _blocks(part, n_genes):
                    w = _weights(x, h, steps)
                    wx = w.T @ x
                    ww, square = _pull(w, h)
                    at = -4 if train else -2
                    total[0, at] += (x * x).sum() - 2.0 * (wx * h).sum() + square
                    total[0, at + 1] += x.size
                    if train:
                        total[0, -6] += (w.max(1) / (w.sum(1) + 1e-12)).sum()
                        total[0, -5] += len(w)
                        total[:, :n_genes] += wx
                        total[:, n_genes:n_genes + narrow] += ww
        yield pd.DataFrame({"r": np.arange(k, dtype=np.int32), "vals": list(total)})

    rows = packed.select("g", "v", "is_train").mapInPandas(run, "r int, vals array<double>")
    summed = rows.select("r", F.posexplode("vals").alias("c", "s")).groupBy("r", "c").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((k, wide))
    out[summed["r"], summed["c"]] = summed["s"]
    errors = [max(out[0, at], 0.0) / out[0, at + 1] if out[0, at + 1] else float("nan") for at in (-4, -2)]
    sharp = 100.0 * out[0, -6] / out[0, -5] if out[0, -5] else float("nan")
    return out[:, :n_genes], dictionary_pull(out[:, n_genes:n_genes + narrow], h), errors[0], errors[1], sharp


def cell_weights(packed: DataFrame, dictionary: np.ndarray, steps: int = 30) -> DataFrame:
    """Weights of every cell for a dictionary: ``(sample_id, cell_id, program_id, weight)``."""
    def run(batches):
        for pdf in batches:
            w = [row for _, x in _blocks(pdf, dictionary.shape[1]) for row in _weights(x, dictionary, steps)]
            yield pdf[[SAMPLE, CELL]].assign(w=w)

    packed_w = packed.mapInPandas(run, "sample_id string, cell_id long, w array<double>")
    return packed_w.select(SAMPLE, CELL, F.posexplode("w").alias("program_id", "weight"))


def dictionary_table(spark, dictionary: np.ndarray, genes: DataFrame, least: float = 0.0) -> DataFrame:
    """``programs(program_id, gene, weight)`` from a dictionary in vocabulary order."""
    k, g = np.nonzero(dictionary > least)
    table = spark.createDataFrame(pa.table({"program_id": pa.array(k, pa.int32()), "gene_idx": pa.array(g, pa.int32()), "weight": pa.array(dictionary[k, g], pa.float64())}))
    return table.join(genes, "gene_idx").select("program_id", GENE, "weight")


def dictionary_matrix(programs: DataFrame, genes: DataFrame) -> np.ndarray:
    """The reverse; programs x genes numbers come to the driver."""
    n = genes.count()
    p = programs.join(genes, GENE).select("program_id", "gene_idx", "weight").toPandas()
    out = np.zeros((int(p["program_id"].max()) + 1 if len(p) else 0, n))
    out[p["program_id"], p["gene_idx"]] = p["weight"]
    return out
