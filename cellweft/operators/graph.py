"""Weighted neighbour graphs ``edges(sample_id, src, dst, weight)`` and what runs on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweft.functions.scalar import EPS, clamp, gaussian_decay, softplus
from cellweft.operators import blocks, spatial
from cellweft.operators.ordering import exact_quantiles
from cellweft.session import settle

SAMPLE, CELL, GENE = "sample_id", "cell_id", "gene"


def endpoint(attributes: DataFrame, end: str, **renames: str) -> DataFrame:
    """Attribute table keyed by one end of an edge, columns renamed."""
    return attributes.select(SAMPLE, F.col(CELL).alias(end), *[F.col(c).alias(n) for c, n in renames.items()])


def attach_attributes(edges: DataFrame, attributes: DataFrame, column: str) -> DataFrame:
    """Both endpoints' values next to each edge, as ``<column>_src`` and ``<column>_dst``."""
    return (edges.join(endpoint(attributes, "src", **{column: f"{column}_src"}), [SAMPLE, "src"])
                 .join(endpoint(attributes, "dst", **{column: f"{column}_dst"}), [SAMPLE, "dst"]))


def cell_norms(expression: DataFrame, value: str = "lognorm") -> DataFrame:
    v = F.col(value)
    return expression.groupBy(SAMPLE, CELL).agg(F.sqrt(F.sum(v * v)).alias("norm"))


def edge_cosine(cells: DataFrame, edges: DataFrame, expression: DataFrame, value: str = "lognorm") -> DataFrame:
    """Cosine of the endpoints' expression on every edge, block by block; cells without rows have norm 1e-9."""
    return blocks.edge_cosines(cells, edges, expression, value, EPS)


def edge_cosine_packed(edges: DataFrame, vectors: DataFrame, column: str = "vec") -> DataFrame:
    """The same on dense arrays: one row per edge, no explosion."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    sized = vectors.select(SAMPLE, CELL, F.struct(F.col(column).alias("v"), F.sqrt(dot(F.col(column), F.col(column))).alias("n")).alias("_a"))
    both = attach_attributes(edges, sized, "_a")
    n = [F.when(F.col(f"_a_{e}.n") == 0, F.lit(EPS)).otherwise(F.col(f"_a_{e}.n")) for e in ("src", "dst")]
    return both.withColumn("sim", dot(F.col("_a_src.v"), F.col("_a_dst.v")) / (n[0] * n[1])).drop("_a_src", "_a_dst")


def zscore_prune(edges: DataFrame, floor: float = -0.5) -> DataFrame:
    """Drop edges whose similarity is low among those of the same source."""
    w = Window.partitionBy(SAMPLE, "src")
    z = (F.col("sim") - F.avg("sim").over(w)) / (F.stddev_pop("sim").over(w) + EPS)
    return edges.withColumn("z", z).filter(F.col("z") > floor)


def bandwidth(edges: DataFrame) -> DataFrame:
    return exact_quantiles(edges, [SAMPLE], "dist", {"bandwidth": 0.5}).withColumn("bandwidth", F.col("bandwidth") + EPS)


def decay_weights(edges: DataFrame) -> DataFrame:
    return (edges.join(bandwidth(edges), SAMPLE)
                 .withColumn("weight", gaussian_decay(F.col("dist"), F.col("bandwidth")) * F.col("sim")).drop("bandwidth"))


def symmetric_normalize(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions plus self loops of 1, scaled by the roots of both degrees.

    Edges are dealt twice, by each end: the degree of the first end is a sum over its edges where they lie, that of the other one is looked up.
    """
    loops = cells.select(SAMPLE, F.col(CELL).alias("src"), F.col(CELL).alias("dst"), F.lit(1.0).alias("weight"))
    turns = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    full = edges.select(SAMPLE, turns.alias("e"), "weight").select(SAMPLE, "e.src", "e.dst", "weight").unionByName(loops)
    w = F.sum("weight").over(Window.partitionBy(SAMPLE, "src"))
    full = settle(full.filter(F.col(SAMPLE).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
                  .withColumn("rs", F.when(w > 0, 1 / F.sqrt(w)).otherwise(F.lit(0.0))))
    degree = full.groupBy(SAMPLE, F.col("src").alias("dst")).agg(F.first("rs").alias("rd"))
    return full.join(degree, [SAMPLE, "dst"]).select(SAMPLE, "src", "dst", (F.col("weight") * F.col("rs") * F.col("rd")).alias("weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(SAMPLE, F.col("src").alias(CELL)).agg(F.sum("weight").alias("degree"))


def spatial_graph(cells: DataFrame, expression: DataFrame | None = None, vectors: DataFrame | None = None,
                  k: int = 11, value: str = "lognorm") -> DataFrame:
    """Neighbour graph weighted by distance and expression similarity, symmetrically normalised."""
    near = spatial.knn_join(cells, k - 1).drop("rank")
    scored = edge_cosine_packed(near, vectors) if vectors is not None else edge_cosine(cells, near, expression, value)
    kept = settle(zscore_prune(scored))
    return symmetric_normalize(cells, spatial.undirected_distinct(decay_weights(kept), "weight"))


def edge_softmax(edges: DataFrame, score: str, out: str = "attention") -> DataFrame:
    """Softmax of edge scores over the edges that share a destination; edges without a sample or destination are left out.

    A window, not a join with sums: ``edges`` is computed once, and stays where it lies if it is dealt by destination already.
    """
    e = edges.filter(F.col(SAMPLE).isNotNull() & F.col("dst").isNotNull()).withColumn("_e", F.exp(clamp(F.col(score), -60.0, 60.0)))
    total = F.sum("_e").over(Window.partitionBy(SAMPLE, "dst"))
    return e.withColumn(out, F.col("_e") / (total + EPS)).drop("_e")


def bilateral_weights(edges: DataFrame, projection: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Edge weights shrunk by the squared distance of the endpoints' program scores (arrays)."""
    both = attach_attributes(edges, projection, "b")
    gap = F.aggregate(F.zip_with("b_src", "b_dst", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return both.withColumn("weight", F.col("weight") * F.exp(-softplus(F.lit(gamma)) * gap)).drop("b_src", "b_dst")


def propagate(features: DataFrame, edges: DataFrame, rounds: int, alpha: float, item: str = GENE,
              value: str = "h", score: str = "weight", attention: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """``h <- (1-a) * weighted mean of neighbours + a * h0``, for a fixed number of rounds.

    ``features(sample_id, cell_id, item, h)`` is sparse. Messages go from src to dst. With the coordinates of ``cells``, cells that are
    near each other are worked on together and meet most of their neighbours in one place; without, those of near ids.
    """
    base = features.select(SAMPLE, CELL, item, value)
    if not rounds:
        return base
    wired = edge_softmax(edges, score, "_w") if attention else edges.withColumn("_w", F.col(score))
    return blocks.spread(cells, wired, "_w", base, rounds, alpha, item, value, dealt=attention)


def neighbour_attention(cells: DataFrame, edges: DataFrame, qkv: DataFrame) -> DataFrame:
    """Scaled dot-product attention of each cell over its neighbours and itself; ``qkv`` holds arrays q, k, v."""
    loops = cells.select(SAMPLE, F.col(CELL).alias("src"), F.col(CELL).alias("dst"))
    wired = edges.select(SAMPLE, "src", "dst").unionByName(loops)
    both = (wired.join(endpoint(qkv, "src", k="k", v="v"), [SAMPLE, "src"]).join(endpoint(qkv, "dst", q="q"), [SAMPLE, "dst"]))
    dot = F.aggregate(F.zip_with("q", "k", lambda p, r: p * r), F.lit(0.0), lambda s, x: s + x)
    att = edge_softmax(both.withColumn("score", dot / F.sqrt(F.size("q"))), "score", "att")
    return (att.select(SAMPLE, F.col("dst").alias(CELL), "att", F.posexplode("v").alias("pos", "v"))
               .groupBy(SAMPLE, CELL, "pos").agg(F.sum(F.col("att") * F.col("v")).alias("value")))


def khop_expand(seeds: DataFrame, edges: DataFrame, hops: int, group: str = "chunk_id") -> DataFrame:
    """Cells within ``hops`` non-zero edges of each group's seeds: ``(sample_id, group, cell_id)``."""
    links = spatial.both_directions(edges.filter("src <> dst and weight <> 0").select(SAMPLE, "src", "dst")).distinct()
    reached = seeds.select(SAMPLE, group, CELL).distinct()
    for i in range(hops):
        step = links.join(reached.withColumnRenamed(CELL, "src"), [SAMPLE, "src"]).select(SAMPLE, group, F.col("dst").alias(CELL))
        reached = reached.unionByName(step).distinct()
        if i + 1 < hops:
            reached = settle(reached)
    return reached


def induced_subgraph(members: DataFrame, edges: DataFrame, group: str = "chunk_id") -> DataFrame:
    """Edges with both ends in the same group."""
    left = members.select(SAMPLE, group, F.col(CELL).alias("src"))
    right = members.select(SAMPLE, group, F.col(CELL).alias("dst"))
    return edges.join(left, [SAMPLE, "src"]).join(right, [SAMPLE, group, "dst"], "left_semi")


def label_propagation(nodes: DataFrame, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Deterministic communities on ``links(a, b, weight)``: every node takes the heaviest label around it.

    The own label keeps a vote, ties go to the lowest label, and rounds stop when nothing
    changes or when labels start to repeat: the state of a round is the exclusive or of its
    rows' hashes, which no order of rows can change. Reaching ``max_rounds`` before that is an error.
    """
    both = settle(links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
                       .groupBy("a", "b").agg(F.max("weight").alias("weight")))
    own = both.groupBy("a").agg((F.max("weight") * 0.5).alias("own"))
    labels = settle(nodes.select("node").withColumn("label", F.col("node")))
    seen: set[int] = set()
    for _ in range(max_rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        mine = labels.withColumnRenamed("node", "a").join(own, "a").select("a", "label", F.col("own").alias("w"))
        total = votes.unionByName(mine).groupBy("a", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = total.groupBy(F.col("a").alias("node")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("_new"))
        labels = settle(labels.join(best, "node", "left").select("node", F.coalesce("_new", "label").alias("label")))
        state = labels.agg(F.bit_xor(F.xxhash64("node", "label"))).first()[0]
        if state in seen:
            break
        seen.add(state)
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    w = Window.orderBy("_first")
    ids = labels.groupBy("label").agg(F.min("node").alias("_first")).withColumn("domain", (F.row_number().over(w) - 1).cast("int"))
    return labels.join(ids, "label").select("node", "domain")
