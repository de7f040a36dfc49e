"""Spectral partitions of many networks at once.

A network's similarity is normalised by the roots of its nodes' strengths. Its leading eigenvectors come from block subspace
iteration: a node keeps a row of the block, a product with the matrix is a join with the links and a sum for each node, and the block
is made orthonormal again by the Gram matrix, a sum of small outer products for each network. Rows are then clustered by keyed
k-means. All networks share the jobs; per network only matrices of the block's width are ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import mirrored
from .lineage import cut

NET = ["network_id"]
ROW = "array<double>"


def _normalised(edges: DataFrame) -> DataFrame:
    """(network_id, u, v, w), each edge both ways, the weight over the roots of both ends' strengths. Edges without a positive weight
    don't count."""
    links = cut(mirrored(edges).filter("w > 0 and u <> v"))
    strength = cut(links.groupBy("network_id", "u").agg(F.sum("w").alias("k")))
    out = links.join(strength, ["network_id", "u"]).join(strength.withColumnsRenamed({"u": "v", "k": "kv"}), ["network_id", "v"])
    return cut(out.select("network_id", "u", "v", (F.col("w") / F.sqrt(F.col("k") * F.col("kv"))).alias("w")))


def _times(rows: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """rows (network_id, node, x) -> (x + links x) / 2: the matrix is shifted so that its largest eigenvalues are its leading ones."""
    sent = rows.join(links.withColumnRenamed("v", "node"), ["network_id", "node"]).select("network_id", F.col("u").alias("node"), F.transform("x", lambda c: c * F.col("w")).alias("x"))
    both = sent.unionByName(rows).groupBy("network_id", "node").agg(*[F.sum(F.col("x")[i]).alias(f"c{i}") for i in range(width)])
    return both.select("network_id", "node", F.array(*[F.col(f"c{i}") / 2 for i in range(width)]).alias("x"))


def _whitener(g: np.ndarray) -> np.ndarray:
    """The matrix that makes a block with this Gram matrix orthonormal; directions of (nearly) no length become 0."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    scale = np.where(values > max(values.max(), 0) * 1e-14, 1 / np.sqrt(np.where(values > 0, values, 1)), 0)
    return vectors * scale


def _ritz(flat: np.ndarray, width: int) -> np.ndarray:
    """From the Gram matrix of a block, that of the block with its product, and that of the product: what turns the block into its best
    eigenvectors, their eigenvalues, largest first, and residuals, all flat."""
    g, h, s = flat.reshape(3, width, width)
    white = _whitener(g)
    values, vectors = np.linalg.eigh(white.T @ (h + h.T) @ white / 2)
    turn, values = white @ vectors[:, ::-1], values[::-1]
    left = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, s, turn) - values**2, 0))
    return np.concatenate([turn.ravel(), values, left])


def _small(width: int):
    """A Column function: ``_ritz`` of flat matrices."""

    def of(column: pa.Array) -> pa.Array:
        return pa.array([None if g is None else _ritz(np.array(g), width).tolist() for g in column.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(of, ROW)


def _turned(rows: DataFrame, turn: DataFrame, width: int) -> DataFrame:
    """rows times the network's small matrix (network_id, t)."""
    cell = lambda j: sum((F.col("x")[i] * F.col("t")[i * width + j] for i in range(1, width)), F.col("x")[0] * F.col("t")[j])
    return rows.join(turn, "network_id").select("network_id", "node", F.array(*[cell(j) for j in range(width)]).alias("x"))


def subspace(edges: DataFrame, k: int, spare: int = 6, tolerance: float = 1e-9, steps: int = 6, most_rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """(network_id, node, x) and (network_id, eigenvalues): the ``k`` leading eigenvectors of each network's normalised similarity, as
    a row for each node with an edge of positive weight, and their eigenvalues, largest first (0 beyond the number of nodes).

    ``spare`` more vectors are carried along, which speeds up convergence; a round is ``steps`` products and one aggregate, from which
    the small matrices of all networks follow. Rounds end when no eigenvalue of any network moves by more than ``tolerance`` and no
    residual exceeds its root.
    """
    width = k + spare
    links = _normalised(edges)
    start = F.array(*[F.hash("node", F.lit(i)).cast("double") / 2.0**31 for i in range(width)])
    rows = links.select("network_id", F.col("u").alias("node")).distinct().select("network_id", "node", start.alias("x"))
    size = rows.groupBy("network_id").count()
    cells = [(i, j) for i in range(width) for j in range(width)]
    before = None
    for _ in range(most_rounds):
        for _ in range(steps):
            rows = _times(rows, links, width)
        rows = cut(rows)
        both = rows.join(_times(rows, links, width).withColumnRenamed("x", "y"), ["network_id", "node"])
        sums = F.array(*[F.sum(F.col(a)[i] * F.col(b)[j]) for a, b in (("x", "x"), ("x", "y"), ("y", "y")) for i, j in cells])
        now = cut(both.groupBy("network_id").agg(sums.alias("g")).select("network_id", _small(width)("g").alias("r")))
        rows = _turned(rows, now.select("network_id", F.slice("r", 1, width * width).alias("t")), width)
        now = now.select("network_id", F.slice("r", width * width + 1, k).alias("v"), F.array_max(F.slice("r", width * width + width + 1, k)).alias("left"))
        if before is not None:
            moved = F.array_max(F.zip_with("v", "o", lambda a, b: F.abs(a - b)))
            if now.join(before.select("network_id", F.col("v").alias("o")), "network_id").filter((moved > tolerance) | (F.col("left") > tolerance**0.5)).isEmpty():
                break
        before = now
    else:
        raise RuntimeError(f"eigenvectors still move after {most_rounds} rounds")
    values = now.join(size, "network_id").select("network_id", F.transform("v", lambda v, i: F.when(i < F.col("count"), 2 * v - 1).otherwise(0.0)).alias("eigenvalues"))
    return cut(rows).select("network_id", "node", F.slice("x", 1, k).alias("x")), values


def _away(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def keyed_kmeans(points: DataFrame, k: int, by: list[str] = NET, most_rounds: int = 100) -> DataFrame:
    """points (by, node, x) -> (by, node, cluster): k-means within each group, clusters numbered from 0 by their smallest node.

    The first centre is the point furthest from the group's mean, each further one the point furthest from all before (ties: the
    smallest node), so results depend on the data alone. A group of fewer distinct points than ``k`` gets fewer clusters. Rounds end
    when no point changes its cluster in any group; each is one aggregate over all groups.
    """
    width = points.select(F.max(F.size("x"))).first()[0] or 0
    points = cut(points.select(*by, "node", "x"))
    mean = lambda df, keys: df.groupBy(*keys).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("m"))
    far = points.join(mean(points, by), by).select(*by, "node", "x", _away("x", "m").alias("d"))
    centres = None
    for place in range(k):
        picked = far.filter("d > 1e-24").groupBy(*by).agg(F.min(F.struct((-F.col("d")).alias("d"), "node", "x")).alias("b"))
        if place == 0:  # points that are all alike still make a cluster
            picked = far.groupBy(*by).agg(F.min(F.struct((-F.col("d")).alias("d"), "node", "x")).alias("b"))
        picked = picked.select(*by, F.lit(place).alias("cluster"), F.col("b.x").alias("c"))
        centres = cut(picked if centres is None else centres.unionByName(picked))
        if place < k - 1:
            near = points.join(centres, by).groupBy(*by, "node", "x").agg(F.min(_away("x", "c")).alias("d"))
            far = cut(near)
    found = None
    for _ in range(most_rounds):
        options = points.join(centres, by).groupBy(*by, "node", "x").agg(F.min(F.struct(F.round(_away("x", "c"), 14).alias("d"), "cluster")).alias("b"))
        new = options.select(*by, "node", "x", F.col("b.cluster").alias("cluster"))
        if found is not None:
            new = new.join(found.select(*by, "node", F.col("cluster").alias("_was")), [*by, "node"])
        new = cut(new)
        done = found is not None and new.filter("cluster <> _was").isEmpty()
        found = new.drop("_was")
        if done:
            break
        centres = cut(mean(found, [*by, "cluster"]).withColumnRenamed("m", "c"))
    else:
        raise RuntimeError(f"clusters still change after {most_rounds} rounds")
    first = Window.partitionBy(*by, "cluster")
    named = found.withColumn("_first", F.min("node").over(first))
    order = named.select(*by, "cluster", "_first").distinct().withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1)
    return named.join(order.select(*by, "cluster", "number"), [*by, "cluster"]).select(*by, "node", F.col("number").alias("cluster"))


def partition(edges: DataFrame, k: int, tolerance: float = 1e-4, **options) -> DataFrame:
    """(network_id, node, cluster): ``k`` clusters of the nodes that have an edge of positive weight, by k-means on the rows of the
    leading eigenvectors, each row over its length. Eigenvalues to ``tolerance`` will do for clusters; where those beyond the k-th are
    about as large there are no clear clusters anyway."""
    rows, _ = subspace(edges, k, tolerance=tolerance, **options)
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    unit = rows.select("network_id", "node", F.transform("x", lambda c: F.round(F.coalesce(F.try_divide(c, length), F.lit(0.0)), 12)).alias("x"))
    return keyed_kmeans(unit, k)


def power_iteration(edges: DataFrame, k: int, steps: int = 20, at_once: int = 5) -> DataFrame:
    """(network_id, node, cluster): k-means of one vector, which a few products with the row-normalised similarity have smoothed from
    the nodes' strengths. Cheaper than ``partition``, for clusters that are well apart."""
    links = cut(mirrored(edges).filter("w > 0 and u <> v"))
    strength = cut(links.groupBy("network_id", "u").agg(F.sum("w").alias("k")))
    share = cut(links.join(strength, ["network_id", "u"]).select("network_id", "u", F.col("v").alias("node"), (F.col("w") / F.col("k")).alias("w")))
    total = strength.groupBy("network_id").agg(F.sum("k").alias("total"))
    x = cut(strength.join(total, "network_id").select("network_id", F.col("u").alias("node"), (F.col("k") / F.col("total")).alias("x")))
    for step in range(steps):
        x = x.join(share, ["network_id", "node"]).groupBy("network_id", F.col("u").alias("node")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))
        if step % at_once == at_once - 1 or step == steps - 1:
            x = cut(x)
            x = x.join(x.groupBy("network_id").agg(F.sum("x").alias("_s")), "network_id").select("network_id", "node", (F.col("x") / F.col("_s")).alias("x"))
    span = x.groupBy("network_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    scaled = x.join(span, "network_id").select("network_id", "node", F.array(F.round(F.coalesce(F.try_divide(F.col("x") - F.col("a"), F.col("b") - F.col("a")), F.lit(0.0)), 9)).alias("x"))
    return keyed_kmeans(scaled, k)
