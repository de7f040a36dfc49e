"""Weighted undirected graphs of items, many at once.

``nodes`` is (network_id, node), ``edges`` (network_id, left_item, right_item, similarity) with left_item < right_item. Every
operator works on all networks in the same job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.stats import correlation

from .lineage import cut

NET = ["network_id"]


def threshold(edges: DataFrame, tau: float, inclusive: bool = True) -> DataFrame:
    return edges.filter(F.col("similarity") >= tau if inclusive else F.col("similarity") > tau)


def mirrored(edges: DataFrame) -> DataFrame:
    """(network_id, u, v, w), each edge both ways."""
    keep = ["network_id", F.col("similarity").alias("w")]
    one = edges.select(*keep, F.col("left_item").alias("u"), F.col("right_item").alias("v"))
    return one.unionByName(edges.select(*keep, F.col("right_item").alias("u"), F.col("left_item").alias("v"))).select("network_id", "u", "v", "w")


def thin(edges: DataFrame, per_node: int, mutual: bool = False, most: int | None = None) -> DataFrame:
    """The strongest edges of each node: those that either end keeps, or (``mutual``) both; at most ``most`` a network."""
    ranked = mirrored(edges).withColumn("k", F.row_number().over(Window.partitionBy("network_id", "u").orderBy(F.desc("w"), "v"))).filter(F.col("k") <= per_node)
    ends = ranked.groupBy("network_id", F.least("u", "v").alias("left_item"), F.greatest("u", "v").alias("right_item")).agg(F.first("w").alias("similarity"), F.count("*").alias("ends"))
    out = ends.filter(F.col("ends") >= (2 if mutual else 1)).drop("ends")
    if most is not None:
        out = out.withColumn("k", F.row_number().over(Window.partitionBy("network_id").orderBy(F.desc("similarity"), "left_item", "right_item"))).filter(F.col("k") <= most).drop("k")
    return out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, node, degree, strength, centrality), isolated nodes too."""
    d = mirrored(edges).groupBy("network_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    size = nodes.groupBy("network_id").agg(F.count("*").alias("_n"))
    out = nodes.join(d, ["network_id", "node"], "left").fillna(0, ["degree"]).fillna(0.0, ["strength"]).join(size, "network_id")
    return out.withColumn("centrality", F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0)).drop("_n")


def _wedges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (network_id, a, b, w) from the node of the lower degree to that of the higher (ties by name), and pairs of edges that
    leave the same node: (network_id, a, b, c, w1, w2). No node has more than sqrt(2m) edges out, so a hub makes few pairs."""
    degree = cut(edges.select("network_id", F.explode(F.array("left_item", "right_item")).alias("u")).groupBy("network_id", "u").agg(F.count("*").alias("k")))
    side = lambda s: degree.select("network_id", F.col("u").alias(f"{s}_item"), F.struct("k", F.col("u").alias("name")).alias(s))
    out = edges.join(side("left"), ["network_id", "left_item"]).join(side("right"), ["network_id", "right_item"])
    out = cut(out.select("network_id", F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"), "w"))
    pairs = out.withColumnRenamed("w", "w1").join(out.select("network_id", "a", F.col("b").alias("c"), F.col("w").alias("w2")), ["network_id", "a"]).filter("b < c")
    return out, pairs


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, clustering, weighted_clustering): means over all nodes; the weighted one takes the cube root of the product of
    a triangle's weights, each over the network's largest, and is 0 where no weight is above 0."""
    edges = cut(edges)
    most = edges.groupBy("network_id").agg(F.max("similarity").alias("top"))
    e = edges.join(most, "network_id").select("network_id", "left_item", "right_item", F.when(F.col("top") > 0, F.col("similarity") / F.col("top")).otherwise(0.0).alias("w"))
    out, pairs = _wedges(e)
    triangles = pairs.join(out.select("network_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w3")), ["network_id", "b", "c"]).withColumn("x", F.cbrt(F.col("w1") * F.col("w2") * F.col("w3")))
    at = triangles.select("network_id", "x", F.explode(F.array("a.name", "b.name", "c.name")).alias("node")).groupBy("network_id", "node").agg(F.count("*").alias("t"), F.sum("x").alias("tw"))
    d = degrees(nodes, edges).join(at, ["network_id", "node"], "left").fillna(0, ["t"]).fillna(0.0, ["tw"])
    pairs = F.col("degree") * (F.col("degree") - 1)
    share = lambda x: F.avg(F.when(pairs > 0, 2 * F.col(x) / pairs).otherwise(0.0))
    return d.groupBy("network_id").agg(share("t").alias("clustering"), share("tw").alias("weighted_clustering"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(network_id, n_nodes, n_edges, density, mean_degree, mean_strength, assortativity)."""
    edges = cut(edges)
    d = cut(degrees(nodes, edges))
    base = d.groupBy("network_id").agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.avg("strength").alias("mean_strength"))
    n = F.col("n_nodes")
    base = base.withColumn("density", F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0))
    both = mirrored(edges).join(d.select("network_id", F.col("node").alias("u"), F.col("degree").alias("du")), ["network_id", "u"]).join(d.select("network_id", F.col("node").alias("v"), F.col("degree").alias("dv")), ["network_id", "v"])
    return base.join(both.groupBy("network_id").agg(correlation("du", "dv").alias("assortativity")), "network_id", "left")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(network_id, node, component): the smallest node that can be reached. Labels spread by minima and then jump to their
    label's label; a table ends each round. Labels that still move after ``max_rounds`` are an error."""
    links = mirrored(edges).select("network_id", "u", "v").persist()
    labels = cut(nodes.select("network_id", "node", F.col("node").alias("component")))
    for _ in range(max_rounds):
        seen = labels.withColumnRenamed("node", "v").join(links, ["network_id", "v"]).groupBy("network_id", F.col("u").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(seen, ["network_id", "node"], "left").select("network_id", "node", F.least("component", "m").alias("m"), "component")
        jump = new.select("network_id", F.col("node").alias("m"), F.col("m").alias("mm"))
        new = cut(new.join(jump, ["network_id", "m"], "left").select("network_id", "node", F.least("m", "mm").alias("component"), (F.least("m", "mm") != F.col("component")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            links.unpersist()
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def modularity(edges: DataFrame, communities: DataFrame, gamma: float = 1.0, keys: list[str] = NET) -> DataFrame:
    """(keys, modularity) of (keys, node, community) on edges keyed alike; 0 where all weights are 0."""
    side = lambda s: communities.select(*keys, F.col("node").alias(s), F.col("community").alias(f"c_{s}"))
    e = edges.join(side("left_item"), [*keys, "left_item"]).join(side("right_item"), [*keys, "right_item"])
    total = e.groupBy(*keys).agg(F.sum("similarity").alias("m"))
    inside = e.filter("c_left_item = c_right_item").groupBy(*keys, F.col("c_left_item").alias("community")).agg(F.sum("similarity").alias("w_in"))
    ends = e.select(*keys, F.explode(F.array("c_left_item", "c_right_item")).alias("community"), "similarity").groupBy(*keys, "community").agg(F.sum("similarity").alias("k"))
    rows = ends.join(inside, [*keys, "community"], "left").join(total, keys)
    share = F.try_divide(F.coalesce("w_in", F.lit(0.0)), F.col("m")) - gamma * F.pow(F.try_divide("k", 2 * F.col("m")), F.lit(2.0))
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(share, F.lit(0.0))).alias("modularity"))


def louvain(nodes: DataFrame, edges: DataFrame, runs: DataFrame, rounds: int = 12, most_rounds: int = 10_000) -> DataFrame:
    """Communities by local moves and contraction, for every run (network_id, gamma, seed) at once: (network_id, gamma, seed, node,
    community), a community named by its smallest node.

    In the first ``rounds`` of a level only nodes whose hash with the seed and the round is even may move, each to the neighbouring
    community of the best positive gain (ties: the smallest name); so two nodes seldom swap for ever. Later a move takes place only
    if it is the best of all that leave or enter either of its two communities: such gains add up, so modularity rises with every
    round and rounds end when nothing can move. Levels end when none contracts any more. A level of ``most_rounds`` is an error.
    Isolated nodes stay alone, and so do all nodes of a network whose weights are all 0. The result depends on the data and the seed alone.
    """
    keys = ["network_id", "gamma", "seed"]
    member = cut(nodes.join(runs, "network_id").select(*keys, "node", F.col("node").alias("top")))
    links = cut(mirrored(edges).join(runs, "network_id").select(*keys, "u", "v", "w"))
    level = 0
    while True:
        strength = links.groupBy(*keys, "u").agg(F.sum("w").alias("k"))
        total = links.groupBy(*keys).agg(F.sum("w").alias("m2"))
        strength = cut(strength.join(total, keys))
        at = strength.select(*keys, "u", "k", "m2", F.col("u").alias("c"))
        for step in range(most_rounds):
            sums = at.groupBy(*keys, "c").agg(F.sum("k").alias("big"))
            to = links.filter("u <> v").join(at.select(*keys, F.col("u").alias("v"), F.col("c").alias("to")), [*keys, "v"]).groupBy(*keys, "u", "to").agg(F.sum("w").alias("w"))
            stay = at.select(*keys, "u", F.col("c").alias("to"), F.lit(0.0).alias("w"))
            options = to.unionByName(stay).groupBy(*keys, "u", "to").agg(F.sum("w").alias("w")).join(at, [*keys, "u"]).join(sums.withColumnRenamed("c", "to"), [*keys, "to"])
            own = F.col("to") == F.col("c")
            gain = F.round(F.coalesce(F.col("w") - F.try_divide(F.col("gamma") * F.col("k") * (F.col("big") - F.when(own, F.col("k")).otherwise(0.0)), F.col("m2")), F.lit(0.0)), 12)
            best = options.withColumn("gain", gain).groupBy(*keys, "u", "k", "m2", "c").agg(F.min(F.struct((-F.col("gain")).alias("g"), (~own).alias("o"), "to")).alias("b"), F.max(F.when(own, F.col("gain"))).alias("now"))
            best = best.withColumn("could", -F.col("b.g") > F.col("now") + 1e-9)
            if step < rounds:
                best = best.withColumn("may", (F.pmod(F.xxhash64("u", "seed", F.lit(step + 100 * level)), F.lit(2)) == 0) & F.col("could"))
            else:
                best = cut(best)
                rank = F.struct((-F.col("b.g") - F.col("now")).alias("rise"), "u")
                ends = best.filter("could").select(*keys, F.explode(F.array("c", "b.to")).alias("end"), rank.alias("rank"))
                top = ends.groupBy(*keys, "end").agg(F.max("rank")["u"].alias("u"))
                first = top.groupBy(*keys, "u").agg((F.count("*") == 2).alias("may"))
                best = best.join(first, [*keys, "u"], "left").withColumn("may", F.coalesce("may", F.lit(False)))
            at = cut(best.select(*keys, "u", "k", "m2", F.when(F.col("may"), F.col("b.to")).otherwise(F.col("c")).alias("c"), "could"))
            could = at.agg(F.coalesce(F.bool_or("could"), F.lit(False))).first()[0]
            at = at.drop("could")
            if not could:
                break
        else:
            raise RuntimeError(f"communities still move after {most_rounds} rounds of level {level}")
        names = at.groupBy(*keys, "c").agg(F.min("u").alias("name"))
        at = at.join(names, [*keys, "c"]).select(*keys, "u", F.col("name").alias("c"))
        member = cut(member.join(at.withColumnRenamed("u", "top"), [*keys, "top"], "left").select(*keys, "node", F.coalesce("c", "top").alias("top")))
        if at.filter("u <> c").isEmpty():
            break
        small = links.join(at.withColumnsRenamed({"c": "cu"}), [*keys, "u"]).join(at.withColumnsRenamed({"u": "v", "c": "cv"}), [*keys, "v"])
        links = cut(small.groupBy(*keys, F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        level += 1
    name = F.min("node").over(Window.partitionBy(*keys, "top"))
    return member.select(*keys, "node", name.alias("community"))


def paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(network_id, s, t, hops, routes): shortest hop distance of every connected pair and how many shortest paths there are; of all
    s, or of ``sources`` (network_id, s).

    A front grows by one hop a round from all sources at once, until it is empty; what was seen is anti-joined away. As many rows as
    sources times nodes.
    """
    links = mirrored(edges).select("network_id", F.col("u").alias("t"), F.col("v").alias("next")).persist()
    front = links.select("network_id", F.col("t").alias("s"), F.col("next").alias("t"), F.lit(1).alias("hops"), F.lit(1).cast("long").alias("routes"))
    front = cut(front if sources is None else front.join(sources, ["network_id", "s"], "left_semi"))
    seen = front
    hop = 1
    while not front.isEmpty():
        hop += 1
        grown = front.join(links, ["network_id", "t"]).filter("s <> next").groupBy("network_id", "s", F.col("next").alias("t")).agg(F.sum("routes").alias("routes"))
        front = cut(grown.join(seen.select("network_id", "s", "t"), ["network_id", "s", "t"], "left_anti").select("network_id", "s", "t", F.lit(hop).alias("hops"), "routes"))
        seen = cut(seen.unionByName(front))
    links.unpersist()
    return seen


def _lengths(links: DataFrame, sources: DataFrame | None, digits: int | None = None) -> DataFrame:
    """links (network_id, t, next, w) -> (network_id, s, t, distance, zeros): least sum of weights of every connected pair, and of
    such paths the least number of edges of weight zero. ``digits`` rounds sums, so that equal ones compare as equal."""
    if not links.filter("w < 0").isEmpty():
        raise ValueError("weights of paths must not be negative")
    keys, near = ["network_id", "s", "t"], lambda x: x if digits is None else F.round(x, digits)
    least = lambda rows: rows.groupBy(*keys).agg(F.min("d").alias("d"))
    zero = (F.col("w") == 0).cast("int")
    front = links.select("network_id", F.col("t").alias("s"), F.col("next").alias("t"), F.struct(near(F.col("w")).alias("distance"), zero.alias("zeros")).alias("d")).filter("s <> t")
    front = cut(least(front if sources is None else front.join(sources, ["network_id", "s"], "left_semi")))
    best = front
    while not front.isEmpty():
        longer = F.struct(near(F.col("d.distance") + F.col("w")).alias("distance"), (F.col("d.zeros") + zero).alias("zeros")).alias("d")
        grown = least(front.join(links, ["network_id", "t"]).filter("s <> next").select("network_id", "s", F.col("next").alias("t"), longer))
        front = cut(grown.join(best.withColumnRenamed("d", "_d"), keys, "left").filter("_d is null or d < _d").drop("_d"))
        best = cut(least(best.unionByName(front)))
    return best.select(*keys, "d.distance", "d.zeros")


def weighted_paths(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(network_id, s, t, distance): least sum of weights of every connected pair; weights count as distances.

    Each round lengthens the distances that the last one lowered by one edge, for all sources (or ``sources``: network_id, s) at
    once, until none is lowered. A negative weight is an error: its distances would fall for ever. As many rows as sources times nodes.
    """
    links = cut(mirrored(edges).select("network_id", F.col("u").alias("t"), F.col("v").alias("next"), "w"))
    return _lengths(links, sources).drop("zeros")


def path_summary(distances: DataFrame, value: str = "distance") -> DataFrame:
    """(network_id, size, mean, longest) of the pairs in each network's largest component (ties: that of the smallest node), from
    the distances of all connected pairs; networks without edges are left out."""
    reach = distances.groupBy("network_id", "s").agg((F.count("*") + 1).alias("size"), F.least(F.min("t"), F.first("s")).alias("root"))
    largest = reach.groupBy("network_id").agg(F.min(F.struct((-F.col("size")).alias("size"), "root")).alias("c")).select("network_id", "c.root", (-F.col("c.size")).alias("size"))
    inside = distances.join(reach.select("network_id", "s", "root"), ["network_id", "s"]).join(largest, ["network_id", "root"])
    return inside.groupBy("network_id", "size").agg(F.avg(value).alias("mean"), F.max(value).alias("longest"))


def _hop_routes(links: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(network_id, s, t, level, routes) of every node that a source reaches, itself included, and the edges (network_id, s, v, t) of
    shortest paths from v to t; by hops."""
    reach = paths(links.select("network_id", F.col("t").alias("left_item"), F.col("next").alias("right_item"), "w").filter("left_item < right_item").withColumnRenamed("w", "similarity"), sources)
    start = sources.select("network_id", "s", F.col("s").alias("t"), F.lit(0).alias("hops"), F.lit(1).cast("long").alias("routes"))
    found = cut(start.unionByName(reach).select("network_id", "s", "t", F.col("hops").alias("level"), F.col("routes").cast("double").alias("routes")))
    before = found.select("network_id", "s", F.col("t").alias("v"), (F.col("level") + 1).alias("level"))
    steps = before.join(links.select("network_id", F.col("t").alias("v"), F.col("next").alias("t")), ["network_id", "v"])
    return found, steps.join(found.select("network_id", "s", "t", "level"), ["network_id", "s", "t", "level"]).select("network_id", "s", "v", "t")


def _weighted_routes(links: DataFrame, sources: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """As ``_hop_routes``, by weights. A node's level comes after those of all nodes before it on its shortest paths."""
    keys = ["network_id", "s", "t"]
    start = sources.select("network_id", "s", F.col("s").alias("t"), F.lit(0.0).alias("distance"), F.lit(0).alias("zeros"))
    far = cut(start.unionByName(_lengths(links, sources, digits)))
    steps = far.withColumnRenamed("t", "v").join(links.withColumnsRenamed({"t": "v", "next": "t"}), ["network_id", "v"])
    steps = steps.select("network_id", "s", "v", "t", F.round(F.col("distance") + F.col("w"), digits).alias("distance"), (F.col("zeros") + (F.col("w") == 0).cast("int")).alias("zeros"))
    steps = cut(steps.join(far, [*keys, "distance", "zeros"]).select("network_id", "s", "v", "t"))
    steps = cut(steps.join(steps.groupBy(*keys).agg(F.count("*").alias("need")), keys))
    front = start.select(*keys, F.lit(0).alias("level"), F.lit(1.0).alias("routes"))
    found, waiting, level = front, None, 0
    while True:
        level += 1
        sent = front.select("network_id", "s", F.col("t").alias("v"), "routes").join(steps, ["network_id", "s", "v"]).select(*keys, "need", F.lit(1).cast("long").alias("got"), "routes")
        sent = (sent if waiting is None else sent.unionByName(waiting)).groupBy(*keys, "need").agg(F.sum("got").alias("got"), F.sum("routes").alias("routes"))
        sent = cut(sent)
        front = sent.filter("got = need").select(*keys, F.lit(level).alias("level"), "routes")
        if front.isEmpty():
            return found, steps.drop("need")
        found, waiting = cut(found.unionByName(front)), sent.filter("got < need")


def _dependencies(found: DataFrame, steps: DataFrame) -> DataFrame:
    """(network_id, node, x): sums over all sources and targets of the share of shortest paths that run through the node, backwards
    over the levels: a node hands 1 + what it got to those before it, by their share of its routes."""
    on = ["network_id", "s", "t"]
    steps = cut(steps.join(found.select("network_id", "s", F.col("t").alias("v"), F.col("routes").alias("before")), ["network_id", "s", "v"]))
    got = found.limit(0).select(*on, F.lit(0.0).alias("x"))
    for level in range(found.agg(F.max("level")).first()[0] or 0, 0, -1):
        rows = found.filter(F.col("level") == level).join(got, on, "left").select(*on, ((1 + F.coalesce("x", F.lit(0.0))) / F.col("routes")).alias("each"))
        given = rows.join(steps, on).select("network_id", "s", F.col("v").alias("t"), (F.col("before") * F.col("each")).alias("x"))
        got = cut(got.unionByName(given).groupBy(*on).agg(F.sum("x").alias("x")))
    return got.filter("s <> t").groupBy("network_id", F.col("t").alias("node")).agg(F.sum("x").alias("x"))


def betweenness(nodes: DataFrame, edges: DataFrame, weighted: bool = False, batches: int = 1, digits: int = 12) -> DataFrame:
    """(network_id, node, betweenness), normalised: the share of shortest paths of other pairs that run through the node, by hops or,
    ``weighted``, by weights as distances.

    Dependencies are accumulated backwards from every source over the edges of its shortest paths, for all sources and networks of a
    batch at once, so work is sources times edges. ``batches`` deals the sources, and with them what is held at a time. Sums of
    weights are compared to ``digits`` digits. Of paths of one length those with the fewest edges of weight zero count as shortest:
    zero is taken for a weight too small to matter otherwise. Networks of fewer than three nodes have 0.
    """
    links = cut(mirrored(edges).filter("u <> v").groupBy("network_id", F.col("u").alias("t"), F.col("v").alias("next")).agg(F.min("w").alias("w")))
    every, parts = links.select("network_id", F.col("t").alias("s")).distinct(), []
    for b in range(batches):
        sources = every if batches == 1 else every.filter(F.pmod(F.xxhash64("network_id", "s"), F.lit(batches)) == b)
        sources = cut(sources)
        parts.append(_dependencies(*(_weighted_routes(links, sources, digits) if weighted else _hop_routes(links, sources))))
    share = reduce(DataFrame.unionByName, parts).groupBy("network_id", "node").agg(F.sum("x").alias("x"))
    size = nodes.groupBy("network_id").agg(F.count("*").alias("n"))
    out = nodes.join(share, ["network_id", "node"], "left").join(size, "network_id")
    return out.select("network_id", "node", F.when(F.col("n") > 2, F.coalesce("x", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))


def homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(network_id, within_weight, across_weight, within_share) of edges whose ends have the same label (item, label)."""
    side = lambda s: labels.select(F.col("item").alias(f"{s}_item"), F.col("label").alias(s))
    e = edges.join(side("left"), "left_item", "left").join(side("right"), "right_item", "left")
    same = F.coalesce(F.col("left") == F.col("right"), F.lit(False))
    return e.groupBy("network_id").agg(F.avg(F.when(same, F.col("similarity"))).alias("within_weight"), F.avg(F.when(~same, F.col("similarity"))).alias("across_weight"), F.avg(same.cast("int")).alias("within_share"))


def align(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two edge sets side by side: (left_item, right_item, x, y), a missing edge 0, values clipped to 0..1."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    x, y = one.select("left_item", "right_item", F.col("similarity").alias("x")), two.select("left_item", "right_item", F.col("similarity").alias("y"))
    return x.join(y, ["left_item", "right_item"], "full_outer").select("left_item", "right_item", clip(F.col("x")).alias("x"), clip(F.col("y")).alias("y"))


def align_all(edges: DataFrame) -> DataFrame:
    """The edges of every two networks side by side: (first, second, left_item, right_item, x, y), a missing edge 0, values clipped to
    0..1. An edge goes to the pairs of its network; a pair of networks without edges has no rows."""
    names = cut(edges.select("network_id").distinct())
    pairs = names.withColumnRenamed("network_id", "first").join(names.withColumnRenamed("network_id", "second"), F.col("first") < F.col("second"))
    pairs = cut(pairs.select("first", "second", F.explode(F.array("first", "second")).alias("network_id")))
    rows = edges.select("network_id", "left_item", "right_item", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("w")).join(pairs, "network_id")
    value = lambda side: F.coalesce(F.max(F.when(F.col("network_id") == F.col(side), F.col("w"))), F.lit(0.0))
    return rows.groupBy("first", "second", "left_item", "right_item").agg(value("first").alias("x"), value("second").alias("y"))


def compare_edges(aligned: DataFrame, tau: float, by: list[str] = (), empty: float = 1.0) -> DataFrame:
    """Edge Jaccard at tau (``empty`` where neither side has an edge), Pearson correlation and root mean square difference of the
    weights."""
    x, y = F.col("x") >= tau, F.col("y") >= tau
    either = F.count_if(x | y)
    return aligned.groupBy(*by).agg(F.when(either > 0, F.count_if(x & y) / either).otherwise(F.lit(float(empty))).alias("edge_jaccard"), correlation("x", "y").alias("pearson"), F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2.0)))).alias("rmse"))
