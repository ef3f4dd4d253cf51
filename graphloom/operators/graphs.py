"""Graphs as relations: nodes (nid, ...) and edges (src < dst, w). Generators are seeded by integer hashes, so every engine
makes the same graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.arrays import dot, gaussian_weight, hash_normal, hash_uniform, norm, scaled
from graphloom.operators.neighbours import nearest  # noqa: F401

DEALS = 8  #: shares of a grid cell's points


def node_range(spark: SparkSession, count: int, first: int = 0) -> DataFrame:
    return spark.range(first, first + count).select(F.col("id").alias("nid"))


def pairs_of(nodes: DataFrame, probability: Column, uniform: Column | None = None) -> DataFrame:
    """Edges among all pairs i < j of a model's nodes whose hash number is below the probability. `nodes` may carry a cluster;
    the probability sees src, dst, c_src and c_dst. The pairs of a node are made where the node is: no pair is shuffled."""
    cluster = "cluster" in nodes.columns
    size = nodes.agg(F.max("nid").alias("last"))  # one row
    clusters = nodes.select(F.col("nid").alias("dst"), F.col("cluster").alias("c_dst")) if cluster else None
    made = nodes.join(F.broadcast(size)).where("nid < last").select(F.col("nid").alias("src"), *([F.col("cluster").alias("c_src")] if cluster else []), F.explode(F.sequence(F.col("nid") + 1, F.col("last"))).alias("dst"))
    if cluster:
        made = made.join(clusters, "dst")
    u = uniform if uniform is not None else hash_uniform("src", "dst")
    return made.where(u < probability).select("src", "dst", *(["c_src", "c_dst"] if cluster else []), F.lit(1.0).alias("w"))


def chain(spark: SparkSession, count: int, first: int = 1, weight: float = 1.0, weak_edge: int | None = None, weak_weight: float = 0.25) -> DataFrame:
    """Edges (eid, src, dst, w) of a path; edge k joins nodes k and k + 1."""
    w = F.lit(weight) if weak_edge is None else F.when(F.col("id") == weak_edge, F.lit(weak_weight)).otherwise(F.lit(weight))
    return spark.range(first, first + count - 1).select(F.col("id").alias("eid"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), w.alias("w"))


def chain_precision(spark: SparkSession, count: int, factor: float, blocks: int) -> DataFrame:
    """Precisions (block, i, j, v): unit diagonal, factor / 3 beside it, and no edge (b, b + 1) in block b."""
    rows = spark.range(1, count + 1).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.greatest(F.lit(1), F.col("i") - 1), F.least(F.lit(count), F.col("i") + 1))))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks))))
    v = F.when(F.col("i") == F.col("j"), 1.0).when(F.least("i", "j") == F.col("block"), 0.0).otherwise(factor / 3)
    return rows.select("block", "i", "j", v.alias("v"))


def star_precision(spark: SparkSession, count: int, leaves: int, hub_value: float = 0.4, seed: int = 0) -> DataFrame:
    """Half the identity, and hub_value / leaves between node 1 and `leaves` others chosen by hash."""
    others = spark.range(2, count + 1).select(F.col("id").alias("j"))
    chosen = others.orderBy(hash_uniform("j", seed=seed), "j").limit(leaves)
    hub = chosen.select(F.lit(1).cast("long").alias("i"), "j", F.lit(hub_value / leaves).alias("v"))
    return spark.range(1, count + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.5).alias("v")).unionAll(hub).unionAll(hub.select("j", "i", "v"))


def neighbourhood(kind: str, node: int, count: int) -> list[int]:
    """True neighbours of a 1-based node in a chain, or in a square grid numbered row by row."""
    if kind == "chain":
        near = [node - 1, node + 1]
        return [n for n in near if 1 <= n <= count]
    side = round(count**0.5)
    row, col = divmod(node - 1, side)
    steps = [(row - 1, col), (row, col - 1), (row, col + 1), (row + 1, col)]
    return [r * side + c + 1 for r, c in steps if 0 <= r < side and 0 <= c < side]


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Edges of a rows x cols grid with node ids row * cols + col."""
    cells = spark.range(rows * cols).select(F.col("id").alias("src"))
    right = cells.where(F.col("src") % cols < cols - 1).select("src", (F.col("src") + 1).alias("dst"))
    down = cells.where(F.col("src") < (rows - 1) * cols).select("src", (F.col("src") + cols).alias("dst"))
    return right.unionAll(down).withColumn("w", F.lit(1.0))


def image_graph(pixels: DataFrame, scale: float = 20.0) -> DataFrame:
    """Grid edges between pixels (row, col, val), weighted by the likeness of their values: two equi-joins."""
    width = pixels.agg((F.max("col") + 1).alias("width"))  # one row
    p = pixels.join(F.broadcast(width)).select("row", "col", F.col("val").cast("double").alias("val"), (F.col("row") * F.col("width") + F.col("col")).cast("long").alias("nid"))
    q = p.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("val").alias("v"), F.col("nid").alias("dst"))
    right = p.join(q, (F.col("r") == F.col("row")) & (F.col("c") == F.col("col") + 1))
    down = p.join(q, (F.col("r") == F.col("row") + 1) & (F.col("c") == F.col("col")))
    return right.unionAll(down).select(F.col("nid").alias("src"), "dst", gaussian_weight("val", "v", scale).alias("w"))


def erdos_renyi(spark: SparkSession, count: int, edges: int | None = None, probability: float | None = None, seed: int = 0) -> DataFrame:
    p = probability if probability is not None else edges / (count * (count - 1) / 2)
    return pairs_of(node_range(spark, count), F.lit(float(p)), hash_uniform("src", "dst", seed))


def block_model(spark: SparkSession, sizes: list[int], inside: float, across: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (nid, cluster) and edges of a stochastic block model; probabilities above 1 count as 1."""
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    cluster = F.lit(len(sizes) - 1)
    for k in reversed(range(len(sizes) - 1)):
        cluster = F.when(F.col("nid") < ends[k], k).otherwise(cluster)
    nodes = node_range(spark, ends[-1]).withColumn("cluster", cluster)
    p = F.when(F.col("c_src") == F.col("c_dst"), F.lit(float(inside))).otherwise(F.lit(float(across)))
    return nodes, pairs_of(nodes, p, hash_uniform("src", "dst", seed))


def two_clusters(spark: SparkSession, first: int, second: int, degree: float, boundary: float, seed: int = 0, inside_weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Two random clusters with about `boundary` edges between them; an isolated node is tied to the other cluster's node at the
    border (nodes first and first - 1)."""
    nodes, edges = block_model(spark, [first, second], degree / first, boundary / (first * second), seed)
    edges = edges.withColumn("w", F.when(F.col("c_src") == F.col("c_dst"), F.lit(float(inside_weight))).otherwise(F.lit(1.0)))
    alone = isolated(nodes, edges)
    anchor = F.when(F.col("cluster") == 0, F.lit(first)).otherwise(F.lit(first - 1)).cast("long")
    repaired = alone.select(F.least("nid", anchor).alias("src"), F.greatest("nid", anchor).alias("dst"), F.lit(0).alias("c_src"), F.lit(1).alias("c_dst"), F.lit(1.0).alias("w"))
    return nodes, edges.unionByName(repaired.distinct())


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables joined by grid cells (cx, cy). A cell's points are few bytes and many pairs: the points of a are dealt in turn to DEALS
    shares of their cell, b goes to each, and the number of tasks is fixed, as by bytes all cells would end in a few. They merge, so a task
    holds one share at a time and its pairs come cell by cell: in a file, neighbouring rows share few ids, and Parquet keeps its
    dictionaries where it would write eight bytes an id."""
    tasks = max(200, 8 * a.sparkSession.sparkContext.defaultParallelism)
    left = a.withColumn("_deal", F.pmod(F.xxhash64(*a.columns), F.lit(DEALS))).repartition(tasks, "cx", "cy", "_deal")
    right = b.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))).repartition(tasks, "cx", "cy", "_deal")
    return right.hint("merge").join(left, ["cx", "cy", "_deal"]).drop("_deal")


def _squared(x1: str, x2: str, y1: str, y2: str) -> Column:
    """The squared distance, by products: exactly as SQL has it."""
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return dx * dx + dy * dy


def radius_graph(points: DataFrame, radius: float, x: str = "x", y: str = "y", node: str = "nid") -> DataFrame:
    """Edges between points nearer than the radius, (src, dst, d2). Points meet in grid cells of the radius' size: a cell's points
    go to themselves and half of the cells around, so each pair meets once."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    placed = points.select(F.col(node).alias("nid"), F.col(x).alias("x"), F.col(y).alias("y"), cell(x).alias("cx"), cell(y).alias("cy"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))]))
    sent = placed.select("*", steps.alias("s")).select(F.col("nid").alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"), (F.abs("s.a") + F.abs("s.b")).alias("far"))
    met = _met(sent, placed).where((F.col("far") > 0) | (F.col("n1") < F.col("nid")))
    d2 = _squared("x1", "x", "y1", "y")
    return met.select(F.least("n1", "nid").alias("src"), F.greatest("n1", "nid").alias("dst"), d2.alias("d2")).where(F.col("d2") < radius * radius)


def match_within(left: DataFrame, right: DataFrame, radius: float, lkey: str, rkey: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """(lkey, rkey, d2) of points of two tables nearer than the radius, by grid cells."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    a = left.select(F.col(lkey), F.col(x).alias("x1"), F.col(y).alias("y1"), cell(x).alias("cx"), cell(y).alias("cy"))
    b = right.select(F.col(rkey), F.col(x).alias("x2"), F.col(y).alias("y2"), cell(x).alias("px"), cell(y).alias("py"), around.alias("s"))
    b = b.select(rkey, "x2", "y2", (F.col("px") + F.col("s.a")).alias("cx"), (F.col("py") + F.col("s.b")).alias("cy"))
    d2 = _squared("x1", "x2", "y1", "y2")
    return _met(a, b).select(lkey, rkey, d2.alias("d2")).where(F.col("d2") < radius * radius)


def symmetric(directed: DataFrame, a: str = "nid", b: str = "other") -> DataFrame:
    """Undirected edges (src, dst, w = 1): one for each pair that is linked in either direction."""
    return directed.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct().withColumn("w", F.lit(1.0))


def ends(edges: DataFrame) -> DataFrame:
    """Both directions: (nid, other, w, sign), sign +1 at the source."""
    both = F.inline(F.array(F.struct(F.col("src").alias("nid"), F.col("dst").alias("other"), "w", F.lit(1.0).alias("sign")), F.struct(F.col("dst").alias("nid"), F.col("src").alias("other"), "w", F.lit(-1.0).alias("sign"))))
    return edges.select(both)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nid, degree, strength, gamma): edges, their weight, and 1 / degree (0 where isolated)."""
    sums = ends(edges).groupBy("nid").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    return nodes.join(sums.hint("merge"), "nid", "left").select(*nodes.columns, F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce(1.0 / F.col("degree"), F.lit(0.0)).alias("gamma"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges).select("nid"), "nid", "left_anti")


def laplacian(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, v) with the weighted degrees on the diagonal, isolated nodes included."""
    diagonal = degrees(nodes, edges).select(F.col("nid").alias("i"), F.col("nid").alias("j"), F.col("strength").alias("v"))
    return diagonal.unionAll(ends(edges).select(F.col("nid").alias("i"), F.col("other").alias("j"), (-F.col("w")).alias("v")))


def gradient(edges: DataFrame, signal: DataFrame, value: str = "x") -> DataFrame:
    """Edges with the difference of the signal, source less target."""
    a, b = signal.select(F.col("nid").alias("src"), F.col(value).alias("_a")), signal.select(F.col("nid").alias("dst"), F.col(value).alias("_b"))
    return edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").withColumn("dx", F.col("_a") - F.col("_b")).drop("_a", "_b")


def divergence(edges: DataFrame, flow: str = "y") -> DataFrame:
    """(nid, div): signed sums of the flow at every node with edges."""
    signed = F.inline(F.array(F.struct(F.col("src").alias("nid"), F.col(flow).alias("v")), F.struct(F.col("dst").alias("nid"), (-F.col(flow)).alias("v"))))
    return edges.select(signed).groupBy("nid").agg(F.sum("v").alias("div"))


def total_variation(edges: DataFrame, signal: DataFrame, value: str = "x") -> DataFrame:
    """One row: weighted sums of absolute and of squared differences."""
    g = gradient(edges, signal, value)
    return g.agg(F.sum(F.col("w") * F.abs("dx")).alias("absolute"), F.sum(F.col("w") * F.pow("dx", F.lit(2.0))).alias("squared"))


def neighbour_average(edges: DataFrame, signal: DataFrame, value: str = "x") -> DataFrame:
    """(nid, mean) over neighbours; isolated nodes have no row."""
    far = signal.select(F.col("nid").alias("other"), F.col(value).alias("_v"))
    return ends(edges).join(far.hint("merge"), "other").groupBy("nid").agg(F.avg("_v").alias("mean"))


def cut(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: number and weight of the edges between clusters; weights below 1 count as 1."""
    g = gradient(edges, clusters, "cluster").where("dx <> 0")
    return g.agg(F.count("*").alias("edges"), F.greatest(F.lit(1.0), F.coalesce(F.sum("w"), F.lit(0.0))).alias("weight"))


def border_nodes(points: DataFrame, x: str = "x") -> DataFrame:
    """The leftmost node of cluster 0 and the rightmost of cluster 1."""
    return points.agg(F.min(F.when(F.col("cluster") == 0, F.struct(x, "nid"))).alias("a"), F.max(F.when(F.col("cluster") == 1, F.struct(x, "nid"))).alias("b")).select(F.col("a.nid").alias("leftmost"), F.col("b.nid").alias("rightmost"))


def attributed_nodes(spark: SparkSession, count: int, clusters: int, dimension: int, noise: float = 0.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (nid, cluster, feature, label) and parameters (cluster, weights): clusters by hash, features of +1 and -1, a cluster's
    weights uniform, labels their product plus normal noise."""
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    weights = spark.range(clusters).select(F.col("id").cast("int").alias("cluster"), F.transform(places, lambda k: hash_uniform(F.col("id") + 1000, k, seed + 1)).alias("weights"))
    cluster = F.floor(hash_uniform("nid", F.lit(7), seed) * clusters).cast("int")
    feature = F.transform(places, lambda k: F.when(hash_uniform("nid", k + 13, seed + 2) < 0.5, -1.0).otherwise(1.0))
    nodes = node_range(spark, count).select("nid", cluster.alias("cluster"), feature.alias("feature"))
    label = dot("feature", "weights") + noise * hash_normal("nid", F.lit(29), seed + 3)
    return nodes.join(F.broadcast(weights), "cluster").select("nid", "cluster", "feature", label.alias("label")), weights  # a row a cluster


def unit_features(nodes: DataFrame, dimension: int = 2, scale: float = 0.01, seed: int = 0) -> DataFrame:
    """nodes (nid, cluster) with unit-length normal features and labels by the cluster's weights, plus or minus scale / sqrt(dimension)."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda k: hash_normal("nid", k, seed))
    made = nodes.withColumn("_raw", raw).withColumn("feature", scaled("_raw", 1.0 / norm("_raw"))).drop("_raw")
    value = F.lit(scale / dimension**0.5) * F.when(F.col("cluster") == 0, 1.0).otherwise(-1.0)
    return made.withColumn("label", F.aggregate("feature", F.lit(0.0), lambda s, x: s + x) * value)


def geometric_clusters(spark: SparkSession, first: int, second: int, radius: float, shift: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of two unit squares, `shift` apart, linked within the radius: nodes (nid, cluster, x, y), edges, and the nodes at the border."""
    nodes = node_range(spark, first + second).withColumn("cluster", (F.col("nid") >= first).cast("int"))
    nodes = nodes.select("nid", "cluster", (hash_uniform("nid", seed=seed) + F.col("cluster") * shift).alias("x"), hash_uniform(F.lit(0), "nid", seed).alias("y"))
    return nodes, radius_graph(nodes, radius).select("src", "dst", F.lit(1.0).alias("w")), border_nodes(nodes)
