"""Exact nearest neighbours through a metric index.

Equal vectors are one point, with the ids that can matter. Points go to the cell of their nearest pivot, and points of a cell into blocks
by their distance from it, so a block is a piece of a ring. Every block knows the nearest and furthest of its points from every pivot;
by the triangle inequality, two blocks are at least as far apart as these intervals. Blocks form a tree of such bounds, and pairs of blocks
come from descending it in pairs, dropping those further apart than the left block's reach, its largest distance to a k-th neighbour
so far. Reaches start from a block and those beside it and shrink from round to round, while each block meets its next nearest
candidates, four times as many a round, until none is within reach."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.tabular import with_rank
from graphloom.plans.joins import spread_join
from graphloom.plans.state import settled, ship_package

FAN = 8  #: children of a node of the tree
TILE_BYTES = 8 << 20  #: vectors on a side of a tile, unless a single block has more
BROADCAST_BYTES = 8 << 20  #: of ids and lists, or of repeated vectors, that may be broadcast at the end
FOUND = "nid long, other long, d2 double"
# Joins here and on the graph that comes of it are told to merge: what Spark would broadcast by itself, up to its limit each, passes through the driver.


@dataclass
class Work:
    """What a search did: blocks, and pairs of blocks that met."""

    points: int = 0
    blocks: int = 0
    met: int = 0
    rounds: list[int] = field(default_factory=list)

    @property
    def skipped(self) -> float:
        return 1 - self.met / max(1, self.blocks**2)


def nearest(vectors: DataFrame, k: int, node: str = "vec_id", vector: str = "embedding", block: int = 1024, digits: int = 6, pivots: int = 32, work: Work | None = None) -> DataFrame:
    """(nid, other, d2, rank): each vector's k nearest others, exact, by squared distance rounded to `digits`, ties by id. Rows without a
    vector have no neighbours. `work` is told how many block pairs met."""
    ship_package(vectors.sparkSession)
    work = Work() if work is None else work
    kind = "f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "f8"
    own = vectors.where(F.col(vector).isNotNull()).select(F.col(node).cast("long").alias("nid"), F.col(vector).cast("array<double>").alias("v"))
    held = own.withColumn("_at", F.row_number().over(Window.partitionBy("v").orderBy("nid"))).where(F.col("_at") <= k + 1)
    points = settled(held.groupBy("v").agg(F.array_sort(F.collect_list("nid")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids"))  # k + 1 ids at most
    work.points = points.count()
    if not work.points:
        return vectors.sparkSession.createDataFrame([], FOUND + ", rank int")
    between = _between_points(points, k, block, digits, pivots, kind, work)

    # back from points to ids: a point's own ids come first, then those of its nearest points
    told = points.select(F.col("rep").alias("other"), F.explode("ids").alias("id"))
    near = between.join(told.hint("merge"), "other").select("rep", "d2", "id").unionByName(points.select("rep", F.lit(0.0).alias("d2"), F.explode("ids").alias("id")))
    lists = near.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "id"))), 1, k + 1).alias("near"))  # (k + 1)^2 entries at most
    few = max(1, BROADCAST_BYTES // (8 * max(len(own.select("v").first()["v"]), 4 * (k + 1))))  # rows, so that wide ones stay off the driver too
    alone = own.select("nid").join(points.where(F.size("ids") == 1).select(F.col("rep").alias("nid")).hint("merge"), "nid", "left_semi").select("nid", F.col("nid").alias("rep"))
    shared = points.where(F.size("ids") > 1).select("v", "rep")
    members = alone if shared.isEmpty() else alone.unionByName(spread_join(own, shared.hint("merge"), "v", "nid", broadcast_rows=few).select("nid", "rep"))
    listed = spread_join(members, lists.hint("merge"), "rep", "nid", broadcast_rows=few)
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("nid")), 1, k)
    rows = listed.select("nid", F.posexplode(mine).alias("at", "x"))
    return rows.select("nid", F.col("x.id").alias("other"), F.col("x.d2").alias("d2"), (F.col("at") + 1).alias("rank"))


def _between_points(points: DataFrame, k: int, block: int, digits: int, pivots: int, kind: str, work: Work) -> DataFrame:
    """(rep, other, d2) of the k nearest other points."""
    packed = settled(_packed(points, block, pivots, kind))
    work.blocks = packed.count()
    largest = packed.agg(F.max(F.length("m"))).first()[0]
    home = packed.select("block", "reps")
    dealt = 4 * points.sparkSession.sparkContext.defaultParallelism  # a number, as tiles are small rows that mean much work
    side = max(1, min(TILE_BYTES // max(largest, 1), math.ceil(work.blocks / math.sqrt(dealt))))  # blocks on a side of a tile
    reach_of = F.sqrt(F.col("worst") + F.lit(2 * 10.0**-digits)) * (1 + 1e-9) + 1e-9  # rounding can't hide a neighbour

    def met(pairs: DataFrame) -> DataFrame:
        """Pairs meet in tiles: a tile gets its blocks once, by a shuffle, however many of its pairs meet, and nothing passes through the driver."""
        placed = pairs.withColumn("ta", F.floor(F.col("a") / side)).withColumn("tb", F.floor(F.col("b") / side)).repartition(dealt, "ta", "tb")
        needed = placed.select(F.col("ta").alias("ha"), F.col("tb").alias("hb"), F.explode(F.array("a", "b")).alias("block")).distinct()
        held = needed.join(packed.select("block", "reps", "m").hint("shuffle_hash"), "block").repartition(dealt, "ha", "hb")
        return placed.groupBy("ta", "tb").cogroup(held.groupBy("ha", "hb")).applyInArrow(lambda p, h: _compared(p, h, k, digits, kind), FOUND)

    def kept(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("nid").orderBy("d2", "other"))
        return settled(found.withColumn("_at", place).where(F.col("_at") <= k).drop("_at"))

    def reaches(best: DataFrame) -> DataFrame:
        """(block, worst): the largest squared distance to a k-th neighbour; infinite while a point has fewer."""
        each = best.groupBy("nid").agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(float("inf")).alias("worst"))
        inside = home.select("block", F.explode("reps").alias("nid")).join(each.hint("merge"), "nid", "left")
        return settled(inside.groupBy("block").agg(F.max(F.coalesce("worst", F.lit(float("inf")))).alias("worst")))

    beside = F.explode(F.array(*[F.col("block") + x for x in (0, 1, -1)]))
    start = packed.select(F.col("block").alias("a"), beside.alias("b")).where(F.col("b").between(0, work.blocks - 1)).withColumn("worst", F.lit(float("inf")))
    work.met = start.count()
    best = kept(met(start))
    if work.blocks <= 2:  # all pairs have met
        return best.select(F.col("nid").alias("rep"), "other", "d2")
    worst = reaches(best)

    found = _descended(packed.select("block", "lo", "hi"), worst.select("block", reach_of.alias("reach")), work.blocks)
    order = Window.partitionBy("a").orderBy("gap", "b")
    candidates = settled(found.where(F.abs(F.col("a") - F.col("b")) > 1).withColumn("at", F.row_number().over(order)))
    done, next_size = 0, 4
    while True:
        open_ = candidates.where(F.col("at") > done).join(worst.withColumnRenamed("block", "a").hint("merge"), "a").where(F.col("gap") <= reach_of)
        now = settled(open_.where(F.col("at") <= done + next_size).select("a", "b", "worst"))
        count = now.count()
        if count:
            work.met += count
            work.rounds.append(count)
            best = kept(best.unionByName(met(now)))
            worst = reaches(best)
        elif open_.isEmpty():
            return best.select(F.col("nid").alias("rep"), "other", "d2")
        done, next_size = done + next_size, 4 * next_size


def _packed(points: DataFrame, block: int, pivots: int, kind: str) -> DataFrame:
    """(block, reps, m, lo, hi): blocks in the order of cells and rings, their vectors as bytes, and the distances of the nearest and furthest
    of them from each pivot. The pivots, a fixed number chosen by hash, come to the driver."""
    chosen = np.array([r["v"] for r in points.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("v").collect()])

    def distances(m: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in chosen], axis=1)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                d = distances(np.stack(pdf["v"].to_list()))
                yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), ring=d.min(axis=1))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_list())
        d = distances(m)
        return pd.DataFrame({"block": [key[0]], "reps": [pdf["rep"].to_numpy()], "m": [m.astype(kind).tobytes()], "lo": [d.min(axis=0)], "hi": [d.max(axis=0)]})

    cells = points.select("rep", "v").mapInPandas(placed, "rep long, v array<double>, cell int, ring double")
    ranked = with_rank(cells, [F.asc("cell"), F.asc("ring"), F.asc("rep")])
    return ranked.withColumn("block", F.floor((F.col("rank") - 1) / block).cast("long")).groupBy("block").applyInPandas(pack, "block long, reps array<long>, m binary, lo array<double>, hi array<double>")


def _gap(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    """A distance that any two points of two blocks have at least, less the rounding of the bounds."""
    apart = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: x - y))
    return F.greatest(apart(lo, other_hi), apart(other_lo, hi), F.lit(0.0)) * (1 - 1e-9)


def _above(bounds: DataFrame) -> DataFrame:
    """The bounds and the reach of the next level's nodes, FAN below each."""
    parts = bounds.select(F.floor(F.col("block") / FAN).cast("long").alias("block"), "reach", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "x"))
    each = parts.groupBy("block", "p").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"), F.max("reach").alias("reach"))
    ordered = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("x"), F.max("reach").alias("reach"))  # an entry a pivot
    return ordered.select("block", F.transform("x", lambda v: v["lo"]).alias("lo"), F.transform("x", lambda v: v["hi"]).alias("hi"), "reach")


def _descended(bounds: DataFrame, reach: DataFrame, blocks: int) -> DataFrame:
    """(a, b, gap) of blocks within reach of a, from pairs of nodes that are, level by level."""
    levels, count = [settled(bounds.join(reach.hint("merge"), "block"))], blocks
    while count > FAN:
        levels.append(settled(_above(levels[-1])))
        count = -(-count // FAN)
    pairs = levels[-1].select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("b"))  # FAN^2 pairs at most
    children = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
    for at, level in enumerate(reversed(levels)):
        if at:
            pairs = pairs.select("b", children("a").alias("a")).select("a", children("b").alias("b"))
        left = level.select(F.col("block").alias("a"), "lo", "hi", "reach")
        right = level.select(F.col("block").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        near = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("gap", _gap("lo", "hi", "blo", "bhi"))
        pairs = settled(near.where(F.col("gap") <= F.col("reach")).select("a", "b", "gap"))
    return pairs


def _compared(pairs: pa.Table, held: pa.Table, k: int, digits: int, kind: str) -> pa.Table:
    """The nearest of each pair of a tile, from the blocks that the tile holds; k of a point are kept, and the k-th so far limits what later blocks give."""
    at = {b: i for i, b in enumerate(held.column("block").to_pylist())}
    reps, vectors = held.column("reps").combine_chunks(), held.column("m").combine_chunks()

    def block(b: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(reps[at[b]].values)
        return ids, np.frombuffer(vectors[at[b]].as_buffer(), kind).reshape(len(ids), -1).astype(float)

    found, last, left, limit = [], None, None, None
    for a, b, worst in sorted(zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "worst")), strict=True)):
        if a != last:
            last, left, limit = a, block(a), worst
            found.append((left[0], (np.empty(0, int), np.empty(0, int), np.empty(0))))
        ids, so_far = found[-1]
        got = closest(left[1], *block(b), k, digits, limit, a == b)
        if len(got[0]):
            found[-1] = ids, _least([so_far, got], k)
            limit = np.minimum(worst, _kth(*found[-1][1], k, len(ids)))
    rows = [(ids[i], other, d2) for ids, (i, other, d2) in found]
    return pa.table({name: np.concatenate([r[i] for r in rows]) for i, name in enumerate(("nid", "other", "d2"))})


def _least(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k rows (place, other, d2) of a point, the nearest by distance and id."""
    place, other, d2 = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((other, d2, place))
    place, other, d2 = place[order], other[order], d2[order]
    keep = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[keep], other[keep], d2[keep]


def _kth(place: np.ndarray, other: np.ndarray, d2: np.ndarray, k: int, count: int) -> np.ndarray:
    """Each point's k-th distance among its least rows, infinite while it has fewer."""
    has = np.bincount(place, minlength=count)
    out = np.full(count, np.inf)
    out[has == k] = d2[np.cumsum(has)[has == k] - 1]
    return out


def closest(q: np.ndarray, b: np.ndarray, m: np.ndarray, k: int, digits: int, limit: float | np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, id, d2): for each of q, up to k of b no further than its limit. `same` says that both are one block, where a point is none
    of its own. Products find who can be among them, within a bound on their error; differences decide."""
    qq, mm = (q * q).sum(axis=1), (m * m).sum(axis=1)
    rough = np.column_stack([q, qq, np.ones(len(q))]) @ np.column_stack([-2 * m, np.ones(len(m)), mm]).T
    if same:
        np.fill_diagonal(rough, np.inf)
    slack = 2 * (1e-10 * (qq.max() + mm.max()) + 2 * 10.0**-digits)
    within = lambda most: rough <= np.minimum(np.broadcast_to(most, len(q)) + slack, np.finfo(float).max)[:, None]
    near = within(limit)
    if len(b) >= k and np.count_nonzero(near) > 8 * k * len(q):  # limits that leave many: the products' own k-th is one too
        near &= within(np.partition(rough, k - 1, axis=1)[:, k - 1])
    i, j = np.divmod(np.flatnonzero(near), len(b))
    d = np.round(((q[i] - m[j]) ** 2).sum(axis=1), digits)
    order = np.lexsort((b[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k  # places among those of the same point
    return i[keep], b[j[keep]], d[keep]
