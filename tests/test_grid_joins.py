"""Points that meet in grid cells: pairs are many and bytes few, so tasks must not follow from bytes."""

from pyspark.sql import functions as F

from graphloom.functions.arrays import hash_uniform
from graphloom.operators import graphs


def test_crowded_cells_are_dealt_to_many_tasks(spark):
    points = spark.range(400).select(F.col("id").alias("nid"), (hash_uniform("id") * 0.1).alias("x"), (hash_uniform(F.lit(0), "id") * 0.1).alias("y"))
    near = graphs.radius_graph(points, 0.2)
    rows = near.select("src", "dst", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.src, r.dst) for r in rows) == [(a, b) for a in range(400) for b in range(a + 1, 400)]
    assert len({r.task for r in rows}) > 4
    left, right = points.select("nid", F.col("x").alias("lon"), F.col("y").alias("lat")), points.select(F.col("nid").alias("cid"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    met = graphs.match_within(right, left, 0.2, "cid", "nid").select("cid", "nid", F.spark_partition_id().alias("task")).collect()
    assert len({(r.cid, r.nid) for r in met}) == len(met) == 160_000 and len({r.task for r in met}) > 4


def test_pairs_come_cell_by_cell(spark):
    """Rows of a file then share few ids, so its dictionaries hold; and squared distances are exactly those of SQL."""
    place = lambda seed: (hash_uniform("id", seed=seed).alias("lon"), hash_uniform(F.lit(0), "id", seed).alias("lat"))
    left, right = spark.range(2000).select(F.col("id").alias("cid"), *place(1)), spark.range(300).select(F.col("id").alias("nid"), *place(0))
    met = graphs.match_within(left, right, 0.1, "cid", "nid").select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    a, b = ({r[0]: (r.lon, r.lat) for r in df.collect()} for df in (left, right))
    tasks, pairs = {}, {}
    for r in sorted(met.collect(), key=lambda r: r.at):
        tasks.setdefault(r.task, []).append(tuple(int(v // 0.1) for v in a[r.cid]))
        pairs[r.cid, r.nid] = r.d2
    assert max(len(set(cells)) for cells in tasks.values()) > 2
    assert all(1 + sum(x != y for x, y in zip(cells, cells[1:])) == len(set(cells)) for cells in tasks.values())
    d2 = {(c, n): (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) for c, p in a.items() for n, q in b.items()}
    assert pairs == {k: v for k, v in d2.items() if v < 0.1 * 0.1}
