"""The prefix trie of conversations, by partition refinement.

All conversations start in one class. A round takes the active classes' next turns and splits each class by them; a class of one
conversation retires and its remaining turns are emitted as a chain of nodes without further rounds, so there are as many rounds as the
longest shared prefix has turns. Then sums are folded back from the deepest round to the root. Turns travel as SHA-256 hashes and word
counts, texts never leave the first pass. Turns are numbered by ranks over ranges, classes are split by combining sums, and hot classes
and conversations are dealt to many tasks in every join: no task holds a whole class or conversation.

A node is named by its depth and the smallest conversation under it, as classes of one depth are disjoint.

Defined results: rows without a conversation id are left out; null roles and texts count as empty; turns are ordered by turn (null first),
ties by the hash of role and text, repeated rows are turns of their own; a conversation without turns ends at the root; an empty table gives
no nodes; other columns don't matter, whatever their names; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.tabular import with_rank
from graphloom.plans.joins import spread_join

from .common import fresh_path, release, ship_package, stored

WORD = r"[^\x20\x09-\x0D]+"
HOT = 20_000  #: rows of a key from which it is dealt to several tasks


def turn_hash(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def conversation_steps(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """steps (conv_id, depth, key, words), depths 1, 2, ... in the order of the turns, and conversations (conv_id, length)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_hash(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ranked = with_rank(told, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("key")], "place")
    spans = stored(ranked.groupBy("conv_id").agg(F.min("place").alias("first"), F.count("*").alias("length")), "spans")
    steps = _spread(ranked, spans, "conv_id", "place").select("conv_id", (F.col("place") - F.col("first") + 1).alias("depth"), "key", "words")
    return stored(steps, "steps"), spans.select("conv_id", "length")


def with_shared_heads(steps: DataFrame, conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation c rebuilt: the first h turns of the first conversation of its group, c - c % group, then c's own after its first h,
    with h = crc32(c) % most. A leader that is absent or shorter gives what it has."""
    told = conversations.select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % group).alias("leader"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("cut"))
    leaders = conversations.select(F.col("conv_id").alias("leader"), F.col("length").alias("led"))
    plan = stored(told.join(leaders, "leader", "left").select("conv_id", "length", "leader", "cut", F.least("cut", F.coalesce("led", F.lit(0))).alias("head")), "plan")
    own = _spread(steps, plan.select("conv_id", "length", "cut", "head"), "conv_id", "depth").where("depth > cut").select("conv_id", (F.col("depth") - F.col("cut") + F.col("head")).alias("depth"), "key", "words")
    heads = steps.where((F.col("conv_id") % group == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "leader")
    lent = plan.where("head > 0").select("conv_id", "leader", "head").join(heads, "leader").where("depth <= head").select("conv_id", "depth", "key", "words")
    return own.unionByName(lent), plan.select("conv_id", (F.col("head") + F.greatest(F.col("length") - F.col("cut"), F.lit(0))).alias("length"))


def prefix_trie(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. steps
    (conv_id, depth, key, words) with depths 1 ... length of conversations (conv_id, length)."""
    spark = steps.sparkSession
    base = fresh_path(spark, "trie")
    all_convs = stored(conversations.select("conv_id", F.col("length").cast("long").alias("length")), "conversations")
    paths = stored(steps.select("conv_id", F.col("depth").cast("long").alias("depth"), "key", F.col("words").cast("long").alias("words")).sortWithinPartitions("depth"), "paths")
    root = all_convs.agg(F.min("conv_id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("key"), F.count("*").alias("n"), F.lit(0).cast("long").alias("words"), F.max("length").alias("length")).where("n > 0")
    classes = f"{base}/classes"
    kinds = root.schema
    root.write.parquet(f"{classes}/depth=0")
    of = lambda d: spark.read.schema(kinds).parquet(f"{classes}/depth={d}")

    # refinement: classes with several members are active, those with one retire
    depth = 0
    live = of(0).where("n > 1")
    top = live.first()  # one row
    active = all_convs.withColumn("class", F.lit(top["node"] if top else None).cast("long"))
    while not live.isEmpty():
        active.where(F.col("length") == depth).select("conv_id", F.col("class").alias("node")).write.parquet(f"{base}/ended/depth={depth}")
        depth += 1
        moved = stored(active.where(F.col("length") >= depth).join(paths.where(F.col("depth") == depth).drop("depth"), "conv_id").select("conv_id", "class", "length", "words", F.struct("class", "key").alias("edge")), "moved")
        if depth > 1:
            release(active)
        split = moved.groupBy("edge").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("length").alias("length"))
        split.select("node", F.col("edge.class").alias("parent"), F.col("edge.key").alias("key"), "n", "words", "length").write.parquet(f"{classes}/depth={depth}")
        live = of(depth).where("n > 1")
        named = live.select(F.struct(F.col("parent").alias("class"), "key").alias("edge"), F.col("node").alias("next"), "n")
        active = stored(spread_join(moved, named, "edge", "conv_id", hot_rows=HOT, hot=named.where(F.col("n") > HOT).select("edge")).select("conv_id", F.col("next").alias("class"), "length"), "active")
        release(moved)

    # fold back: what the deepest classes sum to goes to their parents
    sums = "parent long, count long, leaves long, saved long"
    below = spark.createDataFrame([], sums)
    for d in range(depth, -1, -1):
        found = of(d).where("n > 1").join(below.select(F.col("parent").alias("node"), "count", "leaves", "saved"), "node", "left")
        folded = found.select("node", "parent", "n", F.coalesce("count", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved"))
        folded.write.parquet(f"{base}/folded/depth={d}")
        told = spark.read.schema(folded.schema).parquet(f"{base}/folded/depth={d}").select("parent", "leaves", "saved")
        alone = of(d).where("n = 1").select("parent", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        below = told.unionByName(alone).groupBy("parent").agg(F.count("*").alias("count"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    every = lambda part, schema: spark.read.schema(f"{schema}, depth long").parquet(f"{base}/{part}")
    folded = every("folded", "node long, parent long, n long, children long, leaves long, saved long")
    ended = every("ended", "conv_id long, node long") if depth else spark.createDataFrame([], "conv_id long, node long, depth long")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    shared = folded.join(end_digests(ended), ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", nothing).alias("ends_sha256")
    )
    retired = every("classes", "node long, parent long, n long, length long").where("n = 1").select(F.col("node").alias("conv_id"), F.col("depth").alias("top"), F.col("parent").alias("above"), "length")
    tails = _spread(paths.select("conv_id", "depth"), retired, "conv_id", "depth").where("depth > top").select("conv_id", "depth", F.col("conv_id").alias("above"), "length")
    single = retired.select("conv_id", F.col("top").alias("depth"), "above", "length").unionByName(tails)
    last = F.col("depth") == F.col("length")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    chain = single.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return shared.unionByName(chain)


def end_digests(ended: DataFrame) -> DataFrame:
    """(node, depth, digest): SHA-256 of the ids that end at a node, ascending, joined by commas. Ids are sorted over ranges and joined to
    runs there; the digest itself is sequential by nature, and one task streams a node's runs through it without holding them."""
    ship_package(ended.sparkSession)
    kind = ended.schema["conv_id"].dataType.simpleString()

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, node, ids = (batch.column(c).to_numpy() for c in ("depth", "node", "conv_id"))
            starts = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])])
            stops = np.r_[starts[1:], len(ids)]
            joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(depth[starts]), pa.array(node[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], names=["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if at == (depth, node):
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(ids.encode())
            if done:
                yield _digests(done)
        if at is not None:
            yield _digests([(*at, state.hexdigest())])

    runs = ended.select("depth", "node", "conv_id").repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(join_runs, f"depth long, node long, first {kind}, ids string")
    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node long, digest string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, node, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(digest, pa.string())], names=["depth", "node", "digest"])


def _spread(rows: DataFrame, unique: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with a table of conversations and their lengths, of which one may have very many rows."""
    return spread_join(rows, unique, key, spread, hot_rows=HOT, hot=unique.where(F.col("length") > HOT).select(key))
