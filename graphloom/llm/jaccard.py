"""Exact self-join of texts by the Jaccard similarity of their word shingles, by vertical partitioning.

The global order of all shingles (by hash) is cut into fragments. A pair's overlap is counted in every fragment by a task of its own,
from the two texts' segments there, and the partial overlaps are summed per pair. A fragment sends nothing for pairs without a common
shingle in it, nor for pairs whose segments alone differ by more than two linked texts of their sizes may differ altogether.

Which pairs are counted follows from a prefix: a text of n shingles has at most floor(n / 5) that a partner at 0.8 lacks. How many
texts have a shingle is counted, by fragment too, in the first cut, `region` of the order (copies in one chunk count once). A text whose
region holds more unshared shingles than that has no partner; for the others the rarest shared shingles of the region, then the next
ones of the order, make up a prefix, and linked texts share a shingle of their prefixes, after the first of which each has as many more
as the link takes. The texts of one such shingle are a list.
Lists are worked off in rounds. A round takes a few texts of each list as pivots, the same ones in similar lists, counts the overlaps
of the pivots with the list's other texts, joins what links, and drops the pivots. A list whose texts are all in one component by
then has nothing left to find, so a large group of near copies costs its size and not its square. The first round takes one pivot of
each list, the later ones `growth` times as many as the round before, of those outside the list's largest component. A few pivots join
most of a group before many of its pairs are looked at. What `rounds` rounds leave are large lists of texts that share much and link
little. All pairs of theirs are counted: the texts that such lists connect are dealt to blocks, each block meets each other one of
its group, and a fragment sends the partial overlaps of a meeting as one matrix; matrices are summed, and only links leave a task.

Exact copies are one text from the start. A pivot's partners meet it in blocks of about `block`, keys with many rows are dealt to
several tasks (plans.joins), and chunks and batches are bounded by bytes.

Defined results: null and empty texts and texts of blanks have no shingles and link with nothing, not even with each other; a text of
fewer words than a shingle has its whole sequence as one; repeated rows are copies; rows of one id with different texts are
judged by their texts; a row with a null id links like others but never names a component; extra columns don't matter, whatever they
are called. Sets are told apart by 64 bits of their digest and shingles by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.joins import spread_join

from .common import WordHashes, ngram_hashes, parallelism, release, ship_package, stored, texts_of, word_array


@dataclass(frozen=True)
class JoinRules:
    words: int = 5
    percent: int = 80  #: least similarity; at least 50
    region: float = 0.3  #: share of the order in which frequencies are counted
    chunk: int = 500  #: most texts that are kept together
    chunk_bytes: int = 1 << 20  #: bytes of shingles from which a chunk ends
    fragments: int = 8  #: cuts of the order in which overlaps are counted
    block: int = 256  #: texts that meet a pivot at once; blocks that meet blocks have four times as many, so texts are copied less
    rounds: int = 2  #: rounds with a few pivots of each list
    growth: int = 4  #: times as many pivots of a list from round to round
    bucket_bytes: int = 1 << 20  #: segments that one group of a counting task holds, about
    few_edges: int = 500_000  #: most edges (8 MB) whose components one task finds; beyond, rounds of joins find them
    broadcast_rows: int = 200_000  #: most rows of ids (some 10 MB) that are broadcast; beyond, joins are shuffled


def shingles(text: str, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    return np.unique(ngram_hashes(word_array(words, hashes), n))


def linked(a: int, b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def spare(n: int, percent: int) -> int:
    """Shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def _chunks(docs: DataFrame, rules: JoinRules, id_col: str, text_col: str) -> DataFrame:
    """Texts in chunks: ids, set sizes, set digests and the region's shingles (at least as many as a prefix), all packed."""
    cut = np.uint64(int(rules.region * 2.0**64))
    names = ("ids", "known", "keys", "sizes", "digests", "counts", "shingles")
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("texts", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in names)])

    def packed(number: int, rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([i if i is not None else 0 for i, *_ in rows], np.int64)
        known = np.array([i is not None for i, *_ in rows], np.uint8)
        blobs = (ids.tobytes(), known.tobytes(), np.array([r[4] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.int64).tobytes(), b"".join(r[2] for r in rows), np.array([len(r[3]) for r in rows], np.int32).tobytes(), b"".join(r[3].tobytes() for r in rows))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(rows)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, size, number = WordHashes(), [], 0, TaskContext.get().partitionId() << 32
        for doc, text, key in _rows(batches):
            s = shingles(text or "", hashes, rules.words)
            least = spare(len(s), rules.percent) + 1 if len(s) else 0
            kept = s[: max(int(np.searchsorted(s, cut)), least)].copy()  # a view would hold the whole set
            rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16), kept, key))
            size += kept.nbytes
            if len(rows) == rules.chunk or size >= rules.chunk_bytes:
                yield packed(number, rows)
                number, rows, size = number + 1, [], 0
        if rows:
            yield packed(number, rows)

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(work, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches; of a batch some at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of packed columns, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _members(chunks: DataFrame) -> DataFrame:
    """id, key (hash of the text), n, node (64 bits of the set's digest; null for empty sets) of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _packs(batches):
            known = np.frombuffer(row["known"], np.uint8).astype(bool)
            sizes = np.frombuffer(row["sizes"], np.int64)
            columns = [np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64), sizes, np.frombuffer(row["digests"], np.int64)[::2]]
            masks = [~known, None, None, sizes == 0]
            yield pa.RecordBatch.from_arrays([pa.array(c, mask=m) for c, m in zip(columns, masks, strict=True)], names=["id", "key", "n", "node"])

    return chunks.select("ids", "known", "keys", "sizes", "digests").mapInArrow(work, "id long, key long, n long, node long")


def _regions(row: dict) -> list[tuple[int, int, np.ndarray]]:
    """(node, size, kept shingles) of a chunk's texts that have any, each set once."""
    counts, sizes = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["sizes"], np.int64)
    values, nodes = np.frombuffer(row["shingles"], np.uint64), np.frombuffer(row["digests"], np.int64)[::2]
    ends = np.cumsum(counts)
    first = {int(nodes[k]): k for k in reversed(range(len(sizes))) if sizes[k]}
    return [(node, int(sizes[k]), values[ends[k] - counts[k] : ends[k]]) for node, k in sorted(first.items())]


def _requests(chunks: DataFrame, fragments: int, cut: int) -> DataFrame:
    """Each chunk's distinct shingles of the region with their counts in it, by fragment of the order."""
    schema = "fragment long, chunk long, shingles binary, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _packs(batches):
            held = _regions(row)
            if not held:
                continue
            values, counts = np.unique(np.concatenate([s for _, _, s in held]), return_counts=True)
            counts = counts[values < np.uint64(cut)].astype(np.int32)
            values = values[values < np.uint64(cut)]
            edges = np.searchsorted(values, np.array([cut * f // fragments for f in range(fragments)] + [cut], np.uint64))
            used = [f for f in range(fragments) if edges[f] < edges[f + 1]]
            parts = [(values[edges[f] : edges[f + 1]].tobytes(), counts[edges[f] : edges[f + 1]].tobytes()) for f in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([row["chunk"]] * len(used), pa.int64()), *(pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1))], names=["fragment", "chunk", "shingles", "counts"])

    return chunks.select("chunk", "sizes", "digests", "counts", "shingles").mapInArrow(work, schema)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment: for each chunk its shingles that occur in two or more texts, with the number of texts."""
    parts = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    values = np.concatenate(parts)
    unique, where = np.unique(values, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, where, np.concatenate([np.frombuffer(x, np.int32) for x in pdf["counts"]]))
    total, at, rows = total[where], 0, []
    for chunk, part in zip(pdf["chunk"], parts, strict=True):
        n = total[at : at + len(part)]
        at += len(part)
        if (n > 1).any():
            rows.append((chunk, part[n > 1].tobytes(), n[n > 1].tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "shingles", "texts"])


def _prefixes(chunks: DataFrame, rules: JoinRules, cut: int) -> DataFrame:
    """(shingle, node, n, pos) for the shared shingles in each set's prefix; pos of the set's shingles come before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _packs(batches):
            answers = row["answers"] or []
            values = np.concatenate([np.frombuffer(a["shingles"], np.uint64) for a in answers] or [np.empty(0, np.uint64)])
            texts = np.concatenate([np.frombuffer(a["texts"], np.int64) for a in answers] or [np.empty(0, np.int64)])
            order = np.argsort(values)
            values, texts = values[order], texts[order]
            keys, nodes, sizes, places = [], [], [], []
            for node, n, s in _regions(row):
                prefix = spare(n, rules.percent) + 1
                inside = s[s < np.uint64(cut)]
                at = np.minimum(np.searchsorted(values, inside), max(0, len(values) - 1))
                common = values[at] == inside if len(values) else np.zeros(len(inside), bool)
                room = prefix - int((~common).sum())
                if room <= 0:
                    continue
                mine = inside[common][np.lexsort((inside[common], texts[at[common]]))][:room]
                beyond = s[len(inside) :][: max(0, room - len(mine))]
                for part, at in ((mine, prefix - room), (beyond, len(inside))):
                    keys.append(part)
                    nodes.append(np.full(len(part), node))
                    sizes.append(np.full(len(part), n))
                    places.append(np.arange(at, at + len(part)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["shingle", "node", "n", "pos"])

    return chunks.mapInArrow(work, "shingle long, node long, n long, pos long")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all the edges a, b that come, by union and find."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    moved = [(x, t) for x in list(parent) if (t := top(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in moved], pa.int64()) for k in (0, 1)], names=["node", "component"])


def components(edges: DataFrame, rules: JoinRules = JoinRules(), most: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of undirected edges a, b, for nodes that aren't the smallest themselves. Up to
    `few_edges` edges go to one task. More are joined by alternating large and small stars, each round written to the shared
    folder: every step is a grouped minimum, which is combined before it moves, and a join by spread_join, so the edges of a hub
    never meet in one task."""
    wide = lambda rows, small, key, spread: spread_join(rows, small, key, spread, broadcast_rows=rules.broadcast_rows)
    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(edges.where("a <> b").select(lower.alias("a"), upper.alias("b")).distinct(), "edges")
    if edges.count() <= rules.few_edges:
        return stored(edges.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
    for _ in range(most):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stored(wide(both.where("b > a"), least, "a", "b").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours move to the smallest of them
        small = stored(large.groupBy("b").agg(F.min("a").alias("m")), "small")
        moved = wide(large, small, "b", "a").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
        after = stored(moved.unionByName(small.select(F.col("m").alias("a"), "b")).distinct(), "edges")
        release(edges, least, large, small)
        edges = after
        tops = after.select("a").distinct().join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        parents = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
        if tops.select(F.lit(1)).unionAll(parents.select(F.lit(1))).isEmpty():
            break
    else:
        raise RuntimeError("components need more rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def matches(left: np.ndarray, left_owner: np.ndarray, right: np.ndarray, right_owner: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner in left, owner in right, number of equal values) of the owners that have any; an owner's values are distinct."""
    order = np.argsort(left, kind="stable")
    left, left_owner = left[order], left_owner[order]
    begin, end = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
    found = np.nonzero(end > begin)[0]
    begin, times, owner = begin[found], (end - begin)[found], right_owner[found]
    width = int(left_owner.max()) + 1 if len(left_owner) else 1
    ends, keys, sums, at = np.cumsum(times), [], [], 0
    while at < len(times):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        n = times[at:stop]
        place = np.repeat(begin[at:stop] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        k, c = np.unique(np.repeat(owner[at:stop], n) * width + left_owner[place], return_counts=True)
        keys.append(k)
        sums.append(c)
        at = stop
    if not keys:
        return (np.empty(0, np.int64),) * 3
    pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
    return pairs % width, pairs // width, np.bincount(where, np.concatenate(sums)).astype(np.int64)


def _partial_overlaps(percent: int):
    """The overlaps, in one fragment, of a bucket's meetings: gid, a, b, the two sizes and tops, and the number of common shingles."""
    names = ["gid", "a", "b", "na", "nb", "ta", "tb", "common"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        segments = [np.frombuffer(x, np.uint64) for x in pdf["segment"]]
        lengths = np.array([len(s) for s in segments], np.int64)
        gid, node, n, top = (pdf[c].to_numpy() for c in ("gid", "node", "n", "top"))
        pivot = pdf["pivot"].to_numpy(bool)
        # a meeting's shingles are told from another's by a bijection of the hash that its id picks
        values = np.concatenate(segments) ^ np.repeat(gid.view(np.uint64), lengths) * np.uint64(0x9E3779B97F4A7C15)
        owner = np.repeat(np.arange(len(pdf)), lengths)
        of_pivot = pivot[owner]
        p, m, common = matches(values[of_pivot], owner[of_pivot], values, owner)
        open_ = ~pivot[m] & (gid[p] == gid[m]) & ((100 + percent) * (lengths[p] + lengths[m] - 2 * common) <= (100 - percent) * (n[p] + n[m]))
        p, m, common = p[open_], m[open_], common[open_]
        return pd.DataFrame(dict(zip(names, (gid[p], node[p], node[m], n[p], n[m], top[p], top[m], common), strict=True)))

    return work, ", ".join(f"{c} long" for c in names)


def _live(lists: DataFrame, rules: JoinRules) -> DataFrame:
    """The lists (shingle, node, n, pos, top) whose texts are not all in one component, with their sizes, first nodes, largest
    components (ties: the largest id), and the first nodes of the smallest ones; stored."""
    parts = lists.groupBy("shingle", "top").agg(F.count("*").alias("c"), F.min("node").alias("first"))
    heads = parts.groupBy("shingle").agg(F.sum("c").alias("m"), F.min("first").alias("first"), F.max(F.struct("c", "top")).alias("main"), F.min(F.struct("c", "top", "first")).alias("least"), F.count("*").alias("parts")).where("parts > 1")
    heads = stored(heads.select("shingle", "m", "first", F.col("main.top").alias("main"), F.col("least.first").alias("other"), (F.col("m") - F.col("main.c")).alias("outside")), "heads")
    live = stored(spread_join(lists, heads, "shingle", "node", broadcast_rows=rules.broadcast_rows), "live")
    release(heads)
    return live


def _links(live: DataFrame, sets: DataFrame, number: int, pivots: int, rules: JoinRules) -> tuple[DataFrame, DataFrame]:
    """One round: the links (a, b) of components that the lists' pivots find, some `pivots` of each, and the lists without these."""
    if number == 0:
        chosen = F.col("node") == F.col("first")
    else:  # pairs of two components have a text outside the largest one; nodes are picked alike in all lists
        chosen = (F.col("top") != F.col("main")) & (F.pmod(F.xxhash64("node", F.lit(number)), F.lit(1 << 30)) * F.col("outside") < float(pivots * (1 << 30))) | (F.col("node") == F.col("other"))
    live = live.withColumn("pivot", chosen)
    held = live.where("pivot").groupBy("shingle").agg(F.collect_set(F.struct("node", "n", "top", "pos")).alias("pivots"))  # about `block` of them at most
    held = stored(held, "pivots")
    rows = spread_join(live.withColumn("blocks", F.ceil(F.col("m") / rules.block)), held, "shingle", "node", broadcast_rows=rules.broadcast_rows // 64)

    def near(p: Column) -> Column:
        """Two components, sizes that can be similar, and enough shingles from this common one on, were it their first."""
        both = p["n"] + F.col("n")
        possible = (100 + rules.percent) * F.least(p["n"] - p["pos"], F.col("n") - F.col("pos")) >= rules.percent * both
        return (p["top"] != F.col("top")) & (~F.col("pivot") | (p["node"] < F.col("node"))) & possible

    pairs = rows.select(F.explode(F.filter("pivots", near)).alias("p"), "node", "n", "top", "blocks")
    pairs = pairs.groupBy(F.struct("p.node", "p.n", "p.top").alias("p"), "node", "n", "top").agg(F.max("blocks").alias("blocks"))
    pairs = stored(pairs.select(F.xxhash64("p.node", "blocks", F.pmod(F.xxhash64("node"), "blocks")).alias("gid"), "p", "node", "n", "top"), "pairs")
    # a pivot meets its partners in blocks of about `block`
    meetings = stored(pairs.select("gid", "node", "n", "top", F.lit(False).alias("pivot")).unionByName(pairs.select("gid", "p").distinct().select("gid", "p.*", F.lit(True).alias("pivot"))), "meetings")
    size = meetings.agg(F.sum("n"), F.count("*")).first()
    buckets = max(1, (size[0] or 0) * 8 // rules.fragments // rules.bucket_bytes)
    met = F.broadcast(meetings) if size[1] <= rules.broadcast_rows else meetings
    work, schema = _partial_overlaps(rules.percent)
    parts = sets.join(met, "node").withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    partial = parts.groupBy("fragment", "bucket").applyInPandas(work, schema)
    sums = partial.groupBy("gid", "a", "b").agg(F.sum("common").alias("common"), *[F.first(c).alias(c) for c in ("na", "nb", "ta", "tb")])
    found = stored(sums.where(100 * F.col("common") >= rules.percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
    release(held, pairs, meetings)
    return found, live.where("NOT pivot").select("shingle", "node", "n", "pos", "top")


def _rest(live: DataFrame, sets: DataFrame, rules: JoinRules) -> DataFrame:
    """The links (a, b) of components among all texts of the lists that are left, block by block."""
    nodes = live.select("node", "n", "top").distinct()
    joined = components(live.select(F.col("first").alias("a"), F.col("node").alias("b")), rules)
    grouped = stored(spread_join(nodes, joined, "node", "n", "left", rules.broadcast_rows).select("node", "n", "top", F.coalesce("component", "node").alias("grp")), "groups")
    sizes = stored(grouped.groupBy("grp").agg(F.ceil(F.count("*") / (4 * rules.block)).cast("int").alias("blocks")), "sizes")
    dealt = spread_join(grouped, sizes, "grp", "node", broadcast_rows=rules.broadcast_rows).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other")).alias("gid"), "node", "n", "top", (F.col("mine") > F.col("other")).alias("right"))
    met = stored(met, "meetings")
    size = met.agg(F.sum("n"), F.count("*")).first()
    buckets = max(1, (size[0] or 0) * 8 // rules.fragments // rules.bucket_bytes)
    if size[1] <= rules.broadcast_rows:
        met = F.broadcast(met)
    parts = sets.join(met, "node").withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    matrices = parts.groupBy("fragment", "bucket").applyInPandas(_matrices, "gid long, " + ", ".join(f"{c} binary" for c in MATRIX))
    return stored(matrices.groupBy("gid").applyInPandas(_summed(rules.percent), "a long, b long").distinct(), "links")


#: The two sides of a meeting, and its partial overlaps row by row.
MATRIX = ("left", "left_n", "left_top", "right", "right_n", "right_top", "common")


def _matrices(pdf: pd.DataFrame) -> pd.DataFrame:
    """The partial overlaps of each meeting in one fragment."""
    rows = []
    for gid, part in pdf.groupby("gid", sort=False):
        on_right = part["right"].to_numpy(bool)
        sides = [np.nonzero(~on_right)[0], np.nonzero(on_right)[0] if on_right.any() else np.arange(len(part))]
        segments = [np.frombuffer(x, np.uint64) for x in part["segment"]]
        flat = [(np.concatenate([segments[k] for k in side] or [np.empty(0, np.uint64)]), np.repeat(np.arange(len(side)), [len(segments[k]) for k in side])) for side in sides]
        common = np.zeros((len(sides[0]), len(sides[1])), np.int32)
        a, b, n = matches(*flat[0], *flat[1])
        common[a, b] = n
        columns = [part[c].to_numpy(np.int64) for c in ("node", "n", "top")]
        rows.append((gid, *(c[side].tobytes() for side in sides for c in columns), zstandard.compress(common.tobytes(), 1)))
    return pd.DataFrame(rows, columns=["gid", *MATRIX])


def _summed(percent: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """The components that a meeting's sums link."""
        held = []
        for side in ("left", "right"):
            parts = [[np.frombuffer(x, np.int64) for x in pdf[c]] for c in (side, f"{side}_n", f"{side}_top")]
            node, first = np.unique(np.concatenate(parts[0]), return_index=True)
            held.append((node, *(np.concatenate(p)[first] for p in parts[1:]), [np.searchsorted(node, x) for x in parts[0]]))
        (_, na, ta, rows), (_, nb, tb, columns) = held
        total = np.zeros((len(na), len(nb)), np.int64)
        for at, to, blob in zip(rows, columns, pdf["common"], strict=True):
            total[np.ix_(at, to)] += np.frombuffer(zstandard.decompress(blob), np.int32).reshape(len(at), len(to))
        hit = (100 * total >= percent * (na[:, None] + nb[None, :] - total)) & (ta[:, None] != tb[None, :])
        i, j = np.nonzero(hit)
        links = np.unique(np.column_stack([np.minimum(ta[i], tb[j]), np.maximum(ta[i], tb[j])]), axis=0)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return work


def _labelled(docs: DataFrame, rules: JoinRules, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), n, node and top (one value a component; null without shingles) of every row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    wide = lambda rows, small, key, spread, how: spread_join(rows, small, key, spread, how, rules.broadcast_rows)
    cut = int(rules.region * 2.0**64)
    chunks = stored(_chunks(docs, rules, id_col, text_col), "shingles")
    members = stored(_members(chunks), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    fragments = max(parallelism(spark), int(total * rules.region) // 1_000_000)
    answers = _requests(chunks, fragments, cut).groupBy("fragment").applyInPandas(_shared, "chunk long, shingles binary, texts binary")
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("shingles", "texts")).alias("answers"))  # bounded by a chunk's bytes
    answered = chunks.select("chunk", "sizes", "digests", "counts", "shingles").join(gathered, "chunk", "left")
    prefixes = stored(_prefixes(answered, rules, cut), "prefixes")
    live = _live(prefixes.distinct().withColumn("top", F.col("node")), rules)
    wanted = stored(live.select("node").distinct(), "wanted")
    # the first row of each wanted set gives its text once more
    first = F.min(F.struct("id", "key")).alias("f")
    texts = wide(members.where("node IS NOT NULL"), wanted, "node", "id", "left_semi").groupBy("node").agg(first)
    sets = stored(_sets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")), stored(texts.select("node", "f.id", "f.key"), "first"), rules), "sets")
    release(chunks, prefixes)
    tops, number, pivots = None, 0, 1
    while not live.isEmpty():
        if number < rules.rounds:
            links, rest = _links(live, sets, number, pivots, rules)
        else:
            links, rest = _rest(live, sets, rules), live.where("false").select("shingle", "node", "n", "pos", "top")
        if not links.isEmpty():
            moved = components(links, rules).withColumnsRenamed({"node": "top", "component": "now"})
            step = lambda rows, moved=moved: wide(rows, moved, "top", "node", "left").withColumn("top", F.coalesce("now", "top")).drop("now")
            tops = stored(step((wanted.withColumn("top", F.col("node")) if tops is None else tops).select("node", "top")), "tops")
            rest = step(rest)
        after = _live(rest, rules)
        release(live, links)
        live, number, pivots = after, number + 1, min(rules.block, pivots * rules.growth)
    release(sets)
    if tops is None:
        return members.withColumn("top", F.col("node"))
    return wide(members, tops, "node", "key", "left").withColumn("top", F.coalesce("top", "node"))


def join(docs: DataFrame, rules: JoinRules = JoinRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id."""
    rows = stored(_labelled(docs, rules, id_col, text_col).select("id", "n", "top"), "labelled")
    # only components of several rows need a name
    named = rows.where("top IS NOT NULL").groupBy("top").agg(F.min("id").alias("component"), F.count("*").alias("rows")).where("rows > 1").select("top", "component")
    out = spread_join(rows, named, "top", "id", "left", rules.broadcast_rows)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _sets(docs: DataFrame, wanted: DataFrame, rules: JoinRules) -> DataFrame:
    """node, fragment and segment (packed shingles) of the first copies in `wanted`, made again from their texts."""
    if wanted.count() <= rules.broadcast_rows:
        wanted = F.broadcast(wanted)
    same = (docs["key"] == wanted["key"]) & docs["id"].eqNullSafe(wanted["id"])
    texts = docs.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    edges = np.array([(f << 64) // rules.fragments for f in range(1, rules.fragments)], np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for node, text in _rows(batches):
            parts = np.split(s := shingles(text, hashes, rules.words), np.searchsorted(s, edges))
            used = [f for f, part in enumerate(parts) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([parts[f].tobytes() for f in used], pa.binary())], names=["node", "fragment", "segment"])

    return texts.mapInArrow(work, "node long, fragment int, segment binary")


def representatives(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """One row of docs for each component: of its smallest id, then the smallest hash of the text, then of all columns. Rows without
    shingles and rows with a null id stay."""
    rows = stored(_labelled(docs, rules, "doc_id", "text").where("top IS NOT NULL AND id IS NOT NULL").select("id", "key", "top"), "labelled")
    best = rows.groupBy("top").agg(F.min(F.struct("id", "key")).alias("best"), F.count("*").alias("rows")).where("rows > 1").select("top", "best")
    judged = stored(spread_join(rows, best, "top", "id", "inner", rules.broadcast_rows).select(F.col("id").alias("doc_id"), F.col("key").alias("_key"), (F.struct("id", "key") == F.col("best")).alias("_stays")), "judged")
    gone = judged.where("NOT _stays").select("doc_id", "_key").distinct()
    again = judged.where("_stays").groupBy("doc_id", "_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "_key")
    keyed = docs.withColumn("_key", F.xxhash64("text"))

    def sized(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows else keys

    left = keyed.join(sized(gone), ["doc_id", "_key"], "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    whole = F.struct(*docs.columns)
    repeated = left.join(sized(again), ["doc_id", "_key"], "left_semi").groupBy("doc_id", "_key").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("_row"))
    return left.join(sized(again), ["doc_id", "_key"], "left_anti").select(*docs.columns).unionByName(repeated.select("_row.*"))
