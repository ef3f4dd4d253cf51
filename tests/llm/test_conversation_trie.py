import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversation_trie as c

TURNS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """conversation -> its turns (role, text) in order."""
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    convs = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    return dict(convs)


def rebuilt(convs, group=20, most=4):
    out = {}
    for i, own in convs.items():
        h = zlib.crc32(str(i).encode()) % most
        out[i] = convs.get(i - i % group, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for i, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(i)
    rows = {}
    for path in sorted(nodes, key=len, reverse=True):
        ids = sorted(nodes[path])
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        ends = ",".join(str(i) for i in ids if len(convs[i]) == len(path))
        saved = (len(ids) - 1) * words + sum(rows[k][6] for k in kids)
        rows[path] = (ids[0], len(path), min(nodes[path[:-1]]) if path else None, len(ids), len(kids), sum(rows[k][5] for k in kids) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(rows.values(), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_turns(seed, convs=70):
    rng = random.Random(seed)
    rows = []
    for i in range(convs):
        start = rng.choice([0, 0, 1, 2])
        text = ["hello  there", "hello", "", None, "a b\x0bc d"][start]
        for t in range(rng.choice([0, 1, 2, 3, 6])):
            rows.append((i, t if rng.random() < 0.9 else None, rng.choice(["user", "user", "assistant", None]), text if rng.random() < 0.6 else f"{rng.randint(0, 2)} x"))
    rows += [(1000 + i, t, "user", "copy of a long one") for i in range(12) for t in range(9)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shared", [False, True])
def test_against_brute_force(spark, monkeypatch, seed, shared):
    monkeypatch.setattr(c, "HOT", 5)
    rows = random_turns(seed)
    steps, convs = c.conversation_steps(spark.createDataFrame(rows, TURNS).repartition(4))
    told = ordered(rows)
    if shared:
        (steps, convs), told = c.with_shared_heads(steps, convs), rebuilt(told)
    assert rows_of(c.prefix_trie(steps, convs)) == brute(told)


def test_hot_keys_without_broadcasts(spark, monkeypatch):
    """A conversation with a third of all turns and a class with a third of all conversations, every join salted."""
    monkeypatch.setattr(c, "HOT", 3)
    plain = c.spread_join
    monkeypatch.setattr(c, "spread_join", lambda *a, **b: plain(*a, **b | {"broadcast_rows": 0}))
    rows = [(5, t, "user", f"turn {t}") for t in range(60)] + [(100 + i, 0, "user", "same") for i in range(30)] + [(100 + i, 1, "user", "same" if i < 20 else str(i)) for i in range(30)]
    steps, convs = c.conversation_steps(spark.createDataFrame(rows, TURNS))
    assert rows_of(c.prefix_trie(steps, convs)) == brute(ordered(rows))


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", None), (None, 0, "user", "x"), (3, 0, "user", long), (3, 0, "user", long), (7, 0, "user", long), (21, 5, "u", "a"), (21, 5, "u", "a"), (21, 5, "v", "a"), (23, 1, "u", "x")]
    turns = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(x) for x in ("depth", "key", "words", "place", "length", "node", "edge", "class", "n", "first")])
    steps, convs = c.conversation_steps(turns)
    assert rows_of(c.prefix_trie(steps, convs)) == brute(ordered(rows))
    assert rows_of(c.prefix_trie(*c.with_shared_heads(steps, convs))) == brute(rebuilt(ordered(rows)))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], TURNS)
    assert c.prefix_trie(*c.conversation_steps(none)).collect() == []
    one = [(4, 0, "user", "a b"), (4, 1, "user", "c")]
    assert rows_of(c.prefix_trie(*c.conversation_steps(spark.createDataFrame(one, TURNS)))) == brute(ordered(one))
    # every conversation is cut down to nothing: all of them end at the root
    bare = spark.createDataFrame([(1, 0), (2, 0)], "conv_id long, length long")
    assert rows_of(c.prefix_trie(spark.createDataFrame([], "conv_id long, depth long, key binary, words long"), bare)) == brute({1: [], 2: []})


def test_end_digests_over_several_runs(spark):
    ids = [(3, 2, i) for i in range(0, 50_000, 3)] + [(1, 1, i) for i in range(40)]
    ended = spark.createDataFrame(ids, "depth long, node long, conv_id long")
    got = {(r.node, r.depth): r.digest for r in c.end_digests(ended).collect()}
    assert got == {(n, d): hashlib.sha256(",".join(str(i) for x, y, i in ids if (x, y) == (d, n)).encode()).hexdigest() for n, d in ((2, 3), (1, 1))}
