import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup as d

WIDE = d.CopyRules()
NARROW = d.CopyRules(broadcast_rows=0, hot_rows=2)  # every join shuffled, every group of three dealt out


def brute(rows, largest=True):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        told = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not told, hashlib.sha256(text.encode()).hexdigest()))
            told |= i == keep
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rules", [WIDE, NARROW])
def test_odd_rows(spark, odd_docs, no_docs, rules):
    want = brute([tuple(r) for r in odd_docs.collect()])
    assert rows_of(d.groups(odd_docs, rules)) == want
    assert sum(r[3] for r in want) == len({r[4] for r in want})
    assert d.groups(no_docs, rules).collect() == []


def test_clashing_names_and_ties(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(30)] * 2
    docs = spark.createDataFrame(rows, "id long, text string").select("id", "text", *[F.lit(1).alias(c) for c in ("hash", "sha", "rows", "size", "keep_id", "kept", "copy", "place", "texts")])
    assert rows_of(d.groups(docs, NARROW, id_col="id")) == brute(rows)


@pytest.mark.parametrize("rules", [WIDE, NARROW])
@pytest.mark.parametrize("hashed", [lambda t: F.lit("one").cast("binary"), lambda t: F.unhex(F.substring(F.md5(t), 1, 2))])
def test_collisions_are_told_apart_by_bytes(spark, rules, hashed):
    """With a hash that collides, and a third of all rows of one text."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", None, "", *[f"text {k}" for k in range(40)]]) if i % 3 else "hot") for i in range(300)] + [(299, "hot"), (7, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(d.groups(docs, rules, hashed=hashed)) == brute(rows)


def test_smallest_stays(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (None, "a"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(d.groups(docs, d.CopyRules("smallest"))) == brute(rows, largest=False)
    with pytest.raises(ValueError):
        d.groups(docs, d.CopyRules("first"))


def test_other_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x")], "name string, body string")
    assert [(r["name"], r.keep_id, r.kept) for r in d.groups(docs, id_col="name", text_col="body").orderBy("name").collect()] == [("a", "b", False), ("b", "b", True)]
