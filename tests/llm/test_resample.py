import hashlib
import math
import random
import re
import sys
import zlib

from pyspark.sql import functions as F

from graphloom.llm import resample as r
from graphloom.llm.queries import op12_resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text):
    words = WORD.findall((text or "").translate(FOLD))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def brute(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    held = [(i, *features(x)) for i, x in docs]
    for _, _, buckets in held:
        for b in buckets:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    S, T = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((b + 1.0) * (S + 10_000) / ((a + 1.0) * (T + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, n, buckets in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        out.append((i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    chosen = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], math.inf if x[0] is None else x[0]))
    places = [(x, k + 1) for k, x in enumerate(chosen[: 5 * len(chosen) // 100])]
    rest = [(x, None) for x in chosen[len(places) :] + [x for x in out if x[1] < 20]]
    return sorted([(x[0], x[2], x[3], x[4], k) for x, k in places + rest], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows_of(op12_resampling(spark, SF))
    assert got == brute(docs, target) and sum(x[4] is not None for x in got) == 5 * sum(features(x)[0] >= 20 for _, x in docs) // 100


def test_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(3)
    words = ["Éa", "éA", "x1", "Ⅷ", "日本", "\x00b", "Zz-z", "ẞ", "İ"]
    more = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(18, 45)))) for i in range(40)] + [(100, "A b " * 30), (100, "A b " * 30)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    target = ["éa x1 日本", None, "", "the quick brown fox"]
    clashing = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "bucket", "buckets", "n_words", "s", "rank", "weight", "_p", "_w")])
    table = spark.createDataFrame([(x,) for x in target], "text string")
    assert rows_of(r.resample(clashing, table)) == brute([tuple(x) for x in docs.collect()], target)
    assert r.resample(no_docs, table).collect() == []
    assert rows_of(r.resample(docs, table.where("false"))) == brute([tuple(x) for x in docs.collect()], [])


def test_only_ascii_is_folded(spark):
    every = spark.range(1, sys.maxunicode + 1).where("id < 55296 OR id > 57343").select(F.col("id"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    wrong = every.select("id", "c", r.ascii_lower(F.col("c")).alias("low")).where((F.col("c") != F.col("low")) & ~F.col("id").between(65, 90))
    assert wrong.count() == 0


def test_draws_towards_the_target(spark):
    """Of documents of two kinds, those worded like the target are drawn far more often than their share."""
    rng = random.Random(1)
    kind = lambda k: " ".join(f"{'near' if rng.random() < 0.7 else 'far'}{rng.randint(0, 30)}" if k else f"far{rng.randint(0, 30)}" for _ in range(60))
    docs = spark.createDataFrame([(i, kind(i % 10 == 0)) for i in range(600)], "doc_id long, text string")
    target = spark.createDataFrame([(kind(True),) for _ in range(50)], "text string")
    drawn = [x.doc_id for x in r.resample(docs, target).where("rank IS NOT NULL").orderBy("rank").collect()]
    assert len(drawn) == 30 and all(i % 10 == 0 for i in drawn)
