import math
from collections import Counter

from graphloom.llm import lm_score as m


def brute(docs, good, most, prior):
    words = {d: (t or "").encode().lower().split() for d, t in docs}
    counts = Counter(w for d, t in docs for w in (t or "").encode().lower().split())
    levels = sorted(set(counts.values()), reverse=True)
    least = None
    for n in levels:
        if sum(c >= n for c in counts.values()) > most:
            break
        least = n
    known = {w for w, c in counts.items() if least and c >= least}
    size = len(known) + 2
    ids = {d: [w if w in known else None for w in ws] for d, ws in words.items()}
    models, grams = [], lambda ws: list(zip(["<", *ws], ws, strict=False))
    for chosen in (good, set(ids)):
        uni, pair, hist = Counter(), Counter(), Counter()
        for d in chosen & set(ids):
            for h, w in zip(["<", *ids[d]], ids[d], strict=False):
                uni[w] += 1
                pair[h, w] += 1
                hist[h] += 1
        models.append((uni, pair, hist, sum(uni.values()), chosen))
    out = {}
    for d, ws in ids.items():
        loss = [None, None]
        if ws:
            loss = []
            for uni, pair, hist, n, chosen in models:
                own = d in chosen
                mine = (Counter(ws), Counter(grams(ws)), Counter(h for h, _ in grams(ws))) if own else (Counter(),) * 3
                q = {w: (uni[w] - mine[0][w] + 1) / (n - own * len(ws) + size) for w in ws}
                loss.append(sum(-math.log((pair[h, w] - mine[1][h, w] + prior * q[w]) / (hist[h] - mine[2][h] + prior)) for h, w in grams(ws)) / len(ws))
        out[d] = (len(ws), *loss)
    return out


def test_same_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = brute(rows, good, 500, 2.0)
    for rules in (m.LmRules(vocabulary=500, batch_tokens=3000), m.LmRules(vocabulary=500, broadcast_ids=0, batch_texts=7)):
        for r in m.score(docs, labels, rules).collect():
            n, a, b = want[r.doc_id]
            assert r.n_tokens == n
            if n:
                assert abs(r.target_loss - a) < 1e-9 and abs(r.background_loss - b) < 1e-9 and abs(r.score - (a - b)) < 1e-9
            else:
                assert r.score is None and r.target_loss is None


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (None, 1), (5, None), (77, 1)], "doc_id long, quality int")
    rows = m.score(odd_docs, labels).collect()
    assert len(rows) == 11 and {r.doc_id for r in rows if r.score is None} == {1, 2, 6}
    by = lambda i: {(round(r.target_loss, 12), round(r.background_loss, 12)) for r in rows if r.doc_id == i}
    assert by(5) == by(None) and len(by(4)) == 1  # copies are judged alike; 4 is a target, whose own tokens the target model leaves out
    assert {b for _, b in by(4)} == {b for _, b in by(5)} and by(4) != by(5)
    assert m.score(no_docs, labels).count() == 0
    assert all(r.score is not None for r in m.score(odd_docs, labels.where("false")).collect() if r.n_tokens)


def test_every_word_counts(spark):
    """Words beyond any 16-bit table: 70,000 different ones, most of them once, against the same counts with no bound."""
    rows = [(k, " ".join(f"w{i}" for i in range(700 * k, 700 * k + 700)) + " w1 w1 w2") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(0, 100, 2)], "doc_id long, quality int")
    want = brute(rows, {k for k in range(0, 100, 2) if k % 3}, 10**9, 2.0)
    for r in m.score(docs, labels, m.LmRules(batch_tokens=9000)).collect():
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n and abs(r.target_loss - a) < 1e-9 and abs(r.background_loss - b) < 1e-9
