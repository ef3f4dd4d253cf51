import random

import numpy as np
import pytest

from graphloom.llm import jaccard as j


def brute(rows, percent=80):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words)} - {b""} if len(words) < 5 else {b" ".join(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((str(i), len(s), str(least.get(top(k)))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(out):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect())


def corpus(seed, groups, copies, length, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randrange(1, 4)))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(r.randrange(3, length))]
        if g % 3 == 0:
            base += passage
        for _ in range(r.randrange(1, copies)):
            text = list(base)
            for _ in range(r.randrange(0, edits)):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 1009, r.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed, 40 // seed, 8, 120, 6)
    rules = j.JoinRules(block=3, chunk=7, fragments=16, broadcast_rows=1, few_edges=0) if seed == 2 else j.JoinRules()
    assert got(j.join(spark.createDataFrame(rows, "doc_id long, text string"), rules)) == brute(rows)


def test_large_group_in_blocks(spark):
    rows = corpus(5, 3, 120, 90, 9)
    for rounds in (0, 1):
        assert got(j.join(spark.createDataFrame(rows, "doc_id long, text string"), j.JoinRules(block=8, chunk=16, rounds=rounds))) == brute(rows)


def test_matches():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    owner = np.repeat(np.arange(12), [len(s) for s in sets])
    values = np.concatenate(sets)
    for at_once in (1, 17, 1 << 20):
        left, right, n = j.matches(values[owner < 5], owner[owner < 5], values, owner, at_once)
        got_ = dict(zip(zip(left.tolist(), right.tolist(), strict=True), n.tolist(), strict=True))
        assert got_ == {(a, b): k for a in range(5) for b in range(12) if (k := len(np.intersect1d(sets[a], sets[b])))}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)]
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    for rules in (j.JoinRules(), j.JoinRules(few_edges=0), j.JoinRules(few_edges=0, broadcast_rows=1)):
        found = {x.node: x.component for x in j.components(spark.createDataFrame(edges, "a long, b long"), rules).collect()}
        assert all(found.get(x, x) == min(s) for x, s in want.items())


def test_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(j.join(odd_docs)) == brute(rows)
    assert j.join(no_docs).count() == 0
    kept = j.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, None, 6, 7, 9}


def test_one_row_of_each_group(spark):
    """Repeated rows of the smallest id leave one; another text under the same id is judged by itself; other columns decide last."""
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"else{k}" for k in range(40))
    rows = [(4, text, "a"), (4, text, "a"), (4, text, "b"), (5, text, "c"), (9, text + " more", "d"), (9, other, "e"), (2, other + " end", "f"), (7, None, "g"), (7, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for rules in (j.JoinRules(), j.JoinRules(broadcast_rows=0)):
        kept = sorted((r.doc_id, r.text or "") for r in j.representatives(docs, rules).collect())
        assert kept == [(2, other + " end"), (4, text), (7, ""), (7, "")]
