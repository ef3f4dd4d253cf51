import random

from graphloom.llm import decontam as d


def distance_in(pattern, text):
    """Least edits of the pattern to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edited(text, edits, r):
    chars = list(text)
    for _ in range(edits):
        k = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[k] = r.choice("abcdefgh")
        elif kind == 1:
            del chars[k]
        else:
            chars.insert(k, r.choice("abcdefgh"))
    return "".join(chars)


def test_myers():
    r = random.Random(1)
    for _ in range(200):
        pattern = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randrange(0, 120)))
        want, most = distance_in(pattern, text), r.randrange(0, 40)
        got = d.myers(pattern, text, most)
        # an empty match (the whole pattern left out) is no occurrence
        assert (got is None and (want > most or want == len(pattern))) or got[0] == want


def test_same_as_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(12)] + [(12, None), (13, "..."), (14, "xyzzy"), (0, "again " + word())]
    docs = []
    for k in range(120):
        body = [word() for _ in range(60)]
        if k % 2:
            body.insert(30, edited(items[k % 12][1], k % 11, r).upper())
        docs.append((k, " ".join(body)))
    docs += [(200, "an xyzzy here"), (201, "xyzzyx"), (None, items[0][1]), (202, None), (203, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, text in docs:
        for item, it in items:
            p, t = d.normalised(it or ""), d.normalised(text or "")
            k = int(len(p) * 0.06)
            if p and ((k and distance_in(p, t) <= k) or (not k and f" {p} " in f" {t} ")):
                want.add((doc, item))
    found = d.leaks(table, bench).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want and len(want) > 40
    blocks = d.leaks(table, bench, d.LeakRules(block_chars=300)).collect()
    assert {(x.doc_id, x.item_id) for x in blocks} == want
    bad = {x for x, _ in want}
    assert sorted(str(x.doc_id) for x in d.clean(table, bench).collect()) == sorted(str(x) for x, _ in docs if x not in bad)


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "seven wizards brew a potion of honey and thyme")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in d.leaks(odd_docs, bench).collect()) == ["4", "4", "5", "None"]
    assert d.leaks(no_docs, bench).count() == 0 and d.leaks(odd_docs, bench.where("false")).count() == 0
    assert d.clean(odd_docs, bench.where("false")).count() == 11 and d.clean(odd_docs, bench).columns == odd_docs.columns
