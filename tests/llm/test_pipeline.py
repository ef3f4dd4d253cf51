import corpus_pipeline as c
from graphloom.llm import decontam, jaccard, pii, quality
from graphloom.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    start = docs
    labels = table(spark, SF, "labels")
    seen = []
    for name, stage in c.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), "test")
        assert after.columns == start.columns and after.dtypes == start.dtypes, name
        seen.append((docs, after))
        docs = after
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (a, b), (_, d), (_, e), (_, f) = seen
    verdict = {r.doc_id: r.kept for r in quality.judge(a, quality.train(a, labels)).collect()}
    assert ids(b) == [k for k in ids(a) if verdict[k]]
    assert ids(d) == sorted(r.doc_id for r in jaccard.join(b).collect() if r.doc_id == r.component_id)
    bench = [r.text for r in table(spark, SF, "benchmark").collect()]
    dirty = {r.doc_id for r in d.collect() if any(decontam.normalised(t) in decontam.normalised(r.text) for t in bench)}
    assert not dirty & set(ids(e)) and set(ids(d)) - set(ids(e)) <= {r.doc_id for r in decontam.leaks(d, table(spark, SF, "benchmark")).collect()}
    text = {r.doc_id: r.text for r in e.collect()}
    assert all(r.text == pii.pseudonymise(text[r.doc_id], pii.Feistel(pii.PiiKey().key))[0] for r in f.collect())
    packed = c.STAGES[-1][1](spark, f, SF).collect()
    assert sorted({r.doc_id for r in packed}) == ids(f)


def test_run(spark):
    rows = c.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
