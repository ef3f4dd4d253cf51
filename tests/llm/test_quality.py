import re

from graphloom.llm import quality as q
from graphloom.llm.common import WordHashes, word_array


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


TEXTS = [None, "", "a", "# a | b\n# a | b\n\n\n \n", "w " * 30, " ".join(map(str, range(25))), " ".join(map(str, [*range(25), *range(9)])), "é x\x0by\x1cz " + " ".join("abcdefghijklmnopqrstuvwxyz"), " ".join(map(str, [*range(8), *range(8), *range(60)]))]


def test_base_columns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in q.judge(docs, None).collect()}
    for k, text in enumerate(TEXTS):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text), text
        assert r.kept == (not r.base_failed) and r.probability is None


def test_window_hits():
    words = [b"%d" % (k % 11) for k in range(40)]
    assert q.repeated_words(word_array(words, WordHashes())) == plain(" ".join(w.decode() for w in words))[4]


def test_learns_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = q.train(docs, labels.where("doc_id % 3 <> 0"))
    held = q.judge(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("NOT base_failed").collect()  # those that reach the model
    assert sum(r.kept for r in held if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in held)
    assert sum(r.kept for r in held if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in held)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (3, 1), (None, 0), (99, 1)], "doc_id long, quality int")
    model = q.train(odd_docs, labels)
    assert q.judge(odd_docs, model).count() == 11 and q.judge(no_docs, model).count() == 0
    assert q.train(odd_docs, labels.where("quality = 1")) is None and q.train(no_docs, labels) is None
    assert q.judge(odd_docs, model).columns.count("kept") == 1
    kept = q.passing(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes and q.passing(no_docs, model).count() == 0
    assert sorted(r.n_chars or 0 for r in kept.collect()) == sorted(r.n_chars or 0 for r in odd_docs.collect() if q.verdict(r.text or "", WordHashes(), model, q.QualityRules())[-1])


def test_character_grams():
    """Four letters make a gram in any script, wherever they stand."""
    for text in ("abcd", "дом№", "日本語文", "\U0001f600abc"):
        words, chars = q.feature_ids(text, word_array(text.encode().split(), WordHashes()), 15)
        twice = q.feature_ids("x" + text, word_array([b"x"], WordHashes()), 15)[1]
        assert len(chars) == 1 and len(twice) == 2 and twice[1] == chars[0]


def test_score_from_plain_formula(spark):
    """Probability by hand: averages of the weights of all grams, through the calibration."""
    weights = __import__("numpy").random.default_rng(1).standard_normal(2 << 15)
    model = q.QualityModel(weights, 0.25, 2.0, -0.5)
    text = "the quick brown fox jumps over the lazy dog " * 3
    words, chars = q.feature_ids(text, word_array(text.encode().split(), WordHashes()), 15)
    raw = 0.25 + sum(weights[k] for k in words) / len(words) + sum(weights[k] for k in chars) / len(chars)
    row = q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert len(words) == 27 + 26 and len(chars) == len(text) - 3
    assert abs(row.probability - 1 / (1 + __import__("math").exp(-(2.0 * raw - 0.5)))) < 1e-9
