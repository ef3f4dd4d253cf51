from pyspark.sql import functions as F

from graphloom.llm import url_rules as u

CASES = {
    "HTTP://WWW.Example.COM/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://blog.example.com/en/": ("blog.example.com", "/en/", "example.com/en/", "block"),
    "http://example.com/En/": ("example.com", "/En/", "com/", "allow"),
    "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
    "http://a.net/de/1": ("a.net", "/de/1", None, "allow"),
    "http://notexample.com": ("notexample.com", "", None, "allow"),
    "http://xcom/": ("xcom", "/", None, "allow"),
    "//x.com/": ("", "", None, "allow"),
    "http://x.com?u=http://y.com/": ("x.com", "", None, "allow"),
    "http://spam-farm.example.org/a": ("spam-farm.example.org", "/a", None, "block"),
    "http://İ.org/": ("İ.org", "/", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
}


def test_judgements(spark):
    table = spark.createDataFrame([(k, url, "old") for k, url in enumerate(CASES)], "page_id long, url string, verdict string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in u.judge(table).collect()}
    assert got == CASES
    assert u.judge(table.where("false")).count() == 0
    assert u.judge(table.unionAll(table)).count() == 2 * len(CASES)


def test_index_takes_the_rarest_token(spark):
    table = spark.createDataFrame([(k, "http://cheap.example/pills" if k else "http://cheap.example/") for k in range(3)], "page_id long, url string")
    index = [r.token for r in u.rule_index(table, u.rule_table(spark)).collect()]
    assert "pills" in index and "cheap" not in index and len(index) == len(u.PATTERN_RULES)


def test_no_python_on_executors(spark):
    plan = u.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_rules_from_a_table(spark, monkeypatch, tmp_path):
    """Thousands of rules, with and without a broadcast, against every rule tried on every URL."""
    import random
    import re

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    rules = [(f"rule {k:05d}", f"{(a := word())} {(b := word())}", f"/{a}-{b}(/|$)") for k in range(6000)]
    (tmp_path / "rules.tsv").write_text("name\ttokens\tpattern\n" + "".join("\t".join(x) + "\n" for x in rules))
    urls = [f"http://h/{word()}-{word()}/{word()}-{word()}" for _ in range(400)] + ["http://h/" + rules[0][1].replace(" ", "-")] * 300 + [None, None, ""]
    compiled = [(n, re.compile(p)) for n, _, p in rules]
    want = [min((n for n, p in compiled if p.search(u_)), default=None) if u_ else None for u_ in urls]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (100_000, 10):
        monkeypatch.setattr(u, "BROADCAST_RULES", most)
        monkeypatch.setattr(u, "BROADCAST_URLS", most)
        got = {x.page_id: x.pattern_rule for x in u.judge(table, u.read_rules(spark, f"file://{tmp_path}/rules.tsv"), ()).collect()}
        assert [got[k] for k in range(len(urls))] == want and any(want)


def test_odd_tables(spark, odd_docs):
    import pytest

    pages = odd_docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "host", "score")
    out = u.judge(pages, u.rule_table(spark, ()))
    assert out.columns == ["page_id", "url", "score", "host", "path", "rule", "pattern_rule", "verdict"] and out.count() == 11
    with pytest.raises(Exception, match="literal tokens"):
        u.judge(pages, u.rule_table(spark, (u.PatternRule("bad", ("a.b",), "x"),))).collect()
