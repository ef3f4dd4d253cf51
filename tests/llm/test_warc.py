import gzip
import hashlib
import io

import pytest

from graphloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")


def test_round_trip_with_revisits(spark):
    big, small = "<p>é</p>" * 200, "<p>x</p>"
    rows = [(1, "http://a/", big, ""), (5, "http://b/ü\r\nX: y", big, ""), (3, None, big, ""), (4, "u", small, ""), (6, "u", small, ""), (7, "u", None, ""), (8, "u", "", ""), (None, "u", big, ""), (5, "http://b/", big, "")]
    got = sorted(map(tuple, warc.round_trip(pages(spark, rows)).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        old = len(data) >= 1000 and page is not None and page < 5
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", 5 if old else None))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_members_and_checks():
    data = [warc.record(k, "u", b"x" * k * 50_000, None, "2000-01-01T00:00:00Z") for k in range(4)]
    stream = b"".join(gzip.compress(d) for d in data)
    assert list(warc.members(io.BytesIO(stream))) == data
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(stream[:-3])))
    assert warc.parsed(data[2])[:2] == (2, 100_000)
    for broken in (data[2][:-1], data[2].replace(b"xxx", b"xyx", 1), data[2] + b"!"):
        with pytest.raises(warc.WarcError):
            warc.parsed(broken)


def test_archives_roll(spark):
    rows = [(k, "u", f"page {k} " * 100, "") for k in range(50)]
    rules = warc.WarcRules(archive_bytes=5000)
    from graphloom.llm.common import fresh_path

    manifest = warc.write_archives(warc.with_references(pages(spark, rows), rules), fresh_path(spark, "warc"), rules)
    assert manifest.count() > 5
    assert sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(50))


def test_hot_payloads(spark):
    """A payload with a third of the rows, and as many small pages, beyond the broadcast: same records, no partition with all of them."""
    big, small = "x" * 1500, "tiny"
    rows = [(k, "http://a/", big if k % 3 == 0 else small if k % 3 == 1 else f"{k:06d}" * 300) for k in range(900)] + [(2000, None, "z" * 400_000), (2001, None, "z" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for rules in (warc.WarcRules(), warc.WarcRules(broadcast_rows=0)):
        got = {r.page_id: r for r in warc.round_trip(pages, rules).collect()}
        assert len(got) == 902
        assert all(got[k].refers_to == (897 if k % 3 == 0 and k != 897 else None) for k in range(900))
        assert (got[2000].record_type, got[2000].refers_to, got[2000].payload_bytes) == ("revisit", 2001, 400_000)
