"""Day windows as a stream from a server that fails now and then, and hourly windows of the events as a stream."""

import threading
import urllib.parse
from collections import Counter
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from graphloom.plans.state import ship_package
from graphloom.sources import observations


@pytest.fixture
def server():
    """Answers with a reply of one position for the window's start; every window fails once, those from 2021 on are refused."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            start = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["starttime"][0]
            asked[start] += 1
            status = 400 if start >= "2021" else 503 if asked[start] == 1 else 200
            body = f"<positions>60.1 24.9 {int(datetime.fromisoformat(start).timestamp())}</positions>" if status == 200 else ""
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/wfs", asked
    http.shutdown()


def stream(spark, url, end, folder):
    source = spark.readStream.format("coverage").option("url", url).option("start", "2020-01-01").option("end", end).option("wait", "0.01").load()
    query = source.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(once=True).start()
    query.awaitTermination()
    return sorted((r.doc_id, r.xml) for r in spark.read.parquet(f"{folder}/out").collect())


def test_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    ship_package(spark)
    spark.dataSource.register(observations.CoverageSource)
    url, asked = server
    first = stream(spark, url, "2020-01-03", tmp_path)
    assert [d for d, _ in first] == ["2020-01-01T00:00:00", "2020-01-02T00:00:00"]
    assert asked == {f"2020-01-0{d}T00:00:00Z": 2 for d in (1, 2)}  # each failed once
    later = stream(spark, url, "2020-01-04T12:00:00", tmp_path)
    assert later[:2] == first and [d for d, _ in later] == [f"2020-01-0{d}T00:00:00" for d in (1, 2, 3, 4)]
    assert asked == {f"2020-01-0{d}T00:00:00Z": 2 for d in (1, 2, 3, 4)}  # nothing is asked for again
    batch = spark.read.format("coverage").option("url", url).option("start", "2020-01-01").option("end", "2020-01-04T12:00:00").option("wait", "0.01").load()
    assert sorted((r.doc_id, r.xml) for r in batch.collect()) == later


def test_offsets_and_replay():
    reader = observations.CoverageStreamReader({"url": "http://h", "start": "2020-01-01", "end": "2020-01-02T06:00:00"})
    first, last = reader.initialOffset(), reader.latestOffset()
    assert (first, last) == ({"until": "2020-01-01T00:00:00"}, {"until": "2020-01-02T06:00:00"})
    windows = [(p.start, p.end) for p in reader.partitions(first, last)]
    assert windows == [(datetime(2020, 1, 1), datetime(2020, 1, 2)), (datetime(2020, 1, 2), datetime(2020, 1, 2, 6))]
    assert windows == [(p.start, p.end) for p in reader.partitions(first, last)] and reader.partitions(last, last) == []
    begun = datetime.now() - timedelta(days=10)
    going = datetime.fromisoformat(observations.CoverageStreamReader({"start": begun.isoformat(), "settle": "48"}).latestOffset()["until"])
    assert (going - begun) % timedelta(days=1) == timedelta(0) and timedelta(days=7) <= going - begun <= timedelta(days=9)
    ahead = observations.CoverageStreamReader({"start": "2999-01-01"})
    assert ahead.initialOffset() == ahead.latestOffset()


def test_refused_at_once(server):
    url, asked = server
    with pytest.raises(OSError):
        observations.fetched(f"{url}?starttime=2021-01-01T00:00:00Z", wait=0.01)
    assert asked["2021-01-01T00:00:00Z"] == 1
    with pytest.raises(OSError):
        observations.fetched(f"{url}?starttime=2020-05-01T00:00:00Z", tries=1)
