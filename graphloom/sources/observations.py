"""Weather observations from multi-point coverage replies in XML: JVM-side parsing, and a data source with one partition a day.

A reply lists positions as whitespace-separated triples (lat, lon, epoch seconds) and one line of values per position; its
observed property's address names the values."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _text(xml: Column, name: str) -> Column:
    return F.btrim(F.xpath_string(xml, F.lit(f"//*[local-name()='{name}']")))


def positions(replies: DataFrame, xml: str = "xml", key: str = "doc_id") -> DataFrame:
    """(key, pos, lat, lon, epoch)."""
    flat = F.split(_text(F.col(xml), "positions"), r"\s+")
    triples = replies.select(key, flat.alias("v")).select(key, "v", F.explode(F.sequence(F.lit(0), (F.size("v") / 3).cast("int") - 1)).alias("pos"))
    at = lambda k: F.element_at("v", F.col("pos") * 3 + k)
    return triples.select(key, "pos", at(1).cast("double").alias("lat"), at(2).cast("double").alias("lon"), at(3).cast("long").alias("epoch"))


def tuples(replies: DataFrame, xml: str = "xml", key: str = "doc_id") -> DataFrame:
    """(key, pos, field, value) with NaN as null; fields count from 0."""
    lines = replies.select(key, F.posexplode(F.split(_text(F.col(xml), "doubleOrNilReasonTupleList"), r"\s*\n\s*")).alias("pos", "line"))
    values = lines.select(key, "pos", F.posexplode(F.split(F.btrim("line"), r"\s+")).alias("field", "text"))
    return values.select(key, "pos", "field", F.nullif(F.col("text").cast("double"), F.lit(float("nan"))).alias("value"))


def parameters(replies: DataFrame, xml: str = "xml", key: str = "doc_id") -> DataFrame:
    """(key, field, param) from the observed property's address."""
    href = F.xpath_string(F.col(xml), F.lit("//*[local-name()='observedProperty']/@*[local-name()='href']"))
    return replies.select(key, F.posexplode(F.split(F.regexp_extract(href, r"param=([^&]*)", 1), ",")).alias("field", "param"))


def labels(metadata: DataFrame, xml: str = "xml") -> DataFrame:
    """(param, label) of a metadata document, whose properties carry an id and a label."""
    ids = F.xpath(F.col(xml), F.lit("//*[local-name()='ObservableProperty']/@*[local-name()='id']"))
    names = F.xpath(F.col(xml), F.lit("//*[local-name()='ObservableProperty']/*[local-name()='label']/text()"))
    return metadata.select(F.explode(F.arrays_zip(ids.alias("param"), names.alias("label"))).alias("p")).select("p.param", F.btrim("p.label").alias("label"))


def observations(replies: DataFrame, xml: str = "xml", key: str = "doc_id") -> DataFrame:
    """(key, pos, lat, lon, epoch, param, value): values zipped with positions by place."""
    named = tuples(replies, xml, key).join(parameters(replies, xml, key), [key, "field"])
    return named.join(positions(replies, xml, key), [key, "pos"]).select(key, "pos", "lat", "lon", "epoch", "param", "value")


def day_windows(start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """Windows of a day, the last one shorter."""
    out = []
    while start < end:
        stop = min(start + timedelta(days=1), end)
        out.append((start, stop))
        start = stop
    return out


def request_url(base: str, query: str, box: str, start: datetime, end: datetime) -> str:
    stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    return base + "?" + urllib.parse.urlencode({"service": "WFS", "version": "2.0.0", "request": "getFeature", "storedquery_id": query, "bbox": box, "starttime": stamp(start), "endtime": stamp(end)})


class DayWindow(InputPartition):
    def __init__(self, start: datetime, end: datetime) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


def fetched(url: str, tries: int = 4, wait: float = 1.0) -> str:
    """The reply at an address. Errors of the server or the network are tried again after a wait that doubles; refused requests raise at once."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as reply:
                return reply.read().decode("utf-8")
        except urllib.error.HTTPError as error:
            if error.code < 500 and error.code != 429 or attempt == tries - 1:
                raise
        except OSError:
            if attempt == tries - 1:
                raise
        time.sleep(wait * 2**attempt)
    raise ValueError("at least one try is needed")


def _reply(options: dict, partition: DayWindow) -> Iterator[tuple]:
    url = request_url(options["url"], options.get("query", ""), options.get("bbox", ""), partition.start, partition.end)
    yield (partition.start.isoformat(), fetched(url, int(options.get("tries", 4)), float(options.get("wait", 1.0))))


class CoverageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[DayWindow]:
        read = lambda k: datetime.fromisoformat(self.options[k])
        return [DayWindow(a, b) for a, b in day_windows(read("start"), read("end"))]

    def read(self, partition: DayWindow) -> Iterator[tuple]:
        return _reply(self.options, partition)


class CoverageStreamReader(DataSourceStreamReader):
    """Whole days from `start` on as they pass; an offset is the first moment not read. A batch's windows follow from its two offsets alone, so a
    batch that is run again makes the same requests. Days end `settle` hours late, when their observations are in; with `end`, the
    stream goes up to there and its last window may be shorter."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.start = datetime.fromisoformat(options["start"])

    def initialOffset(self) -> dict:
        return {"until": self.start.isoformat()}

    def latestOffset(self) -> dict:
        passed = datetime.now(UTC).replace(tzinfo=self.start.tzinfo) - timedelta(hours=float(self.options.get("settle", 0)))
        end = self.options.get("end")
        if end and datetime.fromisoformat(end) <= passed:
            return {"until": max(self.start, datetime.fromisoformat(end)).isoformat()}
        return {"until": (self.start + max(passed - self.start, timedelta(0)) // timedelta(days=1) * timedelta(days=1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[DayWindow]:
        return [DayWindow(a, b) for a, b in day_windows(datetime.fromisoformat(start["until"]), datetime.fromisoformat(end["until"]))]

    def read(self, partition: DayWindow) -> Iterator[tuple]:
        return _reply(self.options, partition)


class CoverageSource(DataSource):
    """spark.dataSource.register(CoverageSource); spark.read.format("coverage").option("url", ...).option("start", "2020-01-01")..., or
    spark.readStream with the same options. tries and wait (seconds) say how often and after what a failed request is made again."""

    @classmethod
    def name(cls) -> str:
        return "coverage"

    def schema(self) -> str:
        return "doc_id string, xml string"

    def reader(self, schema) -> CoverageReader:
        return CoverageReader(dict(self.options))

    def streamReader(self, schema) -> CoverageStreamReader:
        return CoverageStreamReader(dict(self.options))
