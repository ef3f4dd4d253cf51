"""python -m graphloom QUERY SF_DIR OUT, or fetch URL OUT --starttime --endtime: one query's rows, or weather replies, as files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom import catalog, queries  # noqa: F401
from graphloom.sources import observations, tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("what", help="a registered query, or fetch")
    parser.add_argument("source", help="folder of the parquet tables, or the service's address")
    parser.add_argument("filename", help="where the result goes")
    parser.add_argument("--starttime", default="2011-03-13")
    parser.add_argument("--endtime", default="2011-03-14")
    parser.add_argument("--query", default="")
    parser.add_argument("--bbox", default="")
    args = parser.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.what == "fetch":
        spark.dataSource.register(observations.CoverageSource)
        replies = spark.read.format("coverage").option("url", args.source).option("start", args.starttime).option("end", args.endtime).option("query", args.query).option("bbox", args.bbox).load()
        tables.write_csv(observations.observations(replies), args.filename, sep=";")
    else:
        catalog.QUERIES[args.what](spark, args.source).write.mode("overwrite").parquet(args.filename)


if __name__ == "__main__":
    main()
