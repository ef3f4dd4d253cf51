"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.state import shared_dir, ship_package  # noqa: F401

#: What `[^\x20\x09-\x0D]+` leaves out, which is also where bytes.split() splits.
BLANKS = " \t\n\x0b\x0c\r"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and executors may be lost afterwards."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes stored tables from which nothing is read any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    BOUND = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


#: Odd multipliers of the n-gram hashes, by position.
MULTIPLIERS = tuple(xxhash.xxh64_intdigest(b"position %d" % i) | 1 for i in range(16))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(MULTIPLIERS[0])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of word hashes, in order; none if there are fewer than n."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count] * np.uint64(MULTIPLIERS[0])
    for k in range(1, n):
        total = total + words[k : k + count] * np.uint64(MULTIPLIERS[k])
    return mixed(total)


def word_array(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def texts_of(column) -> list[str]:
    """An Arrow column of texts as Python strings, nulls as empty texts."""
    return [x or "" for x in column.to_pylist()]
