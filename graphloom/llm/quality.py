"""Quality rules: hashed word and character n-gram logistic regression over labelled rows, calibrated, against a fixed threshold.

Features of a text are the relative frequencies of its hashed word 1- and 2-grams and of its hashed character 4-grams, so a text's
score is an average of weights and needs no per-text dictionary. The model is fitted on at most `train_rows` labelled documents
(of the documents with a label, those with the smallest hashes of their ids), a share of which is held out to calibrate the probability (Platt).

Rules that need no model go first: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged alike; a null id stays
null; null labels don't train; without labels of both kinds there is no model and every document that passes the base rules is
kept, with a null probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, MULTIPLIERS, WordHashes, ngram_hashes, ship_package, texts_of, word_array

WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    bits: int = 15  #: of a hash, for words and for characters
    train_rows: int = 1500  #: bound of the labelled sample
    holdout: float = 0.25  #: share of it that calibrates
    epochs: int = 80
    l2: float = 1e-6
    threshold: float = 0.5  #: least calibrated probability of good quality


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  #: words, then characters
    bias: float
    slope: float
    shift: float

    def probability(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40))))


def base_counts(text: str, words: list[bytes], hashed: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return chars, symbols, len(lines) - len(set(lines)), repeated_words(hashed)


def repeated_words(hashed: np.ndarray) -> int:
    """Words in windows of 8 that occur twice or more."""
    grams = ngram_hashes(hashed, WINDOW)
    ranked = np.sort(grams)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    starts = np.unique(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    edge = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def feature_ids(text: str, hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word n-grams, and of the character 4-grams behind them."""
    shift = np.uint64(64 - bits)
    words = np.concatenate([ngram_hashes(hashed, 1), ngram_hashes(hashed, 2)]) >> shift
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(c) < 4:
        return words.astype(np.int64), np.empty(0, np.int64)
    low = [np.uint32(m & 0xFFFFFFFF) for m in MULTIPLIERS[:4]]
    four = c[:-3] * low[0]
    for k in (1, 2, 3):
        four += c[k : k - 3 or None] * low[k]
    chars = (four ^ four >> np.uint32(15)) * low[0] >> np.uint32(32 - bits)
    return words.astype(np.int64), chars.astype(np.int64) + (1 << bits)


def raw_score(model: QualityModel, text: str, hashed: np.ndarray, bits: int) -> float:
    words, chars = feature_ids(text, hashed, bits)
    return model.bias + sum(float(model.weights[x].mean()) for x in (words, chars) if len(x))


def _fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rules: QualityRules) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by full-batch Adam; the classes weigh alike."""
    rows = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    ids, values = (np.concatenate([r[k] for r in x]) for k in (0, 1))
    size = 2 << rules.bits
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, bias, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rules.epochs + 1):
        z = np.bincount(rows, values * w[ids], len(x)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        grad = np.append(np.bincount(ids, values * g[rows], size) + rules.l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 1.0 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w.astype(np.float32).astype(np.float64), bias


def _calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift, by Newton steps on smoothed targets."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return 1.0, 0.0
    scale = float(np.abs(raw).mean()) or 1.0
    a = np.column_stack([raw / scale, np.ones(len(raw))])
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    p = np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a @ p, -40, 40)))
        h = (a * (q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(h, a.T @ (q - target) + 1e-3 * p)
    return float(max(p[0], 1e-6) / scale), float(p[1])


def train(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> QualityModel | None:
    """The model of the labelled sample; what comes to the driver is bounded by train_rows rows of 2**(bits + 1) features."""
    ship_package(docs.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.max("quality").alias("_quality"))
    usable = usable.join(docs.select(id_col), id_col, "left_semi")  # labels without a document would use up the sample
    sample = usable.orderBy(F.xxhash64(id_col), id_col).limit(rules.train_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(id_col, text_col, "_quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, values = [], []
            for text in texts_of(batch.column(1)):
                data = text.encode()
                parts = [np.unique(x, return_counts=True) for x in feature_ids(text, word_array(data.split(), hashes), rules.bits)]
                ids.append(np.concatenate([i for i, _ in parts]).astype(np.uint32).tobytes())
                values.append(np.concatenate([n / max(1, n.sum()) for _, n in parts]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], names=["id", "quality", "ids", "values"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("quality", labels.schema["quality"].dataType), T.StructField("ids", T.BinaryType()), T.StructField("values", T.BinaryType())])
    got = sorted(rows.mapInArrow(features, schema).dropDuplicates(["id"]).collect(), key=lambda r: r["id"])
    y = np.array([1 if r["quality"] > 0 else 0 for r in got])
    if not 0 < y.sum() < len(y):
        return None
    x = [(np.frombuffer(r["ids"], np.uint32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(np.float64)) for r in got]
    held = np.random.default_rng(7).permutation(len(y)) < rules.holdout * len(y)
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    w, bias = _fit([r for r, h in zip(x, held, strict=True) if not h], y[~held], rules)
    raw = np.array([bias + float(w[i] @ v) for i, v in x])
    slope, shift = _calibrated(raw[held], y[held]) if held.any() else (1.0, 0.0)
    return QualityModel(w, bias, slope, shift)


def verdict(text: str, hashes: WordHashes, model: QualityModel | None, rules: QualityRules) -> tuple:
    """The values of the columns that judge adds."""
    words = text.encode().split()
    hashed = word_array(words, hashes)
    counts = base_counts(text, words, hashed)
    failed = len(words) < rules.min_words or 100 * counts[3] > rules.max_repeat_percent * len(words)
    p = model.probability(raw_score(model, text, hashed, rules.bits)) if model else None
    return len(words), *counts, failed, p, not failed and (p is None or p >= rules.threshold)


def passing(docs: DataFrame, model: QualityModel | None, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all columns as they are, whatever these are called."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, fitted = WordHashes(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([verdict(t, hashes, fitted, rules)[-1] for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def judge(docs: DataFrame, model: QualityModel | None, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept; these names
    replace columns of docs that are called so."""
    spark = docs.sparkSession
    ship_package(spark)
    new = {k: T.LongType() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": T.BooleanType(), "probability": T.DoubleType(), "kept": T.BooleanType()}
    own = [c for c in docs.columns if c not in new]
    shared = spark.sparkContext.broadcast(model)  # 2**(bits + 1) weights
    at = own.index(text_col)
    out = T.StructType([docs.schema[c] for c in own] + [T.StructField(k, t) for k, t in new.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, fitted = WordHashes(), shared.value
        for batch in batches:
            rows = [verdict(text, hashes, fitted, rules) for text in texts_of(batch.column(at))]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=out.names)

    return docs.select(*own).mapInArrow(work, out)
