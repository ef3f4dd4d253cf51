"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and reduced to words joined by single blanks. An item of m characters may differ from a
passage by k = floor(m * error_rate) edits; cut into k + 1 pieces, one piece must occur unchanged, so an automaton of all pieces
finds every place worth a look, and Myers' bit-parallel edit distance (its search form) verifies the windows around them.

Items are a stated query set: they are measured first, and sets beyond `block_chars` characters are applied in blocks, each to
all documents. Only an item block comes to the driver and is broadcast; with several blocks each one's rows are written before the
next block is read. A worker process keeps the automaton of the block it last used.

Defined results: null and empty texts match nothing; items that are null or have no words match nothing; items too short for an
edit must occur exactly, between word boundaries; repeated documents and repeated items each give their own rows; a null id
stays null.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, stored, texts_of

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LeakRules:
    error_rate: float = 0.06
    block_chars: int = 8_000_000  #: characters of items that are broadcast at once


def normalised(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def cut_pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    n, m = k + 1, len(item)
    edges = [i * m // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: str, window: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of the pattern in the window with at most `most` edits, the first of equals."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(window):
        eq = masks[c] if c in masks else 0
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Items:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rules: LeakRules) -> None:
        import ahocorasick

        self.items = [(i, norm, int(len(norm) * rules.error_rate)) for i, text in items if (norm := normalised(text))]
        uses: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, norm, k) in enumerate(self.items):
            for at, piece in cut_pieces(norm, k):
                uses[piece].append((n, at))
        self.pieces = ahocorasick.Automaton()
        for piece, where in uses.items():
            self.pieces.add_word(piece, (len(piece), where))
        if uses:
            self.pieces.make_automaton()

    def found(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of each item's best passage, by the item's order; places in the normalised text, the
        start of an inexact one to within its distance."""
        if not self.items:
            return []
        norm = normalised(text)
        places: dict[int, set[int]] = defaultdict(set)
        for last, (length, where) in self.pieces.iter(norm):
            for n, at in where:
                places[n].add(last - length + 1 - at)
        out = []
        for n in sorted(places):
            item, pattern, k = self.items[n]
            m, best = len(pattern), None
            exact = next((s for s in sorted(places[n]) if s >= 0 and norm.startswith(pattern, s) and (k or self.bounded(norm, s, s + m))), None)
            if exact is not None:
                out.append((item, 0, exact, exact + m))
                continue
            if not k:
                continue
            windows: list[list[int]] = []
            for s in sorted(places[n]):
                a, b = max(0, s - k), min(len(norm), s + m + k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            for a, b in windows:
                if (hit := myers(pattern, norm[a:b], k)) and (best is None or hit[0] < best[1]):
                    best = (item, hit[0], max(0, a + hit[1] - m), a + hit[1])
            if best:
                out.append(best)
        return out

    @staticmethod
    def bounded(norm: str, a: int, b: int) -> bool:
        return (a == 0 or norm[a - 1] == " ") and (b == len(norm) or norm[b] == " ")


def leaks(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end of every item that a document holds."""
    ship_package(docs.sparkSession)
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", kind), *(T.StructField(c, T.LongType()) for c in ("distance", "start", "end"))])
    read = docs.select(id_col, text_col)
    made = []
    for held, last in item_blocks(benchmark, rules):
        found = _scan(read, held, schema, rules)
        if not last:
            found = stored(found, "leaks")
            held.unpersist()
        made.append(found)
    return reduce(DataFrame.unionAll, made)


def item_blocks(benchmark: DataFrame, rules: LeakRules) -> Iterator[tuple[Broadcast, bool]]:
    """The items as broadcasts of about block_chars characters at most, one at least, one after the other; and whether it is the last."""
    spark = benchmark.sparkSession
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // rules.block_chars))
    parts = [items] if count == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]
    for number, part in enumerate(parts, 1):
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str))), number == count


_KEPT: dict[str, Items] = {}


def _items(held: Broadcast, rules: LeakRules) -> Items:
    name, items = held.value
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Items(items, rules)
    return _KEPT[name]


def _scan(docs: DataFrame, held, schema: T.StructType, rules: LeakRules) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(held, rules)
        for batch in batches:
            rows = [(row, *hit) for row, text in enumerate(texts_of(batch.column(1))) for hit in items.found(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

    return docs.mapInArrow(work, schema)


def clean(docs: DataFrame, benchmark: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The documents that hold no item, judged by their own text; all columns stay."""
    ship_package(docs.sparkSession)
    at, out = docs.columns.index("text"), docs
    for held, last in item_blocks(benchmark, rules):

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = _items(held, rules)
            for batch in batches:
                yield batch.filter(pa.array([not items.found(t) for t in texts_of(batch.column(at))], pa.bool_()))

        out = out.mapInArrow(work, docs.schema)
        if not last:
            out = stored(out, "cleaned")
            held.unpersist()
    return out
