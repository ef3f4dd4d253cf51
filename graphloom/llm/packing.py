"""Best-fit packing of tokenised documents into sequences, by best-two-fit.

Every document becomes its token ids and one end id; longer ones than a sequence are cut into full pieces and a rest. A bin is
filled greedily with the largest piece that fits; when nothing fits, its smallest piece is taken out again if two unpacked pieces
fill the widened gap more tightly. Pieces are dealt at random, by their place in the stored table of pieces, into groups of a bounded
number of tokens and of pieces, which are packed each by one task; a group wastes at most its last bins, so with `group_tokens` of thousands of sequences the loss is below 0.1 %.

Defined results: null and empty texts hold the end id alone; repeated rows are packed as often as they come; a null id stays
null; ties between pieces of one length go to the smallest (id, piece); an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, stored, texts_of


@dataclass(frozen=True)
class PackingRules:
    vocabulary: str  #: path of the tokenizer's file
    sequence: int = 4096
    end_id: int = 1
    group_tokens: int = 8_000_000  #: tokens that one task packs, about
    group_pieces: int = 200_000  #: and pieces


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Words(dict):
    """Ids (little-endian unsigned 32-bit) of text between ASCII blanks. Where the vocabulary's rules never reach across blanks, a
    text's ids are those of its words, and words are remembered up to a bound. Words of ASCII and Latin-1 letters skip the general
    normaliser: for them it only lowers letters, and the pre-tokenizer's classes are plain."""

    BOUND = 400_000
    PLAIN = re.compile(r"[\x21-\x7e\xc0-\xff]{1,200}")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rule = splits_at_blanks(path)
        self.whole = rule is None
        self.letters = byte_letters()
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        if rule:
            latin = "a-z\xdf-\xf6\xf8-\xff"  # lower-case letters among the plain characters
            self.cut = re.compile(rule.replace(r"[\p{L}]+", f"[{latin}]+").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", latin + "0-9")).findall

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.PLAIN.fullmatch(text) and not ("<" in text and any(t in text for t in self.special)):
            parts = self.cut(text.lower())
            ids = [t.id for p in parts for t in self.model.tokenize(p if p.isascii() else "".join([self.letters[b] for b in p.encode()]))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        made = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.BOUND:
                self.clear()
            self[word] = made
        return made

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [b"".join(map(self.__getitem__, t.encode().split())) for t in texts]


def splits_at_blanks(path: str) -> str | None:
    """The pattern by which the vocabulary's own pre-tokenizer picks words, if it has the form that drops white space and lowers
    letters first, so that words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    rule = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
    fits = kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    fits = fits and rule.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return rule if fits and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])) else None


def pieces(docs: DataFrame, rules: PackingRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    ship_package(docs.sparkSession)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    end = np.array([rules.end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(rules.vocabulary)
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rows = []
                for row, ids in enumerate(words.ids(texts_of(batch.column(1)))):
                    data = ids + end
                    for k, a in enumerate(range(0, len(data), 4 * rules.sequence)):
                        part = data[a : a + 4 * rules.sequence]
                        rows.append((row, k, a // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=out.names)

    return docs.select(id_col, text_col).mapInArrow(work, out)


_KEPT: dict[str, Words] = {}


def _words(path: str) -> Words:
    """One cache for each worker process."""
    if path not in _KEPT:
        _KEPT[path] = Words(path)
    return _KEPT[path]


def best_two_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(bin, offset) for each length; equal lengths are used in the order they come."""
    waiting: dict[int, list[int]] = {}
    for i in reversed(range(len(lengths))):
        waiting.setdefault(lengths[i], []).append(i)
    there = sum(1 << n for n in waiting)  # bit n: a piece of n tokens waits

    def largest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        i = waiting[n].pop()
        if not waiting[n]:
            del waiting[n]
            there ^= 1 << n
        return i

    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    bins = 0
    while there:
        inside, gap = [], size
        while (n := largest(gap)) > 0:
            inside.append(take(n))
            gap -= n
        if gap and there:
            small = lengths[inside[-1]]
            wide, best = gap + small, (small, 0, 0)
            a = largest(wide - 1)
            while a > 0 and 2 * a > best[0]:
                b = largest(min(a, wide - a))
                if b == a and len(waiting[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == wide:
                        break
                a = largest(a - 1)
            if best[1]:
                back = inside.pop()
                inside += [take(best[1]), take(best[2])]
                if small not in waiting:
                    there |= 1 << small
                waiting.setdefault(small, []).append(back)
        at = 0
        for i in inside:
            placed[i] = (bins, at)
            at += lengths[i]
        bins += 1
    return placed


def pack(docs: DataFrame, rules: PackingRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    cut = stored(pieces(docs, rules, id_col, text_col), "pieces")
    tokens, count = cut.where(F.col("length") < rules.sequence).agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(tokens or 0) // rules.group_tokens), -(-count // rules.group_pieces))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    full = cut.where(F.col("length") == rules.sequence).select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_group").sort_values([id_col, "piece"], kind="stable", ignore_index=True)
        at = best_two_fit(pdf["length"].tolist(), rules.sequence)
        pdf["sequence_id"] = [(b << 24) | int(key[0]) for b, _ in at]
        pdf["offset"] = [o for _, o in at]
        return pdf

    # the place in the stored table deals out repeated rows, too, and is the same whenever a task reads it again
    place = (F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(groups))
    rest = cut.where(F.col("length") < rules.sequence).select("*", F.pmod(*place).alias("_group"))
    packed = rest.groupBy("_group").applyInPandas(work, schema)
    numbered = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    return numbered.unionByName(packed)
