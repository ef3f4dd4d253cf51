"""Secrets in texts: three fixed patterns, and strings in a sensitive context that a dictionary-primed zstandard model can't predict.

A string of 16 or more token characters after a sensitive word is a candidate. Its novelty is the number of bytes by which
it makes the compressed surroundings longer, with a dictionary of identifiers (fixed ones and those that a share of the corpus' texts
have near sensitive words) and the surrounding text, less all copies of the candidate itself, as history. Random
strings, with or without digits, stay incompressible; long ones cost about the bits a character of their alphabet, 4 in hexadecimal
and 6 in base 64, and are held against these. Identifiers and paths cost little. A string that costs enough at one of its places in a
sensitive context is reported wherever it stands in the text as a token of its own.

The dictionary depends on the shares of texts, not on their number: a corpus and several copies of it give the same spans. Only
identifiers that are no part of a longer token get into it, so no secret primes for itself.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows are judged one by one; a null id
stays null; extra columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, texts_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z_][A-Za-z0-9_]{3,14}(?![A-Za-z0-9+/_-])", re.A)
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api_?key|private_?key|credential|bearer|authorization|client_?id|signature|session_?id|aws_", re.I | re.A)
CONTEXTS = ("pass", "secret", "token", "key", "credential", "bearer", "authorization", "client", "signature", "session", "aws_")
#: Identifiers that code has around credentials without being one.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer credential session_id signature username user_name account environment config settings "
    "default example placeholder changeme your_api_key your_token_here localhost http https www com org net github "
    "import from return function const let var export string value name type object class public static void null "
    "true false none self this get set put post delete request response header content application json xml html "
    "database connection host port server service endpoint region bucket table index version release license "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx ################ "
)


@dataclass(frozen=True)
class SecretRules:
    context_before: int = 48  #: characters before a candidate in which a sensitive word must stand
    surroundings: int = 256  #: characters on either side that prime the compressor
    novel_share: float = 0.62  #: marginal compressed bytes a candidate must cost, as a share of its length; less for long ones of less than 62 characters' alphabets
    distinct: int = 8  #: different characters a candidate must have
    assign_length: int = 8
    identifiers: int = 1000  #: identifiers of the corpus that prime the compressor, 15 characters each at most
    least_texts: float = 0.04  #: share of the texts with sensitive words that must have such an identifier


def marginal_bytes(before: str, candidate: str, after: str, identifiers: str = IDENTIFIERS) -> int:
    """Compressed bytes that the candidate adds to its surroundings."""
    primer = zstandard.ZstdCompressionDict((identifiers + before + "\n" + after).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    with_it = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False)
    return len(with_it.compress(candidate.encode())) - len(with_it.compress(b""))


CODED_FROM = 64  #: zstandard leaves shorter runs of new characters as they are, at 8 bits each
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
CLASSES = tuple((re.compile(p), n) for p, n in (("[0-9]", 10), ("[a-z]", 26), ("[A-Z]", 26), ("[+/_=-]", 2)))


def least_share(candidate: str, rules: SecretRules = SecretRules()) -> float:
    """The share of its length that a candidate must cost, by the bits a character of its alphabet where zstandard codes by these."""
    if len(candidate) < CODED_FROM:
        return rules.novel_share
    size = 16 if HEXADECIMAL.fullmatch(candidate) else sum(n for p, n in CLASSES if p.search(candidate))
    return rules.novel_share * min(1.0, math.log2(size) / math.log2(62))


def base_spans(text: str, rules: SecretRules = SecretRules()) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    low = text.lower()  # finds a keyword sooner than the pattern would
    found = []
    if any(k in low for k in KEYWORDS):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= rules.assign_length]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def sensitive_ends(text: str) -> list[int]:
    """Where sensitive words end, in order."""
    low = text.lower()
    return [m.end() for m in SENSITIVE.finditer(text)] if any(k in low for k in CONTEXTS) else []


def without_copies(text: str, lo: int, hi: int, string: str) -> str:
    """text[lo:hi] less what belongs to copies of the string, those that reach over its ends included."""
    lo = max(0, lo)
    kept, at = [], lo
    place = text.find(string, max(0, lo - len(string) + 1), hi + len(string) - 1)
    while place >= 0:
        kept.append(text[at : max(at, min(place, hi))])
        at = max(at, place + len(string))
        place = text.find(string, place + len(string), hi + len(string) - 1)
    return "".join(kept) + text[at:hi]


def novel_spans(text: str, taken: list[tuple[int, int, int]], rules: SecretRules = SecretRules(), identifiers: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """(start, 3, end) of further strings in a sensitive context that don't compress, and of their copies. taken: spans by start. Words,
    candidates and taken spans are each gone through once, and once more if there is something to report."""
    ends = sensitive_ends(text)
    if not ends:
        return []
    novel: set[str] = set()
    for m, free in _candidates(text, ends[0], taken):
        a, b = m.span()
        last = bisect_right(ends, a)
        if not free or m[0] in novel or not last or a - ends[last - 1] > rules.context_before or len(set(m[0])) < rules.distinct:
            continue
        before, after = without_copies(text, a - rules.surroundings, a, m[0]), without_copies(text, b, b + rules.surroundings, m[0])
        if marginal_bytes(before, m[0], after, identifiers) >= least_share(m[0], rules) * len(m[0]):
            novel.add(m[0])
    return [(m.start(), 3, m.end()) for m, free in _candidates(text, 0, taken) if free and m[0] in novel] if novel else []


def _candidates(text: str, begin: int, taken: list[tuple[int, int, int]]) -> Iterator[tuple[re.Match, bool]]:
    """Candidates, and whether no taken span overlaps them."""
    reach, at = -1, 0  # the furthest end of the taken spans that begin before the candidate's end
    for m in CANDIDATE.finditer(text, begin):
        while at < len(taken) and taken[at][0] < m.end():
            reach, at = max(reach, taken[at][2]), at + 1
        yield m, reach <= m.start()


def identifier_dictionary(docs: DataFrame, rules: SecretRules = SecretRules(), text_col: str = "text") -> str:
    """The identifiers that most texts have near their sensitive words (ties: by name), the most frequent last, where zstandard
    finds them cheapest, after the fixed ones; a share of the texts with sensitive words must have one. All texts are counted, combined in each
    task; only the chosen ones come to the driver."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in texts_of(batch.column(0)):
                held: set[str] = set()
                done = 0
                found = sensitive_ends(text)
                if found:
                    held.add("")  # counts the texts
                for end in found:
                    stop = end + rules.surroundings
                    whole = IDENTIFIER.finditer(text, max(done, end - rules.surroundings), stop)
                    held.update(m[0] for m in whole if m.end() < stop or stop >= len(text))  # none that the window cuts
                    done = stop
                seen.update(held)
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    counts = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = counts.orderBy(F.desc("n"), "word").limit(rules.identifiers + 1).collect()  # the texts themselves come first
    least = rules.least_texts * chosen[0]["n"] if chosen else 0
    return " ".join([IDENTIFIERS, *(r["word"] for r in reversed(chosen[1:]) if r["n"] >= least)]) + " "


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, rules: SecretRules = SecretRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and spans of the fixed patterns, novel spans, and all spans by start."""
    spark = docs.sparkSession
    ship_package(spark)
    primer = spark.sparkContext.broadcast(identifier_dictionary(docs, rules, text_col))
    out = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
        + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                base = base_spans(text, rules)
                novel = novel_spans(text, base, rules, primer.value)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)] + [len(novel)]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(sorted(base + novel))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=out.names)

    return docs.select(id_col, text_col).mapInArrow(work, out)
