"""Cross-entropy difference of two matched bigram models (Moore and Lewis).

The target model counts the documents labelled as of good quality, the background model all documents; both share one vocabulary and
one smoothing, so per-token loss differences compare like with like:
    p(w | h) = (c(h w) + prior * q(w)) / (c(h) + prior)    q(w) = (c(w) + 1) / (N + V)
How far a model trusts its bigrams follows from its counts of the history, so the smaller model backs off by itself, to the whole of
q where it has never seen the history, and p sums to one over the vocabulary (the words and one for unseen ones). A document's own
tokens are left out of the counts that score it, in both models (in the target's where it is a target): it is judged by the others.
score = mean over tokens of (target loss - background loss), in nats; lower is closer to the target.

Every word counts as itself, as a 64-bit hash, at every size of the input: no table of words is broadcast or comes to the driver. A
bound on the vocabulary can be set; it then holds every word that occurs at least as often as the least count with which it has at most
`vocabulary` words, and the others are one unknown word. Documents are encoded once, in batches. Each batch sends its distinct bigrams
and words with their counts to the fragments of the hash space, where both models' counts meet, and gets back the two counts of
each and the number of different words in each fragment: hot ones travel once per batch. The ids of target documents are broadcast
up to a checked number; beyond it they are joined.

Defined results: null and empty texts have no tokens and null losses; repeated rows count and score each; a null id stays null; null
labels and labels without document don't train; without a labelled document the target model is the smoothing alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIERS, WordHashes, mixed, parallelism, ship_package, stored, texts_of, word_array

UNKNOWN, BEGIN = b" ", b"\n"  #: no word has blanks


@dataclass(frozen=True)
class LmRules:
    vocabulary: int | None = None  #: most words; all of them where it is unset
    prior: float = 2.0  #: counts that the unigrams weigh beside a history's own
    batch_tokens: int = 1_000_000
    batch_texts: int = 50_000
    broadcast_ids: int = 2_000_000  #: most target ids (16 MB) that are broadcast


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def vocabulary(docs: DataFrame, most: int, text_col: str = "text") -> list[bytes]:
    """The vocabulary, most frequent first. Only it and a histogram of counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in texts_of(batch.column(0)):
                seen.update(words_of(text))
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    counts = stored(docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    histogram = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    room, least = most, None
    for r in histogram.toLocalIterator():
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    if least is None:
        return []
    return [r["word"] for r in sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))]


def _encoded(docs: DataFrame, words: list[bytes] | None, targets: np.ndarray | None, rules: LmRules, id_col: str, text_col: str) -> DataFrame:
    """Batches of documents: ids, lengths, the hashes of their words and tokens as places among these, packed, and which of them are
    targets: the sorted ids in `targets`, or those with _target."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    chosen = docs.sparkSession.sparkContext.broadcast(targets)
    schema = "batch long, ids binary, known binary, target binary, lengths binary, words binary, tokens binary, n long, n_target long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None if shared.value is None else frozenset(shared.value)
        hashes = WordHashes()
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            lengths, target = np.array([len(r[2]) for r in rows], np.int64), np.array([r[1] for r in rows], np.uint8)
            used, tokens, often = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # small places for frequent words compress well
            used, tokens = used[order], np.argsort(order)[tokens]
            blobs = (np.array([r[0] or 0 for r in rows], np.int64).tobytes(), np.array([r[0] is not None for r in rows], np.uint8).tobytes(), target.tobytes(), lengths.tobytes(), used.tobytes(), planes(tokens.astype(np.uint32)))
            sums = (int(lengths.sum()), int(lengths[target > 0].sum()))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), *(pa.array([n], pa.int64()) for n in sums)], names=["batch", "ids", "known", "target", "lengths", "words", "tokens", "n", "n_target"])

        wanted = chosen.value
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            if wanted is None:
                marks = batch.column(2).to_pylist()
            else:
                marks = np.isin(np.array([-1 if d is None else d for d in docs_], np.int64), wanted) & np.array([d is not None for d in docs_], bool)
            for doc, text, target in zip(docs_, texts_of(batch.column(1)), marks, strict=True):
                found = words_of(text)
                if kept is not None:
                    found = [w if w in kept else UNKNOWN for w in found]
                tokens = word_array(found, hashes)
                rows.append((doc, bool(target), tokens))
                size += len(tokens)
                if size >= rules.batch_tokens or len(rows) >= rules.batch_texts:
                    yield packed()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield packed()

    return docs.select(id_col, text_col, *(["_target"] if targets is None else [])).mapInArrow(work, schema)


def planes(x: np.ndarray) -> bytes:
    """x compressed, the first bytes of all numbers before all second ones: small numbers take little."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unplaned(blob: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8)
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(wide, len(flat) // wide).T).reshape(-1).view(kind)


@dataclass
class Asked:
    """What a batch asks for: its distinct bigrams and its words, BEGIN as the first of them."""

    lengths: np.ndarray
    tokens: np.ndarray  #: places among the words
    before: np.ndarray  #: of each distinct bigram, the place of its history
    after: np.ndarray  #: and of its word
    where: np.ndarray  #: the bigram of every token
    pairs: np.ndarray  #: hashes of the bigrams
    words: np.ndarray  #: and of the words

    @classmethod
    def of(cls, row: dict) -> Asked:
        lengths, tokens = np.frombuffer(row["lengths"], np.int64), unplaned(row["tokens"], np.uint32).astype(np.int64) + 1
        words = np.concatenate([word_array([BEGIN], WordHashes()), np.frombuffer(row["words"], np.uint64)])
        histories = np.zeros(len(tokens), np.int64)
        histories[1:] = tokens[:-1]
        histories[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
        both, where = np.unique(histories << 32 | tokens, return_inverse=True)
        before, after = both >> 32, both & 0xFFFFFFFF
        return cls(lengths, tokens, before, after, where, mixed(words[before] * np.uint64(MULTIPLIERS[0]) + words[after] * np.uint64(MULTIPLIERS[1])), mixed(words))

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """How often each bigram, word as such and word as history occurs among the chosen tokens."""
        where, n = self.where[chosen], len(self.words)
        found = (np.bincount(where, minlength=len(self.pairs)), np.bincount(self.tokens[chosen], minlength=n), np.bincount(self.before[where], minlength=n))
        return tuple(x.astype(np.int32) for x in found)

    def own(self, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every token, how often its document has its bigram, its word, and its history as one."""
        counts = []
        for of in (self.where, self.tokens, self.before[self.where]):
            _, at, n = np.unique(owner << 32 | of, return_inverse=True, return_counts=True)
            counts.append(n[at])
        return tuple(counts)

    def losses(self, joint: np.ndarray, words: np.ndarray, histories: np.ndarray, total: np.ndarray, size: int, prior: float, own: tuple[np.ndarray, ...]) -> np.ndarray:
        """-log p(w | h) of every token in one model, from the model's counts of what was asked for, less the document's own; total
        is the number of the other documents' tokens, for every token."""
        joint, words, histories = joint[self.where] - own[0], words[self.tokens] - own[1], histories[self.before[self.where]] - own[2]
        return -np.log((joint + prior * (words + 1) / (total + size)) / (histories + prior))


def dealt(hashes: np.ndarray, fragments: int) -> list[np.ndarray]:
    """The places of the hashes of each fragment, by hash; fragments are ranges of hashes."""
    order = np.argsort(hashes, kind="stable")
    fragment = (hashes[order] >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
    return np.split(order, np.searchsorted(fragment, np.arange(1, fragments, dtype=np.uint64)))


def gaps(ascending: np.ndarray) -> bytes:
    """Ascending hashes by their differences, which are smaller."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def ungapped(blob: bytes) -> np.ndarray:
    return np.cumsum(unplaned(blob, np.uint64), dtype=np.uint64)


def score(docs: DataFrame, labels: DataFrame, rules: LmRules = LmRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, target_loss, background_loss, score."""
    spark = docs.sparkSession
    ship_package(spark)
    good = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max("quality") > 0).alias("_target")).where("_target")
    words = None if rules.vocabulary is None else vocabulary(docs, rules.vocabulary, text_col)
    few = good.count() <= rules.broadcast_ids
    targets = np.sort(good.select(id_col).toPandas()[id_col].to_numpy(np.int64)) if few else None
    read = docs.select(id_col, text_col)
    encoded = stored(_encoded(read if few else read.join(good, id_col, "left"), words, targets, rules, id_col, text_col), "encoded")
    sums = encoded.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_target", "n")]).first()
    totals = (sums["n_target"], sums["n"])
    fragments = max(parallelism(spark), totals[1] // 2_000_000)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = Asked.of(row)
                chosen = np.repeat(np.frombuffer(row["target"], np.uint8), asked.lengths) > 0
                target, background = asked.counts(chosen), asked.counts(np.ones(len(asked.tokens), bool))
                blobs = []
                for p, w in zip(dealt(asked.pairs, fragments), dealt(asked.words, fragments), strict=True):
                    both = (np.concatenate([joint[p], single[w], history[w]]) for joint, single, history in (target, background))
                    blobs.append((gaps(asked.pairs[p]), gaps(asked.words[w]), *map(planes, both)))
                yield pa.RecordBatch.from_arrays([pa.array(range(fragments), pa.int64()), pa.array([row["batch"]] * fragments, pa.int64()), *(pa.array([b[k] for b in blobs], pa.binary()) for k in range(4))], names=["fragment", "batch", "pairs", "words", "target", "background"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        places = []
        for column in ("pairs", "words"):
            parts = [ungapped(x) for x in pdf[column]]
            unique, where = np.unique(np.concatenate(parts), return_inverse=True)
            places.append((len(unique), np.cumsum([len(p) for p in parts]), where))
        (pairs, pair_edges, pair_where), (words, word_edges, word_where) = places
        both = []
        for column in ("target", "background"):
            counts = [unplaned(x, np.int32) for x in pdf[column]]
            sent = [np.split(c, [p, p + w]) for c, p, w in zip(counts, np.diff(pair_edges, prepend=0), np.diff(word_edges, prepend=0), strict=True)]
            back = []
            for k, (n, edges, where) in enumerate(((pairs, pair_edges, pair_where), (words, word_edges, word_where), (words, word_edges, word_where))):
                total = np.bincount(where, np.concatenate([s[k] for s in sent]), n).astype(np.int64)
                back.append(np.split(total[where], edges[:-1]))
            both.append([planes(np.concatenate(x)) for x in zip(*back, strict=True)])
        return pd.DataFrame({"batch": pdf["batch"], "fragment": pdf["fragment"], "distinct": words, "target": both[0], "background": both[1]})

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = Asked.of(row)
                lengths = asked.lengths
                pairs, words_ = dealt(asked.pairs, fragments), dealt(asked.words, fragments)
                answers = sorted(row["answers"], key=lambda a: a["fragment"])
                size = sum(a["distinct"] for a in answers) + 1 if words is None else len(words) + 2  # with BEGIN, which is among the distinct ones
                owner = np.repeat(np.arange(len(lengths)), lengths)
                empty, mean, own = lengths == 0, [], asked.own(owner)
                among = np.repeat(np.frombuffer(row["target"], np.uint8), lengths) > 0
                for name, total, left_out in zip(("target", "background"), totals, (among, np.ones(len(among), bool)), strict=True):
                    joint, single, history = np.empty(len(asked.pairs)), np.empty(len(asked.words)), np.empty(len(asked.words))
                    for a, p, w in zip(answers, pairs, words_, strict=True):
                        joint[p], single[w], history[w] = np.split(unplaned(a[name], np.int64), [len(p), len(p) + len(w)])
                    mean.append(np.bincount(owner, asked.losses(joint, single, history, total - lengths[owner] * left_out, size, rules.prior, tuple(n * left_out for n in own)), len(lengths)) / np.maximum(lengths, 1))
                ids = pa.array(np.frombuffer(row["ids"], np.int64), pa.int64(), mask=np.frombuffer(row["known"], np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), *(pa.array(x, pa.float64(), mask=empty) for x in (mean[0], mean[1], mean[0] - mean[1]))], names=[id_col, "n_tokens", "target_loss", "background_loss", "score"])

    asked = encoded.select("batch", "target", "lengths", "words", "tokens").mapInArrow(ask, "fragment long, batch long, pairs binary, words binary, target binary, background binary")
    answers = asked.groupBy("fragment").applyInPandas(answer, "batch long, fragment long, distinct long, target binary, background binary")
    gathered = answers.groupBy("batch").agg(F.collect_list(F.struct("fragment", "distinct", "target", "background")).alias("answers"))  # bounded by a batch's tokens
    rated = encoded.select("batch", "ids", "known", "target", "lengths", "words", "tokens").join(gathered, "batch", "left")
    return rated.mapInArrow(rate, f"`{id_col}` long, n_tokens long, target_loss double, background_loss double, score double")
