"""Importance resampling of documents towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to ``max_run`` consecutive words, repeats counted; the
bucket of a feature is the CRC-32 of its words, joined by one space, modulo ``buckets``.
The gain of a bucket is the logarithm of how much more often the target texts hit it than
the documents, a document's weight the mean gain of its features.  Weights plus Gumbel noise,
drawn from a hash of the doc_id, rank the documents; the best ones are drawn, which samples
without replacement in proportion to the weights.

Head-tail vocabulary: one pass over all documents finds the words, and for longer runs the
word pairs, that are frequent in some task; the most frequent ones are broadcast, words with
their CRC state and pairs with their bucket.  A state goes on over the next word of a run.
Features outside the head take the CRC of their bytes directly.  Both ways give the same
bucket, so totals are exact over all texts and the head decides about speed alone.  It has at
most ``HEAD`` entries of at most ``WORD_BYTES`` bytes a word, so its size has a bound (a few MB).

Only bucket totals (``buckets`` numbers a task, added up by Spark) and a histogram of scores
(whole numbers between -60,000 and 80,000) reach the driver.

Edge cases: a null text has no words, weight 0 and is never drawn as it has fewer than
``min_words`` words (unless that is 0); a null doc_id draws its noise from the seed alone and
comes last among equal scores; rows that share a doc_id are ranked one by one; empty targets
leave the gains of the documents alone; an empty table gives an empty result.
"""

import math
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.ordinals import numbered
from pageloom.llm.shared import binary_column, stage

MAX_RUN = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
HEAD = 1 << 15
WORD_BYTES = 64
# A task emits what makes up one of HEAD * _SHARE parts of its features, so at most that many rows.
_SHARE = 8
# Distinct features that a task counts before it emits the frequent ones and starts anew.
_COUNTED = 1 << 18
# Lower-cases A-Z; every other ASCII character but letters and digits becomes a space.
_FOLD = bytes(
    ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else c if c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of A-Z (lower-cased), a-z, 0-9 and characters above ASCII."""
    return text.translate(_FOLD).split()


class _Head(dict):
    """Values of frequent features; others are computed by ``direct`` and not kept."""

    def __init__(self, known: dict, direct):
        super().__init__(known)
        self.direct = direct

    def __missing__(self, feature):
        return self.direct(feature)


def head_of(words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> dict:
    """What is broadcast: CRC states of words, buckets of pairs."""
    return {
        "states": {word: zlib.crc32(word) for word in words},
        "pairs": {(a, b): zlib.crc32(b" " + b, zlib.crc32(a)) % buckets for a, b in pairs},
        "buckets": buckets,
    }


def buckets_of(words: list[bytes], states: _Head, pairs: _Head, max_run: int, buckets: int) -> np.ndarray:
    """Bucket of every feature of a text."""
    crc = np.fromiter(map(states.__getitem__, words), np.int64, len(words))
    found = [crc % buckets]
    if max_run >= 2:
        found.append(np.fromiter(map(pairs.__getitem__, zip(words, words[1:])), np.int64, max(0, len(words) - 1)))
    for run in range(3, max_run + 1):
        # the state of a run goes on from the state of its first word
        found.append(np.fromiter(
            (zlib.crc32(b" " + b" ".join(words[at + 1:at + run]), int(crc[at])) % buckets
             for at in range(len(words) - run + 1)), np.int64, max(0, len(words) - run + 1)))
    return np.concatenate(found)


def _lookups(head: Broadcast) -> tuple[_Head, _Head, int]:
    held = head.value  # a worker keeps it, with what is built from it
    if "lookups" not in held:
        buckets = held["buckets"]
        states = _Head(held["states"], zlib.crc32)
        pairs = _Head(held["pairs"], lambda pair: zlib.crc32(b" " + pair[1], states[pair[0]]) % buckets)
        held["lookups"] = states, pairs, buckets
    return held["lookups"]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        for text in binary_column(batch, "text"):
            yield words_of(text.as_py() or b"")


def _frequent(size: int, max_run: int):
    """Counts of the features that are frequent in a task."""

    def emit(counts: Counter) -> pa.RecordBatch:
        least = max(2, -(-sum(counts.values()) // (size * _SHARE)))
        rows = [(f, n) for f, n in counts.items() if n >= least and all(len(word) <= WORD_BYTES for word in f)]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f, _ in rows], pa.binary()), pa.array([f[1] if len(f) > 1 else None for f, _ in rows], pa.binary()),
             pa.array([n for _, n in rows], pa.int64())], ["first", "second", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(min(max_run, 2))]
        for words in _texts(batches):
            counts[0].update(zip(words))
            if max_run >= 2:
                counts[1].update(zip(words, words[1:]))
            for i, seen in enumerate(counts):
                if len(seen) >= _COUNTED:
                    yield emit(seen)
                    counts[i] = Counter()
        yield from map(emit, filter(None, counts))

    return run


def head(docs: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, size: int = HEAD) -> Broadcast:
    """The broadcast head of the vocabulary of all documents."""
    counted = docs.select("text").mapInArrow(_frequent(size, max_run), "first binary, second binary, n long")
    total = counted.groupBy("first", "second").agg(F.sum("n").alias("n"))
    kept = stage(total, "head")

    def top(rows: DataFrame) -> list:
        return rows.orderBy(F.desc("n"), "first", "second").limit(size).collect()

    words = [bytes(row["first"]) for row in top(kept.filter("second IS NULL"))]
    pairs = [(bytes(row["first"]), bytes(row["second"])) for row in top(kept.filter("second IS NOT NULL"))] if max_run >= 2 else []
    return docs.sparkSession.sparkContext.broadcast(head_of(words, pairs, buckets))


def _totals(head: Broadcast, max_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, pairs, buckets = _lookups(head)
        total = np.zeros(buckets, np.int64)
        for words in _texts(batches):
            if words:
                total += np.bincount(buckets_of(words, states, pairs, max_run, buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return run


def bucket_totals(texts: DataFrame, head: Broadcast, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; exact."""
    found = texts.select("text").mapInArrow(_totals(head, max_run), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) of every bucket."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), corpus.size
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def _weights(head: Broadcast, gain: Broadcast, max_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, pairs, buckets = _lookups(head)
        table = gain.value
        for batch in batches:
            rows = []
            for words in _texts(iter([batch])):
                found = buckets_of(words, states, pairs, max_run, buckets) if words else ()
                rows.append((len(words), len(found), int(table[found].sum()) // len(found) if words else 0))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(column, pa.int64()) for column in columns]],
                ["doc_id", "n_words", "n_features", "weight"])

    return run


def weighted(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    context = docs.sparkSession.sparkContext
    common = head(docs, max_run, buckets)
    gain = context.broadcast(gains(
        bucket_totals(docs, common, max_run, buckets), bucket_totals(target, common, max_run, buckets)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _weights(common, gain, max_run), "doc_id long, n_words long, n_features long, weight long")


def noisy(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """``weights`` plus ``score``: weight and Gumbel noise in thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long"))


def _cut(scored: DataFrame, percent: int) -> tuple[int, int]:
    """(how many to draw, least score that can be drawn) from the histogram of scores."""
    counts = sorted(((row["score"], row["n"]) for row in scored.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    seen = 0
    for score, n in counts:
        seen += n
        if seen >= wanted:
            return wanted, score
    return 0, 0


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
    max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` of 100 (rounded down) with the
    highest scores get a rank from 1, ties to the smaller doc_id; other rows have none.
    """
    scored = stage(noisy(weighted(docs, target, max_run, buckets), seed), "scores")
    wanted, least = _cut(scored.filter(F.col("n_words") >= min_words), percent)
    columns = ["doc_id", "n_features", "weight", "score"]
    able = (F.col("n_words") >= min_words) & (F.col("score") >= least) & F.lit(wanted > 0)
    reach = scored.filter(able).select(
        *columns, (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("no_id"))
    ranked = numbered(reach, [], ["down", "no_id", "doc_id", "n_features"], "ranks")
    rank = F.when(F.col("position") < wanted, F.col("position") + 1)
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
