"""Packing documents into batches of bounded padded size with optimal length buckets.

The histogram of token counts over all documents goes through a dynamic program that
chooses the bucket bounds with the least padding: every document is padded to the bound
of its bucket.  Inside a bucket, batches are filled up to a budget of padded tokens.

Bounds are chosen on a grid: counts keep their leading ``_PRECISION`` bits and are
rounded up, so the histogram that the driver sees has at most 512 cells per doubling of
the length, and counts below 1,024 are exact.

Edge cases: null text counts as empty and has only the end token; a document longer than
the budget is a batch of its own; repeated rows are packed one by one, a null doc_id
is packed as well; an empty table gives an empty result.
"""

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import per_batch, stage, text_hash

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary of TOKENIZER cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 16
BUDGET = 65_536
# Documents per task while batches are numbered.
CELL = 100_000
_PRECISION = 10
_MEMO = 400_000


class _Lengths(dict):
    """Number of tokens of a word; words are encoded once and remembered."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        length = self[word] = len(self.encoding.encode_ordinary(word))
        return length


def _length_batch(vocabulary):
    words = regex.compile(PATTERN)

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value  # a worker keeps it from task to task, and what is built with it
        if "lengths" not in held:
            held["lengths"] = _Lengths(held["file"])
        lengths = held["lengths"]
        counts = [sum(map(lengths.__getitem__, words.findall(text.as_py() or ""))) + 1 for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(counts, pa.int64())], ["doc_id", "h", "n_tokens"])

    return per_batch(build)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, text hash ``h`` and ``n_tokens``, an end token included, of every row.

    ``tokenizer`` is a file of tokens and ranks, read once by the driver.  Words
    are encoded once and remembered, which changes no count: no token crosses words.
    """
    with open(tokenizer, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast({"file": file.read()})
    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("doc_id"), F.col("text")).alias("h"), "text")
    return rows.mapInArrow(_length_batch(vocabulary), "doc_id long, h long, n_tokens long")


def grid(length: Column) -> Column:
    """``length`` rounded up to its leading bits."""
    bits = F.length(F.bin(length))
    step = F.greatest(bits - _PRECISION, F.lit(0))
    return F.expr("0L") + F.call_function("shiftleft", F.call_function(
        "shiftright", length + F.call_function("shiftleft", F.lit(1).cast("long"), step) - 1, step), step)


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in all.

    ``lengths`` ascend.  Padding of cells i..j in one bucket is lengths[j] times their
    documents, less a constant; that cost has the quadrangle property, so the best split
    moves to the right with j and each layer is solved by halving: O(buckets n log n).
    """
    n = lengths.size
    if n == 0:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    width = lengths.astype(np.float64)
    cost = width * total[1:]  # all cells up to j in one bucket
    splits = []
    for _ in range(min(buckets, n) - 1):
        better, split = np.empty(n), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            middle = (low + high) // 2
            # the last bucket starts after cell k, k = -1 standing for no split
            k = np.arange(first, min(last, middle) + 1)
            tried = np.where(k > 0, cost[k - 1], 0.0) + width[middle] * (total[middle + 1] - total[k])
            at = int(np.argmin(tried))
            better[middle], split[middle] = tried[at], k[at]
            if low < middle:
                todo.append((low, middle - 1, first, int(k[at])))
            if middle < high:
                todo.append((middle + 1, high, int(k[at]), last))
        cost = better
        splits.append(split)
    bounds, j = [int(lengths[-1])], n - 1
    for split in reversed(splits):
        j = int(split[j]) - 1
        if j < 0:
            break
        bounds.append(int(lengths[j]))
    return bounds[::-1]


def pack(
    docs: DataFrame, tokenizer: str = TOKENIZER, buckets: int = BUCKETS, budget: int = BUDGET
) -> DataFrame:
    """``doc_id, n_tokens, bucket_len, batch_id, slot, batch_rows`` of every row.

    ``batch_id`` is unique over the corpus, ``slot`` counts from 0 inside the batch.  Rows
    of a bucket are numbered in the order of a hash, in cells of about ``CELL`` rows whose
    sizes are added up, so a bucket with most of the rows is dealt to many tasks.
    """
    spark = docs.sparkSession
    counted = stage(token_counts(docs, tokenizer), "lengths")
    seen = counted.groupBy(grid(F.col("n_tokens")).alias("length")).agg(F.count("*").alias("n")).collect()
    cells = sorted((row["length"], row["n"]) for row in seen)
    lengths = np.array([length for length, _ in cells], np.int64)
    counts = np.array([n for _, n in cells], np.int64)
    bounds = bucket_bounds(lengths, counts, buckets)
    sizes = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds)) if bounds else []
    table = spark.createDataFrame(
        [(int(b), max(1, budget // int(b)), max(1, -(-int(n) // CELL))) for b, n in zip(bounds, sizes)],
        "bucket_len long, rows int, cells int")
    bound = F.coalesce(*[F.when(grid(F.col("n_tokens")) <= b, F.lit(b).cast("long")) for b in bounds], F.lit(0).cast("long"))
    mixed = F.xxhash64("doc_id", "h", F.lit(7))
    dealt = (
        counted.withColumn("bucket_len", bound).join(F.broadcast(table), "bucket_len")
        .withColumn("mixed", mixed).withColumn("cell", F.pmod(F.shiftright("mixed", 20), F.col("cells")).cast("int"))
    )
    before = Window.partitionBy("bucket_len").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket_len", "cell").agg(F.count("*").alias("n"), F.first("rows").alias("rows"))
    offsets = offsets.select(
        "bucket_len", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("bucket_len")).alias("bucket_rows"))
    # the first batch number of a bucket: batches of the shorter buckets come before
    starts, first = {}, 0
    for b, n in zip(bounds, sizes):
        starts[int(b)] = first
        first += -(-int(n) // max(1, budget // int(b)))
    start = F.coalesce(*[F.when(F.col("bucket_len") == b, F.lit(s)) for b, s in starts.items()], F.lit(0)).cast("long")
    inside = Window.partitionBy("bucket_len", "cell").orderBy("mixed", "doc_id", "n_tokens")
    numbered = (
        dealt.withColumn("nth", F.row_number().over(inside))
        .join(stage(offsets, "offsets"), ["bucket_len", "cell"])
        .withColumn("place", F.col("offset") + F.col("nth") - 1)
        .withColumn("batch", F.floor(F.col("place") / F.col("rows")))
    )
    return numbered.select(
        "doc_id", "n_tokens", "bucket_len", (start + F.col("batch")).alias("batch_id"),
        (F.col("place") % F.col("rows")).cast("long").alias("slot"),
        F.least(F.col("rows").cast("long"), F.col("bucket_rows") - F.col("batch") * F.col("rows")).alias("batch_rows"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
