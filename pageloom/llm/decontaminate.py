"""Benchmark decontamination with a distributed positional inverted index.

Items and documents are sequences of words.  A window is ``WIDTH`` consecutive words of
an item (a shorter item is one window).  The steps:

1. Corpus frequencies of all terms that items contain.
2. Every window is looked up by its rarest term.  The postings ``(term, document,
   position)`` of these terms are stored for the whole corpus, each with the words
   around its position, which stand for the postings of the other terms nearby.
3. Lists are intersected from the rarest term on, positions adjusted by the term's
   offset in the window: a posting proposes a start, the second rarest term must stand
   at its place, and then all neighbours must spell the window.

Terms are filtered by a bitmap of fixed size before they leave a task, so what is
broadcast does not grow with the benchmark; joins on the term itself follow, so a
false hit in the bitmap only costs a row.  A frequent term that is the rarest of its
window has many postings; the join on it is split by the skew handling of Spark.

Edge cases: null and empty texts have no words, and an item without words no window;
a null item_id counts as the empty id; items that repeat an id are one item; rows that
repeat a doc_id are separate documents, and rows equal in text too get equal results;
empty tables give no hits, or no rows.
"""

import itertools
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import binary_column, per_batch, stage, text_hash

WIDTH = 10
# Terms that are compared one by one, from the rarest on, before the whole window.
RAREST = 2
# Bits of the term bitmap: 2 MB, whatever the benchmark.
_BITS = 1 << 24
_MEMO = 1 << 20
# A-Z become small; words are 0-9, a-z and all characters beyond ASCII.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


def _slot(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) % _BITS


class _Bitmap(dict):
    """Whether a term may be among the wanted ones; remembers what it looked up."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= _MEMO:
            self.clear()
        slot = _slot(term)
        found = self[term] = bool(self.bits[slot >> 3] >> (slot & 7) & 1)
        return found


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Bitmap of the strings in column ``term``: built in the tasks, merged by Spark.

    At most _BITS / 64 rows of one word each reach the driver.
    """
    words = (
        terms.select("term").mapInArrow(per_batch(_slots), "term_slot long")
        .groupBy(F.floor(F.col("term_slot") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(term_slot, 64) as int))")).alias("bits"))
    ).toArrow()
    bits = np.zeros(_BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits.view(np.uint8)


def _slots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    slots = [_slot(term.as_py()) for term in binary_column(batch, "term")]
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["term_slot"])


def _window_batch(width: int):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items, windows = [], []
        for item, text in zip(batch.column("item").to_pylist(), binary_column(batch, "text")):
            words = [word.decode() for word in split_words(text.as_py() or b"")]
            for start in range(max(1, len(words) - width + 1) if words else 0):
                items.append(item)
                windows.append(words[start:start + width])
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array(windows, pa.list_(pa.string()))], ["item", "words"])

    return per_batch(build)


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``words`` (array) and ``items`` (array of item ids) of every different window."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(item, "text").mapInArrow(_window_batch(width), "item string, words array<string>")
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def _count_batch(bitmap):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wanted, counts = _Bitmap(bitmap.value), Counter()
        for text in binary_column(batch, "text"):
            counts.update(split_words(text.as_py() or b""))
        found = [(term, n) for term, n in counts.items() if wanted[term]]
        yield pa.RecordBatch.from_arrays(
            [_strings([term for term, _ in found]), pa.array([n for _, n in found], pa.int64())], ["term", "n"])

    return per_batch(build)


def _strings(terms: list[bytes]) -> pa.Array:
    """Words cut from UTF-8 texts are UTF-8 themselves."""
    return pa.array(terms, pa.binary()).cast(pa.string())


def _posting_batch(bitmap, width: int):
    """Per document a row with ``n_words`` and no term, and a row per posting."""

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wanted = _Bitmap(bitmap.value)
        row, term, at, around, before, n_words = [], [], [], [], [], []
        for number, text in enumerate(binary_column(batch, "text")):
            words = split_words(text.as_py() or b"")
            places = np.flatnonzero(np.fromiter(map(wanted.__getitem__, words), bool, len(words))).tolist()
            row += itertools.repeat(number, len(places) + 1)
            term += [None, *(words[p] for p in places)]
            at += [0, *places]
            around += [None, *(b" ".join(words[max(0, p - width + 1):p + width]) for p in places)]
            before += [0, *(min(p, width - 1) for p in places)]
            n_words += itertools.repeat(len(words), len(places) + 1)
        index = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(index), batch.column("h").take(index), _strings(term), pa.array(at, pa.int64()),
             _strings(around), pa.array(before, pa.int32()), pa.array(n_words, pa.int64())],
            ["doc_id", "h", "term", "at", "around", "before", "n_words"],
        )

    return per_batch(build)


def index(docs: DataFrame, terms: DataFrame, width: int = WIDTH) -> DataFrame:
    """The stored positional index of ``docs`` for the strings in ``terms.term``.

    A row per posting: ``doc_id``, ``h`` (text hash), ``term``, ``at`` (position), ``around``
    (the words within ``width - 1`` of it), ``before`` (how many of them precede it); and a
    row per document without a term, for ``n_words``.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(terms))
    rows = _keyed(docs).mapInArrow(
        _posting_batch(bitmap, width),
        "doc_id long, h long, term string, at long, around string, before int, n_words long")
    return stage(rows, "postings")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_hash(F.col("doc_id"), F.col("text")).alias("h"), "text")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term`` and its number of occurrences ``n`` in all of ``docs``, for ``terms.term``."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))
    counted = docs.select("text").mapInArrow(_count_batch(bitmap), "term string, n long")
    return terms.join(counted.groupBy("term").agg(F.sum("n").alias("n")), "term", "left").select(
        "term", F.coalesce("n", F.lit(0)).alias("n"))


def ranked_windows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Windows whose terms all occur, with their ``rarest`` terms: array of (n, term, offset)."""
    found = stage(windows(benchmark, width), "windows")
    terms = found.select(F.explode("words").alias("term")).distinct()
    counts = frequencies(docs, terms)
    ranked = (
        found.select("words", "items", F.posexplode("words").alias("offset", "term"))
        .join(counts, "term")
        .groupBy("words").agg(
            F.first("items").alias("items"),
            F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("order"))
        .filter("order[0].n > 0")
    )
    # one entry per term: a second place of the same term adds nothing to the first
    first_place = F.filter("order", lambda x, i: (i == 0) | (F.get(F.col("order"), i - 1)["term"] != x["term"]))
    return stage(ranked.select("words", "items", F.slice(first_place, 1, RAREST).alias("rarest")), "ranked")


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences of windows, and the words per document.

    The first has ``doc_id, h, start, length, items``; the second ``doc_id, h, n_words``
    for every row of ``docs``.
    """
    ranked = ranked_windows(docs, benchmark, width)
    wanted = ranked.select(F.col("rarest")[0]["term"].alias("term")).distinct()
    stored = index(docs, wanted, width)
    postings = stored.filter("term is not null")
    looked_up = ranked.select(
        "words", "items", F.col("rarest")[0]["term"].alias("term"), F.col("rarest")[0]["offset"].alias("offset"),
        F.get("rarest", F.lit(1)).alias("second"))
    proposed = postings.join(looked_up, "term").withColumn("start", F.col("at") - F.col("offset")).filter(
        # the second rarest term at its own offset, then all words
        "start >= 0 and (second is null or get(split(around, ' '), before - offset + second.offset) = second.term)")
    spelled = F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.size("words"))
    exact = proposed.filter(spelled == F.col("words")).select(
        "doc_id", "h", "start", F.size("words").alias("length"), "items")
    return exact, stored.filter("term is null").select("doc_id", "h", "n_words")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = 0.8) -> DataFrame:
    """Places where a window is nearly there: ``doc_id, h, start, items, found``.

    At a posting of a window's rarest term, at least ``share`` of the window's different
    words stand within ``width - 1`` words, in any order; ``found`` is that share.
    """
    ranked = ranked_windows(docs, benchmark, width)
    first = F.col("rarest")[0]
    stored = index(docs, ranked.select(first["term"].alias("term")).distinct(), width)
    near = stored.filter("term is not null").join(
        ranked.select("words", "items", first["term"].alias("term"), first["offset"].alias("offset")), "term")
    there = F.size(F.array_intersect(F.split("around", " "), F.col("words"))) / F.size(F.array_distinct("words"))
    return near.withColumn("found", there).filter(F.col("found") >= share).select(
        "doc_id", "h", (F.col("at") - F.col("offset")).alias("start"), "items", "found")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: ``doc_id, h, n_words, n_hit, items`` (sorted item ids)."""
    exact, sizes = occurrences(docs, benchmark, width)
    placed = (
        exact.select("doc_id", "h", "start", (F.col("start") + F.col("length")).alias("end"), "items")
        .groupBy("doc_id", "h", "start").agg(F.max("end").alias("end"), F.flatten(F.collect_list("items")).alias("items"))
    )
    ordered = Window.partitionBy("doc_id", "h").orderBy("start")
    reach = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = (
        placed.withColumn("fresh", F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0)))
        .groupBy("doc_id", "h").agg(
            F.sum("fresh").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("items"))))).alias("items"))
    )
    hits = stage(hits, "hits")
    return sizes.join(hits, _same(sizes, hits), "left").select(
        sizes.doc_id, sizes.h, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left.doc_id.eqNullSafe(right.doc_id) & (left.h == right.h)


def clean_rows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that contain no window of an item."""
    exact, _ = occurrences(docs, benchmark, width)
    hit = stage(exact.select("doc_id", "h").distinct(), "hit")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       text_hash(F.col("doc_id"), F.col("text")).alias("h"))
    return rows.join(hit, _same(rows, hit), "left_anti").select("row.*")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
