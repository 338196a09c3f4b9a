"""Repeated byte passages by a depth-limited radix sort of suffixes.

Wanted are all strings of ``LENGTH`` bytes that start at two places or more.  Suffixes
are ordered only through that depth, most significant part first, and a group that
has one member left leaves the sort:

1. The first digit of a suffix is the ``GRAM`` bytes at its anchor: of the GRAM-byte
   pieces inside its first LENGTH bytes, the one with the smallest hash.  Equal strings
   have equal anchors, so nothing is lost, and neighbouring suffixes share an anchor: a
   run of them is one row, about one row per 65 bytes.
2. The second digit is the whole span of bytes that a run's strings cover.  Runs with
   equal spans are repeated in all their strings.
3. Only where a group of equal first digits falls into different spans, the strings
   of one run per span are compared one by one, at full depth.

Equal groups at full depth are exactly the repeated strings.  Groups are made by
two independent 64-bit hashes, a rolling polynomial of the anchor and XXH3 of the span
or string.

Before each pass its digits are counted alone, which combines before the shuffle; a
bitmap of bounded size then keeps the rows of single digits inside their tasks.  Groups
of anchors are numbered by Spark window functions, which spill.  An anchor with more than
1/PARTS of the rows is dealt to several windows by salts; spans are then counted over the
salts, from one row per span and salt.  Full-depth strings are joined with their counts, hot
ones salted likewise.  Texts are read again for step 3 and for the removal; only
documents that a bitmap of fixed size names are shuffled, and the join after it is exact.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH keep all;
rows that repeat a doc_id or a whole text are separate documents, so their copies count
as repetitions, and rows equal in both get equal results; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import binary_column, per_batch, sha256_hex, stage, text_hash
from pageloom.operators.joins import PARTS, salted_join

LENGTH = 200
GRAM = 73
_BLOCK = 1 << 16
_STEPS = LENGTH - GRAM + 1  # pieces per string; a power of two for the sliding minimum
# Bits of the bitmap that names documents: at most _BITS / 64 rows are broadcast.
_BITS = 1 << 22
_PLACE = np.uint64((1 << 20) - 1)
# Bits of a bitmap of repeated hashes: 16 to 32 a hash, 32 MB at most.  Beyond that more
# single rows pass, which the exact grouping after it drops.
_BITS_PER_HASH = 16
_LEAST_MARKS, _MOST_MARKS = 1 << 16, 1 << 28


class _Rolling:
    """Hashes of all pieces of a block of bytes, by prefix sums modulo 2**64."""

    def __init__(self):
        rng = np.random.default_rng(_SEED)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(1 << 32, 1 << 63)) | 5
        size = 2 * _BLOCK + LENGTH
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
        inverse = pow(base, -1, 1 << 64)
        self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, inverse, np.uint64))])

    def grams(self, data: np.ndarray, length: int) -> np.ndarray:
        """Hash of the piece of ``length`` bytes at every place."""
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:data.size], out=sums[1:])
        hashes = sums[length:] - sums[:-length]
        hashes *= self.inverses[:hashes.size]
        hashes ^= hashes >> np.uint64(31)  # spread the strong upper bits over the word
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        return hashes


_SEED = 11


def runs(pieces: list[bytes], rolling: _Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with a common anchor; each piece has LENGTH bytes or more.

    Arrays: number of the piece, first string in it, last string, hash of the anchor.
    The pieces are hashed in one go; strings that would cross them are dropped.
    """
    sizes = np.array([len(piece) for piece in pieces])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    grams = rolling.grams(np.frombuffer(b"".join(pieces), np.uint8), GRAM)
    # the upper bits decide, then the place: the first smallest gram of each string
    lowest = (grams & ~_PLACE) | np.arange(grams.size, dtype=np.uint64)
    step = 1
    while step < _STEPS:
        lowest = np.minimum(lowest[:-step], lowest[step:])
        step *= 2
    strings = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), strings)
    within = np.arange(owner.size) - np.repeat(np.cumsum(strings) - strings, strings)
    anchor = (lowest[within + offsets[owner]] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:] - 1, anchor.size - 1]
    return owner[first], within[first], within[last], grams[anchor[first]]


def _pieces(texts: Iterator[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in lists of about _BLOCK bytes; long texts overlap in pieces."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for offset in range(0, len(text) - LENGTH + 1, _BLOCK):
            piece = text[offset:offset + _BLOCK + LENGTH - 1]
            if held and size + len(piece) > _BLOCK + LENGTH:
                yield held
                held, size = [], 0
            held.append((row, offset, piece))
            size += len(piece)
    if held:
        yield held


def _marks(hashes: DataFrame, name: str) -> np.ndarray:
    """Bitmap of the hashes in column ``name``: at most _MOST_MARKS / 64 rows reach the driver."""
    wanted = _BITS_PER_HASH * max(hashes.count(), 1)
    bits = min(_MOST_MARKS, max(_LEAST_MARKS, 1 << (wanted - 1).bit_length()))
    words = (
        hashes.groupBy(F.shiftright(F.col(name).bitwiseAND(F.lit(bits - 1)), 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits"))
    ).toArrow()
    marks = np.zeros(bits // 64, np.uint64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bitmap."""
    place = hashes & np.uint64(marks.size * 64 - 1)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (text.as_py() or b"" for text in binary_column(batch, "text"))


def _gram_batch():
    """Anchors of all runs, with counts."""
    kept: list[_Rolling] = []

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(_Rolling())
        for held in _pieces(_texts(batch)):
            grams, n = np.unique(runs([piece for _, _, piece in held], kept[0])[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return per_batch(build)


def _run_batch(marks):
    """Runs whose anchor may be repeated, with the hash of their span."""
    kept: list[_Rolling] = []

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(_Rolling())
        for held in _pieces(_texts(batch)):
            owner, first, last, grams = runs([piece for _, _, piece in held], kept[0])
            maybe = _marked(marks.value, grams)
            if not maybe.any():
                continue
            owner, first, last, grams = owner[maybe], first[maybe], last[maybe], grams[maybe]
            row = np.array([row for row, _, _ in held])[owner]
            offset = np.array([offset for _, offset, _ in held])[owner]
            views = [memoryview(piece) for _, _, piece in held]
            spans = np.fromiter(
                (xxhash.xxh3_64_intdigest(views[k][a:b + LENGTH])
                 for k, a, b in zip(owner.tolist(), first.tolist(), last.tolist())), np.uint64, first.size)
            # equal runs in a row (a line or word again and again) are one row that counts them
            fresh = np.flatnonzero(np.r_[
                True, (grams[1:] != grams[:-1]) | (spans[1:] != spans[:-1]) | (owner[1:] != owner[:-1])
                | (first[1:] != last[:-1] + 1)])
            final = np.r_[fresh[1:] - 1, first.size - 1]
            index = pa.array(row[fresh])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("h").take(index), pa.array((first + offset)[fresh]),
                 pa.array((last - first)[fresh].astype(np.int32)), pa.array((last[final] - first[fresh]).astype(np.int32)),
                 pa.array((final - fresh + 1).astype(np.int32)),
                 pa.array(grams[fresh].view(np.int64)), pa.array(spans[fresh].view(np.int64))],
                ["doc_id", "h", "at", "more", "all_more", "times", "gram", "span"],
            )

    return per_batch(build)


def _strings(text: bytes, found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, anchor, ``shared`` and full-depth hash of the strings of the runs in ``found``."""
    data = memoryview(text)
    at, more, grams, shared = (column.to_numpy(zero_copy_only=False) for column in found.flatten())
    counts = more + 1
    place = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(data[p:p + LENGTH]) for p in place.tolist()), np.uint64, place.size)
    return place, np.repeat(grams, counts), np.repeat(shared, counts), hashes


def _string_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The strings of the runs in ``runs`` (a list per document), to be counted."""
    for row, text in enumerate(_texts(batch)):
        _, grams, shared, hashes = _strings(text, batch.column("runs")[row].values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams), pa.array(hashes.view(np.int64)), pa.array(shared)], ["gram", "string", "shared"])


def _place_batch(marks):
    """Places of the strings that may be repeated and do not stand in repeated spans."""

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, text in enumerate(_texts(batch)):
            place, grams, shared, hashes = _strings(text, batch.column("runs")[row].values)
            maybe = np.flatnonzero(_marked(marks.value, hashes) & ~shared.astype(bool))
            index = pa.array(np.full(maybe.size, row))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("h").take(index), pa.array(place[maybe]),
                 pa.array(grams[maybe]), pa.array(hashes[maybe].view(np.int64))],
                ["doc_id", "h", "at", "gram", "string"],
            )

    return per_batch(build)


def _named_by(rows: DataFrame) -> DataFrame:
    """Bitmap of the documents in ``rows``: at most _BITS / 64 rows of (word, bits)."""
    bit = _bit()
    return rows.select(F.floor(bit / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({_BIT_SQL}, 64) as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))


_BIT_SQL = f"pmod(xxhash64(doc_id, h), {_BITS})"


def _bit() -> Column:
    return F.expr(_BIT_SQL)


def _split(docs: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``docs`` with ``named``: false only if the document is certainly not in the bitmap."""
    marked = docs.withColumn("word", F.floor(_bit() / 64))
    return (
        marked.join(F.broadcast(bitmap), "word", "left")
        .withColumn("named", F.coalesce(F.expr(f"(shiftright(bits, cast(pmod({_BIT_SQL}, 64) as int)) & 1) = 1"), F.lit(False)))
        .drop("word", "bits")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_hash(F.col("doc_id"), F.col("text")).alias("h"), "text")


def _on_document(left: DataFrame, right: DataFrame) -> Column:
    return left.doc_id.eqNullSafe(right.doc_id) & (left.h == right.h)


def _grouped_runs(rows: DataFrame, parts: int) -> DataFrame:
    """Runs whose anchor stands at two places or more.

    ``n_gram`` is exact.  ``nth`` and ``n_span`` number and count the runs of a span; where
    ``hot`` is true they do so among the runs with the same ``salt`` only.
    """
    grams = stage(
        rows.mapInArrow(_gram_batch(), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1"),
        "grams")
    part = max((grams.agg(F.sum("n")).first()[0] or 0) / parts, 1.0)
    hot = F.broadcast(grams.filter(F.col("n") > part).select(
        "gram", F.col("n").alias("n_hot"), F.ceil(F.col("n") / F.lit(part)).cast("int").alias("salts")))
    marks = rows.sparkSession.sparkContext.broadcast(_marks(grams, "gram"))
    found = rows.mapInArrow(
        _run_batch(marks), "doc_id long, h long, at long, more int, all_more int, times int, gram long, span long"
    ).join(hot, "gram", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "h", "at"), "salts")).cast("int"))
    by_gram = Window.partitionBy("gram", "salt")
    by_span = Window.partitionBy("gram", "salt", "span")
    return stage(
        found.withColumn("n_gram", F.coalesce("n_hot", F.sum("times").over(by_gram))).filter("n_gram > 1")
        .withColumn("nth", F.row_number().over(by_span.orderBy("doc_id", "h", "at")))
        .withColumn("n_span", F.sum("times").over(by_span))
        .withColumn("hot", F.col("n_hot").isNotNull()).drop("n_hot", "salts"),
        "runs",
    )


def repeated_intervals(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """Per document (``doc_id``, text hash ``h``) the byte intervals that are repeated.

    ``intervals`` is an array of (start, end); they may overlap.  ``parts`` decides from which
    share on an anchor or string is salted; results do not depend on it.
    """
    rows = _keyed(docs)
    grouped = _grouped_runs(rows, parts)
    # a hot span has one row per salt here, however many runs it has
    spans = stage(
        grouped.filter("hot and nth = 1").groupBy("gram", "span").agg(
            F.max("n_gram").alias("n_gram"), F.sum("n_span").alias("n_span"),
            F.min(F.struct("doc_id", "h", "at", "more")).alias("run")),
        "hot-spans",
    )
    # alone with its salt, a run may still meet its like under another; that is one run a salt
    met = grouped.filter("hot and n_span = 1").join(spans.filter("n_span > 1"), ["gram", "span"], "left_semi")
    whole = grouped.filter("n_span > 1").select(*met.columns).union(met).select(
        "doc_id", "h", F.col("at").alias("start"), (F.col("at") + F.col("all_more") + LENGTH).alias("end"))
    # one run per span stands for all of them; `shared` says that there are more
    shared = (F.col("n_span") > 1).alias("shared")
    mixed = stage(
        grouped.filter("not hot and n_gram > n_span and nth = 1").select("doc_id", "h", "at", "more", "gram", shared)
        .union(spans.filter("n_gram > n_span").select("run.*", "gram", shared))
        .groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "more", "gram", "shared")).alias("runs")),
        "mixed",
    )
    texts = _split(rows, _named_by(mixed)).filter("named").dropDuplicates(["doc_id", "h"])
    texts = texts.join(mixed, _on_document(texts, mixed)).select(texts.doc_id, texts.h, "text", "runs")
    strings = stage(
        texts.select("text", "runs").mapInArrow(per_batch(_string_batch), "gram long, string long, shared boolean")
        .groupBy("gram", "string").agg(F.count("*").alias("n"), F.min("shared").alias("all_shared"))
        .filter("n > 1 and not all_shared").select("gram", "string", "n"),
        "strings",
    )
    marks = rows.sparkSession.sparkContext.broadcast(_marks(strings, "string"))
    places = texts.mapInArrow(_place_batch(marks), "doc_id long, h long, at long, gram long, string long")
    single = salted_join(places, strings, ["gram", "string"], ["doc_id", "h", "at"], heat="n", parts=parts).select(
        "doc_id", "h", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    return whole.union(single).groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("start", "end")).alias("intervals"))


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, ascending intervals; those that touch are joined."""
    if not starts.size:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[first], reach[np.r_[first[1:] - 1, starts.size - 1]]


def _remove_batch(with_text: bool):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, removed, spans, digests, texts = [], [], [], [], []
        lists = batch.column("intervals")
        for row, text in enumerate(binary_column(batch, "text")):
            data = text.as_py() or b""
            left = data
            starts = ends = np.zeros(0, np.int64)
            if lists[row].is_valid:
                at, to = lists[row].values.flatten()
                starts, ends = union(at.to_numpy(), to.to_numpy())
                edges = zip([0, *ends.tolist()], [*starts.tolist(), len(data)])
                left = b"".join(data[a:b] for a, b in edges)
            sizes.append(len(data))
            removed.append(int((ends - starts).sum()))
            spans.append(starts.size)
            digests.append(sha256_hex(left))
            if with_text:
                texts.append(left.decode("utf-8", "ignore"))
        arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                  pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(arrays, names)

    return per_batch(build)


def remove_repeats(docs: DataFrame, with_text: bool = False, parts: int = PARTS) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    With ``with_text`` also ``kept_text``, without what is left of cut characters.
    """
    intervals = stage(repeated_intervals(docs, parts), "intervals")
    rows = _split(_keyed(docs), _named_by(intervals))
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    shape += ", kept_text string" if with_text else ""
    kind = intervals.schema["intervals"].dataType
    untouched = rows.filter("not named").select("doc_id", "h", "text", F.lit(None).cast(kind).alias("intervals"))
    touched = rows.filter("named")
    touched = touched.join(intervals, _on_document(touched, intervals), "left").select(
        touched.doc_id, touched.h, "text", "intervals")
    # two Python steps, so the rows without repetitions never enter the shuffle
    return untouched.mapInArrow(_remove_batch(with_text), shape).union(
        touched.mapInArrow(_remove_batch(with_text), shape))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
