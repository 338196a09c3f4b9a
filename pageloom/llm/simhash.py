"""SimHash near-duplicates by exact tiled comparison of fingerprints.

A document's fingerprint has 64 bits; two documents are linked when theirs differ
in at most ``RADIUS`` bits.  Distinct fingerprints are compared tile against tile
with numpy exclusive-or and bit counts.  Tiles hold fingerprints of equal
population counts, so tile pairs whose counts differ beyond the radius are skipped:

* between tasks, a tile is the pair of population counts of the two 32-bit halves
  (``sum |difference| <= radius`` is necessary for a link);
* inside a task, tiles that are still large are cut again by the counts of four,
  eight and sixteen segments, and the same test is applied there.

No pair within the radius is ever lost: the skipping rule is exact.  A task emits
a spanning forest of its links, never all pairs of a group.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; rows that repeat a doc_id each get a row; a null doc_id takes part, but never
names a component unless all its members are null; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import binary_column, components, per_batch, stage, text_hash

WORDS = 3
SEED = 42
RADIUS = 3
# Fingerprints per tile; a task compares two tiles, so this bounds its memory.
TILE = 1 << 18
_BLOCK = 1 << 16
_LEAF = 1 << 20


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text; 0 if it has no word."""
    # lower() of bytes touches A-Z only, split() knows exactly the ASCII white space
    tokens = text.lower().split()
    if not tokens:
        return 0
    shifted = [itertools.islice(tokens, i, None) for i in range(words)]
    shingles = map(b" ".join, zip(*shifted)) if len(tokens) >= words else iter([b" ".join(tokens)])
    hashes = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(seed))
    ones, total = np.zeros(64, np.int64), 0
    while (block := np.fromiter(itertools.islice(hashes, _BLOCK), np.uint64)).size:
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += block.size
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprint_batch(words: int, seed: int):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = binary_column(batch, "text")
        values = np.fromiter(
            (fingerprint(text.as_py() or b"", words, seed) for text in texts), np.uint64, len(texts)
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "h", "fp"]
        )

    return per_batch(build)


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, a text hash ``h`` and the fingerprint ``fp`` (a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), text_hash(F.col("doc_id"), F.col("text")).alias("h"), "text").mapInArrow(
        _fingerprint_batch(words, seed), "doc_id long, h long, fp long"
    )


def _segment_counts(values: np.ndarray, segments: int) -> np.ndarray:
    """Population count of each of ``segments`` equal parts: shape (n, segments)."""
    width = 64 // segments
    shifts = np.arange(segments, dtype=np.uint64) * np.uint64(width)
    mask = np.uint64((1 << width) - 1)
    return np.bitwise_count((values[:, None] >> shifts) & mask)


def near_pairs(
    left: np.ndarray, right: np.ndarray, radius: int = RADIUS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs (i, j) with at most ``radius`` bits between them.

    Exact; work is cut into smaller tiles by finer population counts as long as a
    pair of tiles is large, and then done in blocks of bounded size.
    """
    todo = [(np.arange(left.size), np.arange(right.size), 4)]
    while todo:
        a, b, segments = todo.pop()
        if a.size * b.size > _LEAF and segments <= 16:
            a_tiles, b_tiles = _cut(left, a, segments), _cut(right, b, segments)
            distance = sum(
                np.abs(a_tiles[0][:, None, s] - b_tiles[0][None, :, s]) for s in range(segments)
            )
            for i, j in zip(*np.nonzero(distance <= radius)):
                todo.append((a_tiles[1][i], b_tiles[1][j], segments * 2))
            continue
        rows = max(1, _LEAF // max(1, b.size))
        for start in range(0, a.size, rows):
            part = a[start:start + rows]
            near = np.bitwise_count(left[part][:, None] ^ right[b][None, :]) <= radius
            i, j = np.nonzero(near)
            if i.size:
                yield part[i], b[j]


def _cut(values: np.ndarray, index: np.ndarray, segments: int):
    """Tiles of equal segment counts: their counts and their members."""
    counts = _segment_counts(values[index], segments).astype(np.int8)
    order = np.lexsort(counts.T)
    ordered = counts[order]
    starts = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]).any(axis=1)])
    return ordered[starts].astype(np.int16), np.split(index[order], starts[1:])


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i]; the smallest index stays the root."""
    while a.size:
        a, b = _roots(parent, a), _roots(parent, b)
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _roots(parent: np.ndarray, index: np.ndarray) -> np.ndarray:
    roots = parent[index]
    while True:
        above = parent[roots]
        if np.array_equal(above, roots):
            return roots
        roots = above


def _tile_forest(radius: int):
    def link(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        on_left = table.column("on_left").to_numpy(zero_copy_only=False)
        on_right = table.column("on_right").to_numpy(zero_copy_only=False)
        nodes = np.unique(values)
        left = np.flatnonzero(np.isin(nodes, values[on_left]))
        right = np.flatnonzero(np.isin(nodes, values[on_right]))
        parent = np.arange(nodes.size)
        for i, j in near_pairs(nodes[left], nodes[right], radius):
            _unite(parent, left[i], right[j])
        roots = _roots(parent, np.arange(nodes.size))
        linked = np.flatnonzero(roots != np.arange(nodes.size))
        return pa.table({
            "a": nodes[linked].view(np.int64), "b": nodes[roots[linked]].view(np.int64),
        })

    return link


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints ``fp`` within ``radius``.

    Per pair of tiles a spanning forest of the pairs within the radius.  A class of
    population counts is cut into as many tiles as its exact size asks for.  There
    are at most 33 x 33 classes, which bounds the two broadcast tables.  A tile meets
    the tiles of the 24 neighbouring classes and its own, so about 25 rows are shuffled
    per fingerprint while classes fit one tile; beyond that raise ``tile``.
    """
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    classed = distinct.select("fp", low.cast("int").alias("p"), high.cast("int").alias("q"))
    sizes = stage(
        classed.groupBy("p", "q").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "classes"
    )
    steps = [
        F.struct((F.col("p") + dp).alias("p2"), (F.col("q") + dq).alias("q2"))
        for dp in range(-radius, radius + 1)
        for dq in range(-radius, radius + 1)
        if abs(dp) + abs(dq) <= radius
    ]
    theirs = sizes.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("tiles").alias("tiles2"))
    met = (
        classed.join(F.broadcast(sizes), ["p", "q"])
        .select("fp", "p", "q", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"),
                F.inline(F.array(*steps)))
        .join(F.broadcast(theirs), ["p2", "q2"])
        .select("fp", F.struct("p", "q", "tile").alias("own"), "p2", "q2",
                F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)).alias("tile2"))
        .withColumn("other", F.struct(F.col("p2").alias("p"), F.col("q2").alias("q"), F.col("tile2").alias("tile")))
    )
    pairs = met.select(
        "fp", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
        (F.col("own") <= F.col("other")).alias("on_left"), (F.col("own") >= F.col("other")).alias("on_right"),
    )
    return pairs.groupBy("first", "second").applyInArrow(_tile_forest(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``h``, ``fp``, ``root`` and ``component_id`` of every row.

    ``component_id`` is the smallest doc_id reachable over links, ``root`` the smallest
    fingerprint of the component, ``h`` a hash of the text (rows may share a doc_id).
    """
    marked = stage(fingerprints(docs, words, seed), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = stage(rooted.join(named, "root").select("fp", "root", "component_id"), "groups")
    return marked.join(groups, "fp").select("doc_id", "h", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates.

    ``groups`` has ``doc_id``, ``h`` and ``root`` of every row.  The row with the smallest doc_id stays; among rows that repeat it, one of them.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    kept = stage(
        (near_duplicates(docs) if groups is None else groups).groupBy("root").agg(first).select("first.doc_id", "first.h"), "kept"
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_hash(F.col("doc_id"), F.col("text")).alias("key"))
    order = Window.partitionBy("id", "key").orderBy("id")
    return (
        rows.join(kept, rows.id.eqNullSafe(kept.doc_id) & (rows.key == kept.h), "left_semi")
        .withColumn("nth", F.row_number().over(order))
        .filter("nth = 1").select("row.*")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
