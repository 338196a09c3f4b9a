"""Merkle manifest of a dataset: a tree per source, a tree over the sources' roots, proofs.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its length in UTF-8
bytes, ``:`` and its value.  The leaves of a source ascend by doc_id; while there are several
nodes, every ``ARITY`` consecutive ones become the hash of their digests (as hex text), also
where the last run has fewer or one.  The sources' roots, ordered by source with null first,
form a tree in the same way.

Checkpoint and recompute: of a tree only every ``DEPTH``-th level is written.  An aligned
subtree between two written levels has at most ``ARITY ** DEPTH`` stored descendants; a task
reads them in order, regenerates the levels in between, emits what is asked for (the top, or
each descendant's siblings) and forgets them.  Proofs go from the top down: the path of a
stored node is a row in front of its subtree, and its descendants get their own levels
before it.  No task ever holds more than one subtree, however large a source is.

Edge cases: rows that share a doc_id are ordered by their leaf, equal rows have one proof each;
a null doc_id is first in its source and is never tampered with; an empty table gives an
empty result; a lone row is its own root and its proof is empty; further columns are ignored.
"""

import hashlib
import itertools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.ordinals import numbered
from pageloom.llm.shared import stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
# Levels between two written ones: a subtree has up to 729 stored descendants.
DEPTH = 6
_ROWS = 2_000
_NODES = "tree string, position long, digest binary, total long"
_PATHS = "tree string, position long, proof string, steps string"


def field_text(column: Column) -> Column:
    """``-`` for null, else length in bytes, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the named fields as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(columns[name]) for name in FIELDS]).cast("binary"), 256))


def without_newlines(columns: dict[str, Column]) -> dict[str, Column]:
    """What the tampering of the contract does to a row's fields."""
    return columns | {"text": F.replace(columns["text"], F.lit("\n"), F.lit(""))}


def parent(digests: list[bytes]) -> bytes:
    """The node above a run: hash of the digests' hex texts."""
    return hashlib.sha256("".join(map(bytes.hex, digests)).encode()).digest()


def levels_above(nodes: list[bytes], whole: bool, arity: int = ARITY, depth: int = DEPTH) -> list[list[bytes]]:
    """The levels of a subtree from its stored nodes up to its top.

    ``whole``: these are all nodes of the tree, which ends as soon as one is left.
    """
    levels = [nodes]
    while len(levels) <= depth and not (whole and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([parent(below[at:at + arity]) for at in range(0, len(below), arity)])
    return levels


def siblings(levels: list[list[bytes]], place: int, arity: int = ARITY) -> tuple[str, str]:
    """(hex digests of the siblings level by level, ``index/size`` of each run) of a stored node."""
    proof, steps = [], []
    for level in levels[:-1]:
        start = place - place % arity
        run = level[start:start + arity]
        proof += [node.hex() for i, node in enumerate(run) if start + i != place]
        steps.append(f"{place - start}/{len(run)}")
        place //= arity
    return "".join(proof), ",".join(steps)


def folded(digest: bytes, proof: str, steps: str) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for step in filter(None, steps.split(",")):
        index, size = map(int, step.split("/"))
        left, right = at + 64 * index, at + 64 * (size - 1)
        digest = hashlib.sha256((proof[at:left] + digest.hex() + proof[left:right]).encode()).digest()
        at = right
    return digest


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, _ROWS).columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while block := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*block), schema)], schema=schema)


def _over_subtrees(make: Callable[[list[tuple]], Iterator[tuple]], schema: pa.Schema):
    """A mapInArrow function: ``make`` gets the rows of one subtree (columns tree, block first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = itertools.groupby(_rows(batches), key=lambda row: row[:2])
        yield from _batches(itertools.chain.from_iterable(make(list(rows)) for _, rows in groups), schema)

    return run


def _by_subtree(rows: DataFrame, columns: list[str], span: int) -> DataFrame:
    """Rows with their subtree, whole subtrees in a task, each in the order of its nodes."""
    block = F.col("block") if "block" in rows.columns else F.floor(F.col("position") / span).cast("long")
    dealt = rows.withColumn("block", block).select("tree", "block", "position", *columns)
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")


def _tops(arity: int, depth: int):
    span = arity ** depth

    def make(rows: list[tuple]) -> Iterator[tuple]:
        tree, block, _, _, total = rows[0]
        top = levels_above([row[3] for row in rows], total <= span, arity, depth)[-1][0]
        yield tree, block, top, -(-total // span)

    return make


def stored_levels(nodes: DataFrame, name: str, arity: int = ARITY, depth: int = DEPTH) -> list[DataFrame]:
    """Every ``depth``-th level of all trees, from the leaves up.

    ``nodes``: ``tree, position, digest, total``.  A table holds the nodes of the trees
    that go on above it and the roots (``total`` 1) of those that end there.
    """
    schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("digest", pa.binary()), ("total", pa.int64())])
    levels = [nodes]
    while (nodes.agg(F.max("total")).first()[0] or 0) > 1:
        rising = _by_subtree(nodes.filter("total > 1"), ["digest", "total"], arity ** depth)
        nodes = stage(rising.mapInArrow(_over_subtrees(_tops(arity, depth), schema), _NODES), f"{name}-{len(levels)}")
        levels.append(nodes)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest, made``: the root of every tree and the index of the table that has it."""
    found = [level.filter("total = 1").select("tree", "digest", F.lit(made).alias("made")) for made, level in enumerate(levels)]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def _emit(arity: int, depth: int, finish: Callable[..., tuple]):
    """Siblings of each descendant; the first row of a subtree is the path of its top."""
    span = arity ** depth

    def make(rows: list[tuple]) -> Iterator[tuple]:
        head, nodes = rows[0], rows[1:]
        total = nodes[0][6]
        levels = levels_above([row[5] for row in nodes], total <= span, arity, depth)
        for place, row in enumerate(nodes):
            proof, steps = siblings(levels, place, arity)
            yield finish(row, proof + head[3], ",".join(filter(None, (steps, head[4]))), levels[0][place])

    return make


def paths(
    levels: list[DataFrame], tops: DataFrame, name: str, finish: Callable[..., tuple], schema: pa.Schema,
    ddl: str, carried: list[str] = [], arity: int = ARITY, depth: int = DEPTH,
) -> DataFrame:
    """A row per leaf, made by ``finish(row, proof, steps, digest)``.

    ``tops``: ``tree, proof, steps, made`` of every root (see ``roots``).  ``row`` has tree,
    block, position, two nulls, digest, total and the ``carried`` columns of ``levels[0]``.
    """
    path_schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("proof", pa.string()), ("steps", pa.string())])
    span, above = arity ** depth, None
    for number in range(max(0, len(levels) - 2), -1, -1):
        nodes = levels[number]
        # heads: roots that the pass over this table made, and the paths found one pass above
        made = F.col("made") == number + 1
        if number == 0:
            made = made | (F.col("made") == 0)
        else:
            nodes = nodes.filter("total > 1")
        heads = tops.filter(made).select("tree", F.lit(0).cast("long").alias("block"), "proof", "steps")
        if above is not None:
            heads = heads.unionByName(above.select("tree", F.col("position").alias("block"), "proof", "steps"))
        extra = carried if number == 0 else []
        body = nodes.withColumns({
            "block": F.floor(F.col("position") / span).cast("long"),
            "proof": F.lit(None).cast("string"), "steps": F.lit(None).cast("string")})
        front = heads.withColumns(
            {"position": F.lit(-1).cast("long"), "digest": F.lit(None).cast("binary"), "total": F.lit(None).cast("long")}
            | {column: F.lit(None).cast(levels[0].schema[column].dataType) for column in extra})
        columns = ["proof", "steps", "digest", "total", *extra]
        both = body.select("tree", "block", "position", *columns).unionByName(front)
        dealt = _by_subtree(both, columns, span)
        if number == 0:
            return dealt.mapInArrow(_over_subtrees(_emit(arity, depth, finish), schema), ddl)
        step = _emit(arity, depth, lambda row, proof, steps, _: (row[0], row[2], proof, steps))
        above = stage(dealt.mapInArrow(_over_subtrees(step, path_schema), _PATHS), f"{name}-paths-{number}")
    raise AssertionError("there is always a first level")


def manifest(
    docs: DataFrame, tampered: Callable[[dict[str, Column]], dict[str, Column]] = without_newlines,
    is_tampered: Column | None = None, arity: int = ARITY, depth: int = DEPTH,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, steps, folded_root, verified`` of every row.

    ``proof`` has the hex digests of the siblings from the leaf to the root, ``steps`` the
    index and size of each run on the way, as ``folded`` takes them.  ``folded_root`` starts
    from the leaf of the row as ``tampered`` leaves it where ``is_tampered`` (default: 2
    divides the CRC-32 of the decimal doc_id) holds, and from the leaf elsewhere.
    """
    if is_tampered is None:
        is_tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    own = {name: F.col(name) for name in FIELDS}
    changed = leaf_digest(tampered(own))
    leaves = stage(docs.select(
        F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(own).alias("digest"),
        F.when(F.coalesce(is_tampered, F.lit(False)), changed).alias("changed")), "leaves")
    nodes = stage(numbered(leaves, ["tree"], ["doc_id", "digest"], "leaves"), "numbered")
    levels = stored_levels(nodes, "sources", arity, depth)
    subroots = stage(roots(levels), "subroots")
    # the upper tree has one leaf per source; its tree key is a constant
    ordered = numbered(subroots, [], ["tree"], "subroots")
    upper = stage(ordered.select(
        F.lit("").alias("tree"), "position", "digest", "total", F.col("tree").alias("source"), "made"), "sources")
    upper_levels = stored_levels(upper, "roots", arity, depth)
    apex = roots(upper_levels).select(
        "tree", F.lit("").alias("proof"), F.lit("").alias("steps"), "made")
    top_schema = pa.schema([("tree", pa.string()), ("subroot", pa.string()), ("proof", pa.string()), ("steps", pa.string()), ("made", pa.int32())])
    tops = stage(paths(
        upper_levels, apex, "roots", lambda row, proof, steps, digest: (row[7], digest.hex(), proof, steps, row[8]),
        top_schema, "tree string, subroot string, proof string, steps string, made int", ["source", "made"], arity, depth), "tops")
    found = roots(upper_levels).first()
    root = found["digest"].hex() if found else ""
    leaf_schema = pa.schema([("tree", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("proof", pa.string()),
                             ("steps", pa.string()), ("subroot", pa.string()), ("folded_root", pa.string())])

    def finish(row: tuple, proof: str, steps: str, digest: bytes) -> tuple:
        # the head's steps carry the subroot in front, so that it comes with every leaf
        steps, _, subroot = steps.rpartition(",")
        start = digest if row[8] is None else bytes(row[8])
        return row[0], row[7], digest.hex(), proof, steps, subroot, folded(start, proof, steps).hex()

    heads = tops.select("tree", "proof", F.concat_ws(",", F.nullif("steps", F.lit("")), "subroot").alias("steps"), "made")
    rows = paths(
        levels, heads, "sources", finish, leaf_schema,
        "tree string, doc_id long, leaf string, proof string, steps string, subroot string, folded_root string",
        ["doc_id", "changed"], arity, depth)
    return rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "steps", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
