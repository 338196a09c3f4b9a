"""Named entities from a pluggable recogniser or from a dictionary table."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import vocab
from pageloom.functions import words
from pageloom.functions.batches import parts
from pageloom.functions.expr import explode_structs, let
from pageloom.functions.entities import ENTITY_LIST, entity_list, kind_of
from pageloom.operators import joins
from pageloom.operators.joins import keep_wanted, key_bitmaps, measured_bytes, on_demand_join
from pageloom.operators.text import with_every_key
from pageloom.plans.staging import stage

# A recogniser maps (text, labels) to (span text, label) pairs in its own order.  If it has a
# method ``batch``, that gets a list of texts instead and returns a list of such results.
Recogniser = Callable[[str, list[str]], Iterable[tuple[str, str]]]

SPANS = T.ArrayType(T.StructType().add("text", T.StringType()).add("label", T.StringType()))
FOUND = T.StructType().add("spans", SPANS).add("status", T.StringType())
# What became of a text: recognised; null; the recogniser could not be loaded; it failed on this text.
OK, NO_TEXT, NOT_LOADED, FAILED = "ok", "no text", "not loaded", "failed"
# Texts in one call of a recogniser's ``batch``.
BATCH_TEXTS = 64


def _recognise_all(recogniser, texts: list[str], labels: list[str]) -> list[tuple[list | None, str]]:
    """(spans, status) of each text; a batch that fails is done again text by text."""
    found = []
    for start in range(0, len(texts), BATCH_TEXTS):
        part = texts[start:start + BATCH_TEXTS]
        batch = getattr(recogniser, "batch", None)
        if batch is not None:
            try:
                results = [[(t, label) for t, label in spans] for spans in batch(part, labels)]
                if len(results) == len(part):
                    found += [(spans, OK) for spans in results]
                    continue
            except Exception:  # one of them is bad: find out which
                pass
        for text in part:
            try:
                spans = batch([text], labels)[0] if batch is not None else recogniser(text, labels)
                found.append(([(t, label) for t, label in spans], OK))
            except Exception:  # one bad page must not stop the job
                found.append(([], FAILED))
    return found


def span_detector(
    load: Callable[[], Recogniser], labels: list[str] = vocab.ENTITY_LABELS
) -> Callable[[Column], Column]:
    """Column function that runs a recogniser over texts in Arrow batches: ``spans, status``.

    ``load`` runs on the executor, once per Python worker, which keeps the recogniser
    from task to task; ship model files with ``SparkContext.addFile`` and open them
    there.  A recogniser that cannot be loaded finds nothing, and the job goes on; a
    text it fails on gets no spans, as does a null text.  ``status`` says which.
    """
    labels = list(labels)
    span = pa.struct([("text", pa.string()), ("label", pa.string())])
    kind = pa.struct([("spans", pa.list_(span)), ("status", pa.string())])
    # a worker reads a broadcast value once and keeps it, with what is added to it
    kept = SparkContext.getOrCreate().broadcast({"load": cloudpickle.dumps(load)})

    def found_in(recogniser: Recogniser | None, texts: list[str | None]) -> pa.Array:
        rows = [([], NO_TEXT if text is None else NOT_LOADED) for text in texts]
        if recogniser is not None:
            given = [i for i, text in enumerate(texts) if text is not None]
            for i, found in zip(given, _recognise_all(recogniser, [texts[i] for i in given], labels)):
                rows[i] = found
        return pa.array(
            [{"spans": [{"text": t, "label": label} for t, label in spans], "status": status} for spans, status in rows], kind)

    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = kept.value
        if "recogniser" not in held:
            try:
                held["recogniser"] = cloudpickle.loads(held["load"])()
            except Exception:  # articles without entities are better than none
                held["recogniser"] = None
        for batch in batches:
            for part in parts(batch):
                yield found_in(held["recogniser"], part.to_pylist())

    detect.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(detect, FOUND)


def detect_entities(
    df: DataFrame, body: str, load: Callable[[], Recogniser] | None,
    labels: list[str] = vocab.ENTITY_LABELS, limit: int = vocab.ENTITIES_PER_PAGE, status: str | None = None,
    lookup: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add ``named_entities``; without a recogniser and a dictionary every list is empty.

    Pages without an extractable body are not sent to the recogniser.  ``status`` names a
    column for what became of each page.  ``lookup`` (``dictionary_detector``) adds entries
    of a dictionary after what the recogniser found.
    """
    text = F.nullif(F.col(body), F.lit(vocab.NO_BODY))
    spans = F.array().cast(SPANS)
    if load is not None:
        df = df.withColumn("_found", span_detector(load, labels)(text))
        spans = F.col("_found")["spans"]
    if lookup is not None:
        df = df.withColumn("_entries", lookup(words.word_list(text)))
        entries = F.transform("_entries", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")))
        spans = F.concat(spans, F.coalesce(entries, F.array().cast(SPANS)))
    if load is None and lookup is None:
        found = df.withColumn("named_entities", F.array().cast(ENTITY_LIST))
    else:
        found = df.withColumn("named_entities", entity_list(spans, limit))
    if status is not None:
        found = found.withColumn(status, F.lit(NOT_LOADED) if load is None else F.col("_found")["status"])
    return found.drop("_found", "_entries")


ENTRY_SPANS = T.ArrayType(
    T.StructType().add("seq", T.IntegerType()).add("text", T.StringType()).add("label", T.StringType()))


def dictionary_entries(dictionary: DataFrame) -> DataFrame:
    """``text, label`` with one label per text, written once."""
    return stage(dictionary.groupBy("text").agg(F.min("label").alias("label")), "dictionary")


def fits_broadcast(entries: DataFrame) -> bool:
    """Whether a dictionary's measured size allows a copy per worker."""
    return measured_bytes(entries) <= joins.BROADCAST_LIMIT_BYTES


def dictionary_detector(entries: DataFrame, max_words: int = 3) -> Callable[[Column], Column]:
    """Column function: word list of a text -> ``array<struct<seq, text, label>>``.

    For each entry found as a run of up to ``max_words`` words its first place, in the order
    of the text.  The dictionary goes to every worker as a hash table, so measure it first
    (``fits_broadcast``).  Words that begin no entry are settled for a whole part of a batch
    at once.
    """
    listed = [(row["text"], row["label"]) for row in entries.collect()]
    kept = SparkContext.getOrCreate().broadcast({"entries": listed})

    def table(held: dict) -> tuple[pa.Array, dict[str, list[int]], dict[str, str]]:
        if "table" not in held:
            labels, sizes = {}, {}
            for text, label in held.pop("entries"):
                size = 0 if text is None else text.count(" ") + 1
                if 0 < size <= max_words:
                    labels[text] = label
                    sizes.setdefault(text.split(" ", 1)[0], set()).add(size)
            held["table"] = pa.array(sizes, pa.string()), {w: sorted(found) for w, found in sizes.items()}, labels
        return held["table"]

    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("seq", pa.int32()), ("text", pa.string()), ("label", pa.string())]))
        beginnings, sizes, labels = table(kept.value)
        for batch in batches:
            for part in parts(batch):
                ends = part.offsets.to_pylist()
                first = ends[0]
                words_ = part.values.slice(first, ends[-1] - first)
                begins = pc.is_in(words_, beginnings).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
                flat = words_.to_pylist() if begins else []
                rows, at = [], 0
                for row in range(len(part)):
                    start, stop, found = ends[row] - first, ends[row + 1] - first, {}
                    while at < len(begins) and begins[at] < start:
                        at += 1
                    while at < len(begins) and begins[at] < stop:
                        i = begins[at]
                        for size in sizes[flat[i]]:
                            run = flat[i] if size == 1 else " ".join(flat[i:i + size]) if i + size <= stop else None
                            if run in labels and run not in found:
                                found[run] = (i - start) * max_words + size - 1
                        at += 1
                    rows.append(None if not part[row].is_valid else [
                        {"seq": seq, "text": text, "label": labels[text]} for text, seq in found.items()])
                yield pa.array(rows, kind)

    detect.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(detect, ENTRY_SPANS)


def dictionary_spans(
    df: DataFrame, keys: list[str], text: Column | str, dictionary: DataFrame, max_words: int = 3
) -> DataFrame:
    """``keys, seq, text, label``: first place of each dictionary entry in a text.

    Entries are matched as whole runs of up to ``max_words`` words, case-sensitive.  A
    dictionary whose measured size allows it is looked up in each text's row, so only
    found entries leave the row.  Beyond that, a bitmap of the dictionary keeps most other
    runs, each once per text, out of the shuffle; the rest is joined with the dictionary, an
    entry that many texts hold being copied as often as its share asks for.
    """
    text = F.col(text) if isinstance(text, str) else text
    entries = dictionary_entries(dictionary)
    if fits_broadcast(entries):
        found = dictionary_detector(entries, max_words)(words.word_list(text))
        hits = explode_structs(df, keys, found, "seq")
    else:
        grams = explode_structs(df, keys, let(words.word_list(text), _grams(max_words)), "seq")
        entries = stage(entries, "entries")
        wanted = stage(keep_wanted(grams, "text", *key_bitmaps(entries, "text")), "wanted-runs")
        hits = on_demand_join(wanted, entries, ["text"], spread_by=[*keys, "seq"])
    return hits.groupBy(*keys, "text", "label").agg(F.min("seq").alias("seq"))


def _grams(max_words: int) -> Callable[[Column], Column]:
    """Function of a word list: its distinct runs with their first place."""

    def grams_of(w: Column, n: int) -> Column:
        if n == 1:
            return F.transform(w, lambda x, i: F.struct((i * max_words).alias("seq"), x.alias("text")))
        return F.when(
            F.size(w) >= n,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - n),
                lambda i: F.struct(
                    (i * max_words + (n - 1)).alias("seq"),
                    F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]).alias("text"),
                ),
            ),
        ).otherwise(F.array())

    def all_grams(w: Column) -> Column:
        grams = F.concat(*[grams_of(w, n) for n in range(1, max_words + 1)])
        by_text = F.transform(grams, lambda g: F.struct(g["text"].alias("text"), g["seq"].alias("seq")))
        return let(F.sort_array(by_text), lambda s: F.filter(
            s, lambda g, i: (i == 0) | (g["text"] != F.get(s, i - 1)["text"])))

    return all_grams


def first_entities(
    spans: DataFrame, keys: list[str], limit: int = vocab.ENTITIES_PER_PAGE
) -> DataFrame:
    """Span rows -> ``keys, rank, text, kind``: first label per text, first ``limit`` texts."""
    firsts = spans.groupBy(*keys, "text").agg(
        F.min("seq").alias("_seq"), F.min_by("label", "seq").alias("_label")
    )
    order = Window.partitionBy(*keys).orderBy("_seq", "text")
    return (
        firsts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(*keys, "rank", "text", kind_of(F.col("_label")).alias("kind"))
    )


def collect_entities(
    spans: DataFrame, keys: list[str], limit: int = vocab.ENTITIES_PER_PAGE, every: DataFrame | None = None
) -> DataFrame:
    """``keys, named_entities`` from span rows; lists hold at most ``limit``.

    Keys of ``every`` without a span get an empty list.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "text", "kind"))))
    return with_every_key(first_entities(spans, keys, limit), keys, every).groupBy(*keys).agg(
        F.transform(listed, lambda e: F.struct(e["text"].alias("text"), e["kind"].alias("kind")))
        .cast(ENTITY_LIST)
        .alias("named_entities")
    )
