"""Secrets by patterns and by two character Markov models.

Base patterns find assignments, access keys and long hexadecimal strings.  The method
adds strings that look random: a first-order Markov model of random strings and one
of ordinary identifiers give every long token a log-likelihood ratio.  Base spans are
cut out of a token and its other pieces judged; what does not pass as a whole is judged
again between slashes and equals signs.  Both are trained
on the corpus, on samples that the base patterns label: the values that they find are
random strings, all other text but long tokens with digits is ordinary.  Training counts cover all rows and are
summed by Spark into a table of fixed size (2 classes x 68 x 68 characters).

Positions are code points, the end is exclusive.

Edge cases: a null or empty text has no spans; without a single base span the random
model is uniform; repeated rows are judged one by one; an empty table gives an empty
result; extra columns are carried by ``redact`` and not read otherwise.
"""

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import per_batch, span_list

# The base kinds in their order.  The classes spell out both cases, as
# a case-blind match would also accept some letters outside ASCII.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
# A token to be judged; every access key and hexadecimal match lies inside one.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SEGMENT = re.compile(r"[^/=]{16,}")
MIN_TOKEN = 16
_DIGIT = re.compile(r"[0-9]")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
# A token counts as random from this log-likelihood ratio (1 in 20,000 tokens is a
# secret), if on average a character speaks for it with so many nats and if it has so
# many different characters.
THRESHOLD = 9.9
PER_CHARACTER = 1.5
DISTINCT = 8
_EVEN = (0.1, 0.7)
_STRENGTH = 10.0
_SIZE = len(ALPHABET) + 1
_CODES = np.zeros(256, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by start, then by kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    for token in TOKEN.finditer(text):
        start, end = token.span()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end) if m.end() - m.start() >= MIN_ACCESS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end) if m.end() - m.start() >= MIN_HEX]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def _pairs(text: str) -> np.ndarray:
    """Counts of neighbouring character codes; characters outside the alphabet are code 0."""
    codes = _CODES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if codes.size < 2:
        return np.zeros(_SIZE * _SIZE, np.int64)
    return np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE)


def _count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ordinary = np.zeros(_SIZE * _SIZE, np.int64)
    random = np.zeros(_SIZE * _SIZE, np.int64)
    for value in batch.column("text"):
        text = value.as_py()
        if not text:
            continue
        ordinary += _pairs(text)
        # long tokens with a digit carry no label of their own: they are not ordinary text
        unlabelled = [m.span() for m in TOKEN.finditer(text) if _DIGIT.search(m[0])]
        for start, end in unlabelled:
            ordinary -= _pairs(text[start:end])
        for kind, start, end in base_spans(text):
            if kind == "assign":  # the value, not its name
                start = ASSIGN.match(text, start).start(2)
            secret = _pairs(text[start:end])
            random += secret
            if not any(a <= start and end <= b for a, b in unlabelled):
                ordinary -= secret
    for label, counts in ((0, np.maximum(ordinary, 0)), (1, random)):
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(pair.size, label, np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[pair])],
            ["label", "pair", "n"],
        )


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio per pair of codes, random against ordinary.

    What reaches the driver has at most 2 x 69 x 69 rows.  After a character that was
    seldom seen, the next one follows its class's usual frequencies, mixed with an
    even choice: a tenth of it for ordinary text, most of it for random strings.
    """
    counted = docs.select("text").mapInArrow(per_batch(_count_batch), "label int, pair int, n long")
    table = np.zeros((2, _SIZE, _SIZE))
    for row in counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        table[row["label"]].flat[row["pair"]] = row["n"]
    inner = table[:, 1:, 1:]
    logs = []
    for counts, even in zip(inner, _EVEN):
        seen = counts.sum(axis=0) + 0.5
        usual = even / len(ALPHABET) + (1 - even) * seen / seen.sum()
        logs.append(np.log((counts + _STRENGTH * usual) / (counts.sum(axis=1, keepdims=True) + _STRENGTH)))
    ratio = np.zeros((_SIZE, _SIZE))
    ratio[1:, 1:] = logs[1] - logs[0]
    return ratio


def randomness(token: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of a token; words in capitals are also tried in small letters."""
    def score(text: str) -> float:
        codes = _CODES[np.frombuffer(text.encode(), np.uint8)]
        return float(ratio[codes[:-1], codes[1:]].sum())

    value = score(token)
    return min(value, score(token.lower())) if token.upper() == token else value


def _is_random(token: str, ratio: np.ndarray) -> bool:
    return len(set(token)) >= DISTINCT and randomness(token, ratio) >= max(THRESHOLD, PER_CHARACTER * len(token))


def secret_spans(text: str, ratio: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans, by start and then by kind."""
    base = base_spans(text)
    covered = []  # base spans, overlapping ones as one
    for _, start, end in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    added, at = [], 0
    for token in TOKEN.finditer(text):
        start, end = token.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        pieces, cut = [], at
        while cut < len(covered) and covered[cut][0] < end:
            pieces.append((start, covered[cut][0]))
            start, cut = covered[cut][1], cut + 1
        for a, b in [*pieces, (start, end)]:
            if cut > at:  # the signs between a base span and a piece belong to neither
                a = b - len(text[a:b].lstrip("/=")) if b > a else a
                b = a + len(text[a:b].rstrip("/=")) if b < end else b
            if b - a < MIN_TOKEN:
                continue
            if _is_random(text[a:b], ratio):
                added.append(("random", a, b))
            else:
                added += [("random", m.start(), m.end()) for m in SEGMENT.finditer(text, a, b)
                          if m.end() - m.start() < b - a and _is_random(m[0], ratio)]
    order = {kind: i for i, kind in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (s[1], order[s[0]], s[2]))


def _scan_batch(ratio: np.ndarray):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: list[list[int]] = [[], [], [], []]
        base_lists, all_lists = [], []
        for value in batch.column("text"):
            base, spans = secret_spans(value.as_py() or "", ratio)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(s[0] == kind for s in spans))
            base_lists.append(span_list(base))
            all_lists.append(span_list(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts],
             pa.array(base_lists, pa.string()), pa.array(all_lists, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base", "spans"],
        )

    return per_batch(build)


def scan(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """Counts per kind and the span lists ``base`` and ``spans`` of every row."""
    ratio = train(docs) if ratio is None else ratio
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan_batch(ratio),
        "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string",
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by a mark."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _redact_batch(ratio: np.ndarray):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for value in batch.column("text"):
            text = value.as_py()
            texts.append(text if text is None else redacted(text, secret_spans(text, ratio)[1]))
        column = batch.schema.get_field_index("text")
        yield batch.set_column(column, "text", pa.array(texts, batch.schema.field(column).type))

    return per_batch(build)


def redact(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """The rows of ``docs`` with every secret replaced by ``<secret>``."""
    ratio = train(docs) if ratio is None else ratio
    return docs.mapInArrow(_redact_batch(ratio), docs.schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``redact`` for the documents table: ``n_chars`` becomes the length of the new text."""
    cleaned = redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
