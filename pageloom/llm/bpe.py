"""Byte-level BPE: texts to token ids and back, with a public vocabulary.

A text is cut at special tokens, then into words by the vocabulary's pattern; the bytes of
a word are merged by rank.  Merging keeps the symbols in a doubly linked list and the
candidate pairs in a priority queue of (rank, place): the lowest rank merges first, of equal
ranks the leftmost; an entry whose symbols have merged since is stale and skipped.  That
takes O(n log n) for a word of n bytes, so one endless word holds no task.  Decoding
concatenates the byte strings of the ids.

Words are encoded once and remembered (at most twice ``_MEMO`` of them), which changes no id, as no
merge crosses words.  Characters that Unicode has not assigned may be letters to one library
version and not to the next, so texts with one are cut into words by the vocabulary's own
pre-tokenizer.

Edge cases: a null text is empty and has no ids; a special token's string in a text is that
token; ids that are not in the vocabulary raise a KeyError; bytes that are no UTF-8 (ids cut in
the middle of a character) decode to replacement characters; repeated rows and null doc_ids
are encoded one by one; an empty table gives an empty result; further columns are carried.
"""

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how the vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMO = 150_000
# Ids that go to Spark in one batch.
_BATCH_IDS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _Unassigned(Exception):
    """A word holds a character without a category."""


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file with a byte-level BPE model."""

    def __init__(self, file: str):
        content = json.loads(file)
        model, before = content["model"], content["pre_tokenizer"]
        plain = (
            model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
            and content["normalizer"] is None and not model.get("ignore_merges") and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in content["added_tokens"])
        )
        if not plain:
            raise ValueError("the tokenizer file has steps besides byte-level words and merges")
        self.file = file
        alphabet = byte_alphabet()
        ids = model["vocab"]
        self.of_byte = [0] * 256
        for character, byte in alphabet.items():
            self.of_byte[byte] = ids[character]
        self.pairs, self.tokens = model["merges"], ids
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.bytes_of = {
            id_: bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
            for token, id_ in (ids | self.special).items()
        }
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = _Known(self)

    @cached_property
    def merges(self) -> tuple[list[dict[int, int]], list[int]]:
        """Of each id, the ranks of its pairs by the id to its right; and the id that each rank makes."""
        ids, none = self.tokens, {}
        ranks, made = [none] * (max(ids.values()) + 1), []
        for rank, merge in enumerate(self.pairs):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if ranks[ids[left]] is none:
                ranks[ids[left]] = {}
            ranks[ids[left]][ids[right]] = rank
            made.append(ids[left + right])
        return ranks, made

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a word."""
        ids = [self.of_byte[byte] for byte in word]
        size = len(ids)
        if size == 1:
            return (ids[0],)
        ranks, made = self.merges
        # a queue entry is rank and place in one number
        queue = [
            rank * size + i for i in range(size - 1) if (rank := ranks[ids[i]].get(ids[i + 1])) is not None
        ]
        heapify(queue)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while queue:
            entry = heappop(queue)
            rank = entry // size
            i = entry - rank * size
            left, j = ids[i], after[i]
            # stale: the symbol is gone, or has merged since, or its neighbour has
            if left < 0 or j >= size or ranks[left].get(ids[j]) != rank:
                continue
            merged = ids[i] = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (rank := ranks[merged].get(ids[k])) is not None:
                    heappush(queue, rank * size + i)
            h = before[i]
            if h >= 0 and (rank := ranks[ids[h]].get(merged)) is not None:
                heappush(queue, rank * size + h)
        return tuple([id_ for id_ in ids if id_ >= 0])

    def _pieces(self, text: str) -> list[int]:
        try:
            return list(chain.from_iterable(map(self.known.__getitem__, self.words.findall(text))))
        except _Unassigned:
            pre = _pre_tokenizer(self.file).pre_tokenize_str(text)
            return list(chain.from_iterable(self.merge(text[a:b].encode()) for _, (a, b) in pre))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the string of a special token is that token."""
        if self.cut is None or not any(special in text for special in self.special):
            return self._pieces(text)
        ids = []
        for piece in self.cut.split(text):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                ids += self._pieces(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _pre_tokenizer(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(file).pre_tokenizer


class _Known(dict):
    """Ids of words seen lately: a full memory becomes the old one, where a word is found again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.old = vocabulary, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):
                raise _Unassigned
            ids = self.vocabulary.merge(word.encode())
        if len(word) <= 64:  # endless words are not worth their room
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def load(spark: SparkSession, tokenizer: str = TOKENIZER) -> Broadcast:
    """The tokenizer file, read once by the driver; workers build their vocabulary from it."""
    with open(tokenizer, encoding="utf-8") as file:
        return spark.sparkContext.broadcast({"file": file.read()})


def vocabulary_of(held: dict) -> Vocabulary:
    """A worker keeps the broadcast value from task to task, and the vocabulary with it."""
    if "vocabulary" not in held:
        held["vocabulary"] = Vocabulary(held["file"])
    return held["vocabulary"]


def _encode_batches(vocabulary: Broadcast, text: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary_of(vocabulary.value).encode
        for batch in batches:
            place = batch.schema.get_field_index(text)
            kept = [i for i in range(batch.num_columns) if i != place]
            names = [batch.schema.names[i] for i in kept]
            start, size, found = 0, 0, []

            def rows(stop: int) -> pa.RecordBatch:
                part = batch.slice(start, stop - start)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                values = np.concatenate([np.array(one, np.int32) for one in found])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
                return pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], lists], [*names, ids])

            for i, value in enumerate(batch.column(place)):
                found.append(encode(value.as_py() or ""))
                size += len(found[-1])
                if size >= _BATCH_IDS:
                    yield rows(i + 1)
                    start, size, found = i + 1, 0, []
            if found:
                yield rows(batch.num_rows)

    return run


def _decode_batches(vocabulary: Broadcast, ids: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary_of(vocabulary.value).decode
        for batch in batches:
            place = batch.schema.get_field_index(ids)
            kept = [i for i in range(batch.num_columns) if i != place]
            lists = batch.column(place)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(texts, pa.string())],
                [*[batch.schema.names[i] for i in kept], text])

    return run


def _replaced(schema: T.StructType, old: str, new: str, kind: T.DataType) -> T.StructType:
    """``schema`` with the column ``old`` taken out and ``new`` at the end."""
    if new in schema.names and new != old:
        raise ValueError(f"there is a column {new} already")
    return T.StructType([*[f for f in schema.fields if f.name != old], T.StructField(new, kind)])


def encode(docs: DataFrame, tokenizer: str | Broadcast = TOKENIZER, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``ids``, its token ids (never null)."""
    vocabulary = load(docs.sparkSession, tokenizer) if isinstance(tokenizer, str) else tokenizer
    schema = _replaced(docs.schema, text, ids, T.ArrayType(T.IntegerType(), False))
    return docs.mapInArrow(_encode_batches(vocabulary, text, ids), schema)


def decode(tokens: DataFrame, tokenizer: str | Broadcast = TOKENIZER, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the column ``ids`` replaced by ``text``, what the ids stand for.

    Null ids count as none.
    """
    vocabulary = load(tokens.sparkSession, tokenizer) if isinstance(tokenizer, str) else tokenizer
    schema = _replaced(tokens.schema, ids, text, T.StringType())
    whole = tokens.withColumn(ids, F.coalesce(ids, F.array().cast("array<int>")))
    return whole.mapInArrow(_decode_batches(vocabulary, ids, text), schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
