"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text gives, from any position, the longest
piece that occurs in that text.  A text is parsed into such pieces; the language that
needs the fewest, weighed by the bits that a piece of its sample costs and divided by
the length of the text, wins.  Pieces do not cross words, and a word is parsed
with the blanks around it, so equal words cost the same and are parsed once per batch
of work instead of once per occurrence.

The automata are fitted to a bounded sample of rows: per language ``SAMPLE_DOCS`` labelled
documents with distinct texts, in the order of a hash of these.  As pieces do not cross
words, a sample is a list of distinct words: those of the whole texts, by the sum over
the documents of one divided by the word's rank there, until the languages have
``SAMPLE_TOTAL`` characters together.  So no long document outweighs the others.  Whole
texts are predicted.

Edge cases: null text and text without a letter give ``und`` with score 0, as does a
table without any labelled row; ties go to the first language by name; repeated rows
are predicted one by one; an empty table gives an empty result.
"""

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import per_batch

SAMPLE_DOCS = 400
SAMPLE_TOTAL = 60_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
# Words whose costs a worker keeps, words parsed at a time, rows looked at at a time.
_MEMO = 400_000
_STEP = 20_000
_ROWS = 500
# Letters of a sample word; longer ones are several, so no word takes the place of all others.
_WORD_CHARS = 64


def letter_words(text: str) -> list[str]:
    """Runs of letters, in small letters; numerals like ² and Ⅷ alone are no word."""
    found = _LETTERS.findall(text.lower())
    return [word for word in found if word.isalpha() or any(map(str.isalpha, word))]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Moves by byte of the automaton of every piece of ``text``; state 0 is the empty piece."""
    moves: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for byte in text:
        state = len(moves)
        moves.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = state
            at = links[at]
        if at >= 0:
            following = moves[at][byte]
            if lengths[at] + 1 == lengths[following]:
                links[state] = following
            else:
                copy = len(moves)
                moves.append(dict(moves[following]))
                lengths.append(lengths[at] + 1)
                links.append(links[following])
                while at >= 0 and moves[at].get(byte) == following:
                    moves[at][byte] = copy
                    at = links[at]
                links[following] = links[state] = copy
        last = state
    return moves


class Parser:
    """Cross-parses words with the automata of all languages, many words at a time.

    A table holds the moves of a language: a row per state, a column per byte that the
    samples contain; column 0 is any other byte, entry 0 means no move (no move leads
    back to state 0).  Costs of words are kept, up to ``_MEMO`` of them.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = list(samples)
        texts = [text.encode() for text in samples.values()]
        used = sorted(set(b"".join(texts)))
        self.column = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        self.column[used] = np.arange(1, len(used) + 1)
        self.tables = [self._table(suffix_automaton(text), len(used) + 1) for text in texts]
        self.bits = np.array([math.log2(len(text) + 2) for text in texts])
        self._forget()

    def _table(self, moves: list[dict[int, int]], width: int) -> np.ndarray:
        table = np.zeros((len(moves), width), np.int32)
        for state, found in enumerate(moves):
            for byte, following in found.items():
                table[state, self.column[byte]] = following
        return table

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.costs = np.zeros((1 << 12, len(self.languages) + 1), np.int32)

    def learn(self, words: set[str]) -> None:
        """Make sure that the costs of ``words`` are known."""
        new = sorted(words.difference(self.places))
        if len(self.places) + len(new) > _MEMO:
            self._forget()
            new = sorted(words)
        while len(self.places) + len(new) > len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        for start in range(0, len(new), _STEP):
            part = new[start:start + _STEP]
            first = len(self.places)
            self.costs[first:first + len(part)] = self._phrases([f" {word} ".encode() for word in part])
            self.places.update(zip(part, range(first, first + len(part))))

    def _phrases(self, words: list[bytes]) -> np.ndarray:
        """Per word and language the number of longest pieces, and last the word's bytes."""
        sizes = np.array([len(word) for word in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        codes = self.column[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.concatenate([[0], np.cumsum([len(word) for word in words])[:-1]])[order]
        found = np.zeros((len(words), len(self.languages) + 1), np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left") if len(words) else []
        for language, table in enumerate(self.tables):
            state = np.zeros(len(words), np.int32)
            count = np.zeros(len(words), np.int32)
            for step, n in enumerate(active):
                code = codes[starts[:n] + step]
                at = state[:n]
                following = table[at, code]
                stuck = following == 0
                again = table[0, code]
                count[:n] += stuck & (at != 0)
                count[:n] += stuck & (again == 0)  # a byte that the sample lacks is a piece
                state[:n] = np.where(stuck, again, following)
            found[order, language] = count + (state != 0)
        found[order, -1] = sizes - 1
        return found

    def predict(self, words: list[str]) -> tuple[str, float]:
        """Language and score of a text, given its words, which must have been learnt."""
        if not words or not self.languages:
            return UNKNOWN, 0.0
        totals = self.costs[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(axis=0)
        rates = totals[:-1] * self.bits / totals[-1]
        ranked = np.argsort(rates, kind="stable")
        best = rates[ranked[0]]
        second = rates[ranked[1]] if ranked.size > 1 else 0.0
        score = 1.0 if ranked.size == 1 else float((second - best) / second) if second > 0 else 0.0
        return self.languages[ranked[0]], score


def _predict_batch(model):
    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held = model.value  # a worker keeps it from task to task, and what is built with it
        if "parser" not in held:
            held["parser"] = Parser(held["samples"])
        parser, found = held["parser"], []
        for start in range(0, len(batch), _ROWS):
            texts = [letter_words(text.as_py() or "") for text in batch.column("text")[start:start + _ROWS]]
            parser.learn(set().union(*texts))
            found += [parser.predict(words) for words in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    return per_batch(build)


def held_out() -> Column:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def _ranked_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every distinct word of a text with its rank by frequency."""
    for row, text in enumerate(batch.column("text")):
        words = Counter(
            word[at:at + _WORD_CHARS] for word in letter_words(text.as_py()) for at in range(0, len(word), _WORD_CHARS))
        found = sorted(words, key=lambda word: (-words[word], word))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(np.full(len(found), row))), pa.array(found, pa.string()),
             pa.array(np.arange(len(found), dtype=np.int64))],
            ["lang", "word", "nth"],
        )


def samples(docs: DataFrame) -> dict[str, str]:
    """Language -> its training words, of bounded length."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.col("text") != "")).select(
        "lang", F.xxhash64("text").alias("h"), "text")
    # rows of 20 bytes or so, SAMPLE_DOCS per language; only their texts are read, each once
    chosen = (
        labelled.select("lang", "h").distinct()
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("nth") <= SAMPLE_DOCS).select("lang", "h")
    )
    texts = labelled.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    words = (
        texts.mapInArrow(per_batch(_ranked_words), "lang string, word string, nth long")
        .groupBy("lang", "word").agg(F.sum(F.floor(F.lit(1_000_000) / (F.col("nth") + 1))).alias("worth"))
    )
    languages = words.select("lang").distinct().count()
    by_rank = Window.partitionBy("lang").orderBy(F.desc("worth"), F.xxhash64("word"), "word").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    kept = (
        words.withColumn("reach", F.sum(F.length("word") + 1).over(by_rank))
        .filter(F.col("reach") <= SAMPLE_TOTAL // max(1, languages) - 1)
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("reach", "word"))).alias("words"))
    )
    return {
        row["lang"]: f" {' '.join(word['word'] for word in row['words'])} "
        for row in kept.orderBy("lang").collect()
    }


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    texts = samples(docs)
    model = docs.sparkSession.sparkContext.broadcast({"samples": texts})
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(
        _predict_batch(model), "doc_id long, held_out boolean, lang_pred string, score double"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
