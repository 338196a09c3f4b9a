"""Tokens and term frequencies of any table with a text column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import words
from pageloom.functions.expr import add_struct, explode_structs, let


def tokenize(
    df: DataFrame, keys: list[str], text: Column | str, stop_words: list[str] = vocab.STOP_WORDS
) -> DataFrame:
    """``keys, tokens``: ordered tokens of each row, duplicates kept."""
    return df.select(*keys, words.tokens(F.col(text) if isinstance(text, str) else text, stop_words).alias("tokens"))


def term_freq(
    df: DataFrame, keys: list[str], text: Column | str,
    stop_words: list[str] = vocab.STOP_WORDS, unique_keys: bool = False,
) -> DataFrame:
    """``keys, term, tf``.

    Each row is counted in place.  With ``unique_keys`` (one row per key) that is
    the result and nothing is shuffled; otherwise the per-row counts, already
    combined, are summed per (key, term).
    """
    text = F.col(text) if isinstance(text, str) else text
    counted = explode_structs(df, keys, words.term_counts(words.tokens(text, stop_words)), "term")
    return counted if unique_keys else sum_terms(counted, keys)


def sum_terms(counted: DataFrame, keys: list[str]) -> DataFrame:
    return counted.groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def term_freq_with_total(
    df: DataFrame, keys: list[str], text: Column | str, stop_words: list[str] = vocab.STOP_WORDS
) -> DataFrame:
    """``keys, term, tf, n_tokens`` for one row per key, without a shuffle."""
    text = F.col(text) if isinstance(text, str) else text
    counted = let(
        words.tokens(text, stop_words),
        lambda t: F.struct(
            F.size(t).cast("bigint").alias("n_tokens"), words.term_counts(t).alias("_counts")
        ),
    )
    return explode_structs(
        add_struct(df, keys, counted), [*keys, "n_tokens"], F.col("_counts"), "term"
    ).select(*keys, "term", "tf", "n_tokens")


def document_freq(
    df: DataFrame, text: Column | str | None = None, stop_words: list[str] = vocab.STOP_WORDS
) -> DataFrame:
    """``term, df``: in how many rows each term occurs.

    Without ``text``, ``df`` has a row per row and term (``term_freq_with_total``).
    """
    if text is not None:
        text = F.col(text) if isinstance(text, str) else text
        df = df.select(F.explode(F.array_distinct(words.tokens(text, stop_words))).alias("term"))
    return df.groupBy("term").agg(F.count("*").alias("df"))


def with_every_key(rows: DataFrame, keys: list[str], every: DataFrame | None) -> DataFrame:
    """``rows`` plus one row with nulls per row of ``every``.

    An aggregation by key then keeps keys without rows, null keys included, and
    needs no join back.
    """
    if every is None:
        return rows
    return rows.unionByName(every.select(*keys), allowMissingColumns=True)


def term_totals(
    counts: DataFrame, keys: list[str], topic_terms: list[str] = vocab.TOPIC_TERMS, every: DataFrame | None = None
) -> DataFrame:
    """``keys, n_tokens, unique_terms, topic_hits`` of a term frequency table.

    Keys of ``every`` without a term get zeros.
    """
    rows = with_every_key(counts.select(*keys, "term", "tf"), keys, every)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"),
        F.count("term").alias("unique_terms"),
        F.coalesce(F.sum(F.col("tf") * words.prefix_matches(F.col("term"), topic_terms)), F.lit(0)).alias("topic_hits"),
    )
