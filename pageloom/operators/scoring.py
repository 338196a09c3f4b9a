"""Relevance, keywords, category and run figures."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import words
from pageloom.functions.expr import add_struct
from pageloom.operators import text as text_ops
from pageloom.operators.joins import lookup_join, salted_join
from pageloom.plans.staging import stage

# A term with more than this part of the rows of a corpus is looked up without a shuffle.
FREQUENT_TERMS = 100_000


def with_scores(stats: DataFrame, rules=None) -> DataFrame:
    """Add relevance_score and inferred_category to a table of text stats."""
    n, unique, hits = F.col("n_tokens"), F.col("unique_terms"), F.col("topic_hits")
    return stats.withColumn("relevance_score", words.relevance(n, unique, hits)).withColumn(
        "inferred_category", words.infer_category(F.col("top_keywords"), rules)
    )


def score_texts(
    df: DataFrame, keys: list[str], text: str,
    topic_terms: list[str] = vocab.TOPIC_TERMS, stop_words: list[str] = vocab.STOP_WORDS,
    k: int = vocab.KEYWORDS_PER_PAGE, rules=None,
) -> DataFrame:
    """Scores of a table with one text per row.  Narrow: no shuffle at any size."""
    stats = words.column_stats(text, tuple(topic_terms), tuple(stop_words), k)
    return with_scores(add_struct(df, keys, stats), rules)


def top_keywords(counts: DataFrame, keys: list[str], k: int = vocab.KEYWORDS_PER_PAGE) -> DataFrame:
    """``keys, top_keywords``: tf descending, then term.

    The rank filter becomes a group limit before the shuffle, so a key with any
    number of terms sends at most k rows per task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("tf").desc(), F.col("term"))
    best = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return best.groupBy(*keys).agg(F.transform(listed, lambda t: t["term"]).alias("top_keywords"))


def score_groups(
    df: DataFrame, keys: list[str], text: Column | str,
    topic_terms: list[str] = vocab.TOPIC_TERMS, stop_words: list[str] = vocab.STOP_WORDS,
    k: int = vocab.KEYWORDS_PER_PAGE, rules=None,
) -> DataFrame:
    """Like ``score_texts`` when several rows share a key (turns of a conversation).

    Keys without any token keep a row: no tokens, score 0, no keywords.  A null key is
    a key like any other.
    """
    counts = text_ops.term_freq(df, keys, text, stop_words)
    totals = text_ops.term_totals(counts, keys, topic_terms, every=df)
    keywords = top_keywords(counts, keys, k)
    same = [totals[key].eqNullSafe(keywords[key]) for key in keys]
    stats = totals.join(keywords, same, "left").select(
        *[totals[key] for key in keys], "n_tokens", "unique_terms", "topic_hits",
        F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"),
    )
    return with_scores(stats, rules)


def topic_hits_from_table(
    counts: DataFrame, keys: list[str], vocabulary: DataFrame, every: DataFrame | None = None,
    repeats: bool = False,
) -> DataFrame:
    """``keys, topic_hits`` with the prefixes in a table column ``prefix``.

    "Starts with" becomes an equi-join: each distinct term is expanded into its own
    prefixes, one per length that occurs in the vocabulary, and looked up.  No theta join,
    whatever the size of the vocabulary.  The list of lengths is the square root of the
    vocabulary's bytes at most.  With ``repeats`` a prefix listed twice counts twice.
    Keys of ``every`` without a term get 0.
    """
    times = F.count("*") if repeats else F.lit(1).cast("bigint")
    prefixes = vocabulary.groupBy("prefix").agg(times.alias("times"))
    lengths = prefixes.agg(F.sort_array(F.collect_set(F.char_length("prefix")))).first()[0]
    occurring = F.array(*map(F.lit, lengths)).cast("array<int>")
    terms = counts.groupBy("term").agg(F.count("*").alias("rows"))
    expanded = terms.select(
        "term",
        "rows",
        F.explode(
            F.transform(
                F.filter(occurring, lambda n: n <= F.char_length("term")),
                lambda n: F.left(F.col("term"), n),
            )
        ).alias("prefix"),
    )
    found = stage(
        lookup_join(expanded, prefixes, ["prefix"], spread_by=["term"])
        .groupBy("term")
        .agg(F.sum("times").alias("n_prefixes"), F.max("rows").alias("rows")),
        "prefix-matches",
    )
    joined = salted_join(counts, found, ["term"], spread_by=keys, how="left", heat="rows")
    hits = F.col("tf") * F.coalesce("n_prefixes", F.lit(0))
    rows = text_ops.with_every_key(joined.select(*keys, hits.alias("hits")), keys, every)
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("topic_hits"))


def keep_relevant(scored: DataFrame, threshold: float = vocab.DEFAULT_THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold."""
    return scored.filter(F.col("relevance_score") >= F.lit(threshold))


def tf_idf(
    counts: DataFrame, keys: list[str], n_docs: Column, document_freq: DataFrame | None = None
) -> DataFrame:
    """``keys, term, tf, df, weight`` over a corpus.

    weight = tf / n_tokens * (ln((1 + N) / (1 + df)) + 1) with N documents, df of
    them containing the term.  ``counts`` needs ``n_tokens`` (see
    ``term_freq_with_total``); ``document_freq`` (``text.document_freq``) is derived
    from it if not given.  ``counts`` is read three times, so it should be a written table.

    A term with more than 1/``FREQUENT_TERMS`` of the rows is looked up where its rows are
    read.  Fewer than ``FREQUENT_TERMS`` terms can be that frequent, which bounds what is
    broadcast, and they own most rows; only the rest is shuffled, without a hot key.
    """
    if document_freq is None:
        document_freq = text_ops.document_freq(counts)
    vocabulary = stage(document_freq, "document-freq")
    often = F.col("df") > (vocabulary.agg(F.sum("df")).first()[0] or 0) / FREQUENT_TERMS
    frequent = F.broadcast(vocabulary.filter(often))
    others = counts.join(F.broadcast(vocabulary.filter(often).select("term")), "term", "left_anti")
    found = counts.join(frequent, "term").unionByName(
        others.join(vocabulary.filter(~often).hint("merge"), "term"))
    idf = F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return found.select(
        *keys, "term", "tf", "df",
        (F.col("tf") / F.col("n_tokens").cast("double") * idf).alias("weight"),
    )


def run_figures(threshold: float | None) -> list[Column]:
    """Aggregates ``pages_in, discarded, kept`` of a scored table."""
    kept = F.lit(True) if threshold is None else F.col("relevance_score") >= F.lit(threshold)
    return [
        F.count(F.lit(1)).alias("pages_in"), F.count_if(~kept).alias("discarded"), F.count_if(kept).alias("kept")]


def run_metrics(scored: DataFrame, read_errors: DataFrame | None = None,
                threshold: float = vocab.DEFAULT_THRESHOLD) -> DataFrame:
    """One row: pages_in, read_errors, discarded, kept.

    For tables that are there already; a job takes the same figures from its own run
    (``plans.files.write_run``), without another scan.
    """
    n_errors = F.lit(0) if read_errors is None else read_errors.agg(F.count("*")).scalar()
    return scored.agg(*run_figures(threshold)).withColumn("read_errors", n_errors.cast("bigint"))


def diagnostics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per-page figures of the stages."""
    return scored.select(*keys, "n_tokens", "unique_terms", "relevance_score", "inferred_category")
