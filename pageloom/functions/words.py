"""Text -> tokens -> term counts -> scores, as column expressions.

A text is one row, so everything that concerns one text is computed inside its
row: sort the tokens, count the runs, score the counts.  No shuffle is needed
until texts that share a key meet (see ``operators.text``).
"""

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions.expr import built_once, let, matches_any

# What separates words, and the score's weights and scale.
NOT_ALPHANUMERIC = r"[^\p{IsAlphabetic}\p{N}]+"
TOPIC_WEIGHT, RICHNESS_WEIGHT, DIVERSITY_WEIGHT = 0.60, 0.25, 0.15
RICH_TEXT_TOKENS = 300.0


def split_words(text: Column) -> Column:
    """Split on everything that is not a Unicode letter or number."""
    return F.split(text, NOT_ALPHANUMERIC)


def word_list(text: Column) -> Column:
    """The words of a text as they stand in it."""
    return F.filter(split_words(text), lambda w: w != "")


def keep_word(word: Column, stop_words: list[str]) -> Column:
    """At least 3 bytes, not a stop word, still alphanumeric in lower case.

    The only letter whose lower-case form is not alphanumeric is the dotted
    capital I; it leaves a combining dot behind.
    """
    return (
        (F.octet_length(word) >= 3)
        & ~word.isin(list(stop_words))
        & ~F.contains(word, F.lit("\u0307"))
    )


def lemmatise(word: Column) -> Column:
    """Cut the first matching ending; lengths are UTF-8 bytes."""
    size = F.octet_length(word)

    def without(n: int) -> Column:
        return F.left(word, F.char_length(word) - n)

    return (
        F.when(F.endswith(word, F.lit("ing")) & (size > 6), without(3))
        .when(F.endswith(word, F.lit("ed")) & (size > 5), without(2))
        .when(F.endswith(word, F.lit("ies")) & (size > 5), F.concat(without(3), F.lit("y")))
        .when(
            F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")) & (size > 4),
            without(1),
        )
        .otherwise(word)
    )


def tokens(text: Column, stop_words: list[str] = vocab.STOP_WORDS) -> Column:
    """Ordered tokens of a text, duplicates kept; null text gives no tokens."""
    words = F.transform(split_words(F.coalesce(text, F.lit(""))), F.lower)
    return F.transform(F.filter(words, lambda w: keep_word(w, stop_words)), lemmatise)


def count_runs(terms: Column, extra: int = 0) -> Column:
    """``array<struct<term, tf>>`` of a sorted array: finds where each run of equal
    terms starts and takes the distance to the next start, plus ``extra``."""
    size = F.size(terms)
    starts = F.filter(
        F.sequence(F.lit(0), size - 1),
        lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)),
    )
    counted = let(
        starts,
        lambda at: F.transform(
            at,
            lambda start, k: F.struct(
                F.get(terms, start).alias("term"),
                (F.coalesce(F.get(at, k + 1), size) - start + extra).cast("bigint").alias("tf"),
            ),
        ),
    )
    return F.when(size > 0, counted).otherwise(
        F.array().cast("array<struct<term:string,tf:bigint>>")
    )


def term_counts(token_array: Column) -> Column:
    """``array<struct<term, tf>>`` in term order, in O(n log n) without a shuffle."""
    return let(F.sort_array(token_array), count_runs)


def prefix_matches(term: Column, prefixes: list[str], repeats: bool = False) -> Column:
    """How many of ``prefixes`` the term starts with; with ``repeats``, one listed twice counts twice.

    One hash lookup per distinct prefix length and multiplicity, however long the list is.
    """
    groups: dict[tuple[int, int], list[str]] = {}
    for prefix, times in sorted(Counter(prefixes if repeats else set(prefixes)).items()):
        groups.setdefault((len(prefix), times), []).append(prefix)
    if not groups:
        return F.lit(0)
    total = F.lit(0)
    for (length, times), group in sorted(groups.items()):
        total = total + F.left(term, F.lit(length)).isin(group).cast("int") * times
    # most terms share no beginning with any prefix: settle those with one lookup
    return F.when(may_match(term, prefixes), total).otherwise(F.lit(0))


def may_match(term: Column, prefixes: list[str]) -> Column:
    """Whether the term begins like at least one prefix."""
    shortest = min(map(len, prefixes))
    return F.left(term, F.lit(shortest)).isin(sorted({p[:shortest] for p in prefixes}))


def topic_hits(token_array: Column, prefixes: list[str], repeats: bool = False) -> Column:
    """Sum over all tokens of the number of prefixes they start with.

    The same as the sum of tf over (term, prefix) pairs, without needing the counts.
    """
    if not prefixes:
        return F.lit(0).cast("bigint")
    return F.aggregate(
        F.filter(token_array, lambda t: may_match(t, prefixes)),
        F.lit(0).cast("bigint"),
        lambda total, t: total + prefix_matches(t, prefixes, repeats),
    )


def top_terms(terms: Column, repeated: Column, k: int) -> Column:
    """The k most frequent terms of a sorted array; ties in byte order of the term.

    ``repeated`` holds the counts of the terms that occur more than once.  Only if
    these are fewer than k do terms that occur once matter, and of them the first k.
    """
    single = F.filter(
        terms,
        lambda x, i: ~F.equal_null(x, F.get(terms, i - 1)) & ~F.equal_null(x, F.get(terms, i + 1)),
    )
    ranked = F.transform(
        F.slice(
            F.sort_array(
                F.transform(
                    repeated,
                    lambda c: F.struct((-c["tf"]).alias("o"), c["term"].alias("term")),
                )
            ),
            1,
            k,
        ),
        lambda r: r["term"],
    )
    return F.when(F.size(repeated) >= k, ranked).otherwise(
        F.slice(F.concat(ranked, F.slice(single, 1, k)), 1, k)
    )


def text_stats(
    token_array: Column,
    topic_terms: list[str] = vocab.TOPIC_TERMS,
    k: int = vocab.KEYWORDS_PER_PAGE,
) -> Column:
    """Struct of everything the scores need: counts, topic hits, top keywords.

    In the sorted tokens every token equal to its left neighbour is a repeat, so
    the number of distinct terms is the rest, and only repeated terms are counted.
    """

    def stats(terms: Column, repeats: Column) -> Column:
        return F.struct(
            F.size(terms).cast("bigint").alias("n_tokens"),
            (F.size(terms) - F.size(repeats)).cast("bigint").alias("unique_terms"),
            topic_hits(terms, topic_terms).alias("topic_hits"),
            let(count_runs(repeats, extra=1), lambda c: top_terms(terms, c, k)).alias("top_keywords"),
        )

    return let(
        F.sort_array(token_array),
        lambda terms: let(
            F.filter(terms, lambda x, i: F.equal_null(x, F.get(terms, i - 1))),
            lambda repeats: stats(terms, repeats),
        ),
    )


@built_once
def column_stats(text: str, topic_terms: tuple, stop_words: tuple, k: int) -> Column:
    """``text_stats`` of a text column given by name."""
    return text_stats(tokens(F.col(text), stop_words), topic_terms, k)


def share(part: Column, n: Column) -> Column:
    """part / n, at most 1; null when n is 0 (least() alone would skip that null)."""
    return F.when(n != 0, F.least(part.cast("double") / n.cast("double"), F.lit(1.0)))


def tf_ratio(hits: Column, n: Column) -> Column:
    return share(hits, n)


def richness(n: Column) -> Column:
    return F.sqrt(F.least(n.cast("double") / F.lit(RICH_TEXT_TOKENS), F.lit(1.0)))


def diversity(unique: Column, n: Column) -> Column:
    return share(unique, n)


def relevance(n: Column, unique: Column, hits: Column) -> Column:
    """Weighted topic share + length bonus + vocabulary diversity, in [0, 1]."""
    score = (
        tf_ratio(hits, n) * TOPIC_WEIGHT
        + richness(n) * RICHNESS_WEIGHT
        + diversity(unique, n) * DIVERSITY_WEIGHT
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def infer_category(keywords: Column, rules=None, default: str = vocab.DEFAULT_CATEGORY) -> Column:
    """First rule with a signal contained anywhere in the joined keywords."""
    joined = F.lower(F.array_join(keywords, " "))
    label = F.lit(default)
    for name, signals in reversed(vocab.CATEGORY_RULES if rules is None else rules):
        label = F.when(matches_any(joined, signals), F.lit(name)).otherwise(label)
    return label
