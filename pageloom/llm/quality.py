"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good, votes bad or abstains.  Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of rules, so a bounded table)
estimates how reliable each rule is, and the posterior probability of "good"
decides instead of a rule that all must pass.  Two base rules still reject alone.

Edge cases: a null or empty text has no words and fails the base rule; repeated rows
are judged one by one; an empty table gives an empty result.  Input columns are
carried in a struct, so names that clash with the features do no harm.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.expr import add_struct, let
from pageloom.llm import weak_labels
from pageloom.llm.shared import stage

# White space that separates words, and the counted symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
KEEP_FROM = 0.5
# Up to so many repeated hashes are looked up in a list; the result is the same.
_FEW = 64


def words(text: Column) -> Column:
    """The runs of characters that are not ASCII white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, r"[\x20\x09-\x0D]+")))


def repeat_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more.

    Windows are compared by a 64-bit hash inside one text.  The hashes that repeat are
    found by sorting; where they are few, their places are looked up in that short
    list, else (same result) by sorting hashes together with their places.
    """
    last = F.size(tokens) - width
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(tokens, i + d) for d in range(width)]),
    )

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(
            places, lambda i: F.sequence(i, i + width - 1)))))

    def looked_up(hashes: Column, repeated: Column) -> Column:
        return F.filter(
            F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull()
        )

    def sorted_out(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.filter(F.transform(s, lambda x, j: F.when(
            (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull()))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        repeated = let(ordered, lambda s: F.array_distinct(F.filter(s, lambda h, i: F.get(s, i - 1) == h)))
        return let(repeated, lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(covered(
            F.when(F.size(r) <= _FEW, looked_up(hashes, r)).otherwise(sorted_out(hashes)))))

    return F.when(last < 0, F.lit(0)).otherwise(let(windows, count))


def word_features(text: Column) -> Column:
    """Struct of the counts over words; null text counts as empty."""
    return let(words(text), lambda tokens: F.struct(
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        repeat_words(tokens).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"),
    ))


def line_features(text: Column) -> Column:
    """Struct of the counts over lines and characters; null text counts as empty."""
    filled = F.coalesce(text, F.lit(""))
    # \s is exactly the ASCII white space here; what is left are neither blanks nor letters
    others = F.regexp_replace(filled, r"[\p{L}\s]+", "")
    lines = F.filter(F.split(filled, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")

    def ended(line: Column) -> Column:
        return F.right(F.rtrim(line), F.lit(1)).isin(".", "!", "?")

    return let(others, lambda rest: let(lines, lambda rows: F.struct(
        (F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        F.size(rows).cast("long").alias("n_lines"),
        F.length(rest).cast("long").alias("n_others"),
        F.size(F.filter(rows, ended)).cast("long").alias("n_ended"),
    )))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(0))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(-1))


def rules() -> dict[str, Column]:
    """Rule name -> vote (1 good, 0 bad, -1 abstain) over the feature columns.

    A rule that looks for one defect abstains where it finds none; a rule that looks
    for prose votes good where it finds it.
    """
    letters = 1 - _share("n_others", "word_chars")
    mean_length = _share("word_chars", "n_words")
    variety = F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    ended = _share("n_ended", "n_lines")
    return {
        "symbols": _vote(_share("n_symbols", "n_words") > 0.1),
        "letters": _vote(letters < 0.8, letters >= 0.92),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.25),
        "lines": _vote((F.col("n_lines") >= 3) & (_share("n_dup_lines", "n_lines") > 0.3)),
        "length": _vote((mean_length < 2.5) | (mean_length > 9), (mean_length >= 3.5) & (mean_length <= 7)),
        "variety": _vote(variety < 3, variety >= 5),
        "sentences": _vote((F.col("n_lines") >= 3) & (ended < 0.2), ended >= 0.6),
    }


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input columns, or those in ``carry``), the features, ``p_good``, ``base_failed``, ``kept``.

    Features are computed once and written with the rows; the vote counts, the only
    thing that meets on the driver, have at most 3 ** 7 rows.
    """
    votes = rules()
    row = F.struct(*(carry or docs.columns)).alias("row")
    # two structs: bound inside each other, their lambdas run at half the speed
    counted = add_struct(docs, [row, F.col("text").alias("_text")], word_features(F.col("text")))
    measured = add_struct(counted, ["*"], line_features(F.col("_text"))).drop("_text")
    voted = stage(
        measured.select("*", *[vote.cast("tinyint").alias(f"vote_{name}") for name, vote in votes.items()]),
        "quality",
    )
    names = [f"vote_{name}" for name in votes]
    met = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(row[name] for name in names), row["n"]) for row in met)
    prior, steps = weak_labels.fit(patterns, len(names))
    odds = F.lit(prior)
    for name, step in zip(names, steps):
        odds = odds + F.when(F.col(name) == 1, step[1]).when(F.col(name) == 0, step[0]).otherwise(step[-1])
    return (
        voted.withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judge(docs).filter("kept").select("row.*")
