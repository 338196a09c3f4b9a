"""Split rows into valid and quarantined ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def first_error(rules: list[Rule]) -> Column:
    """Message of the first rule that does not hold (null counts as failed)."""
    return F.coalesce(
        *[F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)) for holds, message in rules]
    )


def mark_errors(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``message``: null for valid rows."""
    return df.withColumn("message", first_error(rules))


def validate(df: DataFrame, item: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows with ``item`` and ``message``).

    Each row lands on exactly one side.  Tables have no order: carry an ordinal
    column when the order of items matters.
    """
    marked = mark_errors(df, rules)
    valid = marked.filter(F.col("message").isNull()).drop("message")
    failed = marked.filter(F.col("message").isNotNull()).withColumn("item", F.col(item))
    return valid, failed


def error_text(item: Column, message: Column) -> Column:
    return F.format_string("Invalid item: %s - %s", item, message)


def even_integer_rules(item: Column) -> list[Rule]:
    """32-bit integers that are even; no blanks, as the sign and digits only."""
    number = F.when(F.rlike(item, F.lit(r"^[+-]?[0-9]+$")), item.try_cast("int"))
    return [(number.isNotNull(), "Not a number"), (number % 2 == 0, "Odd number")]


def is_html_path(path: Column) -> Column:
    """Extension ``html`` in any letter case; a bare ``.html`` has no extension."""
    return F.rlike(path, F.lit(r"(?i)[^/]\.html$"))
