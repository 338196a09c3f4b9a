"""Small building blocks shared by all column functions."""

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the Unicode White_Space characters.  Spark's plain trim() only
# knows the ASCII blank.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines a projected column into the expressions above it.  When the
    column is used inside a lambda that would re-evaluate it per array element,
    so values used more than once are bound to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def blank_to_null(text: Column) -> Column:
    """Empty text becomes null; ``text`` is evaluated once (nullif does it twice)."""
    return let(text, lambda t: F.when(t != "", t))


def add_struct(df: DataFrame, columns: list, value: Column) -> DataFrame:
    """``columns`` plus the fields of the struct ``value``, one row per row.

    The struct goes through a one-element generator.  Filters on its fields stay
    above the generator, so a costly struct is computed once per row instead of
    once in the pushed-down filter and again in the projection.
    """
    return df.select(*columns, F.inline_outer(F.array(value)))


def explode_structs(df: DataFrame, columns: list, structs: Column, required: str) -> DataFrame:
    """One row per element of an array of structs.

    The outer generator keeps Catalyst from deriving a ``size(array) > 0`` filter
    below it, which would build the array twice; the filter on a field that is
    never null drops the placeholder rows of empty arrays.
    """
    return df.select(*columns, F.inline_outer(structs)).filter(F.col(required).isNotNull())


def matches_any(text: Column, needles: list[str]) -> Column:
    """True when ``text`` contains at least one of ``needles``."""
    return count_contained(text, needles) > 0


def count_contained(text: Column, needles: list[str]) -> Column:
    """How many of ``needles`` occur in ``text``, each counted once."""
    if not needles:
        return F.lit(0)
    # folded to one array literal; far fewer driver calls than a term per needle
    words = F.split(F.lit("\n".join(needles)), "\n")
    return F.size(F.filter(words, lambda needle: F.contains(text, needle)))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the columns a function builds from names and other plain values.

    A column is only a description, so it can be used again in the same session;
    building a long one takes thousands of calls from Python to the driver JVM.
    """
    kept = {}

    @functools.wraps(build)
    def lookup(*args, **kwargs) -> Column:
        key = (id(SparkContext._active_spark_context), args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = build(*args, **kwargs)
        return kept[key]

    return lookup
