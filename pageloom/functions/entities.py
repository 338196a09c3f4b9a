"""Entity spans -> entity lists, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions.expr import let

ENTITY_LIST = "array<struct<text:string,kind:string>>"


def kind_of(label: Column) -> Column:
    """Upper-case label, blanks as underscores."""
    return F.translate(F.upper(label), " ", "_")


def merge_entities(first: Column, second: Column, limit: int = vocab.ENTITIES_PER_PAGE) -> Column:
    """Entities of two lists, the first entity of each text, at most ``limit``."""
    both = F.concat(first, F.coalesce(second, F.array().cast(ENTITY_LIST)))
    texts = F.transform(both, lambda e: e["text"])
    return let(F.struct(both.alias("both"), texts.alias("texts")), lambda it: F.slice(
        F.filter(it["both"], lambda e, i: F.array_position(it["texts"], e["text"]) == i + 1), 1, limit)).cast(ENTITY_LIST)


def entity_list(spans: Column, limit: int = vocab.ENTITIES_PER_PAGE) -> Column:
    """First span of each text in span order, at most ``limit``; null -> empty."""
    numbered = F.transform(
        spans,
        lambda s, i: F.struct(s["text"].alias("text"), i.alias("seq"), s["label"].alias("label")),
    )
    firsts = let(
        F.sort_array(numbered),
        lambda s: F.filter(s, lambda e, i: (i == 0) | (e["text"] != F.get(s, i - 1)["text"])),
    )
    ordered = F.slice(
        F.sort_array(
            F.transform(firsts, lambda e: F.struct(e["seq"], e["text"].alias("text"), e["label"].alias("label")))
        ),
        1,
        limit,
    )
    entities = F.transform(
        ordered, lambda e: F.struct(e["text"].alias("text"), kind_of(e["label"]).alias("kind"))
    )
    return F.coalesce(entities.cast(ENTITY_LIST), F.array().cast(ENTITY_LIST))
