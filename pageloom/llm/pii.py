"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  The
method looks at wider candidates as well (numbers written without a plus sign,
account and social security numbers, written-out addresses, titled names).  Regex,
gazetteer and context labelers vote on every candidate or abstain;
expectation-maximisation over the counts of vote patterns estimates what each vote
is worth.  Its posteriors train the final classifier, a logistic regression over the
votes, the kind, and features of the span and of what stands before it.  A candidate
that the classifier accepts becomes a span; base spans stay whatever it says.

Positions are code points, the end is exclusive.  The work per candidate does not
depend on the length of the text or on the number of its candidates.

Edge cases: a null or empty text has no spans; repeated rows are judged one by
one; an empty table gives an empty result; input columns travel in a struct, so
clashing names do no harm.
"""

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.expr import let
from pageloom.llm import weak_labels
from pageloom.llm.shared import stage

# The base kinds in their order and their patterns.  Possessive
# repeats and look-behinds keep them linear; the matches are those of the plain forms
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+
#   phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a pattern to be tried at all.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# Further kinds.
WIDE = {
    "national_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "written_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}[ ]?[(\[]at[)\]][ ]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[(\[]dot[)\]][ ]?)[A-Za-z0-9-]{1,63}){1,8}",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,2}(?![A-Za-z])",
}
WIDE_GATE = r"[0-9][-. ][0-9]{3}|[0-9]-[0-9]{2}-[0-9]|[A-Z]{2}[0-9]{2}|[(\[]at[)\]]|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]"
# The gazetteers.
TOP_LEVEL = ["com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at"]
IBAN_LANDS = ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
CARD_STARTS = ["4", "51", "52", "53", "54", "55", "34", "37", "60", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27"]
CUES = r"(?i)(?:e-?mail|mail|contact|kontakt|phone|tel|call|fax|mobile|handy|card|visa|karte|tarjeta|carte|iban|account|konto|compte|cuenta|ssn|social|security|address|ip|host|client|name|signed|reach)\W{0,3}(?:\w+\W{1,2}){0,2}$"
ANTI_CUES = r"(?i)(?:version|isbn|issn|order|invoice|build|release|chapter|section|figure|page|article|id|sku|serial)\W{0,3}(?:no\W{0,2}|number\W{0,2})?$"
CONTEXT = 40
# Elements of a block of running totals, as a power of two, and characters of a piece of text.
_BLOCK_BITS = 6
_PIECE_BITS = 10
# Weight that pulls the classifier's coefficients to zero, and its rounds.
_RIDGE, _ROUNDS = 0.1, 30


def _running(values: Column, merge: Callable[[Column, Column], Column], zero: Column, levels: int = 2) -> Column:
    """Running totals of an array of integers that has elements and is bound by ``let``.

    A total is that of the blocks before plus some elements of its own block; totals of
    blocks come about in the same way, so the work is about half a block per element.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, lambda total, x: merge(total, x))

    if levels == 0:
        return F.transform(values, lambda _, i: fold(F.slice(values, F.lit(1), i + 1)))
    size = 1 << _BLOCK_BITS
    blocks = F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size(values) - 1, _BLOCK_BITS)),
        lambda b: fold(F.slice(values, b * size + 1, F.lit(size))))

    def total(before: Column, i: Column, b: Column) -> Column:
        return merge(F.coalesce(F.get(before, b - 1), zero), fold(F.slice(values, b * size + 1, i - b * size + 1)))

    return let(blocks, lambda own: let(_running(own, merge, zero, levels - 1), lambda before: F.transform(
        values, lambda _, i: total(before, i, F.shiftright(i, _BLOCK_BITS)))))


def find_spans(text: Column, kind: str, pattern: str, gate: str) -> Column:
    """``array<struct<kind,start,end,value>>`` of the leftmost non-overlapping matches.

    Splitting by the pattern gives what lies between the matches; lengths of pieces
    and matches add up to the positions.
    """
    def located(pieces: Column, values: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(pieces, i)))
        sums = let(steps, lambda bound: _running(bound, lambda a, b: a + b, F.lit(0)))
        return let(sums, lambda ends: F.transform(values, lambda v, i: F.struct(
            F.lit(kind).alias("kind"),
            (F.get(ends, i) - F.length(v)).alias("start"),
            F.get(ends, i).alias("end"),
            v.alias("value"))))

    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(gate), let(values, lambda found: F.when(F.size(found) > 0, let(
        F.split(text, pattern, -1), lambda pieces: located(pieces, found))).otherwise(nothing))).otherwise(nothing)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn check of a string of ASCII digits."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def small_parts(value: Column) -> Column:
    """All parts of a dotted number are at most 255."""
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def valid(kind: Column, value: Column, digits: Column) -> Column:
    """Whether a base match, whose digits are ``digits``, passes the check of its kind."""
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small_parts(value))
        .when(kind == "card", F.when((n >= 13) & (n <= 19), luhn_ok(digits)).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(False)
    )


# Fixed order of the labelers.
LABELERS = ["regex", "gazetteer", "context", "counter_context", "shape"]


def votes(kind: Column, value: Column, digits: Column, before: Column, is_base: Column) -> dict[str, Column]:
    """Labeler -> 1 (personal), 0 (not), -1 (abstain) for one candidate."""
    n = F.length(digits)
    repeated = F.length(F.replace(digits, F.left(digits, F.lit(1)), F.lit(""))) == 0
    last_label = F.lower(F.element_at(F.split(value, r"[.\s\])]+"), -1))
    regex = (
        F.when(is_base, F.lit(1))
        .when(kind == "card", F.lit(0)).when(kind == "ip", F.lit(0))
        .when(kind == "ssn", F.when(value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), 1).otherwise(0))
        .when(kind == "national_phone", F.when(value.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]{0,2}[2-9]"), 1).otherwise(0))
        .when(kind.isin("iban", "name", "written_email"), F.lit(1))
        .otherwise(F.lit(-1))
    )
    gazetteer = (
        F.when(kind.isin("email", "written_email"), F.when(last_label.isin(TOP_LEVEL), 1).otherwise(-1))
        .when(kind == "iban", F.when(F.left(value, F.lit(2)).isin(IBAN_LANDS), 1).otherwise(0))
        .when(kind == "card", F.when(
            F.left(value, F.lit(1)).isin(CARD_STARTS) | F.left(value, F.lit(2)).isin(CARD_STARTS), 1).otherwise(0))
        .otherwise(F.lit(-1))
    )
    shape = (
        F.when(repeated & (n > 0), F.lit(0))
        .when(kind == "card", F.when((n >= 13) & (n <= 19), 1).otherwise(0))
        .when(kind == "ip", F.when(F.length(value) <= 15, 1).otherwise(0))
        .when(kind == "phone", F.when((n >= 9) & (n <= 15), 1).otherwise(0))
        .when(kind == "iban", F.when((n >= 10), 1).otherwise(-1))
        .when(kind.isin("email", "written_email"), F.when(F.length(value) <= 100, 1).otherwise(0))
        .when(kind == "ssn", F.when(n == 9, 1).otherwise(0))
        .when(kind == "national_phone", F.when(n == 10, 1).otherwise(0))
        .otherwise(F.lit(-1))
    )
    return {
        "regex": regex,
        "gazetteer": gazetteer,
        "context": F.when(before.rlike(CUES), F.lit(1)).otherwise(F.lit(-1)),
        "counter_context": F.when(before.rlike(ANTI_CUES), F.lit(0)).otherwise(F.lit(-1)),
        "shape": shape,
    }


# Fixed order of the features; each has few values, so their patterns are bounded.
FEATURES = ["n_digits", "separators", "left"]


def features(value: Column, digits: Column, before: Column) -> dict[str, Column]:
    """Small numbers that describe a candidate and the character before it."""
    n = F.length(digits)
    return {
        "n_digits": F.when(n == 0, 0).when(n < 7, 1).when(n < 10, 2).when(n < 13, 3).when(n < 17, 4).otherwise(5),
        "separators": (
            F.when(~value.rlike(r"[ .()-]"), 0).when(~value.rlike(r"[ .()]"), 1)
            .when(~value.rlike(r"[ ()-]"), 2).when(~value.rlike(r"[.()-]"), 3).otherwise(4)),
        "left": (
            F.when(before.rlike(r"[:=]\s*$"), 1).when(before.rlike(r"(?:^|\s)$"), 0)
            .when(before.rlike(r"[A-Za-z0-9]$"), 2).otherwise(3)),
    }


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes, base kinds first, then by position."""
    found = F.concat(
        *[find_spans(text, kind, pattern, GATES[kind]) for kind, pattern in BASE.items()],
        F.when(text.rlike(WIDE_GATE), F.concat(
            *[find_spans(text, kind, pattern, ".") for kind, pattern in WIDE.items()]
        )).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")),
    )
    size = 1 << _PIECE_BITS

    def before(pieces: Column, start: Column, piece: Column) -> Column:
        """The characters before a place, from its piece of the text and the piece before."""
        near = F.concat(
            F.coalesce(F.substring(F.get(pieces, piece - 1), -CONTEXT, CONTEXT), F.lit("")),
            F.substring(F.get(pieces, piece), F.lit(1), start - piece * size))
        return F.substring(near, -CONTEXT, CONTEXT)

    def judged(span: Column, digits: Column, before: Column, is_base: Column) -> Column:
        voted = votes(span["kind"], span["value"], digits, before, is_base)
        described = features(span["value"], digits, before)
        return F.struct(
            span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            span["value"].alias("value"), is_base.alias("is_base"),
            F.struct(*[voted[name].cast("tinyint").alias(name) for name in LABELERS]).alias("votes"),
            F.struct(*[described[name].cast("tinyint").alias(name) for name in FEATURES]).alias("features"),
        )

    def labelled(pieces: Column, span: Column) -> Column:
        return let(_digits(span["value"]), lambda digits: let(
            F.struct(
                before(pieces, span["start"], F.shiftright(span["start"], _PIECE_BITS)).alias("before"),
                valid(span["kind"], span["value"], digits).alias("is_base")),
            lambda around: judged(span, digits, around["before"], around["is_base"])))

    def all_labelled(spans: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        return let(pieces, lambda bound: F.transform(spans, lambda span: labelled(bound, span)))

    return let(found, lambda spans: F.when(F.size(spans) > 0, all_labelled(spans)))


def _beside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (bound, with elements) that overlap none of the base spans.

    In the order of their starts a span is free if no base span that starts before it, or
    with it, reaches into it and the next base span starts at its end or later.
    """
    far = F.lit(2**31 - 1)
    ordered = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(
            b["start"].alias("start"), F.lit(-1).alias("nth"), b["end"].alias("end"))),
        F.transform(spans, lambda c, i: F.struct(
            c["start"].alias("start"), i.alias("nth"), c["end"].alias("end")))))

    def flags(places: Column, reach: Column, following: Column) -> Column:
        marked = F.transform(places, lambda c, i: F.struct(c["nth"].alias("nth"), (
            (F.get(reach, i) <= c["start"]) & (F.get(following, F.size(places) - 1 - i) >= c["end"])).alias("free")))
        return F.filter(marked, lambda c: c["nth"] >= 0)

    def settled(places: Column) -> Column:
        ends = F.transform(places, lambda c: F.when(c["nth"] < 0, c["end"]).otherwise(F.lit(0)))
        starts = F.reverse(F.transform(places, lambda c: F.when(c["nth"] < 0, c["start"]).otherwise(far)))
        return let(ends, lambda e: let(starts, lambda s: let(
            F.struct(_running(e, F.greatest, F.lit(0)).alias("reach"), _running(s, F.least, far).alias("following")),
            lambda run: F.array_sort(flags(places, run["reach"], run["following"])))))

    return let(let(ordered, settled), lambda free: F.filter(spans, lambda _, i: F.get(free, i)["free"]))


def detect(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the input columns, or those in ``carry``) and ``spans``: ``kind, start, end, value, is_base, p``.

    Base spans come first in the order of their kinds, the others follow with their
    own kinds; an added span never overlaps a base span.
    """
    marked = stage(
        docs.select(F.struct(*(carry or docs.columns)).alias("row"),
                    candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found")),
        "candidates",
    )
    seen = (
        marked.select(F.explode("found").alias("c")).groupBy("c.kind", "c.is_base", "c.votes", "c.features")
        .agg(F.count("*").alias("n")).collect()
    )
    score = classifier([
        (row["kind"], row["is_base"], tuple(row["votes"][name] for name in LABELERS),
         tuple(row["features"][name] for name in FEATURES), row["n"]) for row in seen
    ])
    scored = F.transform(F.col("found"), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
        c["is_base"].alias("is_base"), score(c).alias("p")))

    def accepted(all_: Column) -> Column:
        return let(
            F.struct(F.filter(all_, lambda c: c["is_base"]).alias("base"),
                     F.filter(all_, lambda c: ~c["is_base"] & (c["p"] >= 0.5)).alias("added")),
            lambda parts: F.when((F.size(parts["base"]) == 0) | (F.size(parts["added"]) == 0), F.concat(parts["base"], parts["added"]))
            .otherwise(F.concat(parts["base"], let(parts["added"], lambda added: _beside(added, parts["base"])))))

    kind_of = "array<struct<kind:string,start:int,end:int,value:string,is_base:boolean,p:double>>"
    return marked.select("row", F.coalesce(let(scored, accepted), F.array().cast(kind_of)).alias("spans"))


def classifier(counts: list[tuple[str, bool, tuple[int, ...], tuple[int, ...], int]]):
    """A column function giving the probability that a candidate is personal data.

    ``counts`` has a row per kind, base check, votes and features, so it is bounded by
    the number of kinds times 3 to the number of labelers times the values of the features.
    The labelers' weights come from expectation-maximisation over all kinds, with base spans known
    to be personal; a logistic regression over kind, votes and features is fitted to the posteriors.
    """
    patterns: dict[tuple[tuple[int, ...], bool], int] = {}
    for _, is_base, vote, _, n in counts:
        patterns[vote, is_base] = patterns.get((vote, is_base), 0) + n
    ordered = sorted(patterns.items())
    prior, steps = weak_labels.fit(
        [(vote, n) for (vote, _), n in ordered], len(LABELERS), start=(-0.5, 1.0, -1.5),
        known=[is_base for (_, is_base), _ in ordered])
    targets = [
        1.0 if is_base else 1 / (1 + math.exp(-max(-500.0, min(500.0, weak_labels.log_odds(vote, prior, steps)))))
        for _, is_base, vote, _, _ in counts
    ]
    names = [
        [("kind", kind), *zip(LABELERS, vote), *zip(FEATURES, described)] for kind, _, vote, described, _ in counts
    ]
    weights = _logistic(names, targets, [n for *_, n in counts])

    def worth(name: str, value: Column) -> Column:
        """The coefficient of a value; one that was not seen adds nothing."""
        found = F.lit(0.0)
        for (owner, seen), weight in sorted(weights.items(), key=str):
            if owner == name:
                found = F.when(value == F.lit(seen), F.lit(weight)).otherwise(found)
        return found

    def score(candidate: Column) -> Column:
        odds = F.lit(weights.get(("", ""), 0.0)) + worth("kind", candidate["kind"])
        for name in LABELERS:
            odds = odds + worth(name, candidate["votes"][name])
        for name in FEATURES:
            odds = odds + worth(name, candidate["features"][name])
        return 1 / (1 + F.exp(-odds))

    return score


def _logistic(names: list[list[tuple]], targets: list[float], counts: list[int]) -> dict[tuple, float]:
    """Coefficient per (feature, value), and ("", "") for the constant, by Newton steps.

    ``targets`` are probabilities; a row counts as often as ``counts`` says.
    """
    if not names:
        return {}
    columns = {name: at for at, name in enumerate(sorted({name for row in names for name in row} | {("", "")}, key=str))}
    shown = np.zeros((len(names), len(columns)))
    shown[:, columns["", ""]] = 1.0
    for row, found in enumerate(names):
        shown[row, [columns[name] for name in found]] = 1.0
    target, count = np.array(targets), np.array(counts, float)
    pull = np.full(len(columns), _RIDGE)
    weights = np.zeros(len(columns))

    def loss(at: np.ndarray) -> float:
        odds = shown @ at
        return float((count * (np.logaddexp(0, odds) - target * odds)).sum() + (pull * at * at).sum() / 2)

    for _ in range(_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(shown @ weights, -500, 500)))
        slope = shown.T @ (count * (p - target)) + pull * weights
        step = np.linalg.solve((shown * (count * p * (1 - p))[:, None]).T @ shown + np.diag(pull), slope)
        size = 1.0
        while size > 1e-6 and loss(weights - size * step) > loss(weights):
            size /= 2
        weights = weights - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return {name: float(weights[at]) for name, at in columns.items()}


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in angle brackets."""
    found = detect(docs)
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def replace(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        return F.when(fresh, F.struct(
            F.concat(done["text"], F.substring(F.col("row.text"), done["at"] + 1, span["start"] - done["at"]),
                     F.lit("<"), span["kind"], F.lit(">")).alias("text"),
            span["end"].alias("at"))).otherwise(done)

    text = F.aggregate(
        ordered, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), replace,
        lambda done: F.concat(done["text"], F.substring(F.col("row.text"), done["at"] + 1, F.length(F.col("row.text")))))
    return found.select(*[
        (text if name == "text" else F.col(f"row.{name}")).alias(name) for name in docs.columns
    ])
