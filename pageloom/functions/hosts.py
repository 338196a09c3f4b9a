"""Normal form of host names, after the public URL Standard.

Most hosts are plain: ASCII letters, digits and punctuation that need no more than lower
case.  ``urls`` settles those with column functions.  The others - percent-encoded and
international names, numeric addresses, bracketed addresses - go through the Arrow function
of this module, a short list per row and usually an empty one, and come back as a map from
the host as written to its normal form.

International names follow UTS #46 without transitional processing.  Its mapping table is
rebuilt from rules: compatibility composition and case folding, but for four deviating
characters; what may stand in a name is decided by character category.  Names that mix
directions are held to the bidi rule; joiners need a virama before them.
"""

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the URL Standard and of UTS #46.
FORBIDDEN = re.compile(r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7f]")
_ALLOWED_AFTER_ALL = re.compile(r"[\"`{}]")
IGNORED = re.compile("[­͏᠋-᠍᠏​⁠⁤︀-️﻿\U000e0100-\U000e01ef]")
STOPS = re.compile("[。．｡]")
JOINERS = "‌‍"
DEVIATING = {"ß": "ß", "ς": "ς", "ẞ": "ß", "‌": "‌", "‍": "‍"}
DISALLOWED = {"Cc", "Cf", "Cs", "Co", "Cn", "Zs", "Zl", "Zp"}
DISALLOWED_SYMBOLS = re.compile("[⿰-⿿￼�]")
VIRAMA = 9
_MEMO = 100_000


def _mapped(text: str) -> str:
    """Mapping step of UTS #46."""
    def one(c: str) -> str:
        if c in DEVIATING:
            return DEVIATING[c]
        return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())

    kept = IGNORED.sub("", STOPS.sub(".", text))
    return unicodedata.normalize("NFC", STOPS.sub(".", "".join(map(one, kept))))


def _valid_label(label: str) -> bool:
    """Validity of a mapped label."""
    if not label:
        return True
    if unicodedata.category(label[0]).startswith("M") or unicodedata.normalize("NFC", label) != label:
        return False
    for i, c in enumerate(label):
        if c in JOINERS:
            if not i or unicodedata.combining(label[i - 1]) != VIRAMA:
                return False
        elif (unicodedata.category(c) in DISALLOWED and not c.isascii()) or DISALLOWED_SYMBOLS.match(c):
            return False
    return True


def _bidi_ok(label: str) -> bool:
    """The bidi rule for a label of a name that has right-to-left characters."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    if not kinds:
        return True
    last = next((k for k in reversed(kinds) if k != "NSM"), "")
    if kinds[0] in ("R", "AL"):
        allowed = {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
        return set(kinds) <= allowed and last in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    if kinds[0] != "L":
        return False
    return set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and last in ("L", "EN")


def ascii_name(name: str) -> str | None:
    """A domain name in ASCII, None if it is not one."""
    if name.isascii() and not re.search(r"(^|\.)xn--", name, re.I):
        return name.lower()
    labels, decoded = [], []
    for label in _mapped(name).split("."):
        if label.startswith("xn--"):
            try:
                plain = label[4:].encode("ascii").decode("punycode")
                again = plain.encode("punycode").decode("ascii")
            except (UnicodeError, ValueError, OverflowError):
                return None
            if plain.isascii() or again != label[4:] or _mapped(plain) != plain or "." in plain:
                return None
        else:
            plain = label
        if not _valid_label(plain):
            return None
        decoded.append(plain)
        labels.append(plain if plain.isascii() else "xn--" + plain.encode("punycode").decode("ascii"))
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in "".join(decoded)):
        if not all(map(_bidi_ok, decoded)):
            return None
    return ".".join(labels)


def _number(part: str) -> int | None:
    """A part of a numeric address: decimal, octal after 0, hexadecimal after 0x."""
    if re.fullmatch(r"0[xX][0-9a-fA-F]*", part):
        return int(part[2:] or "0", 16)
    if re.fullmatch(r"0[0-7]*", part):
        return int(part, 8)
    return int(part) if re.fullmatch(r"[1-9][0-9]*", part) else None


def _ends_in_number(host: str) -> bool:
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    return bool(re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]))


def ipv4(host: str) -> str | None:
    """Dotted form of a numeric address of one to four parts."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    numbers = [_number(part) if len(part) <= 64 else None for part in parts]
    if len(parts) > 4 or None in numbers:
        return None
    *high, low = numbers
    if any(n > 255 for n in high) or low >= 256 ** (5 - len(numbers)):
        return None
    value = low + sum(n << 8 * (3 - i) for i, n in enumerate(high))
    return ".".join(str(value >> shift & 255) for shift in (24, 16, 8, 0))


def ipv6(text: str) -> str | None:
    """Shortest form of an address in colons, without its brackets."""
    head, gap, tail = text.partition("::")
    if "::" in tail or (gap and (tail.startswith(":") or head.endswith(":"))):
        return None
    groups = []
    for side in (head, tail):
        pieces = side.split(":") if side else []
        if pieces and "." in pieces[-1] and (side is tail or not gap):
            octets = pieces.pop().split(".")
            if len(octets) != 4 or not all(re.fullmatch(r"0|[1-9][0-9]{0,2}", o) and int(o) <= 255 for o in octets):
                return None
            a, b, c, d = map(int, octets)
            pieces += [f"{a << 8 | b:x}", f"{c << 8 | d:x}"]
        if not all(re.fullmatch(r"[0-9a-fA-F]{1,4}", piece) for piece in pieces):
            return None
        groups.append([int(piece, 16) for piece in pieces])
    missing = 8 - sum(map(len, groups))
    if missing < (1 if gap else 0) or (not gap and missing):
        return None
    whole = groups[0] + [0] * missing + groups[1]
    runs = [(len(run[0]), -run.start()) for run in re.finditer("0+", "".join("0" if g == 0 else "1" for g in whole))]
    longest, start = max(runs, default=(0, 0))
    if longest < 2:
        return ":".join(f"{g:x}" for g in whole)
    at = -start
    return ":".join(f"{g:x}" for g in whole[:at]) + "::" + ":".join(f"{g:x}" for g in whole[at + longest:])


@functools.lru_cache(_MEMO)
def normal_host(host: str) -> str | None:
    """Normal form of a host as written in a URL of a special scheme, None if it is invalid."""
    if host.startswith("["):
        address = ipv6(host[1:-1]) if host.endswith("]") else None
        return None if address is None else f"[{address}]"
    name = ascii_name(unquote_to_bytes(host).decode("utf-8", "replace"))
    if not name or FORBIDDEN.search(_ALLOWED_AFTER_ALL.sub("", name)):
        return None
    return ipv4(name) if _ends_in_number(name) else name


def _forms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Lists of hosts -> maps from each to its normal form; invalid hosts are left out."""
    kind = pa.map_(pa.string(), pa.string())
    for batch in batches:
        rows = []
        for hosts in batch.to_pylist():
            found = {host: normal_host(host) for host in hosts or () if host is not None}
            rows.append([(host, form) for host, form in found.items() if form is not None])
        yield pa.array(rows, kind)


_forms.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def host_forms(hosts: Column) -> Column:
    """Map from each host of an array to its normal form; not for use inside a lambda.

    Declared as non-deterministic, which keeps Catalyst from merging projections: a function
    of a resolved url would then hold two Python functions that feed each other.
    """
    return F.arrow_udf(_forms, T.MapType(T.StringType(), T.StringType())).asNondeterministic()(hosts)


# Task code travels with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
