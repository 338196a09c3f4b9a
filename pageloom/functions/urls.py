"""URL resolution, normal form and link scoring as column expressions.

Follows the public URL Standard for the "special" schemes (http, https, ws, wss,
ftp) with dot segments, backslashes, default ports and percent-encoding; hosts get
their normal form (``hosts``).  Other schemes (mailto:, javascript:, ...) give null.

Odd hosts need a Python function, which cannot run inside a lambda.  Functions that are
used there take the map ``hosts`` of the normal forms, made outside by ``forms_of``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions.expr import count_contained, let
from pageloom.functions.hosts import host_forms

# Parts of the URL Standard.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:([^/\\?#]*)@)?(\[[^\]/\\?#]*\]|[^:/\\?#]*)(?::([^/\\?#]*))?"
# a host that needs more than lower case: other characters, an encoded label, a number at the end
ODD_HOST = r"(?i)[^a-z0-9._~!$&'()*+,;=\-]|(^|\.)xn--|(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"
HOST_AS_WRITTEN = r"(?i)^(?:(?:https?|wss?|ftp):[/\\]*|[/\\]{2,})(?:[^/\\?#]*@)?(\[[^\]/\\?#]*\]|[^:/\\?#]*)"
PATH_SAFE = r"[!#-;=?-_a-z|~]"
PATH_UNSAFE = r"[^!#-;=?-_a-z|~]"
DOT_SEGMENT = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"

# Link score in hundredths.
BASE_SCORE, URL_SIGNAL, ANCHOR_SIGNAL, DATE_STAMP, ARTICLE_DEPTH, NOISE = 40, 8, 4, 15, 10, 20


def _encode_path(path: Column) -> Column:
    """Percent-encode what a path may not contain, run by run."""
    runs = F.regexp_extract_all(path, F.lit(f"{PATH_SAFE}+|{PATH_UNSAFE}+"), F.lit(0))
    encoded = F.array_join(
        F.transform(
            runs,
            lambda run: F.when(F.rlike(run, F.lit(PATH_SAFE)), run).otherwise(
                F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))
            ),
        ),
        "",
    )
    return F.when(F.rlike(path, F.lit(PATH_UNSAFE)), encoded).otherwise(path)


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path that starts with a slash."""
    # a trailing dot segment leaves an empty last segment behind
    closed = F.regexp_replace(path, r"(?i)/((?:\.|%2e){1,2})$", "/$1/")
    segments = F.split(F.substr(closed, F.lit(2)), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, segment: F.when(
            F.rlike(segment, F.lit(r"(?i)^(\.|%2e){2}$")),
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .when(F.rlike(segment, F.lit(r"(?i)^(\.|%2e)$")), done)
        .otherwise(F.concat(done, F.array(segment))),
    )
    return F.when(
        F.rlike(path, F.lit(DOT_SEGMENT)), F.concat(F.lit("/"), F.array_join(kept, "/"))
    ).otherwise(path)


def _normal_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    rooted = F.when(F.startswith(slashed, F.lit("/")), slashed).otherwise(
        F.concat(F.lit("/"), slashed)
    )
    return let(let(rooted, _remove_dots), _encode_path)


def _clean(url: Column) -> Column:
    """Strip control characters and blanks around, tabs and newlines inside."""
    stripped = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.translate(stripped, "\t\n\r", "")


def _tail(text: Column) -> tuple[Column, Column, Column]:
    """Path, ``?query`` and ``#fragment`` of what follows the authority."""
    path = F.regexp_extract(text, r"^([^?#]*)", 1)
    query = F.regexp_extract(text, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(text, r"(#.*)$", 1)
    return path, query, fragment


def _parts(scheme, authority, path, query, fragment) -> Column:
    return F.struct(
        scheme.alias("scheme"),
        authority.alias("authority"),
        path.alias("path"),
        query.alias("query"),
        fragment.alias("fragment"),
    )


def odd_host(url: Column) -> Column:
    """The host of an absolute or scheme-relative reference if it is odd, else null."""
    host = F.regexp_extract(_clean(url), HOST_AS_WRITTEN, 1)
    return F.when(F.rlike(host, F.lit(ODD_HOST)), host)


def forms_of(*references: Column) -> Column:
    """Normal forms of the odd hosts of some references; not for use inside a lambda."""
    return host_forms(F.array_compact(F.array(*map(odd_host, references))))


def _authority(scheme: Column, rest: Column, hosts: Column) -> Column:
    """``[user@]host[:port]`` in normal form, null when not a valid host."""

    def build(written: Column) -> Column:
        user = F.regexp_extract(rest, AUTHORITY, 1)
        host = F.when(F.rlike(written, F.lit(ODD_HOST)), F.try_element_at(hosts, written)).otherwise(F.lower(written))
        port = F.regexp_replace(F.regexp_extract(rest, AUTHORITY, 3), "^0+(?=[0-9])", "")
        is_default = F.concat(scheme, F.lit(":"), port).isin(
            [f"{name}:{number}" for name, number in DEFAULT_PORTS.items()]
        )
        valid_port = (port == "") | (
            F.rlike(port, F.lit("^[0-9]{1,5}$")) & (port.try_cast("int") <= 65535)
        )
        return F.when(
            (written != "") & valid_port,
            F.concat(
                F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""),
                host,
                F.when((port == "") | is_default, "").otherwise(F.concat(F.lit(":"), port)),
            ),
        )

    return let(F.regexp_extract(rest, AUTHORITY, 2), build)


def _absolute(scheme: Column, rest: Column, hosts: Column) -> Column:
    """Parts of a URL given what follows ``scheme:``; null when invalid."""

    def build(after: Column) -> Column:
        path, query, fragment = _tail(F.regexp_replace(after, AUTHORITY, ""))
        return let(_authority(scheme, after, hosts), lambda authority: F.when(
            authority.isNotNull(), _parts(scheme, authority, _normal_path(path), query, fragment)
        ))

    return let(F.regexp_replace(rest, r"^[/\\]*", ""), build)


def url_parts(url: Column, hosts: Column | None = None) -> Column:
    """Struct of an absolute URL in normal form, null if it is not one."""
    if hosts is None:  # a Python function's value enters lambdas as their argument only
        given = F.struct(url.alias("url"), forms_of(url).alias("hosts"))
        return let(given, lambda it: url_parts(it["url"], it["hosts"]))

    def parse(text: Column) -> Column:
        scheme = F.lower(F.regexp_extract(text, SCHEME, 1))
        return F.when(
            scheme.isin(list(DEFAULT_PORTS)),
            _absolute(scheme, F.regexp_replace(text, SCHEME, ""), hosts),
        )

    return let(_clean(url), parse)


def join_parts(base: Column, href: Column, hosts: Column) -> Column:
    """Parts of ``href`` seen from a page whose ``url_parts`` are ``base``."""

    def relative(text: Column) -> Column:
        path, query, fragment = _tail(text)
        folder = F.regexp_replace(base["path"], "[^/]*$", "")
        from_root = F.rlike(path, F.lit(r"^[/\\]"))
        full = F.when(from_root, path).otherwise(F.concat(folder, path))
        return F.when(
            path != "",
            _parts(base["scheme"], base["authority"], _normal_path(full), query, fragment),
        ).otherwise(
            _parts(
                base["scheme"],
                base["authority"],
                base["path"],
                F.when(query != "", query).otherwise(base["query"]),
                fragment,
            )
        )

    def parse(text: Column) -> Column:
        own_scheme = F.lower(F.regexp_extract(text, SCHEME, 1))
        scheme = F.when(own_scheme == "", base["scheme"]).otherwise(own_scheme)
        return let(
            F.struct(scheme.alias("scheme"), F.regexp_replace(text, SCHEME, "").alias("rest")),
            lambda ref: F.when(
                (ref["scheme"] == base["scheme"]) & ~F.rlike(ref["rest"], F.lit(r"^[/\\]{2}")),
                relative(ref["rest"]),
            ).when(ref["scheme"].isin(list(DEFAULT_PORTS)), _absolute(ref["scheme"], ref["rest"], hosts)),
        )

    return F.when(base.isNotNull(), let(_clean(href), parse))


def format_parts(parts: Column, canonical: bool = False) -> Column:
    """URL text of parts; ``canonical`` leaves out query and fragment."""
    fields = [parts["scheme"], F.lit("://"), parts["authority"], parts["path"]]
    if not canonical:
        fields += [parts["query"], parts["fragment"]]
    return F.concat(*fields)


def host_of(parts: Column) -> Column:
    """Host without user and port."""
    return F.regexp_replace(parts["authority"], r"^.*@|:[0-9]*$", "")


def resolve_url(base_url: Column, href: Column, canonical: bool = False) -> Column:
    """Absolute URL of ``href`` on the page ``base_url``; null if unusable.

    ``canonical`` leaves out query and fragment.  To go on from the result with another
    function of this module, select it under a name first: one expression cannot hold
    two Python functions that feed each other through lambdas.
    """
    given = F.struct(base_url.alias("base"), href.alias("href"), forms_of(base_url, href).alias("hosts"))
    return let(given, lambda it: let(
        url_parts(it["base"], it["hosts"]),
        lambda base: let(join_parts(base, it["href"], it["hosts"]), lambda parts: format_parts(parts, canonical)),
    ))


def canonical_url(url: Column) -> Column:
    """Normal form without query and fragment; null if not an absolute URL."""
    return let(url_parts(url), lambda parts: format_parts(parts, canonical=True))


def host(url: Column) -> Column:
    return let(url_parts(url), host_of)


def path_depth(canonical: Column) -> Column:
    """Number of non-empty path segments."""
    path = F.regexp_replace(canonical, r"^[a-z]+://[^/]*", "")
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def link_score(
    canonical: Column,
    anchor: Column,
    article_signals: list[str] = vocab.ARTICLE_SIGNALS,
    noise_signals: list[str] = vocab.NOISE_SIGNALS,
) -> Column:
    """Link priority in hundredths, 0..100; integers keep equal sums equal."""

    def score(it: Column) -> Column:
        url, depth = it["url"], it["depth"]
        dated = F.contains(url, F.lit("/202")) | F.contains(url, F.lit("/201"))
        total = (
            F.lit(BASE_SCORE)
            + count_contained(url, article_signals) * URL_SIGNAL
            + count_contained(it["anchor"], article_signals) * ANCHOR_SIGNAL
            + F.when(dated, DATE_STAMP).otherwise(0)
            + F.when(depth.between(3, 6), ARTICLE_DEPTH).otherwise(0)
            - count_contained(url, noise_signals) * NOISE
        )
        return F.greatest(F.lit(0), F.least(F.lit(100), total))

    given = F.struct(
        F.lower(canonical).alias("url"), F.lower(anchor).alias("anchor"), path_depth(canonical).alias("depth"))
    return let(given, score)


def link_priority(canonical: Column, anchor: Column, **signals) -> Column:
    """Link priority in [0, 1]."""
    return link_score(canonical, anchor, **signals).cast("double") / 100.0
