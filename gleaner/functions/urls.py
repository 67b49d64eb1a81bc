"""URL parts and reference resolution (RFC 3986) as column expressions.

``parse_url`` goes through ``java.net.URI`` and rejects many URLs found in real pages (blanks,
non-ASCII paths), so the generic URI grammar of the RFC is used instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.common import blank_to_null, col, let

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_PREFIX = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), _SCHEME, 1))


def netloc(url: Column | str) -> Column:
    """Authority with port, '' if there is none."""
    return F.regexp_extract(col(url), _PREFIX + r"//([^/?#]*)", 1)


def domain(url: Column | str, default: str = "unknown") -> Column:
    return F.coalesce(blank_to_null(netloc(url)), F.lit(default))


def same_domain(a: Column | str, b: Column | str) -> Column:
    return netloc(a) == netloc(b)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _PREFIX + r"(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"#(.*)$", 1)


def path_and_query(url: Column | str) -> Column:
    """What a robots rule is matched against; '/' for an empty path."""
    p, q = path(url), query(url)
    return F.concat(F.when(p == "", "/").otherwise(p), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def _remove_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments. Runs only on paths that have any."""
    segments = F.split(p, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    closed = F.when(p.rlike(r"(?:^|/)\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)
    # more ".." than folders also removes the root
    return F.when(closed.startswith("/"), closed).otherwise(F.concat(F.lit("/"), closed))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` seen on the page ``base``."""
    # bound once: every part of the result looks at the reference
    return let(col(href), lambda h: _resolve(col(base), h))


def _resolve(base: Column, href: Column) -> Column:
    b_scheme, b_auth, b_path, b_query = scheme(base), netloc(base), path(base), query(base)
    h_scheme, h_path, h_query, h_frag = scheme(href), path(href), query(href), fragment(href)
    has_auth = href.rlike(_PREFIX + "//")

    folder = F.regexp_extract(b_path, r"^(.*)/[^/]*$", 1)
    directory = F.regexp_replace(F.regexp_replace(folder, r"/{2,}", "/"), "/$", "")
    merged = (
        F.when(h_path == "", b_path)
        .when(h_path.startswith("/"), h_path)
        .otherwise(F.concat(directory, F.lit("/"), F.regexp_replace(h_path, r"/{2,}", "/")))
    )
    full_path = let(
        merged,
        lambda p: F.when((h_path != "") & p.rlike(r"(?:^|/)\.\.?(?:/|$)"), _remove_dots(p))
        .when((h_path != "") & (p == ""), "/")
        .otherwise(p),
    )
    full_query = F.when((h_path == "") & (h_query == ""), b_query).otherwise(h_query)
    tail = F.concat(
        F.when(full_query == "", "").otherwise(F.concat(F.lit("?"), full_query)),
        F.when(h_frag == "", "").otherwise(F.concat(F.lit("#"), h_frag)),
    )
    origin = F.concat(b_scheme, F.lit("://"), b_auth)
    return (
        F.when(href == "", base)
        .when((h_scheme != "") & (h_scheme != b_scheme), href)
        .when(has_auth, F.concat(b_scheme, F.lit("://"), netloc(href), h_path, tail))
        .otherwise(F.concat(origin, full_path, tail))
    )
