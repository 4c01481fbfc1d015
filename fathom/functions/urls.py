"""URL expressions. Patterns avoid look-around, possessive loops and nested loops, and read alike in Java and RE2."""

from __future__ import annotations

import mimetypes
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986, appendix B: scheme, authority, path, query, fragment.
URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
SITE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
ESCAPE = "%[0-9A-Fa-f]{2}"
_CHARS = r"A-Za-z0-9\-._~!$&'()*+,;="
VALID = (
    rf"^[A-Za-z][A-Za-z0-9+.\-]*:(?://(?:[{_CHARS}:]*@)?(?:\[[0-9A-Fa-f:.]+\]|[{_CHARS}]*)(?::[0-9]*)?"
    rf"(?:/[{_CHARS}:@/]*)?|/?[{_CHARS}:@][{_CHARS}:@/]*|/)?(?:\?[{_CHARS}:@/?]*)?(?:#[{_CHARS}:@/?]*)?$"
)
# Scheme, then slashes, user part, host, port.
HOST_PORT = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]*(?:[^/?#\\@]*@)?(\[[^\]/?#]*\]|[^/?#:\\@]*)(?::([0-9]*))?(?:[/?#\\].*)?$"
SUBMITTABLE = r"^https?://.+\.[a-zA-Z]+$"
# Schemes whose origin is host and port, with their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
PLAIN = r"[\x21-\x7E]"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def site(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, SITE, 0)


def is_root(url: Column) -> Column:
    return path(url).isin("", "/")


def is_valid_url(url: Column) -> Column:
    """RFC 3986 validity. Escapes stand for one unreserved character, which keeps the pattern free of nested loops."""
    return F.coalesce(F.regexp_replace(url, ESCAPE, "~").rlike(VALID), F.lit(False))


def escape_url(url: Column) -> Column:
    """Percent-encode everything outside printable ASCII."""
    runs = F.regexp_extract_all(url, F.lit(f"{PLAIN}+|[^\\x21-\\x7E]+"), F.lit(0))
    encoded = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^{PLAIN}"), r).otherwise(
        F.replace(F.url_encode(r), F.lit("+"), F.lit("%20")))), "")
    return F.when(url.rlike(r"[^\x21-\x7E]"), encoded).otherwise(url)


def _sorted_query(query: Column) -> Column:
    def pair(arg: Column) -> Column:
        at = F.locate("=", arg)
        return F.struct(
            F.when(at > 0, F.substring(arg, F.lit(1), at - 1)).otherwise(arg).alias("k"),
            F.when(at > 0, F.substring(arg, at + 1, F.length(arg))).otherwise("").alias("v"))

    args = F.filter(F.split(query, "&"), lambda a: a != "")
    pairs = F.sort_array(F.transform(args, pair))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def canonical_url(url: Column) -> Column:
    """Normal form: lower-case scheme and authority, sorted query arguments, no fragment, at least the path ``/``.

    A URL without authority (``mailto:a@b``) has no slashes and no such path.
    """
    url = escape_url(url)
    auth, query = netloc(url), _part(url, 4)
    placed = url.rlike("^[^:/?#]+://")
    where = F.when(placed & (path(url) == ""), "/").otherwise(path(url))
    tail = F.when(query == "", "").otherwise(F.concat(F.lit("?"), _sorted_query(query)))
    start = F.when(placed, F.lit("://")).when(scheme(url) == "", "").otherwise(":")
    return F.concat(scheme(url), start, F.lower(auth), where, tail)


def url_origin(url: Column) -> Column:
    """scheme://host[:port] without a default port; ``null`` as text for schemes without an origin, NULL if unparsable."""
    kind = F.lower(F.regexp_extract(F.trim(url), SCHEME, 1))
    host = F.lower(F.regexp_extract(F.trim(url), HOST_PORT, 1))
    port = F.regexp_extract(F.trim(url), HOST_PORT, 2)
    default = F.lit("")
    for name, number in DEFAULT_PORTS.items():
        default = F.when(kind == name, number).otherwise(default)
    shown = F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(kind == "", F.lit(None).cast("string")).when(~kind.isin(*DEFAULT_PORTS), "null").when(
        (host == "") | host.rlike(r"[\s%<>^|]"), F.lit(None).cast("string")).otherwise(
        F.concat(kind, F.lit("://"), host, shown))


def remove_dot_segments(where: Column) -> Column:
    """``/a/./b/../c`` to ``/a/c``."""
    def step(done: Column, s: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(s == ".", done).when(s == "..", shorter).otherwise(F.concat(done, F.array(s)))

    parts = F.split(where, "/")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    tail = F.when(where.rlike(r"/\.\.?$"), "/").otherwise("")
    full = F.concat(F.array_join(kept, "/"), tail)
    return F.when(where.contains("/."), F.when(full == "", "/").otherwise(full)).otherwise(where)


def resolve_url(base: Column, href: Column) -> Column:
    """Join a reference to the URL of its page."""
    ref = F.trim(href)
    ref_path, rest = F.regexp_extract(ref, r"^[^?#]*", 0), F.regexp_extract(ref, r"[?#].*$", 0)
    base_path = path(base)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"^.*/", 0))
    return (
        F.when(ref == "", base)
        .when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site(base), remove_dot_segments(ref_path), rest))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^[^#]*", 0), ref))
        .otherwise(F.concat(site(base), remove_dot_segments(F.concat(folder, ref_path)), rest))
    )


def last_label(url: Column) -> Column:
    """Last label of the host, without port."""
    return F.lower(F.regexp_extract(netloc(url), r"\.([^.:@]+)(?::[0-9]*)?$", 1))


@cache
def mimetype_table() -> mimetypes.MimeTypes:
    """Python's own extension table, without the files of the machine."""
    return mimetypes.MimeTypes()


def _extension(url: Column) -> Column:
    table = mimetype_table()
    name = F.regexp_extract(path(url), r"[^/]*$", 0)
    for short, long in table.suffix_map.items():
        name = F.regexp_replace(name, f"\\{short}$", long)
    last = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    inner = F.regexp_extract(name, r"[^.](\.[^.]*)\.[^.]*$", 1)
    return F.lower(F.when(last.isin(*table.encodings_map), inner).otherwise(last))


def known_types() -> dict[str, str]:
    return dict(mimetype_table().types_map[True])


def guess_mimetype(url: Column, default: str = "text/html") -> Column:
    """Type by the extension of the URL's path."""
    table = F.create_map(*[F.lit(x) for pair in known_types().items() for x in pair])
    return F.coalesce(F.try_element_at(table, _extension(url)), F.lit(default))


def has_mimetype(url: Column, allowed: list[str], default: str) -> Column:
    """Same as testing :func:`guess_mimetype`, with two set lookups instead of a map."""
    types = known_types()
    ext = _extension(url)
    fits = ext.isin(*[e for e, t in types.items() if t in allowed])
    return fits | ~ext.isin(*types) if default in allowed else fits


def is_submittable(url: Column) -> Column:
    return url.rlike(SUBMITTABLE)


def ipv4_to_long(ip: Column) -> Column:
    """Dotted IPv4 as a number; NULL if it is none."""
    total = F.lit(0).cast("bigint")
    for i in range(4):
        octet = F.try_element_at(F.split(ip, r"\."), F.lit(i + 1)).try_cast("bigint")
        total = total * 256 + F.when((octet >= 0) & (octet < 256), octet)
    return F.when(ip.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), total)
