"""URL functions as Columns. try_parse_url keeps the case of hosts and gives null for what is no URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open the path of a checkout.
CHECKOUT = "cart|checkout|basket|bag|payment|order"
#: Suffixes of two labels under which names are registered; a short list of common ones, all others have one label.
SUFFIXES = tuple(f"{a}.{b}" for b in ("uk", "au", "nz", "jp", "kr", "br", "in", "za") for a in ("co", "com", "org", "net", "ac", "gov", "edu"))


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))


def origin(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1)
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host(url), port)


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL of a link on a page; other schemes stay as they are."""
    root = origin(base)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(base, "PROTOCOL"), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(href.rlike("^[#?]"), F.concat(root, path(base), href))
        .otherwise(F.concat(root, folder, href))
    )


def registrable(host_: Column) -> Column:
    """The name under a public suffix (by SUFFIXES); an IP address is its own, nothing gives null."""
    labels = F.split(host_, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*SUFFIXES)
    return F.when(host_ == "", None).when(host_.rlike(r"^[0-9.]+$|:"), host_).when(two, last(3)).otherwise(last(2))


def is_checkout(url: Column) -> Column:
    # Only a URL that names such a folder is taken apart.
    return F.coalesce(F.when(F.lower(url).rlike(f"/(?:{CHECKOUT})"), F.lower(path(url)).rlike(f"^/(?:{CHECKOUT})(?:/.*)?$")), F.lit(False))


def is_content(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, "PROTOCOL")).isin("http", "https", "file"), F.lit(False))


def pattern_regex(host_pattern: str, path_pattern: str | None) -> tuple[str, str]:
    """Anchored expressions of a site pattern: *. stands for any or no subdomain, * for anything."""
    escape = lambda s: "".join("[^?#]*" if c == "*" else f"\\{c}" if c in r".^$+?()[]{}|\\" else c for c in s)
    any_sub = host_pattern.startswith("*.")
    h = r"^(?:[^.]+\.)*" + escape(host_pattern[2:]) if any_sub else "^" + escape(host_pattern).replace("[^?#]*", "[^.]*")
    return h + "$", "^" + escape(path_pattern or "/*") + "$"


def matches(url: Column, host_pattern: str, path_pattern: str | None = None) -> Column:
    h, p = pattern_regex(host_pattern, path_pattern)
    return F.coalesce(host(url).rlike(h) & path(url).rlike(p), F.lit(False))
