"""Many site patterns over many URLs: a join by host suffix.

A host pattern ends in labels without a wildcard; these are its key. A host is exploded into its suffixes, which meet the keys
by equality, so a URL meets only patterns that end as its host does, and the rest of the pattern is a test of
the joined row. No pattern is collected into the plan. Hosts are joined once each, however many URLs they have, and their
patterns go back to the URLs by host and a salt, so that a host that holds a large share of the URLs is dealt to SALT tasks.

``*.`` at the start stands for any or no subdomain, ``*`` elsewhere in a host for anything within a label, and in a path
for anything; a null path stands for all. Null URLs, and those without a host, match nothing; case counts in paths alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U

SALT = 16


def suffixes(host: Column) -> Column:
    """A host, what is left of it without its first labels, and the empty string."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))


def key(host_pattern: Column) -> Column:
    """The labels of a pattern behind its last wildcard."""
    return F.regexp_extract(F.lower(host_pattern), r"^(?:.*\*[^.]*\.)?([^*]*)$", 1)


def _escaped(pattern: Column, any_: str) -> Column:
    return F.replace(F.regexp_replace(pattern, r"([.^$+?()\[\]{}|\\])", r"\\$1"), F.lit("*"), F.lit(any_))


def host_fits(host: Column, host_pattern: Column) -> Column:
    p = F.lower(host_pattern)
    rest = F.substring(p, 3, 1 << 20)
    plain = (p == "*") | (p == host) | (F.startswith(p, F.lit("*.")) & ((host == rest) | F.endswith(host, F.concat(F.lit("."), rest))))
    wild = F.concat(F.lit("^"), F.when(F.startswith(p, F.lit("*.")), F.concat(F.lit(r"(?:[^.]+\.)*"), _escaped(rest, "[^.]*"))).otherwise(_escaped(p, "[^.]*")), F.lit("$"))
    inner = F.when(F.startswith(p, F.lit("*.")), rest).otherwise(p)
    return plain | (F.contains(inner, F.lit("*")) & F.regexp(host, wild))


def path_fits(path: Column, path_pattern: Column) -> Column:
    p = F.coalesce(path_pattern, F.lit("/*"))
    return p.isin("*", "/*") | (p == path) | (F.contains(p, F.lit("*")) & F.regexp(path, F.concat(F.lit("^"), _escaped(p, "[^?#]*"), F.lit("$"))))


def fits(host: Column, path: Column, host_pattern: Column, path_pattern: Column) -> Column:
    return F.coalesce(host_fits(host, host_pattern) & path_fits(path, path_pattern), F.lit(False))


def match(urls: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Each row of ``urls`` with each row of ``patterns`` (host_pattern, path_pattern and others) that it fits."""
    u = urls.withColumns({"_host": U.host(F.col(url)), "_path": U.path(F.col(url))}).filter("_host IS NOT NULL")
    keyed = patterns.withColumn("_key", key(F.col("host_pattern")))
    hosts = u.select("_host").distinct().withColumn("_key", F.explode(suffixes(F.col("_host"))))
    met = hosts.join(keyed, "_key").filter(host_fits(F.col("_host"), F.col("host_pattern"))).drop("_key")
    met = met.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    # The salt is that of the whole row, so URLs that are equal are spread as well.
    salted = u.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in urls.columns]), F.lit(SALT)).cast("int"))
    return salted.join(met, ["_host", "_salt"]).filter(path_fits(F.col("_path"), F.col("path_pattern"))).drop("_host", "_path", "_salt")


def denied(urls: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``urls``, each once, with denied: whether any pattern fits it."""
    some = urls.select(url).distinct()
    hit = match(some, patterns.select("host_pattern", "path_pattern").distinct(), url).select(F.col(url).alias("_u")).distinct()
    return urls.join(hit, F.col(url) == F.col("_u"), "left").withColumn("denied", F.col("_u").isNotNull()).drop("_u")
