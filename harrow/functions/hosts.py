"""Names of hosts: the Bootstring form of international labels, and registrable names by a list of public suffixes.

A list has one rule for each row: a suffix (``co.uk``), ``*.`` before one for any label under it, or ``!`` before a name that is no
suffix although a wildcard says so. The rule of an exception wins, then the one of most labels; a name that no rule fits has its last label
as suffix. Rules meet hosts by equality on exploded suffixes, so lists may be long and are never in the plan.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "xn--"


def decode_label(label: str) -> str:
    """What an ``xn--`` label stands for; the label itself where it is none or is malformed."""
    try:
        said = label[len(PREFIX) :].encode("ascii").decode("punycode") if label.startswith(PREFIX) else label
        said.encode("utf-8")  # half of a pair is no character
        return said
    except (UnicodeError, OverflowError, ValueError):
        return label


def encode_label(label: str) -> str:
    """A label as ASCII; ASCII stays."""
    return label if label.isascii() else PREFIX + unicodedata.normalize("NFC", label).encode("punycode").decode("ascii")


def _each_label(one, odd):
    """A function of labels over a column of hosts; each different odd host is taken once."""

    @F.pandas_udf(T.StringType())
    def run(hosts: pd.Series) -> pd.Series:
        some = {h: ".".join(map(one, h.split("."))) for h in hosts.dropna().unique() if odd(h)}
        return hosts.map(lambda h: None if h is None else some.get(h, h))

    return run


def to_unicode(host: Column) -> Column:
    """A host with its ``xn--`` labels decoded, lower case."""
    return _each_label(decode_label, lambda h: PREFIX in h)(F.lower(host))


def to_ascii(host: Column) -> Column:
    """A host with labels beyond ASCII encoded, lower case; the full stops of other scripts separate labels as well."""
    return _each_label(encode_label, lambda h: not h.isascii())(F.translate(F.lower(host), "。．｡", "..."))


def suffix_list(text: DataFrame) -> DataFrame:
    """Rules (rule) of lines (value) of a list file: comments and what follows white space go; section marks of private names end the list."""
    line = F.regexp_extract("value", r"^\s*(\S*)", 1)
    return text.select(F.lower(line).alias("rule")).filter((F.col("rule") != "") & ~F.startswith("rule", F.lit("//"))).distinct()


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host", out: str = "site") -> DataFrame:
    """``hosts`` with the registrable name of each: one label more than its public suffix. IP addresses are their own; a null or
    empty host, and one that is a suffix itself, has none."""
    address = F.col(host).rlike(r"^[0-9.]+$|:")
    names = hosts.filter((F.col(host) != "") & ~address).select(F.col(host).alias("_h")).distinct()
    labels = F.split(F.rtrim(F.lower("_h"), F.lit(".")), r"\.")
    ends = names.select("_h", F.size(labels).alias("_all"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("key")))).alias("_e"))
    kind = F.when(F.startswith("rule", F.lit("!")), 2).when(F.startswith("rule", F.lit("*.")), 1).otherwise(0)
    keyed = rules.select(kind.alias("_kind"), F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("_key")).distinct()
    met = ends.join(keyed, F.col("_e.key") == F.col("_key"))
    # Labels of the suffix that a rule says: a wildcard takes one more than it names, if there is one, an exception one less.
    says = F.when(F.col("_kind") == 2, F.col("_e.n") - 1).when(F.col("_kind") == 1, F.when(F.col("_all") > F.col("_e.n"), F.col("_e.n") + 1)).otherwise(F.col("_e.n"))
    best = met.groupBy("_h").agg(F.max_by(says, F.struct(F.col("_kind") == 2, F.coalesce(says, F.lit(0)))).alias("_n"))
    every = names.join(best, "_h", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    site = F.when(F.size(labels) > F.col("_n"), F.array_join(F.slice(labels, F.size(labels) - F.col("_n"), F.col("_n") + 1), "."))
    every = every.select("_h", site.alias("_site"))
    return hosts.join(every, F.col(host) == F.col("_h"), "left").withColumn(out, F.when(address, F.col(host)).otherwise(F.col("_site"))).drop("_h", "_site")
