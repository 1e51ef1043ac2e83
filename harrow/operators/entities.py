"""What pages say of organizations and people in structured data: JSON-LD at any depth, and microdata by who holds what.

A property of microdata belongs to the nearest item around it, which is found by intervals (``dom.nearest``). JSON-LD
scripts are few and short beside the nodes, so a Python helper walks them. An entity that claims an address under another registrable
name than its page's, and is an authority, or a person in the place of one, can't be taken at its word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls as U
from harrow.operators import dom as D

#: Kinds of authorities, kinds that are ones in some places, those places, and hosts that show what others wrote: fixed values.
AUTHORITIES = ("Organization", "NewsMediaOrganization", "OnlineBusiness", "EducationalOrganization", "GovernmentOrganization", "Corporation", "NGO", "MediaOrganization")
PEOPLE = ("Person",)
PLACES = ("author", "editor", "publisher", "creator", "contributor", "maintainer", "sourceOrganization", "reviewedBy", "funder", "sponsor", "provider", "producer")
AGGREGATORS = ("news.google.com", "news.yahoo.com", "news.msn.com", "flipboard.com", "smartnews.com", "apple.news", "web.archive.org", "archive.today", "archive.ph", "feedly.com", "getpocket.com")
AGGREGATOR_ENDS = (".cdn.ampproject.org", ".translate.goog")

FOUND = "page_id long, node_id int, pre int, end int, url string, types array<string>, roles array<string>, claim string"


def claims(text: str) -> list[tuple[list[str], list[str], str | None]]:
    """(types, roles, claim) of every object of a JSON-LD text that has a type: the key it stands under, through lists, and its url or @id."""
    try:
        todo, out = [(json.loads(text), None)], []
    except ValueError:
        return []
    while todo:
        value, role = todo.pop()
        if isinstance(value, list):
            todo += [(v, role) for v in value]
        elif isinstance(value, dict):
            given = value.get("@type")
            types = [t.rpartition("/")[2] for t in (given if isinstance(given, list) else [given]) if isinstance(t, str)]
            claim = next((value[k] for k in ("url", "@id") if isinstance(value.get(k), str) and value[k]), None)
            if types:
                out.append((types, [] if role is None else [role], claim))
            todo += [(v, k) for k, v in value.items()]
    return out


def from_json(n: DataFrame) -> DataFrame:
    """FOUND of the JSON-LD scripts; a script is the node of all its entities."""
    script = n.filter((F.col("kind") == "element") & (F.col("tag") == "script") & (F.lower(F.btrim(D.attr("type"))) == "application/ld+json")).select("page_id", "node_id", "pre", "end", "url")
    text = n.filter("kind = 'text'").select("page_id", F.col("parent_id").alias("node_id"), "text")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(*row[:-1], *c) for row in frame.itertuples(index=False) for c in claims(row[-1])], columns=[f.split()[0] for f in FOUND.split(", ")])

    return script.join(text, ["page_id", "node_id"]).select("page_id", "node_id", "pre", "end", "url", "text").mapInPandas(walk, FOUND)


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s+"), lambda t: t != "")


def from_microdata(n: DataFrame) -> DataFrame:
    """FOUND of the items with a type. The claim is the first url of theirs that says something, else their itemid."""
    e = n.filter("kind = 'element'")
    scopes = e.filter(D.attr("itemscope").isNotNull()).select("page_id", "node_id", "pre", "end")
    props = e.filter(F.array_contains(_tokens(D.attr("itemprop")), "url")).select("page_id", "node_id", "pre", "end", "tag", "attrs")
    owned = D.nearest(props, scopes, "_owner", F.col("node_id"), strict=True).filter("_owner IS NOT NULL")
    plain = ~F.col("tag").isin("meta", "a", "link", "area", "img", "audio", "video", "source")
    said = D.whole_text(n, owned.filter(plain))
    value = F.when(F.col("tag") == "meta", D.attr("content")).when(F.col("tag").isin("a", "link", "area"), D.attr("href")).when(~plain, D.attr("src")).otherwise(F.col("said"))
    urls = owned.join(said, ["page_id", "node_id"], "left").withColumn("_v", F.btrim(F.coalesce(value, F.lit("")))).filter("_v <> ''")
    first = urls.groupBy("page_id", F.col("_owner").alias("node_id")).agg(F.min_by("_v", "pre").alias("_url"))
    items = e.filter(D.attr("itemscope").isNotNull() & D.attr("itemtype").isNotNull()).join(first, ["page_id", "node_id"], "left")
    types = F.transform(_tokens(D.attr("itemtype")), lambda t: F.regexp_extract(t, "[^/]*$", 0))
    return items.select("page_id", "node_id", "pre", "end", "url", types.alias("types"), _tokens(D.attr("itemprop")).alias("roles"), F.coalesce("_url", F.nullif(D.attr("itemid"), F.lit(""))).alias("claim"))


def entities(n: DataFrame) -> DataFrame:
    """All entities of pages (nodes with url), with source: ``json-ld`` or ``microdata``."""
    return from_json(n).withColumn("source", F.lit("json-ld")).unionByName(from_microdata(n).withColumn("source", F.lit("microdata")))


def untrusted(found: DataFrame) -> DataFrame:
    """The entities whose claim is another's, with outcome: ``sanitize`` for an authority, ``annotate`` for a person in the place of one."""
    named = lambda column, names: F.arrays_overlap(column, F.array(*map(F.lit, names)))
    authority = named("types", AUTHORITIES)
    outcome = F.when(authority, "sanitize").when(named("types", PEOPLE) & named("roles", PLACES), "annotate")
    host = U.host(F.col("url"))
    shown = host.isin(*AGGREGATORS)
    for end in AGGREGATOR_ENDS:
        shown = shown | F.endswith(host, F.lit(end))
    elsewhere = F.lower(F.col("claim")).rlike("^https?://") & (U.registrable(U.host(F.col("claim"))) != U.registrable(host))
    return found.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull() & elsewhere & ~shown)
