"""Rules that need the URL of a page alone, and the compressed tree of a page for a model.

Site tables are joined by host, with the path as a residual test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.functions import urls as U
from harrow.operators import dom as D
from harrow.session import shared_table

#: host, path pattern, difficulty, notes: sites that are hard to leave; made-up names.
WARNINGS = [("gym.example.com", "^/join", "hard", "Cancel by letter"), ("paper.example.org", "^/", "very-hard", "Cancel by phone")]
#: host, difficulty of closing an account.
DELETIONS = [("game.example.net", "impossible"), ("gym.example.com", "hard")]
#: host, recipe for a search by URL.
RECIPES = [("shop.example.com", "https://shop.example.com/search?q={terms}"), ("wiki.example.org", "https://wiki.example.org/w?search={terms}")]
VISITS = [(1, "https://www.gym.example.com/join/now"), (2, "https://gym.example.com/about"), (3, "https://game.example.net/signup"), (4, "https://game.example.net/play"), (5, "https://shop.example.com/x"), (6, "https://paper.example.org/"), (7, "not a url")]
SIGNUP = "sign-?up|register|join|subscribe|create-account|trial"


def _listed(visits: DataFrame, given: DataFrame | None, rows: list[tuple], schema: str) -> DataFrame:
    return visits.sparkSession.createDataFrame(rows, schema) if given is None else given


def roach_motel(visits: DataFrame, warnings: DataFrame | None = None, deletions: DataFrame | None = None) -> DataFrame:
    """page_id, difficulty, source: a curated warning, else a listed host on a page for signing up.

    ``warnings`` (host, at, warned) and ``deletions`` (host, closing) are lists of any length, each host once; without them WARNINGS and DELETIONS count.
    """
    v = visits.withColumns({"host": U.bare_host(F.col("url")), "path": U.path(F.col("url"))})
    curated = _listed(visits, warnings, [w[:3] for w in WARNINGS], "host string, at string, warned string")
    listed = _listed(visits, deletions, DELETIONS, "host string, closing string")
    w = v.join(curated, "host", "left").withColumn("warned", F.when(F.expr("path rlike at"), F.col("warned")))
    w = w.join(listed, "host", "left").withColumn("closing", F.when(F.lower("path").rlike(f"/(?:{SIGNUP})"), F.col("closing")))
    return w.filter(F.coalesce("warned", "closing").isNotNull()).select("page_id", F.coalesce("warned", "closing").alias("difficulty"), F.when(F.col("warned").isNotNull(), "curated").otherwise("list").alias("source"))


def recipes(visits: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """page_id and recipe of pages whose host is in ``given`` (host, recipe; RECIPES without one)."""
    listed = _listed(visits, given, RECIPES, "host string, recipe string")
    return visits.withColumn("host", U.bare_host(F.col("url"))).join(listed, "host").select("page_id", "recipe")


ROACH_SQL = "SELECT CAST(page_id AS BIGINT) AS page_id, difficulty, source FROM (VALUES (1, 'hard', 'curated'), (3, 'impossible', 'list'), (6, 'very-hard', 'curated')) v(page_id, difficulty, source)"
RECIPE_SQL = f"SELECT CAST(5 AS BIGINT) AS page_id, '{RECIPES[0][1]}' AS recipe"

#: What a page's tree shows: attributes, elements that are left out with what they hold, elements and roles that can be
#: used, elements that hold a part of a page, wrappers without a meaning, and characters of a text. Fixed values.
KEPT = r"^(?:title|role|aria-.*|href|alt|name|placeholder|type|pattern|value|checked)$"
LEFT_OUT = ("script", "code", "style", "link", "meta", "head", "title", "noscript", "template")
USABLE_TAGS, USABLE_ROLES = ("button", "input", "select", "textarea", "a"), ("button", "checkbox", "input", "link", "menuitem", "option", "radio", "tab", "textbox")
CONTAINERS = ("section", "aside", "nav", "article", "header", "footer", "main", "figure", "dialog")
WRAPPERS, SAID = ("span", "div"), 160


def contracted(nodes: DataFrame) -> DataFrame:
    """Elements and texts of the compressed tree of each page: page_id, node_id, pre, end, kind, tag, kept (attributes), said,
    depth and up (depth and parent in that tree) and ref (whether the node can be named).

    Wrappers without kept attributes go if nothing is left in them, and give way to their only child if that is an element. A
    wrapper stays while anything else lies in its interval, so the first is one look ahead in document order and the
    second one count of children; depth and parent are those of the nearest shown ancestor, found without climbing.
    """
    w = Window.partitionBy("page_id")
    hidden = D.attr("hidden").isNotNull() | F.lower(F.regexp_replace(F.coalesce(D.attr("style"), F.lit("")), r"\s", "")).rlike("(?:^|;)display:none")
    element = F.col("kind") == "element"
    closed = nodes.filter(element & (F.col("tag").isin(*LEFT_OUT, "svg", "textarea") | F.coalesce(hidden, F.lit(False))))
    gone = element & (F.col("tag").isin(*LEFT_OUT) | F.coalesce(hidden, F.lit(False)))
    n = D.inside(nodes.filter(F.col("kind").isin("element", "text")), closed, "left_anti").filter(~gone)
    flat = X.collapse_space(F.col("text"))
    said = F.when(F.length(flat) > SAID, F.concat(F.rtrim(F.substring(flat, 1, SAID)), F.lit("…"))).otherwise(flat)
    kept = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k.rlike(KEPT))
    n = n.withColumns({"said": said, "kept": kept}).filter(element | (F.length("said") > 0))
    bare = F.coalesce(F.col("tag").isin(*WRAPPERS), F.lit(False)) & (F.size("kept") == 0)
    # The next node that is no bare wrapper lies within a wrapper that has anything in it.
    n = n.withColumn("_bare", bare).withColumn("_next", F.min(F.when(~F.col("_bare"), F.col("pre"))).over(w.orderBy("pre").rowsBetween(0, Window.unboundedFollowing)))
    n = n.filter(~F.col("_bare") | (F.col("_next") <= F.col("end")))
    n = shared_table(n.select("page_id", "node_id", "parent_id", "pre", "end", "kind", "tag", "attrs", "said", "kept", "_bare"), "unwrapped")
    below = n.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_below"), F.count_if(F.col("kind") == "text").alias("_texts"))
    n = n.join(below, ["page_id", "node_id"], "left").filter(~F.col("_bare") | (F.col("_below") > 1) | (F.col("_texts") > 0))
    heading = nodes.filter(element & F.col("tag").isin("h1", "h2", "h3")).select("page_id", "parent_id")
    parents = nodes.filter(element).select("page_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_above"))
    heads = heading.join(parents, ["page_id", "parent_id"]).select("page_id", F.explode(F.array_distinct(F.array("parent_id", "_above"))).alias("node_id")).filter("node_id IS NOT NULL").distinct().withColumn("_head", F.lit(True))
    usable = D.attr("disabled").isNull() & D.attr("readonly").isNull() & (F.col("tag").isin(*USABLE_TAGS) | D.attr("tabindex").isNotNull() | D.attr("contenteditable").isNotNull() | F.coalesce(D.attr("role").isin(*USABLE_ROLES), F.lit(False)))
    n = n.join(heads, ["page_id", "node_id"], "left").withColumn("ref", element & F.coalesce(usable | F.col("tag").isin(*CONTAINERS) | F.col("_head"), F.lit(False)))
    # Depth and parent read the shown nodes several times, so they are made once, with what they need of them.
    n = shared_table(n.select("page_id", "node_id", "pre", "end", "kind", "tag", "kept", "said", "ref"), "shown")
    shown = n.filter(element)
    # How many shown elements lie around a node: what began before it, less what ended.
    begin, end = shown.select("page_id", (F.col("pre") + 1).alias("_at"), F.lit(1).alias("_d")), shown.select("page_id", (F.col("end") + 1).alias("_at"), F.lit(-1).alias("_d"))
    place = n.select("page_id", F.col("pre").alias("_at"), F.lit(0).alias("_d"), "node_id").unionByName(begin.unionByName(end), allowMissingColumns=True)
    depth = place.withColumn("depth", F.sum("_d").over(w.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))).filter("node_id IS NOT NULL").select("page_id", "node_id", F.col("depth").cast("int").alias("depth"))
    held = D.nearest(n.join(depth, ["page_id", "node_id"]), shown, "up", F.col("node_id"), strict=True)
    return held.select("page_id", "node_id", "pre", "end", "kind", "tag", "kept", "said", "depth", "up", "ref")


def page_trees(nodes: DataFrame) -> DataFrame:
    """page_id and tree: a line for each shown element with its kept attributes, and for each text, indented by depth. Elements
    that can be used or hold a part of the page end in # and their number, by which a model names them."""
    n = contracted(nodes)
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("kept")), lambda x: F.concat(F.lit(" "), x["key"], F.lit('="'), x["value"], F.lit('"'))), "")
    ref = F.when(F.col("ref"), F.concat(F.lit(" #"), F.col("node_id").cast("string"))).otherwise("")
    line = F.concat(F.repeat(F.lit(" "), F.col("depth")), F.when(F.col("kind") == "text", F.col("said")).otherwise(F.concat(F.lit("<"), F.col("tag"), attrs, F.lit(">"), ref)))
    return n.select("page_id", F.struct("pre", line.alias("line")).alias("l")).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias("tree"))


def classify_sections(trees: DataFrame, classifier: Callable[[str], list[int]]) -> DataFrame:
    """page_id and node_id of the sections that ``classifier`` (a tree to node numbers; a model call, or a stub) names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, r) for p, t in zip(frame["page_id"], frame["tree"], strict=True) for r in dict.fromkeys(classifier(t))]
            yield pd.DataFrame(rows, columns=["page_id", "node_id"])

    return trees.select("page_id", "tree").mapInPandas(run, "page_id long, node_id int")


#: Where a page says what it is about: no section in there is judged.
GUARDED = "article, header, [role=banner]"


def irrelevant_sections(nodes: DataFrame, classifier: Callable[[str], list[int]]) -> DataFrame:
    """page_id, node_id, pre, end and evidence of the sections that a model names: only those that the tree offers, none in or around what
    is GUARDED or that stands fixed on the screen, each once, the outermost."""
    refs = contracted(nodes).filter("ref").select("page_id", "node_id", "pre", "end")
    named = refs.join(classify_sections(page_trees(nodes), classifier), ["page_id", "node_id"], "left_semi")
    guarded = nodes.filter(D.selector(GUARDED))
    fixed = nodes.filter((F.col("kind") == "element") & F.lower(F.regexp_replace(F.coalesce(D.attr("style"), F.lit("")), r"\s", "")).rlike("(?:^|;)position:(?:fixed|sticky)"))
    free = named.join(guarded.unionByName(fixed).select("page_id", "node_id"), ["page_id", "node_id"], "left_anti")
    return D.outermost(D.inside(free, guarded, "left_anti"), "page_id").withColumn("evidence", F.lit("irrelevant"))
