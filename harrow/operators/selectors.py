"""Many selectors over many pages in one pass: an index of tokens, probed by an equality join.

A selector is parsed into steps (compounds joined by descendant, child, next-sibling and later-sibling combinators), and each
step is filed under one token that a node must have to fit it: an id, else a class, an attribute's name, a tag, or none. Nodes
are exploded into their tokens and meet the steps filed under them; the rest of the compound, :not included, is tested as a
Column. Of a selector the step of the rarest kind of token is looked for first. Selectors of one step are then done. For the
others, pages on which that step was found look for the other steps, and steps are linked from left to right: by a running maximum over (pre, end) for descendants, and by
equality for children and siblings. Nothing of the lists is in the plan, so their number is free.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.session import shared_table

_SIMPLE = "tag:string,ids:array<string>,classes:array<string>,attrs:array<struct<name:string,op:string,value:string,fold:boolean>>"
#: Parsed alternatives of a selector list; null where a part of it can't be judged from the tree alone.
PARSED = f"array<struct<specificity:array<int>,steps:array<struct<link:string,{_SIMPLE},nots:array<struct<{_SIMPLE}>>>>>>"
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_PART = re.compile(
    rf"(?P<tag>\*|(?!\d){_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|"
    rf"\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s\"']+))\s*(?P<fold>[iIsS])?\s*)?\]|(?P<not>:not\()|(?P<root>:root(?![\w-]))"
)
_LINK = re.compile(r"\s*([>+~])\s*|\s+")


class Unreadable(ValueError):
    """A selector with a part that is not known."""


def _compound(text: str, at: int, nested: bool = False) -> tuple[dict, list[int], int]:
    """The compound that begins at ``at``, its specificity and where it ends."""
    out = {"tag": None, "ids": [], "classes": [], "attrs": []}
    nots, weight, begin = [], [0, 0, 0], at
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    while at < len(text) and (m := _PART.match(text, at)):
        if m["tag"]:
            if at != begin:
                raise Unreadable(text)
            if m["tag"] != "*":
                out["tag"] = plain(m["tag"]).lower()
                weight[2] += 1
        elif m["id"]:
            out["ids"].append(plain(m["id"]))
            weight[0] += 1
        elif m["cls"]:
            out["classes"].append(plain(m["cls"]))
            weight[1] += 1
        elif m["attr"]:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
            fold = (m["fold"] or "").lower() == "i"
            out["attrs"].append({"name": plain(m["attr"]).lower(), "op": m["op"] or "", "value": value.lower() if value and fold else value, "fold": fold})
            weight[1] += 1
        elif m["root"]:
            out["tag"] = "html"
            weight[1] += 1
        elif nested:
            raise Unreadable(text)
        else:
            end, most = m.end(), [0, 0, 0]
            while True:
                inner, w, end = _compound(text, re.compile(r"\s*").match(text, end).end(), True)
                nots.append(inner)
                most = max(most, w)
                end = re.compile(r"\s*").match(text, end).end()
                if text[end : end + 1] != ",":
                    break
                end += 1
            if text[end : end + 1] != ")":
                raise Unreadable(text)
            weight = [a + b for a, b in zip(weight, most, strict=True)]
            at = end + 1
            continue
        at = m.end()
    if at == begin:
        raise Unreadable(text)
    return (out if nested else out | {"nots": nots}), weight, at


def parse(text: str) -> list[dict] | None:
    """The alternatives of a selector list with their specificity and steps, left to right; null if any can't be read."""
    try:
        out, at = [], len(text) - len(text.lstrip())
        text = text.rstrip()
        while True:
            steps, total, link = [], [0, 0, 0], ""
            while True:
                step, weight, at = _compound(text, at)
                steps.append({"link": link} | step)
                total = [a + b for a, b in zip(total, weight, strict=True)]
                m = _LINK.match(text, at)
                if not m or re.compile(r"\s*(?:,|$)").match(text, at):
                    break
                link, at = m[1] or " ", m.end()
            out.append({"specificity": total, "steps": steps})
            m = re.compile(r"\s*(,)\s*|\s*$").match(text, at)
            if not m:
                return None
            if not m[1]:
                return out
            at = m.end()
    except Unreadable:
        return None


def parsed(selector: Column) -> Column:
    """PARSED of each selector: lists of rules are short beside the nodes they are tried on, so a Python helper reads them."""

    @F.pandas_udf(PARSED)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else parse(t))

    return run(selector)


def _attribute(attrs: Column, c: Column) -> Column:
    raw = F.try_element_at(attrs, c["name"])
    a, v = F.when(c["fold"], F.lower(raw)).otherwise(raw), c["value"]
    given = F.length(v) > 0
    test = (
        F.when(c["op"] == "", True).when(c["op"] == "=", a == v).when(c["op"] == "^=", given & F.startswith(a, v)).when(c["op"] == "$=", given & F.endswith(a, v)).when(c["op"] == "*=", given & F.contains(a, v))
        .when(c["op"] == "~=", F.array_contains(F.split(a, r"\s+"), v)).when(c["op"] == "|=", (a == v) | F.startswith(a, F.concat(v, F.lit("-"))))
    )
    return raw.isNotNull() & F.coalesce(test, F.lit(False))


def _simple(c: Column, tag: Column, attrs: Column, classes: Column) -> Column:
    ids = F.forall(c["ids"], lambda i: F.coalesce(F.try_element_at(attrs, F.lit("id")) == i, F.lit(False)))
    return (c["tag"].isNull() | (c["tag"] == tag)) & ids & F.forall(c["classes"], lambda k: F.array_contains(classes, k)) & F.forall(c["attrs"], lambda a: _attribute(attrs, a))


def fits(c: Column, tag: Column, attrs: Column, classes: Column) -> Column:
    """Whether a node is named by a compound."""
    return _simple(c, tag, attrs, classes) & ~F.exists(c["nots"], lambda n: _simple(n, tag, attrs, classes))


def _filed(c: Column) -> Column:
    """The token under which a step is filed."""
    token = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("token"))
    return (
        F.when(F.size(c["ids"]) > 0, token("#", F.get(c["ids"], F.lit(0)))).when(F.size(c["classes"]) > 0, token(".", F.get(c["classes"], F.lit(0))))
        .when(F.size(c["attrs"]) > 0, token("[", F.get(c["attrs"], F.lit(0))["name"])).when(c["tag"].isNotNull(), token("<", c["tag"])).otherwise(token("*", F.lit("")))
    )


def index(selectors: DataFrame, *scope: str) -> DataFrame:
    """The steps of ``selectors`` (scope, selector): scope, selector, alternative, specificity, step, n_steps, link, compound, kind, token,
    and first: whether a step is that of the rarest kind of token, the last of equals."""
    each = selectors.select(*scope, "selector").distinct()
    read = each.select("selector").distinct().withColumn("_p", parsed(F.col("selector"))).filter("_p IS NOT NULL")
    each = each.join(read, "selector").select(*scope, "selector", F.posexplode("_p").alias("alternative", "_a"))
    # Kinds in the order of how rare their tokens are.
    rank = F.transform("_a.steps", lambda c, k: F.struct(F.instr(F.lit("#.[<*"), _filed(c)["kind"]).alias("kind"), (-k).alias("back")))
    each = each.withColumn("_first", -F.array_min(rank)["back"])
    each = each.select(*scope, "selector", "alternative", F.col("_a.specificity").alias("specificity"), F.size("_a.steps").alias("n_steps"), "_first", F.posexplode("_a.steps").alias("step", "compound"))
    each = each.withColumn("first", F.col("step") == F.col("_first")).drop("_first")
    return each.withColumn("_t", _filed(F.col("compound"))).select(*each.columns, F.col("compound.link").alias("link"), "_t.kind", "_t.token")


def unread(selectors: DataFrame) -> DataFrame:
    """The selectors that can't be read; ``match`` leaves them out."""
    return selectors.withColumn("_p", parsed(F.col("selector"))).filter("_p IS NULL").drop("_p")


def elements(nodes: DataFrame) -> DataFrame:
    """Elements with classes and their tokens."""
    attrs = F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>"))
    classes = F.array_distinct(F.filter(F.split(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")), r"\s+"), lambda c: c != ""))
    token = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("token"))
    tokens = F.concat(
        F.transform(F.col("classes"), lambda c: token(".", c)), F.transform(F.map_keys("attrs"), lambda k: token("[", k)),
        F.array_compact(F.array(F.when(F.try_element_at("attrs", F.lit("id")).isNotNull(), token("#", F.try_element_at("attrs", F.lit("id")))))), F.array(token("<", F.col("tag")), token("*", F.lit(""))),
    )
    out = nodes.filter("kind = 'element'").select("page_id", "node_id", "parent_id", "pre", "end", "tag", attrs.alias("attrs"))
    return out.withColumn("classes", classes).withColumn("tokens", tokens)


def before(nodes: DataFrame) -> DataFrame:
    """page_id, node_id and prev_id, the element before it under the same parent: sorted without what elements hold."""
    last = F.lag("node_id").over(Window.partitionBy("page_id", "parent_id").orderBy("pre"))
    return nodes.filter("kind = 'element'").select("page_id", "node_id", last.alias("prev_id"))


_NODE = ("page_id", "node_id", "parent_id", "pre", "end")
_SELECTOR = ("selector", "alternative")


def _probe(nodes: DataFrame, steps: DataFrame, *scope: str, kinds: list[str] | None = None) -> DataFrame:
    """Nodes that fit steps, found by their tokens, of ``kinds`` alone if steps have no others. Steps of no page are a list, which goes
    to the nodes: a frequent tag is no key that all its nodes are sent to."""
    tokens = F.col("tokens") if kinds is None else F.filter("tokens", lambda t: t["kind"].isin(*kinds))
    # A plain ``explode`` makes the tokens once more to see whether there are any.
    each = nodes.withColumn("tokens", tokens).withColumn("_t", F.explode_outer("tokens")).select(*_NODE, "tag", "attrs", "classes", "_t.kind", "_t.token")
    met = each.join(steps if scope else F.broadcast(steps), [*scope, "kind", "token"])
    return met.filter(fits(F.col("compound"), F.col("tag"), F.col("attrs"), F.col("classes"))).select(*_NODE, *_SELECTOR, "specificity", "step", "n_steps", "link")


def _linked(candidates: DataFrame, holders: DataFrame, links: set[str]) -> DataFrame:
    """Candidates that stand to a holder of the same page and selector as their link asks."""
    both = holders.withColumn("_holds", F.lit(True)).unionByName(candidates.withColumn("_holds", F.lit(False)))
    by, holds = ("page_id", *_SELECTOR), F.col("_holds")
    earlier = lambda w: w.orderBy("pre").rangeBetween(Window.unboundedPreceding, -1)
    tests = {}
    if " " in links:
        tests[" "] = F.max(F.when(holds, F.col("end"))).over(earlier(Window.partitionBy(*by))) >= F.col("pre")
    if ">" in links:
        tests[">"] = F.max(holds).over(Window.partitionBy(*by, "_up")) & F.col("parent_id").isNotNull()
        both = both.withColumn("_up", F.when(holds, F.col("node_id")).otherwise(F.col("parent_id")))
    if "+" in links:
        tests["+"] = F.max(holds).over(Window.partitionBy(*by, "_left")) & F.col("prev_id").isNotNull()
        both = both.withColumn("_left", F.when(holds, F.col("node_id")).otherwise(F.col("prev_id")))
    if "~" in links:
        tests["~"] = F.max(holds).over(earlier(Window.partitionBy(*by, "parent_id")))
    for n, (link, test) in enumerate(tests.items()):
        both = both.withColumn(f"_ok{n}", (F.col("link") == link) & test)
    ok = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_ok{n}"), F.lit(False)) for n in range(len(tests))])
    return both.filter(~holds & ok).select(candidates.columns)


def match(nodes: DataFrame, selectors: DataFrame, *scope: str) -> DataFrame:
    """page_id, node_id, pre, end, selector and specificity of every node that one of ``selectors`` (selector) names.

    With ``scope`` page_id a selector holds on its page alone. Of a selector's alternatives that name a node, the most
    specific counts. Selectors that can't be read name nothing; ``unread`` lists them.
    """
    els, steps = elements(nodes), index(selectors, *scope)
    met = steps.select("step", "link", "n_steps", "first", "kind").distinct().collect()
    shape = {(r.step, r.link) for r in met if r.n_steps > 1 and r.step > 0}
    kinds = {first: sorted({r.kind for r in met if r.first == first}) for first in (True, False)}
    seen = _probe(els, steps.filter("first"), *scope, kinds=kinds[True])
    found = seen.filter("n_steps = 1")
    if shape:
        seen = shared_table(seen.filter("n_steps > 1"), "first")
        live = seen.select("page_id", *_SELECTOR).distinct()
        # The other steps are looked for on pages that hold the first one alone.
        rest = _probe(els, steps.filter("NOT first").join(live, [*scope, *_SELECTOR]).select("page_id", *[c for c in steps.columns if c != "page_id"]), "page_id", kinds=kinds[False])
        some = shared_table(rest, "steps").unionByName(seen)
        beside = any(link == "+" for _, link in shape)
        some = some.join(before(nodes), ["page_id", "node_id"], "left") if beside else some.withColumn("prev_id", F.lit(None).cast("int"))
        held = some.filter("step = 0")
        for k in range(1, 1 + max(step for step, _ in shape)):
            held = _linked(some.filter(F.col("step") == k), held.filter(F.col("n_steps") > k), {link for step, link in shape if step == k})
            found = found.unionByName(held.filter(F.col("n_steps") == k + 1).drop("prev_id"))
    return found.groupBy("page_id", "node_id", "selector").agg(F.min("pre").alias("pre"), F.min("end").alias("end"), F.max("specificity").alias("specificity"))
