"""Style sheets of pages: which declaration of which rule an element gets.

<style> elements are read into rules (a selector, its place, declarations), which are matched on their own page through the
index of ``selectors``; the style attribute adds declarations of its own. For each element and property the winner is the
largest of (important, inline, specificity, place), an aggregate that is combined before the shuffle. Properties that
inherit are carried down from the nearest declaring element by ``dom.nearest``.

Known: rules outside of conditions or under @media all and screen, the selectors that ``selectors`` reads, and the
shorthands ``background`` of a plain colour, ``mask`` and ``overflow``. Other at-rules, linked sheets and what needs layout are left out. A
declaration of inherit, initial, unset or revert counts as none that is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import colour as C
from harrow.operators import dom as D
from harrow.operators import selectors as S
from harrow.session import shared_table

#: Properties that children take over: fixed values of the CSS standard, of those that are asked for here.
INHERITED = ("color", "visibility", "font-size", "text-indent", "-webkit-text-fill-color")
#: Values that name no value of their own.
DEFERRED = ("inherit", "initial", "unset", "revert", "revert-layer")
DECLARATION = "struct<name:string,value:string,important:boolean>"
RULES = f"page_id long, sheet int, rule int, selector string, declarations array<{DECLARATION}>"
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_MEDIA = re.compile(r"(?:only\s+)?(?:all|screen)(?:\s*,.*)?$|.*,\s*(?:only\s+)?(?:all|screen)\s*$", re.I | re.S)
_PIECE = re.compile(r"""[^{};"'()\\]+|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|\\.|[{};()\\]""", re.S)
_DECLARED = re.compile(r"""\s*(-{0,2}[a-zA-Z][\w-]*)\s*:\s*(.*?)\s*$""", re.S)


def declared(text: str) -> list[dict]:
    """The declarations of a block, in order."""
    parts, now, depth = [], "", 0
    for piece in _PIECE.findall(text):
        depth = max(0, depth + (piece == "(") - (piece == ")"))
        if piece == ";" and not depth:
            parts.append(now)
            now = ""
        else:
            now += piece
    out = []
    for part in [*parts, now]:
        if m := _DECLARED.match(part):
            value = re.sub(r"\s*!\s*important$", "", m[2], flags=re.I)
            out.append({"name": m[1].lower(), "value": re.sub(r"\s+", " ", value).lower(), "important": value != m[2]})
    return out


def rules_of(text: str) -> Iterator[tuple[str, list[dict]]]:
    """Selector lists and declarations of a style sheet, in order; blocks under other conditions and blocks within a rule are skipped."""
    head, body, depth, round_ = "", "", 0, 0
    for piece in _PIECE.findall(_COMMENT.sub(" ", text)):
        round_ = max(0, round_ + (piece == "(") - (piece == ")"))
        if piece == "{" and not round_:
            depth += 1
            body += piece if depth > 1 else ""
        elif piece == "}" and not round_:
            if depth > 1:
                body += piece
            elif depth == 1:
                name = head.strip()
                if not name.startswith("@"):
                    yield name, declared(re.sub(r"[^;{}]*\{[^{}]*\}", "", body))
                elif (m := re.match(r"@media\b(.*)$", name, re.S | re.I)) and _MEDIA.match(m[1].strip()):
                    yield from rules_of(body)
                head = body = ""
            depth = max(0, depth - 1)
        elif depth:
            body += piece
        elif piece == ";":
            head = ""  # a statement such as @import
        else:
            head += piece


def sheets(nodes: DataFrame, properties: tuple[str, ...] | None = None) -> DataFrame:
    """RULES of the <style> elements of pages, with the declarations of ``properties`` alone if given."""
    style = nodes.filter((F.col("kind") == "element") & (F.col("tag") == "style") & F.coalesce(F.lower(F.btrim(D.attr("media"))).isin("", "all", "screen"), F.lit(True)))
    text = nodes.filter("kind = 'text'").select("page_id", F.col("parent_id").alias("node_id"), "text")
    held = text.join(style.select("page_id", "node_id", F.col("pre").alias("sheet")), ["page_id", "node_id"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, sheet, css in frame.itertuples(index=False):
                for k, (selector, found) in enumerate(rules_of(css)):
                    kept = [d for d in found if properties is None or d["name"] in properties]
                    if kept:
                        rows.append((page, sheet, k, selector, kept))
            yield pd.DataFrame(rows, columns=["page_id", "sheet", "rule", "selector", "declarations"])

    return held.select("page_id", "sheet", "text").mapInPandas(read, RULES)


def attribute_declarations(style: Column) -> Column:
    """The declarations of a style attribute."""
    plain = r"""([\w-]+)\s*:\s*((?:[^;"'(]|"[^"]*"|'[^']*'|\([^)]*\))*)"""
    each = F.regexp_extract_all(style, F.lit(plain), F.lit(0))

    def one(d: Column) -> Column:
        value = F.lower(F.btrim(F.regexp_replace(F.regexp_extract(d, plain, 2), r"\s+", " ")))
        return F.struct(F.lower(F.regexp_extract(d, plain, 1)).alias("name"), F.regexp_replace(value, r"\s*!\s*important$", "").alias("value"), value.rlike(r"!\s*important$").alias("important"))

    return F.transform(each, one)


def _longhand(d: Column) -> Column:
    """A declaration as an array of those that it stands for."""
    named = lambda name: F.array(F.struct(F.lit(name).alias("name"), d["value"].alias("value"), d["important"].alias("important")))
    return (
        F.when((d["name"] == "background") & C.parse(d["value"]).isNotNull(), named("background-color"))
        .when((d["name"] == "overflow") & ~F.contains(d["value"], F.lit(" ")), F.concat(F.array(d), named("overflow-y")))
        .when(d["name"].isin("mask", "-webkit-mask", "-webkit-mask-image"), named("mask-image"))
        .when(d["name"] == "-webkit-background-clip", named("background-clip"))
        .otherwise(F.array(d))
    )


#: Shorthands and other names of properties that are asked for.
ALSO = {"background-color": ("background",), "overflow-y": ("overflow",), "mask-image": ("mask", "-webkit-mask", "-webkit-mask-image"), "background-clip": ("-webkit-background-clip",)}


def winners(nodes: DataFrame, properties: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, node_id, name, value of the declaration that each element gets of each property (of ``properties`` if given)."""
    asked = None if properties is None else (*properties, *(a for p in properties for a in ALSO.get(p, ())))
    rules = shared_table(sheets(nodes, asked), "sheets")
    named = S.match(nodes, rules.select("page_id", "selector"), "page_id").select("page_id", "node_id", "selector", "specificity")
    ruled = named.join(rules, ["page_id", "selector"]).select("page_id", "node_id", F.lit(False).alias("inline"), "specificity", "sheet", "rule", F.posexplode("declarations").alias("place", "d"))
    own = nodes.filter((F.col("kind") == "element") & D.attr("style").isNotNull())
    own = own.select("page_id", "node_id", F.lit(True).alias("inline"), F.array(*[F.lit(0)] * 3).alias("specificity"), F.lit(0).alias("sheet"), F.lit(0).alias("rule"), F.posexplode_outer(attribute_declarations(D.attr("style"))).alias("place", "d")).filter("d IS NOT NULL")
    # A plain ``explode`` would make its array once more to see whether it is empty.
    each = ruled.unionByName(own).withColumn("d", F.explode_outer(_longhand(F.col("d"))))
    each = each.select("page_id", "node_id", F.col("d.name").alias("name"), F.col("d.value").alias("value"), F.struct("d.important", "inline", "specificity", "sheet", "rule", "place").alias("rank"))
    each = each.filter((F.col("name").isin(*properties) if properties is not None else F.lit(True)) & (F.col("value") != ""))
    won = each.groupBy("page_id", "node_id", "name").agg(F.max_by("value", "rank").alias("value"))
    return won.filter(~F.col("value").isin(*DEFERRED))


def computed(nodes: DataFrame, won: DataFrame, of: DataFrame) -> DataFrame:
    """The nodes ``of`` with css, a map of the winners ``won`` and of what they inherit."""
    here = won.groupBy("page_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("css"))
    out = of.join(here, ["page_id", "node_id"], "left").withColumn("css", F.coalesce("css", F.create_map().cast("map<string,string>")))
    place = nodes.filter("kind = 'element'").select("page_id", "node_id", "pre", "end")
    passed = won.filter(F.col("name").isin(*INHERITED)).join(place, ["page_id", "node_id"])
    # One table of holders for all inherited properties: a name is part of the key, so each has its own intervals.
    wanted = out.select("page_id", "node_id", "pre", "end", F.explode(F.array(*map(F.lit, INHERITED))).alias("name"))
    live = passed.select("page_id", "name").distinct()
    got = D.nearest(wanted.join(live, ["page_id", "name"], "left_semi"), passed, "value", F.col("value"), by=("page_id", "name")).filter("value IS NOT NULL")
    got = got.groupBy("page_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_taken"))
    out = out.join(got, ["page_id", "node_id"], "left")
    return out.withColumn("css", F.coalesce(F.map_concat(F.map_filter("css", lambda k, v: ~k.isin(*INHERITED)), "_taken"), F.col("css"))).drop("_taken")
