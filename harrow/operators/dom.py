"""Algebra over the node table: outermost, innermost, ancestors, groups of inline text and selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outermost(found: DataFrame, *by: str) -> DataFrame:
    """Nodes without an ancestor among the found ones of the same ``by`` (page, rule)."""
    w = Window.partitionBy(*by).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("end").over(w)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("pre"))).drop("_reach")


def innermost(found: DataFrame, *by: str) -> DataFrame:
    """Nodes without a descendant among the found ones."""
    w = Window.partitionBy(*by).orderBy("pre")
    return found.withColumn("_next", F.lead("pre").over(w)).filter(F.col("_next").isNull() | (F.col("_next") > F.col("end"))).drop("_next")


def _beside(found: DataFrame, holders: DataFrame, by: tuple[str, ...], payload: Column) -> DataFrame:
    """Found nodes (in _f) and holders (their payload in _h) as rows of one table, with their place in _at."""
    f = found.select(*by, F.col("pre").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("_f"))
    h = holders.select(*by, F.col("pre").alias("_at"), payload.alias("_h"))
    return f.withColumn("_h", F.lit(None).cast(h.schema["_h"].dataType)).unionByName(h.withColumn("_f", F.lit(None).cast(f.schema["_f"].dataType)))


def inside(found: DataFrame, holders: DataFrame, how: str = "left_semi", by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Found nodes with (left_semi) or without (left_anti) an ancestor among the holders of the same ``by``.

    Intervals of a tree lie within or beside each other, so an ancestor is there if what began before reaches as far: a
    running maximum, one sort for each page.
    """
    w = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    both = _beside(found, holders, by, F.col("end")).withColumn("_reach", F.max("_h").over(w)).filter("_f IS NOT NULL")
    held = F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False))
    return both.filter(held if how == "left_semi" else ~held).select("_f.*")


def nearest(found: DataFrame, holders: DataFrame, name: str, payload: Column, strict: bool = False, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Found nodes with ``payload`` of the nearest holder that is the node itself (unless ``strict``) or an ancestor, null for none.

    The number of holders around a place is a running sum over where they begin and end. Of the holders that lie in as many
    others, the last that began is the one around a node, as intervals of a tree never cross. So it takes two sorts for each
    page and no row for each pair of node and ancestor. Each holder must be given once.
    """
    f = found.select(*by, F.col("pre").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("_f"), F.lit(0).alias("_d"))
    h = holders.select(*by, "pre", "end", F.struct(payload.alias("v")).alias("_v"))
    # A holder is made once: a row of its own, one where it begins, which is the same unless ``strict``, and one behind its end.
    row = lambda at, held, d: F.struct(at.alias("_at"), (F.col("_v") if held else F.lit(None).cast(h.schema["_v"].dataType)).alias("_h"), F.lit(d).alias("_d"))
    rows = [row(F.col("pre"), True, int(not strict)), row(F.col("end") + 1, False, -1), *([row(F.col("pre") + 1, False, 1)] if strict else [])]
    h = h.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")
    both = f.withColumn("_h", F.lit(None).cast(h.schema["_h"].dataType)).unionByName(h.withColumn("_f", F.lit(None).cast(f.schema["_f"].dataType)))
    around = F.sum("_d").over(Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_around", around).filter("_f IS NOT NULL OR _h IS NOT NULL")
    level = F.when(F.col("_h").isNotNull() & F.lit(strict), F.col("_around")).otherwise(F.col("_around") - 1)
    last = Window.partitionBy(*by, "_level").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    held = placed.withColumn("_level", level).withColumn("_held", F.last("_h", ignorenulls=True).over(last)).filter("_f IS NOT NULL")
    return held.select("_f.*", F.col("_held")["v"].alias(name))


def closest(found: DataFrame, holders: DataFrame) -> DataFrame:
    """Found nodes with holder_id, the nearest node among the holders that is the node or an ancestor; null for none."""
    return nearest(found, holders, "holder_id", F.col("node_id"))


def climb(found: DataFrame, holders: DataFrame, barriers: DataFrame, hops: int, name: str = "holder_id", strict: bool = False) -> DataFrame:
    """Found nodes with the nearest holder at most ``hops`` steps above (0 is the node itself, which ``strict`` leaves out) and no
    barrier from the node's parent up to it, the holder itself included; null where there is none. All three tables need depth."""
    one = nearest(found, holders, "_h", F.struct("node_id", "pre", "depth"), strict)
    both = nearest(one, barriers, "_b", F.col("pre"), strict=True)
    free = F.col("_b").isNull() | (F.col("_b") < F.col("_h.pre")) | (F.col("_h.pre") == F.col("pre"))
    reached = (F.col("depth") - F.col("_h.depth") <= hops) & free
    return both.withColumn(name, F.when(reached, F.col("_h.node_id"))).drop("_h", "_b")


def whole_text(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, node_id and the whole text of the nodes ``of``, white space at its ends left out, and what scripts and styles in them hold left in. For few
    nodes of a page: each meets the texts of its page."""
    t = nodes.filter("kind = 'text'").select(F.col("page_id").alias("_p"), F.col("pre").alias("_t"), "text")
    held = of.select("page_id", "node_id", "pre", "end").join(t, (F.col("page_id") == F.col("_p")) & (F.col("_t") > F.col("pre")) & (F.col("_t") <= F.col("end")))
    said = F.array_join(F.array_sort(F.collect_list(F.struct("_t", "text")))["text"], "")
    return held.groupBy("page_id", "node_id").agg(F.regexp_replace(said, r"^\s+|\s+$", "").alias("said"))


def labelled_by(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """page_id, node_id and the name that the elements in aria-labelledby give, in the order of the attribute, joined by a space. An id
    stands for the first element that has it; ids of none, and empty texts, are left out."""
    ids = F.split(F.btrim(attr("aria-labelledby")), r"\s+")
    asked = of.filter(attr("aria-labelledby").isNotNull()).select("page_id", "node_id", F.posexplode(ids).alias("_n", "_id")).filter("_id <> ''")
    # Each page's elements meet the ids that are asked for there alone.
    named = nodes.filter((F.col("kind") == "element") & attr("id").isNotNull()).select("page_id", attr("id").alias("_id"), F.struct("pre", "node_id", "end").alias("_e"))
    first = named.join(asked.select("page_id", "_id").distinct(), ["page_id", "_id"], "left_semi").groupBy("page_id", "_id").agg(F.min("_e").alias("_e")).select("page_id", "_id", "_e.*")
    said = whole_text(nodes, first.dropDuplicates(["page_id", "node_id"])).withColumnRenamed("node_id", "_there")
    met = asked.join(first.select("page_id", "_id", F.col("node_id").alias("_there")), ["page_id", "_id"]).join(said, ["page_id", "_there"]).filter("said <> ''")
    return met.groupBy("page_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", "said")))["said"], " ").alias("label"))


def inline_groups(nodes: DataFrame, min_length: int = 1) -> DataFrame:
    """Text of each run of inline nodes (page_id, grp, text, parts): no block element or line break lies within."""
    t = nodes.filter("kind = 'text' AND NOT in_non_content")
    parts = F.array_sort(F.collect_list(F.struct("pre", "node_id", "text")))
    g = t.groupBy("page_id", "grp").agg(parts.alias("parts")).withColumn("text", F.array_join("parts.text", ""))
    return g.filter(F.length("text") >= min_length).select("page_id", "grp", "text", "parts")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attr("class"), r"\s+"), name), F.lit(False))


def selector(text: str) -> Column:
    """A list of simple selectors (tag, #id, .class, [attr], [attr=v], ^=, $=, *=, and joins of them) as a predicate.

    Combinators are not taken; they raise. ``select`` takes them.
    """
    import re

    def simple(one: str) -> Column:
        out = [F.col("kind") == "element"]
        rest = one.strip()
        while rest:
            m = re.match(r"([a-zA-Z][a-zA-Z0-9-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^$*|]?=)[\"']?([^\]\"']*)[\"']?( i)?)?\]", rest)
            if not m:
                raise ValueError(f"no simple selector: {one!r}")
            tag, id_, cls, name, op, value, fold = m.groups()
            if tag and tag != "*":
                out.append(F.col("tag") == tag.lower())
            elif id_:
                out.append(attr("id") == id_)
            elif cls:
                out.append(has_class(cls))
            elif name:
                a = F.lower(attr(name)) if fold else attr(name)
                v = F.lit(value.lower() if fold else value)
                out.append({None: a.isNotNull(), "=": a == v, "^=": F.startswith(a, v), "$=": F.endswith(a, v), "*=": F.contains(a, v), "~=": F.array_contains(F.split(a, r"\s+"), v), "|=": (a == v) | F.startswith(a, F.concat(v, F.lit("-")))}[op])
            rest = rest[m.end() :]
        return reduce(lambda a, b: a & b, out)

    return F.coalesce(reduce(lambda a, b: a | b, [simple(s) for s in text.split(",")]), F.lit(False))


def asked_attributes(text: str) -> list[str]:
    """Attributes of which a node that ``selector`` names has at least one; empty if an alternative asks for none."""
    import re

    out = set()
    for one in text.split(","):
        bare = re.sub(r"\[[^\]]*\]", "", one)
        asked = {name for mark, name in (("#", "id"), (".", "class")) if mark in bare} | set(re.findall(r"\[([\w-]+)", one))
        if not asked:
            return []
        out |= asked
    return sorted(out)


def select(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes that a list of selectors names, with descendant ("a b") and child ("a > b") combinators."""
    import re

    made = []
    for one in re.split(r",(?![^\[]*\])", text):
        steps = [x for x in re.split(r"\s*(>)\s*|\s+(?![^\[]*\])", one.strip()) if x]
        found, child = None, False
        for part in steps:
            if part == ">":
                child = True
                continue
            here = nodes.filter(selector(part))
            if found is not None and child:
                here = here.join(found.select(F.col("page_id").alias("_page"), F.col("node_id").alias("_up")), (F.col("page_id") == F.col("_page")) & (F.col("parent_id") == F.col("_up")), "left_semi")
            elif found is not None:
                here = inside(here, found)
            found, child = here, False
        made.append(found)
    return reduce(DataFrame.unionByName, made).dropDuplicates(["page_id", "node_id"])


def trigger_tokens(selectors: list[str]) -> list[tuple[str, str]]:
    """The (kind, token) pairs, each once, that can make one of the selectors match: the ids, classes and attributes of its last step."""
    import re

    out = []
    for text in selectors:
        for one in re.split(r",(?![^\[]*\])", text):
            last = re.split(r"\s*>\s*|\s+(?![^\[]*\])", one.strip())[-1]
            out += [("id", m) for m in re.findall(r"#([\w-]+)", re.sub(r"\[[^\]]*\]", "", last))] + [("class", m) for m in re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", last))] + [("attribute", m) for m in re.findall(r"\[([\w-]+)", last)]
    return list(dict.fromkeys(out))


def token_selectors(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """Nodes that any of many plain #id and .class selectors (kind, token) names: an equality join on tokens."""
    ids = F.when(attr("id").isNotNull(), F.array(F.struct(F.lit("id").alias("kind"), attr("id").alias("token"))))
    classes = F.transform(F.filter(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), lambda c: c != ""), lambda c: F.struct(F.lit("class").alias("kind"), c.alias("token")))
    each = nodes.filter("kind = 'element'").withColumn("_t", F.explode(F.concat(F.coalesce(ids, F.array().cast("array<struct<kind:string,token:string>>")), classes)))
    found = each.join(selectors.select(F.col("kind").alias("_k"), F.col("token").alias("_v")), (F.col("_t.kind") == F.col("_k")) & (F.col("_t.token") == F.col("_v")), "left_semi")
    return found.drop("_t").dropDuplicates(["page_id", "node_id"])
