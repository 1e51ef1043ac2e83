"""Pages without what the rules found: spans over groups of inline text, projected back to the text nodes they cross.

A group is the text of inline nodes that stand together (``dom.inline_groups``), so a number that is split over <b> or
<span> is one match. A detection is (page_id, grp, start, end, label, rule_id) and an id made of them, so
what is revealed again is an anti-join on ids, and a rule switched off is a filter.

Defined cases: overlapping spans are merged by start, the longest first; the label stands in the node where a span begins,
nodes that it covers become empty, and the last one keeps what follows it; groups without a span stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import spans as S
from harrow.operators import dom, text_rules

#: Rules over running text: spans by rule id, and the least length of a group worth a look.
TEXT_RULES = {"pii-redact": (text_rules.personal_spans, 9), "secrets-redact": (text_rules.secret_spans, 16), "encoded-payload-redact": (text_rules.encoded_spans, 10)}


def detections(groups: DataFrame, rules: dict | None = None) -> DataFrame:
    """id, page_id, grp, start, end, label and rule_id of every span in the groups (page_id, grp, text)."""
    parts = []
    for rule_id, (spans, least) in (TEXT_RULES if rules is None else rules).items():
        each = groups.filter(F.length("text") >= least).select("page_id", "grp", F.explode(spans(F.col("text"))).alias("s"))
        parts.append(each.select("page_id", "grp", "s.start", "s.end", "s.label", F.lit(rule_id).alias("rule_id")))
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.xxhash64("page_id", "grp", "start", "end", "label", "rule_id").alias("id"), *found.columns)


def reveal(found: DataFrame, ids: DataFrame) -> DataFrame:
    """The detections but for those of the given ids, whose originals stand again."""
    return found.join(ids.select("id"), "id", "left_anti")


def without_rule(found: DataFrame, rule_id: str) -> DataFrame:
    """The detections once a rule is switched off."""
    return found.filter(F.col("rule_id") != rule_id)


def clean(groups: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, grp, text (cleaned), n_spans and nodes: node_id and cleaned text of each part."""
    marked = found.groupBy("page_id", "grp").agg(F.collect_list(F.struct("start", "end", "label")).alias("_s"))
    g = groups.join(marked, ["page_id", "grp"], "left").withColumn("_s", S.merge(F.coalesce("_s", F.array().cast(S.SPAN))))
    place = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, p: F.struct((a["at"] + F.length(p["text"])).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    g = g.withColumn("_at", place)

    def part(p, o):
        n = F.length(p["text"])
        here = F.filter("_s", lambda s: (s["start"] < o + n) & (s["end"] > o))
        own = F.transform(here, lambda s: F.struct(F.greatest(s["start"] - o, F.lit(0)).alias("start"), F.least(s["end"] - o, n).alias("end"), F.when(s["start"] >= o, s["label"]).otherwise("").alias("label")))
        return F.struct(p["node_id"].alias("node_id"), S.replace(p["text"], own).alias("text"))

    nodes = F.zip_with("parts", "_at", part)
    return g.select("page_id", "grp", S.replace(F.col("text"), F.col("_s")).alias("text"), F.size("_s").alias("n_spans"), nodes.alias("nodes"))


def clean_nodes(nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The text nodes of pages as they are left: page_id, node_id, text. Without ``found``, all detections of TEXT_RULES."""
    groups = dom.inline_groups(nodes)
    found = detections(groups) if found is None else found
    return clean(groups, found).select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.node_id", "n.text")
