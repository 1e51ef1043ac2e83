"""Agent runs from their event logs: the state that cumulative events leave, steps, pairs of calls and results, and usage.

An event row has run, seq, type and, for events of type "data", what the payload's result tells: actions and messages
(arrays so far, each event repeating what came before), message, completed, success and usage. A message has a role and
content parts; a part is reasoning text, a tool call or a tool result. A run's arrays are one document, as long as a run.

Defined cases: an array that is shorter than the one kept, or null, leaves that one; of equal lengths the later wins;
a blank message leaves the last answer; rows of other types count for nothing; a run without a data event has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,tool_call_id:string,tool_name:string,input:string,output_type:string,output:string>"
MESSAGES = f"array<struct<role:string,content:array<{PART}>>>"
ACTIONS = "array<struct<type:string,instruction:string,reasoning:string,page_url:string,timestamp_ms:long>>"
#: What begins a real tree, and actions that the agent did not choose: fixed values.
TREE, PROBES = "Accessibility Tree:", ("ariaTree", "screenshot")


def latest_state(events: DataFrame) -> DataFrame:
    """run, actions, messages, answer, completed, success and seq of the last data event."""
    e = events.filter("type = 'data'")
    longest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.size(c), "seq")))
    last = lambda c, where: F.max_by(c, F.when(where, F.col("seq")))
    said = F.length(F.btrim("message")) > 0
    return e.groupBy("run").agg(
        longest("actions").alias("actions"), longest("messages").alias("messages"), last("message", said).alias("answer"),
        F.coalesce(F.bool_or("completed"), F.lit(False)).alias("completed"), last("success", F.col("success").isNotNull()).alias("success"), F.max("seq").alias("seq"),
    )


def tool_pairs(states: DataFrame) -> DataFrame:
    """run, place, call_id, tool_name, input, reasoning, result_kind and result_text of calls that were answered, in order.

    The call that waits is the last one an assistant made; a result with its id answers it once. A later call replaces it.
    """
    m = states.select("run", F.posexplode("messages").alias("at", "m")).select("run", "at", "m.role", "m.content")
    of = lambda kind: F.filter("content", lambda p: p["type"] == kind)
    call = F.when((F.col("role") == "assistant") & (F.size(of("tool-call")) > 0), F.element_at(of("tool-call"), -1))
    thought = F.array_join(F.transform(F.filter(of("reasoning"), lambda p: F.length(F.btrim(p["text"])) > 0), lambda p: p["text"]), "\n")
    before = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.last(F.when(call.isNotNull(), F.struct("at", call.alias("call"), F.btrim(thought).alias("reasoning"))), ignorenulls=True)
    tools = m.withColumn("_w", waiting.over(before)).filter("role = 'tool' AND _w IS NOT NULL")
    found = F.element_at(F.filter(of("tool-result"), lambda p: p["tool_call_id"] == F.col("_w.call.tool_call_id")), 1)
    answers = tools.withColumn("_r", F.when(F.size(F.filter(of("tool-result"), lambda p: p["tool_call_id"] == F.col("_w.call.tool_call_id"))) > 0, found)).filter("_r IS NOT NULL")
    first = answers.withColumn("_n", F.row_number().over(Window.partitionBy("run", "_w.at").orderBy("at"))).filter("_n = 1")
    kind = F.when(F.col("_r.output_type") == "content", "text").when(F.col("_r.output_type") == "json", "json").otherwise("unknown")
    place = F.row_number().over(Window.partitionBy("run").orderBy("at")) - 1
    return first.select(
        "run", place.alias("place"), F.col("_w.call.tool_call_id").alias("call_id"), F.col("_w.call.tool_name").alias("tool_name"), F.col("_w.call.input").alias("input"),
        F.col("_w.reasoning").alias("reasoning"), kind.alias("result_kind"), F.coalesce("_r.output", F.lit("")).alias("result_text"),
    )


def steps(states: DataFrame) -> DataFrame:
    """One row for each action, with the answered call of the same place, the kind of its result and the time since the first timestamp."""
    a = states.select("run", F.posexplode("actions").alias("place", "a")).select("run", "place", "a.*")
    p = tool_pairs(states).withColumnRenamed("reasoning", "_why")
    s = a.join(p, ["run", "place"], "left")
    name, text = F.coalesce(F.nullif("tool_name", F.lit("")), "type"), F.coalesce("result_text", F.lit(""))
    tree = F.when(F.startswith(text, F.lit(TREE)), "aria_tree").when(F.length(F.btrim(text)) > 0, "aria_tree_placeholder").otherwise("empty")
    kind = F.when(name == "ariaTree", tree).otherwise(F.coalesce("result_kind", F.when(text == "", "empty").otherwise("text")))
    start = F.first("timestamp_ms", ignorenulls=True).over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select(
        "run", "place", "type", "instruction", F.btrim(F.coalesce(F.nullif("reasoning", F.lit("")), "_why", F.lit(""))).alias("reasoning"), "page_url", "timestamp_ms",
        F.coalesce(F.col("timestamp_ms") - start, F.lit(0)).alias("ms_since_start"), name.alias("tool_name"), F.coalesce("input", F.lit("{}")).alias("input"),
        kind.alias("result_kind"), text.alias("result_text"), F.length(text).alias("result_len"), F.when(text != "", F.sha2(text, 256)).alias("result_sha256"),
    )


def _path(url: Column) -> Column:
    return F.rtrim(F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), F.lit("/"))


def direct_goto(steps_: DataFrame, starts: DataFrame) -> DataFrame:
    """run and direct: whether its first action that is no probe goes to another path than its start (run, start_url)."""
    first = steps_.filter(~F.col("type").isin(*PROBES)).groupBy("run").agg(F.min_by(F.struct("type", "page_url"), "place").alias("f"))
    there = _path(F.col("f.page_url"))
    direct = (F.col("f.type") == "goto") & (there != _path(F.col("start_url"))) & (there != "")
    return starts.join(first, "run", "left").select("run", F.coalesce(direct, F.lit(False)).alias("direct"))


def token_backfill(usage: DataFrame) -> DataFrame:
    """Sums of (run, input, output, total, cached, cache_creation, reasoning) by run; a field that no row has stays null."""
    some = usage.filter("total IS NOT NULL")
    return some.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("input", "output", "total", "cached", "cache_creation", "reasoning")])


def nth_step_join(steps_: DataFrame, by: list[str], side: str, a, b) -> DataFrame:
    """The n-th step of a type and kind of result on one side of (by) with the n-th on the other; a step without its like is alone."""
    key = [*by, "type", "result_kind", "nth"]
    nth = F.row_number().over(Window.partitionBy(*by, side, "type", "result_kind").orderBy("place"))
    s = steps_.withColumn("nth", nth)
    one = s.filter(F.col(side) == a).select(*key, F.col("place").alias("place_a"), F.col("result_sha256").alias("sha_a"))
    two = s.filter(F.col(side) == b).select(*key, F.col("place").alias("place_b"), F.col("result_sha256").alias("sha_b"))
    return one.join(two, key, "full").withColumn("same", F.coalesce(F.col("sha_a") == F.col("sha_b"), F.lit(False))).drop("sha_a", "sha_b")


def trace_stats(entries: DataFrame) -> DataFrame:
    """tab_id, the number of rule applications and the characters of all entries as JSON, from (tab_id, entry)."""
    return entries.groupBy("tab_id").agg(F.count_if(F.col("entry.type") == "rule-application").alias("events"), F.sum(F.length(F.to_json("entry", {"ignoreNullFields": "false"}))).alias("chars"))
