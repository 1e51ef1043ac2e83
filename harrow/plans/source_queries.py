"""Sources and sinks over files that are written from the given tables, and functions of the catalog over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import records
from harrow.functions import text as X
from harrow.functions import urls as U
from harrow.operators import catalog
from harrow.operators import dom as D
from harrow.session import shared_path
from harrow.sources import html, logs


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _written(lines: DataFrame, label: str) -> str:
    """Lines (value) as text files in the shared folder."""
    path = shared_path(lines.sparkSession, label)
    lines.write.text(path)
    return path


def logged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log of one line for each event, some blank and some broken off, read back: runs and steps of each scenario, and what is malformed."""
    row = F.to_json(F.struct(F.concat(F.lit("s"), F.col("event_id") % 4).alias("scenario_id"), F.lit("t").alias("task_id"), (F.col("event_id") % 17).cast("int").alias("steps_taken"), F.struct((F.col("event_id") % 3 == 0).alias("pass")).alias("judge")))
    line = F.when(F.col("event_id") % 51 == 0, "  ").when(F.col("event_id") % 50 == 0, F.substring(row, 1, 20)).otherwise(row)
    good, bad = logs.results(spark, _written(_events(spark, sf_dir).select(line.alias("value")), "results"))
    runs = good.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.sum("steps_taken").alias("steps"), F.count_if("judge.pass").alias("n_passed"))
    none = F.lit(None).cast("long")
    return runs.unionByName(bad.agg(F.lit("(malformed)").alias("scenario_id"), F.count(F.lit(1)).alias("n"), none.alias("steps"), none.alias("n_passed")))


def stored_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries stored by tab, of which one tab is read: only its folder is touched."""
    path = shared_path(spark, "trace")
    logs.store_trace(_events(spark, sf_dir).select((F.col("user_id") % 10).alias("tab_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type")), path)
    return logs.read_trace(spark, path, "tab_id long, seq long, type string", 3).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def proxied_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a model proxy by kind, endpoint and model."""
    model = F.struct(F.concat(F.lit("m"), F.col("event_id") % 3).alias("model")).alias("request")
    call = F.to_json(F.struct(F.lit("/v1/chat").alias("endpoint"), F.lit(200).alias("status"), (F.col("event_id") % 2 == 0).alias("stream"), model, F.lit("x").alias("response")))
    other = F.to_json(F.struct(F.lit(True).alias("unhandled"), F.concat(F.lit("/"), F.col("event_type")).alias("path")))
    line = F.when(F.col("event_type") == "error", "{broken").when(F.col("event_type") == "view", other).otherwise(call)
    return logs.proxy_log(spark, _written(_events(spark, sf_dir).select(line.alias("value")), "proxy")).groupBy("kind", "endpoint", "model").agg(F.count(F.lit(1)).alias("n"))


def filter_list_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a filter list by kind: notes, rules of sites and extended selectors are left out, repeated ones count once."""
    k = (F.floor(F.col("event_id") / 2) % 500).cast("string")
    r = F.col("event_id") % 12
    line = F.when(r < 4, F.concat(F.lit("##.ad-"), k)).when(r < 7, F.concat(F.lit("###slot-"), k)).when(r < 9, F.concat(F.lit("##div > .x"), k)).when(r == 9, F.concat(F.lit("! note "), k)).when(r == 10, F.concat(F.lit("a.example##.b"), k)).otherwise(F.concat(F.lit("##.c:has(.d"), k, F.lit(")")))
    listed = logs.selector_list(spark, _written(_events(spark, sf_dir).select(line.alias("value")), "list"))
    return listed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def protection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages are in each state of protection, and rules on where it counts."""
    p, k = _pages(spark, sf_dir), F.col("page_id")
    state = catalog.protection(k % 7 != 0, k % 3 == 0, catalog.denied(F.col("url"), [("*.example.net", None)]))
    return p.withColumn("state", state).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(catalog.masked(F.col("state") == "on", k % 2 == 0)).alias("n_masked"))


def content_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages of other schemes hold content."""
    scheme = F.get(F.array(*map(F.lit, ("http", "https", "file", "ftp", "chrome", "HTTPS"))), (F.col("page_id") % 6).cast("int"))
    url = F.concat(scheme, F.lit("://"), F.regexp_extract("url", "^[a-z]+://(.*)$", 1))
    return _pages(spark, sf_dir).select("page_id", U.is_content(url).alias("content"))


def globbed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).filter(records.glob(F.concat("event_type", F.lit("-"), F.col("event_id") % 5), ["pur*-1", "?iew-*", "error-2"])).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def element_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag, with its id and classes, stands in the pages."""
    e = html.nodes(_pages(spark, sf_dir)).filter("kind = 'element'")
    return e.groupBy(X.element_name(F.col("tag"), D.attr("id"), D.attr("class")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (logged_results, stored_trace, proxied_calls, filter_list_kinds, protection_states, content_urls, globbed_events, element_names)}
_BARE = "regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script>', 'gs'), '<!--.*?-->', '', 'gs')"
ORACLES = {
    "logged_results": """SELECT 's' || (event_id % 4) AS scenario_id, count(*) AS n, CAST(sum(event_id % 17) AS BIGINT) AS steps, count(*) FILTER (event_id % 3 = 0) AS n_passed FROM events WHERE event_id % 51 <> 0 AND event_id % 50 <> 0 GROUP BY 1
UNION ALL SELECT '(malformed)', count(*), NULL, NULL FROM events WHERE event_id % 51 <> 0 AND event_id % 50 = 0""",
    "stored_trace": "SELECT event_type AS type, count(*) AS n, max(event_id) AS last_seq FROM events WHERE user_id % 10 = 3 GROUP BY 1",
    "proxied_calls": """SELECT CASE WHEN event_type = 'view' THEN 'unhandled' WHEN event_id % 2 = 0 THEN 'stream' ELSE 'reply' END AS kind, CASE WHEN event_type = 'view' THEN '/view' ELSE '/v1/chat' END AS endpoint, CASE WHEN event_type <> 'view' THEN 'm' || (event_id % 3) END AS model, count(*) AS n
FROM events WHERE event_type <> 'error' GROUP BY ALL""",
    "filter_list_kinds": """SELECT CASE WHEN r < 4 THEN 'class' WHEN r < 7 THEN 'id' ELSE 'complex' END AS kind, count(DISTINCT CASE WHEN r < 4 THEN '.ad-' WHEN r < 7 THEN '#slot-' ELSE 'div > .x' END || k) AS n FROM (SELECT event_id % 12 AS r, (event_id // 2) % 500 AS k FROM events) WHERE r < 9 GROUP BY 1""",
    "protection_states": """SELECT state, count(*) AS n, count(*) FILTER (state = 'on' AND page_id % 2 = 0) AS n_masked FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'off' WHEN regexp_matches(url, '^[a-z]+://([^/?#]*\\.)?example\\.net([/:?#]|$)') THEN 'site' WHEN page_id % 3 = 0 THEN 'paused' ELSE 'on' END AS state FROM pages) GROUP BY state""",
    "content_urls": "SELECT page_id, page_id % 6 NOT IN (3, 4) AS content FROM pages",
    "globbed_events": "SELECT event_type, count(*) AS n FROM (SELECT event_type, event_type || '-' || (event_id % 5) AS name FROM events) WHERE name GLOB 'pur*-1' OR name GLOB '?iew-*' OR name GLOB 'error-2' GROUP BY event_type",
    "element_names": f"SELECT name, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all({_BARE}, '<[a-zA-Z][a-zA-Z0-9]*(?: class=\"[^\"]*\")?'), lambda t: regexp_extract(t, '<([a-zA-Z0-9]+)', 1) || CASE WHEN t LIKE '% class=%' THEN '.' || regexp_extract(t, '\"([^\"]*)\"', 1) ELSE '' END)) AS name FROM pages) GROUP BY name",
}
