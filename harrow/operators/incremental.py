"""Detections that follow pages as they change, without judging again what has not changed.

The state of a set of pages is three tables in a folder, each split by BUCKETS of the page: ``rows``, which nodes were
judged, by what rules can see of them; ``hits``, what rules of single nodes said of those; and ``found``, the detections with a
digest of their page. A batch of new versions of pages touches its own buckets alone. In it

* a page whose digest is that of before keeps its detections as they are;
* of the other pages, nodes that look as one of the page did before are joined with what was said of it, wherever they now
  stand, and only nodes that look new are judged by the rules of single nodes (the delta);
* outermost and innermost hits are settled again over the places that hits have now, and rules that look at several nodes run on changed pages alone.

The result equals judging all pages anew. A new version without html, or without nodes, takes a page out. In a stream ``follow`` does
this for each micro-batch; of several versions of a page in one batch the last by ``version`` counts. A batch that is
repeated after a failure finds its pages unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.operators import page_rules
from harrow.session import shared_table
from harrow.sources import html

BUCKETS = 64
#: Columns of a node by which rules of single nodes judge it.
SEEN = ("kind", "tag", "text", "in_non_content", "in_svg", "in_form", "in_article", "n_children", "text_content", "text_len", "whole_text", "url")
TABLES = {
    "rows": "page_id long, k1 long, k2 long, bucket int",
    "hits": "page_id long, k1 long, k2 long, rule_id string, post string, evidence string, bucket int",
    "found": "page_id long, digest long, n_nodes long, rule_id string, node_id int, evidence string, bucket int",
}


def bucket(page: Column) -> Column:
    return F.pmod(F.xxhash64(page), F.lit(BUCKETS)).cast("int")


def looked_at(nodes: DataFrame) -> DataFrame:
    """Nodes with k1 and k2, 128 bits that say what rules can see of them; their places are left out."""
    attrs = F.array_sort(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))))
    # Nulls are skipped by a hash, so they are marked.
    seen = [*SEEN, F.array(*[F.col(c).isNull() for c in SEEN]), attrs]
    return nodes.withColumns({"k1": F.xxhash64(*seen), "k2": F.xxhash64(F.lit(1), *seen)})


def digests(nodes: DataFrame) -> DataFrame:
    """page_id, digest and n_nodes: equal for pages whose nodes look alike and stand in the same places."""
    each = F.xxhash64("k1", "k2", "pre", "end", "depth", "parent_id", "grp", "nearest_block")
    return nodes.groupBy("page_id").agg(F.bit_xor(each).alias("digest"), F.count(F.lit(1)).alias("n_nodes"))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the state; one that was never written is empty."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], TABLES[name])


def detections(spark: SparkSession, path: str) -> DataFrame:
    """page_id, rule_id, node_id and evidence as they stand."""
    return read(spark, path, "found").filter("rule_id IS NOT NULL").select("page_id", "rule_id", "node_id", "evidence")


def update(pages: DataFrame, path: str, rules: list | None = None) -> dict[str, int]:
    """Take in new versions of ``pages`` (page_id, url, html); the numbers of pages given and changed and of nodes judged."""
    spark = pages.sparkSession
    chosen = [r for r in (page_rules.RULES if rules is None else rules) if r.run and (rules is not None or r.default_on)]
    local = [r for r in chosen if isinstance(r.run, page_rules.Local)]
    other = [r for r in chosen if r not in local]
    given = shared_table(pages.select("page_id").distinct(), "given")
    nodes = shared_table(looked_at(html.nodes(pages, url="url")), "nodes")
    touched = sorted(r.b for r in given.select(bucket(F.col("page_id")).alias("b")).distinct().collect())
    if not touched:
        return {"pages": 0, "changed": 0, "judged": 0}
    before = {name: read(spark, path, name).filter(F.col("bucket").isin(touched)) for name in TABLES}
    now = digests(nodes)
    same = before["found"].select("page_id", "digest", "n_nodes").distinct().join(now, ["page_id", "digest", "n_nodes"]).select("page_id")
    changed = shared_table(given.join(same, "page_id", "left_anti"), "changed")
    delta = nodes.join(changed, "page_id", "left_semi")
    # What looks as before was judged before; what looks new is judged, once for each look.
    looks = ["page_id", "k1", "k2"]
    fresh = shared_table(delta.join(before["rows"], looks, "left_anti").dropDuplicates(looks), "fresh")
    kept = before["hits"].join(changed, "page_id", "left_semi").select(*looks, "rule_id", "post", "evidence")
    said = kept.unionByName(page_rules.local_hits(fresh, local, *looks)) if local else kept
    here = delta.select(*looks).distinct()
    said = shared_table(said.join(here, looks, "left_semi"), "said")
    placed = page_rules.settled(delta.select(*looks, "node_id", "pre", "end").join(said, looks)).select("page_id", "rule_id", "node_id", "evidence")
    parts = [placed, *(r.run(delta).select("page_id", F.lit(r.rule_id).alias("rule_id"), "node_id", "evidence") for r in other)]
    found = reduce(DataFrame.unionByName, parts)
    # A page without detections has one row, for its digest.
    found = now.join(changed, "page_id", "left_semi").join(found, "page_id", "left").select("page_id", "digest", "n_nodes", "rule_id", "node_id", "evidence")
    new = {"rows": here, "hits": said, "found": found}
    # A bucket is replaced as a whole, by what it held of other pages and what is new of the changed ones.
    after = {n: before[n].join(changed, "page_id", "left_anti").select(*new[n].columns).unionByName(new[n]).withColumn("bucket", bucket(F.col("page_id"))) for n in new}
    made = {n: shared_table(table, n) for n, table in after.items()}
    for n, table in made.items():
        _replace(table, f"{path}/{n}", touched)
    return {"pages": given.count(), "changed": changed.count(), "judged": fresh.count()}


def _replace(table: DataFrame, path: str, touched: list[int]) -> None:
    """Put ``table`` in place of the touched buckets. Those that are left empty go."""
    table.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    spark = table.sparkSession
    full = {r.bucket for r in table.select("bucket").distinct().collect()}
    place = spark._jvm.org.apache.hadoop.fs.Path
    for b in touched:
        if b not in full:
            gone = place(f"{path}/bucket={b}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each page (page_id, url, html, version); equal versions are settled by the hash of their html."""
    w = Window.partitionBy("page_id").orderBy(F.desc("version"), F.xxhash64("html"), F.xxhash64("url"))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("page_id", "url", "html")


def follow(stream: DataFrame, path: str, checkpoint: str, rules: list | None = None):
    """Keep the state in ``path`` up with a stream of versions (page_id, url, html, version); returns the running query."""

    def batch(versions: DataFrame, _: int) -> None:
        update(latest(versions), path, rules)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
