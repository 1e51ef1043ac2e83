"""Line dedup over levelled sorted runs of line hashes.

A batch of documents becomes a run: one row for each line key (two 64-bit hashes) with the number of documents
that hold it and the largest of their ids, sorted by hash. Before it is added, a new batch is merge-anti-joined with
the runs: a key that one of them has in enough documents, with an id at least as large as the batch's largest, is
settled, and the batch adds nothing for it. New runs form level 0; when a level holds FANOUT runs, they are merged into
one of the next level, so a key is rewritten once a level. When all batches are in, the keys that enough
documents hold are merge-joined with the lines of the documents, which lose those lines everywhere but in the largest id.

A whole table is dealt to batches by the hash of the id, so all rows of an id are in one batch, whatever files or plan the
table comes from. Two keys are taken for one if both hashes agree, by chance once in 2 ** 128 pairs of keys.

Everything is DataFrame operations. Counting is combined before the shuffle, so a line of every document is one
row a task; the joins are plain sort-merge joins that adaptive execution can split.

Defined cases: a null or empty text is one empty line; a key is the line without [\\x20\\x09-\\x0D] at its ends,
A-Z lower-cased; rows that share an id count as one document, as do all rows without one, and all rows of the largest id
keep the line; a null id is below all others; repeated rows are treated alike; other columns
pass through, but for those of RESERVED names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm._storage import Scratch

MIN_CHARS, MIN_DOCS = 20, 3
#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Batches that a whole table is dealt to.
BATCHES = 4
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Columns of these names are replaced.
RESERVED = ("_id", "_batch", "_text", "_text2", "_gone", "_lines", "_kept", "_n_lines", "_n_dropped")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The key of each line of a text. Trimming is a pass of its own, so that lowering repeats none of it."""
    bare = F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(WHITE)))
    # lower() equals A-Z lower-casing where every character is one byte, and is the faster.
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def hash_of(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _hashes(text: Column, min_chars: int) -> Column:
    """Distinct hashes of a text's keys: sorted, then those that differ from the one before."""
    keys = F.filter(keys_of(text), lambda k: F.length(k) >= min_chars)
    return F.array_sort(F.transform(keys, hash_of))


class LineRuns:
    """The runs of one job, in a shared folder."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, fanout: int = FANOUT, scratch: Scratch | None = None):
        self.spark, self.min_chars, self.min_docs, self.fanout = spark, min_chars, min_docs, fanout
        self.scratch = scratch or Scratch(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.made = 0

    def counted(self, docs: DataFrame, key: str = "doc_id", text: str = "text", *by: str) -> DataFrame:
        """(by, h1, h2, n, last): in how many documents each key is, and the largest of their ids."""
        each = docs.select(*by, F.col(key).alias("_id"), _hashes(F.col(text), self.min_chars).alias("_all"))
        once = each.select(*by, "_id", F.filter("_all", lambda x, i: (i == 0) | (x != F.get("_all", i - 1))).alias("_all"))
        # An outer explode: for an inner one the optimizer tests beforehand that the array has elements, which
        # would compute it twice.
        rows = once.select(*by, "_id", F.explode_outer("_all").alias("_h")).filter(F.col("_h").isNotNull())
        # Rows that share an id are one document. Counts are combined before the shuffle, so a frequent key is a row a task.
        return rows.select(*by, "_h.h1", "_h.h2", "_id").distinct().groupBy(*by, "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last"))

    def _store(self, run: DataFrame, level: int) -> None:
        label = f"run{self.made}"
        self.made += 1
        self.scratch.write(run.sortWithinPartitions("h1", "h2"), label)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(label)

    def add(self, batch: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Add the run of a batch of documents. No id may stand in two batches."""
        self.add_counted(self.counted(batch, key, text))

    def add_counted(self, batch: DataFrame) -> None:
        """Add the keys of a batch that no run has settled, then merge levels that are full."""
        self._store(self.unsettled(batch), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows (h1, h2, n, last) of ``batch`` that can still change what is kept: a merge anti-join with each run."""
        for label in (x for level in self.levels for x in level):
            run = self.spark.read.parquet(self.scratch.path(label)).filter(F.col("n") >= self.min_docs).select(F.col("h1").alias("_r1"), F.col("h2").alias("_r2"), F.col("last").alias("_last"))
            batch = batch.join(run.hint("merge"), (F.col("h1") == F.col("_r1")) & (F.col("h2") == F.col("_r2")) & (F.col("_last") >= F.col("last")), "left_anti")
        return batch

    def _merge(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._store(self._resolved(old), level + 1)
        for label in old:
            self.scratch.drop(label)

    def _resolved(self, labels: list[str]) -> DataFrame:
        runs = self.spark.read.parquet(*[self.scratch.path(x) for x in labels])
        return runs if len(labels) == 1 else runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def keys(self) -> DataFrame | None:
        """All keys so far: h1, h2, n, last; None without a run. Of settled keys, n may leave out later documents."""
        labels = [x for level in self.levels for x in level]
        return self._resolved(labels) if labels else None

    def repeated(self) -> DataFrame | None:
        """The keys that at least ``min_docs`` documents hold, written once."""
        keys = self.keys()
        return None if keys is None else self.scratch.write(keys.filter(F.col("n") >= self.min_docs).select("h1", "h2", "last"), "repeated")


def drop_repeated(docs: DataFrame, repeated: DataFrame | None, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with _kept (text without the dropped lines), _n_lines and _n_dropped.

    A document is told by its id and a hash of its text, so rows that share an id are judged by their own lines.
    """
    docs = docs.drop(*RESERVED)
    each = docs.withColumn("_text", F.xxhash64(text))
    if repeated is None:
        gone = None
    else:
        at = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text"), F.posexplode_outer(keys_of(F.col(text))).alias("_pos", "_key"))
        at = at.filter(F.length("_key") >= min_chars).select("_id", "_text", "_pos", hash_of(F.col("_key")).alias("_h")).select("_id", "_text", "_pos", "_h.h1", "_h.h2")
        lost = at.join(repeated, ["h1", "h2"]).filter(F.coalesce(F.col("_id") != F.col("last"), F.lit(True)) & F.col("last").isNotNull())
        gone = lost.groupBy("_id", "_text").agg(F.collect_list("_pos").alias("_gone")).select("_id", F.col("_text").alias("_text2"), "_gone")
    if gone is None:
        each = each.withColumn("_gone", F.array().cast("array<int>"))
    else:
        each = each.join(gone, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_text2")), "left").drop("_id", "_text2")
    each = each.withColumn("_lines", lines_of(F.col(text)))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.array_except(places, F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    dropped = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_lines") - F.size(stay)).cast("long")
    return each.select(*docs.columns, kept.alias("_kept"), F.size("_lines").cast("long").alias("_n_lines"), dropped.alias("_n_dropped"))


def dedup_table(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """All batches of a table through the runs, then ``drop_repeated``. The lines are hashed and counted in one pass."""
    runs = LineRuns(docs.sparkSession, min_chars, min_docs)
    dealt = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("_batch"))
    counted = runs.counted(dealt, "_id", "_text", "_batch")
    path = runs.scratch.path("counted")
    counted.write.partitionBy("_batch").parquet(path)
    whole = docs.sparkSession.read.schema(counted.schema).parquet(path)
    for batch in range(batches):
        runs.add_counted(whole.filter(F.col("_batch") == batch).drop("_batch"))
    return drop_repeated(docs, runs.repeated(), key, text, min_chars)
