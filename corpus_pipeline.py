"""The corpus pipeline: classify, drop repeated lines, drop near-duplicates, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; n_chars follows the text.

Defined cases, for every stage: a null text is the empty text (it is scored by the bias of the classifier alone, has one
empty line, is equal to other texts without a word, holds no personal data and packs as its end token) and stays null
where a stage does not change it; rows that share an id are scored, redacted and packed one by one, count as
one document for repeated lines, and of rows with equal words one stays; rows without an id are told apart by their
text alone; ties are settled by the least id, then by the hash of the words; other columns pass through all stages but packing, also those
with names that a stage uses itself; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import line_dedup, minhash, packing, pii, quality
from harrow.llm._storage import Scratch
from harrow.llm.queries import table, vocabulary


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of the given names set aside, and what gives them their names back."""
    moved = {c: f"{c} (of the documents)" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({v: k for k, v in moved.items()})


def _with_text(docs: DataFrame, text) -> DataFrame:
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    docs, back = _aside(docs, "_quality")
    return back(quality.accepted(docs, model))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat across them; the text may become empty."""
    docs, back = _aside(docs, *line_dedup.RESERVED)
    columns = docs.columns
    made = line_dedup.dedup_table(docs)
    return back(_with_text(made, F.col("_kept")).select(columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    docs, back = _aside(docs, *minhash.RESERVED)
    return back(minhash.one_of_each(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind in brackets."""
    docs, back = _aside(docs, *pii.RESERVED)
    columns = docs.columns
    found = pii.find(docs)
    return back(_with_text(found, pii.redacted(F.col("text"), F.col("_spans"))).select(columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences."""
    cut = packing.pieces(docs, vocabulary("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact),
    ("packing", pack),
]

#: The classifier, the alignment and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
