"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

A paragraph is what lies between line feeds; its node is the hash of its text, beside short codes of its
segments (up to 64 characters, or to the end of a sentence). A section is a run of paragraphs that ends with
one whose hash begins with 0 or 1, so an edit moves no later border; its node is the hash of its paragraphs.
The root is the hash of the section nodes. As a string:

    root:section[paragraph(segment.segment),paragraph()];section[...]

Equal texts have equal fingerprints, and different texts different roots. ``likeness`` needs the fingerprints
alone: 1 for equal ones, else Dice's coefficient of the distinct segment codes. ``differing`` tells the sections
and paragraphs of the one that the other lacks.

Defined cases: a null text is the empty text, which has one empty paragraph; ``with_next`` orders equal ids by
the hash of their text and puts null ids first; a lone row follows itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm._storage import Scratch

SEGMENT = "[^.!?]{1,64}[.!?]*"
#: Rows that stand together when each row looks for the next one.
RUN_ROWS, RANGES, PARTS = 500, 256, 4096


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string."""

    def paragraph(p: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(p, F.lit(SEGMENT), F.lit(0)), lambda s: F.substring(F.md5(s), 1, 8))
        return F.concat(F.substring(F.sha2(p, 256), 1, 32), F.lit("("), F.array_join(codes, "."), F.lit(")"))

    nodes = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), paragraph)
    ended = F.transform(nodes, lambda n: F.when(F.substring(n, 1, 1).isin("0", "1"), F.concat(n, F.lit(";"))).otherwise(F.concat(n, F.lit(","))))
    body = F.regexp_replace(F.array_join(ended, ""), "[,;]$", "")
    sections = F.transform(F.split(body, ";", -1), lambda s: F.concat(F.substring(F.sha2(s, 256), 1, 32), F.lit("["), s, F.lit("]")))
    tree = F.array_join(sections, ";")
    return F.concat(F.sha2(tree, 256), F.lit(":"), tree)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def segments(print_: Column) -> Column:
    """Distinct segment codes of a fingerprint."""
    inner = F.regexp_extract_all(print_, F.lit(r"\(([0-9a-f.]+)\)"), F.lit(1))
    return F.array_distinct(F.split(F.array_join(inner, "."), r"\."))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprints."""
    x, y = F.array_remove(segments(a), ""), F.array_remove(segments(b), "")
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when(a == b, F.lit(1.0)).when(F.size(x) + F.size(y) == 0, F.lit(0.0)).otherwise(2 * both / (F.size(x) + F.size(y)))


def differing(a: Column, b: Column) -> Column:
    """Nodes of ``a``'s sections and paragraphs that ``b`` lacks; empty for equal roots."""
    nodes = lambda f, pattern: F.regexp_extract_all(f, F.lit(pattern), F.lit(1))
    pick = lambda pattern: F.array_except(nodes(a, pattern), nodes(b, pattern))
    return F.struct(pick(r"([0-9a-f]{32})\[").alias("sections"), pick(r"([0-9a-f]{32})\(").alias("paragraphs"))


def _range_of(key: Column, bounds: list) -> Column:
    """Number of bounds at or below the key, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(0)

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def with_next(docs: DataFrame, key: str, columns: list[str], run_rows: int = RUN_ROWS) -> DataFrame:
    """``docs`` with next_<column> of the row that follows by ascending ``key``; the first follows the last.

    The ids are cut into ranges of about ``run_rows`` rows, a range is sorted in one task, and what follows a
    range is the first row of the next one. ``key`` must be a number.
    """
    total = docs.count()
    wanted = max(1, -(-total // run_rows))
    ranges = min(wanted, RANGES)
    found = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("b"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    bounds = sorted(set(found["b"] or [])) if ranges > 1 else []
    # Within a range, equal widths.
    parts = min(-(-wanted // ranges), PARTS)
    lows = [found["low"] or 0, *bounds]
    widths = [max(1, b - a) for a, b in zip(lows, [*bounds, (found["high"] or 0) + 1], strict=True)]
    at = _range_of(F.col(key), bounds)
    within = F.lit(0) if parts == 1 else F.least(F.lit(parts - 1), F.floor((F.col(key) - F.get(F.array(*map(F.lit, lows)), F.col("_range"))) * parts / F.get(F.array(*map(F.lit, widths)), F.col("_range"))))
    dealt = docs.withColumn("_range", at).withColumn("_run", F.col("_range").cast("long") * PARTS + F.coalesce(within, F.lit(0))).withColumn("_tie", F.xxhash64(*columns)).drop("_range")

    order = ["_run", key, "_tie", *columns]
    firsts = Scratch(docs.sparkSession, "next").write(dealt.groupBy("_run").agg(F.min(F.struct(*order)).alias("_first")), "firsts")
    # One row for each range: few, whatever the rows are.
    follow = firsts.select("_run", F.lead("_run").over(Window.orderBy("_run")).alias("_then"))
    lowest = firsts.agg(F.min("_run").alias("_lowest"))
    follow = follow.crossJoin(F.broadcast(lowest)).select("_run", F.coalesce("_then", "_lowest").alias("_then"))
    edge = follow.join(firsts.select(F.col("_run").alias("_then"), "_first"), "_then").select("_run", *[F.col(f"_first.{c}").alias(f"_edge_{c}") for c in columns])

    window = Window.partitionBy("_run").orderBy(F.col(key).asc_nulls_first(), "_tie")
    led = dealt.withColumns({f"_lead_{c}": F.lead(c).over(window) for c in columns} | {"_end": F.lead(F.lit(1)).over(window).isNull()})
    joined = led.join(edge, "_run")
    return joined.select(*docs.columns, *[F.when(F.col("_end"), F.col(f"_edge_{c}")).otherwise(F.col(f"_lead_{c}")).alias(f"next_{c}") for c in columns])


def edited_prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text, its edited text (its last half replaced by the start of the next one's) and their likenesses."""
    base = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base.withColumn("fingerprint", fingerprint(F.col("_text")))
    both = with_next(base, key, ["_text", "fingerprint"])
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring("next__text", F.lit(1), half))
    both = both.select(key, n.cast("long").alias("n_chars"), "fingerprint", F.col("next_fingerprint").alias("_next"), edited.alias("_edited"))
    both = both.select(key, "n_chars", "fingerprint", "_next", F.sha2("_edited", 256).alias("edited_sha256"), fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    return both.select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
