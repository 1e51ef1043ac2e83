"""Connected components of links between numbers, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm._storage import Scratch

#: Links that a task connects at once.
LINKS = 1 << 20


def _forest(links: DataFrame) -> DataFrame:
    """The links (a, b), those of a task replaced by one from each node to the one of least hash that it is connected to there.

    Links of LINKS rows at a time are connected, so a task's memory has a bound; what is connected stays so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(4)])
            n += len(batch)
            if n >= LINKS:
                yield _stars(held)
                held, n = [], 0
        if held:
            yield _stars(held)

    return links.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb")).mapInArrow(run, "a long, b long")


def _stars(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    a, b, ha, hb = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, first = np.unique(np.concatenate([a, b]), return_index=True)
    rank = np.lexsort((nodes, np.concatenate([ha, hb])[first]))
    place = np.empty(len(nodes), np.int64)
    place[rank] = np.arange(len(nodes))
    p, q = (place[np.searchsorted(nodes, x)] for x in (a, b))
    to = np.arange(len(nodes))
    while True:
        x, y = to[p], to[q]
        apart = x != y
        if not apart.any():
            break
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
    moved = np.flatnonzero(to != np.arange(len(to)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[rank[moved]]), pa.array(nodes[rank[to[moved]]])], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """(node, root) of every node of ``links`` (columns a, b); None without links.

    In each round a task first connects the links that it holds. Then a node points to the one of least hash among itself and
    its neighbours, and links are carried over to what their ends point to, until none is left. Hashes make a long chain shrink
    by a fixed share each round, whatever its numbers. Each round is written; only counts reach the driver.
    """
    edges = scratch.write(_forest(links.filter("a <> b")), f"{name}-edges0")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(steps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("u"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("_least"))
        to = to.select(F.col("a").alias("node"), F.least("_least", rank("a"))["u"].alias("to"))
        to = scratch.write(to, f"{name}-to{k}")
        steps.append(to)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(to.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end + "2")
        moved = ends.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = scratch.write(_forest(scratch.write(moved, f"{name}-moved{k}")), f"{name}-edges{k + 1}")
    if not steps:
        return None
    root = steps[-1].withColumnRenamed("to", "root")
    for step in reversed(steps[:-1]):
        up = root.withColumnRenamed("node", "to")
        root = step.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return scratch.write(root, f"{name}-roots") if len(steps) > 1 else root
