"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. They are turned by a fixed random rotation, which spreads
any structure evenly, and cut into BLOCKS blocks of few dimensions. If a pair lies within the whole budget, in
one block at least it lies within that block's share. So each block is range-joined by itself and what it finds is
verified by the cosine of the whole vectors in double precision; a pair counts in the first block that admits it alone.

A label of at most CELL vectors is one task's work, which range-joins all blocks. A larger one is halved in each block
until cells are about that large, by medians of the block's dimensions. Of a cut, vectors below it by no more than the block's radius visit the
upper side too, and the cuts that a vector visits across are bits of a number: two vectors meet in the one cell that both
are in and where their numbers share no bit. Medians come from SAMPLE vectors of least hash; they decide how even
the cells are, not what is found. A cell of more than TILE vectors is dealt in tiles of pairs of parts.

Equal vectors of a label are one node with a weight. A cell returns, for each vector, the weight of its links and
the least vector that it is connected to, so thousands of near copies give rows in proportion; pairs are kept
for CHUNK vectors at a time alone.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
label, have no links and are components of their own; vectors of unlike lengths are not compared; repeated rows
count as other vectors; finite numbers of any size are scaled first; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm._components import components
from harrow.llm._storage import Scratch

COSINE, BLOCKS, SEED = 0.98, 8, 3
CELL, TILE, CHUNK = 4_000, 4_096, 256
#: Vectors from which cuts are taken, and cuts one below the other at most.
SAMPLE, DEPTH = 20_000, 16
#: In one task a block's pairs are looked at one by one if there are fewer than one of so many.
SPARSE = 16
SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may take, in proportion to its dimensions."""
    return np.array([(2 - 2 * cosine) * (s.stop - s.start) / dim for s in blocks_of(dim)])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _radius(budget: float) -> float:
    return float(np.sqrt(budget)) + SLACK


def cuts_of(turned: np.ndarray, depth: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each block, the order of its dimensions by spread and the medians of each level, one for each cell."""
    out = []
    for part in blocks_of(turned.shape[1]):
        x = turned[:, part]
        dims, levels, cell = np.argsort(-x.var(axis=0)), [], np.zeros(len(x), np.int64)
        for level in range(depth):
            v = x[:, dims[level % len(dims)]]
            order = np.lexsort((v, cell))
            start = np.searchsorted(cell[order], np.arange(1 << level))
            end = np.searchsorted(cell[order], np.arange(1 << level), side="right")
            medians = np.where(end > start, v[order][np.minimum((start + end) // 2, len(v) - 1)], 0.0)
            levels.append(medians)
            cell = 2 * cell + (v >= medians[cell])
        out.append((dims, levels))
    return out


def _places(turned: np.ndarray, depth: np.ndarray, cosine: float, cuts: list):
    """(row, block, cell, visits) of every vector in every block; block -1 stands for all of them in a label without cuts."""
    whole = np.flatnonzero(depth == 0)
    yield whole, -1, np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64)
    for b, budget in enumerate(budgets(turned.shape[1], cosine)):
        x, radius = turned[:, blocks_of(turned.shape[1])[b]], _radius(budget)
        rows = np.flatnonzero(depth > 0)
        cell, visits = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for level in range(int(depth.max(initial=0))):
            ended = depth[rows] <= level
            if ended.any():
                yield rows[ended], b, cell[ended], visits[ended]
                rows, cell, visits = rows[~ended], cell[~ended], visits[~ended]
            dims, levels = cuts[b]
            v, cut = x[rows, dims[level % len(dims)]], levels[level][cell]
            also = (v < cut) & (v >= cut - radius)
            cell, rows, visits = np.r_[2 * cell + (v >= cut), 2 * cell[also] + 1], np.r_[rows, rows[also]], np.r_[visits, visits[also] | (1 << level)]
        yield rows, b, cell, visits


def _join(to: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``to``, which points each vector to the least of its component, with p and q connected."""
    while True:
        a, b = to[p], to[q]
        apart = a != b
        if not apart.any():
            return to
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]


def linked(weight: np.ndarray, visits: np.ndarray, part: np.ndarray | None, x: np.ndarray, block: int, cosine: float):
    """(links, to): the weight linked to each vector of a cell in this block, or in any for -1, and the least connected vector."""
    dim, n = x.shape[1], len(x)
    turned, limit = x @ rotation(dim), budgets(dim, cosine) + SLACK
    subs = [np.ascontiguousarray(turned[:, s]) for s in blocks_of(dim)]
    squares = [(sub * sub).sum(axis=1) for sub in subs]
    links, to = np.zeros(n, np.int64), np.arange(n)
    for b in range(len(subs)) if block < 0 else [block]:
        # A range join: in the order of the block's first dimension, what lies within its radius follows.
        order = np.argsort(subs[b][:, 0], kind="stable")
        first, reach = subs[b][order, 0], _radius(limit[b])
        for at in range(0, n, CHUNK):
            stop = min(at + CHUNK, n)
            i, j = order[at:stop], order[at : np.searchsorted(first, first[stop - 1] + reach, side="right")]
            near = squares[b][i, None] + squares[b][None, j] - 2 * subs[b][i] @ subs[b][j].T <= limit[b]
            near &= np.arange(len(j))[None, :] > np.arange(len(i))[:, None]
            near &= (visits[i, None] & visits[None, j]) == 0
            if part is not None:
                near &= part[i, None] != part[None, j]
            if near.sum() * SPARSE < near.size:
                p, q = np.nonzero(near)
                p, q = i[p], j[q]
                for c in range(b):
                    later = squares[c][p] + squares[c][q] - 2 * np.einsum("ij,ij->i", subs[c][p], subs[c][q]) > limit[c]
                    p, q = p[later], q[later]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[good], q[good]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
            else:
                for c in range(b):
                    near &= squares[c][i, None] + squares[c][None, j] - 2 * subs[c][i] @ subs[c][j].T > limit[c]
                near &= x[i] @ x[j].T >= cosine
                links[i] += near @ weight[j]
                links[j] += weight[i] @ near
                p, q = np.nonzero(near)
                p, q = i[p], j[q]
            to = _join(to, p, q)
    return links, to


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """key, n_links, component_id and kept of every row."""
    scratch = Scratch(vectors.sparkSession, "embedding")
    e = F.col("_e")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(embedding).alias("_e"))
    rows = rows.withColumn("_good", F.coalesce(finite & F.exists(e, lambda x: x != 0) & F.col("_label").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"k1": F.xxhash64("_label", "_e"), "k2": F.xxhash64(F.lit(1), "_label", "_e")})
    good = rows.filter("_good")
    nodes = good.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("weight"), F.min("_id").alias("least"), F.first("_label").alias("label"), F.first("_e").alias("e"))
    # Vectors of a length are compared with each other alone.
    nodes = scratch.write(nodes.withColumn("u", F.monotonically_increasing_id()).withColumn("label", F.concat_ws(":", F.size("e"), "label")), "nodes")
    # Halvings that a label needs. A label of its own size is a row, so this join sorts.
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    halvings = F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / CELL)))).cast("int")
    sizes = scratch.write(sizes.select("label", halvings.alias("depth")), "depths")
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    cuts: dict[int, list] = {}
    if deepest:
        some = [r["e"] for r in nodes.orderBy(F.xxhash64("u"), "u").limit(SAMPLE).select("e").collect()]
        for size in {len(x) for x in some}:
            cuts[size] = cuts_of(_unit(np.array([x for x in some if len(x) == size], np.float64)) @ rotation(size), deepest)

    def deal(batches):
        for batch in batches:
            column, depth = batch.column(3), batch.column(4).to_numpy()
            lengths = np.diff(column.offsets.to_numpy())
            starts, values = column.offsets.to_numpy()[:-1], column.values.to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                turned = _unit(values[starts[at][:, None] + np.arange(size)].astype(np.float64)) @ rotation(int(size))
                zeros = [(np.arange(b.stop - b.start), [np.zeros(1 << k) for k in range(deepest)]) for b in blocks_of(int(size))]
                few = batch.select([0, 1, 2, 3]).take(pa.array(at))
                for which, block, cell, visits in _places(turned, depth[at], cosine, cuts.get(int(size), zeros)):
                    got = few.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.full(len(which), block, np.int32)), pa.array(cell), pa.array(visits)], names=["u", "weight", "label", "e", "block", "cell", "visits"])

    kind = nodes.schema["e"].dataType.simpleString()
    dealt = nodes.join(sizes, "label").select("u", "weight", "label", "e", "depth").mapInArrow(deal, f"u long, weight long, label string, e {kind}, block int, cell long, visits long")
    where = ["label", "block", "cell"]
    crowds = dealt.drop("e").groupBy(*where).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > TILE)
    crowded = scratch.write(crowds, "crowded")
    if crowded.isEmpty():
        tiled = dealt.withColumns({"part": F.lit(0), "low": F.lit(0), "high": F.lit(0)})
    else:
        counted = dealt.join(crowded, where, "left").withColumn("parts", F.coalesce(F.ceil(F.col("size") / TILE), F.lit(1)).cast("int"))
        counted = counted.withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
        counted = counted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        tiled = counted.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("size", "parts", "other")

    def meet(pairs: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("u", ignore_index=True)
        u = frame["u"].to_numpy()
        part = frame["part"].to_numpy() if pairs[3] != pairs[4] else None
        x = _unit(np.stack(frame["e"].to_list()).astype(np.float64))
        links, to = linked(frame["weight"].to_numpy(), frame["visits"].to_numpy(), part, x, int(pairs[1]), cosine)
        some = links > 0
        return pd.DataFrame({"u": u[some], "links": links[some], "to": u[to[some]]})

    met = scratch.write(tiled.groupBy(*where, "low", "high").applyInPandas(meet, "u long, links long, to long"), "met")
    roots = components(met.select(F.col("u").alias("a"), F.col("to").alias("b")), scratch, "parts")
    counts = met.groupBy("u").agg(F.sum("links").alias("links"))
    named = nodes.select("u", "k1", "k2", "weight", "least").join(counts, "u", "left")
    if roots is None:
        named = named.withColumn("root", F.col("u"))
    else:
        named = named.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    named = scratch.write(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answers = scratch.write(named.join(least, "root").select("k1", "k2", F.lit(True).alias("_good"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id"), "answers")
    out = rows.drop("_e", "_label").join(answers, ["k1", "k2", "_good"], "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("_id") == component).alias("kept"))
