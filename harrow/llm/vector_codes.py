"""Product codes of vectors by Yinyang Lloyd in whole numbers.

Vectors are cut into PARTS equal parts; each part position has a codebook of at most ENTRIES entries, which starts as
that part of the vectors of the smallest ids and is moved by ROUNDS rounds of Lloyd. The entries of a codebook are clustered once
into groups of about GROUP. Each vector keeps, for every part, its entry and one lower bound for each group: no entry of
the group but its own is nearer than that. A round lowers the bounds by the largest drift in the group, computes the exact distance to the own
entry and scans only groups whose bound does not lie above it; scanned groups get new bounds. Bounds are
floating-point and rounded down, distances are whole numbers, so ties are settled exactly, by the lower index.

A round is one pass over the rows without a shuffle: a task writes its rows with their new entries and bounds, and beside
them its sums for each entry, of which the driver adds up the totals (PARTS x ENTRIES rows). The rows of the round before are dropped.
Errors are summed for each label before the sums meet the rows again; labels that hold over a HOT-th of the rows are
fewer than HOT, and their sums are broadcast, so no label's rows come together in a task.

Defined cases: vectors that are null or hold null or non-finite components are dropped; fewer vectors than ENTRIES give
smaller codebooks; vectors whose length is not that of the vector of the smallest id, or no multiple of PARTS, have a null code and error
and count in no sum; ties in the id are settled by the components; repeated rows and null ids (last in order) are vectors of their own; components are cut off
where squared distances would pass 2 ** 63 (``floored``); other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm._storage import Scratch
from harrow.llm._vectors import finite, floored

PARTS, ENTRIES, ROUNDS, SCALE, GROUP = 4, 256, 4, 1024, 16
#: A label with a larger share of the rows than one of so many has its sum broadcast.
HOT = 512
MOST = np.iinfo(np.int64).max


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two arrays of whole numbers, as a table."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None].astype(np.int64) - y[None, :, k]
        out += d * d
    return out


def entry_groups(book: np.ndarray, size: int = GROUP, rounds: int = 5) -> list[np.ndarray]:
    """The entries of a codebook in groups of about ``size`` near ones, each in ascending order."""
    n = max(1, len(book) // size)
    centres = book[np.linspace(0, len(book) - 1, n).astype(int)].astype(np.float64)
    for _ in range(rounds):
        of = ((book[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([book[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(n)])
    return [m for g in range(n) if len(m := np.flatnonzero(of == g))]


def _below(bound: np.ndarray) -> np.ndarray:
    """Lower bounds as 32-bit numbers that lie below."""
    return np.nextafter((bound * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def nearest(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], code: np.ndarray | None = None, lower: np.ndarray | None = None, drift: np.ndarray | None = None):
    """(code, error, lower, scanned): the nearest entry of each row with the lower index of equals, its squared distance,
    the bounds of the groups and how many (row, group) were scanned. ``code`` and ``lower`` are those of the round
    before and ``drift`` is how far the entries of each group have moved at most since."""
    n, rows = len(x), np.arange(len(x))
    if code is None:
        best, own, bound = np.full(n, MOST), np.full(n, len(book)), np.zeros((n, len(groups)))
    else:
        own, moved = code.astype(np.int64), x - book[code]
        best, bound = (moved * moved).sum(axis=1), lower.astype(np.float64) - drift
    first_code, first_best = own.copy(), best.copy()
    upper = np.sqrt(best.astype(np.float64)) * (1 + 1e-9)
    scan = bound <= upper[:, None]
    second, group_of = np.zeros((n, len(groups))), np.zeros(len(book) + 1, np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        d, some = squared(x[at], book[members]), rows[: len(at)]
        near = d.argmin(axis=1)
        least, entry = d[some, near], members[near]
        d[some, near] = MOST
        bound[at, g], second[at, g] = np.sqrt(least.astype(np.float64)), np.sqrt(d.min(axis=1).astype(np.float64))
        better = (least < best[at]) | ((least == best[at]) & (entry < own[at]))
        best[at[better]], own[at[better]] = least[better], entry[better]
    if code is not None:
        # The entry of before is none of the others any more where a nearer one in another group was found.
        left = np.flatnonzero((own != first_code) & ~scan[rows, group_of[first_code]])
        g = group_of[first_code[left]]
        bound[left, g] = np.minimum(bound[left, g], np.sqrt(first_best[left].astype(np.float64)))
    of = group_of[own]
    found = scan[rows, of]
    bound[rows[found], of[found]] = second[rows[found], of[found]]
    return own, best, _below(bound), int(scan.sum())


def _values(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assign(books: np.ndarray, groups: list[list[np.ndarray]], drifts: list[np.ndarray] | None, last: bool):
    """Columns of a batch (id, label, q, code, lower) to those with new entries; at the end the sums for each entry."""
    parts, entries, width = books.shape
    ends = np.cumsum([0, *map(len, groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, scanned = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _values(batch.column(2), parts * width).astype(np.int64).reshape(-1, parts, width)
            before = None if drifts is None else (_values(batch.column(3), parts), _values(batch.column(4), ends[-1]))
            codes, errors, lowers = [], 0, []
            for p in range(parts):
                state = () if before is None else (before[0][:, p], before[1][:, ends[p] : ends[p + 1]], drifts[p])
                code, error, lower, n = nearest(np.ascontiguousarray(q[:, p]), books[p], groups[p], *state)
                codes.append(code)
                errors = errors + error
                lowers.append(lower)
                scanned += n
                if not last:
                    counts[p] += np.bincount(code, minlength=entries)
                    np.add.at(sums[p], code, q[:, p])
            code = np.stack(codes, axis=1)
            if last:
                yield _batch(_LAST, batch.column(0), batch.column(1), pa.array([bytes(c).hex() for c in code.astype(np.uint8)]), pa.array(errors, pa.int64()))
            else:
                yield _batch(_STATE, batch.column(0), batch.column(1), batch.column(2), _lists(code.astype(np.int32), pa.int32()), _lists(np.concatenate(lowers, axis=1), pa.float32()), *[None] * 5, n=len(q))
        if counts.any():
            part, entry = np.nonzero(counts)
            some = (pa.array(a) for a in (part.astype(np.int32), entry.astype(np.int32), counts[part, entry]))
            yield _batch(_STATE, *[None] * 5, *some, _lists(sums[part, entry], pa.int64()), pa.array([scanned] + [0] * (len(part) - 1), pa.int64()), n=len(part))

    return run


#: Columns that a round returns, with their Arrow types: those of a vector, then those of an entry's sums.
_STATE = {"id": pa.int64(), "label": pa.string(), "q": pa.list_(pa.int32()), "code": pa.list_(pa.int32()), "lower": pa.list_(pa.float32()), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64()), "scanned": pa.int64()}
_LAST = {"id": pa.int64(), "label": pa.string(), "code": pa.string(), "error": pa.int64()}
_STATE_SCHEMA = "id long, label string, q array<int>, code array<int>, lower array<float>, part int, entry int, n long, sums array<long>, scanned long"


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _batch(kinds: dict, *columns, n: int = 0) -> pa.RecordBatch:
    arrays = [pa.nulls(n, kind) if c is None else c.cast(kind) for c, kind in zip(columns, kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _totals(sums: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and sums of the entries over all tasks: one row for each entry comes to the driver."""
    parts, entries, width = shape
    each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = each.groupBy("part", "entry").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("x")).collect()
    counts, out = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
    for r in rows:
        counts[r.part, r.entry], out[r.part, r.entry] = r.n, r.x
    return counts, out


def codes(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, report: list | None = None) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every vector that is kept. ``report`` gets, for each round
    after the first, how many (vector, part, group) were scanned."""
    scratch = Scratch(vectors.sparkSession, "codes")
    e = F.col("_e")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("_e")).filter(finite(e))
    rows = rows.select("id", "label", floored(e, scale, 4).alias("q"))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").first()
    width = len(first.q) // parts if first else 0
    if not width or len(first.q) % parts:
        return rows.select(F.col("id").alias(key), *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    fit = F.size("q") == parts * width
    start = [r.q for r in rows.filter(fit).orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    groups, drifts = [entry_groups(b) for b in books], None
    state = rows.filter(fit).select("id", "label", "q")
    for k in range(rounds):
        table = scratch.write(state.mapInArrow(_assign(books, groups, drifts, False), _STATE_SCHEMA), f"round{k}")
        if k:
            scratch.drop(f"round{k - 1}")
        sums = table.filter("n IS NOT NULL")
        counts, totals = _totals(sums, books.shape)
        if report is not None and k:
            report.append(sums.agg(F.sum("scanned")).first()[0])
        moved = np.where(counts[:, :, None] > 0, totals // np.maximum(counts, 1)[:, :, None], books)
        far = np.sqrt(((moved - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-9)
        drifts, books = [np.array([far[p][m].max() for m in groups[p]]) for p in range(parts)], moved
        state = table.filter("n IS NULL").select("id", "label", "q", "code", "lower")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    done = scratch.write(state.mapInArrow(_assign(books, groups, drifts, True), "id long, label string, code string, error long"), "coded")
    out = _with_label_sums(done).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    other = rows.filter(~fit).select(F.col("id").alias(key), *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"))), F.lit(digest).alias("codebooks_sha256"))
    return out.unionByName(other)


def _with_label_sums(done: DataFrame) -> DataFrame:
    """``done`` with the errors summed over equal labels, nulls together."""
    sums = done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    hot = (F.col("n") * HOT > done.count()).alias("hot")
    sums = sums.select(F.col("label").alias("of"), "label_error", hot)
    same = F.col("label").eqNullSafe(F.col("of"))
    # Fewer than HOT labels hold over a HOT-th of the rows each, so this side has a bound.
    large = F.broadcast(sums.filter("hot"))
    return done.join(large, same).drop("of", "hot").unionByName(done.join(large, same, "left_anti").join(sums.filter("NOT hot"), same).drop("of", "hot"))
