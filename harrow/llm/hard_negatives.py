"""Hard negatives by a two-dimensional block matrix multiply.

Scores are integer inner products of anchors with all rows. Anchors and rows are dealt to blocks by the hash of a row
number, and a block's matrix is cut into chunks of CHUNK dimensions. A chunk of an anchor block meets the same chunk of a row block
in one task, which makes a partial tile of int64 scores; the partial tiles of two blocks are shuffled to one place and
added up. From a whole tile only the first few rows of each anchor (and window) go on, and a rank over what the tiles leave
gives the answer. It is done twice: over the blocks of each label, for the positives, and over the blocks of
all rows, for the negatives within the window that each positive opens. A tile holds ANCHORS x ROWS scores, sent in as
few bytes as its largest takes; no task holds more than one row block, one anchor block and one tile for each chunk, and
a label of any size is dealt to as many blocks as it needs.

Defined cases: rows with a null id, null label, null vector or any null or non-finite component take no part;
vectors of unlike lengths are not compared, those of no component have the score 0; repeated rows are rows of their own, and each repeated
anchor has its own answer; ties go to the smaller id; components are cut off where sums of products times 100 would pass 2 ** 63 (``floored``);
other columns are dropped; an anchor without positives, or a positive without negatives, gives no row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm._storage import Scratch
from harrow.llm._vectors import finite, floored

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 80, 100
ANCHORS, ROWS, CHUNK = 256, 1_024, 32


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of whole numbers as int64."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def narrow(x: np.ndarray) -> tuple[bytes, str]:
    """A table of whole numbers in as few bytes as its largest takes, and the type."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
    return x.astype(kind).tobytes(), kind


def first_rows(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the columns ``at``, the ``k`` of highest score, ties to the first, in that order."""
    if len(at) > k:
        some = scores[at]
        last = np.partition(some, len(at) - k)[len(at) - k]
        above, same = at[some > last], at[some == last]
        at = np.concatenate([above, same[: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


_PANEL = "space string, block long, chunk int, n int, width int, kind string, x binary, u binary, id binary, labels array<string>, windows binary"


def _panels(rows: DataFrame, chunk: int) -> DataFrame:
    """The blocks of ``rows`` (space, block, u, id, label, q and perhaps windows) as matrices, one row for each chunk of
    dimensions; the first also holds who the rows are, in the order of their ids."""

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "u"], ignore_index=True)
        q = np.stack(frame["q"].to_list()).astype(np.int64).reshape(len(frame), -1)
        windows = np.stack(frame["windows"].to_list()).astype("<i8").tobytes() if "windows" in frame else b""
        who = [frame["u"].to_numpy("<i8").tobytes(), frame["id"].to_numpy("<i8").tobytes(), frame["label"].to_list(), windows]
        out = []
        for c in range(max(1, -(-q.shape[1] // chunk))):
            part = q[:, c * chunk : (c + 1) * chunk]
            x, kind = narrow(part)
            out.append((key[0], key[1], c, len(frame), part.shape[1], kind, x, *(who if c == 0 else [None] * 4)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _PANEL.split(", ")])

    return rows.groupBy("space", "block").applyInPandas(build, _PANEL)


def _tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial tiles: each chunk of each anchor block times that of each row block of its space. ``anchors`` and ``rows``
    are panels with the number of the other side's blocks in ``others``."""

    def multiply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["space", "i", "j", "chunk", "kind", "tile", *(f"{side}_{n}" for side in ("a", "r") for n in ("u", "id", "labels")), "windows"]
        if left.empty or right.empty:
            return pd.DataFrame([], columns=names)
        a, b = left.iloc[0], right.iloc[0]
        x, y = (np.frombuffer(p["x"], p["kind"]).reshape(p["n"], p["width"]) for p in (a, b))
        tile, kind = narrow(product(x, y))
        return pd.DataFrame([(*key[:4], kind, tile, a["u"], a["id"], a["labels"], b["u"], b["id"], b["labels"], a["windows"])], columns=names)

    left = anchors.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumnRenamed("block", "i").drop("others")
    right = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumnRenamed("block", "j").drop("others")
    keys = ["space", "i", "j", "chunk"]
    schema = "space string, i long, j long, chunk int, kind string, tile binary, a_u binary, a_id binary, a_labels array<string>, r_u binary, r_id binary, r_labels array<string>, windows binary"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(multiply, schema)


def _whole(frame: pd.DataFrame):
    """The sum of the partial tiles of two blocks, and who the anchors and the rows are."""
    first = frame.loc[frame["chunk"] == 0].iloc[0]
    who = {n: np.frombuffer(first[n], "<i8") for n in ("a_u", "a_id", "r_u", "r_id")}
    total = sum(np.frombuffer(t, k).astype(np.int64) for t, k in zip(frame["tile"], frame["kind"], strict=True))
    return total.reshape(len(who["a_u"]), len(who["r_u"])), who, first


def _best_positives(k: int):
    names = ["u", "anchor", "other_u", "other", "score"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        scores, who, _ = _whole(frame)
        out = []
        for a, u in enumerate(who["a_u"]):
            at = first_rows(scores[a], np.flatnonzero(who["r_u"] != u), k)
            out.append(np.stack([np.full(len(at), u), np.full(len(at), who["a_id"][a]), who["r_u"][at], who["r_id"][at], scores[a][at]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=names)

    return run, ", ".join(f"{n} long" for n in names)


def _best_negatives(k: int, low: int, high: int):
    names = ["u", "anchor", "place", "positive", "positive_score", "other_u", "other", "score"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        scores, who, first = _whole(frame)
        windows = np.frombuffer(first["windows"], "<i8").reshape(len(who["a_u"]), -1, 3)
        codes = {label: c for c, label in enumerate({*first["a_labels"], *first["r_labels"]})}
        mine, theirs = (np.array([codes[x] for x in first[n]]) for n in ("a_labels", "r_labels"))
        out = [np.zeros((0, len(names)), np.int64)]
        for a, u in enumerate(who["a_u"]):
            other = np.flatnonzero(theirs != mine[a])
            hundred = 100 * scores[a][other]
            for place, positive, score in windows[a]:
                if not place or score < 0:
                    continue
                at = first_rows(scores[a], other[(hundred >= low * score) & (hundred <= high * score)], k)
                same = [np.full(len(at), v) for v in (u, who["a_id"][a], place, positive, score)]
                out.append(np.stack([*same, who["r_u"][at], who["r_id"][at], scores[a][at]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=names)

    return run, ", ".join(f"{n} long" for n in names)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of what the tiles left for each of ``by``, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other", "other_u")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: tuple[int, int] = (ANCHORS, ROWS), chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``anchor`` says of a row of ``vectors``
    whether it is an anchor."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("_e"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("_e")))
    rows = rows.select("id", "label", "anchor", floored(F.col("_e"), scale, 128).alias("q")).withColumn("u", F.monotonically_increasing_id())
    rows = scratch.write(rows.withColumn("dim", F.size("q").cast("string")), "rows")
    blocks = lambda n, size: F.ceil(n / F.lit(size)).cast("long")
    deal = lambda n: F.pmod(F.xxhash64("u"), n)

    # Positives: the blocks of each label with an anchor.
    spaced = rows.withColumn("space", F.concat_ws(":", "dim", "label"))
    counted = spaced.groupBy("space").agg(blocks(F.count_if("anchor"), block[0]).alias("a_blocks"), blocks(F.count(F.lit(1)), block[1]).alias("r_blocks"))
    sizes = scratch.write(counted.filter("a_blocks > 0"), "sizes")
    dealt = spaced.join(sizes, "space").select("space", "u", "id", "label", "q", "anchor", "a_blocks", "r_blocks")
    a_panels = _panels(dealt.filter("anchor").withColumn("block", deal(F.col("a_blocks"))), chunk)
    r_panels = _panels(dealt.withColumn("block", deal(F.col("r_blocks"))), chunk)
    tiles = _tiles(a_panels.join(sizes.select("space", F.col("r_blocks").alias("others")), "space"), r_panels.join(sizes.select("space", F.col("a_blocks").alias("others")), "space"))
    best = tiles.groupBy("space", "i", "j").applyInPandas(*_best_positives(positives))
    found = scratch.write(_ranked(best, ["u"], positives), "positives")

    # Negatives: the blocks of all rows, with the windows of each anchor's positives beside it.
    window = F.struct(F.col("rank").cast("long").alias("place"), F.col("other").alias("positive"), F.col("score"))
    windows = found.groupBy("u").agg(F.array_sort(F.collect_list(window)).alias("w"))
    n_rows, n_anchors = rows.count(), windows.count()
    if not n_anchors:
        return rows.limit(0).select(*(F.lit(0).cast(t).alias(n) for n, t in _ANSWER.items()))
    a_blocks, r_blocks = -(-n_anchors // block[0]), -(-n_rows // block[1])
    everywhere = rows.withColumnRenamed("dim", "space").select("space", "u", "id", "label", "q", "anchor")
    opened = everywhere.filter("anchor").join(windows.withColumn("windows", _padded(positives)).drop("w"), "u")
    a_panels = _panels(opened.withColumn("block", deal(F.lit(a_blocks))), chunk).withColumn("others", F.lit(r_blocks).cast("long"))
    r_panels = _panels(everywhere.withColumn("block", deal(F.lit(r_blocks))), chunk).withColumn("others", F.lit(a_blocks).cast("long"))
    best = _tiles(a_panels, r_panels).groupBy("space", "i", "j").applyInPandas(*_best_negatives(negatives, low, high))
    ranked = _ranked(best, ["u", "place"], negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_ANSWER = {"anchor_id": "long", "positive_id": "long", "rank": "int", "negative_id": "long", "positive_score": "long", "negative_score": "long"}


def _padded(positives: int) -> Column:
    """The windows ``w`` of an anchor as numbers, three for each, and zeros for those that are not there."""
    flat = F.flatten(F.transform("w", lambda x: F.array(x["place"], x["positive"], x["score"])))
    return F.concat(flat, F.array_repeat(F.lit(0).cast("long"), F.lit(3 * positives) - F.size(flat)))
