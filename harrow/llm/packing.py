"""Best-fit packing of documents into token sequences, improved by swaps between underfull bins.

Token counts alone decide where a piece goes, so the ids never leave the Python worker: each document becomes
rows (key, piece, start, length, crc of the ids). Pieces are dealt by their row number into groups of at most
GROUP pieces; in a group, best-fit decreasing places them and a local search then moves documents, or exchanges
one for one or two for one, between underfull bins so that the sum of squared fills rises and the emptiest
bins vanish. The bins that stay least full in each group, with a bounded share of its pieces, are opened again and packed
together in further rounds, each of fewer groups of at most GROUP pieces, until one group is left or none is opened.

Defined cases: a null text is the empty text, which is the end token alone; a document longer than a sequence
is cut into full pieces and a rest; repeated rows are documents of their own; the order among equal lengths
follows the row number. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm import _memory
from harrow.llm._storage import Scratch
from harrow.llm._words import word_ids
from harrow.llm.bpe import chunks

CAPACITY = 2048
#: Pieces that one task packs.
GROUP = 20_000
#: Bins of each group that later rounds open again, and the share of its pieces that they hold at most, one of so many.
REOPENED, AGAIN = 64, 8
#: Emptiest bins that the local search tries in vain before it ends.
PATIENCE = 40
#: Pairs of bins that the local search of a group looks at.
TRIES = 400_000


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, ids: str | None = None) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, and the ids themselves if ``ids`` names a column."""
    base = docs.select(docs[key].alias(key), docs[text].alias(text))
    fields = [base.schema[key], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))]
    if ids:
        fields.append(T.StructField(ids, T.ArrayType(T.LongType())))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memory.enter("packing", word_ids.cache_clear)
        words = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            at = 0
            for some in chunks([x or "" for x in batch.column(1).to_pylist()]):
                for made in words.of(some):
                    made += last
                    for k, i in enumerate(range(0, len(made), 4 * capacity)):
                        part = made[i : i + 4 * capacity]
                        row = (at, k, i // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4").tolist()) if ids else row)
                    at += 1
            if rows:
                which, *rest = map(list, zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(x, t) for x, t in zip(rest, types, strict=False))], names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers by best-fit decreasing; ``by_free`` keeps the bins of each free space."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = there >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                there &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - n
        by_free[left].append(b)
        there |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, patience: int = PATIENCE, tries: int = TRIES) -> list[list[int]]:
    """Local search: drain the emptiest bin into fuller ones by the exchange that fills the other bin most.

    Each step takes from a bin and gives to a fuller one, so the sum of squared fills rises and the search ends: when
    no more bin can vanish, when ``patience`` bins were tried in vain, or after ``tries`` pairs of bins.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    open_bins = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: fill[b])
    sizes = {b: {lengths[i] for i in bins[b]} for b in open_bins}
    count, vain, failed = len(bins), 0, set()
    while count > least and vain < patience and tries > 0:
        donor = next((b for b in open_bins if b not in failed and fill[b]), None)
        if donor is None:
            break
        moved = True
        while moved and bins[donor] and tries > 0:
            moved = False
            ones, sums = _sums(bins[donor], lengths)
            for target in reversed(open_bins):
                free = capacity - fill[target]
                if target == donor or not free or fill[target] < fill[donor]:
                    continue
                tries -= 1
                best = _exchange(ones, sums, sizes[target], free)
                if best:
                    _apply(bins[donor], bins[target], lengths, *best)
                    fill[donor] -= best[0]
                    fill[target] += best[0]
                    sizes[target] = {lengths[i] for i in bins[target]}
                    moved = True
                    if not bins[donor]:
                        break
                    ones, sums = _sums(bins[donor], lengths)
        if bins[donor]:
            sizes[donor] = {lengths[i] for i in bins[donor]}
            failed.add(donor)
            vain += 1
        else:
            count -= 1
            vain = 0
        open_bins = sorted((b for b in open_bins if 0 < fill[b] < capacity), key=lambda b: fill[b])
    return [b for b in bins if b]


def _sums(items: list[int], lengths: list[int]) -> tuple[int, int]:
    """The lengths of one item, and those of one or two, as bits of a number."""
    ones = twos = 0
    for i in items:
        twos |= ones << lengths[i]
        ones |= 1 << lengths[i]
    return ones, ones | twos


def _exchange(ones: int, sums: int, sizes: set[int], free: int) -> tuple[int, int] | None:
    """Most tokens that a target with items of ``sizes`` and ``free`` room can gain, and the length it gives back: 0 for
    a move, else that of one item for one or two. A shift of the donor's sums by that length has the gains as its bits."""
    mask = (2 << free) - 2
    gain, back = (ones & mask).bit_length() - 1, 0
    for size in sizes:
        got = ((sums >> size) & mask).bit_length() - 1
        if got > gain:
            gain, back = got, size
        if gain == free:
            break
    return (gain, back) if gain > 0 else None


def _apply(donor: list[int], target: list[int], lengths: list[int], gain: int, back: int) -> None:
    """Give items of ``gain + back`` tokens, one if there is one and else two, for one of ``back``."""
    need = gain + back
    out = next(([i] for i in donor if lengths[i] == need), None)
    if out is None:
        at: dict[int, int] = {}
        for i in donor:
            if need - lengths[i] in at:
                out = [at[need - lengths[i]], i]
                break
            at[lengths[i]] = i
    returned = [next(i for i in target if lengths[i] == back)] if back else []
    for i in out:
        donor.remove(i)
    for i in returned:
        target.remove(i)
    target.extend(out)
    donor.extend(returned)


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of the numbers of the items, none above ``capacity``."""
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack(table: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP, reopened: int = REOPENED, scratch: Scratch | None = None) -> DataFrame:
    """``table`` with sequence_id and offset; rows above ``capacity`` are refused.

    ``table`` is written once with a row number, which deals the pieces to groups of equal size: no value of
    any column decides the group, so none can overfill one.
    """
    scratch = scratch or Scratch(table.sparkSession, "packing")
    base = table.select(*[c for c in table.columns if c not in ("sequence_id", "offset", "_row")])
    at = scratch.write(base.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    total = at.count()
    slim = at.select("_row", F.col(length).cast("long").alias("_len")).withColumn("_salt", F.xxhash64("_row"))
    placed, waiting, round_ = None, slim, 0
    while True:
        groups = max(1, -(-total // group))
        packer = _packer(capacity, reopened if groups > 1 else 0, group // AGAIN)
        made = waiting.withColumn("_group", F.pmod("_salt", F.lit(groups))).groupBy("_group").applyInPandas(packer, _PLACED)
        made = scratch.write(made.withColumn("_round", F.lit(round_)), f"round{round_}")
        done = made.filter("NOT _again")
        placed = done if placed is None else placed.unionByName(done)
        if groups == 1:
            break
        left = made.filter("_again")
        total, round_ = left.count(), round_ + 1
        waiting = left.select("_row", "_len", F.xxhash64(F.lit(round_), "_row").alias("_salt"))
        if not total:
            break
    # A number of its own for each (round, group, bin): rounds are few, a group has at most GROUP bins.
    number = (F.col("_round").cast("long") * F.lit(1 << 56)) + F.col("_group") * F.lit(1 << 24) + F.col("_bin")
    return at.join(placed.select("_row", number.alias("sequence_id"), F.col("_offset").alias("offset")), "_row").drop("_row")


_PLACED = "_row long, _len long, _group long, _bin long, _offset long, _again boolean"


def _packer(capacity: int, reopened: int, most: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        lengths = frame["_len"].tolist()
        if max(lengths) > capacity:
            raise ValueError(f"a piece of {max(lengths)} tokens in sequences of {capacity}")
        bins = pack_lengths(lengths, capacity)
        free = [capacity - sum(lengths[i] for i in b) for b in bins]
        # At most ``most`` pieces go on, so the next round has fewer groups of the same size.
        emptiest, room = set(), most
        for b in sorted(range(len(bins)), key=lambda b: -free[b])[:reopened]:
            if free[b] and len(bins[b]) <= room:
                emptiest.add(b)
                room -= len(bins[b])
        which, offset, again = np.zeros(len(lengths), int), np.zeros(len(lengths), int), np.zeros(len(lengths), bool)
        for b, items in enumerate(bins):
            run_ = 0
            for i in items:
                which[i], offset[i], again[i] = b, run_, b in emptiest
                run_ += lengths[i]
        return pd.DataFrame({"_row": frame["_row"], "_len": frame["_len"], "_group": key[0], "_bin": which, "_offset": offset, "_again": again})

    return run
