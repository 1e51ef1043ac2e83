"""Sum-of-squares online packing of documents into token windows.

Documents are placed one after the other, each where it leaves the sum of the squared counts of partly filled windows
least. The windows of a task are tracked in a level array: ``counts[h]`` windows are filled up to ``h``. For a piece
of ``s`` tokens the change of that sum is known for each level at once, ``up[h + s] - down[h]``, so a placement costs
one subtraction over the array.

Encoding and placing are one pass over the rows of a task: nothing is shuffled, and a window's rows leave when it is
full. At most OPEN windows are open; if more were, and at the end, they are settled: the emptiest give their
pieces, cut where needed, to the fullest, and the last rest of a task is cut into powers of two, which need no padding. So no
sequence is padded, and a document is cut only if it is longer than a window or when windows are settled.

Defined cases: a null text is the empty text, which is the end token alone; repeated rows, equal ids and null ids are
documents of their own; a document longer than a window is cut into full windows and a rest; among levels that are
equally good the fullest is taken. Other columns are dropped, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from harrow.llm import _memory
from harrow.llm.bpe import byte_table

CAPACITY = 2048
#: Windows that a task holds open at most; each holds up to a window's ids.
OPEN = 4_096
#: Rows of a batch that a task returns.
BATCH = 8_192
#: More than any change of the sum, for levels without a window.
NEVER = 1 << 60


#: How a byte-level tokenizer file splits that names no pattern of its own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevelIds:
    """Ids by a tokenizer file.

    A byte-level file whose merges stand in the order of its ids is the rank file of the tiktoken library, which gives the same ids
    several times as fast and remembers nothing. Texts that hold an added token, and other files, go through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.added = [t["content"] for t in made.get("added_tokens", ())]
        ranks = rank_table(made)
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def rank_table(made: dict) -> dict[bytes, int] | None:
    """The tokens' bytes and ids of a tokenizer file, if merging by the least id is what the file says; null otherwise."""
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = model.get("type") == "BPE" and not made.get("normalizer") and not model.get("dropout") and not any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if not (plain and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")):
        return None
    back = {c: b for b, c in enumerate(byte_table())}
    added = {t["content"] for t in made.get("added_tokens", ())}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    bytes_ = [vocab.get(c) for c in back]
    if None in merged or None in bytes_ or len(vocab) != len(merged) + 256 or merged != sorted(set(merged)) or max(bytes_) > min(merged, default=1 << 32):
        return None
    return {bytes(back[c] for c in t): i for t, i in vocab.items()}


@lru_cache(maxsize=2)
def byte_level_ids(path: str) -> ByteLevelIds:
    """One encoder for each Python worker."""
    return ByteLevelIds(path)


class Levels:
    """The level array: how many windows are filled up to each level, and where a piece goes."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        #: What one more window at a level adds to the sum of squares, and what one less takes from it; a full one is free.
        self.up = np.ones(capacity + 1, np.int64)
        self.up[capacity] = 0
        self.down = np.full(capacity + 1, -NEVER)
        self.down[0] = 0

    def _count(self, level: int, by: int) -> None:
        if not 0 < level < self.capacity:
            return
        self.counts[level] += by
        n = int(self.counts[level])
        self.up[level] = 2 * n + 1
        self.down[level] = 2 * n - 1 if n else -NEVER

    def choose(self, size: int) -> int:
        """The level at which a piece of ``size`` leaves the least sum of squares, 0 for a new window; the fullest of equals."""
        change = self.up[size:] - self.down[: self.capacity + 1 - size]
        return len(change) - 1 - int(change[::-1].argmin())

    def move(self, level: int, to: int) -> None:
        """A window has gone from ``level`` (0: it is new) to ``to`` (0: it is gone)."""
        self._count(level, -1)
        self._count(to, 1)


Piece = tuple  # (the document's number, start, ids as bytes)


class Packer:
    """Windows that are being filled by one task; ``place`` and ``finish`` return those that are done."""

    def __init__(self, capacity: int = CAPACITY, open_windows: int = OPEN):
        self.levels, self.capacity, self.limit = Levels(capacity), capacity, open_windows
        self.at: dict[int, list[list[Piece]]] = defaultdict(list)
        self.n_open = 0

    def place(self, document, ids: bytes) -> list[list[Piece]]:
        step, done = 4 * self.capacity, []
        for i in range(0, len(ids), step):
            part = ids[i : i + step]
            size = len(part) // 4
            level = self.levels.choose(size)
            window = self.at[level].pop() if level else []
            window.append((document, i // 4, part))
            self.levels.move(level, level + size)
            self.n_open += (not level) - (level + size == self.capacity)
            if level + size == self.capacity:
                done.append(window)
            else:
                self.at[level + size].append(window)
        if self.n_open > self.limit:
            done += self.settle()
        return done

    def settle(self) -> list[list[Piece]]:
        """Fill the open windows with one another's pieces; the one that is left stays open."""
        full, rest = fill_up([w for windows in self.at.values() for w in windows], self.capacity)
        self.levels, self.at, self.n_open = Levels(self.capacity), defaultdict(list), 0
        if rest:
            self.at[n := sum(len(p[2]) for p in rest) // 4].append(rest)
            self.levels.move(0, n)
            self.n_open = 1
        return full

    def finish(self) -> list[list[Piece]]:
        done = self.settle()
        for windows in self.at.values():
            for rest in windows:
                done += powers(rest)
        return done


def _tail(piece: Piece, n: int) -> tuple[Piece, Piece]:
    """``piece`` without its last ``n`` ids, and those."""
    document, start, ids = piece
    keep = len(ids) // 4 - n
    return (document, start, ids[: 4 * keep]), (document, start + keep, ids[4 * keep :])


def fill_up(windows: list[list[Piece]], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows made of ``windows`` and the one that is left, if any: the fullest take whole pieces of the emptiest
    while one fits, and then the end of its shortest piece."""
    windows = sorted((sorted(w, key=lambda p: len(p[2])) for w in windows), key=lambda w: sum(len(p[2]) for p in w))
    fills = [sum(len(p[2]) for p in w) // 4 for w in windows]
    full, low, high = [], 0, len(windows) - 1
    while low < high:
        free = capacity - fills[high]
        while free and low < high:
            donor = windows[low]
            fits = [k for k, p in enumerate(donor) if len(p[2]) // 4 <= free]
            if fits:
                given = donor.pop(fits[-1])
            else:
                donor[0], given = _tail(donor[0], free)
            windows[high].append(given)
            n = len(given[2]) // 4
            free, fills[high], fills[low] = free - n, fills[high] + n, fills[low] - n
            low += not donor
        if free:
            break
        full.append(windows[high])
        high -= 1
    return full, windows[low] if low <= high else []


def powers(window: list[Piece]) -> list[list[Piece]]:
    """``window`` cut into windows whose fills are powers of two, the largest first."""
    out, rest = [], list(window)
    while rest:
        room = 1 << (sum(len(p[2]) for p in rest) // 4).bit_length() - 1
        made = []
        while room:
            piece = rest.pop(0)
            n = len(piece[2]) // 4
            if n > room:
                piece, after = _tail(piece, n - room)
                rest.insert(0, after)
                n = room
            made.append(piece)
            room -= n
        out.append(made)
    return out


def pack_online(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 1, ids: str | None = None) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if
    ``ids`` names a column. The sequences of a task are numbered after the number of its partition."""
    base = docs.select(docs[key].alias(key), docs[text].alias(text))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [base.schema[key], *(T.StructField(n, T.LongType()) for n in names)]
    if ids:
        fields.append(T.StructField(ids, T.ArrayType(T.LongType())))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memory.enter("level_packing", byte_level_ids.cache_clear)
        encoder, packer = byte_level_ids(path), Packer(capacity)
        sequence, rows, kind = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], pa.int64()

        def table() -> pa.RecordBatch:
            nonlocal rows
            columns = list(map(list, zip(*rows, strict=True)))
            rows = []
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in columns[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

        def close(windows: list[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for (name, total), start, part in window:
                    n = len(part) // 4
                    row = (name, start, n, zlib.crc32(part), total, sequence, offset)
                    rows.append((*row, part) if ids else row)
                    offset += n
                sequence += 1

        for batch in batches:
            kind = batch.column(0).type
            names_of = iter(batch.column(0).to_pylist())
            texts = batch.column(1)
            for i in range(len(texts)):
                made = encoder.of(texts[i].as_py() or "") + last
                close(packer.place((next(names_of), len(made) // 4), made))
                if len(rows) >= BATCH:
                    yield table()
        close(packer.finish())
        if rows:
            yield table()

    return base.mapInArrow(run, T.StructType(fields))
