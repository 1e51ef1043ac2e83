"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a byte-level BPE model: every byte is mapped to a printable
character by the usual byte table, and each token's two parts are found by merging its bytes with the lower
ranks alone. Decoding reverses the table token by token, so bytes of a character that two tokens share are
joined before UTF-8 decoding.

Defined cases: a null text is encoded as the empty text (no ids); texts are encoded whole, however long;
repeated rows give repeated rows; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from harrow.llm._words import KnownIds

#: Characters of text that are handed to the tokenizer at once.
CHUNK_CHARS = 1 << 20
#: The pattern of which it is known that a lone inner space begins a match.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space beside other white space or at an end, and the places where text can be cut nonetheless.
MIXED, CUT = re.compile(r"^ | \s|\s | $"), re.compile(r"(?<=\S)(?= \S)")


def byte_table() -> list[str]:
    """Byte to character: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces left of a token after all merges of ranks below its own: two in a trained vocabulary."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best, at = limit, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], limit)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        spell = lambda b: "".join(table[x] for x in b)
        pairs = (_parts(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1)
        merges = [(spell(p[0]), spell(p[1])) for p in pairs if len(p) == 2]
        vocab = {spell(t): r for t, r in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.known = KnownIds(self.tokenizer)
        self.spaced = pattern == SPACED_PATTERN
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in vocab.items():
            self.bytes_of[rank] = bytes(back[c] for c in token)
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, put together from those of its stretches.

        A space between two characters that are no white space always begins a new match of a pattern that
        takes a leading space into words, as the usual ones do; so what lies between such spaces is encoded
        once and remembered. ``spaced`` says whether the pattern does so; without it texts are encoded whole.
        """
        if not self.spaced:
            for encoding in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                yield encoding.ids
            return
        split = []
        for text in texts:
            if MIXED.search(text):
                split.append(CUT.split(text))
            else:
                first, *rest = text.split(" ")
                split.append([first, *[" " + x for x in rest]])
        for stretches in self.known.learn(split):
            yield np.frombuffer(b"".join(map(self.known.__getitem__, stretches)), "<u4").tolist()

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and their half-open code-point ranges; tokens that share a character share its range."""
        for encoding in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            yield encoding.ids, encoding.offsets

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of whole characters; bytes that form none become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids arrive: bytes of an unfinished character wait for the next token."""
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.bytes_of[i])
        if rest := decoder.decode(b"", final=True):
            yield rest


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK_CHARS characters; a longer text stands alone."""
    some, n = [], 0
    for text in texts:
        if some and n + len(text) > CHUNK_CHARS:
            yield some
            some, n = [], 0
        some.append(text)
        n += len(text)
    if some:
        yield some


def _plain(column: pa.ChunkedArray) -> list[str]:
    return [text or "" for text in column.to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text``, and their code-point ranges if ``offsets`` names a column."""
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    if offsets:
        extra.append(T.StructField(offsets, T.ArrayType(span)))
    new = {f.name for f in extra}
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            at = 0
            for some in chunks(_plain(batch.column(batch.schema.get_field_index(text)))):
                part = batch.slice(at, len(some))
                at += len(some)
                if offsets:
                    found = list(own.encode_with_offsets(some))
                    spans = [[{"start": a, "end": b} for a, b in where] for _, where in found]
                    columns = [pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                else:
                    columns = [pa.array(list(own.encode(some)), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(f.name for f in extra)])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *extra]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for (null ids: no bytes) in the binary column ``out``."""
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            made = pa.array([own.decode_bytes(x or ()) for x in column], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text and return key, n_tokens, ids_sha256 and decoded_sha256.

    The ids stay in the Python worker: only the digests cross back, so no list of ids is shuffled or stored.
    """
    base = docs.select(docs[key].alias(key), docs[text].alias(text))
    fields = [base.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        digits = own.digits_of.__getitem__
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for some in chunks(_plain(batch.column(1))):
                for ids in own.encode(some):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))
