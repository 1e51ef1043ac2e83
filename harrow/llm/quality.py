"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document is the average of learned vectors: one for each hashed word, one for each hashed character
n-gram of its words and one for each hashed pair of words that follow each other, where a word that follows itself is
the same pair whatever the word. Vectors and output weights are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (SAMPLE documents and SAMPLE_CHARS characters, filled in the order of the hash of their id, so
that any size of input gives a sample of the same kind; a document that does not fit is passed over, and a class that
would be left out has one document in it, whatever its length). Because the output is linear in the average, a word adds one number and one
count to a document; scoring remembers them for each word, and every word of every text is read.

Only the text is an input of a score. Defined cases: a null or empty text has no features and scores by the
bias alone; labels that are null or other than 0 and 1, and labels without a document, are not learned from;
with no labelled rows at all, or one class alone, every document scores the share of label 1, or 1 without any
label; repeated labels count once for each row; other columns pass through, but one
of the output's name is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm import _memory

#: Labelled documents to learn from at most, and the characters of text they may hold together.
SAMPLE = 4_000
SAMPLE_CHARS = 12_000_000
#: Buckets of words and character n-grams, then PAIRS buckets of word pairs, the last of them for a word after itself.
BUCKETS, PAIRS, DIM, EPOCHS, RATE, SEED = 1 << 15, 1 << 14, 8, 4, 0.25, 7
NGRAMS = (2, 3, 4)
THRESHOLD = 0.3
#: Folds by crc32 of the id's text; fold 0 is held out.
FOLDS = 5
KNOWN, KNOWN_CHARS = 300_000, 48


def features(word: str) -> list[int]:
    """Buckets of a word and of the n-grams of the word between boundary marks."""
    marked = f"<{word}>"
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) % BUCKETS]
    raw = marked.encode("utf-8", "surrogatepass") if marked.isascii() else None
    for n in NGRAMS:
        if raw is not None:
            out.extend(zlib.crc32(raw[i : i + n]) % BUCKETS for i in range(len(raw) - n + 1))
        else:
            out.extend(zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(marked) - n + 1))
    return out


def pairs(h: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of words that follow each other, from the words' hashes."""
    one, two = h[:-1].astype(np.int64), h[1:].astype(np.int64)
    return np.where(one == two, BUCKETS + PAIRS - 1, BUCKETS + (one * 31 + two) % (PAIRS - 1))


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class WordSums(dict):
    """Word to the sum of its features' weights, their number and the word's hash, as three doubles in bytes."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> bytes:
        at = features(word)
        got = np.array((self.weights[at].sum(), len(at), word_hash(word))).tobytes()
        if len(word) <= KNOWN_CHARS and len(self) < KNOWN:
            self[word] = got
        return got


@dataclass(eq=False)
class Model:
    """Weight of each bucket after the output layer, the bias, and what calibration does to the sum."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.known = WordSums(self.weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.scale, self.shift)

    def margin(self, text: str) -> float:
        words = text.split()
        if not words:
            return self.bias
        sums, counts, h = np.frombuffer(b"".join(map(self.known.__getitem__, words))).reshape(-1, 3).T
        total = sums.sum() + self.weights[pairs(h)].sum()
        count = counts.sum() + len(words) - 1
        return float(total / count) + self.bias

    def score(self, text: str | None) -> float:
        z = self.scale * self.margin(text or "") + self.shift
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


#: The model that this worker scores with.
_SCORING: list[Model] = []


def _forget() -> None:
    for old in _SCORING:
        old.known.clear()
    _SCORING.clear()


def _scoring_with(model: Model) -> Model:
    """``model``; a worker lives on and forgets the words of the model before."""
    for old in _SCORING:
        if old is not model:
            old.known.clear()
    _SCORING[:] = [model]
    return model


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit by stochastic gradient descent, one document a step; the classes weigh the same."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(BUCKETS + PAIRS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(SEED)
    known: dict[str, bytes] = {}
    bags = []
    for text in texts:
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = np.array(features(w), np.uint16).tobytes()
        at = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16)
        at = np.append(at, pairs(np.fromiter(map(word_hash, words), np.int64, len(words))))
        ids, counts = np.unique(at, return_counts=True)
        bags.append((ids.astype(np.int32), (counts / max(len(at), 1)).astype(np.float32)))
    known.clear()
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + PAIRS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    fit_part = rng.random(len(y)) >= 0.1  # the rest calibrates
    if len(set(y[fit_part])) < 2 or len(set(y[~fit_part])) < 2:
        fit_part[:] = True
    order, steps = np.flatnonzero(fit_part), 0
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            rate = RATE * (1 - steps / (EPOCHS * len(order) + 1))
            steps += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = np.float32(rate * weight[y[i]]) * p
            back = out @ step
            out -= np.outer(hidden, step)
            bias -= step
            if len(ids):
                # An average spreads the gradient thinly; vectors take it by share times the number of features.
                vectors[ids] -= np.minimum(share * len(ids), 4)[:, None] * back[None, :]
    model = Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    held = np.flatnonzero(~fit_part) if not fit_part.all() else np.arange(len(y))
    margins = np.array([float(s @ model.weights[i]) + model.bias for i, s in (bags[k] for k in held)])
    model.scale, model.shift = _platt(margins, y[held], weight)
    return model


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the margin by logistic regression on rows that the vectors were not fitted to."""
    spread = float(margin.std()) or 1.0
    z, w = margin / spread, weight[y]
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = w * (p - y)
        a -= 0.5 * (float((g * z).mean()) + 1e-3 * a)
        b -= 0.5 * float(g.mean())
    return max(a, 0.1) / spread, b


def fold(key: str):
    """crc32 of the id as text, modulo FOLDS."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def fill(rows: Iterable[tuple], chars: int) -> list[tuple]:
    """Of (key, label, text or its length, ...), in the order given, those that fit into ``chars`` together; of a class without one, its shortest."""
    out, room, short = [], chars, {}
    length = lambda row: row[2] if isinstance(row[2], int) else len(row[2])
    for row in rows:
        mark, size = row[1], length(row)
        if size <= room:
            out.append(row)
            room -= size
        elif mark not in short or size < length(short[mark]):
            short[mark] = row
    there = {row[1] for row in out}
    return out + [row for mark, row in sorted(short.items()) if mark not in there]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fold, of ``sample_chars`` characters together.

    Which documents these are is told by ids, lengths and hashes, of which the driver sees ``sample`` at most and one; their
    texts have a bound, so one task holds them; that task trains and the driver gets the model alone.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold(key) != 0)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
    order = [F.xxhash64("_k"), F.col("_k"), F.col("_y")]
    marked = marked.join(docs.select(F.col(key).alias("_k")), "_k", "left_semi")
    chosen = marked.orderBy(*order).limit(sample)
    # A class that none of them has gives the one of least hash.
    least = marked.groupBy("_y").agg(F.min(F.struct(*order[:2]))["_k"].alias("_k")).select("_k", "_y")
    chosen = chosen.unionByName(least.join(chosen.select("_y").distinct(), "_y", "left_anti"))
    # At most ``sample`` ids and one, so the join's small side has a bound.
    whole = F.coalesce(F.col(text), F.lit(""))
    every = docs.select(F.col(key).alias("_k"), F.length(whole).alias("_size"), F.xxhash64(whole).alias("_h"))
    got = every.join(F.broadcast(chosen), "_k")
    # The first of each class comes first, so that rows which share an id can't crowd out a class.
    order = [*order, F.col("_size"), F.col("_h")]
    got = got.withColumn("_n", F.row_number().over(Window.partitionBy("_y").orderBy(*order))).filter(F.col("_n") <= sample)
    rows = [tuple(r) for r in got.orderBy(F.col("_n") > 1, *order).limit(sample).select("_k", "_y", "_size", "_h").collect()]
    marks: dict[tuple, list[int]] = {}
    for k, y, _, h in fill(rows, sample_chars):
        marks.setdefault((k, h), []).append(y)
    if not marks:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame([*marks], T.StructType([T.StructField("_k", docs.schema[key].dataType), T.StructField("_h", T.LongType())]))
    texts = docs.select(F.col(key).alias("_k"), whole.alias("_t")).withColumn("_h", F.xxhash64("_t"))
    texts = texts.join(F.broadcast(wanted), ["_k", "_h"]).dropDuplicates(["_k", "_h"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [tuple(b.column(n)[i].as_py() for n in ("_k", "_h", "_t")) for b in batches for i in range(len(b))]
        some = sorted((k, y, t) for k, h, t in found for y in marks[k, h])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([t for _, _, t in some], [y for _, y, _ in some]))], pa.binary())], names=["model"])

    found = texts.select("_k", "_h", "_t").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in the double column ``out``."""
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != out])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memory.enter("quality", _forget)
        own = _scoring_with(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            made = [own.score(column[i].as_py()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` that score at least ``threshold``; columns as they were."""
    return score(docs.drop("_quality"), model, text, "_quality").filter(F.col("_quality") >= threshold).drop("_quality")
