"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of word k-mers (WORDS lower-cased words), a repeated k-mer labelled with its occurrence.
Each of SKETCHES hashes samples the TAKEN labelled k-mers of least value and keeps them in the order of the
text; the hash of that tuple is a bucket. Two texts meet if they share a bucket, which asks for common k-mers in
a common order. A pair is linked if an alignment of the k-mer sequences, in a band as wide as the threshold lets
them shift, has common / (n_a + n_b - common) >= SIMILARITY, common being the longest common subsequence.

Texts with equal words are one node. A bucket is not turned into all its pairs: the member whose buckets hold
most others leads it and is paired with the rest, and classes are formed. Members of buckets that still hold several
classes then count their k-mers that no other class has. Those k-mers can't be common to two classes, so a member with
too many of them has no link to another class, and a pair of which one has too many for the two lengths has none: both
are left out exactly. In what is left, members outside a bucket's largest class lead next and are paired
with those of other classes, LEADERS at first and four times as many each round, until one class is left. So a
bucket of thousands of copies costs a pair for each, however far the copies are from each other, and no pair of a
bucket is left unjudged that could join two classes. Before texts are shuffled for the first leaders, a pair is left out
only if its k-mers, counted in BINS classes of their hash, can't have as many in common as the threshold asks for.

Defined cases: texts without a word (null, empty, blank) are equal to each other; a text shorter than a k-mer
is one k-mer; class ids are the least id of the class; a class of null ids alone has a null class id; repeated
rows are copies, of which ``one_of_each`` keeps one; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm import _memory
from harrow.llm._components import components
from harrow.llm._storage import Scratch

WORDS, SIMILARITY = 5, 0.8
SKETCHES, TAKEN, SEED = 24, 3, 5
#: Classes of k-mers that are counted for each text. Counts stop at FULL, which stands for any number from it on.
BINS, FULL = 256, 255
#: Leaders of a bucket in the first round after that of one leader.
LEADERS = 256
#: One of so many k-mers tells most of the nodes that are out of reach before all k-mers are looked at.
SHARE = 4
#: Words that a worker remembers, and k-mers that it hands over at once.
KNOWN, KNOWN_CHARS, KMERS = 200_000, 48, 1 << 16
#: Columns of these names must not be in the rows that ``one_of_each`` is given.
RESERVED = ("_h1", "_h2", "_g1", "_g2", "_key", "_n")


class WordHashes(dict):
    """Word to its 64-bit hash as bytes."""

    def __missing__(self, word: str) -> bytes:
        got = blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if len(word) <= KNOWN_CHARS and len(self) < KNOWN:
            self[word] = got
        return got


_HASHES = WordHashes()
_POWERS = np.random.default_rng(SEED).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def words_hash(words: list[str]) -> list[int]:
    """128 bits of the words in order, as two numbers."""
    return np.frombuffer(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.int64).tolist()


def kmers(words: list[str], k: int = WORDS) -> np.ndarray:
    """Hashes of the k-mers of words in order; one for fewer than k words, none for no word."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64)
    n = max(1, len(h) - k + 1)
    total = np.full(n, np.uint64(min(len(h), k)))
    for i in range(min(k, len(h))):
        total += h[i : i + n] * _POWERS[i]
    return _mix(total)


def labelled(h: np.ndarray) -> np.ndarray:
    """The hashes with those that repeat told apart by their occurrence; a first one keeps its hash, as in a text without repeats."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    if not (s[1:] == s[:-1]).any():
        return h
    first = np.r_[True, s[1:] != s[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = np.empty_like(h)
    out[order] = np.where(first, s, _mix(s + (np.arange(len(s)) - start).astype(np.uint64) * _POWERS[63]))
    return out


def sketch(h: np.ndarray, sketches: int = SKETCHES, taken: int = TAKEN) -> np.ndarray:
    """Bucket of each hash: of the ``taken`` k-mers of least value, in text order."""
    h = labelled(h)
    factors = _mix(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    if len(h) > taken:
        values = h[None, :] * factors[:, None]
        at = np.sort(np.argpartition(values, taken - 1, axis=1)[:, :taken], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(h)), (sketches, len(h)))
    out = factors.copy()
    for i in range(at.shape[1]):
        out = _mix(out ^ h[at[:, i]])
    return out.view(np.int64)


def bins(h: np.ndarray) -> bytes:
    """How many of the hashes fall into each class, a byte for each."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes()


def at_most(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For rows of bins, a number that the common k-mers, and so any alignment, can't exceed."""
    sure = np.minimum(s, t)
    return np.where((sure == FULL).any(axis=1), np.iinfo(np.int64).max, sure.sum(axis=1, dtype=np.int64))


def least_common(total, threshold: float):
    """Common k-mers that a link of two texts with ``total`` k-mers needs."""
    return np.ceil(threshold * total / (1 + threshold) - 1e-9).astype(np.int64)


def common(a: np.ndarray, b: np.ndarray, least: int, band: int) -> int:
    """Length of the longest common subsequence within the band, or -1 if it can't reach ``least``."""
    if min(len(a), len(b)) < least or abs(len(a) - len(b)) > band:
        return -1
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b, n = a[head:], b[head:], n - head
    tail = 0
    if n:
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        tail = n if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    sure = head + tail
    if sure >= least and not (len(a) and len(b)):
        return sure
    # No alignment has more than the common k-mers, each as often as in the rarer side.
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if sure + int(np.minimum(ca[ia], cb[ib]).sum()) < least:
        return -1
    if int((ca[ia] * cb[ib]).sum()) <= 16 * (len(a) + len(b)):
        return sure + _sparse(a, b, band)
    return sure + _banded(a, b, band)


def _sparse(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """By the matches alone, where they are few: each row's places in the band, last first, extend the shortest chains."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    ends: list[int] = []
    for i, x in enumerate(a.tolist()):
        for j in reversed(places.get(x, ())):
            if abs(i - j) <= band:
                k = bisect_left(ends, j)
                ends[k : k + 1] = [j]
    return len(ends)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Row by row over the band, where k-mers repeat much."""
    row = np.zeros(len(b) + 1, np.int32)
    for i, x in enumerate(a):
        low, high = max(0, i - band), min(len(b), i + band + 1)
        if low >= high:
            continue
        new = np.maximum(row[low + 1 : high + 1], row[low:high] + (b[low:high] == x))
        row[low + 1 : high + 1] = np.maximum.accumulate(np.maximum(new, row[low]))
    return int(row.max())


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """common / (n_a + n_b - common) of two k-mer sequences, or 0 where it is below the threshold."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    least = int(least_common(total, threshold))
    got = common(a, b, least, total - 2 * least)
    return got / (total - got) if got >= least else 0.0


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, h1 and h2 (hash of the words), n (k-mers), sketches and bins of each row."""
    base = docs.select(docs[key].alias(key), docs[text].alias(text))
    fields = [base.schema[key], *(T.StructField(n, T.LongType()) for n in ("h1", "h2", "n")), T.StructField("sketches", T.ArrayType(T.LongType())), T.StructField("bins", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memory.enter("minhash", _HASHES.clear)
        for batch in batches:
            column, rows = batch.column(1), []
            for i in range(len(column)):
                words = words_of(column[i].as_py())
                h1, h2 = words_hash(words)
                h = kmers(words)
                rows.append((h1, h2, len(h), sketch(h).tolist(), bins(h)))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())], names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """a and b of the pairs (a, b, n, m, bins_a, bins_b) that an alignment could link; none that it links is left out."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
            total = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(at_most(s, t) >= least_common(total, threshold)))

    return pairs.select("a", "b", "n", "m", "bins_a", "bins_b").mapInArrow(run, schema)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) that the alignment links."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, np.empty(0, np.uint64)
        _memory.enter("minhash", _HASHES.clear)
        for batch in batches:
            x, y, good = batch.column(2), batch.column(3), []
            for i in range(len(batch)):
                ta, tb = x[i].as_py(), y[i].as_py()
                if tb != last:  # a leader's pairs mostly follow each other
                    last, seen = tb, kmers(words_of(tb))
                good.append(similarity(kmers(words_of(ta)), seen, threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting, whatever the sizes: both sides grow with the documents, and a broadcast would have no bound."""
    return left.join(right.hint("merge"), on, how)


def _labelled_kmers(texts: DataFrame, share: int) -> DataFrame:
    """u, class and the labelled k-mers of the rows (u, class, text): one of ``share`` by their hash, the same ones in every text."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("u", "class", "kmer")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memory.enter("minhash", _HASHES.clear)
        for batch in batches:
            column, made, start, held = batch.column(2), [], 0, 0
            for i in range(len(column)):
                h = labelled(kmers(words_of(column[i].as_py())))
                made.append(h[h % np.uint64(share) == 0])
                held += len(made[-1])
                if held >= KMERS or i == len(column) - 1:
                    which = pa.array(np.repeat(np.arange(start, i + 1), [len(h) for h in made]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(np.concatenate(made).view(np.int64))], names=schema.names)
                    made, start, held = [], i + 1, 0

    return texts.select("u", "class", "text").mapInArrow(run, schema)


def _needed(total: Column, threshold: float) -> Column:
    """``least_common`` as a column."""
    return F.ceil(total * threshold / (1 + threshold) - 1e-9)


def _may_link(threshold: float) -> Column:
    """Whether ``left`` of n k-mers can be the common ones of a link to a text of any length that fits."""
    return F.col("left") >= _needed(F.col("n") + F.ceil(F.col("n") * threshold - 1e-9), threshold)


def _reachable(scratch: Scratch, nodes: DataFrame, texts: DataFrame, threshold: float, share: int) -> DataFrame:
    """The nodes (u, class, n) that may be linked to another class, as far as one of ``share`` k-mers tells.

    The k-mers that one class alone has can't be common to two classes; a node with too many of them is left out.
    """
    kmers_ = scratch.write(_labelled_kmers(_merge(texts, nodes.select("u", "class"), "u"), share), f"kmers{share}")
    # Of a k-mer, the least and the largest class tell whether it has one class alone; both are combined before the shuffle.
    own = kmers_.groupBy("kmer").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low = high").select("kmer")
    private = _merge(kmers_, own, "kmer", "left_semi").groupBy("u").agg(F.count(F.lit(1)).alias("private"))
    bound = _merge(nodes, private, "u", "left").withColumn("left", F.col("n") - F.coalesce("private", F.lit(0)))
    return scratch.write(bound.filter(_may_link(threshold)).select("u", "class", "n"), f"reachable{share}")


def _prefixes(scratch: Scratch, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """kmer, u, n and left: of each node (u, class, n) the rare k-mers of which a link to another class has one at least.

    The k-mers of a node stand in the order of how many nodes have them, those of its own class alone first. ``left``
    counts a k-mer and those after it. Of two linked nodes, the first k-mer that they share has as many left in each
    as the link needs; so k-mers with fewer left, and those of one class alone, lead to no link.
    """
    kmers_ = scratch.write(_labelled_kmers(_merge(texts, nodes.select("u", "class"), "u"), 1), "kmers")
    shared = kmers_.groupBy("kmer").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("kmer", "df")
    common_ = _merge(_merge(kmers_.select("u", "kmer"), shared, "kmer"), nodes.select("u", "n"), "u")
    after = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("df"), F.desc("kmer")))
    return common_.withColumn("left", after).filter(_may_link(threshold)).select("kmer", "u", "n", "left")


def _grouped(docs: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, h1, h2) of every row, and (h1, h2, root) of every node; the nodes of a class have one root."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.write(sketched(docs, key, text), "rows")
    nodes = rows.groupBy("h1", "h2").agg(F.min(key).alias("_id"), F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.first("bins").alias("bins"))
    nodes = scratch.write(nodes.withColumn("u", F.monotonically_increasing_id()), "nodes")
    entries = nodes.filter("n > 0").select("u", F.posexplode("sketches").alias("j", "value")).select(F.xxhash64("j", "value").alias("bucket"), "u")
    crowded = scratch.write(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "crowded")
    held = scratch.write(_merge(entries, crowded, "bucket"), "entries")
    # A node whose buckets are crowded is close to many others, as the text is that copies were made from.
    known = held.groupBy("u").agg(F.sum("size").alias("fame"))
    known = scratch.write(_merge(known, nodes.select("u", "h1", "h2", "_id", "n", "bins"), "u"), "known")
    held = scratch.write(_merge(held.select("bucket", "u"), known.select("u", "n", "fame"), "u"), "held")
    leader = held.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("u")).alias("v"), "n")).alias("f")).select("bucket", (-F.col("f.v")).alias("b"), F.col("f.n").alias("m"))

    # The texts of the nodes that share a bucket, once.
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    texts = scratch.write(_texts(texts, known.select("u", "h1", "h2", "_id")), "texts")

    fits = F.least("n", "m") >= threshold * F.greatest("n", "m")
    led = _merge(held.select("bucket", F.col("u").alias("a"), "n"), leader, "bucket").filter((F.col("a") != F.col("b")) & fits)
    bins_ = known.select("u", "bins")
    pairs = _merge(led.select("a", "b", "n", "m").distinct(), bins_.toDF("a", "bins_a"), "a")
    links = [_linked(scratch, _possible(_merge(pairs, bins_.toDF("b", "bins_b"), "b"), threshold), texts, threshold, 0)]
    roots = components(links[0], scratch, "classes0")

    # Members of buckets that still hold several classes. First a share of the k-mers tells most of those that no other class can reach.
    now = _with_class(held.select("bucket", "u", "n"), roots)
    several = _merge(now, _mixed(now, "bucket"), "bucket", "left_semi").select("u", "class", "n").distinct()
    several = _reachable(scratch, scratch.write(several, "several"), texts, threshold, SHARE)
    active = scratch.write(_prefixes(scratch, several, texts, threshold), "active0")
    round_, leaders = 1, LEADERS
    while True:
        now = scratch.write(_with_class(active, roots), f"now{round_}")
        mixed = scratch.write(_mixed(now, "kmer"), f"mixed{round_}")
        if mixed.isEmpty():
            break
        # Leaders come from all classes of a k-mer but its largest, smallest first; when they have met all, one class is left.
        sizes = now.groupBy("kmer", "class").agg(F.count(F.lit(1)).alias("size"))
        few = _merge(_merge(now, mixed, "kmer").filter(F.col("class") != F.col("most")), sizes, ["kmer", "class"])
        rank = F.row_number().over(Window.partitionBy("kmer").orderBy("size", "u"))
        lead = few.withColumn("rank", rank).filter(F.col("rank") <= leaders)
        lead = scratch.write(lead.select("kmer", F.col("u").alias("b"), F.col("n").alias("m"), F.col("class").alias("own"), F.col("left").alias("left_b")), f"lead{round_}")
        others = scratch.write(_merge(now, mixed, "kmer", "left_semi"), f"others{round_}")
        # A pair of leaders would come twice, and one of texts that share several rare k-mers more than once.
        can = F.least("left", "left_b") >= _needed(F.col("n") + F.col("m"), threshold)
        pairs = _merge(others, lead, "kmer").filter((F.col("class") != F.col("own")) & fits & can)
        pairs = pairs.select(F.least("u", "b").alias("a"), F.greatest("u", "b").alias("b")).distinct()
        links.append(_linked(scratch, pairs, texts, threshold, round_))
        roots = components(_union(links), scratch, f"classes{round_}")
        active = _merge(others, lead.select("kmer", F.col("b").alias("u")), ["kmer", "u"], "left_anti").drop("class")
        round_, leaders = round_ + 1, leaders * 4

    whole = nodes.select("u", "h1", "h2")
    whole = whole.withColumn("root", F.col("u")) if roots is None else _merge(whole, roots.withColumnRenamed("node", "u"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    return rows.select(key, "h1", "h2"), scratch.write(whole.drop("u"), "whole")


def _with_class(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``entries`` with the class of u."""
    if roots is None:
        return entries.withColumn("class", F.col("u"))
    return _merge(entries, roots.withColumnRenamed("node", "u"), "u", "left").withColumn("class", F.coalesce("root", "u")).drop("root")


def _mixed(entries: DataFrame, by: str) -> DataFrame:
    """``by`` and its largest class, of those values in (by, class) that several classes have."""
    sizes = entries.groupBy(by, "class").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(by).agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("size", "class")).alias("f")).filter("k > 1").select(by, F.col("f.class").alias("most"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """key and class_id of every row of ``docs``."""
    rows, nodes = _grouped(docs, key, text, threshold)
    each = _merge(rows, nodes, ["h1", "h2"])
    least = each.groupBy("root").agg(F.min(key).alias("class_id"))
    return _merge(each, least, "root").select(key, "class_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """u and text of the wanted nodes: the row of a node's least id that has its words."""
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, h1, h2, t = (batch.column(i) for i in range(4))
            good = [words_hash(words_of(t[i].as_py())) == [h1[i].as_py(), h2[i].as_py()] for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([u, t], names=["u", "text"]).filter(pa.array(good, pa.bool_()))

    # Ids can repeat with other texts, and rows with both; any row with the right words will do.
    joined = _merge(texts, wanted, texts["_id"].eqNullSafe(wanted["_id"])).select("u", "h1", "h2", "_text")
    return joined.mapInArrow(run, schema)


def _linked(scratch: Scratch, pairs: DataFrame, texts: DataFrame, threshold: float, round_: int) -> DataFrame:
    pairs = scratch.write(pairs, f"pairs{round_}")
    a = texts.select(F.col("u").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("u").alias("b"), F.col("text").alias("text_b"))
    return scratch.write(_verified(_merge(_merge(pairs, a, "a"), b, "b"), threshold), f"links{round_}")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _h1 and _h2, the hash of a text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            made = [words_hash(words_of(column[i].as_py())) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], pa.int64()) for k in (0, 1))], names=[*batch.schema.names, "_h1", "_h2"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType())]))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, of its least id (null is the largest); columns as they were.

    Where several rows have that id, the class keeps one of those with the words of least hash.
    """
    rows, nodes = _grouped(docs, key, text, threshold)
    each = _merge(rows.groupBy(key, "h1", "h2").agg(F.count(F.lit(1)).alias("_rows")), nodes, ["h1", "h2"])
    chosen = each.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("_none"), F.col(key).alias("_key"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))).alias("_c")).select("_c._key", "_c._h1", "_c._h2")
    # Ids of one row need no look at the text.
    often = each.groupBy(F.col(key).alias("_often")).agg(F.sum("_rows").alias("_n"))
    chosen = Scratch(docs.sparkSession, "one").write(_merge(chosen, often, F.col("_key").eqNullSafe(F.col("_often"))).drop("_often"), "chosen")
    lone = _merge(docs, chosen.filter("_n = 1"), docs[key].eqNullSafe(chosen["_key"]), "left_semi")
    keys = chosen.filter("_n > 1").select("_key").distinct()
    shared = _hashed(_merge(docs, keys, docs[key].eqNullSafe(keys["_key"]), "left_semi"), text)
    more = chosen.filter("_n > 1").select("_key", F.col("_h1").alias("_g1"), F.col("_h2").alias("_g2"))
    found = _merge(shared, more, shared[key].eqNullSafe(more["_key"]) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")), "left_semi")
    return lone.unionByName(found.dropDuplicates([key, "_h1", "_h2"]).drop("_h1", "_h2"))
