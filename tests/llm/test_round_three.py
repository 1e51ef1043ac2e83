"""Hard negatives, online packing and vector codes against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrow.llm import hard_negatives, level_packing, vector_codes
from harrow.llm.queries import vocabulary

VECTORS = "vec_id long, embedding array<float>, label int, u int, id string, block long"
BYTES = vocabulary("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3) for r in rows], VECTORS)


def finite(e):
    return e is not None and all(x is not None and np.isfinite(x) for x in e)


def floors(e, scale):
    return [int(np.floor(float(np.float32(x)) * scale)) for x in e]


ODD = [(50, None, 1), (60, [None, 1.0, 0.0, 0.0], 1), (70, [float("nan"), 1.0, 0.0, 0.0], 1), (80, [float("inf"), 1.0, 0.0, 0.0], 1), (90, [0.5, 0.5, 0.5, 0.5], None), (100, [0.0] * 4, 2), (110, [1.0, 2.0], 1), (120, [], 1), (None, [0.5, 0.5, 0.5, 0.5], 1)]


# 11


def brute_negatives(rows, every, k=5, low=80, high=100):
    good = [(i, floors(e, 256), y) for i, e, y in rows if i is not None and y is not None and finite(e)]
    out = []
    for n, (i, x, y) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, x2, strict=True)), j, m) for m, (j, x2, _) in enumerate(good) if m != n and len(x) == len(x2))
        for s, p, _ in [t for t in scored if good[t[2]][2] == y][:k]:
            within = [(t[1], -t[0]) for t in scored if good[t[2]][2] != y and low * -s <= 100 * -t[0] <= high * -s]
            out += [(i, p, r, j, -s, score) for r, (j, score) in enumerate(within[:k], 1)]
    return out


def mined(got):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize(("block", "chunk"), [((256, 1024), 32), ((3, 20), 3)])
def test_negatives(spark, block, chunk):
    rng, rows = np.random.default_rng(2), []
    for i in range(240):
        # Few different components, so that many scores are equal; a third of the rows has one label.
        rows.append((i, [float(x) for x in rng.integers(-1, 3, 8) / 4], 0 if i % 3 else int(rng.integers(0, 5))))
    rows += [rows[10], rows[10], (20, rows[11][1], 3)]
    got = mined(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, block=block, chunk=chunk))
    want = sorted(brute_negatives(rows, 10))
    assert got == want and len(want) > 400


def test_negatives_odd(spark):
    rows = ODD + [(10 * i, [0.1 * i, 0.5, -0.2, 0.3], i % 2) for i in range(5)] + [(200, [1.0, 2.0], 2), (210, [], 2), (300, [3e38, 0.0, 0.0, 0.0], 1)]
    got = mined(hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0))
    assert [r for r in got if 300 not in (r[0], r[1], r[3])] == [r for r in sorted(brute_negatives([r for r in rows if r[0] != 300], 10)) if 300 not in r[:2]]
    assert hard_negatives.mine(frame(spark, []), F.lit(True)).collect() == []
    assert hard_negatives.mine(frame(spark, rows), F.lit(None).cast("boolean")).collect() == []


def test_first_rows():
    rng = random.Random(3)
    for _ in range(300):
        scores = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 30))])
        at = np.array(sorted(rng.sample(range(len(scores)), rng.randrange(len(scores) + 1))), np.int64)
        assert hard_negatives.first_rows(scores, at, 5).tolist() == sorted(at.tolist(), key=lambda i: (-scores[i], i))[:5]
    big = np.array([[2**28, 2**28 - 1]])
    assert hard_negatives.product(big, big)[0, 0] == 2**56 + (2**28 - 1) ** 2


# 12


def check_packed(rows, docs, ids=None):
    """Pieces cover every document once, sequences have no gap and no padding but at powers of two."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id, r.doc_tokens].append(r)
        of_sequence[r.sequence_id].append(r)
    for places in of_sequence.values():
        at = 0
        for r in sorted(places, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc_id, text in docs:
        made = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc_id, len(made)] += 1
        if sum(d == doc_id for d, _ in docs) == 1:
            at = 0
            for r in sorted(of_doc[doc_id, len(made)], key=lambda r: r.start):
                assert r.start == at and zlib.crc32(made[at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
            assert at == len(made)
    assert set(of_doc) == set(want)
    assert {k: sum(r.length for r in v) for k, v in of_doc.items()} == {k: n * k[1] for k, n in want.items()}
    return of_doc, of_sequence


def test_online_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    of_doc, of_sequence = check_packed(level_packing.pack_online(docs, BYTES).collect(), texts)
    # A settled window takes one end of a piece at most.
    assert sum(len(v) - -(-k[1] // 2048) for k, v in of_doc.items()) <= len(of_sequence)
    withs = level_packing.pack_online(docs.withColumn("start", F.lit(1)), BYTES, ids="ids").collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in withs)


def test_online_packing_odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t x  y "), (4, "same"), (5, "same"), (5, "same"), (None, "no id"), (6, long), (7, "a <|endoftext|> b<|endoftext|> \x1c  c ünï\ncode 😀"), (8, "<|endoftext|>")]
    schema = "doc_id long, text string, start string, sequence_id string"
    check_packed(level_packing.pack_online(spark.createDataFrame([(*r, "", "") for r in rows], schema).repartition(1), BYTES).collect(), rows)
    assert level_packing.pack_online(spark.createDataFrame([], schema), BYTES).collect() == []


def test_ids_equal_those_of_the_tokenizers_library():
    """Every code point beside letters, digits, spaces and itself, and a file that is no rank file."""
    encoder, tokenizer = level_packing.ByteLevelIds(BYTES), Tokenizer.from_file(BYTES)
    assert encoder.fast is not None
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    texts = ["".join(f"a{c}b {c}{c}1 {c}\n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["x" * 3_000, "don't can't we'll'", "  a  \n\n b\t ", "'s 'S"]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.of(text), "<u4").tolist() == want.ids
    other = level_packing.ByteLevelIds(vocabulary("word_bpe_49k.json"))
    assert other.fast is None and len(other.of("Some words")) == 8


def naive_level(counts, size, capacity):
    """The placement by its definition: the sum of squares after each possible one."""
    def after(level):
        made = dict(counts)
        if level:
            made[level] -= 1
        made[level + size] = made.get(level + size, 0) + 1
        return sum(n * n for h, n in made.items() if h != capacity)

    return min((h for h in [0, *[h for h, n in counts.items() if n]] if h + size <= capacity), key=lambda h: (after(h), -h))


def test_levels_follow_the_sum_of_squares():
    rng, capacity = random.Random(4), 32
    levels, counts = level_packing.Levels(capacity), {}
    for _ in range(2_000):
        size = rng.randint(1, capacity)
        level = levels.choose(size)
        assert level == naive_level(counts, size, capacity)
        levels.move(level, level + size)
        if level:
            counts[level] -= 1
        if level + size < capacity:
            counts[level + size] = counts.get(level + size, 0) + 1
    assert levels.counts.tolist() == [counts.get(h, 0) for h in range(capacity + 1)]


@pytest.mark.parametrize("sizes", [[1_500] * 3_000, [1] * 5_000, [2_048] * 9, [700, 1_300, 30] * 500, [1_025] * 7])
def test_windows_are_settled(sizes):
    packer = level_packing.Packer(2048, open_windows=100)
    done, most = [], 0
    for k, n in enumerate(sizes):
        done += packer.place(k, np.full(n, k, "<u4").tobytes())
        most = max(most, packer.n_open)
    done += packer.finish()
    assert most <= 100
    fills, ids = [sum(len(p[2]) for p in w) // 4 for w in done], defaultdict(list)
    for w in done:
        for k, start, part in w:
            assert set(np.frombuffer(part, "<u4")) == {k}
            ids[k].append((start, len(part) // 4))
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills) and len(fills) <= -(-sum(sizes) // 2048) + 11
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(ids[k]):
            assert start == at
            at += length
        assert at == n


# 13


def brute_codes(rows, parts=4, entries=256, rounds=4):
    good = sorted((r for r in rows if finite(r[1])), key=lambda r: (r[0] is None, r[0] or 0, floors(r[1], 1024)))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    x = np.array([floors(r[1], 1024) for r in good], np.int64).reshape(len(good), parts, -1)
    books = [[x[i, p].copy() for i in range(min(entries, len(x)))] for p in range(parts)]

    def assigned():
        out = np.zeros((len(x), parts, 2), np.int64)
        for p in range(parts):
            book = np.array(books[p])
            for i in range(len(x)):
                d = ((book - x[i, p]) ** 2).sum(axis=1)
                out[i, p] = d.argmin(), d.min()
        return out

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            for c in range(len(books[p])):
                own = x[at[:, p, 0] == c, p]
                if len(own):
                    books[p][c] = own.sum(axis=0) // len(own)
    at = assigned()
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = defaultdict(int)
    for r, a in zip(good, at, strict=True):
        errors[r[2]] += int(a[:, 1].sum())
    return [(r[0], "".join(f"{c:02x}" for c in a[:, 0]), int(a[:, 1].sum()), errors[r[2]], digest) for r, a in zip(good, at, strict=True)]


def coded(got):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()), key=repr)


@pytest.mark.parametrize("entries", [40, 256])
def test_codes(spark, entries):
    rng = np.random.default_rng(3)
    # Few different components, so that many distances are equal, and repeated rows.
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 8], None if i % 7 == 0 else int(i % 3 == 0)) for i in range(300)]
    rows += rows[:20]
    report = []
    got = coded(vector_codes.codes(frame(spark, rows), entries=entries, report=report))
    assert got == sorted(brute_codes(rows, entries=entries), key=repr) and len(report) == 3


def test_codes_skip_groups(spark):
    """Later rounds scan a part of the groups alone."""
    rng, report = np.random.default_rng(4), []
    centres = rng.standard_normal((60, 16))
    rows = [(i, [float(v) for v in centres[i % 60] + rng.standard_normal(16) * 0.1], 1) for i in range(3_000)]
    got = coded(vector_codes.codes(frame(spark, rows), report=report))
    assert max(report) < 0.5 * 3_000 * 4 * 16
    assert got == sorted(brute_codes(rows), key=repr)


def test_codes_odd(spark):
    rows = ODD + [(i, [0.1 * i, -0.5, 0.0, 2.0], i % 2) for i in range(10)] + [(11, [1e30, -1e30, 0.0, 0.0], 5)]
    got = coded(vector_codes.codes(frame(spark, rows)))
    other = {r[:4] for r in got if r[1] is None}
    assert other == {(110, None, None, None), (120, None, None, None)} and len(got) == 16
    small = [r for r in rows if r[0] != 11]
    assert [r for r in coded(vector_codes.codes(frame(spark, small))) if r[1]] == sorted(brute_codes(small), key=repr)
    assert vector_codes.codes(frame(spark, [])).collect() == []
    assert coded(vector_codes.codes(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]))) == [(1, None, None, None, None)]


def test_nearest_keeps_true_bounds():
    """After every round no entry of a group but the own one is nearer than the group's bound, and entries are those of brute force."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, book = rng.integers(-8, 9, (60, 3)), rng.integers(-8, 9, (24, 3))
        groups, state = vector_codes.entry_groups(book, 4), ()
        for _ in range(4):
            code, error, lower, _ = vector_codes.nearest(x, book, groups, *state)
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
            d = d.astype(float)
            d[np.arange(60), code] = np.inf
            for g, members in enumerate(groups):
                assert (lower[:, g] <= np.sqrt(d[:, members].min(axis=1))).all()
            moved = book + rng.integers(-1, 2, book.shape)
            far = np.sqrt(((moved - book) ** 2).sum(axis=1)) * (1 + 1e-9)
            book, state = moved, (code, lower, np.array([far[m].max() for m in groups]))
