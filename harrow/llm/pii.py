"""Personal data: base patterns, and candidates chosen by gradient boosted trees, in DataFrame operations alone.

Base spans are the leftmost non-overlapping matches of four patterns, of which failing ones are dropped without
another try. A base pattern can swallow neighbours (a phone number that runs into a card number fails as a
whole), so generators of high recall propose further spans, which may overlap. Their format and context become
features; boosted trees of depth two give a margin, Platt scaling a probability, and a threshold for each kind
selects. The trees are trained on generated sentences whose answers are known (SYNTHETIC of them), with the
features computed by the same columns, and compiled to CASE expressions, so scoring stays in the JVM. Scaling and
thresholds come from sentences of other phrases than the trees were fitted to. Phrases are dealt to right and wrong
candidates alike (a card number that fails its check digit follows "visa", a phone number follows none of the words
that the features know), so no word decides alone.

Offsets are code points, ends exclusive. Defined cases: a null text is the empty text, with no spans; equal
spans of one kind count once; repeated rows are treated alike; other columns pass through, but _base and _spans are
replaced; an empty table gives no rows. The quantified groups of all patterns are possessive,
which Java matches in a loop, so texts of any length need no deep stack.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of these names are replaced by ``find``.
RESERVED = ("_base", "_spans")
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns; a start inside a run of the first class can't match where the run's start doesn't, unless a match ended there.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a try.
SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
DOT = r"(?:[\x20]?(?:\(dot\)|\[dot\]|[\x20]dot[\x20])[\x20]?|\.)"
AT = r"(?:[\x20]?(?:\(at\)|\[at\])[\x20]?|[\x20]at[\x20]|[\x20]@[\x20]?|@[\x20]?)"
#: Generators of candidates: kind, pattern, sign.
GENERATORS = (
    ("email", rf"(?<![{LOCAL}])[A-Za-z0-9_%+-]{{1,64}}+(?:{DOT}[A-Za-z0-9_%+-]{{1,64}}+){{0,3}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{2,24}}+){{1,4}}+", r"[(\[]at[)\]]| at [A-Za-z0-9-]+ ?(?:dot |[(\[]dot)| @|@ |@[A-Za-z0-9-]+ ?(?:dot |[(\[]dot)"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+)?+(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::"),
    ("card", r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{2,4}+)(?![0-9])", r"[0-9]{4}[\x20-]?[0-9]{4}"),
    ("phone", r"\+[0-9]{1,3}+[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}+(?:[\x20.-][0-9]{2,4}+(?![0-9])){1,3}+", r"\+[0-9]"),
    ("phone", r"(?<![0-9+.(-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("phone", r"(?<![0-9+.(/-])0[1-9][0-9]{1,3}[\x20/-][0-9]{5,8}(?![0-9.-])", r"0[0-9]{2,4}[\x20/-][0-9]{5}"),
)
FEATURES = ("kind", "digits", "separators", "luhn", "plus", "brackets", "glued_before", "glued_after", "word_next", "word_near", "other_near", "distinct", "length", "dots", "ending", "letters", "zero")
NEAR = {"email": "mail|contact|write|reach", "ip": "ip|host|server|addr|from|connect", "card": "card|visa|pay|charg|debit|credit|account", "phone": "tel|phone|call|fax|mobile|ring|text|contact|reach|number|whatsapp"}
NOT_NEAR = "order|serial|isbn|version|ticket|part|model|id|hash|code|ref"
ENDINGS = "com|org|net|edu|gov|info|io|co|de|fr|uk|es|it|eu|us|ca|nl|ch|at|pl|be|se|au|jp|br|ru|in"
SYNTHETIC, ROUNDS, SHRINK, SEED = 6_000, 40, 0.3, 11
#: Share of selected candidates that must be right, on generated sentences that the trees were not fitted to.
PRECISION = 0.98


def spans_of(text: Column, pattern: str, sign: str) -> Column:
    """array<struct<start,end,found>> of the leftmost non-overlapping matches; lengths of gaps and matches add up to places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(F.transform(gaps, F.length), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))).alias("out"))

    fold = F.aggregate(F.filter(both, lambda x: x["found"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    has = F.contains(text, F.lit(sign)) if sign == "@" else text.rlike(sign)
    return F.when(has, fold).otherwise(empty)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the check digit of a card number."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit((2 * k) % 10 + (2 * k) // 10) for k in range(10)]), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(F.filter(marks, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(digits_of(found))
    return n.between(10, 15) if kind == "phone" else n.between(14, 19) & luhn(digits_of(found))


def _check(kind: str):
    return lambda x: _holds(kind, x["found"])


def _span(number: int, *more: str):
    """A found match as a span of a kind."""
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), *[x[m].alias(m) for m in more])


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> sorted by start, then kind as listed."""
    parts = []
    for number, kind in enumerate(KINDS):
        good = F.filter(spans_of(text, BASE[kind], SIGN[kind]), _check(kind))
        parts.append(F.transform(good, _span(number)))
    return F.array_sort(F.concat(*parts))


def candidates(text: Column) -> Column:
    """array<struct<start,kind,end,found>> of all generators, without those inside another one of their kind."""
    parts = [F.transform(spans_of(text, pattern, sign), _span(KINDS.index(kind), "found")) for kind, pattern, sign in GENERATORS]
    every = F.array_distinct(F.concat(*parts))
    wider = lambda c, o: (o["kind"] == c["kind"]) & (o["start"] <= c["start"]) & (c["end"] <= o["end"]) & (o["end"] - o["start"] > c["end"] - c["start"])
    return F.transform(F.array(every), lambda a: F.filter(a, lambda c: ~F.exists(a, lambda o: wider(c, o))))[0]


def features(text: Column, c: Column) -> Column:
    """FEATURES of a candidate as an array of doubles."""
    found = c["found"]
    before = F.lower(F.substring(text, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24))))
    prior, after = F.substring(text, c["start"], F.when(c["start"] > 0, 1).otherwise(0)), F.substring(text, c["end"] + 1, F.lit(1))
    by_kind = lambda end: reduce(lambda a, k: F.when(c["kind"] == KINDS.index(k), before.rlike(rf"(?<![a-z])(?:{NEAR[k]}){end}").cast("int")).otherwise(a), KINDS, F.lit(0))
    far = before.rlike(rf"(?:{NOT_NEAR})[a-z]*[^a-z]*$").cast("int")
    digits = digits_of(found)
    values = [
        c["kind"],
        F.length(digits),
        F.length(F.regexp_replace(found, r"[^\x20.()\[\]-]", "")),
        ((c["kind"] == 2) & luhn(digits)).cast("int"),
        F.startswith(found, F.lit("+")).cast("int"),
        found.rlike(r"[(\[]").cast("int"),
        prior.rlike("[A-Za-z0-9]").cast("int"),
        after.rlike("[A-Za-z0-9]").cast("int"),
        by_kind(r"[a-z]*[^a-z]*$"),
        by_kind(""),
        far,
        F.size(F.array_distinct(F.split(digits, ""))),
        c["end"] - c["start"],
        F.length(F.regexp_replace(found, r"[^.]|\.$", "")) + F.regexp_count(found, F.lit("dot")),
        F.lower(found).rlike(rf"(?:\.|dot[\])]?\x20?)(?:{ENDINGS})$").cast("int"),
        F.length(F.regexp_replace(found, "[^A-Za-z]", "")),
        F.startswith(found, F.lit("0")).cast("int"),
    ]
    return F.array(*[v.cast("double") for v in values])


#: Phrases before a candidate, for the sentences that trees are fitted to and for those that scale and choose. What is
#: said before right ones is said before wrong ones too, in other shares.
LEADS = (
    {"email": ("drop a line to", "you find her under", "mail", "e-mail:", "send it over to", "contact"), "ip": ("ping", "the machine at", "host", "blocked traffic from", "listening on"),
     "card": ("visa", "please bill", "card number", "the plastic says", "paid with", "debit card"), "phone": ("call me on", "dial", "tel.", "my number is", "we talk under", "mobile"),
     "other": ("order", "the part", "item", "we saw", "as in", "serial no", "ticket", "chapter", "it says")},
    {"email": ("write to", "reach him via", "his address is", "e-mail", "questions go to"), "ip": ("server", "connect to", "address", "the router answers on", "from"),
     "card": ("charge it to my", "mastercard", "credit card", "account", "number on the front:"), "phone": ("ring", "phone", "fax", "text me at", "get hold of us on", "telephone number"),
     "other": ("reference", "model", "version", "see", "code", "in total", "the id", "line")},
)


def _sentences(n: int, part: int, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Generated sentences with the phrases of a part of LEADS, and the personal data in each."""
    rng = random.Random(seed * 1000 + part)
    words = ("lorem the report river stone of and plan over under green table light wind for with das und le por que".split(), "some more about house water old road to by near ein nicht dans pour una los time add bad face cafe".split())[part]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: ":".join(f"{rng.randrange(65536):x}" for _ in range(k))
    ending = lambda: rng.choice(ENDINGS.split("|"))

    def card(good: bool) -> str:
        head = rng.choice("3456") + number(rng.choice((14, 14, 14, 13, 17)))
        total = sum((2 * int(d)) % 10 + (2 * int(d)) // 10 if i % 2 == 0 else int(d) for i, d in enumerate(reversed(head)))
        last = (10 - total % 10) % 10
        whole, sep = head + str(last if good else (last + rng.randrange(1, 10)) % 10), rng.choice(("", " ", "-"))
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4)) if sep and len(whole) == 16 else whole

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+{rng.randrange(20, 99)} {number(3)} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 {a}.{b}.{c}", f"{a} {b} {c}", f"0{rng.randrange(20, 999)}{rng.choice(' /-')}{number(rng.randrange(5, 9))}"))

    def email() -> str:
        at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", "."), ("@", " (dot) "), (" [at] ", ".")))
        name = rng.choice((rng.choice(words), f"{rng.choice(words)}.{number(2)}", f"{rng.choice(words)}{dot}{rng.choice(words)}"))
        return f"{name}{at}{rng.choice(words)}{dot if rng.random() < 0.8 else '.'}{ending()}"

    def wrong(kind: str) -> str:
        if kind == "email":
            return rng.choice((f"{prose(1)} at {prose(1)} dot {prose(1)}", f"{prose(1)} @ {number(1)}.{number(2)}", f"{prose(1)} @ {prose(1)}.{prose(1)}", f"{prose(1)} at {prose(1)} dot {ending()}ly"))
        if kind == "ip":
            return rng.choice((":".join(number(2) for _ in range(8)), f"{rng.choice(('add', 'bad', 'face', 'cafe', 'a', 'b'))}::{rng.choice(('add', 'bad', 'dead', 'beef', 'f'))}", f"{number(1)}::{number(1)}"))
        if kind == "card":
            # A number that passes by chance within a longer code is no card.
            return card(False) if rng.random() < 0.7 else f"{hexes(2).replace(':', '')}{rng.choice('abcdef')}{card(True)}{rng.choice('abcdef')}{hexes(1)}"
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"+{number(2)} {b}", f"+{number(1)}.{number(2)} {number(2)}", f"0{number(3)}-{number(6)}"))

    out = []
    for _ in range(n):
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        said = LEADS[part]
        # Hard cases: the right words before wrong ones, and none of them before right ones.
        at = rng.random()
        lead = rng.choice(said[kind]) if at < (0.7 if good else 0.25) else rng.choice(said["other"]) if not good and at < 0.8 else prose(2)
        if kind == "phone" and not good and at < 0.25:
            lead = rng.choice(said["other"])
        right = {"email": email, "phone": phone, "card": lambda: card(True), "ip": lambda: rng.choice((hexes(8), f"2001:{hexes(1)}::{hexes(1)}", f"fe80::{hexes(4)}", f"{hexes(3)}::{hexes(2)}"))}
        what = right[kind]() if good else wrong(kind)
        more = card(True) if kind == "phone" and good and rng.random() < 0.25 else ""
        tail = f" {more}" if more else rng.choice(("", ".", ","))
        out.append((f"{prose(5)} {lead} {what}{tail} {prose(4)}", [x for x in (what, more) if good and x]))
    return out


class Trees:
    """Boosted trees of depth two by logistic loss, with Platt scaling and a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray, other: np.ndarray):
        """``other`` marks the rows of other phrases: one half scales, the other chooses thresholds."""
        fit, half = ~other, np.cumsum(other) % 2 == 0
        scale, choose = other & half, other & ~half
        self.bias = float(np.log((y[fit].mean() + 1e-3) / (1 - y[fit].mean() + 1e-3)))
        self.trees: list[tuple] = []
        margin = np.full(fit.sum(), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x[fit], y[fit] - p, p * (1 - p), 2)
            self.trees.append(tree)
            margin += self._value(tree, x[fit])
        self.scale = self._platt(self.margins(x[scale]), y[scale])
        self.thresholds = [self._threshold(self.probability(x[choose & (x[:, 0] == k)]), y[choose & (x[:, 0] == k)]) for k in range(len(KINDS))]

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
        leaf = SHRINK * float(g.sum() / (h.sum() + 1.0))
        best = (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for f in range(x.shape[1]) if depth else ():
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= t
                if 4 < low.sum() < len(low) - 4:
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - whole
                    if gain > best[0]:
                        best = (gain, f, float(t))
        if best[1] is None:
            return (leaf,)
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)

    def _value(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        return np.where(x[:, tree[0]] <= tree[1], self._value(tree[2], x), self._value(tree[3], x))

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self._value(t, x) for t in self.trees)

    @staticmethod
    def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            a, b = a - 0.05 * float(((p - y) * m).mean()), b - 0.05 * float((p - y).mean())
        return a, b

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.margins(x) + self.scale[1], -30, 30)))

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        """The lowest probability, 0.5 at least, above which enough are right."""
        for t in sorted({0.5, *(float(v) for v in p if v > 0.5)}):
            if (chosen := p >= t).any() and y[chosen].mean() >= PRECISION:
                return t
        return 0.999

    def column(self, at: Column) -> Column:
        """The probability of an array of FEATURES as an expression."""

        def value(tree: tuple) -> Column:
            return F.lit(tree[0]) if len(tree) == 1 else F.when(F.get(at, F.lit(tree[0])) <= F.lit(tree[1]), value(tree[2])).otherwise(value(tree[3]))

        margin = reduce(lambda a, t: a + value(t), self.trees, F.lit(self.bias))
        return 1 / (1 + F.exp(-(F.lit(self.scale[0]) * margin + F.lit(self.scale[1]))))


_TRAINED: dict[str, Trees] = {}


def trees(spark: SparkSession) -> Trees:
    """The trained trees, once for each driver."""
    if "trees" not in _TRAINED:
        rows = examples(spark, [(*x, part) for part in (0, 1) for x in _sentences(SYNTHETIC // 2, part)])
        _TRAINED["trees"] = Trees(*(np.array([r[c] for r in rows]) for c in ("x", "y")), np.array([r["part"] == 1 for r in rows]))
    return _TRAINED["trees"]


def examples(spark: SparkSession, sentences: list[tuple[str, list[str], int]]) -> list:
    """part, x (FEATURES) and y (whether it is personal data) of each candidate in generated sentences (text, what, part): as many rows at most as those hold."""
    frame = spark.createDataFrame(sentences, "text string, what array<string>, part int")
    each = frame.select("text", "what", "part", F.explode_outer(candidates(F.col("text"))).alias("c")).filter(F.col("c").isNotNull())
    rows = each.select("part", "text", "c.start", features(F.col("text"), F.col("c")).alias("x"), F.array_contains("what", F.trim("c.found")).cast("int").alias("y")).collect()
    return sorted(rows, key=lambda r: (r["part"], r["text"], r["start"], r["x"]))


def added_spans(text: Column, base: Column, model: Trees) -> Column:
    """Candidates that the trees select and that no base span of their kind overlaps: array<struct<start,kind,end>>."""
    clear = F.filter(candidates(text), lambda c: ~F.exists(base, lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    limits = F.array(*map(F.lit, model.thresholds))
    scored = F.transform(clear, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), features(text, c).alias("x")))
    chosen = F.filter(scored, lambda c: model.column(c["x"]) >= F.get(limits, c["kind"]))
    return F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _base and _spans (all of them), arrays of (start, kind number, end) by start, then kind.

    The columns before each step are set apart, so a later one reads them and repeats no matching.
    """
    model = trees(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    # Most texts hold none of the signs: one look tells.
    some = t.rlike(r"[0-9@]|[(\[]at[)\]]|::| dot ")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    based = docs.drop(*RESERVED).withColumn("_base", F.when(some, base_spans(t)).otherwise(none))
    return based.withColumn("_spans", F.when(some, F.array_sort(F.concat("_base", added_spans(t, F.col("_base"), model)))).otherwise(none))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with spans replaced by [kind]; overlapping ones by the label of the first."""
    t = F.coalesce(text, F.lit(""))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        more = F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        apart = s["start"] >= acc["at"]
        return F.struct(F.when(apart, F.concat(acc["parts"], more)).otherwise(acc["parts"]).alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and lists of spans of each text."""
    found = find(docs.select(key, text), text)
    of = lambda n: F.size(F.filter("_base", lambda s: s["kind"] == n)).cast("long")
    counts = [of(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))
