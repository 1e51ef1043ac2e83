"""Rules over running text: each yields spans (start, end, label) or a boolean, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import spans as S
from harrow.functions import text as X

CARD = "[0-9](?:[ -]?[0-9]){12,18}"
SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
#: Kinds of secrets by their published shapes, and assignments of long hex or mixed values.
SECRETS = {
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "aws key": "(?:AKIA|ASIA)[A-Z0-9]{16}",
    "github token": "gh[pousr]_[A-Za-z0-9]{36,}",
    "slack token": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "private key": "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "secret": r"(?:token|secret|password|api_?key)[\x22']? ?[:=] ?[\x22']?[A-Za-z0-9_/+.-]{20,}",
}
#: Thresholds of encoded runs.
BASE64_MIN, HEX_MIN, PERCENT_MIN, CIPHER_MIN, LEET_MIN, NATO_MIN, MORSE_MIN = 120, 160, 20, 80, 40, 10, 10
DECODED_MIN, PRINTABLE, ENGLISH_MIN, LEET_SIGNS = 40, 0.85, 3, 4
NATO = "alfa alpha bravo charlie delta echo foxtrot golf hotel india juliett juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu".split()
MORSE = dict(zip(".- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --..".split(), "abcdefghijklmnopqrstuvwxyz", strict=True))
#: Families of instructions to a model, by intent.
INJECTION = {
    "override": r"(?:ignore|disregard|forget|override) (?:(?:all|any|the|your|of|these|previous|prior|earlier|above) ){1,4}(?:instructions?|prompts?|rules|directions)",
    "bypass": r"(?:bypass|disable|turn off|circumvent) (?:(?:all|any|the|your) )?(?:safety|guardrails?|filters?|restrictions)",
    "persona": r"you are now (?:a|an|the|in) [a-z]+",
    "persona imperative": r"(?:pretend|act|behave) (?:to be|as if you are|as though you were) ",
    "privileged": r"(?:developer|admin|god|debug|jailbreak) mode (?:enabled|on|activated)",
    "chat token": r"<\|(?:im_start|im_end|system|user|assistant)\|>",
    "end token": r"<\|end_?of_?text\|>",
    "system label": r"(?:^|\n) ?system prompt ?:",
    "directive": r"(?:new|updated|revised) (?:instructions?|directives?|task) ?:",
}
#: Lower-case text without which a family can't match: one look for plain bytes spares most texts the expressions.
INJECTION_NEEDS = {
    "override": ("instruction", "prompt", "rules", "direction"), "bypass": ("bypass ", "disable ", "turn off ", "circumvent "), "persona": ("you are now ",),
    "persona imperative": ("pretend to be ", "act to be ", "behave to be ", " as if you are ", " as though you were "), "privileged": (" mode enabled", " mode on", " mode activated"),
    "chat token": ("<|",), "end token": ("<|",), "system label": ("system prompt",), "directive": ("instruction", "directive", "task"),
}
INJECTION_CASED_NEEDS = {"instruction bracket": ("inst]",), "system bracket": ("sys>>",)}
INJECTION_CASED = {"instruction bracket": r"\[/?INST\]", "system bracket": r"<</?SYS>>"}
SCARCITY = (
    r"only [0-9]+ (?:left|remaining)", r"(?:just|last) [0-9]+ (?:left|items?|rooms?)", r"low stock", r"almost (?:gone|sold out)", r"selling (?:out )?fast", r"limited (?:stock|quantity|availability)",
    r"[0-9]+ (?:people|others|shoppers) (?:are )?(?:viewing|looking|watching)", r"in high demand", r"[0-9]+ (?:sold|bought|booked) (?:in|within) the last", r"(?:in|added to) [0-9]+ (?:carts|baskets)", r"don.t miss out", r"hurry",
)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def card_spans(text: Column) -> Column:
    return S.find(text, S.B + CARD + S.E, "[card hidden]", lambda m: X.luhn(digits(m)))


def ssn_spans(text: Column) -> Column:
    return S.find(text, S.B + SSN + S.E, "[ssn hidden]")


def phone_spans(text: Column) -> Column:
    return S.find(text, r"(?<![0-9.])" + PHONE + "(?![0-9])", "[phone hidden]")


def personal_spans(text: Column) -> Column:
    return S.merge(card_spans(text), ssn_spans(text), phone_spans(text))


def secret_spans(text: Column) -> Column:
    return S.merge(*[S.find(text, p, f"[{kind} hidden]") for kind, p in SECRETS.items()])


#: Windows of a run in which keys are looked for, how far they are apart, the bits of each character that a key has at least,
#: and how many of each class of characters.
WINDOW, STRIDE, BITS, EACH_CLASS = 24, 8, 3.9, 2
#: Runs in which a key can stand; those that follow marks of a URL are names and hashes of its own.
KEY_RUN = f"(?<![A-Za-z0-9_+=/?&.%-])[A-Za-z0-9_+=-]{{{WINDOW},}}+"


def key_like(window: Column) -> Column:
    """Whether the characters of a window are as mixed and as evenly used as those of a random key."""
    many = lambda c: F.length(F.regexp_replace(window, f"[^{c}]", "")) >= EACH_CLASS
    return many("A-Z") & many("a-z") & many("0-9") & (X.shannon_entropy(window) >= BITS)


def entropy_spans(text: Column) -> Column:
    """The maximal stretches of runs of which every window, STRIDE characters apart, is key-like: secrets of no known shape."""
    runs = S.find(text, KEY_RUN, "[secret hidden]")

    def stretches(run: Column) -> Column:
        n = run["end"] - run["start"]
        # The last window ends with the run.
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), n - WINDOW, F.lit(STRIDE)), F.array(n - WINDOW)))
        good = F.filter(starts, lambda i: key_like(F.substring(text, run["start"] + i + 1, F.lit(WINDOW))))
        first = F.array().cast("array<struct<start:int,end:int>>")

        def step(out: Column, i: Column) -> Column:
            start = run["start"] + i
            last = F.try_element_at(out, F.lit(-1))
            grown = F.array_append(F.slice(out, 1, F.size(out) - 1), F.struct(last["start"].alias("start"), (start + WINDOW).alias("end")))
            return F.when((F.size(out) > 0) & (start <= last["end"]), grown).otherwise(F.array_append(out, F.struct(start.alias("start"), (start + WINDOW).alias("end"))))

        return F.transform(F.aggregate(good, first, step), lambda s: F.struct(s["start"], s["end"], run["label"]))

    return F.flatten(F.transform(runs, stretches))


def mask(docs: DataFrame, text: str = "text", *, secrets: bool = False) -> DataFrame:
    """``docs`` with spans and masked, which are computed after one look for digits: three, with a space or dash between them at most, begin
    every card, number and phone."""
    t = F.col(text)
    found = personal_spans(t) if not secrets else S.merge(personal_spans(t), secret_spans(t))
    # A card's digits may all stand apart, and secrets need no digit.
    some = F.lit(True) if secrets else t.rlike("[0-9](?:[ -]?[0-9]){2}")
    return docs.withColumn("spans", F.when(some, found).otherwise(F.array().cast(S.SPAN))).withColumn("masked", S.replace(t, F.col("spans")))


def any_of(text: Column, patterns) -> Column:
    return reduce(lambda a, p: a | text.rlike(p), patterns, F.lit(False))


def injected(text: Column) -> Column:
    """Whether any family matches: one alternation for either case rule, tried on texts that hold what one of them needs."""
    needs = sorted({s for each in (*INJECTION_NEEDS.values(), *INJECTION_CASED_NEEDS.values()) for s in each})
    some = X.once(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in needs]))
    found = text.rlike("(?i)(?:" + "|".join(INJECTION.values()) + ")") | text.rlike("|".join(INJECTION_CASED.values()))
    return F.when(text.isNotNull(), F.coalesce(F.when(some, found), F.lit(False)))


def injection_families(text: Column) -> Column:
    each = [F.when(text.rlike("(?i)" + p), F.lit(k)) for k, p in INJECTION.items()] + [F.when(text.rlike(p), F.lit(k)) for k, p in INJECTION_CASED.items()]
    return F.array_compact(F.array(*each))


def scarce(text: Column) -> Column:
    return text.rlike("(?i)(?:" + "|".join(SCARCITY) + ")")


def printable_share(raw: Column) -> Column:
    """Share of bytes that are printable ASCII, tab or line breaks."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    good = F.filter(pairs, lambda p: p.rlike("^(?:[2-6][0-9A-F]|7[0-9A-E]|0[9AD])$"))
    return F.when(F.size(pairs) == 0, 0.0).otherwise(F.size(good) / F.size(pairs))


def _decodes(raw: Column) -> Column:
    return F.coalesce((F.octet_length(raw) >= DECODED_MIN) & (printable_share(raw) >= PRINTABLE), F.lit(False))


def base64_spans(text: Column) -> Column:
    def good(run: Column) -> Column:
        bare = F.translate(F.rtrim(run, F.lit("=")), "-_", "+/")
        padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
        return (F.length(bare) % 4 != 1) & _decodes(F.try_to_binary(padded, F.lit("base64")))

    runs = S.find(text, f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{BASE64_MIN},}}+={{0,2}}", "[encoded payload hidden]", good)
    # Runs that overlap a token are left to the rule for secrets.
    apart = lambda tokens: F.filter(runs, lambda s: ~F.exists(tokens, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    found = F.transform(F.array(S.find(text, SECRETS["jwt"], "jwt")), apart)[0]
    return F.when(F.length(text) >= BASE64_MIN, found).otherwise(F.array().cast(S.SPAN))


def hex_spans(text: Column) -> Column:
    def good(run: Column) -> Column:
        return (F.length(run) % 2 == 0) & run.rlike("[a-fA-F]") & _decodes(F.unhex(run))

    found = S.find(text, f"(?<![0-9A-Za-z])[0-9A-Fa-f]{{{HEX_MIN},}}+(?![0-9A-Za-z])", "[encoded payload hidden]", good)
    return F.when(F.length(text) >= HEX_MIN, found).otherwise(F.array().cast(S.SPAN))


def percent_spans(text: Column) -> Column:
    def good(run: Column) -> Column:
        codes = F.regexp_extract_all(run, F.lit("%([0-9A-Fa-f]{2})"), F.lit(1))
        return (F.size(codes) >= PERCENT_MIN) & (printable_share(F.unhex(F.array_join(codes, ""))) >= PRINTABLE)

    return S.find(text, "%[0-9A-Fa-f]{2}(?:[^%]{0,8}%[0-9A-Fa-f]{2})++", "[encoded payload hidden]", good)


#: What a text says in a cipher shows in the text itself: its function words in the same cipher, so nothing is decoded.
CIPHERS = {
    "rot13": [w.translate(str.maketrans(X.LOWER, X.LOWER[13:] + X.LOWER[:13])) for w in X.ENGLISH],
    "atbash": [w.translate(str.maketrans(X.LOWER, X.LOWER[::-1])) for w in X.ENGLISH],
    "reversed": [w[::-1] for w in X.ENGLISH],
}


def _among(words: Column, *groups: list[str]) -> Column:
    """The different words of an array that are in any of the groups: one look into a set for each word."""
    return F.array_distinct(F.filter(words, lambda w: w.isin(*sorted({w for g in groups for w in g}))))


def _plain_words(text: Column) -> Column:
    """Runs of ASCII letters in lower case, those of any part of the text that is cut between letters and others."""
    return F.regexp_extract_all(F.translate(text, X.UPPER, X.LOWER), F.lit("[a-z]+"), F.lit(0))


def cipher_of(text: Column) -> Column:
    """The first of rot13, atbash and reversed that turns a text that is not English into English; null for none."""

    def of(words: Column) -> Column:
        out = F.when(X.how_many(words, X.ENGLISH) >= ENGLISH_MIN, None)
        for name, said in CIPHERS.items():
            out = out.when(X.how_many(words, said) >= ENGLISH_MIN, name)
        return out

    # The words are found once, for all four looks.
    return F.when(F.length(text) >= CIPHER_MIN, X.once(_among(X.words_of(text), X.ENGLISH, *CIPHERS.values()), of))


def cipher_spans(text: Column) -> Column:
    """Runs of letters, white space and marks that are in a cipher. A text that has too few words of each cipher has no such run."""
    enough = lambda words: reduce(lambda a, b: a | b, [X.how_many(words, said) >= ENGLISH_MIN for said in CIPHERS.values()])
    some = (F.length(text) >= CIPHER_MIN) & X.once(_among(_plain_words(text), *CIPHERS.values()), enough)
    found = S.find(text, r"""[A-Za-z](?:[\s.,'"!?:;-]*+[A-Za-z]++)*+""", "[encoded payload hidden]", lambda run: cipher_of(run).isNotNull())
    return F.when(some, found).otherwise(F.array().cast(S.SPAN))


def leet_spans(text: Column) -> Column:
    """Runs of letters, digits, signs, white space and marks that read as English once signs are letters. A text with too few signs, or
    too few words once they are letters, has no such run."""
    signs = F.length(F.regexp_replace(text, "[^0134578@$!]", "")) >= LEET_SIGNS
    some = (F.length(text) >= LEET_MIN) & signs & (F.size(_among(_plain_words(X.unleet(text)), X.ENGLISH)) >= ENGLISH_MIN)
    found = S.find(text, r"""[A-Za-z0-9@$!](?:[\s.,'"?:;-]*+[A-Za-z0-9@$!]++)*+""", "[encoded payload hidden]", leet)
    return F.when(some, found).otherwise(F.array().cast(S.SPAN))


def leet(text: Column) -> Column:
    """Whether a text reads as English once signs are letters."""
    signs = F.length(F.regexp_replace(text, "[^0134578@$!]", ""))
    english = lambda t: F.size(_among(X.words_of(t), X.ENGLISH))
    return (F.length(text) >= LEET_MIN) & (signs >= LEET_SIGNS) & (english(text) < ENGLISH_MIN) & (english(X.unleet(F.lower(text))) >= ENGLISH_MIN)


def nato_spans(text: Column) -> Column:
    word = "(?i:" + "|".join(NATO) + ")"

    def good(run: Column) -> Column:
        first = F.transform(F.split(F.lower(run), "[ ,-]+"), lambda w: F.ascii(w))
        # A drill says the alphabet in order.
        drill = F.size(F.filter(first, lambda c, i: (i > 0) & (c != F.get(first, i - 1) + 1))) == 0
        return ~drill

    return S.find(text, f"{S.B}{word}(?:[ ,-]{{1,3}}{word}){{{NATO_MIN - 1},}}+{S.E}", "[encoded payload hidden]", good)


def morse_text(run: Column) -> Column:
    """Letters of dot and dash tokens; those that are none stay out."""
    table = F.create_map(*[F.lit(x) for pair in MORSE.items() for x in pair])
    words = F.split(F.btrim(run), r" ?/ ?|\s{2,}")
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(F.split(w, " "), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(""))), "")), " ")


def morse_spans(text: Column) -> Column:
    def good(run: Column) -> Column:
        tokens = F.filter(F.split(run, "[ /]+"), lambda t: t != "")
        said = morse_text(run)
        return (F.size(tokens) >= MORSE_MIN) & (F.length(F.replace(said, F.lit(" "), F.lit(""))) >= F.size(tokens) * 0.8) & (X.english_words(said) >= ENGLISH_MIN)

    return S.find(text, r"(?<![.-])[.-]{1,6}+(?:[ /]{1,3}+[.-]{1,6}+){9,}+", "[encoded payload hidden]", good)


ENCODED = (base64_spans, hex_spans, percent_spans, nato_spans, morse_spans, cipher_spans, leet_spans)


def encoded_spans(text: Column) -> Column:
    return S.merge(*[spans(text) for spans in ENCODED])


def any_encoded(text: Column) -> Column:
    """Whether a text has a span of ``encoded_spans``: the first kind that is found settles it."""
    return reduce(lambda a, b: a | b, [F.size(spans(text)) > 0 for spans in ENCODED])
