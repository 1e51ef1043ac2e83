"""Scalar functions over text, all as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Frequent English function words; a text with three different ones counts as English.
ENGLISH = (
    "the of and to in is it you that he was for on are with as his they be at one have this from or had by not but what all were we when your can said "
    "there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more "
    "go see no way could people my than first been who its now find down day did get come made may part over"
).split()
#: Letters of other scripts that look like a Latin one: fixed pairs of look and letter.
CONFUSABLES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
#: Characters that show nothing: soft hyphen, joiners of words, fillers, zero-width space, direction marks and overrides, invisible operators, tags.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x200B, 0x200B), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F),
    (0x3164, 0x3164), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE007F), (0xE0100, 0xE01EF),
)
#: The same as a class of a regular expression.
INVISIBLE_CLASS = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in INVISIBLE) + "]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether digits have the check digit of a payment card."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    marks = F.transform(each, lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(marks, F.lit(0), lambda a, d: a + d) % 10 == 0


def skeleton(s: Column) -> Column:
    """Look-alike letters made Latin, then lower case; doing it twice changes nothing."""
    return F.lower(F.translate(s, "".join(CONFUSABLES), "".join(CONFUSABLES.values())))


def words_of(s: Column) -> Column:
    """Runs of ASCII letters, lower case."""
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0))


def how_many(found: Column, words) -> Column:
    """How many different ones of ``words`` are in an array."""
    return F.size(F.array_intersect(found, F.array(*map(F.lit, words))))


def english_words(s: Column) -> Column:
    """Number of different function words."""
    return how_many(words_of(s), ENGLISH)


def rot13(s: Column) -> Column:
    turned = lambda a: a[13:] + a[:13]
    return F.translate(s, UPPER + LOWER, turned(UPPER) + turned(LOWER))


def atbash(s: Column) -> Column:
    return F.translate(s, UPPER + LOWER, UPPER[::-1] + LOWER[::-1])


def unleet(s: Column) -> Column:
    """Digits and signs that stand for letters, replaced by them."""
    return F.translate(s, "0134578@$!", "oieastbasi")


def strip_invisible(s: Column) -> Column:
    return F.regexp_replace(s, INVISIBLE_CLASS, "")


def middle_truncate(s: Column, budget: int) -> Column:
    half = budget // 2
    return F.when(F.length(s) <= budget, s).otherwise(F.concat(F.substring(s, 1, half), F.lit(" […] "), F.right(s, F.lit(half))))


def collapse_space(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, r"\s+", " "))


def safe_filename(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}_.-]", "_")


def shannon_entropy(s: Column) -> Column:
    """Bits for each character of a string; 0 for the empty one."""
    n = F.length(s).cast("double")
    letters = F.array_distinct(F.split(s, ""))
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))


def timer_seconds(s: Column) -> Column:
    """Seconds of a clock (h:m:s, or m:s) or of numbers with units; null for neither. A clock wins."""
    clock = F.regexp_extract(s, r"([0-9]{1,3}(?::[0-9]{1,2}){1,2})", 1)
    parts = F.split(clock, ":")
    of_clock = F.aggregate(F.transform(parts, lambda p: p.try_cast("int")), F.lit(0), lambda a, p: a * 60 + p)
    units = [(r"([0-9]{1,4}) ?d(?:ays?)?(?![a-z])", 86400), (r"([0-9]{1,4}) ?h(?:(?:ou)?rs?)?(?![a-z])", 3600), (r"([0-9]{1,4}) ?m(?:in(?:ute)?s?)?(?![a-z])", 60), (r"([0-9]{1,4}) ?s(?:ec(?:ond)?s?)?(?![a-z])", 1)]
    found = [(F.regexp_extract(F.lower(s), p, 1), k) for p, k in units]
    of_units = reduce(lambda a, x: a + F.coalesce(x[0].try_cast("int"), F.lit(0)) * x[1], found, F.lit(0))
    return F.when(clock != "", of_clock).when(reduce(lambda a, x: a | (x[0] != ""), found, F.lit(False)), of_units)


def percent_delta(a: Column, b: Column) -> Column:
    return F.when((a != 0) & b.isNotNull(), (b - a) / a * 100)


def brightness(r: Column, g: Column, b: Column) -> Column:
    """Perceived brightness of 8-bit channels, 0 to 1, by the weights 0.299, 0.587 and 0.114."""
    return (r * 0.299 + g * 0.587 + b * 0.114) / 255


def element_name(tag: Column, id_: Column, classes: Column) -> Column:
    """tag#id.class.class"""
    return F.concat(tag, F.coalesce(F.concat(F.lit("#"), F.nullif(id_, F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit("."), F.array_join(F.filter(F.split(classes, r"\s+"), lambda c: c != ""), ".")), F.lit("")))
