"""Queries of the text rules over documents, conversations and small fixtures, with check SQL.

Java and RE2 differ: in the SQL, \\b is an ASCII word boundary, as the lookarounds of the Spark patterns are.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions import text as X
from harrow.operators import text_rules as R


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _counts(spans, lang: str = "lang"):
    """Documents and spans of a rule by language."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = F.size(spans(F.col("text")))
        return docs(spark, sf_dir).select(lang, n.cast("long").alias("n")).groupBy(lang).agg(F.sum("n").alias("n_spans"), F.count_if(F.col("n") > 0).alias("n_docs"))

    return query


def pii_masked_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = R.mask(docs(spark, sf_dir)).select("lang", F.explode_outer("spans.label").alias("label")).filter("label IS NOT NULL")
    return spans.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


def pii_masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mask(docs(spark, sf_dir)).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"))


def secrets_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in R.SECRETS.items()])
    return docs(spark, sf_dir).select(F.explode_outer(F.array_compact(kinds)).alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"))


def ipv4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_count("text", F.lit(r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])"))
    return docs(spark, sf_dir).groupBy("lang").agg(F.sum(found).alias("n"))


def unicode_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.length(X.strip_invisible(F.col("text"))).cast("long").alias("n_chars"))


def cipher_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return line.withColumn("cipher", R.cipher_of(F.col("line"))).filter("cipher IS NOT NULL").groupBy("cipher").agg(F.count(F.lit(1)).alias("n"))


def leet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return line.filter(R.leet(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def english_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(F.count_if(X.english_words(F.col("text")) >= R.ENGLISH_MIN).alias("n_english"), F.count(F.lit(1)).alias("n"))


def injection_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.count_if(R.injected(F.col("text"))).alias("n_injected"), F.count(F.lit(1)).alias("n"))


def injection_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.groupBy("role").agg(F.count_if(R.injected(F.col("text"))).alias("n_injected"), F.count(F.lit(1)).alias("n"))


def scarcity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(F.count_if(R.scarce(F.col("text"))).alias("n"))


def skeleton_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.skeleton(F.col("text")), 256).alias("skeleton_sha256"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.middle_truncate(t, 60).alias("cut"), F.sha2(X.safe_filename(t), 256).alias("name_sha256"), F.length(X.collapse_space(t)).cast("long").alias("n_collapsed"))


def entropy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each document that look like keys of no known shape, and their characters."""
    found = docs(spark, sf_dir).select("doc_id", F.explode(R.entropy_spans(F.col("text"))).alias("s"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


_PLAIN = "please read all of the rules and then send what they have to the people of this town, for it is now the time to go"
_INVERSE = {v: k for k, v in R.MORSE.items()}
#: id, text and the label that is expected, null for none.
ENCODED = [
    (1, base64.b64encode(_PLAIN.encode()).decode(), "encoded"), (2, _PLAIN.encode().hex(), "encoded"), (3, "".join(f"%{b:02x}" for b in _PLAIN.encode()[:40]), "encoded"),
    (4, "golf oscar golf lima mike november papa zulu alfa kilo echo", "encoded"), (5, " / ".join(" ".join(_INVERSE[c] for c in w) for w in "the people of this town have said that they will go with you".split()), "encoded"),
    (6, "alfa bravo charlie delta echo foxtrot golf hotel india juliett kilo", None), (7, "0" * 64, None), (8, base64.b64encode(b"short").decode(), None), (9, _PLAIN, None), (10, "1.2.3.4.5.6.7 - - . -", None),
]


def encoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame([(i, t) for i, t, _ in ENCODED], "id int, text string")
    return frame.withColumn("spans", R.encoded_spans(F.col("text"))).select("id", F.when(F.size("spans") > 0, "encoded").alias("label"))


TIMERS = [(1, "Ends in 02:05", 125), (2, "1:00:05 left", 3605), (3, "2 hours 5 min", 7500), (4, "3d 4h", 273600), (5, "45 seconds", 45), (6, "soon", None)]


def timer_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = spark.createDataFrame([(i, t) for i, t, _ in TIMERS], "id int, text string")
    return frame.select("id", X.timer_seconds(F.col("text")).cast("int").alias("seconds"))


QUERIES = {
    "pii_masked_summary": pii_masked_summary,
    "pii_card_counts": _counts(R.card_spans),
    "pii_ssn_counts": _counts(R.ssn_spans),
    "pii_phone_counts": _counts(R.phone_spans),
    "pii_masked_text": pii_masked_text,
    "secrets_by_kind": secrets_by_kind,
    "ipv4_counts": ipv4_counts,
    "unicode_strip": unicode_strip,
    "cipher_candidates": cipher_candidates,
    "leet_candidates": leet_candidates,
    "english_share": english_share,
    "encoded_docs": _counts(R.encoded_spans),
    "encoded_payloads": encoded_payloads,
    "entropy_docs": entropy_docs,
    "injection_docs": injection_docs,
    "injection_turns": injection_turns,
    "scarcity_text": scarcity_text,
    "timer_seconds": timer_seconds,
    "skeleton_words": skeleton_words,
    "text_functions": text_functions,
}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else _lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_CARDS = rf"""list_filter(regexp_extract_all(text, '\b{R.CARD}\b'), lambda m: list_sum(list_transform(range(1, len(regexp_replace(m, '[^0-9]', '', 'g')) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN CAST(regexp_replace(m, '[^0-9]', '', 'g')[-i] AS INT) ELSE (CAST(regexp_replace(m, '[^0-9]', '', 'g')[-i] AS INT) * 2) % 10 + CAST(regexp_replace(m, '[^0-9]', '', 'g')[-i] AS INT) // 5 END)) % 10 = 0)"""
_SSNS = rf"regexp_extract_all(text, '\b{R.SSN}\b')"
_PHONES = rf"regexp_extract_all(text, '(?:^|[^0-9.])({R.PHONE})(?:$|[^0-9])', 1)"
#: A text with a mark after every character that a phone may follow, and one after every run of digits: SQL's expressions do not look around.
_MAY, _END = "\U0010fffe", "\U0010ffff"
_MARKED = rf"'{_MAY}' || regexp_replace(regexp_replace(text, '([^0-9.])', '\1{_MAY}', 'g'), '([0-9]+)', '\1{_END}', 'g')"
_APART = rf"(?:[ -]{_MAY}|\.)"
_MARKED_PHONE = rf"{_MAY}(?:(?:\+{_MAY})?1{_END}?{_APART}?)?(?:\({_MAY}[0-9]{{3}}{_END}\){_MAY}(?: {_MAY})?|[0-9]{{3}}{_END}{_APART})[0-9]{{3}}{_END}{_APART}[0-9]{{4}}{_END}"


def _luhn(m: str) -> str:
    d = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    return f"list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({d}[-i] AS INT) ELSE (CAST({d}[-i] AS INT) * 2) % 10 + CAST({d}[-i] AS INT) // 5 END)) % 10 = 0"


def _placed(text: str, pattern: str, label: str) -> str:
    """SQL of the places of a pattern: what lies before the k-th match is k gaps and k - 1 matches, marks apart."""
    found, gaps = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    chars = lambda x: f"length(regexp_replace({x}, '[{_MAY}{_END}]', '', 'g'))"
    start = f"{chars(f"array_to_string({gaps}[:k], '')")} + {chars(f"array_to_string({found}[:k - 1], '')")}"
    return f"list_transform(range(1, len({found}) + 1), lambda k: {{'start': {start}, 'back': -({start} + {chars(f'{found}[k]')}), 'label': '{label}', 'said': {found}[k]}})"


#: All spans by start, the longest first; one that begins before the last one ends is left out.
_MASKED = f"""WITH p AS (SELECT doc_id, text, list_concat(list_filter({_placed('text', rf'\b{R.CARD}\b', '[card hidden]')}, lambda c: {_luhn('c.said')}), {_placed('text', rf'\b{R.SSN}\b', '[ssn hidden]')}, {_placed(f'({_MARKED})', _MARKED_PHONE, '[phone hidden]')}) AS spans FROM documents),
r AS (SELECT doc_id, text, list_reduce(list_prepend({{'start': CAST(0 AS BIGINT), 'back': CAST(0 AS BIGINT), 'label': '', 'said': ''}}, list_sort(spans)),
    lambda a, x: CASE WHEN x.start >= -a.back THEN {{'start': x.start, 'back': x.back, 'label': '', 'said': a.said || substring(text, 1 - a.back, x.start + a.back) || x.label}} ELSE a END) AS last FROM p)
SELECT doc_id, sha256(last.said || substring(text, 1 - last.back)) AS masked_sha256 FROM r"""
_FOUND = f"SELECT doc_id, lang, text, {_CARDS} AS cards, {_SSNS} AS ssns, {_PHONES} AS phones FROM documents"
_ENGLISH = "len(list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]+')), lambda w: list_contains([" + ", ".join(map(_lit, X.ENGLISH)) + "], w)))"
_INJECTED = f"(regexp_matches(text, {_lit('(?i)(?:' + '|'.join(R.INJECTION.values()) + ')')}) OR regexp_matches(text, {_lit('|'.join(R.INJECTION_CASED.values()))}))"
_ROT = "'" + X.UPPER + X.LOWER + "', '" + X.UPPER[13:] + X.UPPER[:13] + X.LOWER[13:] + X.LOWER[:13] + "'"
_BASH = "'" + X.UPPER + X.LOWER + "', '" + X.UPPER[::-1] + X.LOWER[::-1] + "'"


def _count_sql(name: str) -> str:
    return f"SELECT lang, CAST(sum(len({name})) AS BIGINT) AS n_spans, count(*) FILTER (WHERE len({name}) > 0) AS n_docs FROM ({_FOUND}) GROUP BY lang"


ORACLES = {
    "pii_masked_summary": f"""SELECT lang, label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, '[card hidden]' AS label, len(cards) AS n FROM ({_FOUND}) UNION ALL
    SELECT lang, '[ssn hidden]', len(ssns) FROM ({_FOUND}) UNION ALL SELECT lang, '[phone hidden]', len(phones) FROM ({_FOUND})) GROUP BY lang, label HAVING sum(n) > 0""",
    "pii_card_counts": _count_sql("cards"),
    "pii_ssn_counts": _count_sql("ssns"),
    "pii_phone_counts": _count_sql("phones"),
    "pii_masked_text": _MASKED,
    "secrets_by_kind": " UNION ALL ".join(f"SELECT {_lit(k)} AS kind, count(*) AS n_docs FROM documents WHERE regexp_matches(text, {_lit(p)}) HAVING count(*) > 0" for k, p in R.SECRETS.items()),
    "ipv4_counts": r"SELECT lang, CAST(sum(len(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'))) AS BIGINT) AS n FROM documents GROUP BY lang",
    "unicode_strip": f"SELECT doc_id, length(regexp_replace(text, '{X.INVISIBLE_CLASS}', '', 'g')) AS n_chars FROM documents",
    "cipher_candidates": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT CASE WHEN length(line) < {R.CIPHER_MIN} OR {_ENGLISH.format('line')} >= 3 THEN NULL WHEN {_ENGLISH.format(f'translate(line, {_ROT})')} >= 3 THEN 'rot13'
    WHEN {_ENGLISH.format(f'translate(line, {_BASH})')} >= 3 THEN 'atbash' WHEN {_ENGLISH.format('reverse(line)')} >= 3 THEN 'reversed' END AS cipher FROM l)
    SELECT cipher, count(*) AS n FROM c WHERE cipher IS NOT NULL GROUP BY cipher""",
    "leet_candidates": f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE length(t) >= {R.LEET_MIN} AND length(regexp_replace(t, '[^0134578@$!]', '', 'g')) >= {R.LEET_SIGNS}
    AND {_ENGLISH.format('t')} < 3 AND {_ENGLISH.format("translate(lower(t), '0134578@$!', 'oieastbasi')")} >= 3 GROUP BY doc_id""",
    "english_share": f"SELECT lang, count(*) FILTER (WHERE {_ENGLISH.format('text')} >= 3) AS n_english, count(*) AS n FROM documents GROUP BY lang",
    "entropy_docs": rf"""WITH r AS (SELECT doc_id, row_number() OVER () AS k, run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_+=/?&.%-])([A-Za-z0-9_+=-]{{{R.WINDOW},}})', 1)) AS run FROM documents)),
w AS (SELECT doc_id, k, i, substring(run, i + 1, {R.WINDOW}) AS x FROM (SELECT doc_id, k, run, unnest(list_distinct(list_append(range(0, len(run) - {R.WINDOW} + 1, {R.STRIDE}), len(run) - {R.WINDOW}))) AS i FROM r)),
g AS (SELECT *, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM w WHERE len(regexp_extract_all(x, '[A-Z]')) >= {R.EACH_CLASS} AND len(regexp_extract_all(x, '[a-z]')) >= {R.EACH_CLASS} AND len(regexp_extract_all(x, '[0-9]')) >= {R.EACH_CLASS} AND list_entropy(string_split(x, '')) >= {R.BITS}),
s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > {R.WINDOW}) OVER (PARTITION BY k ORDER BY i) AS part FROM g)
SELECT doc_id, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT doc_id, k, part, max(i) + {R.WINDOW} - min(i) AS chars FROM s GROUP BY ALL) GROUP BY doc_id""",
    "encoded_payloads": f"SELECT id, label FROM (VALUES {_values([(i, e) for i, _, e in ENCODED])}) v(id, label)",
    "injection_docs": f"SELECT source, count(*) FILTER (WHERE {_INJECTED}) AS n_injected, count(*) AS n FROM documents GROUP BY source",
    "injection_turns": f"SELECT role, count(*) FILTER (WHERE {_INJECTED}) AS n_injected, count(*) AS n FROM conversations GROUP BY role",
    "scarcity_text": f"SELECT lang, count(*) FILTER (WHERE regexp_matches(text, {_lit('(?i)(?:' + '|'.join(R.SCARCITY) + ')')})) AS n FROM documents GROUP BY lang",
    "timer_seconds": f"SELECT id, seconds FROM (VALUES {_values([(i, e) for i, _, e in TIMERS])}) v(id, seconds)",
    "skeleton_words": f"SELECT doc_id, sha256(lower(translate(text, {_lit(''.join(X.CONFUSABLES))}, {_lit(''.join(X.CONFUSABLES.values()))}))) AS skeleton_sha256 FROM documents",
    "text_functions": r"""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 30) || ' […] ' || right(text, 30) END AS cut,
    sha256(regexp_replace(text, '[^\p{L}\p{N}_.-]', '_', 'g')) AS name_sha256, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_collapsed FROM documents""",
}
