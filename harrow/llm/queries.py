"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a vocabulary file: of the installed public_tokenizers, else of TOKENIZERS."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def split_pattern() -> str:
    """The split pattern of the byte-level vocabulary: of the installed public_tokenizers, else the usual one."""
    try:
        import public_tokenizers

        return public_tokenizers.PATTERN
    except ImportError:
        from harrow.llm import bpe

        return bpe.SPACED_PATTERN


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import embedding_neardup

    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import fingerprint

    return fingerprint.edited_prints(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import packing

    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import line_dedup

    made = line_dedup.dedup_table(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import chat

    made = chat.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return made.withColumn("mask", mask)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import minhash

    made = minhash.classes(table(spark, sf_dir, "documents"))
    return made.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import bpe

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import pii

    return pii.digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    made = quality.score(docs, model)
    return made.select("doc_id", (quality.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_level_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import level_packing

    return level_packing.pack_online(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from harrow.llm import vector_codes

    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_merkle_fingerprint": op2_merkle_fingerprint,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_order_minhash": op6_order_minhash,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_level_packing": op12_level_packing,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}

#: The white space and the letters of a line key, for SQL.
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Vectors that count, for SQL.
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd over four parts, one common table for the entries and one for the assignment of each round."""
    parts = [f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS u, vec_id, label, CAST(len(embedding) // 4 AS BIGINT) AS w, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_FINITE}),
s AS (SELECT u, part, q[part * w + 1 : part * w + w] AS x FROM v, range(4) t(part)),
b0 AS (SELECT part, u - 1 AS entry, x AS c FROM s WHERE u <= 256)"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS (SELECT s.u, s.part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM s JOIN (SELECT * FROM b{k}) b ON s.part = b.part,
LATERAL (SELECT CAST(list_sum(list_transform(list_zip(s.x, b.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d) GROUP BY s.u, s.part)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT part, entry, pos, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT a{k}.part, a{k}.entry, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{k} JOIN s ON a{k}.u = s.u AND a{k}.part = s.part) GROUP BY part, entry, pos),
n{k} AS (SELECT part, entry, list(y ORDER BY pos) AS c FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} USING (part, entry))""")
    last = rounds
    parts.append(f"""e AS (SELECT u, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY u),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})""")
    return f"WITH {(','  + chr(10)).join(parts)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (u), h"


ORACLES: dict[str, str] = {
    "op1_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op2_merkle_fingerprint": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM d),
e AS (SELECT doc_id, t, u, length(t) AS n, left(t, length(t) - length(t) // 2) || left(u, length(t) // 2) AS v FROM n),
texts AS (SELECT DISTINCT t AS x FROM e UNION SELECT v FROM e),
nodes AS (SELECT x, list_transform(string_split(x, chr(10)), lambda p: left(sha256(p), 32) || '(' ||
    array_to_string(list_transform(regexp_extract_all(p, '[^.!?]{1,64}[.!?]*'), lambda s: left(md5(s), 8)), '.') || ')') AS a FROM texts),
bodies AS (SELECT x, regexp_replace(array_to_string(list_transform(a, lambda q: q || CASE WHEN left(q, 1) IN ('0', '1') THEN ';' ELSE ',' END), ''), '[,;]$', '') AS b FROM nodes),
trees AS (SELECT x, array_to_string(list_transform(string_split(b, ';'), lambda s: left(sha256(s), 32) || '[' || s || ']'), ';') AS tree FROM bodies),
prints AS (SELECT x, sha256(tree) || ':' || tree AS f,
    list_filter(list_distinct(string_split(array_to_string(regexp_extract_all(tree, '\\(([0-9a-f.]+)\\)', 1), '.'), '.')), lambda s: s <> '') AS s FROM trees)
SELECT e.doc_id, n AS n_chars, sha256(v) AS edited_sha256, p.f AS fingerprint, q.f AS edited_fingerprint,
    CASE WHEN p.f = q.f THEN 1.0::DOUBLE WHEN len(p.s) + len(q.s) = 0 THEN 0.0 ELSE 2 * len(list_intersect(p.s, q.s))::DOUBLE / (len(p.s) + len(q.s)) END AS near_edited,
    CASE WHEN p.f = r.f THEN 1.0::DOUBLE WHEN len(p.s) + len(r.s) = 0 THEN 0.0 ELSE 2 * len(list_intersect(p.s, r.s))::DOUBLE / (len(p.s) + len(r.s)) END AS near_next
FROM e JOIN prints p ON p.x = t JOIN prints q ON q.x = v JOIN prints r ON r.x = u""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.key IS NOT NULL AND doc_id <> last) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (r.key IS NOT NULL AND doc_id <> last)), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substring(s, CAST(10 * (k // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h""",
    "op5_chat_perspectives": r"""
WITH t AS (SELECT conv_id, turn, coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS block, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '[\x09-\x0D]', ' ', 'g') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
u AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, speaker, text) - 1) // 64 AS piece FROM t),
s AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
p AS (SELECT u.*, perspective, speaker = perspective AS own,
    '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS lead
    FROM u JOIN s ON u.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (SELECT *, lead || text || '<|im_end|>' || chr(10) AS part, row_number() OVER (PARTITION BY conv_id, perspective, block, piece ORDER BY turn NULLS FIRST, speaker, text) AS n FROM p),
w AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id, perspective, block, piece ORDER BY n) AS upto FROM q)
SELECT conv_id, perspective, block, piece, count(*) AS n_turns, string_agg(part, '' ORDER BY n) AS rendered,
    coalesce(string_agg(CAST(CAST(upto - length(part) + length(lead) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM w GROUP BY conv_id, perspective, block, piece""",
    "op11_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_vector_codes": _codes_sql(),
}
