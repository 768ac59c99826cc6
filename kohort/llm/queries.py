"""The operators on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm import bpe, chat, decontaminate, embeddings, jaccard, langid, licenses, sharding, suffixes, viterbi
from kohort.session import table

BPE_FILE, UNIGRAM_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def _spans(mask: str):
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string"))), ";").alias(mask)


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_turns(chat.swapped_replies(table(spark, sf_dir, "conversations")))
    return out.select("pair_id", F.col("prefix_turns").cast("long").alias("prefix_turns"), "prompt", "chosen", "rejected", _spans("chosen_mask"), _spans("rejected_mask"), "complete")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("mixture").alias("n_languages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(UNIGRAM_FILE))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    ids, best = F.transform("matches", lambda m: m["id"]), F.array_max(F.transform("matches", lambda m: m["score"]))
    return out.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matched"), F.array_join(ids, ",").alias("licenses"), F.round(F.coalesce(best, F.lit(0.0)), 6).alias("best_score"))


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_preference_format, op2_language_mixture, op3_bpe, op4_decontaminate, op5_unigram_counts, op6_embedding_near_dedup, op7_suffix_dedup, op8_license_scan, op9_byte_shards, op10_jaccard_join)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = decontaminate.UPPER, decontaminate.LOWER

_SQL_OP1 = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
reply AS (SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) AS r FROM c WHERE role = 'assistant') WHERE r = 1),
own AS (SELECT c.*, r.conv_id IS NOT NULL AND c.role = 'assistant' AND c.turn IS NOT DISTINCT FROM r.turn AND c.text IS NOT DISTINCT FROM r.text AS is_last, o.text AS other
        FROM c LEFT JOIN reply r ON r.conv_id = c.conv_id LEFT JOIN reply o ON o.conv_id = xor(c.conv_id, 1)),
u AS (SELECT conv_id AS pair_id, 0 AS second, turn, role, text FROM c UNION ALL SELECT conv_id, 1, turn, role, CASE WHEN is_last THEN coalesce(other, '') ELSE text END FROM own),
s AS (SELECT *, row_number() OVER (PARTITION BY pair_id, second ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p, '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' || chr(10) AS body FROM u),
m AS (SELECT a.pair_id, a.p FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.p = b.p AND a.second = 0 AND b.second = 1 AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text),
pre AS (SELECT pair_id, max(p) AS k FROM (SELECT pair_id, p, row_number() OVER (PARTITION BY pair_id ORDER BY p) AS r FROM m) WHERE p = r GROUP BY 1),
x AS (SELECT s.*, coalesce(k, 0) AS k FROM s LEFT JOIN pre USING (pair_id)),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, second ORDER BY p) - length(body) AS head_end FROM x WHERE p > k),
t AS (SELECT pair_id, second, string_agg(head || body, '' ORDER BY p) AS t, coalesce(string_agg(head_end || ':' || length(body), ';' ORDER BY p) FILTER (role = 'assistant'), '') AS mask FROM y GROUP BY 1, 2),
q AS (SELECT pair_id, max(k) AS k, coalesce(string_agg(head || body, '' ORDER BY p) FILTER (p <= k AND second = 0), '') AS prompt FROM x GROUP BY 1)
SELECT pair_id, CAST(k AS BIGINT) AS prefix_turns, prompt, coalesce(a.t, '') AS chosen, coalesce(b.t, '') AS rejected, coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask, true AS complete
FROM q LEFT JOIN (SELECT * FROM t WHERE second = 0) a USING (pair_id) LEFT JOIN (SELECT * FROM t WHERE second = 1) b USING (pair_id)
"""

_SQL_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM d, ms, unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m),
h AS (SELECT r, dw.m, i, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
n AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT r, i, m FROM h), unnest(range(0, m)) AS u(j) GROUP BY 1),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

_SQL_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

#: The checksum byte by byte (the usual polynomial, bits reversed), cuts of the order by prefix sums.
_SQL_OP9 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, doc_id, len(h) // 2 + {sharding.ROW_BYTES} AS size,
      xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda i: CAST(('0x' || h[2 * i + 1 : 2 * i + 2]) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc FROM d, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, r) - size AS start, sum(size) OVER () AS total FROM s),
q AS (SELECT *, CAST(least(39, start * 40 // total) AS INT) AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, r) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM q
"""

_SQL_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express it. The other operators are held against brute force in tests/llm."""
    return {"op1_preference_format": _SQL_OP1, "op4_decontaminate": _SQL_OP4, "op6_embedding_near_dedup": _SQL_OP6, "op8_license_scan": licenses.oracle(), "op9_byte_shards": _SQL_OP9, "op10_jaccard_join": _SQL_OP10}
