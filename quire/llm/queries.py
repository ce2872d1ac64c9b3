"""The queries op1 to op10, each applying its operator with production parameters to a whole table, and their SQL."""

from __future__ import annotations

from quire.llm.common import documents
from quire.llm.decontamination import contaminated
from quire.llm.html_text import extract
from quire.llm.language_id import identify
from quire.llm.line_dedup import deduplicate_lines
from quire.llm.media import media_columns
from quire.llm.mixing import mix
from quire.llm.near_dedup import near_duplicates
from quire.llm.sharding import shard
from quire.llm.suffix_dedup import repeated_strings
from quire.llm.token_count import count_tokens


def op1_suffix_dedup(spark, sf_dir):
    return repeated_strings(documents(spark, sf_dir))


def op2_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op4_token_count(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))


def op5_media_columns(spark, sf_dir):
    return media_columns(documents(spark, sf_dir))


def op6_line_dedup(spark, sf_dir):
    return deduplicate_lines(documents(spark, sf_dir))


def op7_sharding(spark, sf_dir):
    return shard(documents(spark, sf_dir))


def op8_decontamination(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir)).drop("source")


def op10_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_near_dedup": op3_near_dedup,
    "op4_token_count": op4_token_count,
    "op5_media_columns": op5_media_columns,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL: dict[str, str] = {
    "op3_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op7_sharding": """WITH h AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT h.*, d AS bits, h >> (60 - d) AS prefix FROM h, range(0, 61) t(d)),
f AS (SELECT bits, prefix, sum(n_bytes)::BIGINT AS total FROM b GROUP BY ALL HAVING sum(n_bytes) <= 16777216)
SELECT doc_id, n_bytes, CASE WHEN bits = 0 THEN '' ELSE lpad(bin(prefix), bits::INT, '0') END AS shard_id, bits::INT AS shard_bits, total AS shard_bytes, true AS fits
FROM b JOIN f USING (bits, prefix) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY bits) = 1""",
    "op9_mixing": rf"""WITH d AS (SELECT doc_id, source, {_SIZE}::BIGINT AS size, md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS rank FROM documents),
t0 AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS docs FROM d GROUP BY source),
t1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w, sum(size) OVER () AS total FROM t0),
-- sources in order of size by weight: a source is full if the share that is left when all before it are full exceeds its double size
t2 AS (SELECT *, coalesce(sum(size) OVER o, 0) AS below, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open FROM t1 WINDOW o AS (ORDER BY size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, (3 * total - 4 * below) * w > 4 * size * open AS is_full FROM t2),
t4 AS (SELECT *, sum(CASE WHEN is_full THEN size ELSE 0 END) OVER () AS gone, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS left_w FROM t3),
t5 AS (SELECT source, size AS source_size, docs, CASE WHEN is_full THEN 2 * size::DOUBLE ELSE ((3 * total - 4 * gone) * w)::DOUBLE / (2 * left_w)::DOUBLE END AS target FROM t4),
-- blocks of 16 words to sources, then to shards, by highest quotients: all quotients that may win are listed and ranked
s0 AS (SELECT source, target, unnest(range(0, floor(target / 16)::BIGINT + (SELECT count(*) FROM t5) + 1)) AS i FROM t5),
s1 AS (SELECT source, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, source IS NULL, encode(source)) AS place FROM s0 WHERE target > 0),
s2 AS (SELECT source, count(*) AS blocks FROM s1 WHERE place <= (SELECT floor(sum(target) / 16 + 0.5) FROM t5) GROUP BY source),
t6 AS (SELECT t5.*, coalesce(blocks, 0) AS blocks, greatest(1, (docs + 2047) // 2048) AS shards FROM t5 LEFT JOIN s2 ON t5.source IS NOT DISTINCT FROM s2.source),
k AS (SELECT d.*, t6.* EXCLUDE (source), ('0x' || substr(rank, 1, 8))::BIGINT % shards AS shard FROM d JOIN t6 ON d.source IS NOT DISTINCT FROM t6.source),
q0 AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(source_size) AS ss, any_value(blocks) AS blocks, any_value(shards) AS n FROM k GROUP BY source, shard),
q1 AS (SELECT source, shard, words, blocks, unnest(range(0, floor(words::DOUBLE / greatest(ss, 1) * (blocks + n))::BIGINT + 2)) AS i FROM q0),
q2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words::DOUBLE / (2 * i + 1) DESC, shard) AS place FROM q1),
q3 AS (SELECT source, shard, count(*) AS seats FROM q2 WHERE place <= blocks GROUP BY source, shard),
q4 AS (SELECT q0.source, q0.shard, words, least(coalesce(seats, 0) * 16, words * 2)::BIGINT AS quota FROM q0 LEFT JOIN q3 ON q0.source IS NOT DISTINCT FROM q3.source AND q0.shard = q3.shard),
z AS (SELECT k.*, q4.words, q4.quota, coalesce(sum(k.size) OVER (PARTITION BY k.source, k.shard ORDER BY k.rank, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN q4 ON k.source IS NOT DISTINCT FROM q4.source AND k.shard = q4.shard)
SELECT doc_id, size, source_size, target, (CASE WHEN words > 0 THEN (quota // words) * size + least(greatest(quota % words - before, 0), size) ELSE 0 END)::BIGINT AS taken FROM z""",
}
