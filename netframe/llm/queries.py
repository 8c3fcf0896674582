"""The opN_<name> queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_dir
from .exact_dedup import exact_groups
from .packing import pack_documents
from .quality import judge
from .simhash import near_duplicates
from .substring_dedup import repeated_words
from .token_counts import section_tokens
from .token_store import read_store, write_store
from .toxicity import toxicity
from .tree_bpe import encode_decode
from .warc import read_warc, write_pages

WORD = r"[^\x20\x09-\x0D]+"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_words(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS m FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (k) WHERE m < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS n_removed
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


OP2_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g JOIN r USING (doc_id, k)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM
      (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines, 0) AS n_lines
      FROM w LEFT JOIN z ON w.doc_id = z.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS (SELECT doc_id, lang, source, base_failed, unnest([1, 2, 3, 4]) AS measure, unnest([n_symbols, n_dup_lines, n_repeat_words, word_chars]) AS a,
             unnest([word_chars, n_lines, n_words, n_words]) AS b, unnest([1, 1, 5, 0]) AS unit FROM y),
v AS (SELECT *, CAST(floor(CAST(1000000 * a AS DOUBLE) / b) AS BIGINT) AS value,
             CASE WHEN unit > 0 THEN floor(1e6 * (unit * (CAST(a AS DOUBLE) / unit - 2 * sqrt(CAST(a AS DOUBLE) / unit))) / b) ELSE floor(CAST(1000000 * a AS DOUBLE) / b) END AS sure
      FROM x WHERE b > 0),
c AS (SELECT *, greatest(0, length(bin(value)) - 7) AS cut FROM v WHERE NOT base_failed),
s AS (SELECT lang, source, measure, (value >> CAST(cut AS BIGINT)) << CAST(cut AS BIGINT) AS bin, count(*) AS n FROM c GROUP BY ALL),
k AS (SELECT 0 AS level, lang, source, measure, bin, n FROM s UNION ALL SELECT 1, lang, NULL, measure, bin, sum(n) FROM s GROUP BY ALL
      UNION ALL SELECT 2, NULL, NULL, measure, bin, sum(n) FROM s GROUP BY ALL),
kc AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM k),
d AS (SELECT level, lang, source, measure, CAST(max(total) AS DOUBLE) AS n_rows, min(bin) FILTER (WHERE 10 * seen >= total) AS d1,
             min(bin) FILTER (WHERE 10 * seen >= 5 * total) AS d5, min(bin) FILTER (WHERE 10 * seen >= 9 * total) AS d9 FROM kc GROUP BY ALL),
t AS (SELECT level, lang, source, measure, n_rows, d1 - 3 * (d5 - d1) AS low, d9 + 3 * (d9 - d5) AS high FROM d),
u AS (SELECT l.lang, l.measure, (l.n_rows * l.low + 100e0 * e.low) / (l.n_rows + 100e0) AS low, (l.n_rows * l.high + 100e0 * e.high) / (l.n_rows + 100e0) AS high
      FROM t l JOIN t e ON l.measure = e.measure AND l.level = 1 AND e.level = 2),
q AS (SELECT o.lang, o.source, o.measure, (o.n_rows * o.low + 100e0 * u.low) / (o.n_rows + 100e0) AS low, (o.n_rows * o.high + 100e0 * u.high) / (o.n_rows + 100e0) AS high
      FROM t o JOIN u ON o.lang = u.lang AND o.measure = u.measure AND o.level = 0),
bad AS (SELECT DISTINCT doc_id FROM v JOIN q USING (lang, source, measure) WHERE sure > high OR (measure = 4 AND sure < low))
SELECT y.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM y LEFT JOIN bad ON y.doc_id = bad.doc_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) AS bigint)")
    full = read_warc(spark, uri).where("record_type = 'response'")
    again = read_warc(spark, uri, payload="false").where("record_type = 'revisit'")  # headers only
    return full.select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(again.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f <> page_id THEN f END AS refers_to FROM d
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_elias_fano_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "tokens")
    write_store(documents(spark, sf_dir), uri, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_store(spark, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT norm, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN k USING (norm)
"""


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_toxicity": op3_toxicity,
        "op4_elias_fano_store": op4_elias_fano_store,
        "op5_warc": op5_warc,
        "op6_tree_bpe": op6_tree_bpe,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_quality_rules": OP2_SQL, "op5_warc": OP5_SQL, "op8_exact_dedup": OP8_SQL}
