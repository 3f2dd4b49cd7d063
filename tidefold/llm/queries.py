"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster, cluster_sql
from .common import read_table, small_table
from .decontamination import contaminated
from .html_text import extract
from .language_id import identify
from .line_dedup import dedup_lines
from .line_quality import line_quality
from .overlap_join import overlap_components
from .packing import pack
from .resampling import resample
from .ring_shards import ring_shards
from .simhash import simhash_components
from .surrogates import replace_entities
from .url_rules import judge_urls

#: The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), word_tokenizer())


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"host": h, "path": p, "action": a} for h, p, a in URL_RULES]
    return judge_urls(read_table(spark, sf_dir, "pages"), small_table(spark, rules, "host string, path string, action string"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("clean_text").alias("text"), "n_entities")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", "n_left_words",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("clean_text").alias("text"), "n_removed_lines", "n_removed_words")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return identify(read_table(spark, sf_dir, "documents"), F.coalesce(held_out, F.lit(False)))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(read_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def op13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_components(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


LINE_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (SELECT r, source, line, md5(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'))) AS key,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
k AS (SELECT * FROM n WHERE words > 0),
contents AS (SELECT r, string_agg(DISTINCT key, ' ' ORDER BY key) AS content FROM k GROUP BY r),
firsts AS (SELECT source, min(r) AS r FROM d JOIN contents USING (r) GROUP BY source, content),
hosts AS (SELECT source, count(*) AS docs FROM firsts GROUP BY source),
counts AS (SELECT source, key, count(*) AS c FROM (SELECT DISTINCT k.source, k.key, k.r FROM k JOIN firsts ON k.r = firsts.r) AS u GROUP BY source, key),
frequent AS (SELECT counts.source, key FROM counts JOIN hosts ON counts.source IS NOT DISTINCT FROM hosts.source WHERE c >= 10 AND c > docs * 0.02),
per AS (SELECT k.r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines, count(frequent.key) AS n_removed_lines,
  CAST(sum(CASE WHEN frequent.key IS NULL THEN 0 ELSE words END) AS BIGINT) AS gone
  FROM k LEFT JOIN frequent ON k.key = frequent.key AND k.source IS NOT DISTINCT FROM frequent.source GROUP BY k.r),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM
  (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
s AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, len(words) - coalesce(gone, 0) AS n_left_words
  FROM d JOIN w USING (r) LEFT JOIN per USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * (n_words - n_left_words) > 70 * n_words AS kept FROM s"""


def oracle_sql() -> dict[str, str]:
    longest = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'" for h, p, a in longest
    )
    return {
        "op6_line_quality": LINE_QUALITY,
        "op12_centroids": cluster_sql(),
        "op3_url_rules": f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), judged AS (SELECT page_id, host, path, CASE {fits} END AS hit FROM parts)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), 'allow') AS verdict FROM judged""",
    }
