"""The registered queries of this subpackage: each applies its operator to a whole table.

The digest columns of a contract are derived here; the operators keep their own, more general results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.quality_rules import quality_report

    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.topk_search import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.html_text import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.lm_scoring import score_documents

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.quality_classifier import score_quality

    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.pieces import encode_documents

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.pii import find_personal_data

    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.near_duplicates import link_components

    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.warc import archived_pages

    captures = archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from patchloom.llm.filter_audit import audit_filters

    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_topk_search": op3_topk_search,
        "op4_html_extraction": op4_html_extraction,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_pii": op9_pii,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_warc": op12_warc,
        "op13_filter_audit": op13_filter_audit,
    }


def _quality_sql() -> str:
    from patchloom.llm import quality_rules as Q

    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    size = lambda x, p: f"length(regexp_replace({x}, '{p}', '', 'g'))"
    symbol = "[#*$%&|<>]"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
x AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM x),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, range(0, 3) AS o(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, line, regexp_extract_all(line, '{word}+') AS words, length(line) AS chars FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{word}')),
f AS (SELECT r, line, chars - {size("line", symbol)} > {Q.LINE_SYMBOLS} * len(words) OR len([m FOR m IN words IF regexp_matches(m, '[!?][!?]$')]) > {Q.LINE_SHOUTS} * len(words)
  OR (len([m FOR m IN string_split(line, ' ') IF regexp_matches(m, '{Q._MARK}')]) >= {Q.NAV_MARKS} AND 4 * len([m FOR m IN string_split(line, ' ') IF regexp_matches(m, '{Q._MARK}')]) >= len(words))
  OR regexp_matches(line, '{Q.BOILERPLATE}') OR NOT regexp_matches(line, '\\p{{L}}|\\p{{N}}') AS bad FROM l),
g AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_removed, coalesce(sum({size("line", space + "+")}) FILTER (NOT bad), 0) AS left_chars FROM f GROUP BY r),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {size("text", space + "+")} AS word_chars, length(text) - {size("text", symbol)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, CAST(coalesce(left_chars, 0) AS BIGINT) AS left_chars FROM t LEFT JOIN p USING (r) LEFT JOIN g USING (r)),
b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words AS base_failed FROM z)
SELECT *, NOT base_failed AND left_chars >= {Q.MIN_LEFT} * word_chars AS kept FROM b"""


_SEARCH_SQL = """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""


_NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
h AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(n AS INT) AS rank, negative_id, positive_score, negative_score FROM h WHERE n <= 3"""

_WARC_SQL = """WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM t),
d AS (SELECT page_id, octet_length(encode(html)) AS n, first, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * (j // 4) + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS INT) + 1, 1) FOR j IN range(32)], '') AS digest FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to FROM d"""

_AUDIT_SQL = r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(coalesce(good, false) AS INT) AS good, CAST(coalesce(toxic, false) AS INT) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS own FROM o, range(1, 6) AS r(step)),
z AS (SELECT *, length(translate(fails, before, '')) < length(fails) AS earlier, contains(fails, own) AS failed FROM c, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT earlier AND NOT failed), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT earlier AND failed), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (earlier AND failed), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (NOT earlier AND failed), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT earlier AND failed), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // nullif(length(fails), 0)) FILTER (failed), 0) AS BIGINT) AS shapley FROM z GROUP BY part, filter_order, step"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _quality_sql(), "op3_topk_search": _SEARCH_SQL, "op11_hard_negatives": _NEGATIVES_SQL, "op12_warc": _WARC_SQL, "op13_filter_audit": _AUDIT_SQL}
