"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm import decontaminate, language_id, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup, token_records, url_filter
from filigrane.llm.common import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labelled ones that are not held out. Texts without words get a score too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder("doc_id", 3) != 1)
    model = quality_classifier.learn_quality(docs, labels)
    out = quality_classifier.score_quality(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base rule and the fertility verdict of every document. Null texts have no words and fail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.fertility_rules(docs).drop("text")


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document. A null text is a class of its own."""
    return near_dedup.dedup_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url: that of its longest rule, else block if its host is listed. Without a scheme: allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    special = spark.createDataFrame([(k,) for k in url_filter.LISTED], "k string")
    return url_filter.judge_urls(pages, listed=url_filter.spam_hosts(pages).union(special).distinct()).drop("listed")


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; `und` without a letter. Learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn_languages(docs.select("doc_id", "text", "lang").where(remainder("doc_id", 4) != 2))
    out = language_id.identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and PPM log probabilities of every document; learned from those that are not held out. Null: empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scoring.score_texts(docs, remainder("doc_id", 7) != 2)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a passage of a benchmark item. Null texts have no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op8_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 200-byte strings that occur elsewhere too. Null: empty text."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, written as framed records and read back. Null texts: the end id alone."""
    return token_records.records_of(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. Null texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "times")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that do not depend on the vocabularies."""
    return op2_fertility_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that do not depend on the choice of documents."""
    return op10_budget_fit(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (op1_subword_embeddings, op2_fertility_rules, op3_dart_minhash, op4_bloom_cascade, op5_output_codes, op6_partial_matching, op7_wu_manber, op8_suffix_sort, op9_token_records, op10_budget_fit,
              rule_counts, mix_targets)
}

ORACLE = {
    "op4_bloom_cascade": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules AS (
            SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                  ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rule_host, rule_path, rule_verdict)),
        listed AS (SELECT unnest(['localhost', 'local', 'invalid', 'test', 'onion', 'internal']) AS name UNION
                   SELECT host FROM parts WHERE regexp_matches(host, '(^|[.-])(adult|bet|betting|casino|dating|escort|gambling|jackpot|loan|loans|lottery|payday|pharma|pills|poker|porn|replica|sex|slots|viagra|webcam|xxx)([.-]|$)'))
        SELECT page_id, host, path, rule,
               CASE WHEN rule IS NOT NULL THEN rule_verdict
                    WHEN EXISTS (SELECT 1 FROM listed WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, '/'))
                    THEN 'block' ELSE 'allow' END AS verdict
        FROM (SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                     arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
              FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
              GROUP BY page_id, host, path)""",
    "op7_wu_manber": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
          b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
          q AS (SELECT DISTINCT item, m, array_to_string(words[i : i + m - 1], ' ') AS win FROM (SELECT item, words, least(13, len(words)) AS m, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
          w AS (SELECT r, m, i, array_to_string(words[i : i + m - 1], ' ') AS win FROM (SELECT r, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q))),
          f AS (SELECT r, i, w.m, item FROM w JOIN q ON w.m = q.m AND w.win = q.win),
          n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS pos FROM f) GROUP BY r),
          s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
          coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)""",
    "op8_suffix_sort": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
          p AS (SELECT r, o, substr(x, 2 * o + 1, 2400) AS x FROM (SELECT r, x, unnest(range(0, greatest(0, len(x) // 2 - 199), 1000)) AS o FROM d)),
          w AS (SELECT r, o + i AS s, md5_number(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, o, x, unnest(range(0, least(1000, len(x) // 2 - 199))) AS i FROM p)),
          t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
          h AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS b FROM w SEMI JOIN t USING (k)),
          g AS (SELECT r, s, sum(CASE WHEN b IS NULL OR s > b + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS n FROM h),
          spans AS (SELECT r, n, min(s) AS lo, max(s) + 200 AS hi FROM g GROUP BY r, n),
          kept AS (SELECT r, string_agg(part, '' ORDER BY lo) AS x FROM (
              SELECT r, lo, substr(x, 2 * prior + 1, 2 * (lo - prior)) AS part FROM (SELECT spans.r, lo, x, coalesce(lag(hi) OVER (PARTITION BY spans.r ORDER BY lo), 0) AS prior FROM spans JOIN d USING (r))
              UNION ALL SELECT r, max(hi), substr(any_value(x), 2 * max(hi) + 1) FROM spans JOIN d USING (r) GROUP BY r) GROUP BY r)
        SELECT doc_id, len(d.x) // 2 AS n_bytes, coalesce(a.removed, 0)::BIGINT AS n_removed, coalesce(a.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
        FROM d LEFT JOIN (SELECT r, count(*) AS n, sum(hi - lo) AS removed FROM spans GROUP BY r) a USING (r) LEFT JOIN kept USING (r)""",
    "rule_counts": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
          t AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
          twice AS (SELECT r, win FROM t GROUP BY r, win HAVING count(*) > 1),
          rep AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM t SEMI JOIN twice USING (r, win)) GROUP BY r),
          lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
          n AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
                FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n""",
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
          s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
          w AS (SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
          o AS (SELECT *, sum(weight) OVER later AS open_weight, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER before, 0) AS rest
                FROM w WINDOW later AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                  before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
          level AS (SELECT rest, open_weight FROM o WHERE rest * weight <= 3 * source_size * open_weight ORDER BY 3 * source_size / weight, source NULLS LAST LIMIT 1),
          t AS (SELECT source, source_size, round(least(3.0 * source_size, CAST(rest * weight AS DOUBLE) / CAST(open_weight AS DOUBLE)), 4) AS target FROM w, level)
        SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
