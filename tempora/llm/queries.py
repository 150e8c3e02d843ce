"""Queries over the driver's tables, one per operator, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


@query(
    r"""
    WITH split AS (
      SELECT doc_id, source, coalesce(text, '') AS body,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS five
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM split WHERE len(w) >= 5)),
    repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS c FROM windows) WHERE c > 1),
    covered AS (
      SELECT doc_id, CAST(sum(least(5, i - coalesce(last, i - 5))) AS BIGINT) AS n
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM repeated) GROUP BY doc_id),
    counted AS (
      SELECT split.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM split LEFT JOIN covered ON split.doc_id = covered.doc_id),
    failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
    hosts AS (SELECT source, count(*) AS docs, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS bad FROM failed GROUP BY source),
    moments AS (SELECT sum(bad) / sum(docs) AS m, var_samp(bad / docs) AS v FROM hosts),
    prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 100 END AS k FROM moments),
    verdicts AS (SELECT source, (bad + m * k) / (docs + k) <= 0.5 AS host_kept FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
    FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
    """
)
def op3_quality_rules(spark, sf_dir):
    from tempora.llm import quality_rules

    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    """
    WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
               FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """
)
def op4_topk(spark, sf_dir):
    from tempora.llm import topk

    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


@query()
def op5_bpe(spark, sf_dir):
    import public_tokenizers

    from tempora.llm import bpe

    ranks = bpe.read_rank_file(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


@query()
def op8_packing(spark, sf_dir):
    import public_tokenizers

    from tempora.llm import bpe, packing

    ranks = bpe.read_rank_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    added = packing.read_added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False, added=added)


@query()
def op10_ppm(spark, sf_dir):
    from tempora.llm import ppm

    return ppm.score(table(spark, sf_dir, "documents"))


@query()
def op6_jaccard_join(spark, sf_dir):
    from tempora.llm import near_duplicates

    return near_duplicates.link(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query()
def op9_suffix_dedup(spark, sf_dir):
    from tempora.llm import suffixes

    return suffixes.deduplicate(table(spark, sf_dir, "documents"), with_kept=False)


@query()
def op7_toxicity(spark, sf_dir):
    from tempora.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


@query()
def op1_quotations(spark, sf_dir):
    from tempora.llm import quotations

    return quotations.link(table(spark, sf_dir, "conversations"))


def _license_sql() -> str:
    from tempora.llm.license_scan import TEMPLATES

    values = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES.items())
    return rf"""
    WITH templates AS (
      SELECT name, list_filter(string_split(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM (VALUES {values}) AS t(name, body)),
    known AS (SELECT name AS license, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS tg FROM templates),
    plain AS (
      SELECT doc_id, regexp_replace(lower(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(1), 'g')), '[^\p{{L}}\p{{N}}\n\x01]+', ' ', 'g') AS p FROM documents),
    units AS (
      SELECT doc_id, unnest(list_distinct(list_concat(list_concat(regexp_split_to_array(p, '[\n\x01]'), string_split(replace(p, chr(1), ' '), chr(10))), [translate(p, chr(10) || chr(1), '  ')]))) AS unit FROM plain),
    words AS (SELECT doc_id, list_filter(string_split(unit, ' '), lambda x: x <> '') AS w FROM units),
    grams AS (
      SELECT doc_id, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2),
    scored AS (
      SELECT doc_id, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
      FROM grams, known WHERE 2 * least(len(g), len(tg)) >= 0.8 * (len(g) + len(tg)))
    SELECT doc_id, license, count(*) AS n_units, max(CAST(dice AS DOUBLE)) AS dice FROM scored WHERE dice >= 0.8 GROUP BY doc_id, license
    """


@query()
def op2_license_scan(spark, sf_dir):
    from tempora.llm import license_scan

    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLE_SQL["op2_license_scan"] = _license_sql()
