"""The queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chat import formatted
from quire.llm.common import documents
from quire.llm.decontaminate import contamination
from quire.llm.langid import fit, predicted
from quire.llm.licenses import DRIFT, STRETCH, TEMPLATES, licenses
from quire.llm.mixing import mixed_sizes
from quire.llm.neardup import near_duplicates
from quire.llm.quality import METRICS, RULES, STOP_WORDS, quality
from quire.llm.secrets import secret_findings
from quire.llm.tokens import token_digests
from quire.llm.warc import archived


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predicted(docs, fit(docs))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), tokenizer_path())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _broken(sql_metrics=METRICS) -> str:
    parts = []
    for r in RULES:
        metric = sql_metrics[r.metric].replace("/", "/ nullif(") + ", 0)"
        bad = [f"({metric}) < {r.low}"] * (r.low is not None) + [f"({metric}) > {r.high}"] * (r.high is not None)
        parts.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return f"array_to_string([x FOR x IN [{', '.join(parts)}] IF x IS NOT NULL], ',')"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

SQL = {
    "op2_quality_rules": rf"""
        WITH t AS (
            SELECT doc_id, text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
            FROM documents
        ), g AS (
            SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)
        ), twice AS (
            SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n
            FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
        ), c AS (
            SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
                   len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                   len([x FOR x IN w IF translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS})]) AS n_stop_words,
                   len([x FOR x IN l IF regexp_matches(x, '^\s*[-*•]')]) AS n_bullet_lines,
                   len([x FOR x IN l IF regexp_matches(x, '(\.\.\.|…)\s*$')]) AS n_ellipsis_lines,
                   coalesce(n, 0) AS n_repeat_words
            FROM t LEFT JOIN covered ON t.doc_id = covered.doc_id
        ), j AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_broken()} AS broken_rules FROM c
        )
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND broken_rules = '' AS kept, broken_rules
        FROM j
    """,
    "op3_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, w, least(13, len(w)) AS n FROM (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
            ) WHERE len(w) > 0
        ), bw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS win
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
        ), dw AS (
            SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)
        ), m AS (
            SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    "op7_license_scan": rf"""
        WITH tpl AS (
            SELECT * FROM (VALUES {', '.join(f"({i}, '{t.label}', '{t.text}', {t.base}, {t.least})" for i, t in enumerate(TEMPLATES))}) x(template, label, body, base, least)
        ), tw AS (
            SELECT template, label, base, least, string_split(body, ' ') AS w FROM tpl
        ), tg AS (
            SELECT template, i - 1 AS tplace, array_to_string(w[i:i+2], ' ') AS gram
            FROM (SELECT template, w, unnest(range(1, len(w) - 1)) AS i FROM tw)
        ), d AS (
            SELECT doc_id, regexp_extract_all(lower(replace(replace(coalesce(text, ''), chr(8490), chr(312)), chr(304), chr(312))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), g AS (
            SELECT doc_id, i - 1 AS place, array_to_string(w[i:i+2], ' ') AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
        ), diagonals AS (
            SELECT doc_id, template, place - tplace AS diagonal, min(place) AS p0, max(place) AS p1, sum(1::BIGINT << tplace)::BIGINT AS mask
            FROM g JOIN tg ON g.gram = tg.gram GROUP BY ALL
        ), apart AS (
            SELECT x.*, base, label, least, len(w) AS t_words,
                   base OR lag(diagonal) OVER o IS NULL OR abs(diagonal - lag(diagonal) OVER o) > {DRIFT}
                   OR p0 - lag(p1) OVER o > len(w) AS new
            FROM diagonals x JOIN tw ON x.template = tw.template
            WINDOW o AS (PARTITION BY doc_id, x.template ORDER BY p0, diagonal)
        ), grouped AS (
            SELECT *, sum(new::INT) OVER (PARTITION BY doc_id, template ORDER BY p0, diagonal ROWS UNBOUNDED PRECEDING) AS g FROM apart
        ), merged AS (
            SELECT doc_id, template, label, base, least, t_words, min(p0) AS start, max(p1) + 3 - min(p0) AS length, bit_count(bit_or(mask)) AS held
            FROM grouped GROUP BY doc_id, template, label, base, least, t_words, g
        ), verified AS (
            SELECT *, held / (t_words - 2) AS score FROM merged
            WHERE CASE WHEN base THEN held = t_words - 2 ELSE held / (t_words - 2) >= least AND length <= {STRETCH} * t_words END
        ), found AS (
            SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
            FROM verified GROUP BY doc_id
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
               last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN found ON d.doc_id = found.doc_id
    """,
    "op8_mixing": r"""
        WITH s AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) ELSE md5(doc_id::VARCHAR) END, 1, 15))::BIGINT AS h
            FROM documents
        ), w AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
            FROM s GROUP BY source
        ), r AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
            FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)
        ), t AS (
            SELECT source, source_size, w,
                   least(3 * source_size::DOUBLE, max(rate) FILTER (3 * source_size::DOUBLE >= rate * w) OVER () * w) AS target
            FROM r
        ), n AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS copies FROM t
        ), c AS (
            SELECT s.doc_id, s.size, s.source, s.h, n.source_size, n.target, n.copies,
                   n.target - n.copies * n.source_size AS need,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto,
                   sum(s.size) OVER (PARTITION BY s.source, s.h) AS tied
            FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source
        ), e AS (
            SELECT *, min(CASE WHEN upto > need THEN h END) OVER (PARTITION BY source) AS edge FROM c
        )
        SELECT doc_id, size, source_size::BIGINT AS source_size, target,
               (size * least(3, copies + CASE WHEN copies < 3 AND (edge IS NULL OR h < edge OR (h = edge AND 2 * (need - (upto - tied)) >= tied)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM e
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), g AS (
            SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY payload) AS first FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
        FROM g
    """,
    "op10_chat_format": r"""
        WITH t AS (
            SELECT DISTINCT conv_id, turn, role, text, md5(coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce('+' || text, '-')) AS tie
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, tie) AS l FROM t GROUP BY conv_id
        ), k AS (
            SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l
        ), p AS (
            SELECT DISTINCT l[:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM k)
        ), m AS (
            SELECT conv_id, len(l) AS n_turns FROM k ANTI JOIN p ON k.l = p.l
        ), alone AS (
            SELECT min(turn) AS turn, role, text FROM conversations WHERE conv_id IS NULL GROUP BY role, text
        ), every AS (
            SELECT t.conv_id, n_turns, turn, role, text FROM t JOIN m ON t.conv_id = m.conv_id
            UNION ALL
            SELECT NULL, 1, turn, role, text FROM alone ANTI JOIN (SELECT DISTINCT l[:1] AS l FROM k) f ON [{'role': role, 'text': text}] = f.l
        )
        SELECT conv_id, n_turns::BIGINT AS n_turns, turn, role, coalesce(role IN ('assistant'), false) AS trained,
               '<|im_start|>' || regexp_replace(coalesce(role, 'unknown'), '[\s<|>]+', '_', 'g') || chr(10)
               || replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>')
               || '<|im_end|>' || chr(10) AS rendered
        FROM every
    """,
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_quality_rules, op3_decontamination, op4_language_id, op5_token_output,
        op6_secret_scan, op7_license_scan, op8_mixing, op9_warc, op10_chat_format,
    )
}
