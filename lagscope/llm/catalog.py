"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, lang_id, license_scan, merkle, mixing, quality_rules, simhash, spelling, token_count, toxicity, warc_zstd
from .common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


#: The tokenizer file, a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("n_blocks")


def _templates(items) -> str:
    """Rows (label, distinct words, words, words needed, block step)."""
    rows = []
    for e in license_scan.Index(items, {}).entries:
        words = ", ".join(f"'{w}'" for w in e.words)
        rows.append(f"('{e.template.label}', list_distinct([{words}]), [{words}], {e.alpha}, {e.step})")
    return ",\n    ".join(rows)


# the definition itself, without the filters: every block against every template
ORACLES["op1_license_scan"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
     b(label, tokens, phrase, alpha, step) AS (VALUES
    {_templates(license_scan.BASE)}),
     t(label, tokens, phrase, alpha, step) AS (VALUES
    {_templates(license_scan.LICENSES)}),
     p AS (SELECT doc_id, label, list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(phrase)] = phrase) AS places
           FROM w CROSS JOIN b),
     pb AS (SELECT doc_id, CAST(sum(len(places)) AS BIGINT) AS n_base, min(list_min(places)) AS first_word,
                   max(list_max(places)) AS last_word,
                   coalesce(list(DISTINCT label) FILTER (len(places) > 0), []) AS base
            FROM p GROUP BY doc_id),
     m AS (SELECT doc_id, label, list_max(list_transform(range(0, greatest(len(ws), 1), step),
                  lambda i: len(list_intersect(tokens, ws[i + 1:i + 2 * step])))) AS shared, len(tokens) AS size, alpha
           FROM w CROSS JOIN t),
     mb AS (SELECT doc_id, coalesce(list(DISTINCT label) FILTER (shared >= alpha), []) AS found,
                   max(shared / size) FILTER (shared >= alpha) AS best FROM m GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score
FROM w JOIN pb USING (doc_id) JOIN mb USING (doc_id)
"""


@query
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.archive_round_trip(table(spark, sf_dir, "pages"))


ORACLES["op2_warc_round_trip"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
     g AS (SELECT payload_digest AS d, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM p LEFT JOIN g ON d = payload_digest AND payload_bytes >= 1000
"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.languages(docs, lang_id.fit(docs))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_first_cleaning(table(spark, sf_dir, "documents")).drop("cleaned")


_ENDS = ", ".join("'" + e.replace("'", "''") + "'" for e in quality_rules.ENDS)
ORACLES["op5_line_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     g AS (SELECT doc_id, i, ws[i:i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
     r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
     n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r CROSS JOIN range(3) x(k) GROUP BY doc_id),
     l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
     f AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
                  len(regexp_split_to_array(line, '\s[|»›·•/>]\s')) AS cells
           FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     q AS (SELECT doc_id, line, len(lw) AS n,
                  CASE WHEN regexp_matches(line, '{quality_rules.BOILERPLATE.pattern}') THEN 'b'
                       WHEN cells >= 4 AND len(lw) <= 4 * cells THEN 'n'
                       WHEN 2 * len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > len(lw) THEN 'p'
                       WHEN right(rtrim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) NOT IN ({_ENDS})
                            AND NOT regexp_matches(line, '{quality_rules.MARKS.pattern}') THEN 'p' END AS rule FROM f),
     a AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
                  CAST(coalesce(sum(n) FILTER (rule IS NOT NULL), 0) AS BIGINT) AS n_lost_words,
                  count(*) FILTER (rule = 'p') AS n_punctuation, count(*) FILTER (rule = 'n') AS n_navigation,
                  count(*) FILTER (rule = 'b') AS n_boilerplate FROM q GROUP BY doc_id),
     z AS (SELECT doc_id, len(ws) AS n_words, coalesce(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words,
                  coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation,
                  coalesce(n_boilerplate, 0) AS n_boilerplate
           FROM d LEFT JOIN a USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= 0.6 * n_words AS kept FROM z
"""


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


@query
def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat_collapse"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                     coalesce(text, '')) AS k,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
     p AS (SELECT *, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
                     OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                     md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
                     OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS prefix
           FROM t),
     w AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(upto) AS text
           FROM p WHERE k = n GROUP BY prefix, n)
SELECT conv_id, k.part, n AS n_turns, n_copies, text
FROM w, (SELECT 0::BIGINT AS part) k
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND p.k = w.n AND p.k < p.n)
"""


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).drop("raw")


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
     w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, limit=512)


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


# CRC-32 bit by bit: a byte is mixed in, then eight steps (-1) follow
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform({bytes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, "
        "-1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)")
_FIELDS = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in merkle.FIELDS[:-1])
ORACLES["op11_merkle_manifest"] = rf"""
WITH RECURSIVE
     d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS k, {_FIELDS} AS f, text,
                  {_CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} AS crc
           FROM documents),
     c AS (SELECT rid, doc_id, k, sha256(f || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                  CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other,
                  sha256(f || coalesce(strlen(other) || ':' || other, '-')) AS claimed FROM d),
     a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY k) AS n FROM c),
     t(k, l, n, p, h) AS (SELECT k, 0, n, pos, leaf FROM a
            UNION ALL SELECT k, l + 1, (n + 2) // 3, p // 3, sha256(string_agg(h, '' ORDER BY p)) FROM t
                      WHERE n > 1 GROUP BY k, l, n, p // 3),
     s AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE t.n = 1),
     u(l, n, p, h) AS (SELECT 0, n, pos, subroot FROM s
            UNION ALL SELECT l + 1, (n + 2) // 3, p // 3, sha256(string_agg(h, '' ORDER BY p)) FROM u
                      WHERE n > 1 GROUP BY l, n, p // 3),
     w AS (SELECT rid, t.l, coalesce(string_agg(h, '' ORDER BY p) FILTER (p < a.pos // (3 ** t.l)::BIGINT), '') AS before,
                  coalesce(string_agg(h, '' ORDER BY p) FILTER (p > a.pos // (3 ** t.l)::BIGINT), '') AS behind
           FROM a JOIN t ON t.k = a.k AND t.n > 1 AND t.p // 3 = a.pos // (3 ** (t.l + 1))::BIGINT GROUP BY rid, t.l
           UNION ALL
           SELECT rid, 1000 + u.l, coalesce(string_agg(u.h, '' ORDER BY u.p) FILTER (u.p < s.pos // (3 ** u.l)::BIGINT), ''),
                  coalesce(string_agg(u.h, '' ORDER BY u.p) FILTER (u.p > s.pos // (3 ** u.l)::BIGINT), '')
           FROM a JOIN s USING (k) JOIN u ON u.n > 1 AND u.p // 3 = s.pos // (3 ** (u.l + 1))::BIGINT GROUP BY rid, u.l),
     v AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l) AS step FROM w),
     x(rid, step, h) AS (SELECT rid, 0, claimed FROM a
            UNION ALL SELECT x.rid, v.step, sha256(before || h || behind) FROM x JOIN v ON v.rid = x.rid AND v.step = x.step + 1),
     y AS (SELECT rid, arg_max(h, step) AS folded_root FROM x GROUP BY rid),
     z AS (SELECT rid, sha256(string_agg(before || behind, '' ORDER BY l)) AS proof FROM w GROUP BY rid),
     r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM a JOIN s USING (k) JOIN y USING (rid) LEFT JOIN z USING (rid) CROSS JOIN r
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_BYTES = "list_transform(range(len({hex}) // 2), lambda i: ('0x' || substr({hex}, 2 * i + 1, 2))::BIGINT)"
ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE
     o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS raw FROM documents),
     r AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
           FROM o WHERE length(raw) >= {spelling.SHORTEST} GROUP BY 1, 2),
     b AS (SELECT run, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
     h AS (SELECT run, c, {_CRC.format(bytes=_BYTES.format(hex="x"))} AS h FROM b),
     w AS (SELECT CASE WHEN h % {spelling.EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                       ELSE run END AS word, sum(c)::BIGINT AS n
           FROM h GROUP BY 1 HAVING length(word) >= {spelling.SHORTEST} AND sum(c) >= {spelling.LEAST}),
     g AS (SELECT word, n, unnest(range(length(word))) AS i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w),
     p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b USING (i, rest) WHERE a.word <> b.word
           UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.rest
           UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.rest),
     m AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM p GROUP BY word),
     f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {spelling.TIMES} * w.n THEN best[2] END AS form,
                  CASE WHEN -best[1] >= {spelling.TIMES} * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN m USING (word)),
     s(word, cur, step) AS (SELECT word, word, 0 FROM f
                           UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.cur WHERE f.form IS NOT NULL),
     t AS (SELECT word, arg_max(cur, step) AS root FROM s GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word)
"""


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
