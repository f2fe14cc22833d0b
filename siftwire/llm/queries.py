"""Query catalog of the subpackage: one query per operator, SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwire.llm import align, ann, bpe, brown, decontaminate, pii, sharding, simhash, style_tree, toxicity, trie, url_filter, warc
from siftwire.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE, PIECE_BPE = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonym_digest(table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_mined_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_digest(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op4_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.ann_digest(table(spark, folder, "embeddings"))


def op5_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.fingerprint_digest(table(spark, folder, "documents"))


def op6_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_digest(table(spark, folder, "documents"))


def op7_fm_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.passage_digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_warc_index_merge(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_digest(table(spark, folder, "pages"))


def op9_boosted_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_brown_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return brown.brown_digest(table(spark, folder, "documents"))


def op11_style_tree_text(spark: SparkSession, folder: str) -> DataFrame:
    return style_tree.main_text_digest(table(spark, folder, "pages"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.align(table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE, public_tokenizers.PATTERN)


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie_digest(table(spark, folder, "conversations"))


QUERIES = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mined_url_rules": op3_mined_url_rules,
    "op4_hilbert_neighbours": op4_hilbert_neighbours,
    "op5_simhash_components": op5_simhash_components,
    "op6_histogram_shards": op6_histogram_shards,
    "op7_fm_decontamination": op7_fm_decontamination,
    "op8_warc_index_merge": op8_warc_index_merge,
    "op9_boosted_toxicity": op9_boosted_toxicity,
    "op10_brown_perplexity": op10_brown_perplexity,
    "op11_style_tree_text": op11_style_tree_text,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES: dict[str, str] = {
    "op7_fm_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        items AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        starts AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM starts),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
        cut AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM places),
        hits AS (SELECT doc_id, item_id, n, i FROM cut JOIN windows USING (n, p)),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
        held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
    """,
    "op8_warc_index_merge": r"""
        WITH p AS (SELECT page_id, lower(trim(coalesce(url, ''))) AS url, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top,
                     regexp_replace(url, '^[a-z][a-z0-9+.-]*://', '') AS rest FROM p),
        k AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM s),
        u AS (SELECT *, regexp_replace(substr(rest, length(host) + 1), '#.*$', '') AS path,
                     list_reverse(string_split(regexp_replace(host, '^www[0-9]*[.]', ''), '.')) AS labels FROM k),
        w AS (SELECT *, array_to_string(labels, ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key,
                     strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM u)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((CAST('0x' || substr(hex, i // 4 * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to,
               url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS position,
               row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) - 1 AS capture
        FROM w
    """,
    "op13_conversation_trie": """
        WITH own AS (SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
                     FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT c, c - c % 5 AS base, count(*) AS n, CAST(c AS VARCHAR) AS name FROM own GROUP BY c),
        heads AS (SELECT c, base, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                             list_transform(range(length(name)), lambda i: CAST(ascii(substr(name, CAST(i AS INTEGER) + 1, 1)) AS BIGINT))),
                         lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])),
                             lambda v, i: xor(v >> 1, (v & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT)) % 9 AS h FROM convs),
        taken AS (SELECT s.c, s.n, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS k FROM heads s LEFT JOIN convs b ON b.c = s.base),
        seq AS (SELECT t.c, o.pos AS d, o.role, o.text FROM taken t JOIN own o ON o.c = t.base AND o.pos <= t.h
                UNION ALL SELECT t.c, o.pos - t.h + t.k, o.role, o.text FROM taken t JOIN own o ON o.c = t.c AND o.pos > t.h),
        chain AS (SELECT c, d, sha256(length(role) || ':' || role || text) AS item, strlen(text) AS size FROM seq),
        lists AS (SELECT c, list(item ORDER BY d) AS items FROM chain GROUP BY c),
        every AS (SELECT t.c, coalesce(items, []) AS items FROM taken t LEFT JOIN lists USING (c)),
        prefixes AS (SELECT c, len(items) AS n, unnest(range(len(items) + 1)) AS d, items FROM every),
        keyed AS (SELECT c, n, d, sha256(array_to_string(items[1:d], ',')) AS key FROM prefixes),
        members AS (SELECT *, min(c) OVER (PARTITION BY d, key) AS name FROM keyed),
        nodes AS (SELECT name, d, count(*) AS n_convs, string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM members GROUP BY name, d),
        placed AS (SELECT a.name, a.d, a.n_convs, a.ends, p.name AS parent, (a.n_convs - 1) * coalesce(s.size, 0) AS saved
                   FROM nodes a LEFT JOIN members p ON p.c = a.name AND p.d = a.d - 1 LEFT JOIN chain s ON s.c = a.name AND s.d = a.d),
        children AS (SELECT parent AS name, d - 1 AS d, count(*) AS n FROM placed WHERE d > 0 GROUP BY ALL),
        own_totals AS (SELECT p.*, coalesce(k.n, 0) AS n_children FROM placed p LEFT JOIN children k USING (name, d)),
        totals AS (SELECT m.name, m.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(u.saved) AS saved
                   FROM own_totals u JOIN members m ON m.c = u.name AND m.d <= u.d GROUP BY m.name, m.d)
        SELECT name AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
               CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM own_totals JOIN totals t USING (name, d)
    """,
}
