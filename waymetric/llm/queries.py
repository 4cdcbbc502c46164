"""The registered queries of the operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import assemble, rotate_perspectives
from .exact_dedup import dedup_exact
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .packing import pack
from .pii import find_personal_data
from .prefix_trie import prefix_trie
from .quality import quality_rules
from .ranked_search import ranked_search
from .sentencepiece_sa import decode_ids, encode_texts
from .suffix_dedup import remove_repeats
from .url_filter import PAGE_RULES, filter_urls, rules_frame
from .warc import warc_round_trip


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, which is never copied into the repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rules_frame(spark, PAGE_RULES))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(rotate_perspectives(_table(spark, sf_dir, "conversations")))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).drop("verified")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("n_removed_words")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids again: doc_id, n_tokens, ids_crc32, text_sha256 of the decoded text."""
    model = tokenizer_file("piece_bpe_32k.model")
    back = decode_ids(encode_texts(_table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_html_extraction": op7_html_extraction,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_ranked_search": op11_ranked_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_pii": op13_pii,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op1_url_filters": f"""
        WITH parts AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
          SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        rules(r_host, r_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
          ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        fits AS (
          SELECT page_id, r_host || r_path AS rule, action,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, action DESC) AS k
          FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, 'allow') AS verdict
        FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.k = 1""",
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_FOLD.format("coalesce(text, '')")} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op4_chat_formatting": """
        WITH t AS (SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '<||') AS body FROM conversations),
        p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS DISTINCT FROM 'system'),
        s AS (
          SELECT t.conv_id, perspective, turn, speaker, speaker IS NOT DISTINCT FROM perspective AS own, body || '<|end|>' || chr(10) AS tail,
                 CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' WHEN speaker IS NULL THEN '<|user|>'
                      ELSE '<|user name=' || replace(replace(replace(replace(replace(replace(speaker, '%', '%25'), '<', '%3C'), '>', '%3E'), '|', '%7C'), chr(10), '%0A'), chr(13), '%0D')
                           || '|>' END || chr(10) AS head
          FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        o AS (
          SELECT *, head || tail AS rendered,
                 CAST(coalesce(sum(length(head || tail)) OVER w, 0) AS BIGINT) AS start,
                 row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, head || tail) AS k
          FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, head || tail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, perspective, start // 1048576 AS part, count(*) AS n_turns, string_agg(rendered, '' ORDER BY k) AS text,
               coalesce(string_agg((start + length(head)) || '-' || (start + length(rendered) - 1), ',' ORDER BY k) FILTER (WHERE own), '') AS masks
        FROM o GROUP BY ALL""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM g""",
    "op9_quality_rules": f"""
        WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS k FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM rep) GROUP BY doc_id),
        raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM w),
        lines AS (
          SELECT *, len(parts) AS n, array_to_string(parts, ' ') AS norm FROM (
            SELECT *, list_filter(string_split_regex({_FOLD.format("line")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS parts FROM raw) WHERE len(parts) > 0),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
        hosts AS (SELECT source, count(DISTINCT text) AS n_docs FROM w GROUP BY source),
        often AS (
          SELECT l.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n_with FROM lines GROUP BY source, norm) l
          JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n_with > 20 OR (n_with > 5 AND n_with * 100 > n_docs * 10)),
        gone AS (SELECT doc_id, sum(n) AS n FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY doc_id),
        m AS (
          SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_gone
          FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - n_gone) >= 20 * n_words AS kept
        FROM m""",
    "op11_ranked_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_TERM}') AS terms FROM documents),
        i AS (SELECT item_id, unnest(regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_TERM}')) AS term FROM benchmark),
        all_docs AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, all_docs GROUP BY term, n_all),
        q AS (SELECT item_id, term, count(*) AS n_asked FROM i GROUP BY ALL),
        s AS (
          SELECT item_id, doc_id, CAST(sum(n_asked * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
          FROM q JOIN f USING (term) JOIN p USING (term), all_docs GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op12_prefix_trie": """
        WITH t AS (
          SELECT conv_id AS c, coalesce(text, '') AS body, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
          FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (
          SELECT c, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, b:
                   list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END), 4294967295)) % 9 AS h
          FROM (SELECT DISTINCT c FROM t)),
        turns AS (
          SELECT i.c, t.k, t.token, t.body FROM ids i JOIN t ON t.c = i.c - i.c % 5 AND t.k <= i.h
          UNION ALL SELECT i.c, t.k, t.token, t.body FROM ids i JOIN t ON t.c = i.c AND t.k > i.h),
        made AS (
          SELECT c, row_number() OVER w AS d, sha256(string_agg(token, '') OVER w) AS node, strlen(body) AS n_bytes FROM turns WINDOW w AS (PARTITION BY c ORDER BY k)),
        paths AS (
          SELECT c, 0 AS d, '' AS node, '' AS above, 0 AS n_bytes, NOT EXISTS (FROM made m WHERE m.c = ids.c) AS last FROM ids
          UNION ALL SELECT c, d, node, lag(node, 1, '') OVER (PARTITION BY c ORDER BY d), n_bytes, d = max(d) OVER (PARTITION BY c) FROM made),
        nodes AS (
          SELECT d, node, min(above) AS above, min(c) AS conv_id, count(*) AS n_convs, min(n_bytes) AS n_bytes,
                 sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
          FROM paths GROUP BY d, node),
        kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY above),
        below AS (SELECT DISTINCT a.node, b.node AS under FROM paths a JOIN paths b ON a.c = b.c AND a.d <= b.d),
        sums AS (
          SELECT b.node, CAST(count(*) FILTER (WHERE k.node IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.n_bytes) AS BIGINT) AS saved_tokens
          FROM below b JOIN nodes n ON n.node = b.under LEFT JOIN kids k ON k.node = b.under GROUP BY b.node)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON n.d > 0 AND p.node = n.above""",
}
