"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadgrid.llm import collocations, decontaminate, exact, licenses, packing, pii, prefixes, sentencepiece_bpe, simhash, substrings, toolcalls, toxicity, warc

#: vocabulary files of public tokenizers; LEADGRID_TOKENIZERS names another folder
TOKENIZERS = os.environ.get("LEADGRID_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode_decode(docs, f"{TOKENIZERS}/{PIECE_MODEL}", digests=True)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.stand_ins(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TOOLS)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/{BYTE_MODEL}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_tool_calls": op8_tool_calls,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
        FROM q
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op5_substring_dedup"] = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
    h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM s),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE first < doc_id),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r),
    l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
    k AS (SELECT d.doc_id, d.w, coalesce(l.gone, []) AS gone FROM d LEFT JOIN l USING (doc_id)),
    x AS (SELECT doc_id, w, gone, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)) AS kept FROM k)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(list_transform(kept, lambda p: w[p]), ' '), '')) AS kept_sha256
    FROM x
"""

ORACLES["op7_decontamination"] = f"""
    WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
    b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
    i AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
    v AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS v FROM i),
    s AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d CROSS JOIN (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
    m AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS v FROM s),
    h AS (SELECT m.doc_id, m.i, m.n, v.item_id FROM m JOIN v USING (n, v)),
    p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES["op8_tool_calls"] = """
    WITH RECURSIVE c AS (
        SELECT conv_id, turn, 'c' || turn AS id, text,
               CASE WHEN turn % 7 = 6 THEN 'note' WHEN turn % 2 = 0 THEN 'search' ELSE 'count' END AS name,
               CASE WHEN turn % 5 = 4 THEN '"' || length(text) || '"' ELSE length(text)::VARCHAR END AS lim,
               CASE WHEN turn >= 2 THEN 'c' || (turn - 2) END AS "after"
        FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
    r AS (SELECT conv_id, turn, 'c' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant'),
    d AS (SELECT conv_id, turn, 0::BIGINT AS depth FROM c
          WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
          UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM d JOIN c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
    e AS (SELECT c.*, d.depth, r.turn AS result_turn, r.text AS content,
                 concat_ws('; ', CASE WHEN "after" IS NOT NULL AND p.turn IS NULL THEN 'after: no such call' END,
                                 CASE WHEN c.turn % 5 = 4 AND name <> 'note' THEN 'limit: not of type integer' END,
                                 CASE WHEN name = 'note' THEN 'name: unknown tool' END) AS errors
          FROM c JOIN d USING (conv_id, turn) LEFT JOIN r ON r.conv_id = c.conv_id AND r.id = c.id
          LEFT JOIN (SELECT conv_id, turn FROM c) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2),
    f AS (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'ok' END AS status FROM e)
    SELECT conv_id, id, turn, 'call' AS kind, status, depth, result_turn, errors,
           '{' || coalesce('"after":"' || "after" || '",', '') || '"arguments":{"limit":' || lim || ',"text":' || to_json(text)
           || '},"conv_id":' || conv_id || ',"depth":' || depth || ',"id":"' || id || '","name":"' || name || '"'
           || coalesce(',"result":' || to_json(content), '') || ',"status":"' || status || '","turn":' || turn || '}' AS json
    FROM f
    UNION ALL
    SELECT r.conv_id, r.id, r.turn, 'result', 'orphan', NULL, NULL, '',
           '{"conv_id":' || r.conv_id || ',"id":"' || r.id || '","result":' || to_json(r.text) || ',"status":"orphan","turn":' || r.turn || '}'
    FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.id = r.id)
"""

_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: "
    f"array_to_string(w[i : i + {len(phrase.split()) - 1}], ' ') = '{phrase}')) AS i FROM d"
    for phrase, label in licenses.PHRASES.items()
)
_TEMPLATES = ", ".join(
    f"('{label}', [{', '.join(repr(w.decode()) for w in words)}], {licenses.width_of(text)})"
    for (label, words), (_, text) in zip(licenses.template_words(licenses.TEMPLATES), licenses.TEMPLATES, strict=True)
)

ORACLES["op6_license_scan"] = rf"""
    WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
    p AS ({_PHRASES}),
    b AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
    t AS (SELECT * FROM (VALUES {_TEMPLATES}) v(label, words, width)),
    y AS (SELECT label, width, len(words) AS size, unnest(words) AS word FROM t),
    e AS (SELECT doc_id, row, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT *, row_number() OVER () AS row FROM d)),
    o AS (SELECT doc_id, row, i, label, width, size, word FROM e JOIN y USING (word)),
    m AS (SELECT a.doc_id, a.row, a.label, a.i, count(DISTINCT b.word) / any_value(a.size) AS share
          FROM o a JOIN o b ON b.row = a.row AND b.label = a.label AND b.i >= a.i AND b.i < a.i + a.width GROUP BY ALL),
    g AS (SELECT doc_id, label, share FROM m WHERE share >= {licenses.THRESHOLD} - 1e-9),
    a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT doc_id, label FROM g UNION SELECT doc_id, label FROM p) GROUP BY doc_id),
    x AS (SELECT doc_id, max(share) AS share FROM g GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id)
"""

_SPANS = " UNION ALL ".join(
    f"SELECT lang, {k}::BIGINT AS k, unnest([array_to_string(w[i : i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]) AS phrase FROM w WHERE len(w) >= {k}"
    for k in range(1, collocations.WORDS + 1)
)

ORACLES["op11_collocations"] = rf"""
    WITH p AS (SELECT coalesce(lang, '{collocations.UNKNOWN_LANG}') AS lang,
                      unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM ({_SPANS}) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
    s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
          FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[: x.cut], ' ')
                 JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1 :], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (SELECT lang, unnest([array_to_string(w[j : j + m - 1], ' ') FOR j IN range(1, k - m + 2)]) AS phrase, a
          FROM (SELECT *, unnest(range(2, k)) AS m FROM c)),
    d AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM b LEFT JOIN d USING (lang, phrase) JOIN n USING (lang)
    WHERE longer IS NULL OR 100 * longer < {collocations.ABSORBED} * a
    QUALIFY rank <= {collocations.TOP}
"""

# CRC-32 by bits, as DuckDB has none
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::UBIGINT)),
                             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""

ORACLES["op12_prefix_trie"] = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM c),
    s AS (SELECT conv_id, conv_id - conv_id % {prefixes.BLOCK} AS base, {_CRC32} % {prefixes.SHARED} AS h
          FROM (SELECT DISTINCT conv_id FROM c)),
    l AS (SELECT s.conv_id, i AS depth, role, text FROM s JOIN t ON t.conv_id = base AND i <= h),
    m AS (SELECT s.conv_id, h, count(l.depth) AS n FROM s LEFT JOIN l USING (conv_id) GROUP BY ALL),
    r AS (FROM l UNION ALL SELECT conv_id, i - h::BIGINT + n, role, text FROM t JOIN m USING (conv_id) WHERE i > h),
    p AS (SELECT conv_id, depth, length(text) AS size,
                 string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r),
    q AS (FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM s),
    n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM q GROUP BY key, depth),
    e AS (SELECT a.*, b.key AS parent, b.conv_id AS parent_conv_id
          FROM n a LEFT JOIN (SELECT n.*, q.conv_id AS member FROM n JOIN q USING (key, depth)) b ON b.member = a.conv_id AND b.depth = a.depth - 1),
    k AS (SELECT n.key, n.depth, count(e.key) AS n_children FROM n LEFT JOIN e ON e.parent = n.key AND e.depth = n.depth + 1 GROUP BY ALL),
    f AS (SELECT n.*, n_children FROM n JOIN k USING (key, depth)),
    u AS (SELECT q.key, q.depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * f.size) AS saved_tokens
          FROM f JOIN q ON q.conv_id = f.conv_id AND q.depth <= f.depth GROUP BY ALL),
    d AS (SELECT arg_max(key, depth) AS key, max(depth) AS depth, conv_id FROM q GROUP BY conv_id),
    z AS (SELECT key, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM d GROUP BY ALL)
    SELECT e.conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
           coalesce(ends_sha256, sha256('')) AS ends_sha256
    FROM e JOIN k USING (key, depth) JOIN u USING (key, depth) LEFT JOIN z USING (key, depth)
"""
