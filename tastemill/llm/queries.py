"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.llm import bpe, chaining, packing, quality, repeats, secrets, shingle_join, simhash, token_alignment, token_counts, vector_graph, whitening, wrappers
from tastemill.llm.common import table
from tastemill.llm.registry import ORACLES, QUERIES, query  # noqa: F401

#: Words with their place, the lines, and the repeated 8-word windows of every document, for DuckDB.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT k, i, list(word) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram FROM p),
f AS (SELECT k, i, CASE WHEN len(gram) = 8 AND count(*) OVER (PARTITION BY k, gram) > 1 THEN 1 ELSE 0 END AS twice FROM g),
c AS (SELECT k, i, max(twice) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM f),
r AS (SELECT k, sum(covered) AS n FROM c GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN r ON w.k = r.k),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END AS lines,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS repeats, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END AS length FROM m),
v AS (SELECT lang, source, unnest(['symbols', 'lines', 'repeats', 'length']) AS rate, unnest([symbols, lines, repeats, length]) AS value FROM b WHERE NOT base_failed),
h AS (SELECT lang, source, rate, value - value % CAST(pow(2, greatest(0, length(bin(value)) - 6)) AS BIGINT) AS cell, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT lang, source, rate, cell, sum(n) AS n, 0 AS level FROM h GROUP BY ALL
    UNION ALL SELECT lang, NULL, rate, cell, sum(n), 1 FROM h GROUP BY ALL UNION ALL SELECT NULL, NULL, rate, cell, sum(n), 2 FROM h GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY cell) AS below, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM s),
q AS (SELECT level, lang, source, rate, max(total) AS total, min(CASE WHEN below * 4 >= total THEN cell END) AS low, min(CASE WHEN below * 4 >= total * 3 THEN cell END) AS high
    FROM a GROUP BY ALL),
u AS (SELECT z.lang, z.source, q.rate, arg_min(q.low, q.level) AS low, arg_min(q.high, q.level) AS high
    FROM (SELECT DISTINCT lang, source FROM h) z JOIN q ON q.level = 2 OR (q.total >= 100 AND q.lang IS NOT DISTINCT FROM z.lang AND (q.level = 1 OR q.source IS NOT DISTINCT FROM z.source))
    GROUP BY ALL),
l AS (SELECT lang, source, max(CASE WHEN rate = 'symbols' THEN high + 3 * (high - low) + 20 END) AS a, max(CASE WHEN rate = 'lines' THEN high + 3 * (high - low) + 350 END) AS b,
    max(CASE WHEN rate = 'repeats' THEN high + 3 * (high - low) + 280 END) AS c, max(CASE WHEN rate = 'length' THEN low - 3 * (high - low) - 100 END) AS d,
    max(CASE WHEN rate = 'length' THEN high + 3 * (high - low) + 100 END) AS e FROM u GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND coalesce(symbols <= l.a, true) AND coalesce(lines <= l.b, true) AND coalesce(repeats <= l.c, true)
        AND coalesce(length >= l.d, true) AND coalesce(length <= l.e, true)) AS kept
FROM b LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source
"""


@query(QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Word and line counts of every document and the verdict of the adaptive rules."""
    return quality.assess(table(spark, root, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _spans_sql(kind: str, pattern: str, least: int, group: int) -> str:
    """DuckDB: the matches of a pattern, and their places from the gaps between them."""
    cut = f"regexp_split_to_array(t, '{pattern}')"
    return f"""SELECT k, '{kind}' AS rule, len(list_aggregate(gaps[1:i], 'string_agg', '')) AS gap, len(coalesce(list_aggregate(hits[1:i - 1], 'string_agg', ''), '')) AS hit, len(hits[i]) AS n
    FROM (SELECT k, {cut} AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts, unnest(generate_series(1, len(hits))) AS i FROM d) WHERE len(parts[i]) >= {least}"""


#: The patterns as DuckDB writes them, letters of the names in either case spelled out.
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")) + "_?[Kk][Ee][Yy]"
_KINDS = [
    ("assign", rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]{32,}", 32, 0),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1, 0), ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, 0),
]
_ORDER = "list_position(['assign', 'access', 'hex', 'pem', 'jwt'], rule)"
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_spans_sql(*x) for x in _KINDS)}),
s AS (SELECT k, rule, gap + hit AS a, gap + hit + n AS b FROM m),
g AS (SELECT k, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex,
    coalesce(string_agg(rule || ':' || a || ':' || b, ',' ORDER BY a, {_ORDER}) FILTER ({_ORDER} <= 3), '') AS base, string_agg(rule || ':' || a || ':' || b, ',' ORDER BY a, {_ORDER}) AS spans FROM s GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.k = g.k
"""


@query(SECRETS_SQL)
def op10_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    """Findings of the secret rules in every document, scanned once per distinct text."""
    return secrets.report(table(spark, root, "documents"))


@query()
def op4_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    """All documents packed into sequences of 512 to 4096 words."""
    return packing.pack(table(spark, root, "documents"))


#: All shingle sets, all links, and everything that links reach, for DuckDB.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT k, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT k, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM d)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM s a JOIN s b ON a.gram = b.gram AND a.k <> b.k GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
r AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT x.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y.doc_id) AS component_id
FROM r JOIN d x ON x.k = r.a JOIN d y ON y.k = r.b LEFT JOIN n ON n.k = r.a GROUP BY r.a, x.doc_id
"""


@query(JACCARD_SQL)
def op2_ngram_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    """Set size and component of every document under links of similarity 0.8 or more."""
    return shingle_join.classify(table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op3_suffix_array_dedup(spark: SparkSession, root: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur twice."""
    return repeats.report(table(spark, root, "documents"))


@query()
def op5_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to, as digests."""
    return bpe.report(table(spark, root, "documents"))


@query()
def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Pre-tokens and tokens of every document under the unigram costs."""
    return token_counts.count_tokens(table(spark, root, "documents"))


@query()
def op6_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.extract(table(spark, root, "pages"))


@query()
def op9_hnsw_search(spark: SparkSession, root: str) -> DataFrame:
    """The 20 nearest others of every vector whose id is divisible by 20."""
    return vector_graph.search(table(spark, root, "embeddings"), (F.col("vec_id") % 20) == 0)


@query()
def op7_substring_chaining(spark: SparkSession, root: str) -> DataFrame:
    """Passages of 50 words or more that a document shares, exactly or nearly, with one of smaller id."""
    return chaining.report(table(spark, root, "documents"))


@query()
def op11_embedding_whitening(spark: SparkSession, root: str) -> DataFrame:
    """Every vector on the first eight whitened axes of all of them, and its exact deviation from their mean."""
    return whitening.whiten(table(spark, root, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query()
def op12_simhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprint of every document, and its component under links of at most three differing bits."""
    return simhash.classify(table(spark, root, "documents"))


@query()
def op13_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document, and how common the linked ids are."""
    return token_alignment.align(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
