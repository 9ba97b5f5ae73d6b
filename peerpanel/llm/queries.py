"""Registered queries of this package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (hard_negatives, host_text, latent_leaks, line_dedup, packing, preferences, prefix_trie, quality_rules, simhash, token_counts, toxicity,
               url_rules, warc_zip)
from .common import table

#: Fixed values of the queries' contracts.
SHINGLE_WORDS, MAX_BITS = 3, 2
PACK_TOKENIZER = "byte_bpe_50k.json"
COUNT_MODEL = "piece_bpe_32k.model"
URL_RULES = [
    url_rules.host_rule("block", "net", "/"),
    url_rules.host_rule("allow", "example.net", "/en/"),
    url_rules.host_rule("block", "example.com", "/de/"),
    url_rules.host_rule("allow", "org", "/fr/"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return latent_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two preference pairs for every k.  2k: conversations 2k (chosen) and 2k + 1 (rejected); 2k + 1: conversation 2k as it
    is (chosen), and with its last turn replaced by the last turn of conversation 2k + 1 (rejected)."""
    turns = table(spark, sf_dir, "conversations")
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("end")).withColumnRenamed("conv_id", "of")
    conv, last = F.col("conv_id"), F.col("turn").eqNullSafe(F.col("end"))
    even = conv.bitwiseAND(F.lit(1)) == 0
    side = lambda offset, chosen: F.struct(F.lit(offset).alias("offset"), F.lit(chosen).alias("chosen"))
    sides = (F.when(even & last, F.array(side(0, True), side(1, True))).when(even, F.array(side(0, True), side(1, True), side(1, False)))
             .when(last, F.array(side(0, False), side(1, False))).otherwise(F.array(side(0, False))))
    rows = turns.join(ends, conv == F.col("of")).select(*turns.columns, F.inline(sides))
    out = preferences.format_preferences(rows, conv - conv.bitwiseAND(F.lit(1)) + F.col("offset"), F.col("chosen"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("pair").alias("pair_id"), "prefix_turns", "prompt", "chosen", "rejected",
                      text("chosen_spans").alias("chosen_mask"), text("rejected_spans").alias("rejected_mask"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, at most 2 bits apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, SHINGLE_WORDS, MAX_BITS).select("doc_id", "fingerprint", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), PACK_TOKENIZER)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), COUNT_MODEL)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(docs, model).select("doc_id", "severity", "grade", "toxic")


def op6_host_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return host_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written into ZIP packages and read back."""
    read = warc_zip.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, by exact integer scores."""
    rows = table(spark, sf_dir, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.where(finite).select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, "vec_id", "label", "vector", n_positives=5, n_negatives=10, low=30, high=90)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations: a few turns of each twentieth one, then a conversation's own."""
    own = prefix_trie.paths_of(table(spark, sf_dir, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = own.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("path", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    none = F.array().cast(f"array<{prefix_trie.TURN}>")
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("path", h + 1, F.size("path")))
    return prefix_trie.trie(own.join(heads, base == F.col("base"), "left").select("conv_id", rebuilt.alias("path")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that go since ten documents or more hold them."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_latent_leaks, op2_preferences, op3_simhash, op4_toxicity, op5_packing, op6_host_text, op7_url_rules, op8_warc_zip,
                                   op9_token_counts, op10_quality_rules, op11_hard_negatives, op12_prefix_trie, op13_line_dedup)}

_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {warc_zip.MIN_REVISIT} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {warc_zip.MIN_REVISIT}
"""

_URL_SQL = """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""


def _quality_sql() -> str:
    q = quality_rules
    tests = ", ".join(f"('{m}', {c})" for m in q.METRICS for c in q.CUTOFFS)
    p = q.RISK / len(q.METRICS)
    over = " OR ".join(f"coalesce({m} > (SELECT c.cutoff FROM chosen c WHERE c.stratum = f.stratum AND c.metric = '{m}'), false)" for m in q.METRICS)
    value = " ".join(f"WHEN '{m}' THEN {m}" for m in q.METRICS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT *, CASE WHEN len(ws) < {q.WINDOW} THEN [] ELSE list_transform(range(1, len(ws) - {q.WINDOW} + 2), lambda i: array_to_string(ws[i:i + {q.WINDOW} - 1], ' ')) END AS gs FROM w),
e AS (SELECT doc_id, unnest(gs) AS gram, generate_subscripts(gs, 1) AS i FROM g),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM e) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range({q.WINDOW}) r(k) GROUP BY doc_id),
b AS (SELECT g.doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '{q.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
             (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS caps,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM g LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
             CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_share,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
             CASE WHEN word_chars > 0 THEN caps / word_chars ELSE 0.0 END AS caps_share FROM b),
tests(metric, cutoff) AS (VALUES {tests}),
lab AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (SELECT stratum, metric, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND CASE metric {value} END > cutoff) AS k,
             count(*) FILTER (NOT good) AS bad, count(*) FILTER (NOT good AND CASE metric {value} END > cutoff) AS caught
      FROM f JOIN lab USING (doc_id), tests GROUP BY ALL),
pv AS (SELECT *, CASE WHEN k >= n * {p!r} THEN 1.0 ELSE
         list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln({1 - p!r})))) END AS p FROM c),
chosen AS (SELECT stratum, metric, max_by(cutoff, (caught / bad - k / n, cutoff)) AS cutoff FROM pv
           WHERE p <= {q.DELTA!r} / (SELECT count(*) FROM c) AND caught > 0 GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM f
"""


_B, _E = preferences.BEGIN, preferences.END.replace("\n", "")
_PREFERENCE_SQL = f"""
WITH l AS (SELECT *, turn IS NOT DISTINCT FROM max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, conv_id - (conv_id & 1) AS pair_id, conv_id & 1 AS side FROM l
      UNION ALL SELECT *, conv_id + 1, 0 FROM l WHERE conv_id & 1 = 0
      UNION ALL SELECT *, conv_id - (conv_id & 1) + 1, 1 FROM l WHERE (conv_id & 1 = 1) = last),
t AS (SELECT DISTINCT pair_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k,
             '{_B}' || role || chr(10) || text || '{_E}' || chr(10) AS r FROM t),
p AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k))::INT AS prefix_turns
      FROM (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, coalesce(a.r = b.r AND a.role = b.role, false) AS same
            FROM (FROM o WHERE side = 0) a FULL JOIN (FROM o WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k) GROUP BY pair_id),
c AS (SELECT o.*, prefix_turns, sum(length(r)) OVER (PARTITION BY pair_id, side, k > prefix_turns ORDER BY k) AS e FROM o JOIN p USING (pair_id)),
m AS (SELECT *, (e - length(text) - {len(preferences.END)})::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR AS span FROM c)
SELECT pair_id, prefix_turns,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (side = 0 AND k <= prefix_turns), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (side = 0 AND k > prefix_turns), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (side = 1 AND k > prefix_turns), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 0 AND k > prefix_turns AND role = '{preferences.TRAINED_ROLE}'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 1 AND k > prefix_turns AND role = '{preferences.TRAINED_ROLE}'), '') AS rejected_mask
FROM m GROUP BY pair_id, prefix_turns
"""

_NEGATIVE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""

_LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT *, list_transform(ls, lambda x: translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM d),
e AS (SELECT r, doc_id, unnest(ls) AS l, unnest(ks) AS key, generate_subscripts(ls, 1) AS i FROM k),
f AS (SELECT key FROM e WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN f ON e.key = f.key GROUP BY r
"""

_TRIE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS m,
                  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 4 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, k, m FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND k <= h
      UNION ALL SELECT c.conv_id, 1, k, m FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
p AS (SELECT c.conv_id, coalesce(string_agg(m, '' ORDER BY part, k), '') AS path FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
w AS (SELECT DISTINCT m, w FROM t),
x AS (SELECT conv_id, path, unnest(range(0, length(path) // 32 + 1)) AS depth FROM p),
n AS (SELECT path[1:32 * depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length(path) = 32 * depth), '')) AS ends_sha256 FROM x GROUP BY ALL),
kids AS (SELECT node[1:32 * (depth - 1)] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * w.w, 0) AS own FROM n LEFT JOIN kids USING (node) LEFT JOIN w ON w.m = right(node, 32) AND depth > 0),
u AS (SELECT node[1:32 * d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u USING (node) LEFT JOIN n up ON v.depth > 0 AND up.node = v.node[1:32 * (v.depth - 1)]
"""

ORACLE = {"op11_hard_negatives": _NEGATIVE_SQL, "op12_prefix_trie": _TRIE_SQL, "op13_line_dedup": _LINE_SQL, "op2_preferences": _PREFERENCE_SQL, "op8_warc_zip": _WARC_SQL, "op7_url_rules": _URL_SQL, "op10_quality_rules": _quality_sql()}
