"""Queries of the numbered operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import bpe, chat, divergence, merkle, minhash, packing, phrases, pii, quality_fm, spelling, subspace, url_rules, warc
from tallyvane.llm.encoders import read_added

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_pack_sequences")
def op10_pack_sequences(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    added = read_added(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


@query("op1_quality_fm")
def op1_quality_fm(spark: SparkSession, sf: str) -> DataFrame:
    return quality_fm.classify(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query("op6_pii_bootstrap")
def op6_pii_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(load(spark, sf, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS words, string_split(text, chr(10)) AS lines FROM d),
chars AS (
  SELECT rid, lang, length(text) AS n, length(a) AS after_lower, length(b) AS after_space, length(c) AS after_upper, length(e) AS after_digit, length(f) AS after_beyond,
    length(regexp_replace(f, '[.,;:!?''"()-]+', '', 'g')) AS after_stop
  FROM (SELECT *, regexp_replace(e, '[^\x00-\x7F]+', '', 'g') AS f FROM (SELECT *, regexp_replace(c, '[0-9]+', '', 'g') AS e FROM (SELECT *, regexp_replace(b, '[A-Z]+', '', 'g') AS c
    FROM (SELECT *, regexp_replace(a, '[ \t-\r]+', '', 'g') AS b FROM (SELECT *, regexp_replace(text, '[a-z]+', '', 'g') AS a FROM d)))))
),
classes AS (
  SELECT rid, lang, n, unnest([0, 1, 2, 3, 4, 5, 6]) AS k,
    unnest([n - after_lower, after_lower - after_space, after_space - after_upper, after_upper - after_digit, after_digit - after_beyond, after_beyond - after_stop, after_stop]) AS c
  FROM chars
),
tokens AS (SELECT rid, lang, unnest(words) AS word FROM w),
totals AS (SELECT lang, count(*) AS n FROM tokens GROUP BY lang),
big AS (SELECT lang, n FROM totals WHERE n >= 0.01 * (SELECT sum(n) FROM totals) UNION ALL SELECT '*', sum(n) FROM totals),
counts AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY ALL UNION ALL SELECT '*', word, count(*) FROM tokens GROUP BY word),
common AS (SELECT c.lang, word, c.n / b.n AS q FROM counts c JOIN big b USING (lang) WHERE c.n >= 0.005 * b.n AND length(word) <= 64),
ref AS (SELECT rid, CASE WHEN lang IN (SELECT lang FROM big) THEN lang ELSE '*' END AS lang, len(words) AS n FROM w),
shapes AS (
  SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q
  FROM (SELECT lang, k, c FROM classes UNION ALL SELECT '*', k, c FROM classes) GROUP BY lang, k
),
class_terms AS (SELECT rid, c / greatest(classes.n, 1) AS p, q FROM classes JOIN ref USING (rid) JOIN shapes ON shapes.lang = ref.lang AND shapes.k = classes.k),
hits AS (SELECT t.rid, t.word, count(*) AS c FROM tokens t JOIN ref USING (rid) JOIN common c ON c.lang = ref.lang AND c.word = t.word GROUP BY ALL),
word_terms AS (
  SELECT r.rid, coalesce(c, 0) / greatest(r.n, 1) AS p, q FROM ref r JOIN common USING (lang) LEFT JOIN hits h ON h.rid = r.rid AND h.word = common.word
  UNION ALL
  SELECT r.rid, 1 - coalesce((SELECT sum(c) FROM hits h WHERE h.rid = r.rid), 0) / greatest(r.n, 1), 1 - coalesce((SELECT sum(q) FROM common c WHERE c.lang = r.lang), 0) FROM ref r
),
class_far AS (
  SELECT rid, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far FROM class_terms GROUP BY rid
),
word_far AS (
  SELECT rid, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far FROM word_terms GROUP BY rid
),
win AS (SELECT rid, i, words[i : i + 4] AS key FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, key) > 1),
covered AS (SELECT rid, sum(g) AS n FROM (SELECT rid, least(5, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 5)) AS g FROM again) GROUP BY rid),
base AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(lines, lambda x: regexp_matches(x, '[^ \t-\r]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^ \t-\r]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, length(text) AS size
  FROM w LEFT JOIN covered c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (size < 200 OR class_far.far <= 0.25) AND (n_words < 40 OR word_far.far <= 0.35) AS kept
FROM base LEFT JOIN class_far USING (rid) LEFT JOIN word_far USING (rid)
"""


@query("op2_divergence", OP2_SQL)
def op2_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.judge(load(spark, sf, "documents")).drop("class_distance", "word_distance")


@query("op8_super_minhash")
def op8_super_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf, "documents"))


@query("op9_phrase_automata")
def op9_phrase_automata(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.repeated_passages(load(spark, sf, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


OP4_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(verdict, rule_host, rule_path)),
targets AS (
  SELECT url AS u, unnest(
    list_transform(regexp_extract_all(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical["'']?[^>]*>'), lambda t: regexp_extract(t, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) ||
    list_transform(regexp_extract_all(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*>'), lambda t: regexp_extract(t, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1))) AS t
  FROM pages WHERE contains(url, '://')
),
absolute AS (
  SELECT split_part(u, '#', 1) AS a, split_part(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN split_part(u, '://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(u, '^([^:]*://[^/?#]*)', 1) || t
    WHEN regexp_matches(u, '^[^:]*://[^/?#]*[^?#]*/') THEN regexp_extract(u, '^([^:]*://[^/?#]*[^?#]*/)', 1) || t ELSE regexp_extract(u, '^([^:]*://[^/?#]*)', 1) || '/' || t END, '#', 1) AS b
  FROM targets WHERE t <> ''
),
links AS (SELECT a, b FROM absolute WHERE a <> b UNION SELECT b, a FROM absolute WHERE a <> b),
reach AS (SELECT a AS x, a AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
ends AS (SELECT DISTINCT y AS node, CASE WHEN contains(y, '://') THEN substr(y, instr(y, '://') + 3) ELSE '' END AS rest FROM reach),
end_parts AS (
  SELECT node, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM ends
),
end_rule AS (
  SELECT node, verdict FROM end_parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rule_host || rule_path) DESC) = 1
),
carried AS (SELECT x AS node, min(verdict) AS verdict FROM reach JOIN end_rule ON end_rule.node = reach.y GROUP BY x),
numbered AS (SELECT row_number() OVER () AS rid, * FROM parts),
fits AS (
  SELECT rid, rule_host || rule_path AS rule, verdict FROM numbered JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule_host || rule_path) DESC) = 1
)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, c.verdict, 'allow') AS verdict
FROM numbered n LEFT JOIN fits f USING (rid) LEFT JOIN carried c ON contains(n.url, '://') AND c.node = split_part(n.url, '#', 1)
"""


@query("op4_redirect_equivalence", OP4_SQL)
def op4_redirect_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge(load(spark, sf, "pages"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
pairs AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS x, b AS y FROM pairs UNION SELECT reach.x, p.b FROM reach JOIN pairs p ON p.a = reach.y),
low AS (SELECT x, min(vec_id) AS m FROM reach JOIN v ON v.rid = reach.y GROUP BY x),
deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, coalesce(least(m, vec_id), vec_id) = vec_id AS kept
FROM v LEFT JOIN low ON low.x = v.rid LEFT JOIN deg ON deg.a = v.rid
"""


@query("op5_subspace_join", OP5_SQL)
def op5_subspace_join(spark: SparkSession, sf: str) -> DataFrame:
    return subspace.near_duplicates(load(spark, sf, "embeddings"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.digest = p.digest AND strlen(html) >= 100
"""


@query("op3_warc_capture_index", OP3_SQL)
def op3_warc_capture_index(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(load(spark, sf, "pages"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"
OP11_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, len(regexp_extract_all(text, '[^ \t-\r]{1,4}')) + 4 AS tokens, md5(text) AS digest,
    23 + length(replace(replace(replace(replace(replace(replace(replace(replace(role || text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) AS chars
  FROM raw
),
line AS (
  SELECT *, row_number() OVER o AS pos, sum(tokens) OVER o - tokens AS a
  FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest ROWS UNBOUNDED PRECEDING)
),
lead AS (SELECT conv_id, pos AS lead_pos, tokens AS lead_tokens, chars AS lead_chars FROM line WHERE role = 'system' QUALIFY pos = min(pos) OVER (PARTITION BY conv_id)),
roomy AS (
  SELECT l.*, lead_pos, lead_chars, greatest(greatest(2048 - 256 - coalesce(lead_tokens, 0), 512) // 2, 1) AS half
  FROM line l LEFT JOIN lead ON l.conv_id IS NOT DISTINCT FROM lead.conv_id
),
cells AS (SELECT *, 2 * (a // half) + (tokens > half)::INT AS cell FROM roomy),
spans AS (SELECT conv_id, cell, min(a) AS at, max(a + tokens) AS till, sum(chars) AS own, min(pos) AS first_pos, min(lead_pos) AS lead_pos, min(lead_chars) AS lead_chars FROM cells GROUP BY ALL),
tails AS (
  SELECT s.conv_id, s.till AS at, sum(chars) AS more, min(pos) AS first_pos
  FROM spans s JOIN cells c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.cell = c.cell WHERE s.till - c.a <= 256 GROUP BY s.conv_id, s.cell, s.till
),
sizes AS (
  SELECT s.conv_id, sum(own + coalesce(more, 0) + CASE WHEN lead_pos < coalesce(t.first_pos, s.first_pos) THEN lead_chars ELSE 0 END) AS n
  FROM spans s LEFT JOIN tails t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.at = t.at GROUP BY s.conv_id
),
told AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss
  FROM line GROUP BY conv_id
)
SELECT told.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars
FROM told JOIN sizes ON told.conv_id IS NOT DISTINCT FROM sizes.conv_id
"""


@query("op11_budgeted_windows", OP11_SQL)
def op11_budgeted_windows(spark: SparkSession, sf: str) -> DataFrame:
    said = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digest(chat.windows(said.unionByName(control)))


#: CRC-32 of the text of an integer, by the polynomial's table.
CRC_TABLE_SQL = "SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(b))"
OP12_SQL = r"""
WITH RECURSIVE crcs AS (CRC_TABLE),
f AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS code
  FROM documents, crcs
),
leaves AS (
  SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN code % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS used
  FROM f
),
level AS (
  SELECT source, 0 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, k + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM level WHERE n > 1 GROUP BY source, k, i // 3, n
),
subroots AS (SELECT source, node AS subroot, k AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM level WHERE n = 1),
upper_level AS (
  SELECT 0 AS k, place AS i, subroot AS node, n FROM subroots
  UNION ALL
  SELECT k + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (n + 2) // 3 FROM upper_level WHERE n > 1 GROUP BY k, i // 3, n
),
start AS (
  SELECT rid, doc_id, l.source, leaf, used, row_number() OVER (PARTITION BY l.source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, s.subroot, s.place, s.height
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
),
hung AS (
  SELECT source, k, i, string_agg(node, '' ORDER BY i) OVER (PARTITION BY source, k, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft,
    string_agg(node, '' ORDER BY i) OVER (PARTITION BY source, k, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt FROM level WHERE n > 1
),
upper_hung AS (
  SELECT k, i, string_agg(node, '' ORDER BY i) OVER (PARTITION BY k, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft,
    string_agg(node, '' ORDER BY i) OVER (PARTITION BY k, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rgt FROM upper_level WHERE n > 1
),
climb AS (
  SELECT rid, source, i, place, height, 0 AS k, used AS node, '' AS proof FROM start
  UNION ALL
  SELECT c.rid, c.source, CASE WHEN c.k < c.height THEN c.i // 3 ELSE c.i END, CASE WHEN c.k < c.height THEN c.place ELSE c.place // 3 END, c.height, c.k + 1,
    sha256(coalesce(h.lft, u.lft, '') || c.node || coalesce(h.rgt, u.rgt, '')), c.proof || coalesce(h.lft, u.lft, '') || coalesce(h.rgt, u.rgt, '')
  FROM climb c
  LEFT JOIN hung h ON c.k < c.height AND h.source IS NOT DISTINCT FROM c.source AND h.k = c.k AND h.i = c.i
  LEFT JOIN upper_hung u ON c.k >= c.height AND u.k = c.k - c.height AND u.i = c.place
  WHERE c.k < c.height + (SELECT max(k) FROM upper_level)
),
top AS (SELECT node AS root FROM upper_level WHERE n = 1)
SELECT s.doc_id, s.leaf, s.subroot, top.root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = top.root AS verified
FROM start s JOIN climb c ON c.rid = s.rid AND c.k = s.height + (SELECT max(k) FROM upper_level) CROSS JOIN top
""".replace("CRC_TABLE", CRC_TABLE_SQL)


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verify(merkle.manifest(load(spark, sf, "documents")))


OP13_SQL = r"""
WITH RECURSIVE crcs AS (CRC_TABLE),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, sum(n) AS n FROM runs GROUP BY ALL),
coded AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))),
    lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS h
  FROM lowered, crcs
),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM coded),
v AS (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM gaps g JOIN v ON v.word = g.rest
  UNION SELECT v.word, g.word, g.n FROM gaps g JOIN v ON v.word = g.rest
),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
named AS (SELECT p.word, b.n_near, b.top, min(p.near) AS near FROM pairs p JOIN best b ON b.word = p.word AND p.near_n = b.top GROUP BY ALL),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * v.n THEN near END AS form, CASE WHEN top >= 2 * v.n THEN top END::BIGINT AS form_n FROM v LEFT JOIN named USING (word)),
way AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN forms f ON f.word = w.form)
SELECT f.word, f.n, n_near, f.form, form_n, w.root FROM forms f JOIN way w ON w.word = f.word AND w.form IS NULL
""".replace("CRC_TABLE", CRC_TABLE_SQL)


@query("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(load(spark, sf, "documents"))
