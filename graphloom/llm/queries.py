"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontam, exact_dedup, jaccard, license_scan, lm_score, packing, pii, quality, resample, secret_scan, url_rules, warc
from .common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mask(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackingRules(VOCABULARY))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in for files: source, language and a hundred ids make their directories."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", "source", "lang", (F.floor(F.col("doc_id") / 100)).cast("string"), F.col("doc_id").cast("string"))
    return license_scan.scan(docs.select("doc_id", "text", place.alias("path")), license_scan.LicenceRules(file_share=0.02), keep=("doc_id",))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, conversations = conversation_trie.conversation_steps(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_heads(steps, conversations))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_lm_score, op3_secrets, op4_quality, op5_decontamination, op6_url_rules, op7_pseudonyms, op8_packing, op9_jaccard, op10_licences, op11_conversation_trie, op12_resampling, op13_exact_copies,
    )
}


def _url_sql() -> str:
    names = ", ".join(f"CASE WHEN regexp_matches(low, '{r.pattern}') THEN '{r.name}' END" for r in url_rules.PATTERN_RULES)
    ranked = sorted(url_rules.HOST_RULES, key=lambda r: -len(r[1]) - len(r[2]))
    when = lambda out: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if out == 'rule' else v}'" for v, h, p in ranked)
    upper, lower = url_rules.ASCII_LOWER
    return f"""
WITH rest AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), hosts AS (
  SELECT page_id, low, rest, coalesce(regexp_extract(rest, '^[^/?#]*', 0), '') AS raw FROM rest
), split AS (
  SELECT page_id, low, translate(raw, '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0), '') AS path FROM hosts
), found AS (
  SELECT page_id, host, path, CASE {when('rule')} END AS rule, CASE {when('verdict')} END AS said,
         list_min(list_filter([{names}], lambda x: x IS NOT NULL)) AS pattern_rule FROM split
)
SELECT page_id, host, path, rule, pattern_rule,
       coalesce(said, CASE WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM found
"""


#: CRC-32 of byte lists, by the usual table of 256 remainders; crc(bytes) is a macro-like text.
CRC_TABLE = """
crc_bits AS (SELECT i AS byte, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) r(i) UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY byte) AS tab FROM crc_bits WHERE k = 8)
"""
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_sql(text: str) -> str:
    """CRC-32 of a text that is not empty; tab must be in scope."""
    hexed = f"hex(encode({text}))"
    digits = "0123456789ABCDEF"
    of_bytes = f"list_transform(range(1, length({hexed}), 2), lambda i: CAST((strpos('{digits}', substr({hexed}, i, 1)) - 1) * 16 + strpos('{digits}', substr({hexed}, i + 1, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {of_bytes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op11_conversation_trie": f"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS d, sha256(concat(length(coalesce(role, '')), ':', role, text)) AS key,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n, {_crc_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM t, crc_table GROUP BY c, tab),
info AS (SELECT own.c, own.n, own.h, own.c - own.c % 20 AS leader, least(own.h, coalesce(led.n, 0)) AS m FROM own LEFT JOIN own led ON led.c = own.c - own.c % 20),
re AS (SELECT c, d - h + m AS d, key, words FROM t JOIN info USING (c) WHERE d > h UNION ALL SELECT i.c, t.d, key, words FROM info i JOIN t ON t.c = i.leader AND t.d <= i.h),
len AS (SELECT c, m + greatest(n - h, 0) AS l FROM info),
pre AS (SELECT c, d, words, string_agg(key, '') OVER (PARTITION BY c ORDER BY d) AS path FROM re UNION ALL SELECT c, 0, 0, '' FROM info),
node AS MATERIALIZED (SELECT d AS depth, path, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d) AS ends FROM pre JOIN len USING (c) GROUP BY 1, 2),
kids AS (SELECT p.depth, p.path, count(k.path) AS n_children FROM node p LEFT JOIN node k ON k.depth = p.depth + 1 AND starts_with(k.path, p.path) GROUP BY 1, 2),
under AS (SELECT p.depth, p.path, count(*) FILTER (z.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved_tokens FROM node p JOIN node k ON k.depth >= p.depth AND starts_with(k.path, p.path) JOIN kids z ON z.depth = k.depth AND z.path = k.path GROUP BY 1, 2)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM node a JOIN kids USING (depth, path) JOIN under USING (depth, path) LEFT JOIN node b ON b.depth = a.depth - 1 AND b.path = left(a.path, CAST(64 * (a.depth - 1) AS BIGINT))
""",
    "op12_resampling": f"""
WITH RECURSIVE {CRC_TABLE},
x AS (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS (SELECT side, doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS ws FROM x),
f AS (SELECT side, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS g FROM w),
c AS MATERIALIZED (SELECT side, doc_id, g, count(*) AS n FROM f GROUP BY 1, 2, 3),
k AS MATERIALIZED (SELECT g, {_crc_sql("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM c), crc_table),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM c JOIN k USING (g) GROUP BY 1),
gn AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM b) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM b) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b),
wt AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN k USING (g) JOIN gn USING (bucket) WHERE side = 's' GROUP BY 1),
sc AS (SELECT w.doc_id, len(ws) >= 20 AS big, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || w.doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN wt USING (doc_id) WHERE side = 's'),
rk AS (SELECT *, row_number() OVER (PARTITION BY big ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER (PARTITION BY big) // 100 AS most FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN big AND r <= most THEN r END AS rank FROM rk
""",
    "op13_exact_copies": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents
""",
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM r
""",
    "op6_url_rules": _url_sql(),
    "op9_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS node, doc_id AS there FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.there)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(there) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
""",
}
