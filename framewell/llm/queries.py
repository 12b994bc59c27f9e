"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import (
    bpe,
    codes,
    embeddings,
    exact,
    lines,
    mixing,
    negatives,
    quality,
    simhash,
    token_files,
    unigram,
    url_filters,
    warc,
)
from framewell.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from framewell.llm.tables import table, with_groups

#: The rules that the URL query judges by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

URL_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT host, path, max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path,
    verdict := rule_verdict)) AS b
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""


@query(URL_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
starts AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n FROM starts GROUP BY doc_id),
stats AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats),
measured AS (
  SELECT lang, source, unnest([
    {'m': 'symbols', 'v': 1000 * n_symbols // n_words},
    {'m': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1)},
    {'m': 'repeats', 'v': 1000 * n_repeat_words // n_words},
    {'m': 'word_length', 'v': 100 * word_chars // n_words}]) AS p
  FROM judged WHERE NOT base_failed),
bins AS (
  SELECT lang, source, p.m AS m, p.v - p.v % (1::BIGINT << greatest(length(bin(p.v)) - 6, 0)::BIGINT) AS bin
  FROM measured),
levels AS (
  SELECT 0 AS level, lang, source, m, bin, count(*) AS n FROM bins GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, m, bin, count(*) FROM bins GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, m, bin, count(*) FROM bins GROUP BY ALL),
ranked AS (
  SELECT *, bin + (1::BIGINT << greatest(length(bin(bin)) - 6, 0)::BIGINT) - 1 AS top,
    sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY bin) AS below,
    sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM levels),
quant AS (
  SELECT level, lang, source, m, max(total)::BIGINT AS n, min(bin) FILTER (4 * below >= total) AS q250,
    min(bin) FILTER (2 * below >= total) AS q500, min(top) FILTER (4 * below >= 3 * total) AS q750,
    min(top) FILTER (1000 * below >= 998 * total) AS q998
  FROM ranked GROUP BY level, lang, source, m),
by_lang AS (
  SELECT b.lang, b.m, (b.n * b.q250 + 100 * c.q250) // (b.n + 100) AS q250,
    (b.n * b.q500 + 100 * c.q500) // (b.n + 100) AS q500, (b.n * b.q750 + 100 * c.q750) // (b.n + 100) AS q750,
    (b.n * b.q998 + 100 * c.q998) // (b.n + 100) AS q998
  FROM quant b JOIN quant c ON b.m = c.m AND b.level = 1 AND c.level = 2),
blended AS (
  SELECT a.lang, a.source, a.m, (a.n * a.q250 + 100 * b.q250) // (a.n + 100) AS q250,
    (a.n * a.q500 + 100 * b.q500) // (a.n + 100) AS q500, (a.n * a.q750 + 100 * b.q750) // (a.n + 100) AS q750,
    (a.n * a.q998 + 100 * b.q998) // (a.n + 100) AS q998
  FROM quant a JOIN by_lang b ON a.m = b.m AND a.lang IS NOT DISTINCT FROM b.lang AND a.level = 0),
fences AS (
  SELECT lang, source,
    max(q750 + 6 * (q750 - q500) + 200) FILTER (m = 'symbols') AS hi_symbols,
    max(q998) FILTER (m = 'dup_lines') AS hi_dup_lines,
    max(q998) FILTER (m = 'repeats') AS hi_repeats,
    max(q750 + 6 * (q750 - q500)) FILTER (m = 'word_length') AS hi_word_length,
    max(q250 - 6 * (q500 - q250)) FILTER (m = 'word_length') AS lo_word_length
  FROM blended GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE coalesce(1000 * n_symbols // n_words <= hi_symbols
    AND 1000 * n_dup_lines // greatest(n_lines, 1) <= hi_dup_lines
    AND 1000 * n_repeat_words // n_words <= hi_repeats
    AND 100 * word_chars // n_words <= hi_word_length
    AND 100 * word_chars // n_words >= lo_word_length, true) END AS kept
FROM judged LEFT JOIN fences ON judged.lang IS NOT DISTINCT FROM fences.lang
  AND judged.source IS NOT DISTINCT FROM fences.source
"""


@query(QUALITY_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge_quality(documents).select("doc_id", *quality.STATISTICS, "base_failed", "kept")


@query()
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.tokenize_to_files(documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query()
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query(WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, line, whole, regexp_extract_all(part, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, whole, unnest(range(len(p))) AS line, unnest(p) AS part
    FROM (SELECT doc_id, md5(text) AS whole, string_split(text, chr(10)) AS p FROM documents))),
m AS (
  SELECT doc_id, line, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM l WHERE len(w) >= 3),
named AS (SELECT *, len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, array_to_string(t, ' ') AS same FROM m),
own AS (SELECT leaf FROM named GROUP BY leaf HAVING count(*) >= 10),
rare AS (
  SELECT doc_id, line, t, same, unnest([1, 2, 3]) AS way, len(t) || unnest([
    ' <*> ' || t[2] || ' ' || t[3], ' ' || t[1] || ' <*> ' || t[3], ' ' || t[1] || ' ' || t[2] || ' <*>']) AS leaf
  FROM named WHERE leaf NOT IN (FROM own)),
nodes AS (
  FROM own UNION SELECT leaf FROM (SELECT DISTINCT doc_id, line, leaf FROM rare) GROUP BY leaf HAVING count(*) >= 10),
k AS (
  SELECT doc_id, line, t, leaf, same FROM named WHERE leaf IN (FROM own)
  UNION ALL SELECT doc_id, line, any_value(t), min_by(leaf, way), any_value(same)
  FROM rare WHERE leaf IN (FROM nodes) GROUP BY doc_id, line),
seen AS (SELECT leaf, same, count(DISTINCT doc_id) AS docs, any_value(t) AS t FROM k GROUP BY leaf, same),
placed AS (SELECT leaf, same, docs, unnest(range(len(t))) AS place, unnest(t) AS token FROM seen),
fixed AS (
  SELECT leaf, place, token FROM placed WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(docs) >= 10),
forms AS (
  SELECT p.leaf, p.same, count(f.token) AS n_fixed, count(*) AS n,
    string_agg(coalesce(f.token, '<*>'), ' ' ORDER BY p.place) AS template
  FROM placed p LEFT JOIN fixed f ON p.leaf = f.leaf AND p.place = f.place AND p.token = f.token
  GROUP BY p.leaf, p.same),
templated AS (
  SELECT doc_id, line, k.leaf, template FROM k JOIN forms f ON k.leaf = f.leaf AND k.same = f.same
  WHERE 100 * n_fixed >= 60 * n),
recurring AS (
  SELECT leaf, template, min(struct_pack(d := doc_id, l := line)) AS first
  FROM templated GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
exact AS (
  SELECT array_to_string(w, ' ') AS line_text, min(struct_pack(d := doc_id, l := line)) AS first
  FROM l WHERE len(w) > 0 GROUP BY 1
  HAVING count(DISTINCT doc_id) >= 10 OR (any_value(len(w)) >= 50 AND count(DISTINCT whole) >= 2)),
dropped AS (
  SELECT doc_id, line FROM templated t JOIN recurring r ON t.leaf = r.leaf AND t.template = r.template
  WHERE struct_pack(d := doc_id, l := line) > first
  UNION SELECT doc_id, line FROM l JOIN exact ON array_to_string(w, ' ') = line_text
  WHERE struct_pack(d := doc_id, l := line) > first),
kept AS (
  SELECT l.doc_id, string_agg(l.part, chr(10) ORDER BY l.line) FILTER (d.line IS NULL) AS text,
    count(*) AS n_lines, count(d.line) AS n_dropped
  FROM (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS part
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) l
  LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query(LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_template_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.token_counts(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mixture_rates(documents, table(spark, sf_dir, "labels"))


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)
"""


@query(EXACT_SQL)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(table(spark, sf_dir, "documents"), text_sha256=F.sha2("norm", 256))


def _codes_sql() -> str:
    """Six rounds and the last assignment, each a step over all distances."""
    steps = [
        """
v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT n, part, e[part * (len(e) // 8) + 1 : (part + 1) * (len(e) // 8)] AS x FROM v, range(8) AS t(part)),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x AS c FROM parts WHERE n <= 16)"""
    ]
    for r in range(7):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT n, part, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT n, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts JOIN book{r} USING (part))
  GROUP BY n, part)""")
        if r < 6:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.c, b.c) AS c
  FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY pos) AS c
    FROM (SELECT part, best.entry AS entry, pos, sum(x[pos])::BIGINT AS s, count(*) AS k
      FROM near{r} JOIN parts USING (n, part), range(1, len(x) + 1) AS t(pos) GROUP BY ALL)
    GROUP BY part, entry) m USING (part, entry))""")
    steps.append("""
coded AS (
  SELECT n, string_agg(lpad(hex(best.entry), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near6 GROUP BY n)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256
FROM v JOIN coded USING (n)
"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    # one key for each label and one for null; sums of a label are taken before they meet its rows
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return with_groups(keyed, sums, "key", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other))::INTEGER AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


@query(NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, anchor=vec_id % 50 == 0)
