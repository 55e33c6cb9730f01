"""Registered queries of this package and their SQL: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pageloom.llm import decontaminate, language, nbsvm, orchard, packing, quality, secrets, shards, simhash, urlfilter, variants, warc, wavelet

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold():
    """0 to 2, from the identifier; rows of fold 1 are held out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where((fold() != 1) & F.col("lang").isNotNull()))
    found = language.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_quality_rules(spark, sf_dir):
    found = quality.judge_documents(table(spark, sf_dir, "documents"), with_text=False)
    return found.withColumnRenamed("lost", "lost_share")


def op4_sharding(spark, sf_dir):
    found = shards.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    nothing = F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), nothing)


def op5_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark, sf_dir):
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rule"] < len(secrets.BASE_RULES))
    count = lambda i: F.size(F.filter("found", lambda x: x["rule"] == i)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base, secrets.RULES), 256).alias("base_sha256"), secrets.joined(F.col("found"), secrets.RULES).alias("spans"),
    )


def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_warc(spark, sf_dir):
    found = warc.records(warc.archive(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_output(spark, sf_dir):
    files = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))
    return wavelet.read_shards(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark, sf_dir):
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_centroid_clustering(spark, sf_dir):
    return orchard.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels").where(fold() != 1))
    held_out = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return nbsvm.rate(docs, model).select("doc_id", held_out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_url_filter, op3_quality_rules, op4_sharding, op5_decontamination, op6_secret_scan, op7_simhash,
        op8_warc, op9_token_output, op10_packing, op11_centroid_clustering, op12_spelling_variants, op13_quality_classifier,
    )
}

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

_ROUND = """
a{0} AS MATERIALIZED (
  SELECT rid, min(d * 8 + c) AS best FROM (
    SELECT rid, c, sum((x - y) * (x - y)) AS d FROM long JOIN c{0} USING (pos) GROUP BY rid, c) GROUP BY rid),
c{1} AS MATERIALIZED (
  SELECT c, pos, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{0} LEFT JOIN (
    SELECT CAST(best % 8 AS INTEGER) AS c, pos, sum(x) AS s, count(*) AS n FROM long JOIN a{0} USING (rid) GROUP BY ALL) USING (c, pos)),"""



def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(number: int, rule: secrets.Rule) -> str:
    """Spans of one rule: matches and the gaps before them, added up."""
    return f"""
  SELECT rid, {number} AS rule, '{rule.kind}' AS kind, span.stop - length(span.found) AS start, span.stop AS stop FROM (
    SELECT rid, unnest(list_transform(range(1, len(found) + 1), lambda i: {{
      'stop': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(found[1:i], lambda m: length(m))),
      'found': found[i], 'checked': checked[i]}})) AS span
    FROM (SELECT rid, string_split_regex(body, {_sql(rule.pattern)}) AS gaps, regexp_extract_all(body, {_sql(rule.pattern)}, 0) AS found,
                 regexp_extract_all(body, {_sql(rule.pattern)}, {rule.group}) AS checked FROM rows))
  WHERE length(span.checked) >= {rule.least}"""


_SHINGLE = "list_distinct(list_transform(range(1, greatest(len(w) - n, 0) + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')))"

ORACLES = {
    "op5_decontamination": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
items AS MATERIALIZED (
  SELECT item_id, len({_SHINGLE}) AS q, n, {_SHINGLE} AS s FROM (
    SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark) WHERE len(w) > 0)),
piece AS MATERIALIZED (SELECT DISTINCT item_id, q, n, unnest(s) AS s FROM items),
held AS (
  SELECT DISTINCT rid, n, s FROM (
    SELECT rid, n, unnest({_SHINGLE}) AS s FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
  WHERE s IN (SELECT s FROM piece))
SELECT doc_id, item_id, q AS n_shingles, n_shared, n_shared / q AS containment FROM (
  SELECT rid, item_id, q, count(*) AS n_shared FROM held JOIN piece USING (n, s) GROUP BY rid, item_id, q) JOIN d USING (rid)
WHERE n_shared >= ceil(0.8 * q - 1e-9)""",
    "op6_secret_scan": f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES))}),
of_row AS (
  SELECT rid, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (WHERE rule < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(of_row.spans, '') AS spans FROM rows LEFT JOIN of_row USING (rid)""",
    "op11_centroid_clustering": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
long AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(64)) AS pos FROM kept),
c0 AS MATERIALIZED (
  SELECT CAST(number - 1 AS INTEGER) AS c, unnest(v) AS y, unnest(range(64)) AS pos FROM (
    SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) AS number FROM kept) WHERE number <= 8),
{"".join(_ROUND.format(i, i + 1) for i in range(10))}
last AS (
  SELECT rid, CAST(min(d * 8 + c) % 8 AS INTEGER) AS cluster, CAST(min(d * 8 + c) // 8 AS BIGINT) AS distance FROM (
    SELECT rid, c, sum((x - y) * (x - y)) AS d FROM long JOIN c10 USING (pos) GROUP BY rid, c) GROUP BY rid),
named AS (SELECT c AS cluster, sha256(string_agg(CAST(y AS BIGINT)::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c10 GROUP BY c)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM last JOIN kept USING (rid) JOIN named USING (cluster)""",
    "op2_url_filter": f"""
WITH rules(rule_host, rule_path, action) AS (VALUES {_RULE_VALUES}),
parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN best USING (page_id)""",
    "op8_warc": """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
typed AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM typed""",
}
