"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, html_text, jaccard, licenses, packing, quality, toxicity, url_examples, urls, warc
from .common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("id")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.join(table(spark, sf_dir, "embeddings"))


EMBEDDINGS_SQL = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), reached AS (
  SELECT vec_id, vec_id AS to_id FROM embeddings
  UNION
  SELECT r.vec_id, l.v FROM reached r JOIN links l ON l.u = r.to_id
), components AS (
  SELECT vec_id, min(to_id) AS component_id FROM reached GROUP BY vec_id
), counts AS (
  SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM components LEFT JOIN counts USING (vec_id)
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "archives").path("warc")
    warc.write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return warc.assemble(warc.read(spark, path)).select(
        warc.capture_key(F.col("record_id"), "bigint").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"),
        warc.capture_key(F.col("refers_to"), "bigint").alias("refers_to"), F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"),
        "target_uri", F.get("requests.target_uri", F.lit(0)).alias("requested"), F.get("metadata.payload", F.lit(0)).cast("string").alias("said"),
    )


WARC_SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS digest,
    coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), 'urn:capture:' || page_id) AS target FROM pages
), firsts AS (
  SELECT digest, max(page_id) AS first FROM payloads WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, 1 AS n_requests, 1 AS n_metadata,
  target AS target_uri, target AS requested, 'payload-bytes: ' || n || chr(13) || chr(10) AS said
FROM payloads LEFT JOIN firsts USING (digest)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


QUALITY_SQL = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS n FROM placed
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, range(5) r(k) WHERE counted.n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, s.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
    100 * n_symbols > 30 * n_words AS symbols, 100 * n_dup_lines > 60 * n_words AS lines FROM measured
), failures AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f
  FROM (SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([short, repeats, symbols, lines]) AS failed FROM judged WHERE source IS NOT NULL)
  GROUP BY source, rule
), moments AS (
  SELECT rule, least(greatest(avg(f / n), 0.001), 0.999) AS mean, var_pop(f / n) AS var, avg(1 / n) AS noise FROM failures GROUP BY rule
), between_hosts AS (
  SELECT *, (var - mean * (1 - mean) * noise) / greatest(1 - noise, 1e-9) AS spread FROM moments
), priors AS (
  SELECT rule, mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2), 1000) ELSE 1000 END AS strength FROM between_hosts
), hosts AS (
  SELECT source, bool_or((f + mean * strength) / (n + strength) > 0.5) AS host_rejected FROM failures JOIN priors USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  coalesce(host_rejected, false) AS host_rejected, NOT (short OR repeats) AND NOT coalesce(host_rejected, false) AS kept
FROM judged LEFT JOIN hosts USING (source)
"""


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE shared / (a.n + b.n - shared) >= 0.8
), reached AS (
  SELECT doc_id, doc_id AS to_id FROM documents
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.to_id
), classes AS (
  SELECT doc_id, min(to_id) AS class_id FROM reached GROUP BY doc_id
), counts AS (
  SELECT u AS doc_id, count(*) AS n FROM links GROUP BY u
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_links, class_id, class_id = doc_id AS kept FROM classes LEFT JOIN counts USING (doc_id)
"""


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [F.struct(F.lit(u).alias("url"), F.lit(label).alias("label")) for label, part in ((1, url_examples.BLOCKED), (0, url_examples.ALLOWED)) for u in part]
    examples = spark.range(1).select(F.inline(F.array(*given)))
    return urls.judge(table(spark, sf_dir, "pages"), url_examples.RULES, examples)


def _values(rows: list[tuple]) -> str:
    literal = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)


def _url_parts(url: str) -> str:
    found = lambda i: f"coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}), '')"
    return f"translate({found(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {found(2)} AS path"


def _url_features(of: str) -> str:
    grams = " UNION ALL ".join(f"SELECT id, substr(t, i, {n}) AS g FROM (SELECT id, t, unnest(range(1, length(t) - {n - 2})) AS i FROM (SELECT id, '^' || host || '$' || path AS t FROM {of}))" for n in urls.SIZES)
    return f"SELECT id, list(DISTINCT ('0x' || md5(g)[1:4])::INT % {urls.BUCKETS}) AS features FROM ({grams}) GROUP BY id"


URLS_SQL = f"""
WITH RECURSIVE examples AS (
  SELECT row_number() OVER () AS id, label, {_url_parts('url')}
  FROM (VALUES {_values([(u, 1.0) for u in url_examples.BLOCKED] + [(u, 0.0) for u in url_examples.ALLOWED])}) v(url, label)
), example_features AS (
  SELECT id, label, coalesce(features, []) AS features FROM examples LEFT JOIN ({_url_features('examples')}) f USING (id)
), kernel AS (
  SELECT a.id, a.label, list(len(list_intersect(a.features, b.features)) + 1.0 ORDER BY b.id) AS k FROM example_features a, example_features b GROUP BY a.id, a.label
), descent AS (
  SELECT 0 AS epoch, list(0.0::DOUBLE ORDER BY id) AS a FROM kernel
  UNION ALL
  SELECT epoch + 1, (SELECT list(a[id] * (1 - {urls.RATE} * {urls.DECAY}) + (label - 1 / (1 + exp(-list_dot_product(k::DOUBLE[], a::DOUBLE[])))) * {urls.RATE} / len(a) ORDER BY id) FROM kernel)
  FROM descent WHERE epoch < {urls.EPOCHS}
), coefficients AS (
  SELECT a FROM descent WHERE epoch = {urls.EPOCHS}
), weights AS (
  SELECT feature, sum(a[id]) AS w FROM (SELECT id, unnest(features) AS feature FROM example_features), coefficients GROUP BY feature
), pages_parts AS (
  SELECT row_number() OVER () AS id, page_id, {_url_parts('url')} FROM pages
), scores AS (
  SELECT id, sum(w) AS s FROM (SELECT id, unnest(features) AS feature FROM ({_url_features('pages_parts')})) JOIN weights USING (feature) GROUP BY id
), fits AS (
  SELECT id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM pages_parts JOIN (VALUES {_values(url_examples.RULES)}) r(h, p, v) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY id
), judged AS (
  SELECT *, 1 / (1 + exp(-(coalesce(s, 0) + (SELECT list_sum(a) FROM coefficients)))) AS score FROM pages_parts LEFT JOIN scores USING (id) LEFT JOIN fits USING (id)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= {urls.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(score, 4) AS score FROM judged
"""


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


PACKING_SQL = f"""
WITH RECURSIVE lengths AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents
), histogram AS (
  SELECT n AS v, count(*) AS c FROM lengths GROUP BY n
), sums AS (
  SELECT row_number() OVER (ORDER BY v) AS j, v, sum(c) OVER (ORDER BY v)::BIGINT AS count, sum(c * v) OVER (ORDER BY v)::BIGINT AS total FROM histogram
), best AS (
  SELECT 1 AS k, j, v * count - total AS cost, [v] AS ends FROM sums
  UNION ALL
  SELECT any_value(b.k) + 1, s.j, min(b.cost + s.v * (s.count - p.count) - (s.total - p.total)),
    arg_min(list_append(b.ends, s.v), (b.cost + s.v * (s.count - p.count) - (s.total - p.total), b.j))
  FROM best b JOIN sums p ON p.j = b.j JOIN sums s ON s.j > b.j WHERE b.k < {packing.BUCKETS} GROUP BY s.j
), chosen AS (
  SELECT ends FROM best WHERE j = (SELECT max(j) FROM best) ORDER BY k DESC LIMIT 1
), placed AS (
  SELECT doc_id, n, len(list_filter(ends, lambda e: e < n)) AS bucket, ends[len(list_filter(ends, lambda e: e < n)) + 1] AS bucket_length, md5(doc_id::VARCHAR) AS place FROM lengths, chosen
), ranked AS (
  SELECT *, greatest(1, {packing.BUDGET} // greatest(1, bucket_length)) AS room, row_number() OVER (PARTITION BY bucket ORDER BY place, doc_id, n) - 1 AS rank FROM placed
), firsts AS (
  SELECT bucket, coalesce(sum(batches) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT bucket, ceil(count(*) / any_value(room)) AS batches FROM ranked GROUP BY bucket)
)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, bucket_length, (first + rank // room)::BIGINT AS batch, rank % room AS slot FROM ranked JOIN firsts USING (bucket)
"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _license_sizes() -> str:
    scanner = licenses.Scanner(licenses.TEMPLATES)
    sizes = {n: len([w for w in map(licenses.normal, t.encode().split()) if w]) - licenses.WORDS + 1 for n, t in licenses.TEMPLATES.items()}
    return _values([(n, licenses.TEMPLATES[n], *licenses.window_of(sizes[n])) for n in scanner.names])


LICENSES_SQL = f"""
WITH given AS (
  SELECT * FROM (VALUES {_license_sizes()}) v(license, text, win, stride)
), texts AS (
  SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 't', license, text FROM given
), words AS (
  SELECT kind, id, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'),
    lambda w: regexp_replace(regexp_replace(w, '^[^0-9a-z]+', ''), '[^0-9a-z]+$', '')), lambda w: w <> '') AS words FROM texts
), grams AS (
  SELECT kind, id, i - 1 AS place, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - 3)) AS i FROM words WHERE len(words) >= 5)
), wanted AS (
  SELECT DISTINCT id AS license, gram FROM grams WHERE kind = 't'
), hits AS (
  SELECT g.id, w.license, g.place, g.gram, win, stride FROM grams g JOIN wanted w USING (gram) JOIN given USING (license) WHERE g.kind = 'd'
), windows AS (
  SELECT id, license, gram, (place // stride - k) * stride AS start FROM (SELECT *, unnest(range(0, (win + stride - 1) // stride)) AS k FROM hits)
  WHERE place // stride - k >= 0 AND (place // stride - k) * stride + win > place
), matched AS (
  SELECT DISTINCT id, license FROM (SELECT id, license, start, count(DISTINCT gram) AS n FROM windows GROUP BY ALL) JOIN (SELECT license, count(*) AS size FROM wanted GROUP BY license) USING (license)
  WHERE n / size >= 0.8
), listed AS (
  SELECT id::BIGINT AS doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS licenses FROM matched GROUP BY id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN listed USING (doc_id)
"""


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_jaccard": op6_jaccard,
    "op7_urls": op7_urls,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embeddings": EMBEDDINGS_SQL,
    "op2_warc": WARC_SQL,
    "op3_quality": QUALITY_SQL,
    "op6_jaccard": JACCARD_SQL,
    "op7_urls": URLS_SQL,
    "op9_packing": PACKING_SQL,
    "op10_licenses": LICENSES_SQL,
}
