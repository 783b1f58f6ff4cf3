"""The queries of this subpackage for ``__spark_entry__``: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.codes import codebooks_sha256, compress
from gaugeflow.llm.decontaminate import leaked_items
from gaugeflow.llm.divergence import source_divergence
from gaugeflow.llm.lm import score_documents
from gaugeflow.llm.near_dedup import near_duplicates
from gaugeflow.llm.packing import pack, token_pieces
from gaugeflow.llm.quality import quality_rules
from gaugeflow.llm.sharding import shuffle_into_shards
from gaugeflow.llm.substrings import remove_repeats
from gaugeflow.llm.tokens import encoded_lengths, length_histogram, public_vocabulary
from gaugeflow.llm.urls import filter_captures, host_of
from gaugeflow.llm.vectors import similar_vectors
from gaugeflow.llm.warc import field, read_archive, record_ids, write_archive
from gaugeflow.session import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


#: Sets of shingles as texts, pairs by a join on them, components by closure.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (m + n - c)),
b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.b FROM r JOIN b ON b.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, component_id = s.doc_id AS kept FROM s JOIN c ON c.x = s.doc_id
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(_read(spark, sf_dir, "documents"), public_vocabulary()))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_read(spark, sf_dir, "documents"), single_spaces=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Windows by their hashes; a word goes if a window that starts at most 49 words before it also starts in an earlier document.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM v),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
g AS (SELECT doc_id, i FROM h JOIN m USING (h) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
c AS (SELECT t.doc_id, k, word, count(g.i) OVER (PARTITION BY t.doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.k),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    write_archive(_read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        record_ids(field("WARC-Record-ID")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"), record_ids(field("WARC-Refers-To")).alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    light = _read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_into_shards(light, shards=8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_read(spark, sf_dir, "documents"), public_vocabulary())
    packed = pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have neither fetch times nor lists, so both follow from rules: a page is fetched at a minute
    of 90 days set by its id; lists add and remove the hosts that occur, and example domains, at days set by md5."""
    pages = _read(spark, sf_dir, "pages")
    day = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {})"
    captures = pages.select("page_id", "url", F.expr(day.format("pmod(page_id * 7919, 129600)")).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain is not null").distinct().withColumn("h", F.expr("cast(conv(substr(md5(domain), 1, 6), 16, 10) as bigint)"))
    rules = [("ads", "h % 3 = 0", "h % 60", "add"), ("ads", "h % 3 = 0", "h % 60 + 20", "remove"), ("ads", "h % 6 = 0", "h % 60 + 30", "add"), ("spam", "h % 4 = 0", "h % 45", "add"), ("spam", "h % 8 = 0", "h % 45 + 15", "remove")]
    events = [hosts.where(which).select("domain", F.lit(name).alias("list"), F.expr(day.format(f"1440 * ({at})")).alias("at"), F.lit(action).alias("action")) for name, which, at, action in rules]
    wide = spark.sql(f"SELECT 'example.org' domain, 'wide' list, {day.format('1440 * 10')} at, 'add' action UNION ALL SELECT 'example.org', 'wide', {day.format('1440 * 40')}, 'remove'")
    for e in events:
        wide = wide.union(e)
    return filter_captures(captures, wide)


OP10_SQL = """
WITH c AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2), '') AS host,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes((page_id * 7919) % 129600) AS fetched FROM pages),
h AS (SELECT DISTINCT host AS domain, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM c WHERE host IS NOT NULL),
e AS (
  SELECT domain, 'ads' AS list, h % 60 AS d, 'add' AS action FROM h WHERE h % 3 = 0
  UNION ALL SELECT domain, 'ads', h % 60 + 20, 'remove' FROM h WHERE h % 3 = 0
  UNION ALL SELECT domain, 'ads', h % 60 + 30, 'add' FROM h WHERE h % 6 = 0
  UNION ALL SELECT domain, 'spam', h % 45, 'add' FROM h WHERE h % 4 = 0
  UNION ALL SELECT domain, 'spam', h % 45 + 15, 'remove' FROM h WHERE h % 8 = 0
  UNION ALL SELECT 'example.org', 'wide', 10, 'add' UNION ALL SELECT 'example.org', 'wide', 40, 'remove'),
o AS (SELECT domain, list, d, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT domain, list, action, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(1440 * d) AS since,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(1440 * lead(d) OVER (PARTITION BY domain, list ORDER BY d)) AS until FROM o),
m AS (
  SELECT c.page_id, i.domain, i.list, i.since,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.domain) DESC, i.since DESC, i.list DESC) AS k,
    count(*) OVER (PARTITION BY c.page_id) AS n
  FROM c JOIN i ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain)) AND i.action = 'add'
    AND i.since <= c.fetched AND (i.until IS NULL OR c.fetched < i.until))
SELECT c.page_id, c.host, c.fetched, coalesce(m.n, 0) AS n_active, m.domain, m.list, m.since, m.page_id IS NOT NULL AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.k = 1
"""

def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT) // CAST(t.n + 5 * v.v AS HUGEINT) AS p,
    1 + 1000000000 * CAST(k.n + 5 AS HUGEINT) // CAST(v.n + 5 * v.v AS HUGEINT) AS q
  FROM t JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_read(spark, sf_dir, "embeddings"))


#: All pairs; few enough on the small tables.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compress(_read(spark, sf_dir, "embeddings"))
    errors = codes.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)").alias("label_error"))
    joined = codes.join(errors, F.col("label").eqNullSafe(F.col("of")))  # Spark sends the sums to all tasks if they are small
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_decontaminate, op3_token_counts, op4_quality_rules, op5_substring_dedup, op6_warc_archive, op7_sharding, op8_best_fit_packing, op9_lm_scores, op10_url_filters, op11_source_divergence, op12_embedding_near_dedup, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op6_warc_archive": OP6_SQL, "op10_url_filters": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_embedding_near_dedup": OP12_SQL}
