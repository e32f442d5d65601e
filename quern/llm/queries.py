"""The opN_ queries over whole tables, each through its operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.byte_bpe import decode_documents, encode_documents
from quern.llm.common import shared_dir, table
from quern.llm.conversation_repair import damaged, repair_report
from quern.llm.conversation_sql import OP11_SQL
from quern.llm.decontamination import contaminated
from quern.llm.interval_join import overlap_join
from quern.llm.interval_sql import OP12_SQL
from quern.llm.license_scan import license_scan
from quern.llm.packing import pack_documents
from quern.llm.secret_scan import secret_scan
from quern.llm.simhash_dedup import simhash_groups
from quern.llm.simhash_sql import OP8_SQL
from quern.llm.substring_dedup import substring_dedup
from quern.llm.topk_search import top_k
from quern.llm.toxicity import fit, toxicity_scores
from quern.llm.url_filter import url_filter
from quern.llm.warc import read_warc, write_warc

#: Verdict, host, path prefix.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m.kind == "phrase")
    text_of = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m.label))), ",")
    starts = F.transform(base, lambda m: m.start)
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        text_of(base).alias("base_labels"),
        text_of(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.containment)), F.lit(0.0)).alias("score"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(text_of(F.filter("spans", lambda s: s.kind != "novel")), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op12_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clicks")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


OP9_SQL = """
WITH rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM b
), d AS (
  SELECT page_id, host, path,
         (SELECT arg_max(struct_pack(rule := r_host || r_path, verdict := verdict), length(r_host) * 1000 + length(r_path)) FROM rules
          WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS hit
  FROM c
)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM d
"""

OP1_SQL = r"""
WITH b AS (
  SELECT row_number() OVER () AS item, item_id, words, len(words) AS n, least(5, len(words)) AS width FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)) WHERE len(words) > 0
), s AS (
  SELECT item, width, shingle, count(*) AS weight
  FROM (SELECT item, width, unnest(list_transform(range(1, n - width + 2), lambda i: array_to_string(words[i:i + width - 1], ' '))) AS shingle FROM b) GROUP BY ALL
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), p AS (
  SELECT rid, width, i, array_to_string(words[i:i + width - 1], ' ') AS shingle
  FROM (SELECT rid, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM d JOIN (SELECT DISTINCT width FROM b) ON len(words) >= width)
), h AS (
  SELECT rid, item, i, shingle, weight FROM p JOIN s USING (width, shingle)
), z AS (
  SELECT DISTINCT rid, item, least(n, len(d.words)) AS size, width, n FROM h JOIN b USING (item) JOIN d USING (rid)
), k AS (
  SELECT DISTINCT rid, item, unnest(range(greatest(1, i - size + width), least(i, len(words) - size + 1) + 1)) AS start FROM h JOIN z USING (rid, item) JOIN d USING (rid)
), o AS (
  SELECT rid, item, start, size, width, n, shingle, least(count(*), any_value(weight)) AS shared
  FROM k JOIN z USING (rid, item) JOIN h USING (rid, item) WHERE h.i BETWEEN start AND start + size - width GROUP BY ALL
), m AS (
  SELECT rid, item, start, size, CAST(sum(shared) AS DOUBLE) / (size - width + 1 + n - width + 1 - sum(shared)) AS similarity FROM o GROUP BY rid, item, start, size, width, n
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid, item ORDER BY similarity DESC, start) AS place FROM m WHERE similarity >= 0.8
)
SELECT doc_id, item_id, start - 1 AS start_word, size AS n_words, similarity FROM r JOIN d USING (rid) JOIN b USING (item) WHERE place = 1
"""

OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT rid, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)
), f AS (
  SELECT h, min(doc_id) AS least FROM w GROUP BY h
), c AS (
  SELECT DISTINCT rid, unnest(range(i, i + 50)) AS pos FROM w JOIN f USING (h) WHERE doc_id > least OR doc_id IS NULL AND least IS NOT NULL
), g AS (
  SELECT rid, count(*) AS n FROM c GROUP BY rid
), k AS (
  SELECT d.rid, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d JOIN g USING (rid)) d
  LEFT JOIN c ON c.rid = d.rid AND c.pos = d.i WHERE c.pos IS NULL GROUP BY d.rid
)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN k USING (rid)
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h || '00', 1 + (5 * i) // 4, 3) AS BIGINT) >> (7 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM m
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_warc": op2_warc,
    "op3_topk_search": op3_topk_search,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_interval_join": op12_interval_join,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_topk_search": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_simhash_dedup": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_interval_join": OP12_SQL,
}
