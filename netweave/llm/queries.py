"""The text queries with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import arc_warc, change_applier, decontaminate, html_labeller, line_dedup, permutation_index, quality, simhash, source_mix, token_counts, token_files, url_filter, whitening
from netweave.session import shared_path, table

URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(documents, "doc_id", "text", benchmark, "item_id", "text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_sections(table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "fingerprint", "component_id")


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC archives, these as WARC files, and what is read back."""
    pages = table(spark, sf_dir, "pages")
    records = arc_warc.arc_to_warc(arc_warc.pages_to_arc(pages, "page_id", "url", "html"))
    path = shared_path(spark, "warc")
    arc_warc.write_warc(arc_warc.mark_revisits(records), path)
    found = arc_warc.read_warc(spark, path, payloads=False).filter("record_type IN ('response', 'revisit')")
    return found.select(F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, "page_id", "url", URL_RULES)


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=100, k=10)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return source_mix.mix(documents, "doc_id", "text", "source").drop("text_key")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op11_ordered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of clients in 8 batches of 20 days each, by the day they arrive."""
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    day = F.datediff(F.col("valid_at").cast("date"), F.lit("1970-01-01").cast("date")) + 2 * (h % 4)
    batch = 1 + F.floor((day - 19723) * 8 / 160)
    names = change_applier.Names("change_id", "client_id", "seq", "op", ("city", "balance"))
    found = change_applier.apply_changes(table(spark, sf_dir, "client_changes"), names, day, batch, F.col("valid_at").isNotNull() & (h % 11 != 0), batches=8, patience=5)
    cents = F.when(F.abs("v1") < 9e16, F.floor(100 * F.col("v1") + 0.5)).cast("long")
    return found.select(F.col("id").alias("change_id"), F.col("client").alias("client_id"), "status", "batch", "missed", F.col("v0").alias("city"), cents.alias("cents"), "current")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), "doc_id", "text", folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read(spark, folder)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_quality": op2_quality, "op3_token_counts": op3_token_counts, "op4_simhash": op4_simhash, "op5_arc_to_warc": op5_arc_to_warc, "op6_line_dedup": op6_line_dedup, "op7_url_filters": op7_url_filters, "op8_permutation_index": op8_permutation_index, "op9_source_mix": op9_source_mix, "op10_html_text": op10_html_text, "op11_ordered_changes": op11_ordered_changes, "op12_token_files": op12_token_files, "op13_whitening": op13_whitening}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op7_url_filters"] = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
rules(rhost, rpath, action) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, host, path,
    max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, action := action)) AS won
  FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path),
globs(nr, fits, pattern) AS (VALUES """ + ", ".join(
    "({}, '{}', '{}')".format(i, g, "^" + g.replace(".", "\\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", "(.|\\n)*") + "$") for i, g in enumerate(url_filter.BLOCK_GLOBS)
) + """),
flagged AS (
  SELECT page_id, arg_min(fits, nr) AS matched_glob FROM split JOIN globs ON regexp_matches(host || path, pattern) GROUP BY page_id)
SELECT best.page_id, host, path, won.rule AS rule, coalesce(won.action, CASE WHEN matched_glob IS NULL THEN 'allow' ELSE 'block' END) AS verdict, matched_glob
FROM best LEFT JOIN flagged USING (page_id)
"""

ORACLE_SQL["op5_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
