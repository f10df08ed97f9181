"""Entropy, format and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.operators import formats, profile, selection

from .common import contents, hex_blocks, query, table, values

BLOCK = 1024
SAMPLE = 3072
_BYTES = "(SELECT doc_id, ('0x' || b)::INT AS byte, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY ALL)"
_E = f"""(SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, byte, n::DOUBLE AS n FROM {_BYTES})) GROUP BY doc_id)"""
_ALL = f"(SELECT d.doc_id, octet_length(encode(d.text)) AS n_bytes, abs(coalesce(e.entropy, 0.0)) AS entropy FROM documents d LEFT JOIN {_E} e USING (doc_id))"
_RATIO = "CASE WHEN entropy >= 8 THEN 1.0::DOUBLE WHEN entropy <= 0 THEN 100.0::DOUBLE ELSE round(8.0::DOUBLE / greatest(entropy, 0.1::DOUBLE), 2) END"
_LABEL = "CASE WHEN entropy < 2 THEN 'Excellent' WHEN entropy < 4 THEN 'Good' WHEN entropy < 6 THEN 'Moderate' WHEN entropy < 7.5 THEN 'Limited' ELSE 'Poor' END"
_BLOCK_E = f"""(SELECT doc_id, pos AS block_index, abs(round(-sum(n / t * log2(n / t)), 6)) AS entropy FROM
    (SELECT doc_id, pos, b, count(*)::DOUBLE AS n, (sum(count(*)) OVER (PARTITION BY doc_id, pos))::DOUBLE AS t
     FROM (SELECT doc_id, pos, unnest(regexp_extract_all(h, '..')) AS b FROM {hex_blocks(BLOCK)}) GROUP BY doc_id, pos, b) GROUP BY doc_id, pos)"""


@query(f"SELECT * FROM {_BYTES}")
def doc_byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.byte_histogram(contents(spark, sf_dir), "doc_id")


@query(f"SELECT *, {_RATIO} AS est_ratio, {_LABEL} AS label, entropy > 7.9 AS is_random, entropy < 4 AS is_highly_compressible FROM {_ALL}")
def doc_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entropy_report(contents(spark, sf_dir), "doc_id")


@query("SELECT doc_id, length(text) AS char_count, length(text) - length(replace(text, chr(10), '')) AS line_count FROM documents")
def doc_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.char_count(F.col("text")).alias("char_count"), C.line_count(F.col("text")).alias("line_count"))


@query(f"SELECT * FROM {_BLOCK_E}")
def doc_entropy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.block_entropies(contents(spark, sf_dir), BLOCK, "doc_id")


@query(f"SELECT d.doc_id, count(entropy) AS n_blocks, min(entropy) AS min_e, max(entropy) AS max_e, round(sum(entropy ORDER BY block_index) / count(entropy) + 1e-9, 6) AS mean_e FROM documents d LEFT JOIN {_BLOCK_E} b USING (doc_id) GROUP BY d.doc_id")
def doc_block_entropy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.block_entropy_stats(contents(spark, sf_dir), BLOCK, "doc_id")


@query(f"SELECT doc_id, {_RATIO} AS est_ratio FROM {_ALL}")
def doc_ratio_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entropy_report(contents(spark, sf_dir), "doc_id").select("doc_id", "est_ratio")


@query(f"SELECT {_LABEL} AS label, count(*) AS docs, repeat('█', round_even(max(entropy) / 8 * 20, 0)::INT) || repeat('░', 20 - round_even(max(entropy) / 8 * 20, 0)::INT) AS bar FROM {_ALL} GROUP BY 1")
def doc_compressibility_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = profile.entropy_report(contents(spark, sf_dir), "doc_id")
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.max("entropy").alias("e")).select("label", "docs", C.entropy_bar(F.col("e")).alias("bar"))


@query("SELECT doc_id, least(length(h) // 2, 2048) AS sample_bytes, sha256(unhex(substr(h, 1, 4096))) AS sample_hash FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)")
def doc_prefix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = contents(spark, sf_dir).select("doc_id", C.prefix_sample(F.col("content"), 2048).alias("s"))
    return s.select("doc_id", C.size_of(F.col("s")).alias("sample_bytes"), F.sha2("s", 256).alias("sample_hash"))


@query(
    f"""SELECT doc_id, length(s) // 2 AS sample_bytes, sha256(unhex(s)) AS sample_hash FROM
    (SELECT doc_id, CASE WHEN n <= {SAMPLE} THEN h ELSE substr(h, 1, {2 * (SAMPLE // 3)}) || substr(h, 2 * (n // 2) + 1, {2 * (SAMPLE // 3)}) || substr(h, 2 * (n - {SAMPLE // 3}) + 1, {2 * (SAMPLE // 3)}) END AS s
     FROM (SELECT doc_id, hex(encode(text)) AS h, length(hex(encode(text))) // 2 AS n FROM documents))"""
)
def doc_three_point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = contents(spark, sf_dir).select("doc_id", C.three_point_sample(F.col("content"), SAMPLE).alias("s"))
    return s.select("doc_id", C.size_of(F.col("s")).alias("sample_bytes"), F.sha2("s", 256).alias("sample_hash"))


def _cases() -> list[tuple[int, str, str, str, str | None]]:
    """(case_id, path, header in hex, the type it has, member names) for every signature and every extension."""
    rows = [("f.bin", "00" * at + magic + "00" * 40, kind if kind != "WEBP" else "RIFF", None) for kind, at, magic, *_ in formats.SIGNATURES]
    rows += [("a.webp", "52494646" + "00000000" + "57454250" + "00" * 8, "WEBP", None), ("d.pdf", "255044462D312E370A", "PDF", None)]
    rows += [("x.dwg", "414331303135" + "00" * 9, "DWG", None), ("x.bin", "414331303234" + "00" * 9, "DWG", None), ("t.pdf", "2550", "UNKNOWN", None)]
    rows += [(f"dir.x/F{ext.upper()}", "68656C6C6F", kind, None) for ext, (kind, _, _) in formats.EXTENSIONS.items()]
    rows += [("noext", "68656C6C6F", "UNKNOWN", None), (".txt", "68656C6C6F", "UNKNOWN", None), ("e.txt", "", "TXT", None), ("v1.2/readme", "20", "UNKNOWN", None)]
    rows += [("o.docx", "504B030414", "DOCX", "[Content_Types].xml|word/document.xml"), ("o.xlsx", "504B030414", "XLSX", "xl/workbook.xml"), ("o.pptx", "504B030414", "PPTX", "a.xml|ppt/presentation.xml"), ("o.zip", "504B030414", "ZIP", "a.txt")]
    return [(i, *r) for i, r in enumerate(rows)]


CASES = _cases()
_CASES = values(CASES, "case_id, path, header, expected, members")


def _case_rows(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(CASES, "case_id int, path string, header string, expected string, members string")
    return raw.select("case_id", "path", F.unhex("header").alias("header"), "expected", F.split("members", r"\|").alias("members"))


_SIGS = values([(i, *s) for i, s in enumerate(formats.SIGNATURES)], "ord, kind, start_at, magic, mime, category, version")
_MAGIC = f"""(SELECT case_id, arg_min(CASE WHEN kind = 'WEBP' AND substr(header, 17, 8) <> '57454250' THEN 'RIFF' ELSE kind END, ord) AS type,
    arg_min(CASE WHEN kind = 'WEBP' AND substr(header, 17, 8) <> '57454250' THEN 'audio/x-wav' ELSE mime END, ord) AS mime_type,
    arg_min(CASE WHEN kind = 'WEBP' AND substr(header, 17, 8) <> '57454250' THEN 'audio' ELSE category END, ord) AS category,
    first(CASE WHEN kind = 'PDF' THEN decode(unhex(substr(header, 11, 6))) ELSE version END ORDER BY ord) AS version
    FROM {_CASES} c JOIN {_SIGS} s ON substr(header, 2 * start_at + 1, length(magic)) = magic GROUP BY case_id)"""
_EXT = values([(k, *v) for k, v in formats.EXTENSIONS.items()], "ext, type, mime_type, category")
_BY_EXT = f"""(SELECT case_id, coalesce(e.type, 'UNKNOWN') AS type, coalesce(e.mime_type, 'application/octet-stream') AS mime_type, coalesce(e.category, 'unknown') AS category, CASE WHEN e.type IS NULL THEN 0.0 ELSE 0.6 END AS confidence
    FROM {_CASES} c LEFT JOIN {_EXT} e ON e.ext = lower(regexp_extract(c.path, '(?:^|[^/.])(\\.[^./]*)$', 1)))"""
_OFFICE = values([(m, i, k, f"application/vnd.openxmlformats-officedocument.{x}") for i, (m, (k, x)) in enumerate(formats.OFFICE.items())], "member, ord, type, mime_type")
_DETECTED = f"""(SELECT c.case_id, c.path, c.expected,
    CASE WHEN m.type = 'ZIP_OFFICE' AND c.members IS NOT NULL THEN coalesce(o.type, 'ZIP') WHEN m.type IS NOT NULL THEN m.type WHEN substr(header, 1, 12) IN ('414331303135', '414331303234') THEN 'DWG' ELSE x.type END AS type,
    CASE WHEN m.type = 'ZIP_OFFICE' AND c.members IS NOT NULL THEN coalesce(o.mime_type, 'application/zip') WHEN m.type IS NOT NULL THEN m.mime_type WHEN substr(header, 1, 12) IN ('414331303135', '414331303234') THEN 'image/vnd.dwg' ELSE x.mime_type END AS mime_type,
    CASE WHEN m.type = 'ZIP_OFFICE' AND c.members IS NOT NULL THEN CASE WHEN o.type IS NULL THEN 'archive' ELSE 'document' END WHEN m.type IS NOT NULL THEN m.category WHEN substr(header, 1, 12) IN ('414331303135', '414331303234') THEN 'cad' ELSE x.category END AS category,
    CASE WHEN m.type = 'ZIP_OFFICE' AND c.members IS NOT NULL THEN NULL WHEN m.type IS NOT NULL THEN m.version WHEN substr(header, 1, 12) IN ('414331303135', '414331303234') THEN decode(unhex(substr(header, 1, 12))) END AS version,
    (CASE WHEN m.type = 'ZIP_OFFICE' AND c.members IS NOT NULL THEN CASE WHEN o.type IS NULL THEN 0.9 ELSE 0.99 END WHEN m.type IS NOT NULL THEN 0.95 WHEN substr(header, 1, 12) IN ('414331303135', '414331303234') THEN 0.98 ELSE x.confidence END)::DOUBLE AS confidence
    FROM {_CASES} c LEFT JOIN {_MAGIC} m USING (case_id) JOIN {_BY_EXT} x USING (case_id)
    LEFT JOIN (SELECT case_id, arg_min(f.type, f.ord) AS type, arg_min(f.mime_type, f.ord) AS mime_type FROM {_CASES} k JOIN {_OFFICE} f ON list_contains(string_split(k.members, '|'), f.member) GROUP BY case_id) o USING (case_id))"""


@query(f"SELECT c.case_id, m.type, m.mime_type, m.category, m.version FROM {_CASES} c LEFT JOIN {_MAGIC} m USING (case_id)")
def format_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_rows(spark).select("case_id", formats.by_magic(F.col("header")).alias("f")).select("case_id", "f.type", "f.mime_type", "f.category", "f.version")


@query(f"SELECT case_id, type, mime_type, category, confidence::DOUBLE AS confidence FROM {_BY_EXT}")
def format_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_rows(spark).select("case_id", formats.by_extension(F.col("path")).alias("f")).select("case_id", "f.type", "f.mime_type", "f.category", "f.confidence")


@query(f"SELECT case_id, type, mime_type, category, version, confidence, type = expected AS as_expected FROM {_DETECTED}")
def format_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formats.detect(_case_rows(spark), members="members")
    return found.select("case_id", "type", "mime_type", "category", "version", "confidence", (F.col("type") == F.col("expected")).alias("as_expected"))


@query(f"SELECT category, count(*) AS files, count(DISTINCT type) AS types, category = 'image' AS is_image, category = 'document' AS is_document, category = 'cad' AS is_cad, category = 'medical' AS is_medical FROM {_DETECTED} GROUP BY category")
def format_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formats.detect(_case_rows(spark), members="members").groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("type").alias("types"))
    return found.withColumns({f"is_{c}": F.col("category") == c for c in ("image", "document", "cad", "medical")})


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, CASE WHEN lower(left(ltrim(html), 9)) IN ('<!doctype', '<html') OR lower(left(ltrim(html), 5)) = '<html' THEN 'HTML' ELSE 'TEXT' END AS type, octet_length(encode(html)) AS n_bytes FROM pages")
def page_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lower(F.substring(F.ltrim("html"), 1, 9))
    html = (start == "<!doctype") | start.startswith("<html")
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.when(html, "HTML").otherwise("TEXT").alias("type"), C.size_of(C.utf8(F.col("html"))).alias("n_bytes"))


#: Reports that make every rule fire, and one row for each document.
_RULE_ROWS = [
    (-1, "PNG", "image/png", "image", 1 << 20, 3.0, 2.67, "gradient", 0.9, "gradient", 0.9),
    (-2, "PNG", "image/png", "image", 40_000_000, 3.0, 2.67, "gradient", 0.71, "gradient", 0.8),
    (-3, "PNG", "image/png", "image", 9000, 7.9, 1.01, "screenshot", 0.61, "screenshot", 0.88),
    (-4, "PNG", "image/png", "image", 9000, 7.9, 1.01, "logo", 0.5, "vector_render", 0.75),
    (-5, "DWG", "image/vnd.dwg", "cad", 5000, 5.0, 1.6, None, None, None, None),
    (-6, "JSON", "application/json", "data", 50_001, 4.0, 2.0, None, None, None, None),
    (-7, "CSV", "text/csv", "data", 50_000, 4.0, 2.0, None, None, None, None),
    (-8, "PDF", "application/pdf", "document", 70_000, 7.6, 1.05, None, None, None, None),
    (-9, "DICOM", "application/dicom", "medical", 70_000, 6.0, 1.33, None, None, None, None),
    (-10, "DOCX", "application/zip", "document", 70_000, 7.95, 1.01, None, None, None, None),
]
_NAMES = "file_id, format_type, mime_type, category, size, entropy, est_ratio, content_type, content_confidence, generation, generation_confidence"
_REPORTS = f"""(SELECT doc_id AS file_id, 'TXT' AS format_type, 'text/plain' AS mime_type, 'text' AS category, n_bytes AS size, entropy, {_RATIO} AS est_ratio, NULL AS content_type, NULL::DOUBLE AS content_confidence, NULL AS generation, NULL::DOUBLE AS generation_confidence FROM {_ALL}
    UNION ALL SELECT file_id::BIGINT, format_type, mime_type, category, size::BIGINT, entropy::DOUBLE, est_ratio::DOUBLE, content_type, content_confidence::DOUBLE, generation, generation_confidence::DOUBLE FROM {values(_RULE_ROWS, _NAMES)})"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = "file_id long, format_type string, mime_type string, category string, size long, entropy double, est_ratio double, content_type string, content_confidence double, generation string, generation_confidence double"
    made = spark.createDataFrame(_RULE_ROWS, types)
    docs = profile.entropy_report(contents(spark, sf_dir), "doc_id").selectExpr("doc_id AS file_id", "'TXT' AS format_type", "'text/plain' AS mime_type", "'text' AS category", "n_bytes AS size", "entropy", "est_ratio", "CAST(NULL AS STRING) AS content_type", "CAST(NULL AS DOUBLE) AS content_confidence", "CAST(NULL AS STRING) AS generation", "CAST(NULL AS DOUBLE) AS generation_confidence")
    return docs.unionByName(made)


def _duck(expression: str) -> str:
    return expression.replace("0D", "0::DOUBLE")


_CANDIDATES = "(" + " UNION ALL ".join(f"SELECT file_id, '{s}' AS strategy, ({_duck(r)})::DOUBLE AS est_ratio, {p} AS priority FROM {_REPORTS} WHERE {c}" for s, c, r, p in selection.RULES) + ")"
_ADMITTED = f"(SELECT * FROM {_CANDIDATES} WHERE strategy IN ({', '.join(map(repr, selection.REGISTERED))}))"
_RANKED = f"""(SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY priority, est_ratio DESC, strategy))::INT AS rank, strategy, priority, est_ratio
    FROM (SELECT *, row_number() OVER (PARTITION BY file_id, strategy ORDER BY priority, est_ratio DESC) AS r FROM {{}}) WHERE r = 1)"""


@query("SELECT file_id, array_to_string(hints, ',') AS hints, hints[1] AS recommended FROM (SELECT file_id, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in selection.HINTS) + f"], lambda x: x IS NOT NULL) AS hints FROM {_REPORTS})")
def strategy_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.hints(reports(spark, sf_dir)).withColumn("hints", F.array_join("hints", ","))


@query(f"SELECT * FROM {_CANDIDATES}")
def strategy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.candidates(reports(spark, sf_dir))


@query(f"SELECT strategy, count(*) AS files FROM {_ADMITTED} GROUP BY ALL")
def strategy_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.registered(selection.candidates(reports(spark, sf_dir))).groupBy("strategy").agg(F.count(F.lit(1)).alias("files"))


@query(f"SELECT * FROM {_RANKED.format(_ADMITTED)}")
def strategy_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranked(reports(spark, sf_dir))


_NO_FALLBACK = f"(SELECT * FROM {_CANDIDATES} WHERE strategy IN ('semantic_json', 'semantic_pdf') UNION ALL SELECT file_id, 'traditional_zstd', est_ratio, 999 FROM {_REPORTS})"


@query(f"SELECT * FROM {_RANKED.format(_NO_FALLBACK)}")
def strategy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a registered fallback rule every file still gets the fallback, at the end."""
    return selection.ranked(reports(spark, sf_dir), ["semantic_json", "semantic_pdf"])


@query(f"SELECT strategy, needs_mb, count(*) AS candidates FROM (SELECT *, CASE WHEN strategy = 'traditional_lzma' THEN 100 ELSE 10 END AS needs_mb FROM (SELECT file_id, strategy FROM {_REPORTS}, (SELECT unnest(['traditional_zstd', 'traditional_lzma']) AS strategy))) WHERE needs_mb <= 50 GROUP BY ALL")
def strategy_memory_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = reports(spark, sf_dir).select("file_id", F.explode(F.array(F.lit("traditional_zstd"), F.lit("traditional_lzma"))).alias("strategy"))
    return selection.within_memory(both, 50).groupBy("strategy", "needs_mb").agg(F.count(F.lit(1)).alias("candidates"))


_ATTEMPTS = "(SELECT l_orderkey AS file_id, l_linenumber AS ord, 's' || l_linenumber AS strategy, floor(l_extendedprice)::BIGINT AS original_size, floor(l_quantity * l_suppkey)::BIGINT AS compressed_size, l_returnflag <> 'A' AS lossless, CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'failed' END AS error FROM lineitem)"


@query(
    f"""WITH g AS (SELECT *, CASE WHEN compressed_size > 0 THEN original_size / compressed_size::DOUBLE ELSE 0 END AS ratio FROM {_ATTEMPTS} WHERE error IS NULL AND lossless),
    c AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ratio < 50, CASE WHEN ratio >= 50 THEN ord END, ratio DESC, ord) AS r FROM g)
    SELECT file_id, strategy, round(ratio, 6) AS ratio FROM c WHERE r = 1"""
)
def strategy_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file_id", "l_linenumber AS ord", "'s' || l_linenumber AS strategy", "floor(l_extendedprice) AS original_size", "floor(l_quantity * l_suppkey) AS compressed_size", "l_returnflag <> 'A' AS lossless", "CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'failed' END AS error")
    return selection.best_attempt(tries)
