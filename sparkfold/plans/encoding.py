"""Columnar encoding, codec, container and benchmark queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.operators import codecs, columnar, grid

from .common import contents, query, table, values

#: Rows of events as JSON, the same text in both engines: one key is rare, one null at times.
_JSON = """'{"id": ' || event_id || ', "type": "' || event_type || '", "ratio": ' || (event_id % 7) || '.5, "even": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || CASE WHEN event_id % 8 = 0 THEN '' ELSE ', "user": ' || user_id END || CASE WHEN event_id % 3 = 0 THEN ', "note": null' ELSE ', "note": "n' || (event_id % 5) || '"' END || '}'"""
_ROWS = f"(SELECT event_id AS pos, {_JSON} AS json FROM events)"
_KEYS = f"(SELECT pos, k, json_type(json, '$.' || k) AS t FROM (SELECT pos, json, unnest(json_keys(json)) AS k FROM {_ROWS}))"
_SCHEMA = f"""(SELECT k AS key, count(*) AS n_present,
    CASE WHEN i >= f AND i >= s AND i >= b THEN 'int' WHEN f >= s AND f >= b THEN 'float' WHEN s >= b THEN 'str' ELSE 'bool' END AS dominant_type, count(*) >= 0.9 * (SELECT count(*) FROM {_ROWS}) AS kept
    FROM (SELECT k, sum((t IN ('BIGINT', 'UBIGINT'))::INT) OVER w AS i, sum((t = 'DOUBLE')::INT) OVER w AS f, sum((t IN ('VARCHAR', 'OBJECT', 'ARRAY'))::INT) OVER w AS s, sum((t = 'BOOLEAN')::INT) OVER w AS b FROM {_KEYS} WINDOW w AS (PARTITION BY k)) GROUP BY k, i, f, s, b)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.expr(_JSON).alias("json"))


@query(f"SELECT * FROM {_SCHEMA}")
def json_infer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of all rows."""
    return columnar.infer_schema(_rows(spark, sf_dir), sample=None)


@query(f"SELECT count(*) AS all_keys, sum(kept::INT)::BIGINT AS kept_keys, sum(kept::INT) >= 0.9 * count(*) AS is_uniform FROM {_SCHEMA}")
def json_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.uniformity(columnar.infer_schema(_rows(spark, sf_dir), sample=None))


@query(f"SELECT pos, (json->>'$.id')::BIGINT AS id, json->>'$.type' AS type, (json->>'$.ratio')::DOUBLE AS ratio, (json->>'$.even')::BOOLEAN AS even, json->>'$.note' AS note, 0 AS bad_values, CASE WHEN json_exists(json, '$.user') THEN '{{\"user\":' || (json->>'$.user') || '}}' END AS rest FROM {_ROWS}")
def json_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept keys of all rows as typed columns, and every other key in a column of JSON; the schema is the plan's only input from the driver."""
    rows = _rows(spark, sf_dir)
    kept = {r["key"]: r["dominant_type"] for r in columnar.infer_schema(rows, sample=None).where("kept").orderBy("key").collect()}
    return columnar.to_columns(rows, kept, rest="rest")


#: An array of 60 objects of one form for each user, and its text as it must come back.
_TABLES = f"(SELECT user_id, '[' || string_agg('{{\"id\": ' || event_id || ', \"type\": \"' || event_type || '\", \"half\": ' || (event_id // 2) || '.5}}', ', ' ORDER BY event_id) || ']' AS json, count(*) AS n FROM events GROUP BY user_id)"


@query(f"SELECT user_id, octet_length(encode(json)) AS original_size, sha256(encode(json)) AS restored_hash, CASE WHEN octet_length(encode(json)) < 2048 THEN 'too short' WHEN n < 10 THEN 'not a table' END AS refused FROM {_TABLES}")
def json_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a JSON table through the columnar codec; short ones are refused."""
    one = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "half": '), F.expr("event_id div 2").cast("string"), F.lit(".5}"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", one.alias("j")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "j"))).alias("r"))
    text = rows.select("user_id", C.utf8(F.concat(F.lit("["), F.array_join(F.col("r.j"), ", "), F.lit("]"))).alias("content"))
    tries = codecs.attempts(text, ["semantic_json"], "user_id")
    both = text.join(tries.withColumnRenamed("file_id", "user_id"), "user_id")
    why = F.regexp_extract("error", "^Unsuitable: (.*)$", 1)
    return both.select("user_id", "original_size", F.coalesce("restored_hash", F.sha2("content", 256)).alias("restored_hash"), F.when(F.col("error").isNotNull(), why).alias("refused"))


_DELTA = "(SELECT event_id AS pos, user_id AS v, user_id - coalesce(lag(user_id) OVER (ORDER BY event_id), 0) AS d FROM events)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.int_delta(table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("v")), "v", "pos")


@query(f"SELECT * FROM {_DELTA}")
def int_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


@query("SELECT event_id AS pos, user_id AS v FROM events")
def int_undelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.with_running_sum(_deltas(spark, sf_dir).drop("v"), "d", "pos", "v").drop("d")


@query(f"SELECT pos, d, xor(d * 2, d >> 63) AS z, d AS back FROM {_DELTA}")
def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _deltas(spark, sf_dir).select("pos", "d", columnar.zigzag(F.col("d")).alias("z"))
    return d.withColumn("back", columnar.unzigzag(F.col("z")))


_EDGES = [(i, v) for i, v in enumerate([0, 1, -1, 63, -63, 64, -64, -65, 127, 8191, -8192, 8192, 2**31, -(2**31), 2**31 - 1, 2**48, -(2**55), 2**56, 2**61, -(2**61), 2**62, -(2**62), 2**62 - 1, -(2**62) - 1, 2**63 - 1, -(2**63) + 1])]
_Z = f"(SELECT pos, v::BIGINT AS v, CASE WHEN v >= 0 THEN v::HUGEINT * 2 ELSE -(v::HUGEINT) * 2 - 1 END AS z FROM {values(_EDGES, 'pos, v')})"
_LEN = "(CASE " + " ".join(f"WHEN z < {1 << 7 * n} THEN {n}" for n in range(1, 10)) + " ELSE 10 END)"


@query(f"SELECT pos, v, {_LEN} AS n_bytes FROM {_Z}")
def varint_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_EDGES, "pos int, v long").select("pos", "v", columnar.varint_length(columnar.zigzag(F.col("v"))).alias("n_bytes"))


@query(f"SELECT pos, v, array_to_string(list_transform(range(0, {_LEN}), lambda k: printf('%02X', ((z // (128::HUGEINT ** k)::HUGEINT) % 128 + CASE WHEN k < {_LEN} - 1 THEN 128 ELSE 0 END)::INT)), '') AS varint, v AS decoded FROM {_Z}")
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spark.createDataFrame(_EDGES, "pos int, v long").select("pos", "v", columnar.varint_hex(columnar.zigzag(F.col("v"))).alias("varint"))
    return z.withColumn("decoded", F.try_element_at(columnar.varint_decode(F.unhex("varint")), F.lit(1)))


_DICT = "(SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1)"


@query(f"SELECT event_id, d.value, code FROM events JOIN {_DICT} d ON d.value IS NOT DISTINCT FROM event_type")
def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.dict_encode(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT count(*) AS n, count(*) AS equal, count(DISTINCT event_type) AS codes FROM events")
def dict_decode_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    codes = columnar.dict_encode(events, "event_type", "event_id").select("event_id", "code")
    back = codes.join(columnar.dictionary(events, "event_type", "event_id"), "code").join(events.select("event_id", "event_type"), "event_id")
    return back.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") == F.col("event_type"), 1)).alias("equal"), F.countDistinct("code").alias("codes"))


@query('SELECT event_id // 8 AS "group", sum((event_type = \'click\')::INT << (event_id % 8)::INT)::INT AS bits FROM events GROUP BY 1')
def bool_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.bit_pack(table(spark, sf_dir, "events"), F.col("event_type") == "click", "event_id")


@query('SELECT event_id // 8 AS "group", sum((event_id % 3 = 0)::INT << (event_id % 8)::INT)::INT AS bits FROM events GROUP BY 1')
def null_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.get_json_object("json", "$.note")
    return columnar.bit_pack(_rows(spark, sf_dir), note.isNull())


@query(
    f"""SELECT 'user_id' AS name, 'delta varint' AS encoding, sum({_LEN})::BIGINT AS n_bytes FROM (SELECT CASE WHEN d >= 0 THEN d * 2 ELSE -d * 2 - 1 END AS z FROM {_DELTA})
    UNION ALL SELECT 'event_type', 'dictionary', (SELECT sum({_LEN}) FROM (SELECT code AS z FROM events JOIN {_DICT} d ON d.value = event_type))::BIGINT + (SELECT sum(octet_length(encode(value))) FROM {_DICT})::BIGINT
    UNION ALL SELECT 'value', 'float', 8 * count(*) FROM events UNION ALL SELECT 'is_click', 'bits', (count(*) + 7) // 8 FROM events"""
)
def encoded_size_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    size = columnar.varint_length
    ints = _deltas(spark, sf_dir).agg(F.sum(size(columnar.zigzag(F.col("d")))).alias("n"))
    codes = columnar.dict_encode(events, "event_type", "event_id").agg(F.sum(size(F.col("code"))).alias("n"))
    names = events.select("event_type").distinct().agg(F.sum(C.size_of(C.utf8(F.col("event_type")))).alias("m"))
    rows = events.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        ints.select(F.lit("user_id").alias("name"), F.lit("delta varint").alias("encoding"), F.col("n").cast("long").alias("n_bytes")),
        codes.crossJoin(names).select(F.lit("event_type"), F.lit("dictionary"), (F.col("n") + F.col("m")).cast("long")),  # one row each
        rows.select(F.lit("value"), F.lit("float"), F.col("n") * 8),
        rows.select(F.lit("is_click"), F.lit("bits"), F.expr("(n + 7) div 8")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: The bits of a double as 16 hex digits, most significant first.
_BITS = "lpad(hex((value::BIT)::UBIGINT), 16, '0')"


@query(f"SELECT user_id, count(*) AS n, sha256(unhex(string_agg({_BITS}, '' ORDER BY value))) AS packed_hash, max(value) AS greatest FROM events GROUP BY user_id")
def float_pack_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The big-endian form of each user's values, and the greatest of what it gives back."""
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    packed = v.select("user_id", columnar.pack_doubles(F.col("v")).alias("b"))
    return packed.select("user_id", (F.octet_length("b") / 8).cast("long").alias("n"), F.sha2("b", 256).alias("packed_hash"), F.array_max(columnar.unpack_doubles(F.col("b"))).alias("greatest"))


_SAME = "SELECT doc_id, octet_length(encode(text)) AS original_size, sha256(encode(text)) AS restored_hash, true AS lossless FROM documents"


@query(_SAME)
def codec_roundtrip_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.roundtrip(contents(spark, sf_dir), "traditional_zstd", "doc_id")


@query(_SAME)
def codec_roundtrip_lzma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.roundtrip(contents(spark, sf_dir), "traditional_lzma", "doc_id")


@query(_SAME)
def codec_roundtrip_delta_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.roundtrip(contents(spark, sf_dir), "delta_run_length", "doc_id")


_TEXTS = "(SELECT doc_id AS file_id, octet_length(encode(text)) AS file_size, hex(encode(text)) AS h, sha256(encode(text)) AS hash FROM documents)"


def _runs(h: str, name: str) -> str:
    """Of rows (file_id, i, b), the bytes of run lengths."""
    return f"{name} AS MATERIALIZED (SELECT file_id, sum(2 * ((len + 254) // 255))::BIGINT AS n FROM (SELECT file_id, run, count(*) AS len FROM (SELECT file_id, i, sum(fresh) OVER (PARTITION BY file_id ORDER BY i) AS run FROM (SELECT file_id, i, CASE WHEN b = lag(b) OVER (PARTITION BY file_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM {h})) GROUP BY ALL) GROUP BY file_id)"


#: What real codecs whose sizes no library decides make of documents, and one that refuses them.
_STRATEGIES = ("run_length", "delta_run_length", "semantic_json")
_GRID = f"""files AS MATERIALIZED {_TEXTS}, bytes AS MATERIALIZED (SELECT file_id, i, ('0x' || substr(h, i * 2 + 1, 2))::INT AS b FROM files, unnest(range(0, length(h) // 2)) AS u(i)),
    deltas AS (SELECT file_id, i, (b - coalesce(lag(b) OVER (PARTITION BY file_id ORDER BY i), 0) + 256) % 256 AS b FROM bytes), {_runs('bytes', 'plain')}, {_runs('deltas', 'moved')},
    grid AS MATERIALIZED (SELECT *, round(CASE WHEN compressed_size > 0 THEN file_size::DOUBLE / compressed_size ELSE 0 END, 6) AS ratio FROM (
        SELECT f.file_id, file_size, 'run_length' AS strategy, coalesce(n, 0) AS compressed_size, true AS lossless, hash AS restored_hash, NULL AS error FROM files f LEFT JOIN plain USING (file_id)
        UNION ALL SELECT f.file_id, file_size, 'delta_run_length', coalesce(n, 0), true, hash, NULL FROM files f LEFT JOIN moved USING (file_id)
        UNION ALL SELECT file_id, file_size, 'semantic_json', NULL, false, NULL, CASE WHEN file_size < 2048 THEN 'Unsuitable: too short' ELSE 'Unsuitable: not JSON' END FROM files))"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of documents and strategies, each tried and verified."""
    tries = codecs.attempts(contents(spark, sf_dir), _STRATEGIES, "doc_id", excellent=1e9).withColumnRenamed("original_size", "file_size")
    ratio = F.when(F.col("compressed_size") > 0, F.col("file_size").cast("double") / F.col("compressed_size")).when(F.col("error").isNull(), 0.0)
    return tries.withColumn("ratio", F.round(ratio, 6))


@query(f"WITH {_GRID} SELECT file_id, file_size, strategy, coalesce(compressed_size, -1) AS compressed_size, CASE WHEN error IS NULL THEN ratio ELSE 0 END AS ratio, lossless, restored_hash, error FROM grid")
def bench_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every strategy; sizes of failures are -1."""
    r = _records(spark, sf_dir)
    return r.select("file_id", "file_size", "strategy", F.coalesce("compressed_size", F.lit(-1)).alias("compressed_size"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), "lossless", "restored_hash", "error")


@query(f"WITH {_GRID} SELECT file_id, strategy, ratio FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ratio DESC, strategy) AS r FROM grid WHERE error IS NULL) WHERE r = 1")
def bench_best_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.best_per_file(_records(spark, sf_dir)).select("file_id", "strategy", "ratio")


@query(f"WITH {_GRID} SELECT strategy, count(*) AS records, round(avg(ratio), 6) AS avg_ratio, bool_and(lossless) AS all_lossless FROM grid WHERE error IS NULL GROUP BY strategy")
def bench_strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the mean times, which the operator gives too."""
    return grid.strategy_summary(_records(spark, sf_dir)).select("strategy", "records", "avg_ratio", "all_lossless")


@query("SELECT doc_id AS file_id, round(octet_length(encode(text)) / 1048576.0::DOUBLE / ((1 + doc_id % 7) / 1000.0::DOUBLE), 6) AS compression_mbps, round(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE octet_length(encode(text)) / 1048576.0::DOUBLE / ((doc_id % 11) / 1000.0::DOUBLE) END, 6) AS decompression_mbps FROM documents")
def bench_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of given sizes and times; times are numbers of the ids, since measured ones are never the same."""
    files = contents(spark, sf_dir).select(F.col("doc_id").alias("file_id"), C.size_of(F.col("content")).alias("n"))
    return files.select("file_id", F.round(grid.speed(F.col("n"), F.lit(1.0) + F.col("file_id") % 7), 6).alias("compression_mbps"), F.round(grid.speed(F.col("n"), (F.col("file_id") % 11).cast("double")), 6).alias("decompression_mbps"))


@query(f"WITH {_GRID} SELECT file_id, file_size AS original_size, strategy, ratio, hash AS restored_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ratio DESC, strategy DESC) AS r FROM grid WHERE error IS NULL) JOIN files USING (file_id, file_size) WHERE r = 1")
def codec_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt that is kept of each document (the first of equals), and what comes back from its payload."""
    kept = codecs.best_of(contents(spark, sf_dir), _STRATEGIES, "doc_id").where("strategy IS NOT NULL")
    return kept.select("file_id", "original_size", "strategy", "ratio", F.sha2(codecs.restored("packed", "strategy"), 256).alias("restored_hash"))


@query(f"SELECT 'd' || doc_id AS name, 1 AS version, octet_length(encode(text)) AS original_size, octet_length(encode(text)) AS compressed_size, 'plain' AS strategy, sha256(encode(text)) AS payload_hash, lang AS lang, CASE WHEN doc_id % 10 = 0 THEN 'the payload has another checksum' END AS error FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'd' || doc_id, -1, -1, -1, NULL, NULL, NULL, 'the payload has another checksum' FROM documents WHERE doc_id % 10 = 0")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written and read by the container source; of every tenth file a byte was changed between."""
    from sparkfold.functions.lineage import shared_folder
    from sparkfold.sources import container

    spark.dataSource.register(container.Container)
    folder = f"{shared_folder(spark)}/containers-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), C.utf8(F.col("text")).alias("payload"), "lang")
    rows = docs.select("name", C.size_of(F.col("payload")).alias("original_size"), F.lit("plain").alias("strategy"), F.create_map(F.lit("lang"), "lang").alias("metadata"), "payload")
    rows.write.format("container").mode("append").save(folder)
    _damage(docs.where("CAST(substring(name, 2) AS LONG) % 10 = 0").select("name"), folder)
    back = spark.read.format("container").load(folder)
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("version", "original_size", "compressed_size")]
    return back.select("name", *numbers, "strategy", F.sha2("payload", 256).alias("payload_hash"), F.try_element_at("metadata", F.lit("lang")).alias("lang"), "error")


def _damage(names: DataFrame, folder: str) -> None:
    """Changes the last byte of some containers, where they lie."""

    def change(part) -> None:
        from sparkfold.sources import container

        store, base = container.opened(folder)
        for r in part:
            path = f"{base}/{r['name']}{container.SUFFIX}"
            with store.open_input_stream(path) as f:
                data = f.read()
            with store.open_output_stream(path) as f:
                f.write(data[:-1] + bytes([data[-1] ^ 1]))

    names.foreachPartition(change)


_REPORTS = "(SELECT k AS file_id, k % 16 / 2.0::DOUBLE AS entropy, (1 + k) * 997 AS size, ['TXT', 'JSON', 'PDF', 'PNG', 'DOCX', 'XLSX', 'PPTX', 'DICOM'][1 + (k // 16) % 8] AS format_type, ['text', 'data', 'document', 'image', 'document', 'document', 'document', 'medical'][1 + (k // 16) % 8] AS category FROM range(0, 256) AS t(k))"
_ESTIMATES = (
    ("traditional_zstd", "true", "CASE WHEN entropy <= 0 THEN 100.0 ELSE round(8.0::DOUBLE / greatest(entropy, 0.1::DOUBLE), 2) END"),
    ("traditional_lzma", "true", "CASE WHEN entropy < 3 THEN 12.0 WHEN entropy < 5 THEN 6.0 WHEN entropy < 7 THEN 3.0 ELSE 2.5 END"),
    ("traditional_brotli", "category IN ('text', 'data')", "CASE WHEN entropy < 3 THEN 10.0 WHEN entropy < 5 THEN 5.0 WHEN entropy < 7 THEN 2.5 ELSE 2.0 END"),
    ("semantic_json", "category = 'data'", "CASE WHEN size > 50000 THEN 80.0 WHEN size > 10000 THEN 40.0 ELSE 15.0 END"),
    ("procedural_gradient", "category = 'image'", "least(size / 200.0::DOUBLE, 50000.0)"),
    ("semantic_pdf", "format_type = 'PDF'", "CASE WHEN entropy < 5 THEN 8.0 ELSE 5.0 END"),
    ("semantic_office", "format_type IN ('DOCX', 'XLSX', 'PPTX')", "CASE format_type WHEN 'DOCX' THEN 6.0 WHEN 'XLSX' THEN 8.0 ELSE 4.0 END"),
)


@query(" UNION ALL ".join(f"SELECT file_id, '{n}' AS strategy, ({e})::DOUBLE AS est_ratio FROM {_REPORTS} WHERE {c}" for n, c, e in _ESTIMATES))
def codec_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every codec's estimate for reports of all kinds and entropies."""
    kinds = [F.array(*map(F.lit, names)) for names in (("TXT", "JSON", "PDF", "PNG", "DOCX", "XLSX", "PPTX", "DICOM"), ("text", "data", "document", "image", "document", "document", "document", "medical"))]
    at = (F.expr("id div 16") % 8).cast("int")
    reports = spark.range(256).select(F.col("id").alias("file_id"), (F.col("id") % 16 / 2).alias("entropy"), ((F.col("id") + 1) * 997).alias("size"), kinds[0][at].alias("format_type"), kinds[1][at].alias("category"), F.lit("gradient").alias("content_type"), F.lit(1.0).alias("content_confidence"))
    return codecs.estimates(reports)
