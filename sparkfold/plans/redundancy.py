"""Block storage, similarity, delta and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.functions import content as C
from sparkfold.functions.lineage import cut, sized
from sparkfold.operators import cas, delta, lsh, windows

from .common import contents, hex_blocks, query, values

BLOCK, WINDOW, QUERY_STEP = 1024, 4096, 50
_BLOCKS = f"(SELECT doc_id, pos, h, length(h) // 2 AS size, sha256(unhex(h)) AS hash FROM {hex_blocks(BLOCK)})"



def _human(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.1f KB', {n} / 1024.0::DOUBLE) WHEN {n} < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0::DOUBLE) ELSE printf('%.1f GB', {n} / 1073741824.0::DOUBLE) END"


_STORE = f"(SELECT hash, max(size) AS size, count(*) AS ref_count FROM {_BLOCKS} GROUP BY hash)"


@query(f"SELECT doc_id, pos, hash FROM {_BLOCKS}")
def cas_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas.recipes(contents(spark, sf_dir), BLOCK, "doc_id")


@query(f"SELECT * FROM {_STORE}")
def cas_block_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas.block_store(contents(spark, sf_dir), BLOCK, "doc_id")


@query(
    f"""SELECT file_count, total_original_size, total_unique_size, block_count, duplicate_blocks, round(total_original_size::DOUBLE / greatest(total_unique_size, 1), 6) AS dedup_ratio,
    total_original_size - total_unique_size AS saved_bytes, round((total_original_size - total_unique_size) * 100.0::DOUBLE / total_original_size, 6) AS saved_pct
    FROM (SELECT count(*) AS file_count, sum(octet_length(encode(text)))::BIGINT AS total_original_size FROM documents),
    (SELECT sum(size)::BIGINT AS total_unique_size, count(*) AS block_count, sum(ref_count - 1)::BIGINT AS duplicate_blocks FROM {_STORE})"""
)
def cas_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas.stats(contents(spark, sf_dir), BLOCK, "doc_id")


@query("SELECT doc_id, sha256(encode(text)) AS restored_hash FROM documents WHERE length(text) > 0")
def cas_reconstruct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each document as it comes back from recipe and store."""
    docs = contents(spark, sf_dir)
    made = cas.reconstruct(cas.recipes(docs, BLOCK, "doc_id"), cas.block_store(docs, BLOCK, "doc_id", data=True), "doc_id")
    return made.select("doc_id", F.sha2("content", 256).alias("restored_hash"))


@query(f"SELECT format('{{}} files, {{}} as {{}} unique: {{}}x, {{}} % saved, {{}} of {{}} blocks repeated', file_count, {_human('total_original_size')}, {_human('total_unique_size')}, printf('%.2f', total_original_size::DOUBLE / total_unique_size), printf('%.1f', (total_original_size - total_unique_size) * 100.0::DOUBLE / total_original_size), duplicate_blocks, block_count + duplicate_blocks) AS text FROM (SELECT count(*) AS file_count, sum(octet_length(encode(text)))::BIGINT AS total_original_size FROM documents), (SELECT sum(size)::BIGINT AS total_unique_size, count(*) AS block_count, sum(ref_count - 1)::BIGINT AS duplicate_blocks FROM {_STORE})")
def cas_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas.summary(cas.stats(contents(spark, sf_dir), BLOCK, "doc_id"))


@query(f"SELECT doc_id, pos, hash FROM {_BLOCKS} WHERE hash NOT IN (SELECT hash FROM {_STORE} WHERE ref_count > 1)")
def cas_missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes against a store that holds repeated blocks only."""
    docs = contents(spark, sf_dir)
    return cas.missing_blocks(cas.recipes(docs, BLOCK, "doc_id"), cas.block_store(docs, BLOCK, "doc_id").where("ref_count > 1"))


_SETS = f"""s AS MATERIALIZED (SELECT DISTINCT doc_id, hash FROM {_BLOCKS}), k AS MATERIALIZED (SELECT doc_id, string_agg(hash, '' ORDER BY hash) AS key, count(*) AS n FROM s GROUP BY doc_id),
    sets AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS head FROM k),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.hash = y.hash AND x.doc_id < y.doc_id WHERE x.doc_id IN (SELECT head FROM sets) AND y.doc_id IN (SELECT head FROM sets) GROUP BY ALL),
    jac AS MATERIALIZED (SELECT a, b, inter, na.n + nb.n - inter AS uni, round(inter::DOUBLE / (na.n + nb.n - inter), 6) AS jaccard FROM p JOIN sets na ON na.doc_id = a JOIN sets nb ON nb.doc_id = b)"""


@query(f"WITH {_SETS} SELECT * FROM jac")
def block_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives of distinct block sets; block_set_members says whom they stand for."""
    return cas.jaccard_pairs(cas.block_sets(contents(spark, sf_dir), BLOCK, "doc_id")[0])


@query(f"WITH {_SETS} SELECT doc_id, head FROM sets")
def block_set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas.block_sets(contents(spark, sf_dir), BLOCK, "doc_id")[1].select(F.col("id").alias("doc_id"), "head")


@query(f"WITH {_SETS} SELECT DISTINCT head AS i, head AS j, 1.0::DOUBLE AS score FROM sets UNION ALL SELECT a, b, jaccard FROM jac UNION ALL SELECT b, a, jaccard FROM jac")
def similarity_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix over all documents: its cells that aren't zero, of representatives of equal block sets."""
    sets, member = cas.block_sets(contents(spark, sf_dir), BLOCK, "doc_id")
    return cas.similarity_cells(member.select(F.col("head").alias("id")), cas.jaccard_pairs(sets))


@query("SELECT sha256(encode(text)) AS hash, count(*) AS members, min(doc_id) AS first_id FROM documents WHERE length(text) > 0 GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cas.duplicate_groups(contents(spark, sf_dir), "doc_id")


_PERMS = values([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(*lsh.coefficients(), strict=True))], "i, a, b")
_WORDS = """(SELECT doc_id, pos, ('0x' || substr(w, 7, 2) || substr(w, 5, 2) || substr(w, 3, 2) || substr(w, 1, 2))::BIGINT AS w FROM
    (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(CASE WHEN octet_length(encode(text)) < 8 THEN substr(md5(text), 1, 16) ELSE hex(encode(text)) END, '.{8}') AS ws FROM documents WHERE length(text) > 0)))"""
_SHINGLES = f"(SELECT DISTINCT doc_id, (w + 2 * (nxt % {lsh.P})) % {lsh.P} AS v FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM {_WORDS}) WHERE nxt IS NOT NULL)"
_SIG = f"(SELECT doc_id, i, min((a * v + b) % {lsh.P}) AS m FROM {_SHINGLES}, {_PERMS} GROUP BY ALL)"
_BANDS = "(SELECT doc_id, (i // 4)::INT AS band, string_agg(m::VARCHAR, '-' ORDER BY i) AS key FROM sig GROUP BY ALL)"
_CLASSES = "cls AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS head, count(*) OVER (PARTITION BY k) AS copies FROM (SELECT doc_id, string_agg(m::VARCHAR, '-' ORDER BY i) AS k FROM sig GROUP BY doc_id))"
_WITH = f"""WITH RECURSIVE sig AS MATERIALIZED {_SIG}, {_CLASSES}, bands AS MATERIALIZED (SELECT b.* FROM {_BANDS} b WHERE doc_id IN (SELECT head FROM cls)),
    cand AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id),
    pairs AS MATERIALIZED (SELECT a, b, round(j, 4) AS jaccard, j FROM (SELECT c.a, c.b, count(*) / 128.0::DOUBLE AS j FROM cand c JOIN sig x ON x.doc_id = c.a JOIN sig y ON y.doc_id = c.b AND y.i = x.i AND y.m = x.m GROUP BY ALL) WHERE j >= 0.5)"""
_REACH = "edges AS (SELECT a, b FROM pairs UNION SELECT doc_id, head FROM cls WHERE doc_id <> head), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, p.b FROM reach r JOIN both_ways p ON p.a = r.other), clu AS MATERIALIZED (SELECT doc_id, least(doc_id, min(other)) AS cluster_root FROM reach GROUP BY doc_id)"


@query(f"SELECT doc_id, count(*) AS shingles FROM {_SHINGLES} GROUP BY ALL")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).where(C.size_of(F.col("content")) > 0).select("doc_id", lsh.shingle_count(F.col("content")).alias("shingles"))


@query(f"SELECT doc_id, i::INT AS i, m FROM {_SIG}")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.signature_slots(contents(spark, sf_dir), "doc_id").withColumnRenamed("id", "doc_id")


@query(f"WITH sig AS {_SIG} SELECT * FROM {_BANDS}")
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.band_table(lsh.signatures(contents(spark, sf_dir), "doc_id")).withColumnRenamed("id", "doc_id")


@query(f"WITH sig AS {_SIG} SELECT count(DISTINCT doc_id) AS indexed_count, count(DISTINCT band || ':' || key) AS bucket_count, (SELECT max(n) FROM (SELECT count(*) AS n FROM {_BANDS} GROUP BY band, key)) AS largest_bucket FROM {_BANDS}")
def lsh_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = lsh.band_table(lsh.signatures(contents(spark, sf_dir), "doc_id"))
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("band") == 0, 1)).alias("ids"))
    return buckets.agg(F.sum("ids").alias("indexed_count"), F.count(F.lit(1)).alias("bucket_count"), F.max("n").alias("largest_bucket"))


def _heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return lsh.classes(contents(spark, sf_dir), "doc_id")


@query(f"{_WITH} SELECT * FROM cand")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives of distinct signatures that share a band."""
    return lsh.candidates(lsh.packed_bands(_heads(spark, sf_dir)[0].select("id", "sig")))


@query(f"{_WITH} SELECT a, b, jaccard FROM pairs")
def lsh_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of representatives of distinct signatures; lsh_members says whom they stand for."""
    return lsh.similar_pairs(_heads(spark, sf_dir)[0].select("id", "sig"))


@query(f"WITH sig AS MATERIALIZED {_SIG}, {_CLASSES} SELECT * FROM cls")
def lsh_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, member = _heads(spark, sf_dir)
    return member.join(heads.select(F.col("id").alias("head"), "copies"), "head").select(F.col("id").alias("doc_id"), "head", "copies")


@query(f"{_WITH} SELECT (row_number() OVER (ORDER BY jaccard DESC, a, b))::INT AS place, a, b, jaccard FROM pairs QUALIFY place <= 20")
def lsh_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 20 most similar pairs, in order."""
    from pyspark.sql import Window

    top = lsh.most_similar(lsh.similar_pairs(_heads(spark, sf_dir)[0].select("id", "sig")), 20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("jaccard"), "a", "b")).alias("place"), "a", "b", "jaccard")  # 20 rows


@query(
    f"""{_WITH}, q AS (SELECT doc_id AS query_id, head FROM cls WHERE doc_id % {QUERY_STEP} = 0),
    near AS (SELECT a, b, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs UNION ALL SELECT DISTINCT head, head, 1.0::DOUBLE FROM cls)
    SELECT * FROM (SELECT q.query_id, near.b AS doc_id, near.jaccard, c.copies - (near.b = q.head)::INT AS copies FROM q JOIN near ON near.a = q.head JOIN cls c ON c.doc_id = near.b) WHERE copies > 0"""
)
def lsh_query_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by QUERY_STEP against all documents: the representatives that are similar, and how many other documents each stands for."""
    heads, member = _heads(spark, sf_dir)
    queries = contents(spark, sf_dir).where(F.col("doc_id") % QUERY_STEP == 0).select(F.col("doc_id").alias("id"))
    return lsh.query_similar(queries, heads, member).withColumnRenamed("id", "doc_id")


@query(f"{_WITH} SELECT d.doc_id AS query_id, coalesce(c.copies > 1 OR c.head IN (SELECT unnest([a, b]) FROM pairs WHERE j >= 0.95), false) AS is_duplicate FROM documents d LEFT JOIN cls c USING (doc_id)")
def lsh_is_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, whether any other one nearly equals it."""
    return lsh.duplicates(contents(spark, sf_dir), "doc_id")


@query(f"{_WITH}, {_REACH} SELECT * FROM clu")
def lsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.clusters(lsh.links(contents(spark, sf_dir), "doc_id")).withColumnRenamed("id", "doc_id")


@query(f"{_WITH}, {_REACH} SELECT row_number() OVER (ORDER BY size DESC, cluster_root) - 1 AS cluster_id, cluster_root, size FROM (SELECT cluster_root, count(*) AS size FROM clu GROUP BY ALL)")
def lsh_cluster_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.numbered_clusters(lsh.clusters(lsh.links(contents(spark, sf_dir), "doc_id")))


_CLUSTER_STATS = "SELECT cluster_root, max(n) AS size, round(sum(s) / sum(1.0::DOUBLE) + 0.0, 4) AS avg_similarity FROM (SELECT x.cluster_root, (SELECT count(*) FROM clu c WHERE c.cluster_root = x.cluster_root) AS n, (SELECT count(*) FROM sig p JOIN sig q ON p.i = q.i AND p.m = q.m WHERE p.doc_id = x.doc_id AND q.doc_id = y.doc_id) / 128.0::DOUBLE AS s FROM clu x JOIN clu y ON x.cluster_root = y.cluster_root AND x.doc_id < y.doc_id) GROUP BY cluster_root"


@query(f"{_WITH}, {_REACH} {_CLUSTER_STATS}")
def lsh_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, member = _heads(spark, sf_dir)
    return lsh.cluster_stats(lsh.clusters(lsh.linked(heads, member)), heads)


def _first_of_equal(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of those with their text. The ids that aren't are few as a rule, so the others needn't be shuffled with their texts."""
    hashed = cut(docs.where("doc_id IS NOT NULL").select("doc_id", F.sha2("content", 256).alias("h")))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    later = cut(hashed.select("doc_id").join(first, "doc_id", "left_anti").distinct())
    return docs.where("doc_id IS NOT NULL").join(sized(later), "doc_id", "left_anti")


@query(
    f"""{_WITH}, {_SETS}, uniq AS MATERIALIZED (SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) > 0 GROUP BY text),
    found AS MATERIALIZED (SELECT least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b FROM pairs p JOIN cls x ON x.head = p.a JOIN cls y ON y.head = p.b WHERE x.doc_id IN (FROM uniq) AND y.doc_id IN (FROM uniq)
        UNION SELECT x.doc_id, y.doc_id FROM cls x JOIN cls y ON x.head = y.head AND x.doc_id < y.doc_id WHERE x.doc_id IN (FROM uniq) AND y.doc_id IN (FROM uniq)),
    truth AS MATERIALIZED (SELECT least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b FROM jac p JOIN sets x ON x.head = p.a JOIN sets y ON y.head = p.b WHERE p.jaccard >= 0.5 AND x.doc_id IN (FROM uniq) AND y.doc_id IN (FROM uniq)
        UNION SELECT x.doc_id, y.doc_id FROM sets x JOIN sets y ON x.head = y.head AND x.doc_id < y.doc_id WHERE x.doc_id IN (FROM uniq) AND y.doc_id IN (FROM uniq))
    SELECT (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM truth) AS relevant, count(*) AS both, round(count(*)::DOUBLE / (SELECT count(*) FROM found), 6) AS precision, round(count(*)::DOUBLE / (SELECT count(*) FROM truth), 6) AS recall FROM found JOIN truth USING (a, b)"""
)
def lsh_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found pairs of different texts against pairs that share half of their blocks; equal texts are one."""
    docs = contents(spark, sf_dir).where(C.size_of(F.col("content")) > 0)
    docs = cut(_first_of_equal(docs))
    heads, member = lsh.classes(docs, "doc_id")
    sets, of = cas.block_sets(docs, BLOCK, "doc_id")

    def expanded(pairs: DataFrame, member: DataFrame) -> DataFrame:
        """Pairs of representatives as pairs of the (different) texts that they stand for."""
        every = pairs.select("a", "b").unionByName(member.select(F.col("head").alias("a"), F.col("head").alias("b")).distinct())
        both = every.join(member.toDF("x", "a"), "a").join(member.toDF("y", "b"), "b").where("a <> b OR x < y")
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    found = expanded(lsh.similar_pairs(heads.select("id", "sig")), member).withColumn("f", F.lit(1))
    truth = expanded(cas.jaccard_pairs(sets).where("jaccard >= 0.5"), of).withColumn("t", F.lit(1))
    n = found.join(truth, ["a", "b"], "full").agg(F.count("f").alias("found"), F.count("t").alias("relevant"), F.count(F.col("f") + F.col("t")).alias("both"))
    return n.select("*", F.round(F.try_divide("both", "found"), 6).alias("precision"), F.round(F.try_divide("both", "relevant"), 6).alias("recall"))


@query("SELECT s::INT AS percent, round(1 - pow(1 - pow(s / 100.0::DOUBLE, 4), 32), 6) AS odds, round(pow(1 / 32.0::DOUBLE, 0.25), 6) AS midpoint FROM range(0, 101, 5) AS t(s)")
def lsh_s_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.range(0, 101, 5)
    return s.select(F.col("id").cast("int").alias("percent"), F.round(lsh.detection_odds(F.col("id") / 100), 6).alias("odds"), F.lit(round((1 / lsh.BANDS) ** (lsh.BANDS / lsh.PERMUTATIONS), 6)).alias("midpoint"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of clusters: (doc_id, content, cluster_root). Texts outside of them aren't shuffled if the ids in clusters fit a broadcast."""
    docs = contents(spark, sf_dir)
    return docs.join(sized(cut(lsh.clusters(lsh.links(docs, "doc_id")).withColumnRenamed("id", "doc_id"))), "doc_id")


_SIZED = "sized AS (SELECT c.cluster_root, d.doc_id, octet_length(encode(d.text)) AS n, d.text FROM clu c JOIN documents d USING (doc_id)), ref AS (SELECT cluster_root, arg_max(doc_id, (n, -doc_id)) AS reference_id, max(n) AS n_bytes FROM sized GROUP BY ALL)"


@query(f"{_WITH}, {_REACH}, {_SIZED} SELECT * FROM ref")
def delta_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.references(_grouped(spark, sf_dir), "cluster_root", "doc_id")


def _against(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(_grouped(spark, sf_dir))
    return delta.with_reference(docs, delta.references(docs, "cluster_root", "doc_id"), "cluster_root", "doc_id")


_TARGETS = "FROM sized s JOIN ref r USING (cluster_root) JOIN documents d ON d.doc_id = r.reference_id WHERE s.doc_id <> r.reference_id"
#: The XOR of target and reference as hex, and how many of its bytes aren't zero.
_XOR = f"""xored AS (SELECT cluster_root, doc_id, n, string_agg(printf('%02X', xor(('0x' || substr(x, i * 2 + 1, 2))::INT, ('0x' || substr(y, i * 2 + 1, 2))::INT)), '' ORDER BY i) AS z, sum((substr(x, i * 2 + 1, 2) <> substr(y, i * 2 + 1, 2))::INT)::BIGINT AS differing
    FROM (SELECT cluster_root, doc_id, n, rpad(x, greatest(length(x), length(y))::INT, '0') AS x, rpad(y, greatest(length(x), length(y))::INT, '0') AS y FROM (SELECT s.cluster_root, s.doc_id, s.n, hex(encode(s.text)) AS x, hex(encode(d.text)) AS y {_TARGETS})), unnest(range(0, length(x) // 2)) AS u(i) GROUP BY ALL)"""


@query(f"{_WITH}, {_REACH}, {_SIZED} SELECT s.cluster_root, s.doc_id, r.reference_id, s.n AS target_size, r.n_bytes AS reference_size FROM sized s JOIN ref r USING (cluster_root) WHERE s.doc_id <> r.reference_id")
def delta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _against(spark, sf_dir).select("cluster_root", F.col("id").alias("doc_id"), "reference_id", C.size_of(F.col("content")).alias("target_size"), C.size_of(F.col("reference")).alias("reference_size"))


@query(f"{_WITH}, {_REACH}, {_SIZED}, {_XOR} SELECT doc_id, length(z) // 2 AS xor_size, differing, sha256(unhex(z)) AS xor_hash FROM xored")
def delta_xor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _against(spark, sf_dir).select(F.col("id").alias("doc_id"), delta.xor("content", "reference").alias("z"))
    return p.select("doc_id", C.size_of(F.col("z")).alias("xor_size"), delta.differing_bytes(F.col("z")).alias("differing"), F.sha2("z", 256).alias("xor_hash"))


@query(f"{_WITH}, {_REACH}, {_SIZED} SELECT s.doc_id, sha256(encode(s.text)) AS restored_hash, sha256(encode(d.text)) AS reference_hash, 'hash mismatch of the reference' AS wrong_reference {_TARGETS}")
def delta_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back from each delta against the right reference, and what another one gives."""
    e = _against(spark, sf_dir).withColumn("e", delta.encoder()(F.col("reference"), F.col("content")))
    args = (F.col("e.delta"), F.col("e.method"), F.col("e.reference_hash"), F.col("e.target_hash"), C.size_of(F.col("content")))
    right, wrong = delta.decode(F.col("reference"), *args), delta.decode(F.concat(F.col("reference"), F.lit(b"?")), *args)
    d = e.select(F.col("id").alias("doc_id"), right.alias("r"), wrong.alias("w"), "e")
    return d.select("doc_id", F.sha2("r.content", 256).alias("restored_hash"), F.col("e.reference_hash").alias("reference_hash"), F.col("w.error").alias("wrong_reference"))


@query(f"{_WITH}, {_REACH}, {_SIZED}, {_XOR} SELECT cluster_root, count(*) AS targets, sum(n)::BIGINT AS original_bytes, sum(differing)::BIGINT AS differing_bytes, round((1 - sum(differing)::DOUBLE / sum(n)) * 100, 1) AS saved_percent FROM xored GROUP BY ALL")
def delta_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cluster saves if only bytes that differ from the reference are kept; what zstd makes of the deltas depends on its version, tests hold it against the originals."""
    e = _against(spark, sf_dir).select("cluster_root", C.size_of(F.col("content")).alias("n"), delta.differing_bytes(delta.xor("content", "reference")).alias("d"))
    sums = e.groupBy("cluster_root").agg(F.count(F.lit(1)).alias("targets"), F.sum("n").alias("original_bytes"), F.sum("d").alias("differing_bytes"))
    return sums.withColumn("saved_percent", delta.savings_percent(F.col("original_bytes"), F.col("differing_bytes")))


_WIN = f"(SELECT doc_id, pos AS window_index, pos * {WINDOW}::BIGINT AS original_offset, length(h) // 2 AS original_size, sha256(unhex(h)) AS checksum FROM {hex_blocks(WINDOW)})"


@query(f"SELECT * FROM {_WIN}")
def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.split(contents(spark, sf_dir), WINDOW, "doc_id").drop("data")


#: Windows with the size of their run lengths: two bytes for each run of at most 255 bytes.
_PACKED = f"""(SELECT w.*, r.compressed_size FROM {_WIN} w JOIN (SELECT doc_id, pos AS window_index, sum(2 * ((len + 254) // 255))::BIGINT AS compressed_size FROM
    (SELECT doc_id, pos, run, count(*) AS len FROM (SELECT doc_id, pos, i, sum(fresh) OVER (PARTITION BY doc_id, pos ORDER BY i) AS run FROM
        (SELECT doc_id, pos, i, CASE WHEN i > 0 AND substr(h, i * 2 + 1, 2) = substr(h, i * 2 - 1, 2) THEN 0 ELSE 1 END AS fresh FROM {hex_blocks(WINDOW)}, unnest(range(0, length(h) // 2)) AS u(i))) GROUP BY ALL) GROUP BY doc_id, pos) r USING (doc_id, window_index))"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as run lengths, whose sizes no library decides."""
    return windows.compress(windows.split(contents(spark, sf_dir), WINDOW, "doc_id"), codec="run_length")


@query(f"SELECT *, coalesce(sum(compressed_size) OVER (PARTITION BY doc_id ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_offset FROM {_PACKED}")
def window_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, through JSON and back."""
    rows = windows.manifest(_packed(spark, sf_dir).drop("packed"), id_col="doc_id")
    back = windows.manifest_rows(windows.manifest_json(rows, "doc_id"), "doc_id")
    return back.select("doc_id", "window_index", "original_offset", "original_size", "checksum", "compressed_size", "stream_offset")


@query(f"SELECT doc_id, original_size, checksum FROM {_WIN} WHERE window_index = 1")
def window_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.seek(windows.split(contents(spark, sf_dir), WINDOW, "doc_id"), 1).select("doc_id", "original_size", "checksum")


@query("SELECT doc_id, octet_length(encode(text)) AS original_size, sha256(encode(text)) AS restored_hash FROM documents WHERE length(text) > 0")
def window_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows compressed at level 19, read back with their checksums and joined again."""
    packed = windows.compress(windows.split(contents(spark, sf_dir), WINDOW, "doc_id"))
    return windows.restore(packed, "doc_id").select("doc_id", C.size_of(F.col("content")).alias("original_size"), F.sha2("content", 256).alias("restored_hash"))


@query(f"SELECT doc_id, window_index, window_index + 1 AS done, count(*) OVER (PARTITION BY doc_id) AS total, round(sum(original_size) OVER w / (sum(compressed_size) OVER w)::DOUBLE, 6) AS ratio FROM {_PACKED} WINDOW w AS (PARTITION BY doc_id ORDER BY window_index)")
def window_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.progress(_packed(spark, sf_dir).drop("packed"), id_col="doc_id")
