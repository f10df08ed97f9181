"""The queries of this package and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, langid, minhash, mixing, packing, quality, sharding, topk, toxicity
from .frames import table

SHARD_BYTES = 2 << 20
TOP_K = 10
QUERY_STEP = 50


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by QUERY_STEP, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, TOP_K, queries=vectors["vec_id"] % QUERY_STEP == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"), carry=False)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_dedup, op2_language_id, op3_exact_topk, op4_toxicity, op5_exact_dedup, op6_best_fit_packing, op7_sharding, op8_chat_format, op9_mixing, op10_quality]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_topk": f"""
            WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
            p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_inner_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_STEP} = 0),
            r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id)::INT AS rank, neighbour_id, score FROM p)
            SELECT * FROM r WHERE rank <= {TOP_K}""",
        "op8_chat_format": chat.ORACLE_SQL,
        "op5_exact_dedup": """
            SELECT doc_id,
                   CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS kept_id,
                   CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies,
                   text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY text) AS keep
            FROM documents""",
        "op7_sharding": f"""
            WITH r AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, octet_length(encode(text)) AS b FROM documents),
            n AS (SELECT d, h >> (60 - d) AS node, sum(b)::BIGINT AS nb, count(*) AS nn FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY ALL),
            leaf AS (SELECT r.*, min(n.d) AS d FROM r JOIN n ON n.node = r.h >> (60 - n.d) AND (n.nb <= {SHARD_BYTES} OR n.d = 60) GROUP BY ALL)
            SELECT doc_id, CASE WHEN leaf.d = 0 THEN '' ELSE lpad(bin(leaf.h >> (60 - leaf.d)), leaf.d::INT, '0') END AS shard, leaf.d::INT AS depth,
                   b AS bytes, nb AS shard_bytes, nn AS shard_rows, nb > {SHARD_BYTES} AS oversized
            FROM leaf JOIN n ON n.d = leaf.d AND n.node = leaf.h >> (60 - leaf.d)""",
        "op9_mixing": f"""
            WITH r AS (SELECT doc_id, source, round(1000.0 * ln(2.0 + coalesce(length(text), 0)))::BIGINT AS g, md5(coalesce(text, '')) AS m,
                              row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS j FROM documents),
            c AS (SELECT source, count(*) AS n, sum(g)::BIGINT AS g_all, sqrt(count(*)::DOUBLE) AS w FROM r GROUP BY source),
            s AS (SELECT *, round(round(w / sum(w) OVER (), 12) * (sum(n) OVER ())::DOUBLE, 6) AS quota, (sum(n) OVER ())::BIGINT AS total FROM c),
            f AS (SELECT *, floor(quota)::BIGINT AS t0 FROM s),
            p AS (SELECT *, row_number() OVER (ORDER BY round(quota - t0, 6) DESC, source) AS place, total - (sum(t0) OVER ())::BIGINT AS spare FROM f),
            t AS (SELECT source, g_all, t0 + CASE WHEN place <= spare THEN 1 ELSE 0 END AS t FROM p),
            e AS (SELECT r.*, t.t, t.t * g // g_all AS sure, (t.t * g % g_all)::DOUBLE / g_all AS pi,
                         (('0x' || substr(md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || m || CASE WHEN j > 0 THEN '|' || j ELSE '' END), 1, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u
                  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
            q AS (SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM e),
            k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, coalesce(doc_id::VARCHAR, ''), m, j) AS place,
                         t - (sum(sure) OVER (PARTITION BY source))::BIGINT AS need FROM q)
            SELECT doc_id, source, sum(sure + CASE WHEN q IS NOT NULL AND place <= need THEN 1 ELSE 0 END)::BIGINT AS copies
            FROM k GROUP BY doc_id, source, m HAVING sum(sure + CASE WHEN q IS NOT NULL AND place <= need THEN 1 ELSE 0 END) > 0""",
    }
