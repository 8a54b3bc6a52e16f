"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.clusters import describe_clusters, similarity_clusters
from quantloom.llm.cooccur import cooccurring_items
from quantloom.llm.encode import encode_documents
from quantloom.llm.packing import CAPACITY, pack_documents
from quantloom.llm.sentences import document_sentences
from quantloom.llm.split import split_records

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_records(*[_read(spark, sf_dir, t) for t in ("samples", "history", "interactions", "token_roles")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("piece = 1").select("src", "rec_id", "split")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring_items(_read(spark, sf_dir, "interactions"), min_count=8, min_share=1 / 2000, min_lift=4.0).select("item_a", "item_b")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurring_items(_read(spark, sf_dir, "interactions"))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


def p2_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs together more often than chance by a log-likelihood ratio of 10.83 or more (p < 0.001)."""
    pairs = cooccurring_items(_read(spark, sf_dir, "interactions"), min_count=2, min_llr=10.83)
    return pairs.select("item_a", "item_b", "n_ab", F.round("llr", 4).alias("llr"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters(_read(spark, sf_dir, "catalog_items"), centred=False).filter("complete and size >= 3").select("cluster_id", "item_id")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their most typical items and the commonest first-level code beside them."""
    clusters = similarity_clusters(_read(spark, sf_dir, "catalog_items"))
    codes = _read(spark, sf_dir, "codes").select("item_id", F.try_element_at("codes", F.lit(1)).alias("code")).filter("code >= 0").groupBy("item_id").agg(F.min("code").alias("code"))
    counts = clusters.join(codes, "item_id").groupBy("cluster_id", "complete", "code").agg(F.count("*").alias("n"))
    common = counts.groupBy("cluster_id", "complete").agg(F.max(F.struct("n", (-F.col("code")).alias("c"))).alias("m")).select("cluster_id", "complete", (-F.col("m.c")).alias("first_code"))
    return describe_clusters(clusters).join(common, ["cluster_id", "complete"], "left")


def p5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"))


def p5_tree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids with every text over 4,096 characters cut anywhere and joined by tree concatenation."""
    return encode_documents(_read(spark, sf_dir, "documents"), chunk_chars=4_096, cut_anywhere=True)


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir).filter("part = 1").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: (n_containers, n_tokens, fill)."""
    used = _containers(spark, sf_dir).filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.round(F.avg("n") / CAPACITY, 4).alias("fill"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sentences(_read(spark, sf_dir, "documents")).select("doc_id", "end_pos")


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence with its text as it stands in the document."""
    return document_sentences(_read(spark, sf_dir, "documents"), sentence="sentence").select("doc_id", "start_pos", "end_pos", "sentence")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_pairs, p2_significant, p4_found, p4_clusters, p5_ids, p5_tree_ids, p6_found, p6_containers, p6_fill, p7_found, p7_sentences)}


_PAIRS = """
WITH s AS (SELECT DISTINCT session_id, item_id FROM interactions WHERE session_id IS NOT NULL AND item_id >= 0),
     n AS (SELECT count(DISTINCT session_id) AS n FROM s),
     c AS (SELECT item_id, count(*) AS k FROM s GROUP BY item_id),
     p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n_ab
           FROM s a JOIN s b ON a.session_id = b.session_id AND a.item_id < b.item_id GROUP BY 1, 2),
     t AS (SELECT item_a, item_b, n_ab, x.k AS n_a, y.k AS n_b, n.n AS n
           FROM p JOIN c x ON x.item_id = item_a JOIN c y ON y.item_id = item_b CROSS JOIN n)
"""


def _xlogx(e: str) -> str:
    return f"(CASE WHEN ({e}) > 0 THEN ({e}) * ln(CAST(({e}) AS DOUBLE)) ELSE 0 END)"


def oracle_sql() -> dict[str, str]:
    llr = " + ".join(map(_xlogx, ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n"))) + "".join(f" - {_xlogx(e)}" for e in ("n_a", "n - n_a", "n_b", "n - n_b"))
    return {
        "p1_found": """
WITH e AS (SELECT sample_id, split, generate_subscripts(input_ids, 1) AS i, unnest(input_ids) AS t FROM samples),
     s AS (SELECT sample_id, split, max(i) - min(i) + 1 AS n FROM e WHERE t IS NULL OR t <> 0 GROUP BY sample_id, split),
     h AS (SELECT user_id, split, max(len(list_filter(items, lambda x: x IS NOT NULL AND x >= 0))) AS n FROM history GROUP BY user_id, split)
SELECT 'samples' AS src, sample_id AS rec_id, split FROM s WHERE n > 256
UNION ALL SELECT 'history', user_id, split FROM h WHERE n > 20""",
        "p2_found": _PAIRS + "SELECT item_a, item_b FROM t WHERE n_ab >= 8 AND n_ab >= n / 2000.0 AND n_ab * n >= 4.0 * n_a * n_b",
        "p2_pairs": _PAIRS + f"SELECT item_a, item_b, n_ab, n_a, n_b, round(n_ab * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, round(greatest(0.0, 2 * ({llr})), 4) AS llr FROM t",
        "p2_significant": _PAIRS + f"SELECT item_a, item_b, n_ab, round(2 * ({llr}), 4) AS llr FROM t WHERE n_ab >= 2 AND n_ab * n > n_a * n_b AND 2 * ({llr}) >= 10.83",
        "p4_found": """
WITH v AS (SELECT item_id, arg_max(embedding, loaded_at) AS e FROM catalog_items
           WHERE item_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY item_id),
     u AS (SELECT item_id, CAST(e AS DOUBLE[]) AS e FROM v),
     p AS (SELECT a.item_id AS a, b.item_id AS b FROM u a JOIN u b ON list_cosine_similarity(a.e, b.e) >= 0.82),
     d AS (SELECT a, count(*) AS k, min(b) AS m, list(b ORDER BY b) AS nb FROM p GROUP BY a),
     g AS (SELECT m, count(*) AS k, count(DISTINCT nb) AS w, max(k) AS hi FROM d GROUP BY m)
SELECT d.m AS cluster_id, d.a AS item_id FROM d JOIN g ON g.m = d.m WHERE g.w = 1 AND g.k = g.hi AND g.k >= 3""",
    }
