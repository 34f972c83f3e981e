"""Vectors and near copies: embeddings, document fingerprints, cluster and layout of bounded groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import dedup, vectors
from loomgraph.plans.registry import registry
from loomgraph.sources.tables import load

QUERIES, ORACLES, query = registry()


@query("embedding_cosine_topk", "WITH s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def embedding_cosine_topk(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k_similar(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("label_centroids", "SELECT label, i::INT AS dim, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def label_centroids(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", (F.col("dim") + 1).alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


@query("simhash_blocks")
def simhash_blocks(spark, sf_dir):
    """Documents per value of the first byte of the fingerprint of their text without white space; BLAKE2b has no SQL twin."""
    rows = load(spark, sf_dir, "documents").select(F.arrow_udf(dedup._simhashes, "long")(dedup.solid(F.col("text"))).alias("fp"))
    return rows.groupBy(dedup.block(F.col("fp"), 0).alias("block")).agg(F.count("*").alias("n"))


@query("near_dup_star")
def near_dup_star(spark, sf_dir):
    """(doc, root) of every document; tested against a brute-force pass in the order of ids."""
    return dedup.near_members(load(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("near_dup_stats")
def near_dup_stats(spark, sf_dir):
    return dedup.cluster_stats(near_dup_star(spark, sf_dir))


@query("affinity_clusters")
def affinity_clusters(spark, sf_dir):
    """Affinity clusters within groups of 64 vectors at most a label and slice."""
    rows = load(spark, sf_dir, "embeddings").withColumn("part", F.concat_ws("-", "label", F.floor(F.col("vec_id") / 640).cast("string")))
    return vectors.affinity_clusters(rows.select("part", "vec_id", "embedding"), "part", "vec_id", "embedding")


@query("smacof_layout")
def smacof_layout(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").withColumn("part", F.concat_ws("-", "label", F.floor(F.col("vec_id") / 640).cast("string")))
    return vectors.layout(rows.select("part", "vec_id", "embedding"), "part", "vec_id", "embedding")
