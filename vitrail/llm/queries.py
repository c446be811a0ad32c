"""Queries of the operators for training data, with their SQL for comparison where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.llm import bpe, mixture, neighbours, packing, percentiles, spam
from vitrail.sources.tables import cut, read_spread, read_table

REVISION = ["model_id", "model_version", "model_cache_revision", "alignment_revision"]

PCTS = [10, 50, 90, 99]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rows of which one is among the other's 10 most similar, with a cosine of at least 0.90."""
    images = neighbours.similar_pairs(read_table(spark, d, "images"), "row_id", "embedding", 64, 10, 0.90)
    faces = neighbours.similar_pairs(read_table(spark, d, "face_embeddings"), "row_id", "embedding", 128, 10, 0.90, REVISION)
    return images.select(F.lit("images").alias("vec_table"), "*").unionByName(faces.select(F.lit("face_embeddings").alias("vec_table"), "*"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of width and height per root, exact."""
    return percentiles.percentiles(read_table(spark, d, "images"), "root", ["width", "height"], PCTS, positive_only=True)


def p2_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per root from summaries of each scan and month, combined; off by at most a hundredth."""
    images = read_table(spark, d, "images").where(F.col("root").isNotNull()).withColumn("period_ym", F.date_format("ingested_at", "yyyy-MM"))
    parts = percentiles.summary(images, ["root", "last_seen_scan", "period_ym"], ["width", "height"])
    return percentiles.from_summary(percentiles.combine(parts, ["root"]), ["root"], PCTS)


def _face_names(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, name) of the vectors whose face_id is in faces."""
    names = read_table(spark, d, "face_embeddings").select("row_id", F.col("face_id").alias("name")).distinct()
    return cut(names.join(read_table(spark, d, "faces").select(F.col("face_id").alias("name")), "name", "left_semi").select("row_id", "name"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of faces in one cluster of faces of a cosine of at least 0.70."""
    names = _face_names(spark, d)
    found, _ = mixture.clusters(read_table(spark, d, "face_embeddings"), "row_id", "embedding", 128, 0.70, REVISION, names)
    named = found.join(names, "row_id").select("cluster", F.col("name").alias("face_a")).distinct()
    other = named.select("cluster", F.col("face_a").alias("face_b"))
    return named.join(other, "cluster").where(F.col("face_a") < F.col("face_b")).select("face_a", "face_b")


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of every face, named by its smallest face_id; unlike p3_found it grows with the faces only, however large a cluster is."""
    names = _face_names(spark, d)
    found, _ = mixture.clusters(read_table(spark, d, "face_embeddings"), "row_id", "embedding", 128, 0.70, REVISION, names)
    named = found.join(names, "row_id").select("cluster", F.col("name").alias("face_id")).distinct()
    return named.join(named.groupBy("cluster").agg(F.min("face_id").alias("cluster_name")), "cluster").select("face_id", F.col("cluster_name").alias("cluster"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical faces of every cluster."""
    names = _face_names(spark, d)
    vectors = read_table(spark, d, "face_embeddings")
    found, model = mixture.clusters(vectors, "row_id", "embedding", 128, 0.70, REVISION, names)
    if model is None:
        density = found.select("row_id", F.lit(0.0).alias("density"))
    else:
        density = mixture.densities(vectors, "row_id", "embedding", 128, model)
    return mixture.describe(found, density, names)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_corpus(read_spread(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Containers of every budget of tokens and the texts, or pieces of long texts, in them."""
    return packing.pack_documents(read_spread(spark, d, "documents"), read_table(spark, d, "token_budgets"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused room of every budget."""
    return packing.unused_room(p7_packing(spark, d), read_table(spark, d, "token_budgets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are spam of keywords, links or product tags."""
    return spam.find_spam(read_spread(spark, d, "documents"), read_table(spark, d, "page_labels")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_combined": p2_combined, "p3_found": p3_found, "p3_members": p3_members, "p3_clusters": p3_clusters, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_unused": p7_unused, "p8_found": p8_found}

_VALUES = """
WITH v AS (
  SELECT root, 'width' AS field, width::BIGINT AS value FROM images WHERE root IS NOT NULL AND width > 0
  UNION ALL SELECT root, 'height', height::BIGINT FROM images WHERE root IS NOT NULL AND height > 0),
p AS (SELECT unnest([10, 50, 90, 99])::INTEGER AS pct),
"""

_LINKS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT ON (e.row_id) e.row_id, e.face_id, e.embedding::DOUBLE[] AS v, hash(model_id, model_version, model_cache_revision, alignment_revision) AS g
  FROM face_embeddings e WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
  AND face_id IN (SELECT face_id FROM faces)),
u AS (SELECT row_id, face_id, g, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
l AS (SELECT a.face_id AS a, b.face_id AS b FROM u a JOIN u b ON a.g = b.g WHERE round(list_dot_product(a.v, b.v), 10) >= 0.70),
r AS (SELECT DISTINCT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
"""

ORACLE = {
    "p3_found": _LINKS + "SELECT a AS face_a, b AS face_b FROM r WHERE a < b",
    "p3_members": _LINKS + "SELECT a AS face_id, min(b) AS cluster FROM r GROUP BY a",
    "p2_found": _VALUES
    + """
r AS (SELECT root, field, value, row_number() OVER (PARTITION BY root, field ORDER BY value) - 1 AS k,
             count(*) OVER (PARTITION BY root, field) AS n FROM v)
SELECT root, field, pct, value AS pct_value FROM r, p WHERE k = (2 * (n - 1) * pct + 100) // 200
""",
    "p2_combined": _VALUES
    + """
b AS (SELECT root, field, ceil(round(ln(value::DOUBLE) / ln(1.01::DOUBLE / 0.99::DOUBLE), 9))::INTEGER AS bucket FROM v),
r AS (SELECT root, field, bucket, row_number() OVER (PARTITION BY root, field ORDER BY bucket) - 1 AS k,
             count(*) OVER (PARTITION BY root, field) AS n FROM b)
SELECT root, field, pct, round(2 * pow(1.01::DOUBLE / 0.99::DOUBLE, bucket) / (1.01::DOUBLE / 0.99::DOUBLE + 1), 6) AS pct_value
FROM r, p WHERE k = (2 * (n - 1) * pct + 100) // 200
""",
}
