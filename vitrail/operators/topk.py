"""Exact and approximate top-k over vectors, overlap of result lists, even samples and the state of an index."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrail.functions import hashing, vector
from vitrail.operators.ordering import row_numbers
from vitrail.sources import snapshot

# Fixed values of the candidate search: neighbours beyond k that are looked at.
EXTRA_CANDIDATES = 512
EMBEDDING_BYTES = 32 << 20


def exact_top_k(df: DataFrame, id_column: str, vector_column: str, query: list[float], k: int) -> DataFrame:
    """(id, similarity): the k rows of largest dot product with a unit query, ties by id. Vectors of another length or null don't count.

    The query is a constant of the plan; the limit keeps k rows a partition.
    """
    same = F.size(vector_column) == len(query)
    scored = df.where(same).select(F.col(id_column), F.round(vector.dot_literal(F.col(vector_column), query), 6).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), id_column).limit(k)


def check_queries(queries: DataFrame, vector_column: str, most_bytes: int = EMBEDDING_BYTES) -> int:
    """The number of queries, if their vectors are small enough to be broadcast, else an error."""
    n, size = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vector_column)), F.lit(0)) * 4).first()
    if size > most_bytes:
        raise ValueError(f"{n} queries of {size} bytes are too many to broadcast; search in blocks")
    return n


def top_k_per_query(queries: DataFrame, corpus: DataFrame, id_column: str, vector_column: str, k: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, candidate_id, similarity, rank) of a stated query set against all rows.

    The queries are broadcast after a check of their size; a running limit a query leaves k rows a query and partition before the shuffle.
    """
    check_queries(queries, vector_column)
    q = queries.select(F.col(id_column).alias("query_id"), F.col(vector_column).alias("_q"))
    c = corpus.select(F.col(id_column).alias("candidate_id"), F.col(vector_column).alias("_c"))
    on = (F.size("_q") == F.size("_c")) & ((F.col("query_id") != F.col("candidate_id")) if exclude_self else F.lit(True))
    scored = c.join(F.broadcast(q), on).select("query_id", "candidate_id", F.round(vector.dot(F.col("_q"), F.col("_c")), 6).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "candidate_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first row of each group by ``order``, then the first k rows of these."""
    best = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")
    return best.orderBy(*order).limit(k)


def overlap(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall, top1_agreement) of two result lists (query_id, candidate_id, rank), over the queries of the truth."""
    t, f = truth.where(F.col("rank") <= k), found.where(F.col("rank") <= k)
    both = t.join(f.select("query_id", "candidate_id", F.col("rank").alias("_found")), ["query_id", "candidate_id"], "left")
    return both.agg(
        F.round(F.avg(F.col("_found").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("rank") == 1, (F.coalesce(F.col("_found"), F.lit(0)) == 1).cast("double"))), 6).alias("top1_agreement"),
    )


class ApproximateIndex:
    """Candidate search with random projections over unit vectors, where 1 - d*d/2 is the cosine, then exact scores."""

    def __init__(self, tables: int = 8, bucket: float = 0.7, seed: int = 11):
        self.tables, self.bucket, self.seed, self.model = tables, bucket, seed, None

    @staticmethod
    def _points(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        unit = df.where(F.col(vector_column).isNotNull() & (vector.norm(F.col(vector_column)) > vector.EPSILON))
        return unit.select(F.col(id_column).alias("id"), array_to_vector(vector.normalise(F.col(vector_column)).cast("array<double>")).alias("features"))

    def fit(self, df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
        from pyspark.ml.feature import BucketedRandomProjectionLSH

        points = self._points(df, id_column, vector_column)
        lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=self.bucket, numHashTables=self.tables, seed=self.seed)
        self.model = lsh.fit(points)
        return self.model.transform(points)

    def search(self, index: DataFrame, query: list[float], k: int) -> DataFrame:
        """(id, similarity) of about the k most similar points; up to ``EXTRA_CANDIDATES`` more are looked at."""
        from pyspark.ml.linalg import Vectors

        n = sum(x * x for x in query) ** 0.5
        near = self.model.approxNearestNeighbors(index, Vectors.dense([x / n for x in query]), k + EXTRA_CANDIDATES)
        similarity = F.greatest(F.least(1 - F.col("distCol") * F.col("distCol") / 2, F.lit(1.0)), F.lit(-1.0))
        return near.select("id", F.round(similarity, 6).alias("similarity")).orderBy(F.col("similarity").desc(), "id").limit(k)

    def save(self, folder: str, signature: dict) -> None:
        """The model and, renamed into place when complete, the manifest; both on the folder's own file system."""
        self.model.write().overwrite().save(f"{folder}/model")
        snapshot.put_text(SparkSession.active(), f"{folder}/manifest.json", json.dumps(signature, sort_keys=True))

    def load(self, folder: str) -> None:
        from pyspark.ml.feature import BucketedRandomProjectionLSHModel

        self.model = BucketedRandomProjectionLSHModel.load(f"{folder}/model")

    def prepare(self, df: DataFrame, id_column: str, vector_column: str, folder: str) -> tuple[DataFrame, str]:
        """(index, state it was found in): the saved index if it is current, else a new one, which is saved. The signature is that of all ids and vectors."""
        signature = hashing.table_signature(df, id_column, vector_column).first().asDict()
        state = index_state(folder, signature)
        if state == "current":
            self.load(folder)
            return self.model.transform(self._points(df, id_column, vector_column)), state
        index = self.fit(df, id_column, vector_column)
        self.save(folder, signature)
        return index, state


def index_state(folder: str, signature: dict) -> str:
    """current, empty_current, missing, stale or corrupt, by the manifest and the model's folder."""
    spark = SparkSession.active()
    text = snapshot.get_text(spark, f"{folder}/manifest.json")
    if text is None:
        return "missing"
    try:
        found = json.loads(text)
    except ValueError:
        return "corrupt"
    if not isinstance(found, dict) or "n_rows" not in found:
        return "corrupt"
    if found != signature:
        return "stale"
    if found["n_rows"] == 0:
        return "empty_current"
    return "current" if snapshot.exists(spark, f"{folder}/model") else "missing"


def even_sample(df: DataFrame, order: list[str], n: int, endpoints: bool = False) -> DataFrame:
    """n rows spread evenly over the order of unique columns; with ``endpoints`` the first and last row are among them.

    The places are i * total // n, or i * (total - 1) // (n - 1). Only the order columns are numbered, piece by piece; the rows are then picked by them.
    """
    total = df.count()
    n = min(n, total)
    if n <= 0:
        return df.limit(0)
    if endpoints and n > 1:
        places = [i * (total - 1) // (n - 1) for i in range(n)]
    else:
        places = [i * total // n for i in range(n)]
    wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "_row bigint")
    keys = row_numbers(df.select(*order), order).join(F.broadcast(wanted), "_row", "left_semi").drop("_row")
    return df.join(F.broadcast(keys), order, "left_semi")  # n keys
