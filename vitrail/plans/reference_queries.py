"""Queries of the catalog, search, evaluation and face operators over whole tables, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrail.functions import geometry, hashing, score, text, vector
from vitrail.functions.score import SimilaritySettings
from vitrail.operators import catalog, collections, detection, evaluate, faces, hybrid, ordering, profile, search, topk, verify
from vitrail.sources.tables import read_table
from vitrail.streaming import changes

QUERIES: dict = {}
ORACLE: dict = {}

REVISION = faces.EmbeddingRevision("idvec", "4", "c4-a", "align-2", 128)
DETECTOR = faces.Detector("facebox", "2.1", "r3-t60")
COLLECTION_FOLDERS = [(1, "E:\\Materials"), (1, "E:\\Facades\\raw"), (2, "D:\\Family\\Albums"), (2, "F:\\Scans\\Slides"), (3, "c:\\users\\public\\samples")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings")


def _stated(df: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return df.where(F.col("vec_id") % 50 == 0)


def _images(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "images")


def _first_and_last(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The earliest and the latest delivered row of every path."""
    i = _images(spark, d)
    return catalog.last_of_key(i, "path", [F.col("row_id")]), catalog.last_of_key(i, "path", [F.col("row_id").desc()])


_FIRST_LAST = """
f AS (SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY path ORDER BY row_id) = 1),
l AS (SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY path ORDER BY row_id DESC) = 1)
"""

# Vectors


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 10
""")
def vec_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 10 vectors of largest dot product with vector 0."""
    df = _vectors(spark, d)
    first = df.where("vec_id = 0").select("embedding").first()[0]
    return topk.exact_top_k(df, "vec_id", "embedding", list(first), 10)


_SCORES = """
s AS (SELECT a.vec_id AS query_id, a.label AS query_group, b.vec_id AS candidate_id, b.label AS candidate_group,
             round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
"""


@query(f"""
WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s)
SELECT query_id, candidate_id, score AS similarity, rank FROM r WHERE rank <= 10
""")
def vec_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar vectors of every stated query."""
    return topk.top_k_per_query(_stated(_vectors(spark, d)), _vectors(spark, d), "vec_id", "embedding", 10)


@query("""
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, 1.0::DOUBLE AS norm_after, TRUE AS is_unit FROM embeddings
""")
def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of all vectors before and after scaling, from copies of three times the length."""
    df = _vectors(spark, d)
    after = vector.normalise(F.transform("embedding", lambda x: x * 3))
    return df.select("vec_id", F.round(vector.norm(F.col("embedding")), 5).alias("norm"), F.round(vector.norm(after), 5).alias("norm_after"), vector.is_unit(F.col("embedding")).alias("is_unit"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.all_scores(_stated(_vectors(spark, d)), _vectors(spark, d), "vec_id", "label", "embedding")


_RANKS = f"""
WITH {_SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS n FROM s),
r AS (SELECT query_id, min(n) FILTER (WHERE query_group = candidate_group) AS rank FROM o GROUP BY query_id)
"""


@query(_RANKS + """
SELECT count(*) AS queries, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5,
 round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg((rank <= 25)::INT), 6) AS recall_at_25,
 round(avg(1.0 / rank::DOUBLE), 6) AS mrr, round(avg(rank), 6) AS mean_rank FROM r WHERE rank IS NOT NULL
""")
def recall_mrr_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank of the first vector of the same label."""
    return evaluate.rank_metrics(evaluate.first_relevant_rank(_pairs(spark, d)))


@query(f"""
WITH {_SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s)
SELECT query_id, rank FROM o WHERE candidate_id = query_id + 1
""")
def target_rank(spark: SparkSession, d: str) -> DataFrame:
    """The place of the following vector among all others."""
    targets = _stated(_vectors(spark, d)).select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("candidate_id"))
    return evaluate.target_rank(_pairs(spark, d), targets)


def _identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("query_id", F.col("query_group").alias("query_person"), "candidate_id", F.col("candidate_group").alias("candidate_person"), F.col("score").cast("float").alias("similarity"))


_NEAREST = "max(distance) FILTER (WHERE same = {s} AND k = floor((n - 1) * {p}::DOUBLE + 0.5))"


@query(_RANKS + f""",
m AS (SELECT count(*) AS queries, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS recall_at_1, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall_at_5,
  round(avg(coalesce((rank <= 10)::INT, 0)), 6) AS recall_at_10, round(avg(coalesce(1.0 / rank::DOUBLE, 0)), 6) AS mrr FROM r),
d AS (SELECT query_group = candidate_group AS same, round(1 - score::FLOAT::DOUBLE, 9) AS distance FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY same ORDER BY distance) - 1 AS k, count(*) OVER (PARTITION BY same) AS n FROM d),
x AS (SELECT count(*) FILTER (WHERE same) AS same_pairs, count(*) FILTER (WHERE NOT same) AS different_pairs,
  round(avg(distance) FILTER (WHERE same), 6) AS same_mean, round(avg(distance) FILTER (WHERE NOT same), 6) AS different_mean,
  round({_NEAREST.format(s="TRUE", p="0.5")}, 6) AS same_p50, round({_NEAREST.format(s="TRUE", p="0.9")}, 6) AS same_p90,
  round({_NEAREST.format(s="FALSE", p="0.1")}, 6) AS different_p10, round({_NEAREST.format(s="FALSE", p="0.5")}, 6) AS different_p50 FROM k)
SELECT * FROM m, x
""")
def identity_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and distances of same and different pairs."""
    return evaluate.identity_metrics(_identity_pairs(spark, d))


_SWEEP = f"""
WITH {_SCORES}, p AS (SELECT query_group = candidate_group AS same, score::FLOAT::DOUBLE AS sim FROM s),
c AS (SELECT same, sim, count(*) AS n FROM p GROUP BY 1, 2),
t AS (SELECT i::INT AS step, -1.0::DOUBLE + 2.0::DOUBLE * i / 200.0::DOUBLE AS threshold FROM range(201) r(i)),
w AS (SELECT step, threshold, coalesce(sum(n) FILTER (WHERE same AND sim >= threshold), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE NOT same AND sim >= threshold), 0)::BIGINT AS fp,
  coalesce(sum(n) FILTER (WHERE NOT same AND sim < threshold), 0)::BIGINT AS tn, coalesce(sum(n) FILTER (WHERE same AND sim < threshold), 0)::BIGINT AS fn FROM t, c GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall FROM w),
sw AS (SELECT step, threshold, tp, fp, tn, fn, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM pr)
"""


@query(_SWEEP + "SELECT * FROM sw")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Accepts and rejects at every threshold."""
    p = _identity_pairs(spark, d)
    return evaluate.threshold_sweep(p.select((F.col("query_person") == F.col("candidate_person")).alias("same"), "similarity"))


@query(_SWEEP + """
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 6) AS far,
 round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn::DOUBLE / (fn + tp) END, 6) AS frr FROM sw ORDER BY sw.f1 DESC, fp, sw.threshold DESC LIMIT 1
""")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of best F1."""
    p = _identity_pairs(spark, d)
    return evaluate.best_threshold(p.select((F.col("query_person") == F.col("candidate_person")).alias("same"), "similarity"))


_PLACES = "WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)"


@query(_PLACES + "SELECT vec_id FROM o WHERE k IN (SELECT i * (SELECT max(n) FROM o) // 32 FROM range(32) r(i))")
def even_sample_floor(spark: SparkSession, d: str) -> DataFrame:
    """32 evenly spread vectors."""
    return topk.even_sample(_vectors(spark, d).select("vec_id"), ["vec_id"], 32)


@query(_PLACES + "SELECT vec_id FROM o WHERE k IN (SELECT i * ((SELECT max(n) FROM o) - 1) // 23 FROM range(24) r(i))")
def even_sample_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """24 evenly spread vectors with the first and the last."""
    return topk.even_sample(_vectors(spark, d).select("vec_id"), ["vec_id"], 24, endpoints=True)


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT 'library-' || (vec_id % 3) AS library_id, vec_id, label, round(list_dot_product(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
SELECT * FROM s ORDER BY similarity DESC, library_id, vec_id LIMIT 50
""")
def multi_library_union(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best over three libraries put together."""
    df = _vectors(spark, d)
    first = list(df.where("vec_id = 0").select("embedding").first()[0])
    all_rows = catalog.union_libraries({f"library-{k}": df.where(F.col("vec_id") % 3 == k) for k in range(3)})
    scored = all_rows.select("library_id", "vec_id", "label", F.round(vector.dot_literal(F.col("embedding"), first), 6).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "library_id", "vec_id").limit(50)


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) = 1 ORDER BY similarity DESC, vec_id LIMIT 5
""")
def best_per_group_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best vector of each label, then the best 5 of these."""
    df = _vectors(spark, d)
    first = list(df.where("vec_id = 0").select("embedding").first()[0])
    scored = df.select("vec_id", "label", F.round(vector.dot_literal(F.col("embedding"), first), 6).alias("similarity"))
    return topk.best_per_group(scored, ["label"], [F.col("similarity").desc(), F.col("vec_id")], 5)


@query()
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the approximate index for the stated queries, with themselves, at 10."""
    df, k = _vectors(spark, d), 10
    index = topk.ApproximateIndex()
    points = index.fit(df, "vec_id", "embedding")
    queries = points.where(F.col("id") % 50 == 0)
    near = index.model.approxSimilarityJoin(queries, points, 1.5, "distance").select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("candidate_id"), "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "candidate_id")
    found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return topk.overlap(found, topk.top_k_per_query(_stated(df), df, "vec_id", "embedding", k, exclude_self=False), k)


@query("SELECT count(*) AS groups, min(n) AS smallest, max(CASE WHEN k = floor((c - 1) * 0.5::DOUBLE + 0.5) THEN n END) AS p50, max(n) AS largest FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label))")
def label_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Number and sizes of the label groups."""
    return evaluate.group_sizes(_vectors(spark, d), "label")


@query("SELECT row_id FROM images WHERE extension IN (SELECT extension FROM images WHERE extension IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)")
def rows_with_group_positives(spark: SparkSession, d: str) -> DataFrame:
    """Images whose extension has two rows or more."""
    return evaluate.with_group_positives(_images(spark, d), "extension").select("row_id")


@query()
def index_signature(spark: SparkSession, d: str) -> DataFrame:
    """The signature that tells whether an index of all vectors is current."""
    return hashing.table_signature(_vectors(spark, d), "vec_id", "embedding")


# Descriptor scores against one image


def _literal(spark: SparkSession, d: str) -> dict:
    """The descriptors of the first image that has all of them."""
    i = _images(spark, d)
    v = F.col("embedding")
    complete = (F.size("color_histogram") == 64) & (F.size("material_texture") == 48) & (F.col("material_texture_version") == 1)
    complete = complete & F.col("visual_hash").isNotNull() & F.col("dominant.r").isNotNull() & (F.size(v) == 64) & vector.all_finite(v) & (vector.norm(v) > 0)
    return hybrid.query_descriptors(i, i.where(complete & F.col("path").isNotNull()).agg(F.min("row_id")).first()[0])


_FINITE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 64"
_Q = f"""q AS (SELECT visual_hash AS qh, color_histogram AS qc, material_texture AS qt, dominant AS qd, embedding AS qe, path AS qp FROM images
 WHERE visual_hash IS NOT NULL AND len(color_histogram) = 64 AND len(material_texture) = 48 AND material_texture_version = 1 AND dominant.r IS NOT NULL AND path IS NOT NULL
 AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY row_id LIMIT 1)"""
_MIN_SUM = "least(1.0, greatest(0.0, list_sum(list_transform(list_zip({a}, {b}), lambda z: least(z[1], z[2])::DOUBLE))))"


@query(f"WITH {_Q} SELECT row_id, round(1 - bit_count(xor(visual_hash, qh)) / 64.0::DOUBLE, 6) AS score FROM images, q")
def dhash_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Shares of equal hash bits."""
    q = _literal(spark, d)
    return _images(spark, d).select("row_id", F.round(score.hash_similarity(F.lit(q["visual_hash"]).cast("bigint"), F.col("visual_hash")), 6).alias("score"))


@query(f"WITH {_Q} SELECT row_id, round(CASE WHEN color_histogram IS NOT NULL THEN CASE WHEN len(color_histogram) <> 64 THEN 0 ELSE {_MIN_SUM.format(a='color_histogram', b='qc')} END END, 8) AS score FROM images, q")
def hist_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Histogram intersections."""
    q = F.array(*[F.lit(float(x)) for x in _literal(spark, d)["color_histogram"]]).cast("array<float>")
    return _images(spark, d).select("row_id", F.round(score.histogram_intersection(q, F.col("color_histogram")), 8).alias("score"))


_SEGMENT = "+".join(f"{_MIN_SUM.format(a=f'material_texture[{s + 1}:{e}]', b=f'qt[{s + 1}:{e}]')}" for s, e in ((0, 8), (8, 16), (16, 32), (32, 48)))
_TEXTURE = f"CASE WHEN len(material_texture) = 48 AND len(qt) = 48 THEN least(1.0, ({_SEGMENT}) / 4) END"


@query(f"WITH {_Q} SELECT row_id, round({_TEXTURE}, 8) AS score FROM images, q")
def texture_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Texture similarities."""
    q = F.array(*[F.lit(float(x)) for x in _literal(spark, d)["material_texture"]]).cast("array<float>")
    return _images(spark, d).select("row_id", F.round(score.texture_similarity(q, F.col("material_texture")), 8).alias("score"))


_HASH = "(1 - bit_count(xor(visual_hash, qh)) / 64.0::DOUBLE)"
_BLEND = "CASE WHEN h IS NULL THEN t WHEN t IS NULL THEN h ELSE least(1.0, greatest(0.35 * h + 0.65 * t, 0.92 * h)) END"


@query(f"WITH {_Q}, x AS (SELECT row_id, {_HASH} AS h, {_TEXTURE} AS t FROM images, q) SELECT row_id, round({_BLEND}, 8) AS score FROM x")
def texture_dhash_blend(spark: SparkSession, d: str) -> DataFrame:
    """Texture and hash put together."""
    q = _literal(spark, d)
    t = score.texture_similarity(F.array(*[F.lit(float(x)) for x in q["material_texture"]]).cast("array<float>"), F.col("material_texture"))
    h = score.hash_similarity(F.lit(q["visual_hash"]).cast("bigint"), F.col("visual_hash"))
    return _images(spark, d).select("row_id", F.round(score.blend_texture_and_hash(h, t), 8).alias("score"))


_RGB = "least(1.0, greatest(0.0, 1 - sqrt(pow((dominant.r - qd.r)::DOUBLE, 2) + pow((dominant.g - qd.g)::DOUBLE, 2) + pow((dominant.b - qd.b)::DOUBLE, 2)) / (255 * sqrt(3.0::DOUBLE))))"


@query(f"WITH {_Q} SELECT row_id, round(CASE WHEN dominant.r IS NOT NULL AND dominant.g IS NOT NULL AND dominant.b IS NOT NULL THEN {_RGB} END, 6) AS score FROM images, q")
def rgb_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of the dominant colours."""
    q = _literal(spark, d)["dominant"]
    return _images(spark, d).select("row_id", F.round(score.rgb_similarity(F.struct(*[F.lit(v).alias(c) for v, c in zip(q, "rgb")]), F.col("dominant")), 6).alias("score"))


_REDMEAN = """least(1.0, sqrt((2 + ((dominant.r + {r}) * 0.5::DOUBLE) / 256) * pow((dominant.r - {r})::DOUBLE, 2) + 4 * pow((dominant.g - {g})::DOUBLE, 2)
 + (2 + (255 - (dominant.r + {r}) * 0.5::DOUBLE) / 256) * pow((dominant.b - {b})::DOUBLE, 2)) / 765)"""


@query(f"SELECT row_id, round({_REDMEAN.format(r=180, g=150, b=120)}, 6) AS distance FROM images WHERE {_REDMEAN.format(r=180, g=150, b=120)} <= 0.22")
def redmean_filter(spark: SparkSession, d: str) -> DataFrame:
    """Images of a colour near brown."""
    wanted = F.struct(*[F.lit(v).alias(c) for v, c in zip((180, 150, 120), "rgb")])
    return search.color_filter(_images(spark, d), (180, 150, 120)).select("row_id", F.round(score.redmean_distance(wanted, F.col("dominant")), 6).alias("distance"))


def _clean_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Images whose broken vectors are taken as missing."""
    v = F.col("embedding")
    return _images(spark, d).withColumn("embedding", F.when((F.size(v) == 64) & vector.all_finite(v), v))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_EE, _EQ = _DOT.format(a="e", b="e"), _DOT.format(a="e", b="qed")
_METRICS = f"""
WITH {_Q}, qn AS (SELECT *, qe::DOUBLE[] AS qed, sqrt(list_sum(list_transform(qe::DOUBLE[], lambda x: x * x))) AS qnorm FROM q),
i AS (SELECT *, CASE WHEN {_FINITE} THEN embedding::DOUBLE[] END AS e FROM images),
x AS (SELECT row_id, path, file_name, replace(path, '/', '\\') = replace(qp, '/', '\\') AS is_exact, {_HASH} AS h,
  CASE WHEN material_texture_version = 1 THEN {_TEXTURE} END AS t,
  CASE WHEN color_histogram IS NOT NULL THEN CASE WHEN len(color_histogram) <> 64 THEN 0 ELSE {_MIN_SUM.format(a='color_histogram', b='qc')} END END AS hist,
  CASE WHEN dominant.r IS NOT NULL THEN {_RGB} END AS dom,
  CASE WHEN e IS NOT NULL THEN least(1.0, greatest(0.0, CASE WHEN coalesce(embedding_normalized, FALSE) THEN {_EQ} / qnorm
    WHEN {_EE} <= 1.1920929e-07 THEN -1 ELSE {_EQ} / qnorm / sqrt({_EE}) END)) END AS clip FROM i, qn),
m AS (SELECT row_id, path, file_name, coalesce(is_exact, FALSE) AS is_exact, CASE WHEN is_exact THEN 1.0 ELSE {_BLEND} END AS hash_score, CASE WHEN is_exact THEN 1.0 ELSE hist END AS hist_score,
  CASE WHEN is_exact THEN 1.0 ELSE clip END AS clip_score, CASE WHEN is_exact THEN 1.0 ELSE dom END AS dom_score,
  coalesce(is_exact, FALSE) OR coalesce(NOT coalesce(hist * 100 < {{lo}}, FALSE) AND least(1.0, greatest(0.0, 1 - dom)) * 100 <= {{hi}}, FALSE) AS gate FROM x)
"""


def _hybrid_sql(clip: float, dist: float, tex: float, dom: float, lo: float, hi: float, rows: str = "m", limit: int = 2000) -> str:
    parts = [(dom, "dom_score"), (dist, "hist_score"), (tex, "hash_score"), (clip, "clip_score")]
    used = [(w, c) for w, c in parts if w > 0]
    top = " + ".join(f"coalesce({w}::DOUBLE * {c}, 0)" for w, c in used) or "0"
    weight = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for w, c in used) or "0"
    s = f"CASE WHEN is_exact THEN 1.0 WHEN ({weight}) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ({top}) / ({weight}))) END"
    fold = "translate(file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return _METRICS.format(lo=lo, hi=hi), f"SELECT row_id, is_exact, round({s}, 6)::DOUBLE AS score FROM {rows} WHERE gate ORDER BY is_exact DESC, round({s}, 6) DESC, {fold}, path, row_id LIMIT {limit}"


def _hybrid(spark: SparkSession, d: str, settings: SimilaritySettings) -> DataFrame:
    return hybrid.similar(_clean_catalog(spark, d), _literal(spark, d), settings).select("row_id", "is_exact", F.round("score", 6).alias("score"))


@query("".join(_hybrid_sql(44, 31, 20, 5, 30, 30)))
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search with the default weights."""
    return _hybrid(spark, d, SimilaritySettings())


@query("".join(_hybrid_sql(10, 60, 0, 30, 20, 50)))
def hybrid_custom_weights(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search with other weights and a wider gate."""
    return _hybrid(spark, d, SimilaritySettings(10, 60, 0, 30, True, 20, 50))


@query("".join(_hybrid_sql(0, 0, 0, 0, 30, 30)))
def hybrid_zero_weights(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search without weights: only the exact row has a score."""
    return _hybrid(spark, d, SimilaritySettings(0, 0, 0, 0))


@query(_METRICS.format(lo=30, hi=30) + "SELECT row_id, gate AS passes_gate FROM m")
def color_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which images pass the colour gate."""
    q, s = _literal(spark, d), SimilaritySettings()
    m = hybrid.with_metrics(_clean_catalog(spark, d), q, s, text.key_native(F.col("path")) == text.key_native(F.lit(q["path"])))
    return m.select("row_id", "passes_gate")


def _two_stage_sql() -> str:
    head = _METRICS.format(lo=0, hi=100)
    tops = " UNION ".join(f"SELECT row_id FROM (SELECT row_id FROM m WHERE gate AND NOT is_exact AND {c} IS NOT NULL ORDER BY round({c}, 6) DESC, row_id LIMIT 300)" for c in ("hist_score", "hash_score", "clip_score", "dom_score"))
    return head + f"SELECT row_id FROM m WHERE is_exact UNION {tops}"


@query(_two_stage_sql())
def two_stage_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all components, with limits that small tables reach."""
    q, s = _literal(spark, d), SimilaritySettings(min_color_distribution_match=0, max_dominant_color_difference=100)
    m = hybrid.with_metrics(_clean_catalog(spark, d), q, s, text.key_native(F.col("path")) == text.key_native(F.lit(q["path"])))
    for c in ("histogram_score", "hash_score", "clip_score", "dominant_score"):
        m = m.withColumn(c, F.round(c, 6))
    return hybrid.candidates(m, s, 10_000, "row_id", most_results=100, most_candidates=300, min_rows=0).select("row_id")


# Text


def _has(token: str) -> str:
    t = token.replace("'", "''")
    fold = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return "(" + " OR ".join(f"coalesce(contains({fold.format(c=c)}, '{t}'), FALSE)" for c in search.SEARCHED) + ")"


@query(f"SELECT row_id FROM images WHERE {_has('stone')} AND {_has('til')}")
def text_and_substring(spark: SparkSession, d: str) -> DataFrame:
    """Images with both tokens."""
    return search.search_text(_images(spark, d), "STONE til").select("row_id")


@query(f"SELECT row_id FROM images WHERE {_has('x')} AND {_has('60')}")
def text_short_token(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of one and two characters."""
    return search.search_text(_images(spark, d), "x 60").select("row_id")


@query(f"SELECT row_id FROM images WHERE {_has('100%')} OR {_has('_00')}")
def text_escape_wildcards(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with characters that are wildcards elsewhere."""
    i = _images(spark, d)
    return search.search_text(i, "100%").select("row_id").unionByName(search.search_text(i, "_00").select("row_id")).distinct()


@query("SELECT row_id FROM images WHERE FALSE")
def text_empty(spark: SparkSession, d: str) -> DataFrame:
    """An empty query finds nothing."""
    return search.search_text(_images(spark, d), "  ").select("row_id")


_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH g AS (SELECT DISTINCT row_id, unnest(list_concat(
  list_transform(range(1, greatest(1, length(coalesce(file_name, '')) - 1)), lambda i: substr({_FOLD.format(c="coalesce(file_name, '')")}, i, 3)),
  list_transform(range(1, greatest(1, length(coalesce(description, '')) - 1)), lambda i: substr({_FOLD.format(c="coalesce(description, '')")}, i, 3)))) AS trigram FROM images)
SELECT trigram, count(*) AS n_rows FROM g GROUP BY trigram
""")
def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    """How many images hold each trigram of name and description."""
    return search.trigram_postings(_images(spark, d), "row_id", ("file_name", "description")).groupBy("trigram").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT row_id FROM images WHERE {_has('granite')}")
def text_by_postings(spark: SparkSession, d: str) -> DataFrame:
    """A token found through the postings, then checked."""
    i = _images(spark, d)
    return search.search_postings(i, search.trigram_postings(i, "row_id", search.SEARCHED), "row_id", "Granite", search.SEARCHED).select("row_id")


@query(f"SELECT DISTINCT path FROM images WHERE {_FOLD.format(c='path')} > 'e:\\m' ORDER BY {_FOLD.format(c='path')}, path LIMIT 200")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The 200 paths that follow a cursor, without regard to case."""
    return search.page_after(_images(spark, d).select("path").distinct(), "path", "E:\\m", 200, ignore_case=True)


@query(f"""
WITH m AS (SELECT path FROM images WHERE starts_with(path, 'E:\\Materials\\') OR starts_with(path, 'E:\\Facades\\raw\\'))
SELECT row_id FROM images WHERE path IN (SELECT path FROM m) AND {_has('e')} AND {_REDMEAN.format(r=180, g=150, b=120)} <= 0.3
""")
def combined_visible_filter(spark: SparkSession, d: str) -> DataFrame:
    """Collection, text and colour together."""
    i = _images(spark, d)
    folders = spark.createDataFrame(COLLECTION_FOLDERS, "collection_id bigint, folder_path string").where("collection_id = 1")
    m = collections.members(i, folders, spark.createDataFrame([], "collection_id bigint, file_path string"))
    return search.visible(i, members=m, query="e", color=(180, 150, 120), tolerance=0.3).select("row_id")


# Markup


@query("""
SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s)<a[^>]*>(.*?)</a>', 1),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS names
FROM documents
""")
def markup_elements(spark: SparkSession, d: str) -> DataFrame:
    """The contents of all links."""
    return read_table(spark, d, "documents").select("doc_id", text.elements(F.col("text"), "a").alias("names"))


@query("""SELECT doc_id, nullif(regexp_extract(text, 'href="([^"]*)"', 1), '') AS target FROM documents""")
def markup_attribute(spark: SparkSession, d: str) -> DataFrame:
    """The first link target."""
    return read_table(spark, d, "documents").select("doc_id", text.attribute(F.col("text"), "href").alias("target"))


_STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '<[^>]*$', '', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"""


@query(f"SELECT doc_id, md5({_STRIP.format(c='text')}) AS stripped FROM documents")
def markup_strip(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of pages without their tags."""
    return read_table(spark, d, "documents").select("doc_id", F.md5(text.strip_markup(F.col("text")).cast("binary")).alias("stripped"))


@query("""
SELECT row_id, list_aggregate(list_filter(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_position(k, k[i]) = i THEN v[i] END), lambda x: x IS NOT NULL), 'string_agg', ', ') AS kept
FROM (SELECT row_id, v, list_transform(v, lambda x: translate(trim(x), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k
      FROM (SELECT row_id, list_filter(string_split(keywords, ', '), lambda x: trim(x) <> '') AS v FROM images WHERE keywords IS NOT NULL)) WHERE len(v) > 0
""")
def keyword_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated values without repeats."""
    kept = F.array_join(text.dedup_keep_first(F.split("keywords", ", ")), ", ")
    return _images(spark, d).where(F.col("keywords").isNotNull()).select("row_id", kept.alias("kept")).where(F.col("kept") != "")


# Catalog


@query(f"SELECT row_id, row_number() OVER (ORDER BY {_FOLD.format(c='file_name')}, path, row_id) - 1 AS place FROM images WHERE file_name IS NOT NULL AND path IS NOT NULL")
def nocase_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of every image by name without regard to case, numbered piece by piece."""
    i = _images(spark, d).where(F.col("file_name").isNotNull() & F.col("path").isNotNull()).select("row_id", "path", text.nocase(F.col("file_name")).alias("k"))
    return ordering.row_numbers(i, ["k", "path", "row_id"]).select("row_id", F.col("_row").alias("place"))


@query("""
SELECT row_id, embedding IS NULL OR len(embedding) > 0 AS valid_bytes,
 coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = len(embedding)
  AND abs(sqrt(list_sum(list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x::DOUBLE * x::DOUBLE END))) - 1) <= 1e-3, FALSE) AS is_unit FROM images
""")
def verify_dims(spark: SparkSession, d: str) -> DataFrame:
    """Whether the bytes and the length of every stored vector are in order."""
    sized = verify.with_blob_sizes(_images(spark, d))
    return sized.select("row_id", vector.valid_dimension(F.col("embedding_bytes"), F.col("embedding_dim")).alias("valid_bytes"), vector.is_unit(F.col("embedding")).alias("is_unit"))


@query("""
SELECT row_id, round(CASE WHEN len(material_texture) = 48 THEN list_sum(material_texture[1:16])::DOUBLE END, 4) AS gradient_mass, round(CASE WHEN len(color_histogram) > 0 THEN list_sum(color_histogram)::DOUBLE END, 4) AS histogram_mass FROM images
""")
def descriptor_mass(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the gradient part and the histogram of every image, for checks of stored descriptors."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    t, h = F.col("material_texture"), F.col("color_histogram")
    return _images(spark, d).select(
        "row_id", F.round(F.when(F.size(t) == 48, total(F.slice(t, 1, 16))), 4).alias("gradient_mass"), F.round(F.when(F.size(h) > 0, total(h)), 4).alias("histogram_mass")
    )


_PREFIX = "CASE WHEN right(root, 1) IN ('\\', '/') THEN root ELSE root || '\\' END"


@query(f"""
SELECT row_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, CASE WHEN path = root THEN '' WHEN starts_with(path, {_PREFIX}) THEN substr(path, length({_PREFIX}) + 1) END AS relative,
 translate(path, '\\ABCDEFGHIJKLMNOPQRSTUVWXYZ', '/abcdefghijklmnopqrstuvwxyz') AS forward_key FROM images
""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    """Name, relative path and key of every image."""
    p = F.col("path")
    return _images(spark, d).select("row_id", text.file_name(p).alias("name"), text.relative_to(p, F.col("root")).alias("relative"), text.key_forward(p).alias("forward_key"))


@query("""
SELECT path, max_by(root_path, length(root_path)) AS root FROM (
  SELECT p.path, r.path AS root_path FROM (SELECT DISTINCT path FROM images) p LEFT JOIN roots r
  ON p.path = r.path OR starts_with(p.path, r.path || '\\') OR starts_with(p.path, r.path || '/')) GROUP BY path
""")
def longest_prefix_root(spark: SparkSession, d: str) -> DataFrame:
    """The longest registered root of every path."""
    return catalog.owning_root(_images(spark, d).select("path").distinct(), read_table(spark, d, "roots")).select("path", "root")


_RULES = "rules(collection_id, folder) AS (VALUES " + ", ".join("({}, '{}')".format(c, f) for c, f in COLLECTION_FOLDERS) + ")"


def _folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COLLECTION_FOLDERS, "collection_id bigint, folder_path string")


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "collection_id bigint, file_path string")


_MEMBERS = "SELECT DISTINCT collection_id::BIGINT AS collection_id, path FROM {t}, rules WHERE path = folder OR starts_with(path, folder || '\\') OR starts_with(path, folder || '/')"


@query(f"WITH {_RULES} " + _MEMBERS.format(t="images"))
def prefix_membership(spark: SparkSession, d: str) -> DataFrame:
    """Members of collections by folder rules."""
    return collections.members(_images(spark, d), _folders(spark), _files(spark))


@query(f"WITH {_RULES}, i AS ({_MEMBERS.format(t='images')}), x AS ({_MEMBERS.format(t='discovered_images')}), c(id) AS (VALUES (1::BIGINT), (2), (3), (4))" + """
SELECT id, coalesce(ni, 0) AS indexed, coalesce(nd, 0) AS discovered, greatest(coalesce(ni, 0), coalesce(nd, 0)) AS total
FROM c LEFT JOIN (SELECT collection_id, count(*) AS ni FROM i GROUP BY 1) a ON a.collection_id = id LEFT JOIN (SELECT collection_id, count(*) AS nd FROM x GROUP BY 1) b ON b.collection_id = id
""")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    """Indexed and discovered members of every collection."""
    c = spark.createDataFrame([(k, f"c{k}") for k in range(1, 5)], "id bigint, name string")
    return collections.counts(c, _images(spark, d), read_table(spark, d, "discovered_images"), _folders(spark), _files(spark))


@query(f"""
WITH {_RULES} SELECT DISTINCT row_id FROM images, rules WHERE collection_id IN (1, 3)
AND ({_FOLD.format(c='path')} = {_FOLD.format(c='folder')} OR starts_with({_FOLD.format(c='path')}, {_FOLD.format(c='folder')} || '\\') OR starts_with({_FOLD.format(c='path')}, {_FOLD.format(c='folder')} || '/'))
""")
def face_scope(spark: SparkSession, d: str) -> DataFrame:
    """Images in collections with face analysis."""
    on = spark.createDataFrame([(1, True), (3, True)], "collection_id bigint, enabled boolean")
    return collections.in_face_scope(_images(spark, d), on, _folders(spark), _files(spark)).select("row_id")


@query(f"WITH {_FIRST_LAST} SELECT l.path, CASE WHEN l.size IS NOT DISTINCT FROM f.size AND l.modified IS NOT DISTINCT FROM f.modified THEN 'unchanged' ELSE 'changed' END AS status FROM l JOIN f ON l.path = f.path")
def change_diff(spark: SparkSession, d: str) -> DataFrame:
    """New, changed and unchanged files between the first and the last delivery."""
    first, last = _first_and_last(spark, d)
    return catalog.changes(last.where(F.col("path").isNotNull()).select("path", "size", "modified"), first)


@query(f"""
WITH {_FIRST_LAST}, n AS (SELECT * FROM l WHERE row_id NOT IN (SELECT row_id FROM f))
SELECT f.path, coalesce(n.row_id, f.row_id) AS row_id, CASE WHEN n.path IS NOT NULL THEN n.size ELSE f.size END AS size, CASE WHEN n.path IS NOT NULL THEN n.description ELSE f.description END AS description,
 coalesce(f.last_seen_scan, n.last_seen_scan) AS last_seen_scan, CASE WHEN n.path IS NOT NULL THEN 0 ELSE f.material_texture_version END AS material_texture_version,
 CASE WHEN n.path IS NULL THEN f.content_fingerprint END AS content_fingerprint FROM f LEFT JOIN n ON f.path = n.path
""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery with later rows merged into it; derived columns of merged rows are reset."""
    first, last = _first_and_last(spark, d)
    new = last.join(first.select("row_id"), "row_id", "left_anti")
    kept = ["path", "row_id", "size", "description", "last_seen_scan", "material_texture_version", "content_fingerprint"]
    return catalog.upsert(first.select(*kept), new.select(*kept[:4], "last_seen_scan"))


@query(f"""
WITH {_FIRST_LAST} SELECT f.path, coalesce(l.description, f.description) AS description, coalesce(l.keywords, f.keywords) AS keywords FROM f JOIN l ON f.path = l.path
""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the last delivery put into the first where there are any."""
    first, last = _first_and_last(spark, d)
    return catalog.update_columns(first.select("path", "description", "keywords"), last.select("path", "description", "keywords"))


@query("WITH g AS (SELECT max(last_seen_scan) AS g FROM images) SELECT row_id FROM images, g WHERE root IS NULL OR last_seen_scan IS NULL OR last_seen_scan = g")
def stale_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What stays when all roots were scanned to the end."""
    i = _images(spark, d)
    newest = i.agg(F.max("last_seen_scan")).first()[0]
    clean = [r.root for r in i.where(F.col("root").isNotNull()).select("root").distinct().collect()]  # as many as there are roots
    return catalog.sweep(i, newest, clean).select("row_id")


@query("SELECT path FROM discovered_images WHERE path NOT IN (SELECT path FROM images WHERE path IS NOT NULL)")
def not_in_delete(spark: SparkSession, d: str) -> DataFrame:
    """Discovered paths that aren't indexed."""
    return read_table(spark, d, "discovered_images").join(_images(spark, d).select("path"), "path", "left_anti").select("path")


@query("SELECT (greatest(coalesce((SELECT max(last_seen_scan) FROM images), 0), coalesce((SELECT max(last_seen_scan) FROM discovered_images), 0)) + 1)::BIGINT AS generation")
def next_generation(spark: SparkSession, d: str) -> DataFrame:
    """The number of the next scan."""
    return catalog.next_generation(_images(spark, d), read_table(spark, d, "discovered_images"))


@query("""
SELECT r.path, coalesce(i.n, 0) AS indexed, greatest(coalesce(x.n, 0), coalesce(i.n, 0)) AS discovered FROM roots r
LEFT JOIN (SELECT root, count(*) AS n FROM images GROUP BY 1) i ON i.root = r.path LEFT JOIN (SELECT root, count(*) AS n FROM discovered_images GROUP BY 1) x ON x.root = r.path
""")
def root_counts(spark: SparkSession, d: str) -> DataFrame:
    """Indexed and discovered images of every root."""
    return catalog.root_counts(read_table(spark, d, "roots"), _images(spark, d), read_table(spark, d, "discovered_images"))


@query(f"SELECT row_id FROM images WHERE NOT coalesce(path = 'E:\\Facades' OR starts_with({_FOLD.format(c='path')}, 'e:\\facades\\'), FALSE)")
def delete_subtree(spark: SparkSession, d: str) -> DataFrame:
    """What stays when a folder is deleted."""
    return catalog.delete_subtree(_images(spark, d), "E:\\Facades")[0].select("row_id")


@query("SELECT row_id FROM images WHERE visual_hash IS NULL OR color_histogram IS NULL OR material_texture IS NULL OR material_texture_version <> 1")
def needs_descriptor(spark: SparkSession, d: str) -> DataFrame:
    """Images that lack a current descriptor."""
    return catalog.needs_descriptor(_images(spark, d)).select("row_id")


@query("SELECT row_id FROM images WHERE embedding IS NULL")
def needs_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Images without a vector."""
    return catalog.needs_embedding(_images(spark, d)).select("row_id")


@query("SELECT row_id, path, root FROM images WHERE root = 'E:\\Materials' AND (path = root OR starts_with(path, root || '\\'))")
def portable_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A root written to its portable table and read back."""
    i = _images(spark, d).select("row_id", "path", "root")
    portable = catalog.replace_root(i, i, "E:\\Materials")
    return catalog.import_root(i.limit(0), portable, "E:\\Materials")


@query("SELECT row_id, CASE WHEN path = 'E:\\Materials' THEN 'G:\\New' WHEN starts_with(path, 'E:\\Materials\\') THEN 'G:\\New\\' || substr(path, 14) ELSE path END AS path FROM images")
def relocate_library(spark: SparkSession, d: str) -> DataFrame:
    """All paths after a library moved."""
    return catalog.relocate(_images(spark, d).select("row_id", "path"), "path", "E:\\Materials", "G:\\New")


@query("SELECT path, greatest(coalesce(size, 0), 0) AS size, greatest(coalesce(modified, 0), 0) AS modified, greatest(coalesce(width, 0), 0) AS width, greatest(coalesce(height, 0), 0) AS height, content_fingerprint, embedding IS NOT NULL AS has_embedding FROM images")
def file_states(spark: SparkSession, d: str) -> DataFrame:
    """What change detection needs of every image."""
    return catalog.file_states(_images(spark, d))


@query(f"""
WITH {_FIRST_LAST}, lst AS (SELECT path, size, modified FROM l WHERE path IN (SELECT path FROM discovered_images)),
j AS (SELECT f.*, lst.size AS s2, lst.modified AS m2, lst.path IS NOT NULL AS there FROM f LEFT JOIN lst ON f.path = lst.path),
u AS (SELECT CASE WHEN there AND s2 <> greatest(coalesce(size, 0), 0) THEN 'source_size_changed' END AS kind FROM j
 UNION ALL SELECT CASE WHEN there AND m2 IS DISTINCT FROM modified THEN 'source_modified_changed' END FROM j
 UNION ALL SELECT CASE WHEN NOT there THEN 'missing_source' END FROM j
 UNION ALL SELECT CASE WHEN len(embedding) = 0 THEN 'invalid_embedding' END FROM j
 UNION ALL SELECT CASE WHEN len(color_histogram) = 0 THEN 'invalid_color_histogram' END FROM j
 UNION ALL SELECT CASE WHEN len(material_texture) = 0 THEN 'invalid_material_texture' END FROM j)
SELECT kind, count(*) AS n FROM u WHERE kind IS NOT NULL GROUP BY kind
""")
def verify_library(spark: SparkSession, d: str) -> DataFrame:
    """Problems of stored rows against the files found last, by kind. Drives are made folders, so that all paths are relative."""
    first, last = _first_and_last(spark, d)
    there = last.join(read_table(spark, d, "discovered_images").select("path"), "path", "left_semi").select("path", "size", "modified")
    safe = lambda df: df.withColumn("path", F.concat(F.lit("root/"), F.translate("path", ":", "_")))
    found = verify.problems(verify.with_blob_sizes(safe(first.where(F.col("path").isNotNull()))), safe(there))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Profile


@query("SELECT CASE WHEN trim(coalesce(extension, '')) = '' THEN '<none>' ELSE " + _FOLD.format(c="trim(extension)") + " END AS extension, count(*) AS n FROM images GROUP BY 1")
def profile_extension(spark: SparkSession, d: str) -> DataFrame:
    """Images by extension."""
    return profile.extension_counts(_images(spark, d))


_LONG_DIMENSIONS = """
WITH v AS (SELECT width::DOUBLE AS w, height::DOUBLE AS h FROM images WHERE width > 0 AND height > 0),
l AS (SELECT 'width' AS field, w AS value FROM v UNION ALL SELECT 'height', h FROM v UNION ALL SELECT 'megapixels', w * h / 1e6::DOUBLE FROM v),
k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY field) AS n FROM l)
"""


@query(_LONG_DIMENSIONS + "SELECT field, count(*) AS n, min(value) AS smallest, " + ", ".join(f"max(value) FILTER (WHERE k = floor((n - 1) * {p}::DOUBLE + 0.5)) AS {c}" for c, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95))) + ", max(value) AS largest FROM k GROUP BY field")
def profile_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Smallest, largest and percentiles of width, height and megapixels."""
    return profile.dimension_stats(_images(spark, d))


_MP = "width::DOUBLE * height::DOUBLE / 1e6::DOUBLE"


@query(f"SELECT CASE WHEN {_MP} <= 0.5 THEN 'up_to_0_5' WHEN {_MP} <= 2 THEN '0_5_to_2' WHEN {_MP} <= 8 THEN '2_to_8' WHEN {_MP} <= 20 THEN '8_to_20' ELSE 'over_20' END AS bucket, count(*) AS n FROM images WHERE width > 0 AND height > 0 GROUP BY 1")
def profile_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Images by megapixels."""
    return profile.megapixel_buckets(_images(spark, d))


@query("SELECT CASE WHEN NOT coalesce(width > 0 AND height > 0, FALSE) THEN 'invalid' WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END AS orientation, count(*) AS n FROM images GROUP BY 1")
def profile_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Images by orientation."""
    return profile.orientations(_images(spark, d))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE t) AS existing_sources, count(*) FILTER (WHERE NOT t) AS missing_sources, sum(greatest(size, 0))::BIGINT AS total_bytes FROM (SELECT size, coalesce(path IN (SELECT path FROM discovered_images), FALSE) AS t FROM images)")
def profile_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are there, sources that are missing and their size."""
    return profile.source_totals(_images(spark, d), read_table(spark, d, "discovered_images"))


@query("""
WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (WHERE k = floor((n - 1) * 0.5::DOUBLE + 0.5)) AS p50, max(value) FILTER (WHERE k = floor((n - 1) * 0.9::DOUBLE + 0.5)) AS p90, max(value) FILTER (WHERE k = floor((n - 1) * 0.95::DOUBLE + 0.5)) AS p95 FROM k GROUP BY 1
""")
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of events' values by type."""
    return profile.nearest_rank(read_table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


# Change feed


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE event_type <> 'access'),
n AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS ended, count(*) AS n_events FROM n GROUP BY user_id, s
""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events of each user, an hour apart."""
    e = read_table(spark, d, "events").select("user_id", "ts", F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("path"))
    out = changes.batches(changes.relevant(e), "user_id", "1 hour")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_events")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    return changes.latest(read_table(spark, d, "events"), "user_id", "event_id", "event_type")


# Faces

_CURRENT = """
e.model_id = 'idvec' AND e.model_version = '4' AND e.model_cache_revision = 'c4-a' AND e.alignment_revision = 'align-2' AND e.dimension = 128 AND e.normalized AND e.schema_version = 1
AND e.detector_id = f.detector_id AND e.detector_version = f.detector_version AND e.detector_cache_revision = f.detector_cache_revision AND e.detection_schema_version = f.schema_version
AND e.source_size = f.source_size AND e.source_modified = f.source_modified
"""
_STORED = f"""
SELECT DISTINCT f.face_id, f.image_path FROM face_embeddings e JOIN faces f ON f.face_id = e.face_id AND {_CURRENT}
WHERE EXISTS (SELECT 1 FROM face_detection_state s WHERE s.image_path = f.image_path AND s.detector_id = f.detector_id AND s.detector_version = f.detector_version
  AND s.detector_cache_revision = f.detector_cache_revision AND s.schema_version = f.schema_version AND s.source_size = f.source_size AND s.source_modified = f.source_modified)
"""
_COMPATIBLE = _STORED + "AND EXISTS (SELECT 1 FROM images i WHERE i.path = f.image_path AND i.size = f.source_size AND i.modified = f.source_modified)"


def _compatible(spark: SparkSession, d: str, with_images: bool) -> DataFrame:
    t = [read_table(spark, d, n) for n in ("face_embeddings", "faces", "face_detection_state")]
    return faces.compatible(*t, _images(spark, d) if with_images else None, REVISION)


@query(_COMPATIBLE)
def revision_join(spark: SparkSession, d: str) -> DataFrame:
    """Faces whose vector, detection, state and image agree."""
    return _compatible(spark, d, True).select("face_id", "image_path")


@query(_STORED)
def revision_join_stored(spark: SparkSession, d: str) -> DataFrame:
    """Faces whose vector, detection and state agree."""
    return _compatible(spark, d, False).select("face_id", "image_path")


@query(f"SELECT DISTINCT e.row_id FROM face_embeddings e JOIN faces f ON f.face_id = e.face_id AND {_CURRENT}")
def current_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors made from the face as it is stored now."""
    return faces.current_embeddings(read_table(spark, d, "face_embeddings"), read_table(spark, d, "faces"), REVISION).select("row_id").distinct()


@query("""
SELECT DISTINCT path FROM images LEFT JOIN face_detection_state s ON s.image_path = path
WHERE path IS NOT NULL AND (s.image_path IS NULL OR s.detector_id <> 'facebox' OR s.detector_version <> '2.1' OR s.detector_cache_revision <> 'r3-t60' OR s.schema_version <> 2 OR s.source_size <> size OR s.source_modified <> modified)
""")
def needs_detection(spark: SparkSession, d: str) -> DataFrame:
    """Images whose faces must be found again."""
    return faces.needs_detection(_images(spark, d).where(F.col("path").isNotNull()), read_table(spark, d, "face_detection_state"), DETECTOR)


@query(f"SELECT DISTINCT f.face_id FROM faces f LEFT JOIN face_embeddings e ON e.face_id = f.face_id WHERE e.face_id IS NULL OR NOT ({_CURRENT})")
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Faces that need a vector of the revision."""
    return faces.needs_embedding(read_table(spark, d, "faces"), read_table(spark, d, "face_embeddings"), REVISION).select("face_id").distinct()


@query(f"""
WITH c AS ({_STORED}), v AS (SELECT c.face_id, c.image_path, any_value(e.embedding)::DOUBLE[] AS v FROM c JOIN face_embeddings e ON e.face_id = c.face_id AND e.model_id = 'idvec' AND e.model_version = '4' AND e.alignment_revision = 'align-2' AND e.normalized AND len(e.embedding) = 128 GROUP BY 1, 2),
u AS (SELECT *, round(list_dot_product(v, v), 12) AS nn FROM v WHERE abs(sqrt(list_dot_product(v, v)) - 1) <= 1e-3),
q AS (SELECT face_id AS qf, v AS qv FROM u ORDER BY face_id LIMIT 1),
s AS (SELECT 'library' AS library_id, image_path, face_id, round(least(1.0, greatest(-1.0, list_dot_product(v, qv))), 6) AS similarity FROM u, q WHERE face_id <> qf)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY similarity DESC, image_path, face_id) = 1 ORDER BY similarity DESC, library_id, image_path, face_id LIMIT 100
""")
def face_search(spark: SparkSession, d: str) -> DataFrame:
    """The 100 faces most similar to the first face with an agreeing vector."""
    rows = _compatible(spark, d, False).withColumn("library_id", F.lit("library"))
    first = rows.where(vector.is_unit(F.col("embedding"))).orderBy("face_id").select("face_id", "embedding").first()
    if first is None:
        return faces.search(rows, [1.0] + [0.0] * 127, "none", "library")
    faces.check_query(first["face_id"], "library", list(first["embedding"]), REVISION)
    return faces.search(rows, list(first["embedding"]), first["face_id"], "library")


@query("""
WITH f AS (SELECT DISTINCT ON (face_id) face_id, image_path, bbox, confidence FROM faces WHERE image_path IS NOT NULL ORDER BY face_id)
SELECT face_id, row_number() OVER (PARTITION BY image_path ORDER BY bbox.x, bbox.y, bbox.width, bbox.height, confidence DESC, face_id) - 1 AS place FROM f
""")
def face_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each face in its image."""
    f = read_table(spark, d, "faces").where(F.col("image_path").isNotNull()).dropDuplicates(["face_id"])
    w = Window.partitionBy("image_path").orderBy("bbox.x", "bbox.y", "bbox.width", "bbox.height", F.col("confidence").desc(), "face_id")
    return f.select("face_id", (F.row_number().over(w) - 1).alias("place"))


_W = "greatest(0, least(bbox.x::DOUBLE + bbox.width::DOUBLE, 0.75) - greatest(bbox.x::DOUBLE, 0.25))"
_H = "greatest(0, least(bbox.y::DOUBLE + bbox.height::DOUBLE, 0.75) - greatest(bbox.y::DOUBLE, 0.25))"


@query(f"SELECT face_id, round({_W} * {_H} / (0.25 + bbox.width::DOUBLE * bbox.height::DOUBLE - {_W} * {_H}), 6) AS iou FROM (SELECT DISTINCT face_id, bbox FROM faces)")
def iou_with_centre(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every face with the middle of its image."""
    box = F.struct(*[F.lit(v).alias(n) for v, n in ((0.25, "x"), (0.25, "y"), (0.5, "width"), (0.5, "height"))])
    return read_table(spark, d, "faces").select("face_id", "bbox").distinct().select("face_id", F.round(geometry.iou(F.col("bbox"), box), 6).alias("iou"))


@query()
def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Stored faces as predictions against themselves as truth, one of each pair of revisions missing."""
    f = read_table(spark, d, "faces").where(F.col("image_path").isNotNull()).dropDuplicates(["face_id"])
    box = [F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")]
    gt = f.select(F.col("image_path").alias("image_id"), F.lit("gt").alias("kind"), F.lit(0.0).alias("confidence"), *box)
    pred = f.where(F.col("confidence") >= 0.8).select(F.col("image_path").alias("image_id"), F.lit("pred").alias("kind"), F.col("confidence").cast("double").alias("confidence"), *box)
    return detection.detection_metrics(_images(spark, d).select(F.col("path").alias("image_id")), gt.unionByName(pred))


@query()
def suppressed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that stay when overlapping ones of an image are suppressed."""
    f = read_table(spark, d, "faces").where(F.col("image_path").isNotNull())
    return detection.suppress(f.select(F.col("image_path").alias("image_id"), F.col("confidence").cast("double").alias("score"), *[F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x", "y", "width", "height")]))
