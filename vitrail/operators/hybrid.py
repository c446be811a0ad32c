"""Hybrid similarity search: colour gate, component scores, candidates and the ranked result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import score, text, vector
from vitrail.functions.score import SimilaritySettings
from vitrail.sources.tables import cut

# Results at most, candidates of a component at most, rows from which candidates are chosen first.
MAX_RESULTS, MAX_COMPONENT_CANDIDATES, PIPELINE_MIN_ROWS = 2000, 3000, 4000


def component_limit(n: int, most_results: int = MAX_RESULTS, most_candidates: int = MAX_COMPONENT_CANDIDATES) -> int:
    """Half of the rows, rounded up, within the two limits."""
    return min(max(-(-n // 2), most_results), most_candidates)


def with_metrics(rows: DataFrame, query: dict, settings: SimilaritySettings, is_exact: Column) -> DataFrame:
    """``rows`` with is_exact, hash_score, histogram_score, clip_score, dominant_score and passes_gate.

    ``query`` has dominant (r, g, b), visual_hash, color_histogram, material_texture and embedding (a unit vector); those that are None count as
    missing. The exact row has 1 throughout. A histogram is scored if it weighs or the gate needs it, other components if they weigh.
    """
    nothing = F.lit(None).cast("double")
    dominant = score.rgb_similarity(F.struct(*[F.lit(int(v)).alias(c) for v, c in zip(query["dominant"], "rgb")]), F.col("dominant"))
    histogram = hash_score = clip = nothing
    if query.get("color_histogram") is not None and (settings.color_distribution_weight > 0 or settings.strict_color_rejection):
        histogram = score.histogram_intersection(vector.literal(query["color_histogram"]), F.col("color_histogram"))
    if settings.texture_weight > 0:
        hashes = nothing if query.get("visual_hash") is None else score.hash_similarity(F.lit(query["visual_hash"]).cast("bigint"), F.col("visual_hash"))
        texture = nothing
        if query.get("material_texture") is not None:
            current = F.when(F.col("material_texture_version") == 1, F.col("material_texture"))
            texture = score.texture_similarity(vector.literal(query["material_texture"]), current)
        hash_score = score.blend_texture_and_hash(hashes, texture)
    if settings.clip_weight > 0 and query.get("embedding") is not None:
        v = F.col("embedding")
        unit = F.array(*[F.lit(float(x)) for x in query["embedding"]])
        cosine = vector.cosine_to_unit_query(unit, v, F.coalesce(F.col("embedding_normalized"), F.lit(False)))
        clip = F.when(v.isNotNull(), score.clamp01(cosine))
    one = F.lit(1.0)
    gate = score.passes_color_gate(F.col("histogram_score"), F.col("dominant_score"), settings)
    exact = F.coalesce(is_exact, F.lit(False))
    out = rows.withColumn("is_exact", exact)
    for name, c in (("hash_score", hash_score), ("histogram_score", histogram), ("clip_score", clip), ("dominant_score", dominant)):
        out = out.withColumn(name, F.when(F.col("is_exact"), one).otherwise(c))
    return out.withColumn("passes_gate", F.col("is_exact") | F.coalesce(gate, F.lit(False)))


def eligible(metrics: DataFrame) -> DataFrame:
    return metrics.where("passes_gate")


def candidates(metrics: DataFrame, settings: SimilaritySettings, n: int, id_column: str, most_results: int = MAX_RESULTS, most_candidates: int = MAX_COMPONENT_CANDIDATES, min_rows: int = PIPELINE_MIN_ROWS) -> DataFrame:
    """The rows worth an exact score: the best of each weighing component and the exact row.

    Few rows, no weighing component or too few candidates mean all eligible rows. Ties of a component are broken by id. No component
    sorts the whole table in one task.
    """
    all_rows = eligible(metrics)
    if n <= min_rows:
        return all_rows
    limit = component_limit(n, most_results, most_candidates)
    weights = {"histogram_score": settings.color_distribution_weight, "hash_score": settings.texture_weight, "clip_score": settings.clip_weight, "dominant_score": settings.dominant_color_weight}
    weighing = [name for name, weight in weights.items() if weight > 0]
    if not weighing:
        return all_rows
    # Scores and ids only, computed once; the bests of all components come from one pass that keeps ``limit`` rows a partition.
    slim = cut(all_rows.select(id_column, "is_exact", *weighing))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("component"), F.col(name).alias("score")) for name in weighing])).alias("s")
    long = slim.where(~F.col("is_exact")).select(id_column, each).select(id_column, "s.component", "s.score").where(F.col("score").isNotNull())
    order = Window.partitionBy("component").orderBy(F.col("score").desc(), id_column)
    best = long.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(id_column)
    chosen = cut(best.unionByName(slim.where("is_exact").select(id_column)).distinct())
    if chosen.count() < min(most_results, slim.count()):
        return all_rows
    return all_rows.join(chosen, id_column, "left_semi")


def ranked(metrics: DataFrame, settings: SimilaritySettings, limit: int = MAX_RESULTS) -> DataFrame:
    """The best rows with their score: the exact row first, then by score, equal scores by name and path."""
    s = F.when(F.col("is_exact"), F.lit(1.0)).otherwise(score.hybrid_score(F.col("hash_score"), F.col("histogram_score"), F.col("clip_score"), F.col("dominant_score"), settings))
    rows = eligible(metrics).withColumn("score", F.round(s, 6))
    return rows.orderBy(F.col("is_exact").desc(), F.col("score").desc(), text.nocase(F.col("file_name")), "path", "row_id").limit(limit)


def similar(catalog: DataFrame, query_row: dict, settings: SimilaritySettings | None = None, limit: int = MAX_RESULTS, two_stage: bool = False) -> DataFrame:
    """Hybrid search for the catalog row ``query_row`` (a dict of its descriptors and its path)."""
    settings = settings or SimilaritySettings()
    metrics = with_metrics(catalog, query_row, settings, text.key_native(F.col("path")) == text.key_native(F.lit(query_row["path"])))
    if two_stage:
        metrics = candidates(metrics, settings, catalog.count(), "row_id")
    return ranked(metrics, settings, limit)


def query_descriptors(catalog: DataFrame, row_id: int) -> dict:
    """The descriptors of one catalog row, its vector scaled to length 1."""
    r = catalog.where(F.col("row_id") == row_id).limit(1).collect()
    if not r:
        raise ValueError(f"no row {row_id}")
    row = r[0].asDict(recursive=True)
    v = row.get("embedding")
    if v:
        n = sum(x * x for x in v) ** 0.5
        row["embedding"] = [x / n for x in v] if 1e-7 < n < float("inf") else None
    row["dominant"] = tuple((row["dominant"] or {"r": 0, "g": 0, "b": 0})[c] for c in "rgb")
    if row.get("material_texture_version") != 1:
        row["material_texture"] = None
    return row
