"""Quality reports over catalogs, labelled files and faces. Each returns a small table of metrics.

Query sets are stated samples, as the reports define them; they are searched against all rows.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions import score, text, vector
from vitrail.operators import detection, evaluate, features, profile, topk
from vitrail.sources import manifests


def library_profile(images: DataFrame, existing: DataFrame) -> DataFrame:
    """(metric, value) of counts, bytes, dimensions, buckets and orientations."""
    d = "double"
    totals = profile.source_totals(images, existing)
    out = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast(d).alias("value")) for c in totals.columns])).alias("m")).select("m.*")
    for table, key, prefix in ((profile.extension_counts(images), "extension", "extension."), (profile.megapixel_buckets(images), "bucket", "megapixel_bucket."), (profile.orientations(images), "orientation", "orientation.")):
        out = out.unionByName(table.select(F.concat(F.lit(prefix), key).alias("metric"), F.col("n").cast(d).alias("value")))
    stats = profile.dimension_stats(images)
    each = F.explode(F.array(*[F.struct(F.concat("field", F.lit(f".{c}")).alias("metric"), F.col(c).cast(d).alias("value")) for c in stats.columns if c != "field"]))
    return out.unionByName(stats.select(each.alias("m")).select("m.*"))


def ann_benchmark(df: DataFrame, id_column: str, vector_column: str, queries: int = 32, ks: tuple[int, ...] = (10, 50, 100)) -> dict[str, float]:
    """Recall at each k, with the query itself in its list, and milliseconds of exact and approximate search."""
    sample = topk.even_sample(df, [id_column], queries).select(id_column, vector_column).collect()
    index, began = topk.ApproximateIndex(), time.perf_counter()
    points = index.fit(df, id_column, vector_column).persist()
    points.count()
    out: dict[str, float] = {"queries": len(sample), "prepare_ms": (time.perf_counter() - began) * 1000}
    hits, times = dict.fromkeys(ks, 0), {"exact": [], "approximate": []}
    for r in sample:
        q = list(r[vector_column])
        begun = time.perf_counter()
        exact = [x[0] for x in topk.exact_top_k(df, id_column, vector_column, q, max(ks)).collect()]
        middle = time.perf_counter()
        near = [x[0] for x in index.search(points, q, max(ks)).collect()]
        times["exact"].append((middle - begun) * 1000)
        times["approximate"].append((time.perf_counter() - middle) * 1000)
        for k in ks:
            hits[k] += len(set(exact[:k]) & set(near[:k])) / max(1, min(k, len(exact)))
    points.unpersist()
    for name, t in times.items():
        t = sorted(t) or [0.0]
        out |= {f"{name}_avg_ms": statistics.fmean(t), f"{name}_p50_ms": t[int((len(t) - 1) * 0.5 + 0.5)], f"{name}_p95_ms": t[int((len(t) - 1) * 0.95 + 0.5)]}
    return out | {f"recall_at_{k}": h / max(1, len(sample)) for k, h in hits.items()}


def preview_benchmark(original: DataFrame, preview: DataFrame, id_column: str = "row_id", samples: int = 64) -> DataFrame:
    """Agreement of vectors of previews with those of the originals: cosines of pairs, recall at 10 and 25, agreement of the first."""
    sample = topk.even_sample(original, [id_column], samples, endpoints=True)
    p = preview.join(sample.select(id_column), id_column, "left_semi")
    pairs = sample.select(id_column, F.col("embedding").alias("_a")).join(p.select(id_column, F.col("embedding").alias("_b")), id_column).select(vector.dot(F.col("_a"), F.col("_b")).alias("c"))
    ends = pairs.agg(F.round(profile.mean_or_zero(F.col("c")), 6).alias("cosine_mean"), F.round(F.min("c"), 6).alias("cosine_min"))
    low = profile.nearest_rank(pairs, [], "c", {"p": 0.05}).select(F.round("p", 6).alias("cosine_p05"))
    out, one = ends.join(F.broadcast(low), F.lit(True), "left"), F.lit(True)
    for k in (10, 25):
        o = topk.overlap(topk.top_k_per_query(p, p, id_column, "embedding", k), topk.top_k_per_query(sample, sample, id_column, "embedding", k), k)
        out = out.join(F.broadcast(o.select(F.col("recall").alias(f"recall_at_{k}"), *([F.col("top1_agreement")] if k == 10 else []))), one)
    return out


def runtime_benchmark(spark: SparkSession, backends: dict[str, Callable], items: list[bytes], batches: tuple[int, ...] = (1, 4, 8, 16, 32), repeats: int = 3) -> DataFrame:
    """Median times of models by backend and batch size on the driver, as one would choose a setting; a backend that fails has no rows."""
    runs = []
    for name, make in backends.items():
        try:
            model = make()
            for batch in batches:
                for _ in range(repeats):
                    begun = time.perf_counter()
                    for s in range(0, len(items), batch):
                        model(items[s : s + batch])
                    runs.append((name, batch, (time.perf_counter() - begun) * 1000, len(items)))
        except Exception:  # noqa: BLE001
            runs = [r for r in runs if r[0] != name]
    return profile.timing_summary(spark.createDataFrame(runs, "backend string, batch int, ms double, items int"))


def robustness(corpus: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(variant, queries, recall_at_k..., mrr, mean_rank) of changed pictures looking for their original, for each variant and ``overall``.

    ``corpus`` has item_id and embedding, ``queries`` item_id, variant and embedding; both small samples by the report's definition, checked before the queries are broadcast.
    """
    topk.check_queries(queries, "embedding")
    q = queries.select("item_id", "variant", F.col("embedding").alias("_q"))
    scored = corpus.select(F.col("item_id").alias("candidate_id"), F.col("embedding").alias("_c")).join(F.broadcast(q), F.lit(True))
    s = F.round(vector.dot(F.col("_q"), F.col("_c")), 6)
    named = scored.select(F.struct("item_id", "variant").alias("query_id"), "candidate_id", s.alias("score"))
    ranks = evaluate.target_rank(named, q.select(F.struct("item_id", "variant").alias("query_id"), F.col("item_id").alias("candidate_id")))
    each = ranks.select(F.explode(F.array("query_id.variant", F.lit("overall"))).alias("variant"), "rank")
    r = F.col("rank")
    return each.groupBy("variant").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg((r <= k).cast("double")), 6).alias(f"recall_at_{k}") for k in ks], F.round(F.avg(1 / r), 6).alias("mrr"), F.round(F.avg(r), 6).alias("mean_rank"))


def model_benchmark(tables: dict[str, tuple[DataFrame, DataFrame] | Exception]) -> tuple[DataFrame | None, dict[str, str]]:
    """(metrics of every model, failures): ``robustness`` of each model's corpus and queries."""
    good, failed = evaluate.isolated(tables)
    out = None
    for name, (corpus, queries) in good.items():
        one = robustness(corpus, queries, (10, 25)).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out, failed


TEXTURE_SCORES = ("hash", "gradient", "pattern", "texture", "blend")


def texture_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Five scores of every query against every item: (query_id, query_group, candidate_id, candidate_group, scores...); tables have item_id, group, visual_hash, material_texture."""
    q = queries.select(F.col("item_id").alias("query_id"), F.col("group").alias("query_group"), F.col("visual_hash").alias("_qh"), F.col("material_texture").alias("_qt"))
    topk.check_queries(q, "_qt")
    c = corpus.select(F.col("item_id").alias("candidate_id"), F.col("group").alias("candidate_group"), "visual_hash", "material_texture")
    h = score.hash_similarity(F.col("_qh"), F.col("visual_hash"))
    t, args = score.texture_similarity(F.col("_qt"), F.col("material_texture")), (F.col("_qt"), F.col("material_texture"))
    values = {"hash": h, "gradient": score.gradient_similarity(*args), "pattern": score.pattern_similarity(*args), "texture": t, "blend": score.blend_texture_and_hash(h, t)}
    return c.join(F.broadcast(q), F.lit(True)).select("query_id", "query_group", "candidate_id", "candidate_group", *[F.round(v, 6).alias(k) for k, v in values.items()])


def texture_benchmark(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(score, queries, recall_at_1, 5, 10, mrr, mean_rank): how well each texture score finds the item a changed picture came from."""
    scores, out = texture_scores(corpus, queries), None
    targets = queries.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("candidate_id")).distinct()
    for name in TEXTURE_SCORES:
        r = evaluate.rank_metrics(evaluate.target_rank(scores.select("query_id", "candidate_id", F.col(name).alias("score")), targets), (1, 5, 10)).withColumn("score", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def material_benchmark(spark: SparkSession, manifest: str, base: str, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((score, metrics...), missing): how well hash, texture, histogram, colour and vectors find items of the same labelled group.

    Raises if labelled files aren't in the catalog. Items whose group has no other covered member are left out.
    """
    labelled, _ = manifests.material_manifest(spark, manifest, base)
    missing = manifests.missing_from_catalog(labelled, images)
    if missing.limit(1).count():
        raise ValueError("labelled files are missing from the catalog")
    rows = evaluate.with_group_positives(manifests.labelled_rows(labelled, images), "group")
    topk.check_queries(rows, "color_histogram")
    q = rows.select(F.col("row_id").alias("query_id"), F.col("group").alias("query_group"), *[F.col(c).alias(f"_{c}") for c in ("visual_hash", "material_texture", "color_histogram", "dominant", "embedding")])
    c = rows.select(F.col("row_id").alias("candidate_id"), F.col("group").alias("candidate_group"), "visual_hash", "material_texture", "color_histogram", "dominant", "embedding")
    values = {
        "hash": score.hash_similarity(F.col("_visual_hash"), F.col("visual_hash")),
        "texture": score.texture_similarity(F.col("_material_texture"), F.col("material_texture")),
        "histogram": score.histogram_intersection(F.col("_color_histogram"), F.col("color_histogram")),
        "dominant": score.rgb_similarity(F.col("_dominant"), F.col("dominant")),
        "vector": vector.dot(vector.normalise(F.col("_embedding")), vector.normalise(F.col("embedding"))),
    }
    scores = c.join(F.broadcast(q), F.col("query_id") != F.col("candidate_id")).select("query_id", "query_group", "candidate_id", "candidate_group", *[F.round(v, 6).alias(k) for k, v in values.items()])
    out = None
    for name in values:
        one = scores.where(F.col(name).isNotNull()).select("query_id", "query_group", "candidate_id", "candidate_group", F.col(name).alias("score"))
        r = evaluate.rank_metrics(evaluate.first_relevant_rank(one)).withColumn("score", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out, missing


def face_benchmark(spark: SparkSession, manifest: str) -> dict[str, DataFrame]:
    """Detection and identity metrics of a manifest; raises if any of its lines is rejected."""
    tables, rejected = manifests.face_manifest(spark, manifest)
    first = rejected.orderBy("line").limit(1).collect()
    if first or tables["model"].count() != 1:
        raise ValueError(first[0]["reason"] if first else "one model record is needed")
    box = [F.col(f"bbox.{n}").alias(n) for n in ("x", "y", "width", "height")]
    boxes = tables["gt"].select("image_id", F.lit("gt").alias("kind"), F.lit(0.0).alias("confidence"), *box).unionByName(tables["pred"].select("image_id", F.lit("pred").alias("kind"), "confidence", *box))
    return {"model": tables["model"], "detection": detection.detection_metrics(tables["image"], boxes), "identity": evaluate.identity_metrics(tables["identity"])}


def face_runner(found: DataFrame, files: DataFrame, make_model: Callable, dimension: int, decode: Callable = features.decode_png) -> DataFrame:
    """Identity metrics of labelled faces (face_id, person_id, image_path, landmarks in shares of the full size): embeds all and compares all ordered pairs."""
    import numpy as np
    import pandas as pd

    rows = found.join(files.select(F.col("path").alias("image_path"), "content"), "image_path").select("face_id", "person_id", "content", F.transform("landmarks", lambda p: F.array(p["x"], p["y"])).alias("points"))

    def run(batches):
        model = make_model()
        for batch in batches:
            out = []
            for face_id, person, content, points in zip(batch["face_id"], batch["person_id"], batch["content"], batch["points"]):
                p = decode(bytes(content))[..., :3]
                marks = np.array([list(x) for x in points], float) * [p.shape[1], p.shape[0]]
                v = np.asarray(model([features.align_face(p, marks)])[0], np.float64)
                out.append((face_id, person, (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)))
            yield pd.DataFrame(out, columns=["face_id", "person_id", "embedding"])

    vectors = rows.mapInPandas(run, "face_id string, person_id string, embedding array<float>").where(F.size("embedding") == dimension)
    topk.check_queries(vectors, "embedding")
    q = vectors.select(F.col("face_id").alias("query_id"), F.col("person_id").alias("query_person"), F.col("embedding").alias("_q"))
    c = vectors.select(F.col("face_id").alias("candidate_id"), F.col("person_id").alias("candidate_person"), F.col("embedding").alias("_c"))
    pairs = c.join(F.broadcast(q), F.col("query_id") != F.col("candidate_id")).select("query_id", "query_person", "candidate_id", "candidate_person", vector.dot(F.col("_q"), F.col("_c")).cast("float").alias("similarity"))
    return evaluate.identity_metrics(pairs)


def candidates_by_text(images: DataFrame, query: str) -> DataFrame:
    """The names that a text search shows, in order."""
    return images.where(text.matches_all_tokens([F.col(c) for c in ("file_name", "path", "description", "keywords")], query)).select("file_name", "path").orderBy(text.nocase(F.col("file_name")), "path")
