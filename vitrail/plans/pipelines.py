"""Whole runs over a library: rescan, backfill of descriptors and vectors, face detection and embedding, attaching a library.

Each takes tables and returns the new tables; nothing is written before the caller does it. A file or model that fails is an outcome of its
row and leaves the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.functions import text
from vitrail.operators import catalog, faces, features, verify
from vitrail.sources.tables import cut


def rescan(images: DataFrame, discovered: DataFrame, listing: DataFrame, files: DataFrame, clean_roots: list[str], force: bool = False, decode: Callable = features.decode) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, discovered, outcomes) after a scan.

    ``listing`` has root, path, size, modified of what was found; ``files`` path and content. New and changed files are decoded and merged, found paths get
    the scan's numbers (one for discovery, the next for images), and rows of completely traversed roots that weren't found go. ``outcomes`` (root, path, outcome, error)
    says processed, skipped or failed; the old row of a failed file stays.
    """
    generation = catalog.next_generation(images, discovered).first()[0]
    seen = catalog.sweep(catalog.mark_seen(discovered, listing, generation, add_missing=True), generation, clean_roots)
    status = catalog.changes(listing, images, force)
    todo = status.where("status <> 'unchanged'").select("path")
    inspected = cut(features.inspect(files.join(todo, "path", "left_semi"), decode))
    good = inspected.where("error is null").drop("error").join(listing, "path")
    rows = good.withColumn("file_name", text.file_name(F.col("path"))).withColumn("extension", text.nocase(text.extension(F.col("path")))).withColumn("last_seen_scan", F.lit(generation).cast("bigint"))
    texture = rows.select("path", "material_texture", F.lit(catalog.TEXTURE_VERSION).alias("material_texture_version"), "content_fingerprint")
    merged = catalog.update_columns(catalog.upsert(images, rows.drop("material_texture", "content_fingerprint")), texture)
    merged = catalog.sweep(catalog.mark_seen(merged, listing, generation + 1), generation + 1, clean_roots)
    outcome = F.when(F.col("status") == "unchanged", "skipped").when(F.col("error").isNull(), "processed").otherwise("failed")
    failed = F.when(F.col("_tried").isNull() & (F.col("status") != "unchanged"), "file not readable").otherwise(F.col("error")).alias("error")
    tried = inspected.select("path", "error", F.lit(True).alias("_tried"))
    outcomes = listing.select("root", "path").join(status, "path").join(tried, "path", "left").withColumn("error", failed).select("root", "path", outcome.alias("outcome"), "error")
    return merged, seen, outcomes


def backfill_descriptors(images: DataFrame, files: DataFrame, decode: Callable = features.decode) -> tuple[DataFrame, DataFrame]:
    """(images, outcomes): missing or outdated descriptors computed; files that fail stay as they were and are tried again next time."""
    todo = catalog.needs_descriptor(images).select("path").distinct()
    got = cut(features.inspect(files.join(todo, "path", "left_semi"), decode))
    new = got.where("error is null").select("path", "visual_hash", "color_histogram", "material_texture", F.lit(catalog.TEXTURE_VERSION).alias("material_texture_version"), "content_fingerprint")
    return catalog.update_columns(images, new), got.select("path", F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("outcome"), "error")


def backfill_embeddings(images: DataFrame, files: DataFrame, make_model: Callable, dimension: int, batch_size: int = 16) -> tuple[DataFrame, DataFrame]:
    """(images, outcomes): missing vectors computed by a model that each worker makes once."""
    todo = catalog.needs_embedding(images).select("path").distinct()
    got = cut(features.embed(files.join(todo, "path", "left_semi"), make_model, dimension, batch_size))
    return catalog.set_embeddings(images, got.where("error is null").select("path", "embedding")), got.select("path", F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("outcome"), "error")


def detect_faces(scope: DataFrame, images: DataFrame, state: DataFrame, stored: DataFrame, files: DataFrame, make_detector: Callable, d: faces.Detector) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, faces, outcomes): faces of the images in scope that have no current state, replaced image by image.

    ``files`` has path, content, size, modified, orientation, width and height; a file that no longer is as indexed is skipped.
    """
    todo = faces.needs_detection(scope, state, d)
    fresh = files.join(images.select("path", "size", "modified").distinct(), ["path", "size", "modified"], "left_semi").join(todo, "path", "left_semi")
    found = cut(features.detect(fresh, make_detector))
    failed = found.where("error is not null").select(F.col("image_path").alias("path"), "error")
    done = fresh.join(failed, "path", "left_anti").select(
        F.col("path").alias("image_path"), F.col("size").alias("source_size"), F.col("modified").alias("source_modified"), F.col("orientation").alias("exif_orientation"),
        F.col("width").alias("oriented_width"), F.col("height").alias("oriented_height"),
    )
    new_state, new_faces = faces.replace_detections(state, stored, images, done, found.where("error is null").drop("error"), d)
    tried = fresh.select("path").join(failed, "path", "left").select("path", F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("outcome"), "error")
    stale = todo.join(fresh.select("path"), "path", "left_anti").select("path", F.lit("skipped").alias("outcome"), F.lit(None).cast("string").alias("error"))
    return new_state, new_faces, tried.unionByName(stale)


def embed_faces(stored: DataFrame, embeddings: DataFrame, files: DataFrame, make_model: Callable, r: faces.EmbeddingRevision, decode: Callable = features.decode) -> tuple[DataFrame, DataFrame]:
    """(embeddings, outcomes): vectors of faces that have none of the revision, from the aligned face, or a crop without five landmarks.

    A model takes a list of 112 x 112 (or cropped) pictures and returns as many vectors.
    """
    todo = faces.needs_embedding(stored, embeddings, r).dropDuplicates(["face_id"])
    joined = todo.join(files.select(F.col("path").alias("image_path"), "content"), "image_path").select("face_id", "content", "bbox", "landmarks")
    dimension = r.dimension

    def run(batches):
        model = make_model()
        for batch in batches:
            rows = []
            for name, content, box, marks in zip(batch["face_id"], batch["content"], batch["bbox"], batch["landmarks"]):
                try:
                    p = decode(bytes(content))[..., :3]
                    marks = [] if marks is None else [(m["x"], m["y"]) for m in marks]
                    h, w = p.shape[:2]
                    face = features.align_face(p, np.array(marks) * [w - 1, h - 1]) if len(marks) == 5 else features.crop_face(p, (box["x"], box["y"], box["width"], box["height"]), marks)
                    v = np.asarray(model([face])[0], np.float64)
                    n = np.linalg.norm(v)
                    if len(v) != dimension or not np.isfinite(v).all() or n <= 1e-7:
                        raise ValueError("invalid vector")
                    rows.append((name, (v / n).astype(np.float32), None))
                except Exception as x:  # noqa: BLE001
                    rows.append((name, None, str(x) or type(x).__name__))
            yield pd.DataFrame(rows, columns=["face_id", "embedding", "error"])

    got = cut(joined.mapInPandas(run, "face_id string, embedding array<float>, error string"))
    source = todo.select("face_id", "detector_id", "detector_version", "detector_cache_revision", F.col("schema_version").alias("detection_schema_version"), "source_size", "source_modified")
    lit = {"model_id": r.model_id, "model_version": r.model_version, "model_cache_revision": r.model_cache_revision, "alignment_revision": r.alignment_revision}
    new = got.where("error is null").drop("error").join(source, "face_id").withColumns({k: F.lit(v) for k, v in lit.items()})
    new = new.withColumns({"schema_version": F.lit(r.schema_version).cast("bigint"), "dimension": F.lit(r.dimension), "normalized": F.lit(True), "completed_at": F.unix_timestamp()})
    kept = [c for c in new.columns if c in embeddings.columns]
    outcomes = got.select("face_id", F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("outcome"), "error")
    return faces.merge_embeddings(embeddings, new.select(*kept), stored), outcomes


def attach_library(images: DataFrame, roots: DataFrame, registry: DataFrame, rules: dict[str, DataFrame], meta: DataFrame, portable: DataFrame, root: str) -> dict[str, DataFrame]:
    """The session's tables with a library read in at ``root``: its metadata is checked first, then rules move with it if it was elsewhere.

    ``rules`` has the tables folder_path and file_path by these names.
    """
    library_id = verify.preflight(meta)["library_id"]
    old = registry.where(F.col("library_id") == library_id).select("root_path").limit(1).collect()
    if old and old[0][0] != root:
        rules = {c: catalog.relocate(t, c, old[0][0], root) for c, t in rules.items()}
        images, roots = images.where(~F.col("root").eqNullSafe(old[0][0])), roots.where(F.col("path") != old[0][0])
    return {"images": catalog.import_root(images, portable, root), "roots": catalog.add_root(roots, root), "registry": catalog.register_library(registry, library_id, root), **rules}


def previews(files: DataFrame, most: int = 512, decode: Callable = features.decode) -> DataFrame:
    """(key, path, content, error): previews of files (path, content, size, modified, modified_nanos) as PNG of at most ``most`` pixels."""
    from vitrail.functions import hashing

    def run(batches):
        for batch in batches:
            rows = []
            for key, path, content in zip(batch["key"], batch["path"], batch["content"]):
                try:
                    rows.append((key, path, features.encode_png(np.ascontiguousarray(features.thumbnail(decode(bytes(content)), most))), None))
                except Exception as x:  # noqa: BLE001
                    rows.append((key, path, None, str(x) or type(x).__name__))
            yield pd.DataFrame(rows, columns=["key", "path", "content", "error"])

    keyed = files.select(hashing.preview_key(F.col("path"), F.col("size"), F.col("modified"), F.col("modified_nanos")).alias("key"), "path", "content")
    return keyed.mapInPandas(run, "key string, path string, content binary, error string")
