"""Stored faces: what is current, what needs work, replacing an image's faces, and search across libraries."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import geometry, hashing, text, vector

# Fixed values.
DETECTION_SCHEMA, EMBEDDING_SCHEMA = 2, 1
DEFAULT_LIMIT, MAX_LIMIT, MIN_SIMILARITY = 100, 5000, 0.45


@dataclass(frozen=True)
class Detector:
    id: str
    version: str
    cache_revision: str
    schema_version: int = DETECTION_SCHEMA


@dataclass(frozen=True)
class EmbeddingRevision:
    model_id: str
    model_version: str
    model_cache_revision: str
    alignment_revision: str
    dimension: int
    schema_version: int = EMBEDDING_SCHEMA


def detector_revision(version: str, score_threshold: float, nms_threshold: float, top_k: int, model: bytes = b"") -> str:
    """A cache revision that changes with the version, the exact thresholds (as 32-bit floats) and the model's content."""
    bits = [struct.unpack("<I", struct.pack("<f", x))[0] for x in (score_threshold, nms_threshold)]
    return f"{version}-s{bits[0]:08x}-n{bits[1]:08x}-k{top_k}-m{hashing.fnv1a(model):016x}"


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any_differs(*pairs: tuple[Column, Column]) -> Column:
    """Whether some pair differs; like SQL, a null differs from nothing."""
    return reduce(lambda a, b: a | b, [F.coalesce(a != b, F.lit(False)) for a, b in pairs])


def detection_is_current(state: DataFrame, d: Detector, size: Column, modified: Column) -> DataFrame:
    """The states that hold for a file of this size and time and this detector."""
    return state.where(_all(
        F.col("detector_id") == d.id, F.col("detector_version") == d.version, F.col("detector_cache_revision") == d.cache_revision,
        F.col("schema_version") == d.schema_version, F.col("source_size") == size, F.col("source_modified") == modified,
    ))


def needs_detection(images: DataFrame, state: DataFrame, d: Detector) -> DataFrame:
    """(path) of images without a state or with one of another detector or file state; null fields don't make a difference."""
    s = state.select(*[F.col(c).alias(f"_{c}") for c in ("image_path", "detector_id", "detector_version", "detector_cache_revision", "schema_version", "source_size", "source_modified")])
    joined = images.join(s, F.col("path") == F.col("_image_path"), "left")
    differs = _any_differs(
        (F.col("_detector_id"), F.lit(d.id)), (F.col("_detector_version"), F.lit(d.version)), (F.col("_detector_cache_revision"), F.lit(d.cache_revision)),
        (F.col("_schema_version"), F.lit(d.schema_version)), (F.col("_source_size"), F.col("size")), (F.col("_source_modified"), F.col("modified")),
    )
    return joined.where(F.col("_image_path").isNull() | differs).select("path").distinct()


_SOURCE = [("detector_id", "detector_id"), ("detector_version", "detector_version"), ("detector_cache_revision", "detector_cache_revision"), ("detection_schema_version", "schema_version"), ("source_size", "source_size"), ("source_modified", "source_modified")]


def needs_embedding(faces: DataFrame, embeddings: DataFrame, r: EmbeddingRevision) -> DataFrame:
    """Faces without a vector, or with one of another model or made from another detection; null fields don't make a difference."""
    kept = ["face_id", "model_id", "model_version", "model_cache_revision", "schema_version", "alignment_revision", "dimension", "normalized", *[e for e, _ in _SOURCE]]
    e = embeddings.select(*[F.col(c).alias(f"_{c}") for c in kept])
    joined = faces.join(e, F.col("face_id") == F.col("_face_id"), "left")
    differs = _any_differs(
        (F.col("_model_id"), F.lit(r.model_id)), (F.col("_model_version"), F.lit(r.model_version)), (F.col("_model_cache_revision"), F.lit(r.model_cache_revision)),
        (F.col("_schema_version"), F.lit(r.schema_version)), (F.col("_alignment_revision"), F.lit(r.alignment_revision)), (F.col("_dimension"), F.lit(r.dimension)),
        (F.col("_normalized"), F.lit(True)), *[(F.col(f"_{a}"), F.col(b)) for a, b in _SOURCE],
    )
    return joined.where(F.col("_face_id").isNull() | differs).select(*faces.columns)


def of_revision(embeddings: DataFrame, r: EmbeddingRevision) -> DataFrame:
    return embeddings.where(_all(
        F.col("model_id") == r.model_id, F.col("model_version") == r.model_version, F.col("model_cache_revision") == r.model_cache_revision,
        F.col("schema_version") == r.schema_version, F.col("alignment_revision") == r.alignment_revision, F.col("dimension") == r.dimension, F.col("normalized"),
    ))


def current_embeddings(embeddings: DataFrame, faces: DataFrame, r: EmbeddingRevision) -> DataFrame:
    """Vectors of the revision that were made from the face as it is stored now."""
    f = faces.select("face_id", *[F.col(b).alias(a) for a, b in _SOURCE]).distinct()
    return of_revision(embeddings, r).join(f, ["face_id", *[a for a, _ in _SOURCE]], "left_semi")


def compatible(embeddings: DataFrame, faces: DataFrame, state: DataFrame, images: DataFrame | None, r: EmbeddingRevision, with_cache_revision: bool = True) -> DataFrame:
    """(face_id, image_path, bbox, landmarks, embedding) whose vector, face, detection state and image all agree; without ``images`` the first three.

    Filters on the revision come before the joins; the small key sides of state and image are semi joins. Repeated rows of a face count once.
    """
    v = current_embeddings(embeddings, faces, r).select("face_id", "embedding").dropDuplicates(["face_id"])
    columns = ["image_path", "detector_id", "detector_version", *(["detector_cache_revision"] if with_cache_revision else []), "schema_version", "source_size", "source_modified"]
    ok = faces.join(state.select(*columns).distinct(), columns, "left_semi")
    if images is not None:
        i = images.select(F.col("path").alias("image_path"), F.col("size").alias("source_size"), F.col("modified").alias("source_modified")).distinct()
        ok = ok.join(i, ["image_path", "source_size", "source_modified"], "left_semi")
    return ok.dropDuplicates(["face_id"]).select("face_id", "image_path", "bbox", "landmarks").join(v, "face_id")


def check_query(face_id: str, library_id: str, values: list[float], r: EmbeddingRevision) -> None:
    """Raises unless the query is complete and a unit vector of the revision's dimension."""
    if not face_id.strip() or not library_id.strip():
        raise ValueError("a face query needs a face and a library")
    if not (r.model_id.strip() and r.model_version.strip() and r.model_cache_revision.strip() and r.dimension > 0):
        raise ValueError("the revision is incomplete")
    if len(values) != r.dimension or not all(abs(x) < float("inf") for x in values):
        raise ValueError("the vector doesn't fit the revision")
    if abs(sum(x * x for x in values) ** 0.5 - 1) > 1e-3:
        raise ValueError("the vector isn't of length 1")


def search(rows: DataFrame, query: list[float], face_id: str, library_id: str, limit: int = DEFAULT_LIMIT, collapse_image: bool = True, min_similarity: float | None = None) -> DataFrame:
    """(library_id, image_path, face_id, similarity): the most similar faces of compatible rows with their library_id.

    The query itself and vectors that aren't of length 1 don't count. Order: similarity, library, image, face. With ``collapse_image`` an image comes once, by its
    best face. ``min_similarity`` is applied after the limit, which by the order is the same as before.
    """
    limit = min(max(limit, 1), MAX_LIMIT)
    good = rows.where(vector.is_unit(F.col("embedding")) & ~((F.col("library_id") == library_id) & (F.col("face_id") == face_id)))
    similarity = F.round(F.least(F.greatest(vector.dot_literal(F.col("embedding"), query), F.lit(-1.0)), F.lit(1.0)), 6)
    scored = good.where(F.size("embedding") == len(query)).select("library_id", "image_path", "face_id", similarity.alias("similarity"))
    order = [F.col("similarity").desc(), F.col("library_id"), F.col("image_path"), F.col("face_id")]
    if collapse_image:
        first = F.row_number().over(Window.partitionBy("library_id", "image_path").orderBy(*order))
        scored = scored.withColumn("_n", first).where("_n = 1").drop("_n")
    out = scored.orderBy(*order).limit(limit)
    return out if min_similarity is None else out.where(F.col("similarity") >= min_similarity)


def search_report(rows: DataFrame, wanted_libraries: list[str], available: list[str]) -> DataFrame:
    """(roots_searched, roots_unavailable, rows_considered, invalid_skipped)."""
    bad = F.sum(F.when(vector.is_unit(F.col("embedding")), 0).otherwise(1))
    missing = len([x for x in wanted_libraries if x not in available])
    return rows.agg(F.lit(len(wanted_libraries) - missing).alias("roots_searched"), F.lit(missing).alias("roots_unavailable"), F.count(F.lit(1)).alias("rows_considered"), F.coalesce(bad, F.lit(0)).alias("invalid_skipped"))


def stored_faces(detections: DataFrame, d: Detector) -> DataFrame:
    """The rows to store for detections (image_path, confidence, bbox, landmarks, source_size, source_modified).

    Boxes and points are clamped, empty boxes dropped; faces are numbered by x, y, width, height and falling confidence, and named by a stable hash.
    """
    if not (d.id.strip() and d.version.strip() and d.cache_revision.strip()):
        raise ValueError("the detector needs an id, a version and a cache revision")
    clamped = detections.withColumn("bbox", geometry.clamp_box(F.col("bbox"))).withColumn("landmarks", geometry.clamp_landmarks(F.col("landmarks")))
    some = clamped.where((F.col("bbox.width") > 0) & (F.col("bbox.height") > 0))
    order = Window.partitionBy("image_path").orderBy("bbox.x", "bbox.y", "bbox.width", "bbox.height", F.col("confidence").desc())
    numbered = some.withColumn("face_ordinal", F.row_number().over(order) - 1)
    lit = [F.lit(d.id).alias("detector_id"), F.lit(d.version).alias("detector_version"), F.lit(d.cache_revision).alias("detector_cache_revision"), F.lit(d.schema_version).cast("bigint").alias("schema_version")]
    name = hashing.face_id(F.col("image_path"), *lit[:3], lit[3], F.col("face_ordinal"))
    return numbered.select(name.alias("face_id"), "image_path", "face_ordinal", *lit, "confidence", "bbox", "landmarks", "source_size", "source_modified")


def replace_detections(state: DataFrame, faces: DataFrame, images: DataFrame, done: DataFrame, detections: DataFrame, d: Detector) -> tuple[DataFrame, DataFrame]:
    """(state, faces) with the results of the images in ``done`` replaced as a whole; an image without faces is stored too.

    ``done`` has image_path, source_size, source_modified, exif_orientation (1 to 8), oriented_width and oriented_height (positive). Images that aren't indexed or
    have impossible figures are left out.
    """
    fine = done.where(F.col("exif_orientation").between(1, 8) & (F.col("oriented_width") > 0) & (F.col("oriented_height") > 0))
    fine = fine.join(images.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_semi")
    new_faces = stored_faces(detections.join(fine.select("image_path", "source_size", "source_modified"), ["image_path"], "inner"), d)
    n = new_faces.groupBy("image_path").agg(F.count(F.lit(1)).cast("int").alias("face_count"))
    new_state = fine.join(n, "image_path", "left").select(
        "image_path", F.lit(d.id).alias("detector_id"), F.lit(d.version).alias("detector_version"), F.lit(d.cache_revision).alias("detector_cache_revision"),
        F.lit(d.schema_version).cast("bigint").alias("schema_version"), "source_size", "source_modified", "exif_orientation", "oriented_width", "oriented_height",
        F.coalesce("face_count", F.lit(0)).alias("face_count"), F.unix_timestamp().alias("completed_at"),
    )
    gone = fine.select("image_path")
    keep = lambda df: df.join(gone, "image_path", "left_anti")
    return keep(state).unionByName(new_state, allowMissingColumns=True), keep(faces).unionByName(new_faces, allowMissingColumns=True)


def merge_embeddings(embeddings: DataFrame, results: DataFrame, faces: DataFrame) -> DataFrame:
    """The embeddings with new results in place of those of the same face, if they are unit vectors and their face is still the same."""
    f = faces.select("face_id", *[F.col(b).alias(a) for a, b in _SOURCE]).distinct()
    good = results.where(vector.is_unit(F.col("embedding")) & (F.size("embedding") == F.col("dimension"))).join(f, ["face_id", *[a for a, _ in _SOURCE]], "left_semi")
    return embeddings.join(good.select("face_id"), "face_id", "left_anti").unionByName(good, allowMissingColumns=True)


def agreeing(faces: DataFrame, state: DataFrame, images: DataFrame) -> DataFrame:
    """Faces whose detection state and image agree with them, whatever their cache revision and with or without a vector; repeated rows of a face count once."""
    columns = ["image_path", "detector_id", "detector_version", "schema_version", "source_size", "source_modified"]
    files = images.select(F.col("path").alias("image_path"), F.col("size").alias("source_size"), F.col("modified").alias("source_modified")).distinct()
    return faces.join(state.select(*columns).distinct(), columns, "left_semi").join(files, ["image_path", "source_size", "source_modified"], "left_semi").dropDuplicates(["face_id"])


def faces_of(faces: DataFrame, state: DataFrame, images: DataFrame, image_path: str) -> DataFrame:
    """(face_id, face_ordinal, confidence, bbox, landmarks) of one image's faces that still hold, by ordinal."""
    one = agreeing(faces.where(F.col("image_path") == image_path), state.where(F.col("image_path") == image_path), images.where(F.col("path") == image_path))
    return one.select("face_id", "face_ordinal", "confidence", "bbox", "landmarks").orderBy("face_ordinal", "face_id")


def source_still_matches(faces: DataFrame, listing: DataFrame) -> DataFrame:
    """Faces whose file (path, size, modified of a fresh listing) is as it was."""
    files = listing.select(F.col("path").alias("image_path"), F.col("size").alias("source_size"), F.col("modified").alias("source_modified")).distinct()
    return faces.join(files, ["image_path", "source_size", "source_modified"], "left_semi")


def eligible_pages(images: DataFrame, root: str, cursor: str | None, limit: int) -> DataFrame:
    """The next paths of a root in order without regard to case."""
    k = text.nocase(F.col("path"))
    rows = images.where(text.nocase(F.col("root")) == text.fold(root))
    return (rows if cursor is None else rows.where(k > text.fold(cursor))).select("path").orderBy(k).limit(max(limit, 1))
