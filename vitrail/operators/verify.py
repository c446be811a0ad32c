"""Checks of a stored library against its files, and what a repair has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.functions import hashing, text, vector

# Fixed values.
SUPPORTED_SCHEMA, FORMAT_MARKER = 1, "portable-library"
KINDS = ("unsafe_relative_path", "invalid_color_histogram", "invalid_material_texture", "invalid_embedding", "missing_source", "source_size_changed", "source_modified_changed", "missing_fingerprint", "fingerprint_mismatch", "source_decode_failed")


def preflight(meta: DataFrame, supported: int = SUPPORTED_SCHEMA, marker: str = FORMAT_MARKER) -> dict:
    """The metadata (key, value) as a dict, or an error if it forbids any change to the library."""
    values = {r["key"]: r["value"] for r in meta.where(F.col("key").isin("schema_version", "format", "library_id")).collect()}
    try:
        version = int(values["schema_version"])
    except (KeyError, TypeError, ValueError):
        raise ValueError("the library has no valid schema version") from None
    if version <= 0 or version > supported:
        raise ValueError(f"schema version {version} isn't supported")
    if values.get("format", marker) != marker:
        raise ValueError("the library has another format")
    if not (values.get("library_id") or "").strip():
        raise ValueError("the library has no id")
    return {"library_id": values["library_id"], "schema_version": version}


def problems(rows: DataFrame, listing: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """(path, kind) of everything wrong with stored rows.

    ``rows`` has path (relative), size, modified, content_fingerprint and, for each of color_histogram, material_texture and embedding, its bytes (``_bytes``) and
    dimension (``_dim``); ``listing`` has path, size, modified. With ``fingerprints`` (path, fingerprint, null if the file can't be decoded) contents are
    compared as well. An unsafe path hides all other problems of its row, a missing source those that need it. Null sizes count as 0.
    """
    there = listing.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.lit(True).alias("_there")).dropDuplicates(["path"])
    joined = rows.join(there, "path", "left")
    safe = text.is_safe_relative(F.col("path"))
    exists = F.coalesce(F.col("_there"), F.lit(False))
    dim = lambda n: ~F.coalesce(vector.valid_dimension(F.col(f"{n}_bytes"), F.coalesce(f"{n}_dim", F.lit(0))), F.lit(False))
    found = [
        (~safe, "unsafe_relative_path"),
        (safe & dim("color_histogram"), "invalid_color_histogram"),
        (safe & dim("material_texture"), "invalid_material_texture"),
        (safe & dim("embedding"), "invalid_embedding"),
        (safe & ~exists, "missing_source"),
        (safe & exists & (F.col("_size") != F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))), "source_size_changed"),
        (safe & exists & ~F.col("_modified").eqNullSafe(F.col("modified")), "source_modified_changed"),
    ]
    if fingerprints is not None:
        now = fingerprints.select("path", F.col("fingerprint").alias("_now"), F.lit(True).alias("_tried")).dropDuplicates(["path"])
        joined = joined.join(now, "path", "left")
        stored = F.col("content_fingerprint")
        found += [
            (safe & exists & stored.isNull(), "missing_fingerprint"),
            (safe & exists & stored.isNotNull() & F.col("_now").isNotNull() & (F.col("_now") != stored), "fingerprint_mismatch"),
            (safe & exists & stored.isNotNull() & F.col("_now").isNull(), "source_decode_failed"),
        ]
    kinds = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(kind)) for c, kind in found]), lambda x: x.isNotNull())
    return joined.select("path", F.explode(kinds).alias("kind"))


def with_blob_sizes(images: DataFrame) -> DataFrame:
    """Stored arrays as bytes and dimension, as ``problems`` expects them; an empty array has bytes but no dimension."""
    out = images
    for n in ("color_histogram", "material_texture", "embedding"):
        out = out.withColumn(f"{n}_bytes", F.when(F.col(n).isNotNull(), F.size(n) * 4)).withColumn(f"{n}_dim", F.when(F.col(n).isNotNull(), F.size(n)).otherwise(F.lit(0)))
    return out


def report(found: DataFrame, checked: int) -> DataFrame:
    """(kind, n) of all kinds, with the number of checked rows as ``records_checked``."""
    every = found.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counted = every.join(found.groupBy("kind").agg(F.count(F.lit(1)).alias("_n")), "kind", "left").select("kind", F.coalesce("_n", F.lit(0)).alias("n"))
    return counted.unionByName(found.sparkSession.createDataFrame([("records_checked", checked)], "kind string, n bigint"))


def preview_repairs(images: DataFrame, cached: DataFrame) -> DataFrame:
    """(key, path, action): previews to build, to rebuild and, of files that belong to no row, to prune.

    ``images`` has relative path, size, modified, modified_nanos; ``cached`` has key and valid.
    """
    wanted = images.select(hashing.preview_key(F.col("path"), F.col("size"), F.col("modified"), F.col("modified_nanos")).alias("key"), "path")
    joined = wanted.join(cached.select("key", F.col("valid").alias("_valid"), F.lit(True).alias("_cached")), "key", "full_outer")
    action = F.when(F.col("_cached").isNull(), "build").when(F.col("path").isNull(), "prune").when(~F.col("_valid"), "rebuild").otherwise("keep")
    return joined.select("key", "path", action.alias("action"))
