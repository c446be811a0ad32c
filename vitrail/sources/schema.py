"""The tables of a library. A snapshot read with its schema has every column; those an older version lacks come as null."""

from __future__ import annotations

import uuid

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {
        "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "float": T.FloatType(), "timestamp": T.TimestampType(),
        "floats": T.ArrayType(T.FloatType()), "rgb": T.StructType([T.StructField(c, T.IntegerType()) for c in "rgb"]),
        "box": T.StructType([T.StructField(c, T.FloatType()) for c in ("x", "y", "width", "height")]),
        "points": T.ArrayType(T.StructType([T.StructField(c, T.FloatType()) for c in "xy"])),
    }
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in text.split())])


ROOTS = _struct("path:string library_id:string registered_at:timestamp")
IMAGES = _struct(
    "row_id:bigint path:string root:string file_name:string extension:string size:bigint modified:bigint width:int height:int description:string keywords:string dominant:rgb "
    "visual_hash:bigint color_histogram:floats material_texture:floats material_texture_version:int embedding:floats embedding_normalized:boolean last_seen_scan:bigint content_fingerprint:bigint"
)
DISCOVERED = _struct("path:string root:string last_seen_scan:bigint")
COLLECTIONS = _struct("id:bigint name:string")
COLLECTION_FOLDERS = _struct("collection_id:bigint folder_path:string")
COLLECTION_FILES = _struct("collection_id:bigint file_path:string")
COLLECTION_FACE_SETTINGS = _struct("collection_id:bigint enabled:boolean")
DETECTION_STATE = _struct(
    "image_path:string detector_id:string detector_version:string detector_cache_revision:string schema_version:bigint source_size:bigint source_modified:bigint exif_orientation:int "
    "oriented_width:int oriented_height:int face_count:int completed_at:bigint"
)
FACES = _struct(
    "face_id:string image_path:string face_ordinal:int detector_id:string detector_version:string detector_cache_revision:string schema_version:bigint confidence:float bbox:box "
    "landmarks:points source_size:bigint source_modified:bigint"
)
FACE_EMBEDDINGS = _struct(
    "row_id:bigint face_id:string model_id:string model_version:string model_cache_revision:string schema_version:bigint alignment_revision:string dimension:int normalized:boolean "
    "embedding:floats detector_id:string detector_version:string detector_cache_revision:string detection_schema_version:bigint source_size:bigint source_modified:bigint completed_at:bigint"
)
META = _struct("key:string value:string")
ROOT_REGISTRY = _struct("library_id:string root_path:string")


def new_library_id() -> str:
    """A name for a library that no other has."""
    return f"lib-{uuid.uuid4().hex[:16]}"


def new_library_meta(schema_version: int = 1, marker: str = "portable-library") -> list[tuple[str, str]]:
    """The rows of META for a new library."""
    return [("library_id", new_library_id()), ("schema_version", str(schema_version)), ("format", marker)]
