"""More queries: one for each operator on paths, texts, vectors, boxes, stored faces, collections and the catalog, over whole tables, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions import geometry, text, vector
from vitrail.operators import catalog, collections, faces, hybrid, profile, topk, verify
from vitrail.plans import reference_queries as base
from vitrail.sources import manifests
from vitrail.sources.tables import read_table
from vitrail.streaming import changes

QUERIES: dict = {}
ORACLE: dict = {}
DETECTOR, REVISION = base.DETECTOR, base.REVISION


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _fold(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "images")


# Paths


@query(f"SELECT row_id, coalesce(regexp_matches({_fold('path')}, '[^/\\\\]\\.(jpg|jpeg|png|tif|tiff)$'), NULL) AS supported FROM images")
def supported_images(spark: SparkSession, d: str) -> DataFrame:
    """Whether each path has a supported extension."""
    return _images(spark, d).select("row_id", text.is_supported_image(F.col("path")).alias("supported"))


@query("""
SELECT row_id, NOT (regexp_matches(path, '^[\\\\/]') OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(regexp_split_to_array(path, '[\\\\/]'), '..')) AS whole,
 NOT (regexp_matches(rest, '^[\\\\/]') OR regexp_matches(rest, '^[A-Za-z]:') OR list_contains(regexp_split_to_array(rest, '[\\\\/]'), '..')) AS rest_is_safe,
 NOT (regexp_matches(up, '^[\\\\/]') OR regexp_matches(up, '^[A-Za-z]:') OR list_contains(regexp_split_to_array(up, '[\\\\/]'), '..')) AS up_is_safe
FROM (SELECT row_id, path, path[4:] AS rest, replace(path[4:], 'a', '..\\') AS up FROM images)
""")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Whether each path, the path without its drive, and one with steps upward is safe to join to a root."""
    rest = F.expr("substring(path, 4)")
    up = F.replace(rest, F.lit("a"), F.lit("..\\"))
    return _images(spark, d).select("row_id", text.is_safe_relative(F.col("path")).alias("whole"), text.is_safe_relative(rest).alias("rest_is_safe"), text.is_safe_relative(up).alias("up_is_safe"))


@query("SELECT row_id, coalesce(regexp_split_to_array(path, '[\\\\/]')[2] = 'Users', false) AS internal FROM (SELECT row_id, path FROM images)")
def internal_paths(spark: SparkSession, d: str) -> DataFrame:
    """Whether each path without its drive lies in a folder named as an index folder would be."""
    return _images(spark, d).select("row_id", text.is_internal(F.regexp_replace("path", r"^[^\\/]*[\\/]", ""), "Users").alias("internal"))


@query(f"""
SELECT row_id, replace(path, '/', '\\') AS native, {_fold("replace(path, '/', '\\')")} AS native_windows,
 regexp_replace({_fold("replace(path, '/', '\\')")}, '\\\\+$', '') AS folded, {_fold("replace(path, '\\', '/')")} AS forward
FROM images
""")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys by which paths are compared."""
    p = F.col("path")
    return _images(spark, d).select("row_id", text.key_native(p).alias("native"), text.key_native(p, windows=True).alias("native_windows"), text.key_folded_trimmed(p).alias("folded"), text.key_forward(p).alias("forward"))


@query("""
SELECT row_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name,
 CASE WHEN path IS NULL THEN NULL WHEN strpos(regexp_extract(path, '([^/\\\\]*)$', 1)[2:], '.') = 0 THEN '' ELSE regexp_extract(path, '\\.([^./\\\\]*)$', 1) END AS suffix
FROM images
""")
def names_and_extensions(spark: SparkSession, d: str) -> DataFrame:
    """File name and extension of each path."""
    return _images(spark, d).select("row_id", text.file_name(F.col("path")).alias("name"), text.extension(F.col("path")).alias("suffix"))


# Texts and reports


@query("""
SELECT doc_id, regexp_matches(t, 'keyword|subject') AS keywords, regexp_matches(t, 'description|comment|title|caption') AS description
FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
""")
def tag_routes(spark: SparkSession, d: str) -> DataFrame:
    """Where a tag named as each text would go."""
    return read_table(spark, d, "documents").select("doc_id", text.tag_route(F.col("text")).alias("r")).select("doc_id", "r.keywords", "r.description")


@query("""
SELECT row_id, 'Row ' || row_id || ' | of ' || coalesce(extension, 'none') AS described, 'k' || row_id || ', L' AS keyed FROM images
""")
def packet_texts(spark: SparkSession, d: str) -> DataFrame:
    """Description and keywords of a packet made of each row, with values that repeat in another case."""
    i, e = F.col("row_id").cast("string"), F.coalesce(F.col("extension"), F.lit("none"))
    parts = [
        "<x><dc:description>Row ", i, "</dc:description><dc:title> ROW  ", i, "</dc:title><photoshop:Headline>of ", e, "</photoshop:Headline>",
        "<dc:subject>k", i, "</dc:subject><dc:subject>K", i, "</dc:subject><photoshop:Keywords>L</photoshop:Keywords></x>",
    ]
    described, keyed = text.packet_text(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return _images(spark, d).select("row_id", described.alias("described"), keyed.alias("keyed"))


@query(f"SELECT doc_id, md5(regexp_replace({_fold('text')}, '[^a-z0-9._-]', '_', 'g')) AS name, md5(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g')) AS line FROM documents")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the texts as report keys and as one line."""
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", F.md5(text.report_key(t).cast("binary")).alias("name"), F.md5(text.one_line(t).cast("binary")).alias("line"))


@query("""
SELECT row_id, CASE WHEN size >= 1073741824 THEN printf('%.1f GB', size / 1073741824.0) WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.1f KB', size / 1024.0) ELSE size || ' B' END AS shown_size,
 strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M') AS shown_day, CASE WHEN length(path) <= 21 THEN path ELSE path[:10] || '…' || path[-10:] END AS shown_path
FROM images
""")
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, days and paths as they are shown."""
    day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds("modified").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")
    shown = F.when(F.current_timezone() == "UTC", text.format_day(F.col("modified"))).otherwise(day)
    return _images(spark, d).select("row_id", text.format_bytes(F.col("size")).alias("shown_size"), shown.alias("shown_day"), text.truncate_middle(F.col("path"), 21).alias("shown_path"))


@query(f"""
SELECT doc_id, CASE WHEN contains(t, 'illegal start bytes') OR contains(t, 'format error decoding jpeg') OR (contains(t, 'jpeg') AND contains(t, 'format error')) THEN 'invalid_jpeg'
 WHEN contains(t, 'unexpected eof') OR contains(t, 'unexpected end') OR contains(t, 'end of file') OR contains(t, 'truncated') THEN 'truncated' WHEN contains(t, 'unsupported') THEN 'unsupported'
 WHEN contains(t, 'permission denied') OR contains(t, 'access is denied') THEN 'access' ELSE 'other' END AS class
FROM (SELECT doc_id, {_fold("['Format error decoding Jpeg: x', 'unexpected end', 'is truncated', 'Unsupported', 'Access is denied.', 'Permission denied', 'a JPEG format error', 'what'][1 + doc_id % 8] || coalesce(text, '')")} AS t FROM documents)
""")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of decode failures whose messages are followed by each text."""
    messages = ["Format error decoding Jpeg: x", "unexpected end", "is truncated", "Unsupported", "Access is denied.", "Permission denied", "a JPEG format error", "what"]
    m = F.element_at(F.array(*[F.lit(x) for x in messages]), (F.col("doc_id") % 8 + 1).cast("int"))
    return read_table(spark, d, "documents").select("doc_id", text.failure_class(F.concat(m, F.coalesce("text", F.lit("")))).alias("class"))


# Vectors


_NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query(f"""
SELECT row_id, e AS error, CASE WHEN e IS NULL THEN round((embedding[1] / {_NORM})::FLOAT::DOUBLE, 5) END AS first_value FROM (
 SELECT *, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN {_NORM} <= 1.1920929e-07 THEN 'zero' END AS e FROM images)
""")
def strict_units(spark: SparkSession, d: str) -> DataFrame:
    """Why a vector can't be scaled to length 1, or its first value when it is."""
    n = vector.strict_normalise(F.col("embedding"), 64)
    return _images(spark, d).select("row_id", n.alias("n")).select("row_id", "n.error", F.round(F.get("n.vector", F.lit(0)).cast("double"), 5).alias("first_value"))


@query("SELECT row_id, len(embedding) * 4 AS n_bytes, len(embedding) AS n_values, embedding IS NOT NULL AS same FROM images")
def stored_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as bytes and back."""
    v = F.transform("embedding", lambda x: F.coalesce(x, F.lit(float("nan")).cast("float")))
    coded = _images(spark, d).select("row_id", v.alias("v"), vector.encode_floats(v).alias("b"))
    back = coded.withColumn("back", F.when(F.size("v") == 0, F.col("v")).otherwise(vector.decode_or_fail(F.col("b"), F.size("v")))).withColumn("n", F.octet_length("b"))
    return back.select("row_id", F.col("n").alias("n_bytes"), F.when(F.col("v").isNotNull(), F.size("back")).alias("n_values"), F.coalesce(F.col("v").eqNullSafe(F.col("back")) & F.col("v").isNotNull(), F.lit(False)).alias("same"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, round(least(1.0, greatest(-1.0, list_dot_product(q, embedding::DOUBLE[]))), 6) AS cosine FROM q, embeddings
""")
def unit_cosines(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of the stated query set with all vectors, which must fit."""
    v = read_table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    topk.check_queries(q, "q")
    return v.join(F.broadcast(q), F.size("q") == F.size("embedding")).select("query_id", "vec_id", F.round(vector.unit_cosine(F.col("q"), F.col("embedding")), 6).alias("cosine"))


@query("""
WITH s AS (SELECT a.vec_id AS qi, b.vec_id AS ci, a.label = b.label AS l, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
t AS (SELECT qi, ci, row_number() OVER (PARTITION BY qi ORDER BY s DESC, ci) AS r FROM s WHERE qi <> ci QUALIFY r <= 10),
f AS (SELECT qi, ci, row_number() OVER (PARTITION BY qi ORDER BY s DESC, ci) AS r FROM s QUALIFY r <= 10)
SELECT round(avg((f.ci IS NOT NULL)::INT::DOUBLE), 6) AS recall, round(avg(CASE WHEN t.r = 1 THEN (coalesce(f.r, 0) = 1)::INT::DOUBLE END), 6) AS top1_agreement FROM t LEFT JOIN f ON t.qi = f.qi AND t.ci = f.ci
""")
def list_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of the ten nearest others is in the ten nearest with the query itself."""
    v = read_table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0")
    return topk.overlap(topk.top_k_per_query(q, v, "vec_id", "embedding", 10, exclude_self=False), topk.top_k_per_query(q, v, "vec_id", "embedding", 10), 10)


@query("SELECT row_id, least(3000, greatest(2000, (row_id + 1) // 2))::INTEGER AS most FROM images WHERE row_id IS NOT NULL")
def candidate_limits(spark: SparkSession, d: str) -> DataFrame:
    """The number of candidates of a component for a catalog as large as each row number."""
    limit = F.udf(hybrid.component_limit, "int")
    return _images(spark, d).where(F.col("row_id").isNotNull()).select("row_id", limit("row_id").alias("most"))


# Boxes


_EDGE = "least(1.0, greatest(0.0, {}))"
_X1, _Y1 = _EDGE.format("x"), _EDGE.format("y")
_X2, _Y2 = _EDGE.format("x + greatest(w, 0.0)"), _EDGE.format("y + greatest(h, 0.0)")


@query(f"""
SELECT DISTINCT face_id, round({_X1} * 7919) AS x, round({_Y1} * 7919) AS y, round(greatest({_X2} - {_X1}, 0) * 7919) AS width, round(greatest({_Y2} - {_Y1}, 0) * 7919) AS height
FROM (SELECT face_id, bbox.x::DOUBLE - 0.4 AS x, bbox.y::DOUBLE + 0.4 AS y, bbox.width::DOUBLE AS w, bbox.height::DOUBLE AS h FROM faces)
""")
def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes moved to the left and down, cut to the image, on a grid of 7,919 steps."""
    b = {f: F.col(f"bbox.{f}").cast("double") for f in ("x", "y", "width", "height")}
    box = F.struct((b["x"] - 0.4).alias("x"), (b["y"] + 0.4).alias("y"), b["width"].alias("width"), b["height"].alias("height"))
    out = read_table(spark, d, "faces").select("face_id", geometry.clamp_box(box).alias("b"))
    return out.select("face_id", *[F.round(F.col(f"b.{f}").cast("double") * 7919).alias(f) for f in ("x", "y", "width", "height")]).distinct()


@query("""
SELECT face_id, bool_and(coalesce(bbox.x >= 0 AND bbox.y >= 0 AND bbox.width > 0 AND bbox.height > 0 AND bbox.x::DOUBLE + bbox.width::DOUBLE <= 1.000001 AND bbox.y::DOUBLE + bbox.height::DOUBLE <= 1.000001, false)) AS fine,
 bool_and(coalesce(bbox.x >= 0 AND bbox.y >= 0 AND bbox.width > 0 AND bbox.height > 0 AND bbox.x::DOUBLE + 2 * bbox.width::DOUBLE <= 1.000001 AND bbox.y::DOUBLE + bbox.height::DOUBLE <= 1.000001, false)) AS twice FROM faces GROUP BY face_id
""")
def valid_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the box of a face, and one of twice its width, is valid."""
    b = {f: F.col(f"bbox.{f}").cast("double") for f in ("x", "y", "width", "height")}
    wide = F.struct(b["x"].alias("x"), b["y"].alias("y"), (2 * b["width"]).alias("width"), b["height"].alias("height"))
    return read_table(spark, d, "faces").groupBy("face_id").agg(F.bool_and(geometry.valid_box(F.col("bbox"))).alias("fine"), F.bool_and(geometry.valid_box(wide)).alias("twice"))


@query("""
SELECT DISTINCT face_id, CASE WHEN len(landmarks) = 5 THEN round((landmarks[1].x::DOUBLE * 639)::FLOAT::DOUBLE, 2) END AS x, CASE WHEN len(landmarks) = 5 THEN round((landmarks[5].y::DOUBLE * 479)::FLOAT::DOUBLE, 2) END AS y FROM faces
""")
def landmark_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The first and last landmark in pixels."""
    points = F.transform("landmarks", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    p = read_table(spark, d, "faces").select("face_id", geometry.landmarks_to_pixels(points, F.lit(640), F.lit(480)).alias("p"))
    return p.select("face_id", F.round(F.get("p", F.lit(0))["x"].cast("double"), 2).alias("x"), F.round(F.get("p", F.lit(4))["y"].cast("double"), 2).alias("y")).distinct()


# Stored faces


_STATE = "detector_id = 'facebox' AND detector_version = '2.1' AND detector_cache_revision = 'r3-t60' AND schema_version = 2"


@query(f"SELECT DISTINCT image_path FROM face_detection_state WHERE {_STATE} AND source_size IS NOT NULL AND source_modified IS NOT NULL")
def current_detections(spark: SparkSession, d: str) -> DataFrame:
    """States that hold for files as they were when they were made."""
    s = read_table(spark, d, "face_detection_state")
    return faces.detection_is_current(s, DETECTOR, F.col("source_size"), F.col("source_modified")).select("image_path").distinct()


_AGREE = """
SELECT DISTINCT f.face_id, f.image_path FROM faces f JOIN face_detection_state s ON s.image_path = f.image_path AND s.detector_id = f.detector_id AND s.detector_version = f.detector_version
 AND s.schema_version = f.schema_version AND s.source_size = f.source_size AND s.source_modified = f.source_modified
"""


@query(_AGREE + "JOIN face_detection_state i ON i.image_path = f.image_path AND i.source_size = f.source_size AND i.source_modified = f.source_modified")
def agreeing_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces that their state and their file, as the states saw it, agree with."""
    s = read_table(spark, d, "face_detection_state")
    files = s.select(F.col("image_path").alias("path"), F.col("source_size").alias("size"), F.col("source_modified").alias("modified"))
    return faces.agreeing(read_table(spark, d, "faces"), s, files).select("face_id", "image_path")


@query(f"""
WITH one AS (SELECT min(image_path) AS p FROM ({_AGREE}))
SELECT f.face_id, any_value(face_ordinal) AS face_ordinal, round(any_value(confidence)::DOUBLE, 6) AS confidence FROM faces f, one JOIN ({_AGREE}) a ON a.face_id = f.face_id WHERE f.image_path = p GROUP BY f.face_id
""")
def faces_of_an_image(spark: SparkSession, d: str) -> DataFrame:
    """The stored faces of the first image that has any."""
    f, s = read_table(spark, d, "faces"), read_table(spark, d, "face_detection_state")
    files = s.select(F.col("image_path").alias("path"), F.col("source_size").alias("size"), F.col("source_modified").alias("modified"))
    first = faces.agreeing(f, s, files).agg(F.min("image_path")).first()[0]
    return faces.faces_of(f, s, files, first if first is not None else "").select("face_id", "face_ordinal", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@query(base._STORED + "AND EXISTS (SELECT 1 FROM face_detection_state i WHERE i.image_path = f.image_path AND i.source_size = f.source_size AND i.source_modified = f.source_modified)")
def revision_join_files(spark: SparkSession, d: str) -> DataFrame:
    """Faces whose vector, detection, state and file agree, the files as the states saw them."""
    t = [read_table(spark, d, n) for n in ("face_embeddings", "faces", "face_detection_state")]
    files = t[2].select(F.col("image_path").alias("path"), F.col("source_size").alias("size"), F.col("source_modified").alias("modified"))
    return faces.compatible(*t, files, REVISION).select("face_id", "image_path")


@query(f"SELECT * FROM ({base.ORACLE['face_search']}) WHERE similarity >= 0.45")
def face_search_least(spark: SparkSession, d: str) -> DataFrame:
    """The same search, of which only what is similar enough is shown."""
    rows = base._compatible(spark, d, False).withColumn("library_id", F.lit("library"))
    first = rows.where(vector.is_unit(F.col("embedding"))).orderBy("face_id").select("face_id", "embedding").first()
    if first is None:
        return faces.search(rows, [1.0] + [0.0] * 127, "none", "library", min_similarity=faces.MIN_SIMILARITY)
    return faces.search(rows, list(first["embedding"]), first["face_id"], "library", min_similarity=faces.MIN_SIMILARITY)


@query("""
WITH f AS (SELECT DISTINCT ON (face_id) face_id, image_path, bbox, confidence FROM faces WHERE image_path IS NOT NULL AND bbox.width > 0 AND bbox.height > 0 ORDER BY face_id)
SELECT image_path, row_number() OVER (PARTITION BY image_path ORDER BY bbox.x, bbox.y, bbox.width, bbox.height, confidence DESC) - 1 AS face_ordinal, round(bbox.x::DOUBLE, 5) AS x, round(bbox.y::DOUBLE, 5) AS y FROM f
""")
def stored_face_places(spark: SparkSession, d: str) -> DataFrame:
    """The place in its image of each face that would be stored."""
    f = read_table(spark, d, "faces").where(F.col("image_path").isNotNull()).dropDuplicates(["face_id"])
    stored = faces.stored_faces(f.select("image_path", "confidence", "bbox", "landmarks", "source_size", "source_modified"), DETECTOR)
    return stored.select("image_path", F.col("face_ordinal").cast("bigint").alias("face_ordinal"), F.round(F.col("bbox.x").cast("double"), 5).alias("x"), F.round(F.col("bbox.y").cast("double"), 5).alias("y"))


@query("""
SELECT DISTINCT f.face_id FROM faces f JOIN face_detection_state s ON s.image_path = f.image_path AND s.source_size = f.source_size AND s.source_modified = f.source_modified
""")
def faces_of_unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    """Faces whose file, as the states saw it, is as it was."""
    s = read_table(spark, d, "face_detection_state")
    listing = s.select(F.col("image_path").alias("path"), F.col("source_size").alias("size"), F.col("source_modified").alias("modified"))
    f = read_table(spark, d, "faces")
    return faces.source_still_matches(f, listing).join(catalog.current_faces(f, listing).select("face_id").distinct(), "face_id", "left_semi").select("face_id").distinct()


@query("""
WITH p AS (SELECT image_path, source_size, source_modified FROM face_detection_state WHERE image_path IS NOT NULL AND exif_orientation BETWEEN 1 AND 8 AND oriented_width > 0 AND oriented_height > 0 QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY source_size, source_modified) = 1),
n AS (SELECT image_path, count(*) AS n FROM (SELECT DISTINCT face_id, image_path, bbox FROM faces) WHERE bbox.width > 0 AND bbox.height > 0 GROUP BY image_path)
SELECT p.image_path, coalesce(n, 0)::INTEGER AS face_count FROM p LEFT JOIN n ON n.image_path = p.image_path WHERE p.image_path IN (SELECT path FROM images)
""")
def replaced_detections(spark: SparkSession, d: str) -> DataFrame:
    """The states after the detections of all known images were replaced by the stored faces."""
    s, f = read_table(spark, d, "face_detection_state"), read_table(spark, d, "faces")
    done = catalog.last_of_key(s.where(F.col("image_path").isNotNull() & F.col("exif_orientation").between(1, 8) & (F.col("oriented_width") > 0) & (F.col("oriented_height") > 0)), "image_path", [F.col("source_size"), F.col("source_modified")])
    done = done.select("image_path", "source_size", "source_modified", "exif_orientation", "oriented_width", "oriented_height")
    found = f.where(F.col("image_path").isNotNull()).dropDuplicates(["face_id"]).select("image_path", "confidence", "bbox", "landmarks")
    state, _ = faces.replace_detections(s.limit(0), f.limit(0), _images(spark, d), done, found, DETECTOR)
    return state.select("image_path", F.col("face_count").cast("int").alias("face_count"))


# Catalog and collections


@query("SELECT 'images' AS t, count(*) AS n FROM images WHERE root IS DISTINCT FROM (SELECT min(path) FROM roots) UNION ALL SELECT 'discovered', count(*) FROM discovered_images WHERE root IS DISTINCT FROM (SELECT min(path) FROM roots) UNION ALL SELECT 'roots', count(*) - 1 FROM roots")
def removed_root(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay when the first root is removed."""
    roots = read_table(spark, d, "roots")
    first = roots.agg(F.min("path")).first()[0]
    left = catalog.remove_root(first, images=_images(spark, d), discovered=read_table(spark, d, "discovered_images"), roots=roots)
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT path FROM roots UNION ALL SELECT 'Z:\\New'")
def added_roots(spark: SparkSession, d: str) -> DataFrame:
    """The roots after a known and a new one were registered."""
    roots = read_table(spark, d, "roots").select("path")
    first = roots.agg(F.min("path")).first()[0]
    return catalog.add_root(catalog.add_root(roots, first), "Z:\\New")


@query("SELECT row_id, file_name FROM images")
def light_projection(spark: SparkSession, d: str) -> DataFrame:
    """The light columns by name."""
    return catalog.summary_projection(_images(spark, d)).select("row_id", "file_name")


@query("""
SELECT row_id, least(255, greatest(0, dominant.r)) AS r, least(255, greatest(0, dominant.b)) AS b, CASE WHEN material_texture_version = 1 THEN len(material_texture) END AS n_texture FROM images
""")
def projected_for_search(spark: SparkSession, d: str) -> DataFrame:
    """What a search reads of each row."""
    p = catalog.search_projection(_images(spark, d).withColumn("material_texture_version", F.col("material_texture_version")))
    return p.select("row_id", "dominant.r", "dominant.b", F.when(F.col("material_texture").isNotNull(), F.size("material_texture")).alias("n_texture"))


@query(f"""
SELECT row_id, round((CASE WHEN embedding_normalized THEN embedding[1]::DOUBLE ELSE (embedding[1] / {_NORM})::FLOAT::DOUBLE END), 4) AS first_value FROM images
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND {_NORM} > 1.1920929e-07
""")
def scanned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length 1, scaled where they weren't stored so."""
    return catalog.unit_embeddings(_images(spark, d)).select("row_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_value"))


@query("SELECT row_id, path FROM images WHERE row_id IN (SELECT event_id FROM events)")
def rows_by_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a key set."""
    keys = read_table(spark, d, "events").select(F.col("event_id").alias("row_id"))
    return catalog.by_keys(_images(spark, d), keys).select("row_id", "path")


@query(f"""
WITH x AS (SELECT DISTINCT path FROM discovered_images) SELECT path FROM x WHERE regexp_replace({_fold("replace(path, '/', '\\')")}, '\\\\+$', '') NOT IN (SELECT regexp_replace({_fold("replace(path, '/', '\\')")}, '\\\\+$', '') FROM images WHERE path IS NOT NULL)
""")
def missing_materials(spark: SparkSession, d: str) -> DataFrame:
    """Discovered paths, as a manifest, that the catalog doesn't have."""
    m = read_table(spark, d, "discovered_images").select("path").distinct()
    return manifests.missing_from_catalog(m, _images(spark, d).where(F.col("path").isNotNull()))


@query(f"""
SELECT DISTINCT x.root AS "group", i.row_id FROM images i JOIN discovered_images x ON regexp_replace({_fold("replace(x.path, '/', '\\')")}, '\\\\+$', '') = regexp_replace({_fold("replace(i.path, '/', '\\')")}, '\\\\+$', '')
""")
def labelled_materials(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the groups of a manifest made of the discovered paths."""
    m = read_table(spark, d, "discovered_images").select(F.col("root").alias("group"), "path")
    return manifests.labelled_rows(m, _images(spark, d)).select("group", "row_id").distinct()


_FILE_RULES = "files AS (SELECT 2::BIGINT AS collection_id, path FROM discovered_images UNION ALL SELECT 1, upper(path) FROM discovered_images)"


def _file_rules(spark: SparkSession, d: str) -> DataFrame:
    x = read_table(spark, d, "discovered_images")
    return x.select(F.lit(2).cast("bigint").alias("collection_id"), F.col("path").alias("file_path")).unionByName(x.select(F.lit(1).cast("bigint").alias("collection_id"), F.upper("path").alias("file_path")))


@query(f"WITH {base._RULES}, {_FILE_RULES} " + base._MEMBERS.format(t="images") + " UNION SELECT f.collection_id, i.path FROM images i JOIN files f ON f.path = i.path")
def members_by_files(spark: SparkSession, d: str) -> DataFrame:
    """Members of collections by folder and by file rules."""
    return collections.members(_images(spark, d), base._folders(spark), _file_rules(spark, d))


@query(f"WITH {_FILE_RULES} SELECT row_id FROM images i WHERE {_fold('replace(i.path, chr(92), chr(47))')} IN (SELECT {_fold('replace(path, chr(92), chr(47))')} FROM files WHERE collection_id = 1)")
def face_scope_by_files(spark: SparkSession, d: str) -> DataFrame:
    """Images that file rules, in capitals, put in a collection with face analysis."""
    on = collections.set_face_flag(spark.createDataFrame([(2, True)], "collection_id bigint, enabled boolean"), 1, True)
    on = collections.set_face_flag(on, 2, False)
    return collections.in_face_scope(_images(spark, d), on, base._folders(spark).limit(0), _file_rules(spark, d)).select("row_id")


@query("SELECT 1 AS id, 'New' AS name UNION ALL SELECT 2, 'Roof'")
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    """Collections created, renamed and deleted."""
    c = collections.create(collections.create(collections.create(spark.createDataFrame([], "id bigint, name string"), " Old "), "Roof"), "Third")
    return collections.delete(3, collections.rename(c, 1, "New"), base._folders(spark), base._files(spark))[0].select(F.col("id").cast("int").alias("id"), "name")


_KIND_SQL = """
WITH f AS (SELECT CASE WHEN row_id % 7 = 0 THEN '../' || row_id ELSE 'r/' || row_id END AS path, row_id, size, modified, embedding, color_histogram, material_texture,
  CASE WHEN row_id % 5 <> 0 THEN row_id END AS fp FROM images),
j AS (SELECT f.*, row_id % 3 <> 0 AS there, row_id % 4 = 0 AS resized, row_id % 6 = 0 AS touched, row_id % 11 = 0 AS broken, row_id % 13 = 0 AS other FROM f),
s AS (SELECT *, NOT (path LIKE '../%') AS safe FROM j),
u AS (SELECT CASE WHEN NOT safe THEN 'unsafe_relative_path' END AS kind FROM s
 UNION ALL SELECT CASE WHEN safe AND row_id % 19 = 0 THEN 'invalid_color_histogram' END FROM s UNION ALL SELECT CASE WHEN safe AND row_id % 23 = 0 THEN 'invalid_material_texture' END FROM s
 UNION ALL SELECT CASE WHEN safe AND row_id % 17 = 0 THEN 'invalid_embedding' END FROM s
 UNION ALL SELECT CASE WHEN safe AND NOT there THEN 'missing_source' END FROM s
 UNION ALL SELECT CASE WHEN safe AND there AND resized THEN 'source_size_changed' END FROM s
 UNION ALL SELECT CASE WHEN safe AND there AND touched THEN 'source_modified_changed' END FROM s
 UNION ALL SELECT CASE WHEN safe AND there AND fp IS NULL THEN 'missing_fingerprint' END FROM s
 UNION ALL SELECT CASE WHEN safe AND there AND fp IS NOT NULL AND NOT broken AND other THEN 'fingerprint_mismatch' END FROM s
 UNION ALL SELECT CASE WHEN safe AND there AND fp IS NOT NULL AND broken THEN 'source_decode_failed' END FROM s)
SELECT kind, count(*) AS n FROM u WHERE kind IS NOT NULL GROUP BY kind
"""


@query(_KIND_SQL)
def verify_all_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rows made wrong in each of the ten ways, by the problems found."""
    r = F.col("row_id")
    path = F.concat(F.when(r % 7 == 0, F.lit("../")).otherwise(F.lit("r/")), r.cast("string"))
    i = verify.with_blob_sizes(_images(spark, d)).withColumn("path", path).withColumn("content_fingerprint", F.when(r % 5 != 0, r))
    sized = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))
    rows = i
    for name, k in (("embedding", 17), ("color_histogram", 19), ("material_texture", 23)):
        rows = rows.withColumn(f"{name}_dim", F.when(r % k == 0, F.lit(1)).otherwise(F.lit(2))).withColumn(f"{name}_bytes", F.lit(8))
    there = i.where(r % 3 != 0)
    listing = there.select("path", F.when(r % 4 == 0, sized + 1).otherwise(sized).alias("size"), F.when(r % 6 == 0, F.coalesce("modified", F.lit(0)) + 1).otherwise(F.col("modified")).alias("modified"))
    prints = there.select("path", F.when(r % 11 == 0, None).when(r % 13 == 0, r + 1).otherwise(r).cast("bigint").alias("fingerprint"))
    return verify.problems(rows, listing, prints).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Runs and change feeds


@query("""
SELECT root, count(*) AS visited, count(CASE WHEN size > 0 THEN 1 END) AS processed, count(CASE WHEN size IS NULL THEN 1 END) AS skipped, count(CASE WHEN size <= 0 THEN 1 END) AS failed FROM images GROUP BY root
""")
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of a run over each root, where files without a size are skipped or fail."""
    outcome = F.when(F.col("size").isNull(), "skipped").when(F.col("size") > 0, "processed").otherwise("failed")
    return profile.run_summary(_images(spark, d).select("root", outcome.alias("outcome")))


@query("SELECT event_type, round(coalesce(avg(CASE WHEN value > 1e300 THEN value END), 0.0), 6) AS none, round(coalesce(avg(value), 0.0), 4) AS mean_value FROM events GROUP BY event_type")
def mean_values(spark: SparkSession, d: str) -> DataFrame:
    """Means, 0 where there is nothing."""
    e = read_table(spark, d, "events").groupBy("event_type")
    return e.agg(F.round(profile.mean_or_zero(F.when(F.col("value") > 1e300, F.col("value"))), 6).alias("none"), F.round(profile.mean_or_zero(F.col("value")), 4).alias("mean_value"))


@query("""
WITH e AS (SELECT 'user-' || user_id % 5 AS path, event_type AS k, ts FROM events WHERE event_type <> 'view'),
m AS (SELECT k, ts, path, CASE WHEN ts - lag(ts) OVER (PARTITION BY k ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM e),
n AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT k AS library_id, count(*) AS n_events, list_aggregate(list_sort(list_distinct(list(path))), 'string_agg', ',') AS paths, min(ts) AS started FROM n GROUP BY k, s
""")
def change_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of changes of each library with their distinct sorted paths; mere access is left out."""
    e = read_table(spark, d, "events").select(F.col("event_type").alias("library_id"), F.when(F.col("event_type") == "view", "Access").otherwise("modify").alias("kind"), F.concat(F.lit("user-"), (F.col("user_id") % 5).cast("string")).alias("path"), "ts")
    out = changes.batches(changes.relevant(e), gap="2 hours")
    return out.select("library_id", "n_events", F.array_join("paths", ",").alias("paths"), F.col("started").cast("timestamp_ntz").alias("started"))


@query("""
WITH m AS (SELECT event_type AS k, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 420 MILLISECOND THEN 0 ELSE 1 END AS b FROM events),
n AS (SELECT k, ts, sum(b) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT k AS library_id, count(*) AS n_events, min(ts) AS started FROM n GROUP BY k, s
""")
def quiet_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events by the default gap."""
    e = read_table(spark, d, "events").select(F.col("event_type").alias("library_id"), F.lit("modify").alias("kind"), F.col("event_id").cast("string").alias("path"), "ts")
    return changes.batches(changes.relevant(e)).select("library_id", "n_events", F.col("started").cast("timestamp_ntz").alias("started"))
