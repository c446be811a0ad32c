"""Queries of the general data-processing operators, with their SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.operators import orphans, packed
from vitrail.sources.tables import read_table


def _references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    images = read_table(spark, d, "images")
    faces = read_table(spark, d, "faces")
    state = read_table(spark, d, "face_detection_state")
    vectors = read_table(spark, d, "face_embeddings")
    image_key = orphans.ascii_path_key(F.col("path"))
    path_key = orphans.ascii_path_key(F.col("image_path"))
    period = orphans.month(F.col("ingested_at"))
    return [
        orphans.Reference("faces", faces, path_key, F.col("face_id"), period, images, image_key),
        orphans.Reference("face_detection_state", state, path_key, F.col("image_path"), period, images, image_key),
        orphans.Reference("face_embeddings", vectors, F.col("face_id"), F.col("face_id"), period, faces, F.col("face_id")),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose reference exists nowhere in the other table."""
    return orphans.orphan_records(_references(spark, d))


def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and distinct orphan keys per table and month."""
    return orphans.orphan_counts(_references(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per keyword of every image row."""
    return packed.split_packed(read_table(spark, d, "images"), "row_id", "keywords")


QUERIES = {"p4_found": p4_found, "p4_orphan_counts": p4_orphan_counts, "p5_found": p5_found}

_KEY = r"translate({c}, '\ABCDEFGHIJKLMNOPQRSTUVWXYZ', '/abcdefghijklmnopqrstuvwxyz')"
_REFS = f"""
WITH img AS (SELECT DISTINCT {_KEY.format(c="path")} AS k FROM images WHERE path IS NOT NULL),
fid AS (SELECT DISTINCT face_id AS k FROM faces WHERE face_id IS NOT NULL),
refs AS (
  SELECT 'faces' AS table_name, {_KEY.format(c="image_path")} AS k, face_id AS record_key, strftime(ingested_at, '%Y-%m') AS period_ym
  FROM faces
  UNION ALL
  SELECT 'face_detection_state', {_KEY.format(c="image_path")}, image_path, strftime(ingested_at, '%Y-%m') FROM face_detection_state
  UNION ALL
  SELECT 'face_embeddings', face_id, face_id, strftime(ingested_at, '%Y-%m') FROM face_embeddings),
orphan AS (
  SELECT * FROM refs WHERE regexp_matches(k, '\\S')
  AND NOT CASE WHEN table_name = 'face_embeddings' THEN k IN (SELECT k FROM fid) ELSE k IN (SELECT k FROM img) END)
"""

ORACLE = {
    "p4_found": _REFS + "SELECT DISTINCT table_name, record_key, period_ym FROM orphan",
    "p4_orphan_counts": _REFS
    + "SELECT table_name, period_ym, count(*) AS n_references, count(DISTINCT k) AS n_keys FROM orphan GROUP BY table_name, period_ym",
    "p5_found": r"""
WITH f AS (SELECT row_id, trim(keywords, ' ' || chr(9) || chr(10) || chr(13)) AS k FROM images WHERE keywords IS NOT NULL),
u AS (SELECT row_id, k LIKE '[%]' AS listed, CASE WHEN k LIKE '[%]' THEN k[2:-2] ELSE k END || ',' AS k FROM f),
t AS (SELECT row_id, listed, generate_subscripts(l, 1) AS place, unnest(l) AS raw FROM (
  SELECT row_id, listed, regexp_extract_all(k, '[ ]*(?:"(?:\\.|""|[^"\\])*"[ ]*|“[^”]*”[ ]*|„[^“]*“[ ]*|«[^»]*»[ ]*|‘[^’]*’[ ]*|''(?:\\.|''''|[^''\\])*''[ ]*|(?:\\.|[^,;|\n\r\t•·、；，\\])*)[,;|\n\r\t•·、；，]') AS l FROM u)),
p AS (SELECT row_id, place, trim(raw[:-2]) AS v FROM t),
c AS (SELECT row_id, place, CASE
    WHEN regexp_full_match(v, '(?s)".*"') AND length(v) > 1 THEN trim(replace(regexp_replace(v[2:-2], '\\([,;|\n\r\t•·、；，\\"''“”\[\]])', '\1', 'g'), '""', '"'))
    WHEN regexp_full_match(v, '(?s)''.*''') AND length(v) > 1 THEN trim(replace(regexp_replace(v[2:-2], '\\([,;|\n\r\t•·、；，\\"''“”\[\]])', '\1', 'g'), '''''', ''''))
    WHEN regexp_full_match(v, '(?s)(“.*”|„.*“|«.*»|‘.*’)') THEN trim(v[2:-2])
    ELSE trim(regexp_replace(v, '\\([,;|\n\r\t•·、；，\\"''“”\[\]])', '\1', 'g')) END AS keyword FROM p)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY place)::INTEGER AS pos, keyword FROM c WHERE keyword <> ''
""",
}
