"""Collections of files and folders: rules, members, counts and the switch for face analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import text


def create(collections: DataFrame, name: str) -> DataFrame:
    """The collections (id, name) with one more; the name is trimmed and new, whatever its case."""
    name = name.strip()
    if not name:
        raise ValueError("a collection needs a name")
    if collections.where(text.nocase(F.col("name")) == text.fold(name)).limit(1).count():
        raise ValueError(f"there is a collection {name!r} already")
    new = collections.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("bigint").alias("id")).withColumn("name", F.lit(name))
    return collections.unionByName(new)


def rename(collections: DataFrame, collection_id: int, name: str) -> DataFrame:
    name = name.strip()
    if not name:
        raise ValueError("a collection needs a name")
    if not collections.where(F.col("id") == collection_id).limit(1).count():
        raise ValueError(f"no collection {collection_id}")
    if collections.where((text.nocase(F.col("name")) == text.fold(name)) & (F.col("id") != collection_id)).limit(1).count():
        raise ValueError(f"there is a collection {name!r} already")
    return collections.withColumn("name", F.when(F.col("id") == collection_id, F.lit(name)).otherwise(F.col("name")))


def delete(collection_id: int, collections: DataFrame, folders: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a collection; images stay."""
    return collections.where(F.col("id") != collection_id), folders.where(F.col("collection_id") != collection_id), files.where(F.col("collection_id") != collection_id)


def add_rules(rules: DataFrame, collection_id: int, paths: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rules with the new paths, the rows really added): paths that are there already, whatever their case, don't count."""
    new = paths.select(F.col("path").alias(column)).where(F.col(column).isNotNull())
    once = new.withColumn("_k", text.nocase(F.col(column))).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(column))).where("_n = 1")
    have = rules.where(F.col("collection_id") == collection_id).select(text.nocase(F.col(column)).alias("_k"))
    added = once.join(have, "_k", "left_anti").select(F.lit(collection_id).cast("bigint").alias("collection_id"), column)
    return rules.unionByName(added), added


def remove_rule(rules: DataFrame, collection_id: int, path: str, column: str) -> DataFrame:
    return rules.where(~((F.col("collection_id") == collection_id) & (text.nocase(F.col(column)) == text.fold(path))))


def assignable(paths: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexed paths, the others): only indexed files can be assigned."""
    known = images.select("path").distinct()
    return paths.join(known, "path", "left_semi"), paths.join(known, "path", "left_anti")


def members(paths: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """(collection_id, path): files named by a rule or below a folder of a rule, by whole components and with regard to case.

    Every path is met through its own folders, an equi-join on the folder.
    """
    p = paths.select("path").distinct()
    rules = folders.select("collection_id", F.regexp_replace("folder_path", r"[\\/]+$", "").alias("_folder")).distinct()
    by_folder = p.withColumn("_folder", F.explode(text.folders_above(F.col("path")))).join(rules, "_folder").select("collection_id", "path")
    by_file = p.join(files.select("collection_id", F.col("file_path").alias("path")), "path").select("collection_id", "path")
    return by_folder.unionByName(by_file).distinct()


def counts(collections: DataFrame, images: DataFrame, discovered: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """(id, indexed, discovered, total) of every collection; the total is the larger."""
    n = lambda paths, name: members(paths, folders, files).groupBy("collection_id").agg(F.count(F.lit(1)).alias(name))
    zero = F.lit(0).cast("bigint")
    joined = collections.select(F.col("id").alias("collection_id")).join(n(images, "_i"), "collection_id", "left").join(n(discovered, "_d"), "collection_id", "left")
    i, d = F.coalesce("_i", zero), F.coalesce("_d", zero)
    return joined.select(F.col("collection_id").alias("id"), i.alias("indexed"), d.alias("discovered"), F.greatest(i, d).alias("total"))


def set_face_flag(settings: DataFrame, collection_id: int, enabled: bool) -> DataFrame:
    """The settings (collection_id, enabled): on is a row, off is none; results stay."""
    others = settings.where(F.col("collection_id") != collection_id)
    return others.unionByName(settings.sparkSession.createDataFrame([(collection_id, True)], "collection_id bigint, enabled boolean")) if enabled else others


def in_face_scope(images: DataFrame, settings: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """Images in at least one enabled collection: a named file or below a named folder, without regard to case, either separator."""
    on = settings.where("enabled").select("collection_id").distinct()
    file_keys = files.join(on, "collection_id", "left_semi").select(text.nocase(F.col("file_path")).alias("_k"))
    folder_keys = folders.join(on, "collection_id", "left_semi").select(text.nocase(F.col("folder_path")).alias("_k"))
    paths = images.select("path").distinct()
    by_file = paths.withColumn("_k", text.nocase(F.col("path"))).join(file_keys, "_k", "left_semi").select("path")
    by_folder = paths.withColumn("_k", F.explode(F.transform(text.folders_above(F.col("path")), text.nocase))).join(folder_keys, "_k", "left_semi").select("path")
    return images.join(by_file.unionByName(by_folder).distinct(), "path", "left_semi")
