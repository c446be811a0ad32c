"""The catalog as DataFrames: merges, deletions, scan generations, change detection, roots and libraries.

Every function returns the new state as a DataFrame; ``sources.snapshot`` writes it. Keys are unique in the old state; of several new rows
with one key the last by ``order`` counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import text, vector

#: Derived columns that an upsert resets, with what they become.
RESET = {"material_texture": None, "material_texture_version": 0, "embedding": None, "embedding_normalized": False, "content_fingerprint": None}
TEXTURE_VERSION = 1
MAX_GENERATION = (1 << 63) - 1


def last_of_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "path", kept: tuple[str, ...] = ("last_seen_scan",), reset: dict | None = None) -> DataFrame:
    """Rows of ``new`` replace or join those of ``old``; ``kept`` columns stay as they were, ``reset`` columns are cleared.

    One shuffle on the key, by a full outer join; columns of ``old`` that ``new`` lacks stay for untouched rows and become null for new ones.
    """
    reset = RESET if reset is None else reset
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()
    out = []
    for f in old.schema.fields:
        before = F.col(f"o.{f.name}")
        if f.name == key:
            value = F.coalesce(F.col(f"n.{key}"), before)
        elif f.name in kept:
            value = F.coalesce(before, F.col(f"n.{f.name}") if f.name in new.columns else F.lit(None))
        elif f.name in reset:
            value = F.when(fresh, F.lit(reset[f.name])).otherwise(before)
        else:
            value = F.when(fresh, F.col(f"n.{f.name}") if f.name in new.columns else F.lit(None)).otherwise(before)
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(*out)


def update_columns(old: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """The columns of ``changes`` replace those of ``old`` where it has the key and a value; other keys don't matter."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    out = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns]
    return old.join(renamed, key, "left").select(*out)


def set_embeddings(old: DataFrame, embeddings: DataFrame, key: str = "path") -> DataFrame:
    """Stores vectors scaled to length 1."""
    scaled = embeddings.select(key, vector.normalise(F.col("embedding")).alias("embedding"), F.lit(True).alias("embedding_normalized"))
    return update_columns(old, scaled, key)


def in_subtree(path: Column, target: str, separator: str = "\\") -> Column:
    """The path itself, exactly, or below it without regard to case."""
    prefix = target if target.endswith(separator) else target + separator
    return (path == target) | F.startswith(text.nocase(path), F.lit(text.fold(prefix)))


def delete_subtree(df: DataFrame, target: str, separator: str = "\\") -> tuple[DataFrame, DataFrame]:
    """(what stays, the deleted paths)."""
    inside = F.coalesce(in_subtree(F.col("path"), target, separator), F.lit(False))
    return df.where(~inside), df.where(inside).select("path")


def remove_root(root: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of a root; roots lose their own row."""
    return {name: df.where(~F.col("path" if name == "roots" else "root").eqNullSafe(root)) for name, df in tables.items()}


def add_root(roots: DataFrame, root: str) -> DataFrame:
    """The roots with one more, unless it is there already."""
    new = roots.sparkSession.createDataFrame([(root,)], "path string").join(roots.select("path"), "path", "left_anti")
    return roots.unionByName(new, allowMissingColumns=True)


def root_counts(roots: DataFrame, images: DataFrame, discovered: DataFrame) -> DataFrame:
    """(path, indexed, discovered) of every root; no fewer discovered than indexed."""
    i = images.groupBy("root").agg(F.count(F.lit(1)).alias("_i"))
    d = discovered.groupBy("root").agg(F.count(F.lit(1)).alias("_d"))
    zero = F.lit(0).cast("bigint")
    joined = roots.select("path").join(i.withColumnRenamed("root", "path"), "path", "left").join(d.withColumnRenamed("root", "path"), "path", "left")
    return joined.select("path", F.coalesce("_i", zero).alias("indexed"), F.greatest(F.coalesce("_d", zero), F.coalesce("_i", zero)).alias("discovered"))


def next_generation(images: DataFrame, discovered: DataFrame) -> DataFrame:
    """(generation): one more than the latest of both tables, at least 1; 1 again after the largest number."""
    both = images.select("last_seen_scan").unionByName(discovered.select("last_seen_scan"))
    latest = both.agg(F.coalesce(F.max("last_seen_scan"), F.lit(0)).alias("m"))
    return latest.select(F.when(F.col("m") == MAX_GENERATION, F.lit(1)).otherwise(F.greatest(F.col("m") + 1, F.lit(1))).cast("bigint").alias("generation"))


def mark_seen(df: DataFrame, seen: DataFrame, generation: int, add_missing: bool = False) -> DataFrame:
    """Rows of the seen paths get the generation; with ``add_missing`` unknown paths are added with their root."""
    known = df.join(seen.select("path", F.lit(True).alias("_seen"), *([F.col("root").alias("_root")] if add_missing else [])).dropDuplicates(["path"]), "path", "full_outer" if add_missing else "left")
    out = []
    for c in df.columns:
        if c == "last_seen_scan":
            out.append(F.when(F.col("_seen"), F.lit(generation).cast("bigint")).otherwise(F.col(c)).alias(c))
        elif c == "root" and add_missing:
            out.append(F.coalesce("_root", c).alias(c))
        else:
            out.append(F.col(c))
    return known.select(*out)


def sweep(df: DataFrame, generation: int, clean_roots: list[str]) -> DataFrame:
    """Without rows that a complete scan of their root didn't see. Roots that weren't traversed to the end lose nothing."""
    stale = F.col("root").isin(clean_roots) & (F.col("last_seen_scan") != generation)
    return df.where(~F.coalesce(stale, F.lit(False)))


def changes(listing: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """(path, status): new, changed or unchanged files of a listing (path, size, modified). Unchanged means equal size and time."""
    state = catalog.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.lit(True).alias("_known"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    status = F.when(F.col("_known").isNull(), "new").when(same & ~F.lit(force), "unchanged").otherwise("changed")
    return listing.join(state, "path", "left").select("path", status.alias("status"))


def needs_descriptor(df: DataFrame) -> DataFrame:
    """Rows that lack a descriptor or have one of another version."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ("visual_hash", "color_histogram", "material_texture")])
    return df.where(lacks | (F.col("material_texture_version") != TEXTURE_VERSION))


def needs_embedding(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNull())


def replace_root(portable: DataFrame, catalog: DataFrame, root: str, separator: str = "\\") -> DataFrame:
    """The portable table of a root as the catalog has it: relative paths, empty root; nothing else stays.

    ``portable`` only gives the columns.
    """
    rows = catalog.where(F.col("root") == root).withColumn("path", text.relative_to(F.col("path"), F.lit(root), separator)).withColumn("root", F.lit(""))
    return rows.where(F.col("path").isNotNull()).select(*portable.columns)


def mirror_paths(portable: DataFrame, catalog: DataFrame, root: str, paths: DataFrame, separator: str = "\\") -> DataFrame:
    """The portable table with the rows of some paths taken from the catalog; the others stay."""
    rows = replace_root(portable, catalog.join(paths.select("path").distinct(), "path", "left_semi"), root, separator)
    return portable.join(rows.select("path"), "path", "left_anti").unionByName(rows)


def import_root(catalog: DataFrame, portable: DataFrame, root: str, separator: str = "\\") -> DataFrame:
    """The catalog with the rows of a root replaced by those of its portable table, with full paths."""
    rows = portable.withColumn("path", text.absolute_from(F.col("path"), F.lit(root), separator)).withColumn("root", F.lit(root))
    return catalog.where(~F.col("root").eqNullSafe(root)).unionByName(rows.select(*catalog.columns))


def relocate(df: DataFrame, column: str, old_root: str, new_root: str, separator: str = "\\") -> DataFrame:
    """Paths below one root moved below another, whole components only; rows that become equal are kept once."""
    rest = text.relative_to(F.col(column), F.lit(old_root), separator)
    moved = F.when(rest.isNull(), F.col(column)).otherwise(text.absolute_from(rest, F.lit(new_root), separator))
    return df.withColumn(column, moved).distinct()


def register_library(registry: DataFrame, library_id: str, root: str) -> DataFrame:
    """The registry (library_id, root_path), one to one, with this pair; older pairs of either are dropped."""
    kept = registry.where((F.col("library_id") != library_id) & (F.col("root_path") != root))
    return kept.unionByName(registry.sparkSession.createDataFrame([(library_id, root)], "library_id string, root_path string"))


def union_libraries(libraries: dict[str, DataFrame]) -> DataFrame:
    """All rows with their library_id."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("library_id", F.lit(name)) for name, df in libraries.items()])


#: So many roots at most are matched as constants of the plan.
FEW_ROOTS = 200


def owning_root(paths: DataFrame, roots: DataFrame, column: str = "path") -> DataFrame:
    """``paths`` with ``root``, the longest root that is the path or a folder above it, null if there is none.

    Up to ``FEW_ROOTS`` roots are compared with each path, the longest first, without a shuffle; of more each path is matched through its own folders, an
    equi-join. A root matches whole components only.
    """
    r = roots.where(F.col("path").isNotNull()).select(F.regexp_replace("path", r"[\\/]+$", "").alias("_folder"), F.col("path").alias("_root")).distinct()
    few = r.limit(FEW_ROOTS + 1).collect()
    if len(few) <= FEW_ROOTS:
        p = F.col(column)
        below = lambda folder: (p != "") & ((p == folder) | F.startswith(p, F.lit(folder + "/")) | F.startswith(p, F.lit(folder + "\\")))
        longest = sorted(few, key=lambda x: (-len(x["_folder"]), x["_root"]))
        return paths.drop("root").withColumn("root", F.coalesce(*[F.when(below(x["_folder"]), F.lit(x["_root"])) for x in longest], F.lit(None).cast("string")))
    above = paths.select(column).distinct().withColumn("_folder", F.explode(text.folders_above(F.col(column))))
    best = above.join(r, "_folder").groupBy(column).agg(F.max_by("_root", F.length("_folder")).alias("root"))
    return paths.drop("root").join(best, column, "left")


def remove_paths(libraries: DataFrame, roots: DataFrame, paths: DataFrame, separator: str = "\\") -> DataFrame:
    """Rows of all libraries (root, relative path) without the subtrees of absolute paths, each in the library that owns it."""
    owned = owning_root(paths.select("path"), roots).where(F.col("root").isNotNull())
    targets = owned.select(F.col("root").alias("_root"), text.relative_to(F.col("path"), F.col("root"), separator).alias("_target")).distinct()
    above = libraries.select("root", "path").distinct().withColumn("_above", F.explode(text.folders_above(F.col("path"))))
    doomed = above.join(targets, (F.col("root") == F.col("_root")) & (F.col("_above") == F.col("_target")), "left_semi").select("root", "path").distinct()
    return libraries.join(doomed, ["root", "path"], "left_anti")


def file_states(df: DataFrame) -> DataFrame:
    """(path, size, modified, width, height, content_fingerprint, has_embedding); negative sizes and times count as 0."""
    zero = F.lit(0).cast("bigint")
    return df.select(
        "path", F.greatest(F.coalesce("size", zero), zero).alias("size"), F.greatest(F.coalesce("modified", zero), zero).alias("modified"),
        F.greatest(F.coalesce("width", F.lit(0)), F.lit(0)).alias("width"), F.greatest(F.coalesce("height", F.lit(0)), F.lit(0)).alias("height"),
        "content_fingerprint", F.col("embedding").isNotNull().alias("has_embedding"),
    )


def search_projection(df: DataFrame) -> DataFrame:
    """What a search needs, without vectors: a texture of another version is null, colours lie in 0 to 255."""
    channel = lambda c: F.least(F.greatest(F.col(f"dominant.{c}"), F.lit(0)), F.lit(255)).alias(c)
    return df.select(
        "row_id", "path", "root", "file_name", "extension", "size", "modified", "width", "height", F.struct(channel("r"), channel("g"), channel("b")).alias("dominant"),
        "visual_hash", "color_histogram", F.when(F.col("material_texture_version") == TEXTURE_VERSION, F.col("material_texture")).alias("material_texture"),
    )


def summary_projection(df: DataFrame) -> DataFrame:
    """The light columns, by name."""
    return df.select("row_id", "path", "root", "file_name", "extension", "size", "modified", "width", "height", "description", "keywords", "dominant").orderBy(text.nocase(F.col("file_name")), "path", "row_id")


def unit_embeddings(df: DataFrame) -> DataFrame:
    """(row_id, embedding): vectors of length 1; those that aren't are scaled, those that can't be are left out."""
    v = F.col("embedding")
    good = df.where((F.size(v) > 0) & vector.all_finite(v) & (vector.norm(v) > vector.EPSILON))
    return good.select("row_id", F.when(F.col("embedding_normalized"), v).otherwise(vector.normalise(v)).alias("embedding"))


def by_keys(df: DataFrame, keys: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of a key set, which decides itself whether it is small enough to be broadcast."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def current_faces(faces: DataFrame, images: DataFrame) -> DataFrame:
    """Faces whose image still has the size and time they were detected on: what a change invalidates isn't current."""
    i = images.select(F.col("path").alias("image_path"), F.col("size").alias("source_size"), F.col("modified").alias("source_modified"))
    return faces.join(i.distinct(), ["image_path", "source_size", "source_modified"], "left_semi")
