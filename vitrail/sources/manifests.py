"""Labelled manifests: lines of columns separated by tabs. Each reader returns its rows and the lines it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrail.functions import geometry, text

_TAGS = {
    "model": 9,
    "image": 2,
    "gt": 6,
    "pred": 7,
    "identity": 6,
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, columns): lines that aren't blank or comments, trimmed columns. The number orders lines of one file."""
    raw = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    kept = raw.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return kept.select("line", F.transform(F.split("value", "\t"), lambda x: F.trim(x)).alias("columns"))


def _double(c: Column) -> Column:
    return c.try_cast("double")


def material_manifest(spark: SparkSession, path: str, base: str, separator: str = "/") -> tuple[DataFrame, DataFrame]:
    """((group, path), (line, reason)): labelled files; relative paths are below ``base``; a first line "group path" is a heading.

    A path that repeats in its group counts once; one in several groups is rejected, and so are groups of one.
    """
    rows = lines(spark, path)
    two = rows.where((F.size("columns") >= 2) & (F.get("columns", F.lit(0)) != "") & (F.get("columns", F.lit(1)) != ""))
    bad = rows.join(two.select("line"), "line", "left_anti").select("line", F.lit("two columns are needed").alias("reason"))
    heading = (text.nocase(F.get("columns", F.lit(0))) == "group") & (text.nocase(F.get("columns", F.lit(1))) == "path")
    named = two.where(~heading).select("line", F.get("columns", F.lit(0)).alias("group"), F.get("columns", F.lit(1)).alias("_p"))
    absolute = F.rlike("_p", F.lit(r"^([A-Za-z]:|[\\/])"))
    named = named.withColumn("path", F.when(absolute, F.col("_p")).otherwise(F.concat(F.lit(base.rstrip("/\\") + separator), F.col("_p")))).withColumn("_k", text.key_folded_trimmed(F.col("path")))
    groups = named.groupBy("_k").agg(F.count_distinct("group").alias("_g"))
    clash = named.join(groups.where("_g > 1"), "_k", "left_semi").select("line", F.lit("path in several groups").alias("reason"))
    first = F.row_number().over(Window.partitionBy("_k").orderBy("line"))
    single = named.join(groups.where("_g = 1"), "_k", "left_semi").withColumn("_n", first).where("_n = 1")
    size = single.groupBy("group").agg(F.count(F.lit(1)).alias("_s"))
    small = single.join(size.where("_s < 2"), "group", "left_semi").select("line", F.lit("group of one").alias("reason"))
    return single.join(size.where("_s >= 2"), "group", "left_semi").select("group", "path"), bad.unionByName(clash).unionByName(small)


def face_manifest(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by tag, (line, reason)): one table each for model, image, gt, pred and identity records, and everything that is wrong.

    The tables have the records whose own line is in order; the rejected lines tell what else forbids the use of the manifest.
    """
    rows = lines(spark, path).withColumn("tag", text.nocase(F.get("columns", F.lit(0))))
    c = F.col("columns")
    at = lambda k: F.get(c, F.lit(k))
    known = F.col("tag").isin(*_TAGS)
    needed = F.create_map(*[x for t, n in _TAGS.items() for x in (F.lit(t), F.lit(n))])[F.col("tag")]
    shaped = rows.where(known & (F.size(c) == needed))
    bad = rows.where(~(known & (F.size(c) == needed))).select("line", F.when(known, "wrong number of columns").otherwise("unknown record").alias("reason"))
    flag = lambda x: text.nocase(x).isin("true", "1", "yes")
    box = lambda k: F.struct(*[_double(at(k + i)).alias(n) for i, n in enumerate(("x", "y", "width", "height"))])
    tables = {
        "model": shaped.where("tag = 'model'").select("line", *[at(i + 1).alias(n) for i, n in enumerate(("id", "version", "provider", "license"))], flag(at(5)).alias("redistributable"), flag(at(6)).alias("commercial_use"), text.nocase(at(7)).alias("source_mode"), at(8).alias("source")),
        "image": shaped.where("tag = 'image'").select("line", at(1).alias("image_id")),
        "gt": shaped.where("tag = 'gt'").select("line", at(1).alias("image_id"), box(2).alias("bbox")),
        "pred": shaped.where("tag = 'pred'").select("line", at(1).alias("image_id"), _double(at(2)).alias("confidence"), box(3).alias("bbox")),
        "identity": shaped.where("tag = 'identity'").select("line", at(1).alias("query_id"), at(2).alias("query_person"), at(3).alias("candidate_id"), at(4).alias("candidate_person"), _double(at(5)).alias("similarity")),
    }
    return tables, _face_rejects(tables, bad)


def _face_rejects(t: dict[str, DataFrame], bad: DataFrame) -> DataFrame:
    say = lambda df, reason: df.select("line", F.lit(reason).alias("reason"))
    repeated = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("line"))).where("_n > 1")
    m, i = t["model"], t["identity"]
    empty = F.lit(False)
    for n in ("id", "version", "provider", "license", "source"):
        empty = empty | (F.col(n) == "")
    out = [
        say(m.where(empty), "empty model field"),
        say(m.where(~F.col("source_mode").isin("bundled", "external")), "unknown source mode"),
        say(m.where((F.col("source_mode") == "bundled") & ~(F.col("redistributable") & F.col("commercial_use"))), "restricted model marked bundled"),
        say(m.withColumn("_k", F.lit(1)).transform(lambda df: repeated(df, "_k")), "more than one model"),
        say(repeated(t["image"], "image_id"), "image declared twice"),
        say(t["image"].where(F.col("image_id") == ""), "empty image id"),
    ]
    for tag in ("gt", "pred"):
        out.append(say(t[tag].where(~geometry.valid_box(F.col("bbox"))), "box out of range"))
        out.append(say(t[tag].join(t["image"].select("image_id"), "image_id", "left_anti"), "undeclared image"))
    out.append(say(t["pred"].where(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), "confidence out of range"))
    out.append(say(i.where(F.col("query_id") == F.col("candidate_id")), "face compared with itself"))
    out.append(say(i.where(~F.coalesce(F.col("similarity").between(-1.000001, 1.000001), F.lit(False))), "similarity out of range"))
    out.append(say(repeated(i, "query_id", "candidate_id"), "pair given twice"))
    people = i.select("line", F.explode(F.array(F.struct(F.col("query_id").alias("face"), F.col("query_person").alias("person")), F.struct(F.col("candidate_id").alias("face"), F.col("candidate_person").alias("person")))).alias("p")).select("line", "p.face", "p.person")
    several = people.groupBy("face").agg(F.count_distinct("person").alias("_n")).where("_n > 1")
    out.append(say(people.join(several, "face", "left_semi").select("line").distinct(), "face of several persons"))
    for x in out:
        bad = bad.unionByName(x)
    return bad


def runner_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(model, faces, (line, reason)): model records of 7 columns and face records of 14 with ten landmark numbers in [0, 1]."""
    rows = lines(spark, path).withColumn("tag", text.nocase(F.get("columns", F.lit(0))))
    c = F.col("columns")
    at = lambda k: F.get(c, F.lit(k))
    model = rows.where((F.col("tag") == "model") & (F.size(c) == 7)).select("line", *[at(k + 1).alias(n) for k, n in enumerate(("path", "provider", "license", "redistributable", "commercial_use", "source"))])
    points = F.array(*[F.struct(_double(at(4 + 2 * k)).alias("x"), _double(at(5 + 2 * k)).alias("y")) for k in range(5)])
    faces = rows.where((F.col("tag") == "face") & (F.size(c) == 14)).select("line", at(1).alias("face_id"), at(2).alias("person_id"), at(3).alias("image_path"), points.alias("landmarks"))
    fine = F.forall("landmarks", lambda p: F.coalesce(p["x"].between(0, 1) & p["y"].between(0, 1), F.lit(False)))
    bad = rows.join(model.select("line").unionByName(faces.select("line")), "line", "left_anti").select("line", F.lit("unknown record or wrong number of columns").alias("reason"))
    bad = bad.unionByName(faces.where(~fine).select("line", F.lit("landmark out of range").alias("reason")))
    return model, faces.where(fine), bad


def from_folders(listing: DataFrame, root: str, min_size: int = 2) -> DataFrame:
    """(group, path): files grouped by their folder right below ``root``; folders of one name under several roots are told apart by their root.

    ``listing`` has root and path. Groups of fewer than ``min_size`` files are left out.
    """
    rest = text.relative_to(F.col("path"), F.col("root"), "/")
    rows = listing.withColumn("_g", F.regexp_extract(rest, r"^([^/\\]+)[/\\]", 1)).where(F.col("_g") != "")
    roots = rows.groupBy(text.nocase(F.col("_g")).alias("_k")).agg(F.count_distinct("root").alias("_r"))
    named = rows.withColumn("_k", text.nocase(F.col("_g"))).join(roots, "_k")
    group = F.when(F.col("_r") > 1, F.concat(text.file_name(F.col("root")), F.lit("/"), F.col("_g"))).otherwise(F.col("_g"))
    out = named.select(group.alias("group"), "path").distinct()
    return out.join(out.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size), "group", "left_semi")


def missing_from_catalog(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labelled paths that the catalog doesn't have, by folded path without separators at the end."""
    have = catalog.select(text.key_folded_trimmed(F.col("path")).alias("_k")).distinct()
    return manifest.withColumn("_k", text.key_folded_trimmed(F.col("path"))).join(have, "_k", "left_anti").drop("_k")


def labelled_rows(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows with the group of the manifest."""
    m = manifest.select("group", text.key_folded_trimmed(F.col("path")).alias("_k")).distinct()
    return catalog.withColumn("_k", text.key_folded_trimmed(F.col("path"))).join(m, "_k").drop("_k")
