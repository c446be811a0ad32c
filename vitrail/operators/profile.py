"""Counts, sums, exact percentiles and buckets that describe a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions import text
from vitrail.operators.ordering import running_totals


#: Distinct values of a group that one task may order.
ONE_TASK = 5_000_000


def nearest_rank(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], one_task: int = ONE_TASK) -> DataFrame:
    """(groups..., a column for each share): the value at position round((n - 1) * share) of the ascending values, exact.

    Equal values are counted before anything is ordered. If some group has more than ``one_task`` distinct values, at least by estimate, they are ordered in
    pieces, with the same result. Null values don't count; a group without values has no row.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    estimate = df.groupBy(*groups).agg(F.approx_count_distinct(value).alias("_d")).agg(F.max("_d")).first()[0] or 0
    if estimate > one_task:
        ranked = running_totals(counted, groups, value, "_c")
    else:
        ranked = counted.withColumn("_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    picks = []
    for name, share in shares.items():
        k = F.floor((F.col("_n") - 1) * F.lit(float(share)) + 0.5)
        picks.append(F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col(value))).alias(name))
    return ranked.groupBy(*groups).agg(*picks)


def extension_counts(df: DataFrame, column: str = "extension") -> DataFrame:
    """(extension, n): trimmed and without case; none is ``<none>``."""
    e = text.nocase(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return df.groupBy(F.when(e == "", F.lit("<none>")).otherwise(e).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def source_totals(df: DataFrame, existing: DataFrame) -> DataFrame:
    """(n_rows, existing_sources, missing_sources, total_bytes): sources are there if the listing has their path."""
    e = existing.select("path").distinct().withColumn("_there", F.lit(1))
    return df.join(e, "path", "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("_there").alias("existing_sources"), (F.count(F.lit(1)) - F.count("_there")).alias("missing_sources"),
        F.coalesce(F.sum(F.greatest("size", F.lit(0))), F.lit(0)).alias("total_bytes"),
    )


def _valid(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0), F.lit(False))


def dimension_stats(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """(field, n, smallest, p50, p90, p95, largest) of width, height and megapixels; rows without a positive size don't count."""
    ok = df.where(_valid(F.col(width), F.col(height)))
    mp = F.col(width).cast("double") * F.col(height).cast("double") / 1e6
    fields = F.array(*[F.struct(F.lit(n).alias("field"), c.cast("double").alias("value")) for n, c in (("width", F.col(width)), ("height", F.col(height)), ("megapixels", mp))])
    long = ok.select(F.explode(fields).alias("f")).select("f.field", "f.value")
    ranks = nearest_rank(long, ["field"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    ends = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("smallest"), F.max("value").alias("largest"))
    return ends.join(ranks, "field").select("field", "n", "smallest", "p50", "p90", "p95", "largest")


def megapixel_buckets(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """(bucket, n) up to 0.5, 2, 8, 20 and over 20 megapixels."""
    mp = F.col(width).cast("double") * F.col(height).cast("double") / 1e6
    bucket = F.when(mp <= 0.5, "up_to_0_5").when(mp <= 2, "0_5_to_2").when(mp <= 8, "2_to_8").when(mp <= 20, "8_to_20").otherwise("over_20")
    return df.where(_valid(F.col(width), F.col(height))).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def orientations(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """(orientation, n): landscape, portrait, square or invalid."""
    w, h = F.col(width), F.col(height)
    o = F.when(~_valid(w, h), "invalid").when(w > h, "landscape").when(h > w, "portrait").otherwise("square")
    return df.groupBy(o.alias("orientation")).agg(F.count(F.lit(1)).alias("n"))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def run_summary(events: DataFrame) -> DataFrame:
    """(root, visited, processed, skipped, failed) of a pipeline's outcomes (root, outcome)."""
    n = lambda name: F.sum(F.when(F.col("outcome") == name, 1).otherwise(0)).alias(name)
    return events.groupBy("root").agg(F.count(F.lit(1)).alias("visited"), n("processed"), n("skipped"), n("failed"))


def timing_summary(runs: DataFrame) -> DataFrame:
    """(backend, batch, median_ms, min_ms, max_ms, items_per_s, speedup) of repeated runs (backend, batch, ms, items).

    The speed-up compares the best batch of each backend with that of the backend ``cpu``.
    """
    med = nearest_rank(runs.withColumn("ms", F.col("ms").cast("double")), ["backend", "batch"], "ms", {"median_ms": 0.5})
    ends = runs.groupBy("backend", "batch").agg(F.min("ms").cast("double").alias("min_ms"), F.max("ms").cast("double").alias("max_ms"), F.max("items").alias("_items"))
    rates = ends.join(med, ["backend", "batch"]).withColumn("items_per_s", F.round(F.col("_items") * 1000 / F.col("median_ms"), 6))
    cpu = rates.where(F.col("backend") == "cpu").agg(F.max("items_per_s")).scalar()
    best = F.max("items_per_s").over(Window.partitionBy("backend"))
    return rates.select("backend", "batch", "median_ms", "min_ms", "max_ms", "items_per_s", F.round(best / cpu, 6).alias("speedup"), (F.col("items_per_s") == best).alias("best_batch"))
