"""Exact percentiles per group by distributed multi-select, and summaries that can be combined.

Large groups are never sorted or shuffled. Each partition keeps its values of a group as sorted blocks with counts.
Per target (group, column, percentile) the driver holds one open range that must contain the answer and the rank within it. In
each round every block proposes the median of what it has in the two parts of the range, their weighted median
becomes the next pivot of that part, and the values below, at and above the current pivot are counted; one of the
three parts stays. So a round is one job over compact blocks, and about log2(values) rounds find every target.

Groups of at most ``total / MAX_LARGE`` rows (or ``SMALL``) are ranked by a window over their distinct values; so there are
no more than ``MAX_LARGE`` large groups a column, which bounds the driver's state.

``summary`` has counts in buckets of a relative width. Summaries of separate partitions, days or scans are added
bucket by bucket, and percentiles read from them have a relative error of at most ``alpha``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 64
MAX_LARGE = 2000
BLOCK_ROWS = 1 << 20


def rank_of(n: Column, pct: Column) -> Column:
    """Zero-based position round((n - 1) * pct / 100), half up."""
    return F.floor((2 * (n - 1) * pct + 100) / 200).cast("bigint")


def _long(df: DataFrame, group: str, columns: list[str], positive_only: bool) -> DataFrame:
    """(g, field, value) of the values that count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias("value")) for c in columns]))
    long = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), pairs.alias("p")).select("g", "p.field", "p.value")
    return long.where((F.col("value") > 0) if positive_only else F.col("value").isNotNull())


def _blocks(df: DataFrame, group: str, columns: list[str], positive_only: bool, large: dict[str, set[str]]) -> DataFrame:
    """(g, field, values, counts): sorted distinct values with counts of each large group, a few blocks a partition."""
    slim = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string"), *[F.col(c).cast("bigint") for c in columns])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        groups = table.column(0).combine_chunks()
        codes = groups.dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        names, code = codes.dictionary.to_pylist(), np.asarray(codes.indices)
        out: list[tuple[str, str, bytes, bytes]] = []
        for x, column in enumerate(columns):
            values = table.column(1 + x)
            ok = np.asarray(values.is_valid())
            v = np.asarray(values.fill_null(0))
            if positive_only:
                ok &= v > 0
            v, c = v[ok], code[ok]
            order = np.lexsort((v, c))
            v, c = v[order], c[order]
            if not len(v):
                continue
            new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])]))
            counts = np.diff(np.append(new, len(v)))
            v, c = v[new], c[new]
            for name in np.unique(c):
                if names[name] in large[column]:
                    a, b = np.searchsorted(c, [name, name + 1])
                    out.append((names[name], column, v[a:b].astype(np.int64).tobytes(), counts[a:b].astype(np.int64).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["g", "field", "values", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return slim.mapInArrow(run, "g string, field string, values binary, counts binary")


def _median_of(values: np.ndarray, total: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """Weighted median of values[a:b] and their weight; ``total`` has the cumulative counts with a leading 0."""
    weight = int(total[b] - total[a])
    if weight == 0:
        return 0, 0
    return int(values[np.searchsorted(total, total[a] + (weight + 1) // 2) - 1]), weight


def _round(blocks: DataFrame, targets: dict[tuple[str, str], list[tuple[int, int | None, int | None, int | None]]]) -> DataFrame:
    """Per target: counts below, at and above the pivot, and the next pivots of the parts below and above.

    ``targets``: by group and column (target number, low, high, pivot); the range is open, None is no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                wanted = targets.get((row["g"], row["field"]))
                if not wanted:
                    continue
                values = np.frombuffer(row["values"], np.int64)
                total = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int64))])
                for number, low, high, pivot in wanted:
                    a = 0 if low is None else int(np.searchsorted(values, low, "right"))
                    b = len(values) if high is None else int(np.searchsorted(values, high, "left"))
                    if b <= a:
                        continue
                    if pivot is None:
                        m, w = _median_of(values, total, a, b)
                        out.append((number, 0, 0, w, 0, 0, m, w))
                        continue
                    p, q = (a + int(x) for x in (np.searchsorted(values[a:b], pivot, "left"), np.searchsorted(values[a:b], pivot, "right")))
                    below, above = _median_of(values, total, a, p), _median_of(values, total, q, b)
                    out.append((number, int(total[p] - total[a]), int(total[q] - total[p]), int(total[b] - total[q]), *below, *above))
            if out:
                names = ["t", "below", "at", "above", "low_median", "low_weight", "high_median", "high_weight"]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    counted = blocks.mapInArrow(run, "t bigint, below bigint, at bigint, above bigint, low_median bigint, low_weight bigint, high_median bigint, high_weight bigint")

    def pivot(side: str) -> Column:
        median, weight = F.col(f"{side}_median"), F.col(f"{side}_weight")
        own = F.when(weight > 0, median)
        middle = F.percentile(own, F.lit(0.5), F.when(weight > 0, weight).otherwise(F.lit(1).cast("bigint")))
        return F.least(F.greatest(F.floor(middle).cast("bigint"), F.min(own)), F.max(own))  # stays inside the range whatever the rounding

    return counted.groupBy("t").agg(F.sum("below").alias("below"), F.sum("at").alias("at"), F.sum("above").alias("above"), pivot("low").alias("low_pivot"), pivot("high").alias("high_pivot"))


def percentiles(df: DataFrame, group: str, columns: list[str], pcts: list[int], positive_only: bool = False, small: int = SMALL) -> DataFrame:
    """(group string, field string, pct int, pct_value bigint): the value at position round((n - 1) * pct / 100) of each group and column.

    Exact. Rows without a group don't count, nor do null values, column by column; with ``positive_only`` nor do values below 1. A group without values has
    no row; repeated rows count each. Columns are integers; other columns of ``df`` don't matter. An empty table gives an empty result.
    """
    spark = df.sparkSession
    clean = df.select(F.col(group), *[F.col(c) for c in columns])
    long = _long(clean, group, columns, positive_only)
    sizes = long.groupBy("g", "field").agg(F.count(F.lit(1)).alias("n"))
    bound = F.greatest(F.lit(small), F.ceil(sizes.agg(F.sum("n")).scalar() / MAX_LARGE))
    large_rows = sizes.where(F.col("n") > bound).collect()  # at most MAX_LARGE
    found = _small_groups(long, {(r.g, r.field) for r in large_rows}, pcts)
    if large_rows:
        found = found.unionByName(_select(spark, clean, group, columns, pcts, positive_only, large_rows))
    return found.withColumnRenamed("g", group)


def _small_groups(long: DataFrame, large: set[tuple[str, str]], pcts: list[int]) -> DataFrame:
    spark = long.sparkSession
    if large:
        out = spark.createDataFrame(sorted(large), "g string, field string")
        long = long.join(F.broadcast(out), ["g", "field"], "left_anti")
    by_value = long.groupBy("g", "field", "value").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g", "field")
    ranked = by_value.withColumn("upto", F.sum("c").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(group))
    each = ranked.withColumn("pct", F.explode(F.array(*map(F.lit, pcts))))
    k = rank_of(F.col("n"), F.col("pct"))
    return each.where((F.col("upto") > k) & (F.col("upto") - F.col("c") <= k)).select("g", "field", "pct", F.col("value").alias("pct_value"))


def _select(spark, df: DataFrame, group: str, columns: list[str], pcts: list[int], positive_only: bool, large_rows: list) -> DataFrame:
    large = {c: {r.g for r in large_rows if r.field == c} for c in columns}
    blocks = _blocks(df, group, columns, positive_only, large).persist(StorageLevel.MEMORY_AND_DISK)
    # number: group, column, percentile, low, high, pivot, rank within the open range
    state: dict[int, list] = {}
    for r in large_rows:
        for pct in pcts:
            state[len(state)] = [r.g, r.field, pct, None, None, None, (2 * (r.n - 1) * pct + 100) // 200]
    answers: list[tuple[str, str, int, int]] = []
    try:
        while state:
            targets: dict[tuple[str, str], list] = {}
            for number, (g, field, _, low, high, pivot, _) in state.items():
                targets.setdefault((g, field), []).append((number, low, high, pivot))
            for r in _round(blocks, targets).collect():
                s = state[r.t]
                if s[5] is None:
                    s[5] = r.high_pivot
                elif s[6] < r.below:
                    s[4], s[5] = s[5], r.low_pivot
                elif s[6] < r.below + r.at:
                    answers.append((s[0], s[1], s[2], s[5]))
                    del state[r.t]
                else:
                    s[3], s[5], s[6] = s[5], r.high_pivot, s[6] - r.below - r.at
    finally:
        blocks.unpersist()
    return spark.createDataFrame(answers, "g string, field string, pct int, pct_value bigint")


def summary(df: DataFrame, by: list[str], columns: list[str], alpha: float = 0.01) -> DataFrame:
    """(by..., field string, bucket int, n bigint): counts of positive values in buckets of relative width.

    Bucket b holds the values in (q**(b-1), q**b] with q = (1 + alpha) / (1 - alpha). Null and non-positive values don't count.
    """
    q = math.log((1 + alpha) / (1 - alpha))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = df.select(*by, pairs.alias("_p")).select(*by, F.col("_p.field").alias("field"), F.col("_p.value").alias("_value")).where(F.col("_value") > 0)
    bucket = F.ceil(F.round(F.log("_value") / F.lit(q), 9)).cast("int")
    return long.groupBy(*by, "field", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def combine(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries added up over all columns but ``by``."""
    return summaries.groupBy(*by, "field", "bucket").agg(F.sum("n").alias("n"))


def from_summary(summaries: DataFrame, by: list[str], pcts: list[int], alpha: float = 0.01) -> DataFrame:
    """(by..., field, pct int, pct_value double): percentiles from combined summaries, off by at most ``alpha`` of the value."""
    q = (1 + alpha) / (1 - alpha)
    group = Window.partitionBy(*by, "field")
    ranked = summaries.withColumn("_upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(group))
    each = ranked.withColumn("pct", F.explode(F.array(*map(F.lit, pcts))))
    k = rank_of(F.col("_n"), F.col("pct"))
    value = F.round(2 * F.pow(F.lit(q), F.col("bucket").cast("double")) / (q + 1), 6)
    return each.where((F.col("_upto") > k) & (F.col("_upto") - F.col("n") <= k)).select(*by, "field", "pct", value.alias("pct_value"))
