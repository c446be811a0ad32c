"""References whose target key exists nowhere in the other table.

The work is split by key weight. References are first counted per key and period, so that however often
a key is repeated it crosses the network once per map partition. The few keys that hold more than one
in ``HEAVY_SHARE`` of all references (there can be no more than ``HEAVY_SHARE`` of them, which bounds the broadcast)
are checked against the target by a broadcast semi join; all other keys go through one shuffled anti join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one in so many of all references: at most so many keys can be.
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class Reference:
    """One kind of reference.

    ``rows``: the referring rows; ``key``: the normalised reference; ``record``: what names the referring
    record; ``period``: the reporting period; ``targets``: the target rows and ``target_key`` their key.
    """

    table_name: str
    rows: DataFrame
    key: Column
    record: Column
    period: Column
    targets: DataFrame
    target_key: Column


def ascii_path_key(path: Column) -> Column:
    """Backslashes become slashes and A to Z become a to z; every other character stays."""
    return F.translate(path, "\\ABCDEFGHIJKLMNOPQRSTUVWXYZ", "/abcdefghijklmnopqrstuvwxyz")


def month(ts: Column) -> Column:
    """``yyyy-MM``; null for a null time."""
    return F.date_format(ts, "yyyy-MM")


def _prepared(ref: Reference) -> DataFrame:
    key = ref.key
    return ref.rows.select(key.alias("_key"), ref.record.cast("string").alias("record_key"), ref.period.alias("period_ym")).where(
        F.col("_key").isNotNull() & F.col("_key").rlike(r"\S")
    )


def _split_orphans(ref: Reference, heavy_share: int) -> tuple[DataFrame, DataFrame]:
    """(_key, period_ym, n_references) without a target: those of heavy keys, which have at most ``heavy_share`` keys, and the others."""
    counted = _prepared(ref).groupBy("_key", "period_ym").agg(F.count(F.lit(1)).alias("n_references"))
    per_key = counted.groupBy("_key").agg(F.sum("n_references").alias("_n"))
    total = per_key.agg(F.sum("_n").alias("_total"))
    heavy = per_key.where(F.col("_n") * heavy_share > total.scalar()).select("_key")
    # Distinct, so that a much repeated target is one row before it crosses the network.
    targets = ref.targets.select(ref.target_key.alias("_key")).where(F.col("_key").isNotNull()).distinct()
    heavy_present = targets.join(F.broadcast(heavy), "_key", "left_semi")
    hot = counted.join(F.broadcast(heavy), "_key", "left_semi").join(F.broadcast(heavy_present), "_key", "left_anti")
    return hot, counted.join(F.broadcast(heavy), "_key", "left_anti").join(targets, "_key", "left_anti")


def orphan_keys(ref: Reference, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(_key, period_ym, n_references) of the references without a target.

    Null and blank references are no case; a null period is a period of its own. Rows that are repeated count
    each in ``n_references``. Without targets every reference is an orphan; without references the result is empty.
    """
    hot, cold = _split_orphans(ref, heavy_share)
    return hot.unionByName(cold)


def orphan_counts(refs: list[Reference], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(table_name, period_ym, n_references, n_keys): orphan references and distinct orphan keys per table and period."""
    out = None
    for ref in refs:
        part = (
            orphan_keys(ref, heavy_share)
            .groupBy("period_ym")
            .agg(F.sum("n_references").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
            .select(F.lit(ref.table_name).alias("table_name"), "period_ym", "n_references", "n_keys")
        )
        out = part if out is None else out.unionByName(part)
    return out


def orphan_records(refs: list[Reference], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(table_name, record_key, period_ym), distinct: the records whose reference has no target.

    The orphan keys come from the references counted per key and period, as in ``orphan_counts``; the records are then looked up by them, those of heavy keys
    by broadcast, where a hot key needs no task of its own. A record with a null name comes out as a null ``record_key``.
    """
    out = None
    for ref in refs:
        hot, cold = (part.select("_key").distinct() for part in _split_orphans(ref, heavy_share))
        rows = _prepared(ref)
        found = rows.join(F.broadcast(hot), "_key", "left_semi").unionByName(rows.join(cold, "_key", "left_semi"))
        part = found.select(F.lit(ref.table_name).alias("table_name"), "record_key", "period_ym").distinct()
        out = part if out is None else out.unionByName(part)
    return out
