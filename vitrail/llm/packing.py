"""Filling containers of fixed capacity with items of varying size.

Items are spread over shards by a hash of their id, ``SHARD_ITEMS`` each, and every shard is packed in one task by conflict-constrained best fit over items of
falling size. The open containers are ordered by what room they have left, as a bitmap of the residuals that occur, and carry a bitmap of the sources and one of the
classes of copies that they are closed to. The search starts at the smallest residual that holds the item and goes on to its successors until it finds the tightest
container that is closed to neither. Only then a new one is opened.

A container is closed to a class of copies when it holds its share of them, the least with which the class needs no more containers than the whole shard does; that is
one copy, unless a class is very frequent. With a ``slack``, copies open no more containers than that share beyond the fewest
that can hold the shard. It is closed to a source one item after its share, as long as that opens no container beyond the fewest.

Only an item larger than the capacity is cut: into full containers and a rest, which is packed like an item. A shard
wastes at most a part of its last container, so the loss against packing all in one task is under one container a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm import bpe
from vitrail.sources.tables import cut

SHARD_ITEMS = 20_000
#: For texts: the share of containers that keeping copies apart may cost, one at least.
TEXT_SLACK = 0.005
SCHEMA = "budget_id int, container_id string, item_id bigint, piece int, first_token bigint, n_tokens int"


class _Open:
    """The open containers by what room they have left, and of equal room by what they are closed to: bitmaps of sources and of classes of copies."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.room: list[int] = []
        self.closed: list[tuple[int, int]] = []
        self.buckets: dict[int, dict[tuple[int, int], dict[int, None]]] = {}  # room: bitmaps: containers, the last put first
        self.residuals = 0  # bit r is set if a container has room r

    def put(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.buckets.setdefault(r, {}).setdefault(self.closed[b], {})[b] = None
            self.residuals |= 1 << r

    def take(self, r: int, closed: tuple[int, int]) -> int:
        same = self.buckets[r][closed]
        b, _ = same.popitem()
        if not same:
            del self.buckets[r][closed]
            if not self.buckets[r]:
                del self.buckets[r]
                self.residuals ^= 1 << r
        return b

    def tightest(self, size: int, source: int, copy: int) -> int | None:
        """The container of least room for ``size`` that is closed to none of the bits ``source`` and ``copy``, taken out: from the smallest residual on to its successors."""
        above = self.residuals >> size
        r = size
        while above:
            step = (above & -above).bit_length() - 1
            r += step
            for closed in self.buckets[r]:
                if not closed[0] & source and not closed[1] & copy:
                    return self.take(r, closed)
            above >>= step + 1
            r += 1
        return None

    def new(self) -> int:
        self.room.append(self.capacity)
        self.closed.append((0, 0))
        return len(self.room) - 1


def best_fit(sizes: list[int], copies: list[int], sources: list[int], capacity: int, slack: float | None = None) -> list[int]:
    """The container of each item. ``copies`` and ``sources`` are class and source numbers; items come by falling size."""
    fewest = max(1, -(-sum(sizes) // capacity))
    enough = float("inf") if slack is None else fewest + max(1, int(slack * fewest))
    count: dict[tuple[str, int], int] = {}
    for kind, names in (("copy", copies), ("source", sources)):
        for x in names:
            count[kind, x] = count.get((kind, x), 0) + 1
    # A class of one is in no conflict and has no bit. A source may come once more than its share, for its items differ in size.
    bits = {x: 1 << k for k, x in enumerate(x for (kind, x), n in count.items() if kind == "copy" and n > 1)}
    allowed = {c: -(-count["copy", c] // fewest) for c in bits}
    allowed_source = {s: -(-n // fewest) + 1 for (kind, s), n in count.items() if kind == "source"}
    held: dict[tuple[str, int, int], int] = {}
    of_class: dict[int, list[int]] = {}  # the containers closed to a class
    open_ones = _Open(capacity)
    out = []
    for size, copy, source in zip(sizes, copies, sources):
        source_bit, copy_bit = 1 << source, bits.get(copy, 0)
        b = open_ones.tightest(size, source_bit, copy_bit)
        if b is None and len(open_ones.room) >= fewest:
            b = open_ones.tightest(size, 0, copy_bit)  # a source opens no container beyond the fewest
        if b is None and len(open_ones.room) >= enough and any(open_ones.room[x] >= size for x in of_class.get(copy, ())):
            b = open_ones.tightest(size, 0, 0)
        if b is None:
            b = open_ones.new()
        open_ones.room[b] -= size
        held["source", source, b] = held.get(("source", source, b), 0) + 1
        by_source, by_copy = open_ones.closed[b]
        if held["source", source, b] >= allowed_source[source]:
            by_source |= source_bit
        if copy_bit:
            held["copy", copy, b] = held.get(("copy", copy, b), 0) + 1
            if held["copy", copy, b] >= allowed[copy]:
                by_copy |= copy_bit
                of_class.setdefault(copy, []).append(b)
        open_ones.closed[b] = (by_source, by_copy)
        open_ones.put(b)
        out.append(b)
    return out


def pack_shard(rows: pd.DataFrame, slack: float | None = None) -> pd.DataFrame:
    """Containers of the rows (budget_id, capacity, shard, item_id, source, copy, size) of one budget and shard."""
    budget, capacity, shard = int(rows["budget_id"].iloc[0]), int(rows["capacity"].iloc[0]), int(rows["shard"].iloc[0])
    size = rows["size"].to_numpy(np.int64)
    full, rest = size // capacity, size % capacity
    ids = rows["item_id"].to_numpy()
    copy = pd.factorize(rows["copy"])[0]
    source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    order = np.lexsort((ids, copy, -rest))
    order = order[rest[order] > 0]
    at = best_fit(rest[order].tolist(), copy[order].tolist(), source[order].tolist(), capacity, slack)
    packed = pd.DataFrame({"n": np.array(at, np.int64), "item_id": ids[order], "piece": full[order] + 1, "first_token": full[order] * capacity, "n_tokens": rest[order]})
    piece = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
    begun = (max(at) + 1) if at else 0
    cut_items = pd.DataFrame({"n": begun + np.arange(len(piece)), "item_id": np.repeat(ids, full), "piece": piece + 1, "first_token": piece * capacity, "n_tokens": np.full(len(piece), capacity)})
    out = pd.concat([packed, cut_items], ignore_index=True)
    out["budget_id"] = budget
    out["container_id"] = f"{budget}-{shard}-" + out["n"].astype(str)
    return out[["budget_id", "container_id", "item_id", "piece", "first_token", "n_tokens"]]


def pack(items: DataFrame, budgets: DataFrame, shard_items: int = SHARD_ITEMS, slack: float | None = None) -> DataFrame:
    """(budget_id, container_id, item_id, piece, first_token, n_tokens): where each piece of each item goes, for every budget.

    ``items`` (item_id, source, copy, size), ``budgets`` (budget_id, capacity). Items of size 0 or null take no room and have no row; a null source is a
    source, a null ``copy`` a class. Rows with equal ids are packed each for itself. Budgets without a positive capacity are left out. Without items or budgets the result is empty.
    """
    listed = [(r[0], r[1]) for r in budgets.select("budget_id", "capacity").where(F.col("capacity") > 0).distinct().limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1000 budgets")
    sized = items.where(F.col("size") > 0).select(F.col("item_id").cast("bigint"), F.col("source").cast("string"), F.col("copy").cast("bigint"), F.col("size").cast("bigint"))
    shards = max(1, -(-items.count() // shard_items))
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("int").alias("capacity")) for b, c in listed])) if listed else None
    if each is None:
        return items.sparkSession.createDataFrame([], SCHEMA)
    spread = sized.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")).withColumn("b", each)
    return spread.select("b.budget_id", "b.capacity", "shard", "item_id", "source", "copy", "size").groupBy("budget_id", "shard").applyInPandas(lambda rows: pack_shard(rows, slack), SCHEMA)


def sized_documents(documents: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(item_id, source, copy, size): the documents by tokens; texts equal but for case and white space are copies."""
    text = F.col("text").cast("string")
    slim = documents.select(F.col("doc_id").alias("item_id"), "source", F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")).alias("copy"), text.alias("text"))
    return cut(bpe.count_tokens(slim, "text", "size", vocabulary))


def pack_documents(documents: DataFrame, budgets: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """``pack`` over the texts of documents; budgets have budget_id and capacity_tokens."""
    return pack(sized_documents(documents, vocabulary), budgets.select("budget_id", F.col("capacity_tokens").alias("capacity")), slack=TEXT_SLACK).withColumnRenamed("item_id", "doc_id")


def unused_room(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, n_containers, n_tokens, unused_share) of each budget; containers at the least are ceil(n_tokens / capacity)."""
    capacity = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity_tokens").alias("capacity"))
    per = packed.groupBy("budget_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(F.broadcast(capacity), "budget_id").select(
        "budget_id", "capacity", "n_containers", "n_tokens", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6).alias("unused_share")
    )
