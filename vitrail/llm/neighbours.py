"""The most similar vectors of every vector, by a block matrix join.

1. Exact copies of a vector form a class; only its smallest row goes on. So a vector that a third of all
   rows share is compared once, and its rows are ranked by id when the result is expanded. The other rows of classes are left out by a broadcast list of
   their ids if it is within ``EXCLUDED_BOUND``, else by a join.
2. ``anchor_factor * sqrt(rows)`` anchors, the centres of a bounded sample drawn by hash from all distinct vectors, are broadcast (a
   checked size). Each representative joins the blocks of its ``probes`` most similar anchors; more than ``FLAT_ANCHORS`` anchors are looked up through groups. Dense regions draw as many anchors
   as they have vectors, so blocks stay of similar size whatever the data.
3. Within a block, tiles of int8 codes are multiplied. Each code has a known quantisation error, hence each product
   a bound; pairs whose bound cannot reach the threshold or the row's k-th best are dropped, the others are recomputed from
   the stored floats in double precision and kept in the row's k best.
4. The k best of each block are merged to the k best of the row, then classes are expanded to rows.

The loss is that of step 2 alone: a pair is missed if its vectors share none of their ``probes`` anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.sources.tables import cut

#: Broadcast anchors take no more than this; beyond it blocks grow instead.
ANCHOR_BYTES = 32 << 20
#: The sample that anchors are fitted to: rows an anchor, bytes at most, rounds.
SAMPLE_PER_ANCHOR, SAMPLE_BYTES, ANCHOR_ROUNDS = 16, 64 << 20, 3
#: More anchors than this are reached through their groups, of which a vector looks into so many.
FLAT_ANCHORS, GROUPS_TRIED = 8192, 16
#: Bytes of a tile of similarities to anchors.
TILE_BYTES = 16 << 20
#: Ids of left-out rows are broadcast up to this number (8 bytes each).
EXCLUDED_BOUND = 1_000_000
#: Size of a partition of blocks.
PARTITION_BYTES = 32 << 20
#: Tables of fewer rows are one block, which is exact.
ONE_BLOCK = 2000
#: Similarities are rounded to this many digits before they are ranked, so that scaled copies tie.
DIGITS = 10
ROW_TILE, COLUMN_TILE = 1024, 4096


def group_key(columns: list[str]) -> Column:
    """One number for the columns that must agree; a null agrees with null only."""
    if not columns:
        return F.lit(0).cast("bigint")
    return F.xxhash64(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}))


def usable(vector_column: str, dimension: int) -> Column:
    """Full length, all values present and finite, not all zero. NaN is the largest value to Spark, so the extremes show it."""
    v, inf = F.col(vector_column), F.lit(float("inf")).cast("float")
    high, low = F.array_max(v), F.array_min(v)
    return (F.size(v) == dimension) & (F.size(F.array_compact(v)) == dimension) & (high < inf) & (low > -inf) & ((high != 0) | (low != 0))


def light_rows(df: DataFrame, id_column: str, vector_column: str, dimension: int, group_columns: list[str]) -> DataFrame:
    """(row_id, g, h1, h2): usable rows, the key of their comparable rows and two hashes that name the vector."""
    return df.where(usable(vector_column, dimension)).select(
        F.col(id_column).cast("bigint").alias("row_id"),
        group_key(group_columns).alias("g"),
        F.xxhash64(vector_column).alias("h1"),
        F.hash(vector_column).alias("h2"),
    ).where(F.col("row_id").isNotNull())


def copies_of(light: DataFrame) -> DataFrame:
    """(rep, row_id): the rows of every class of more than one row, named by its smallest row; written to the checkpoint folder."""
    classes = light.groupBy("g", "h1", "h2").agg(F.min("row_id").alias("rep"), F.max("row_id").alias("last")).where("rep < last")
    return cut(light.join(classes.drop("last"), ["g", "h1", "h2"]).select("rep", "row_id").distinct())


def leave_out(vectors: DataFrame, excluded: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The vectors, and the sorted ids that must still be left out; more than ``EXCLUDED_BOUND`` ids are left out by a join instead."""
    ids = np.asarray(excluded.select("row_id").limit(EXCLUDED_BOUND + 1).toArrow().column(0).combine_chunks())
    if len(ids) > EXCLUDED_BOUND:
        return vectors.join(excluded.select("row_id"), "row_id", "left_anti").select("g", "row_id", "vec"), np.zeros(0, np.int64)
    return vectors, np.sort(ids)


def kept(ids: np.ndarray, excluded: np.ndarray) -> np.ndarray:
    """Which ids aren't among the sorted ``excluded``."""
    if not len(excluded):
        return np.ones(len(ids), bool)
    return excluded[np.minimum(np.searchsorted(excluded, ids), len(excluded) - 1)] != ids


def vector_array(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column and the vectors, as stored."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    offsets = np.asarray(column.offsets)
    values = column.values
    flat = np.asarray(values.cast(pa.float32()).fill_null(float("nan")) if values.null_count else values.cast(pa.float32()))
    full = np.flatnonzero(lengths == dimension)
    x = flat[offsets[full][:, None] + np.arange(dimension)[None, :]] if len(full) else np.zeros((0, dimension), np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return full[good], x[good]


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def plain_vectors(df: DataFrame, id_column: str, vector_column: str, dimension: int, group_columns: list[str]) -> DataFrame:
    """(g, row_id, vec) of rows with an id and a vector of full length."""
    full = df.where((F.size(vector_column) == dimension) & F.col(id_column).isNotNull())
    return full.select(group_key(group_columns).alias("g"), F.col(id_column).cast("bigint").alias("row_id"), F.col(vector_column).cast("array<float>").alias("vec"))


class Anchors:
    """Unit vectors by which blocks are chosen; many of them in about the square root of their number of groups, each with its centre."""

    def __init__(self, anchors: np.ndarray):
        self.anchors, self.groups = anchors, None
        if len(anchors) > FLAT_ANCHORS:
            start = np.random.default_rng(2).permutation(len(anchors))[: math.isqrt(len(anchors))]
            self.groups = centres(anchors, anchors[start])
            of = _largest(anchors, self.groups, 1)[0][:, 0]
            self.order = np.argsort(of, kind="stable")
            self.anchors = anchors[self.order]
            self.begun = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.groups)))])

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most similar anchors of each vector, ascending: of all anchors, or of those in the ``GROUPS_TRIED`` most similar groups."""
        if len(self.anchors) == 0:
            return np.zeros((len(unit), 1), np.int32)
        p = min(probes, len(self.anchors))
        near = unit.astype(np.float32)
        out = _largest(near, self.anchors, p)[0] if self.groups is None else self._by_groups(near, p)
        out.sort(axis=1)
        return out

    def one_nearest(self, unit: np.ndarray) -> np.ndarray:
        """The place of the most similar anchor, in the order they were given; there are groups."""
        return self.order[self._by_groups(unit, 1)[:, 0]]

    def _by_groups(self, near: np.ndarray, p: int) -> np.ndarray:
        tried, _ = _largest(near, self.groups, min(GROUPS_TRIED, len(self.groups)))
        best = np.zeros((len(near), p), np.int32)
        value = np.full((len(near), p), -2.0, np.float32)
        order = np.argsort(tried.ravel(), kind="stable")
        rows, group = order // tried.shape[1], tried.ravel()[order]
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        for a, b in zip(edges[:-1], edges[1:]):
            low, high = self.begun[group[a]], self.begun[group[a] + 1]
            if low == high:
                continue
            mine = rows[a:b]
            at, sims = _largest(near[mine], self.anchors[low:high], min(p, high - low))
            both, ids = np.concatenate([value[mine], sims], axis=1), np.concatenate([best[mine], at + low], axis=1)
            top = np.argpartition(both, both.shape[1] - p, axis=1)[:, both.shape[1] - p :]
            value[mine], best[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        return best


def _largest(near: np.ndarray, anchors: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and products of the ``p`` anchors of largest product with each row, in tiles of ``TILE_BYTES``."""
    out, value = np.empty((len(near), p), np.int32), np.empty((len(near), p), np.float32)
    step = max(16, min(2048, TILE_BYTES // (4 * len(anchors))))
    for s in range(0, len(near), step):
        sims = near[s : s + step] @ anchors.T
        top = np.argpartition(sims, len(anchors) - p, axis=1)[:, len(anchors) - p :]
        out[s : s + step], value[s : s + step] = top, np.take_along_axis(sims, top, 1)
    return out, value


def draw_anchors(df: DataFrame, vector_column: str, dimension: int, factor: float, rows: int) -> np.ndarray:
    """About factor * sqrt(rows) unit vectors, within ``ANCHOR_BYTES``: centres of a sample of the distinct usable vectors."""
    if rows < ONE_BLOCK:
        return np.zeros((0, dimension), np.float32)
    wanted = int(min(factor * math.sqrt(rows), ANCHOR_BYTES / (4 * dimension), rows / 4))
    sample = max(wanted, min(SAMPLE_PER_ANCHOR * wanted, rows, SAMPLE_BYTES // (4 * dimension)))
    share = int(min(1.0, sample / rows) * (1 << 31))
    h = F.xxhash64(F.lit("anchor"), F.col(vector_column))
    drawn = df.where(usable(vector_column, dimension) & (F.pmod(h, F.lit(1 << 31)) < share)).select(F.col(vector_column).cast("array<float>").alias("v"), h.alias("h")).distinct()
    _, x = vector_array(drawn.orderBy("h").limit(2 * sample + 64).select("v").toArrow().column("v"), dimension)
    if not len(x):
        return np.zeros((0, dimension), np.float32)
    unit = normalised(x[np.lexsort(x.T)]).astype(np.float32)
    start = np.random.default_rng(1).permutation(len(unit))[:wanted]
    return centres(unit, unit[start])


def centres(unit: np.ndarray, anchors: np.ndarray, rounds: int = ANCHOR_ROUNDS) -> np.ndarray:
    """Anchors moved to the mean direction of the vectors that are nearest to them, a few times; those without any stay."""
    for _ in range(rounds):
        nearest = Anchors(anchors).one_nearest(unit) if len(anchors) > FLAT_ANCHORS else _largest(unit, anchors, 1)[0][:, 0]
        order = np.argsort(nearest, kind="stable")
        begun = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        total = np.add.reduceat(unit[order].astype(np.float64), begun, axis=0)
        length = np.sqrt((total * total).sum(1))
        moved = length > 1e-6
        anchors = anchors.copy()
        anchors[nearest[order][begun[moved]]] = (total[moved] / length[moved, None]).astype(np.float32)
    return anchors


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit vectors: |u - scale * code| = error."""
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(1))
    return code, scale, error


def block_best(unit: np.ndarray, ids: np.ndarray, cells: np.ndarray, cell: int, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (row, other) and similarity of each row's k best in a block sorted by id.

    A pair counts only in the smallest cell that both have. The int8 codes are multiplied as float32 integers: their sums stay
    under 2**24, so the products are exact.
    """
    m = len(ids)
    code, scale, error = quantise(unit)
    wide = code.astype(np.float32)
    floor = -2.0 if least is None else least - 1e-9
    rows_out, others_out, sims_out = [], [], []
    for i in range(0, m, ROW_TILE):
        i2 = min(m, i + ROW_TILE)
        best_row, best_other, best_sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth = np.full(i2 - i, floor)
        for j in range(0, m, COLUMN_TILE):
            j2 = min(m, j + COLUMN_TILE)
            near = wide[i:i2] @ wide[j:j2].T
            near *= scale[i:i2, None].astype(np.float32)
            near *= scale[None, j:j2].astype(np.float32)
            slack = error[i:i2, None] + float(error[j:j2].max()) * (1 + error[i:i2, None]) + 1e-5
            if least is None and j2 - j > k + 1:
                low = np.partition(near, j2 - j - k - 1, axis=1)[:, j2 - j - k - 1]
                kth = np.maximum(kth, low - slack[:, 0])  # one of the k+1 may be the row itself
            keep = near >= (kth[:, None] - slack).astype(np.float32)
            if keep.mean() > 0.1 and keep.size > 65536:
                exact = np.round(unit[i:i2] @ unit[j:j2].T, DIGITS)
                # Ids rise with j: an equal similarity in a later tile cannot displace one that is kept.
                keep = (exact > kth[:, None]) if len(best_row) else (exact >= kth[:, None])
                if j2 - j > k + 1 + cells.shape[1]:
                    top = np.argsort(-exact, axis=1, kind="stable")
                    common = _smallest_common(cells[i:i2], cells[j:j2], top, cell)
                    a, b = _first_k(top, keep & True, common, np.arange(i, i2), j, k)
                else:
                    a, b = np.nonzero(keep)
                    a, b = a + i, b + j
            else:
                a, b = np.nonzero(keep)
                a, b = a + i, b + j
            other = a != b
            a, b = a[other], b[other]
            if not len(a):
                continue
            shared = cells[a][:, :, None] == cells[b][:, None, :]
            first = np.where(shared.any(2), cells[a], np.iinfo(np.int32).max).min(1) == cell
            a, b = a[first], b[first]
            sims = np.concatenate([np.einsum("ij,ij->i", unit[a[s : s + 100_000]], unit[b[s : s + 100_000]]) for s in range(0, len(a), 100_000)]) if len(a) else np.zeros(0)
            sims = np.round(np.clip(sims, -1, 1), DIGITS)
            good = sims >= floor + (1e-9 if least is not None else 0)
            best_row, best_other, best_sim = np.concatenate([best_row, a[good]]), np.concatenate([best_other, b[good]]), np.concatenate([best_sim, sims[good]])
            order = np.lexsort((best_other, -best_sim, best_row))
            best_row, best_other, best_sim = best_row[order], best_other[order], best_sim[order]
            rank = np.arange(len(best_row)) - np.searchsorted(best_row, best_row)
            kept = rank < k
            best_row, best_other, best_sim, rank = best_row[kept], best_other[kept], best_sim[kept], rank[kept]
            full = rank == k - 1
            kth[best_row[full] - i] = np.maximum(kth[best_row[full] - i], best_sim[full])
        rows_out.append(best_row)
        others_out.append(best_other)
        sims_out.append(best_sim)
    return np.concatenate(rows_out), np.concatenate(others_out), np.concatenate(sims_out)


def _smallest_common(row_cells: np.ndarray, column_cells: np.ndarray, top: np.ndarray, cell: int) -> np.ndarray:
    """For each row and column, in the order ``top``: whether ``cell`` is the smallest cell that both have."""
    out = np.ones((len(row_cells), len(column_cells)), bool)
    for x in range(row_cells.shape[1]):
        lower = row_cells[:, x] < cell
        if lower.any():
            has = (column_cells[None, :, :] == row_cells[:, x][:, None, None]).any(2)
            out &= ~(has & lower[:, None])
    return np.take_along_axis(out, top, 1)


def _first_k(top: np.ndarray, keep: np.ndarray, common: np.ndarray, rows: np.ndarray, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k columns of each row, in the order ``top``, that are kept, common and not the row itself."""
    ok = np.take_along_axis(keep, top, 1) & common & (top + j != rows[:, None])
    ok &= np.cumsum(ok, axis=1) <= k
    a, b = np.nonzero(ok)
    return rows[a], top[a, b] + j


def pack(x: np.ndarray) -> np.ndarray:
    """Floats as bytes with equal places of all floats of a row together, which compresses better in a shuffle."""
    n, d = x.shape
    return np.ascontiguousarray(np.ascontiguousarray(x, np.float32).view(np.uint8).reshape(n, d, 4).transpose(0, 2, 1)).reshape(n, 4 * d)


def unpack(packed: np.ndarray) -> np.ndarray:
    n, w = packed.shape
    return np.ascontiguousarray(packed.reshape(n, 4, w // 4).transpose(0, 2, 1)).reshape(n, w).view(np.float32)


def explode_cells(keys: list[pa.Array], x: np.ndarray, cells: np.ndarray, carried: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each cell of each vector (negative ones are none): the keys, the cell, its ``carried`` cells (all by default) and the stored floats, packed."""
    n = len(cells)
    carried = cells if carried is None else carried
    used = cells.ravel() >= 0
    take = pa.array(np.repeat(np.arange(n), cells.shape[1])[used])
    binary = lambda a, width: pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
    packed, all_cells = binary(pack(x), 4 * x.shape[1]), binary(carried.astype(np.int32), 4 * carried.shape[1])
    return pa.RecordBatch.from_arrays([*[key.take(take) for key in keys], pa.array(cells.ravel()[used]), all_cells.take(take), packed.take(take)], ["g", "row_id", "cell", "cells", "vec"])


def by_block(cells: DataFrame, rows: int, probes: int, dimension: int) -> DataFrame:
    """Rows of one block together and sorted, in partitions of about ``PARTITION_BYTES``, however the session is set up."""
    least = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-rows * probes * (4 * dimension + 48) // PARTITION_BYTES))
    return cells.repartition(partitions, "g", "cell").sortWithinPartitions("g", "cell", "row_id")


def wanted_vectors(batches: Iterator[pa.RecordBatch], dimension: int, excluded: np.ndarray) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """The keys g and row_id and the vectors of the usable rows of each batch that aren't excluded."""
    for batch in batches:
        good, x = vector_array(batch.column(2), dimension)
        keep = kept(np.asarray(batch.column(1))[good], excluded)
        if keep.any():
            at = pa.array(good[keep])
            yield [batch.column(0).take(at), batch.column(1).take(at)], x[keep]


CELL_SCHEMA = "g bigint, row_id bigint, cell int, cells binary, vec binary"


def sorted_blocks(batches: Iterator[pa.RecordBatch], dimension: int, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(g, cell, ids, cells, vectors) of each block of rows that come sorted by g, cell and row; rows that came twice count once.

    With ``most``, a block of more rows comes in parts of about so many."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    current: tuple[int, int] | None = None

    def block():
        ids, cells, vecs = (np.concatenate([h[x] for h in held]) for x in range(3))
        once = np.concatenate([[True], np.diff(ids) != 0])
        return (*current, ids[once], cells[once], vecs[once])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g, ids, cell = (np.asarray(batch.column(x)) for x in range(3))
        vecs = unpack(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(n, 4 * dimension))
        carried = b"".join(batch.column(3).to_pylist())
        cells = np.frombuffer(carried, np.int32).reshape(n, len(carried) // 4 // n)
        edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(cell) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, n]):
            key = (int(g[a]), int(cell[a]))
            if current is not None and (key != current or (most is not None and sum(len(h[0]) for h in held) >= most)):
                yield block()
                held = []
            current = key
            held.append((ids[a:b], cells[a:b], vecs[a:b]))
    if held:
        yield block()


def most_similar(
    df: DataFrame,
    id_column: str,
    vector_column: str,
    dimension: int,
    k: int = 10,
    min_similarity: float | None = None,
    group_columns: list[str] | None = None,
    probes: int = 3,
    anchor_factor: float = 5.0,
) -> DataFrame:
    """(row_id, neighbour_id, similarity, rank): the k most similar comparable rows of each row, best first, ties by smaller id.

    Vectors that are null, of another length, zero or not finite take no part, nor do rows without an id. Rows that share an id
    count once. Rows compare only if ``group_columns`` agree. ``min_similarity`` keeps neighbours of at least that cosine.
    An empty table, or one without usable vectors, gives an empty result; other columns don't matter.
    """
    groups = group_columns or []
    source = df.select(F.col(id_column), F.col(vector_column), *[F.col(c) for c in dict.fromkeys(groups) if c not in (id_column, vector_column)])
    rows = source.count()
    anchors = Anchors(draw_anchors(source, vector_column, dimension, anchor_factor, rows))
    shared = df.sparkSession.sparkContext.broadcast(anchors)
    copies = copies_of(light_rows(source, id_column, vector_column, dimension, groups))
    vectors, excluded = leave_out(plain_vectors(source, id_column, vector_column, dimension, groups), copies.where("row_id <> rep"))
    sent = df.sparkSession.sparkContext.broadcast(excluded)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in wanted_vectors(batches, dimension, sent.value):
            yield explode_cells(keys, x, shared.value.nearest(normalised(x), probes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell, ids, cells, x in sorted_blocks(batches, dimension):
            if len(ids) > 1:
                a, b, sims = block_best(normalised(x), ids, cells, cell, k, min_similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sims)], ["a", "b", "similarity"])

    blocks = by_block(vectors.mapInArrow(assign, CELL_SCHEMA), rows, probes, dimension)
    found = blocks.mapInArrow(search, "a bigint, b bigint, similarity double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))).where(F.col("rank") <= k).drop("rank")
    return expand_classes(ranked, copies, k)


#: Rows of one class that meet the class's neighbours in one task.
ROWS_PER_SALT = 10_000


def expand_classes(ranked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes as neighbours of rows.

    A row of a class of copies has the class's other rows at similarity 1, of which the k smallest can count, and the neighbours of
    its class, each standing for the k smallest rows of its own class. Large classes are salted by row.
    """
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("row_id"))).where(F.col("n") <= k + 1)
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("bigint").alias("salts"))
    salted_members = members.join(sizes, "rep").select("rep", "row_id", F.pmod(F.xxhash64("row_id"), F.col("salts")).alias("salt"))
    to_rows = (
        ranked.join(first.where(F.col("n") <= k).select(F.col("rep").alias("b"), F.col("row_id").alias("member")), "b", "left")
        .select("a", F.coalesce("member", "b").alias("neighbour_id"), "similarity")
        .join(sizes.withColumnRenamed("rep", "a"), "a", "left")
        .select("a", "neighbour_id", "similarity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1).cast("bigint")) - 1)).alias("salt"))
        .join(salted_members.withColumnRenamed("rep", "a"), ["a", "salt"], "left")
        .select(F.coalesce("row_id", "a").alias("row_id"), "neighbour_id", "similarity")
    )
    own = (
        first.join(sizes, "rep")
        .select("rep", F.col("row_id").alias("neighbour_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
        .join(salted_members, ["rep", "salt"])
        .where(F.col("row_id") != F.col("neighbour_id"))
        .select("row_id", "neighbour_id", F.lit(1.0).alias("similarity"))
    )
    order = Window.partitionBy("row_id").orderBy(F.col("similarity").desc(), "neighbour_id")
    return to_rows.unionByName(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, id_column: str, vector_column: str, dimension: int, k: int, min_similarity: float, group_columns: list[str] | None = None) -> DataFrame:
    """(row_a, row_b), row_a < row_b, distinct: pairs of which at least one lists the other among its k most similar rows."""
    near = most_similar(df, id_column, vector_column, dimension, k, min_similarity, group_columns)
    return near.select(F.least("row_id", "neighbour_id").alias("row_a"), F.greatest("row_id", "neighbour_id").alias("row_b")).distinct()
