"""Nearest vectors, percentiles and clusters, against brute force."""

import itertools
import pickle
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrail.llm import border, mixture, neighbours, percentiles

SCHEMA = "row_id bigint, embedding array<float>, kind string, rank string, similarity string"


def table(spark, vectors, ids=None, kinds=None):
    ids = ids or range(1, len(vectors) + 1)
    kinds = kinds or ["k"] * len(vectors)
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, "", "") for i, v, k in zip(ids, vectors, kinds)], SCHEMA)


def brute(vectors, ids, k, least, kinds=None):
    out = set()
    kinds = kinds or ["k"] * len(vectors)
    best = {}
    for i, v, kind in zip(ids, vectors, kinds):
        if v is not None and len(v) == len(vectors[0]) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            best[i] = (u / np.linalg.norm(u), kind)
    for i, (u, kind) in best.items():
        sims = [(-round(float(u @ w), 10), j) for j, (w, kj) in best.items() if j != i and kj == kind]
        for rank, (s, j) in enumerate(sorted(sims)[:k], 1):
            if least is None or -s >= least:
                out.add((i, j, rank))
    return out


def clustered(n, d, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 6), d))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))
    return np.round(x, 3).astype(np.float32).tolist()


@pytest.mark.parametrize("least", [0.9, None])
def test_exact_in_one_block(spark, least):
    x = clustered(300, 8, 1)
    x[5], x[6] = None, x[5][:3] if x[5] else [1.0]
    x[7], x[8], x[9] = [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7
    x[10] = [None] + [1.0] * 7
    x[20] = x[21] = x[22] = x[30]
    x[23] = [v * 7.3 for v in x[30]]
    kinds = ["a" if i % 3 else "b" for i in range(300)]
    x = [[1.0] * 8, *x[1:]]
    got = neighbours.most_similar(table(spark, x, kinds=kinds), "row_id", "embedding", 8, 5, least, ["kind"])
    assert {(r.row_id, r.neighbour_id, r["rank"]) for r in got.collect()} == brute(x, range(1, 301), 5, least, kinds)


def test_many_copies_of_one_vector(spark):
    x = clustered(200, 8, 2)
    x = x + [x[3]] * 100
    got = {(r.row_id, r.neighbour_id, r["rank"]) for r in neighbours.most_similar(table(spark, x), "row_id", "embedding", 8, 4, 0.5).collect()}
    assert got == brute(x, range(1, len(x) + 1), 4, 0.5)


def test_repeated_rows_count_once_and_pairs_are_unordered(spark):
    x = [[1, 0], [0.99, 0.1], [1, 0], [0, 1]]
    df = table(spark, x, ids=[5, 9, 5, 7])
    assert rows(neighbours.similar_pairs(df, "row_id", "embedding", 2, 10, 0.9)) == [(5, 9)]


def test_recall_with_anchors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ONE_BLOCK", 10)
    x = clustered(3000, 24, 3)
    got = {(r.row_id, r.neighbour_id) for r in neighbours.most_similar(table(spark, x), "row_id", "embedding", 24, 10, 0.9).collect()}
    want = {(a, b) for a, b, _ in brute(x, range(1, 3001), 10, 0.9)}
    assert len(got & want) >= 0.95 * len(want) and len(want) > 1000


def test_anchors_in_groups(monkeypatch):
    rng = np.random.default_rng(4)
    x = neighbours.normalised(np.array(clustered(4000, 24, 6)))
    flat = neighbours.Anchors(x[:900].astype(np.float32))
    monkeypatch.setattr(neighbours, "FLAT_ANCHORS", 100)
    grouped = neighbours.Anchors(x[:900].astype(np.float32))
    a, b = flat.nearest(x, 3), grouped.nearest(x, 3)
    assert a.shape == b.shape and grouped.groups is not None and len(grouped.groups) == 30
    # Grouped anchors are in another order: their vectors tell them.
    same = [len({tuple(v) for v in flat.anchors[p]} & {tuple(v) for v in grouped.anchors[q]}) for p, q in zip(a, b)]
    assert np.mean(same) >= 0.95 * 3
    moved = neighbours.centres(x.astype(np.float32), x[rng.permutation(4000)[:300]].astype(np.float32))
    assert moved.shape == (300, 24) and np.allclose(np.linalg.norm(moved, axis=1), 1, atol=1e-5)


def test_left_out_rows_by_join(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "EXCLUDED_BOUND", 3)
    x = clustered(100, 8, 4)
    x = x + x[:20]
    got = {(r.row_id, r.neighbour_id, r["rank"]) for r in neighbours.most_similar(table(spark, x), "row_id", "embedding", 8, 3, 0.5).collect()}
    assert got == brute(x, range(1, 121), 3, 0.5)


def test_dense_blocks_with_ties():
    """Directions that all tie, in a block of several tiles: the smallest ids win."""
    n, k = 9000, 3
    unit = neighbours.normalised(np.tile([[1.0, 2.0]], (n, 1)) * np.linspace(1, 5, n)[:, None])
    a, b, s = neighbours.block_best(unit, np.arange(n), np.zeros((n, 1), np.int32), 0, k, 0.9)
    assert len(a) == n * k and np.all(s == 1)
    last = b[a == n - 1]
    assert sorted(last.tolist()) == [0, 1, 2] and sorted(b[a == 1].tolist()) == [0, 2, 3]


def test_quantisation_bound():
    u = neighbours.normalised(np.random.default_rng(0).normal(size=(200, 16)))
    code, scale, error = neighbours.quantise(u)
    near = (code.astype(float) * scale[:, None]) @ (code.astype(float) * scale[:, None]).T
    assert np.all(np.abs(near - u @ u.T) <= error[:, None] + error[None, :] * (1 + error[:, None]) + 1e-12)


def test_pack_round_trip():
    x = np.random.default_rng(0).normal(size=(7, 12)).astype(np.float32)
    assert np.array_equal(neighbours.unpack(neighbours.pack(x)), x)


def test_empty_and_unusable_tables(spark):
    for x in ([], [None, [0.0, 0.0], [1.0]]):
        assert neighbours.most_similar(table(spark, x), "row_id", "embedding", 2).count() == 0
        found, _ = mixture.clusters(table(spark, x), "row_id", "embedding", 2, 0.7)
        assert found.count() == 0


# Percentiles


def by_definition(values, pct):
    v = sorted(values)
    return v[(2 * (len(v) - 1) * pct + 100) // 200]


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_percentiles(spark, small):
    rng = np.random.default_rng(5)
    data = [("hot", int(v), None) for v in rng.integers(1, 50, 3000)] + [("wide", int(v), int(v) % 7 - 2) for v in rng.integers(-(10**12), 10**12, 900)]
    data += [("one", 4, 4), ("tie", 3, 3), ("tie", 3, 3), (None, 1, 1), ("none", None, None), ("neg", -5, 0)]
    df = spark.createDataFrame([(g, a, b, "x", 1) for g, a, b in data], "root string, a bigint, b bigint, field string, pct int").repartition(7)
    for positive in (True, False):
        want = []
        for g in {g for g, *_ in data if g}:
            for x, c in ((1, "a"), (2, "b")):
                v = [r[x] for r in data if r[0] == g and r[x] is not None and (r[x] > 0 or not positive)]
                want += [(g, c, p, by_definition(v, p)) for p in (10, 50, 90, 99) if v]
        got = rows(percentiles.percentiles(df, "root", ["a", "b"], [10, 50, 90, 99], positive, small))
        assert got == sorted(want, key=str)
    assert rows(percentiles.percentiles(df.limit(0), "root", ["a"], [50])) == []


def test_summaries_combine_within_the_error(spark):
    rng = np.random.default_rng(6)
    v = np.exp(rng.normal(5, 2, 5000)).astype(int) + 1
    df = spark.createDataFrame([("r", int(x), i % 9) for i, x in enumerate(v)] + [("r", None, 1), ("r", 0, 2)], "root string, a bigint, day int")
    parts = percentiles.summary(df, ["root", "day"], ["a"])
    whole = percentiles.combine(percentiles.summary(df, ["root"], ["a"]), ["root"])
    assert rows(percentiles.combine(parts, ["root"])) == rows(whole)
    for r in percentiles.from_summary(whole, ["root"], [1, 50, 99]).collect():
        true = by_definition(v.tolist(), r.pct)
        assert abs(r.pct_value - true) <= 0.0101 * true


# Clusters


def linked(vectors, ids, least, kinds):
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in zip(ids, vectors, kinds) if v is not None and any(v)]
    root = {i: i for i, *_ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, u, k), (j, w, m) in itertools.combinations(good, 2):
        if k == m and round(float(u @ w / np.linalg.norm(u) / np.linalg.norm(w)), 10) >= least:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in root:
        groups.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_clusters(spark):
    x = clustered(260, 16, 7, 0.2) + [None]
    x[9] = [0.0] * 16
    x[50:80] = [x[40]] * 30
    kinds = ["a" if i % 5 else "b" for i in range(261)]
    df = table(spark, x, kinds=kinds)
    found, model = mixture.clusters(df, "row_id", "embedding", 16, 0.8, ["kind"], probes=64)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster, set()).add(r.row_id)
    assert {frozenset(g) for g in groups.values()} == linked(x, range(1, 262), 0.8, kinds)
    named = df.select("row_id", F.concat(F.lit("n"), "row_id").alias("name"))
    described = mixture.describe(found, mixture.densities(df, "row_id", "embedding", 16, model), named).collect()
    assert sum(r.n_members for r in described) == 259
    assert all(1 <= len(r.typical) <= 3 and len(set(r.typical)) == len(r.typical) for r in described)
    some = df.select("row_id").where("row_id % 2 = 0")
    half, _ = mixture.clusters(df, "row_id", "embedding", 16, 0.8, ["kind"], some, probes=64)
    groups = {}
    for r in half.collect():
        groups.setdefault(r.cluster, set()).add(r.row_id)
    even = [(i, v, k) for i, v, k in zip(range(1, 262), x, kinds) if i % 2 == 0]
    assert {frozenset(g) for g in groups.values()} == linked([v for _, v, _ in even], [i for i, *_ in even], 0.8, [k for *_, k in even])


def test_clusters_recall_with_default_probes(spark):
    x = clustered(1500, 32, 8, 0.3)
    found, model = mixture.clusters(table(spark, x), "row_id", "embedding", 32, 0.75)
    got = {}
    for r in found.collect():
        got.setdefault(r.cluster, set()).add(r.row_id)
    want = linked(x, range(1, 1501), 0.75, ["k"] * 1500)
    pairs = lambda gs: {p for g in gs for p in itertools.combinations(sorted(g), 2)}
    assert len(pairs(got.values()) & pairs(want)) >= 0.95 * len(pairs(want))
    assert len(model.means) > 1


@pytest.mark.parametrize("bounds", [{}, {"CHUNK_BYTES": 20_000, "EXCLUDED_BOUND": 3}, {"BLOCK_ROWS": 40}])
def test_links_across_components_are_found(spark, monkeypatch, bounds):
    """One component a vector: what the others hold is linked all the same, in one chunk or in several, with places broadcast or joined, with components divided."""
    for name, value in bounds.items():
        monkeypatch.setattr({"CHUNK_BYTES": border, "BLOCK_ROWS": mixture}.get(name, neighbours), name, value)
    x = clustered(500, 16, 10, 0.35)
    kinds = ["a" if i % 7 else "b" for i in range(500)]
    found, model = mixture.clusters(table(spark, x, kinds=kinds), "row_id", "embedding", 16, 0.75, ["kind"], probes=1)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.cluster, set()).add(r.row_id)
    assert {frozenset(g) for g in groups.values()} == linked(x, range(1, 501), 0.75, kinds)
    assert all(min(g) == c for c, g in groups.items()) and len(model.means) > 1


def test_vectors_are_read_once_however_many_chunks(spark, monkeypatch):
    """With places joined, more chunks of balls mean more passes over the codes only."""
    x = clustered(500, 16, 10, 0.35)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = table(spark, x)
    df = df.mapInArrow(counted, df.schema)
    monkeypatch.setattr(neighbours, "EXCLUDED_BOUND", 3)
    want, reads = linked(x, range(1, 501), 0.75, ["k"] * 500), []
    for chunk_bytes in (20_000, 4_000):
        monkeypatch.setattr(border, "CHUNK_BYTES", chunk_bytes)
        before, groups = read.value, {}
        for r in mixture.clusters(df, "row_id", "embedding", 16, 0.75, probes=1)[0].collect():
            groups.setdefault(r.cluster, set()).add(r.row_id)
        assert {frozenset(g) for g in groups.values()} == want
        reads.append(read.value - before)
    assert reads[1] <= reads[0]


def test_balls_of_whole_clusters():
    """Vectors of a cluster that came together in several blocks are one ball; what lies apart keeps its name."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 32))
    centre /= np.sqrt((centre * centre).sum(1, keepdims=True))
    unit = neighbours.normalised(np.concatenate([centre[0] + 0.05 * rng.normal(size=(6, 32)), centre[1:2], centre[2:]]).astype(np.float32))
    ids, label, ball = np.arange(10, 18), np.array([-5] * 7 + [9]), np.array([1, 1, 1, 2, 2, 2, 16, 17])
    ball, size = border.gathered(unit, ids, label, ball)
    assert ball.tolist() == [10] * 6 + [16, 17] and size.tolist() == [6] * 6 + [1, 1]


@pytest.mark.parametrize("wide", [0.85, 0.5])
def test_balls_lose_no_link(wide, monkeypatch):
    """All pairs of clusters that a link joins come out of the search among balls of any radius, from codes; what is certain is a link."""
    monkeypatch.setattr(border, "WHOLE_COSINE", wide)
    unit = neighbours.normalised(np.array(clustered(700, 24, 12, 0.3), np.float32))
    ids = np.arange(700) * 3
    root = ids - ids % 12  # clusters of four rows, of which many lie apart
    label = border.mixed(root)
    order = np.lexsort((ids, label))
    unit, ids, root, label = unit[order], ids[order], root[order], label[order]
    ball, size = border.gathered(unit, ids, label, ids)
    code, scale, error = neighbours.quantise(unit)
    columns = {"g": np.zeros(700, np.int64), "row_id": ids, "size": size, "ball": ball, "root": root, "scale": scale, "error": error, "code": [c.tobytes() for c in code]}
    leaders = pickle.loads(pickle.dumps(border.Leaders(pa.table(columns), 24, 0.75, np.eye(24))))
    found = list(leaders.candidates(0, ids, border.rank_key(size, ball), root, code * scale[:, None], float(error.max())))
    a, b, root_a, root_b, certain = (np.concatenate(c) for c in zip(*found))
    place = np.empty(2100, np.int64)
    place[ids] = np.arange(700)
    sims = np.einsum("ij,ij->i", unit[place[a]], unit[place[b]])
    assert (sims[certain] >= 0.75).all() and certain.any()
    p, q = np.nonzero((unit @ unit.T >= 0.75) & (root[:, None] < root[None, :]))
    pairs = lambda x, y: set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
    assert pairs(root[p], root[q]) <= pairs(root_a, root_b)


def test_information_criterion_and_fit():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.3, (400, 3)) for c in (-4, 0, 4)]).astype(np.float32)
    bics = {k: mixture.fit(x, k, rounds=30)[3] for k in (1, 6)}
    assert bics[6] < bics[1]
    means, variance, weights, _ = mixture.fit(x, 6, rounds=30)
    assert np.isfinite(means).all() and (variance > 0).all() and abs(np.exp(weights).sum() - 1) < 1e-3
