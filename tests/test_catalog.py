"""Catalog, collections, snapshots, verification, profile and search on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrail.functions.score import SimilaritySettings
from vitrail.operators import catalog, collections, hybrid, profile, search, topk, verify
from vitrail.sources import settings, snapshot
from vitrail.streaming import changes

IMAGE = "path string, root string, size bigint, modified bigint, last_seen_scan bigint, material_texture array<float>, material_texture_version int, embedding array<float>, embedding_normalized boolean, content_fingerprint bigint, description string"


@pytest.fixture
def images(spark):
    return spark.createDataFrame(
        [
            ("E:\\a\\1.png", "E:\\a", 10, 100, 3, [1.0], 1, [1.0], True, 7, "one"),
            ("E:\\a\\sub\\2.png", "E:\\a", 20, 200, 3, None, 0, None, False, None, "two"),
            ("E:\\ab\\3.png", "E:\\ab", 30, 300, 2, None, 0, None, False, None, None),
        ],
        IMAGE,
    )


def test_upsert_resets_and_keeps(spark, images):
    new = spark.createDataFrame([("E:\\a\\1.png", "E:\\a", 11, 101, 9, "uno"), ("E:\\a\\9.png", "E:\\a", 1, 1, 4, None)], "path string, root string, size bigint, modified bigint, last_seen_scan bigint, description string")
    got = {r.path: r for r in catalog.upsert(images, new).collect()}
    assert len(got) == 4
    first = got["E:\\a\\1.png"]
    assert (first.size, first.description, first.last_seen_scan, first.material_texture, first.material_texture_version, first.embedding, first.content_fingerprint) == (11, "uno", 3, None, 0, None, None)
    assert got["E:\\a\\9.png"].last_seen_scan == 4 and got["E:\\ab\\3.png"].size == 30
    assert catalog.upsert(images, new.limit(0)).count() == 3 and catalog.upsert(images.limit(0), new).count() == 2


def test_partial_updates(spark, images):
    e = spark.createDataFrame([("E:\\ab\\3.png", [3.0, 4.0]), ("none", [1.0, 0.0])], "path string, embedding array<float>")
    got = {r.path: r for r in catalog.set_embeddings(images, e).collect()}
    assert list(got["E:\\ab\\3.png"].embedding) == pytest.approx([0.6, 0.8]) and got["E:\\ab\\3.png"].embedding_normalized and list(got["E:\\a\\1.png"].embedding) == [1.0]


def test_delete_subtree(spark, images):
    kept, gone = catalog.delete_subtree(images, "E:\\a")
    assert rows(kept, "path") == [("E:\\ab\\3.png",)] and len(rows(gone)) == 2
    assert catalog.delete_subtree(images, "e:\\A")[0].count() == 1  # below it without regard to case
    assert catalog.delete_subtree(images, "E:\\a\\1.PNG")[0].count() == 3  # the path itself exactly


def test_generations(spark, images):
    discovered = spark.createDataFrame([("x", "E:\\a", 5)], "path string, root string, last_seen_scan bigint")
    assert rows(catalog.next_generation(images, discovered)) == [(6,)]
    assert rows(catalog.next_generation(images.limit(0), discovered.limit(0))) == [(1,)]
    top = discovered.withColumn("last_seen_scan", F.lit(catalog.MAX_GENERATION))
    assert rows(catalog.next_generation(images, top)) == [(1,)]
    seen = spark.createDataFrame([("x", "E:\\a"), ("y", "E:\\b")], "path string, root string")
    assert rows(catalog.mark_seen(discovered, seen, 6, add_missing=True)) == [("x", "E:\\a", 6), ("y", "E:\\b", 6)]
    assert rows(catalog.mark_seen(discovered, seen, 6)) == [("x", "E:\\a", 6)]
    assert rows(catalog.sweep(images, 3, ["E:\\a"]), "path") == rows(images, "path")
    assert rows(catalog.sweep(images, 9, ["E:\\a"]), "path") == [("E:\\ab\\3.png",)]


def test_changes(spark, images):
    listing = spark.createDataFrame([("E:\\a\\1.png", 10, 100), ("E:\\a\\sub\\2.png", 20, 201), ("new", 1, 1)], "path string, size bigint, modified bigint")
    assert rows(catalog.changes(listing, images)) == sorted([("E:\\a\\1.png", "unchanged"), ("E:\\a\\sub\\2.png", "changed"), ("new", "new")], key=str)
    assert ("E:\\a\\1.png", "changed") in rows(catalog.changes(listing, images, force=True))


def test_roots_and_libraries(spark, images):
    roots = spark.createDataFrame([("E:\\a",), ("E:\\ab",), ("E:\\a\\sub",), ("Z",)], "path string")
    assert catalog.add_root(roots, "E:\\a").count() == 4 and catalog.add_root(roots, "Y").count() == 5
    owned = {r.path: r.root for r in catalog.owning_root(images.select("path"), roots).collect()}
    few, catalog.FEW_ROOTS = catalog.FEW_ROOTS, 0
    try:
        assert owned == {r.path: r.root for r in catalog.owning_root(images.select("path"), roots).collect()}
    finally:
        catalog.FEW_ROOTS = few
    assert owned == {"E:\\a\\1.png": "E:\\a", "E:\\a\\sub\\2.png": "E:\\a\\sub", "E:\\ab\\3.png": "E:\\ab"}
    counts = {r.path: (r.indexed, r.discovered) for r in catalog.root_counts(roots, images, images.limit(0).select("path", "root")).collect()}
    assert counts["E:\\a"] == (2, 2) and counts["Z"] == (0, 0)
    left = catalog.remove_root("E:\\a", images=images, roots=roots)
    assert left["images"].count() == 1 and left["roots"].count() == 3
    portable = catalog.replace_root(images.limit(0), images, "E:\\a")
    assert rows(portable, "path", "root") == [("1.png", ""), ("sub\\2.png", "")]
    moved = catalog.import_root(images, portable, "G:\\n")
    assert ("G:\\n\\sub\\2.png",) in rows(moved, "path") and moved.count() == 5
    again = catalog.mirror_paths(portable, images.withColumn("size", F.lit(99).cast("bigint")), "E:\\a", spark.createDataFrame([("E:\\a\\1.png",)], "path string"))
    assert rows(again, "path", "size") == [("1.png", 99), ("sub\\2.png", 20)]
    registry = spark.createDataFrame([("l1", "E:\\a"), ("l2", "F:\\")], "library_id string, root_path string")
    assert rows(catalog.register_library(registry, "l2", "E:\\a")) == [("l2", "E:\\a")]
    rules = spark.createDataFrame([(1, "E:\\a\\x"), (1, "E:\\ab"), (1, "G:\\n\\x")], "collection_id bigint, folder_path string")
    assert rows(catalog.relocate(rules, "folder_path", "E:\\a", "G:\\n")) == [(1, "E:\\ab"), (1, "G:\\n\\x")]
    libraries = portable.select("path").withColumn("root", F.lit("E:\\a"))
    paths = spark.createDataFrame([("E:\\a\\sub",)], "path string")
    assert rows(catalog.remove_paths(libraries, spark.createDataFrame([("E:\\a",)], "path string"), paths), "path") == [("1.png",)]


def test_collections(spark, images):
    c = spark.createDataFrame([], "id bigint, name string")
    c = collections.create(c, " Stone ")
    assert rows(c) == [(1, "Stone")]
    for bad in ("stone", " "):
        with pytest.raises(ValueError):
            collections.create(c, bad)
    with pytest.raises(ValueError):
        collections.rename(c, 9, "x")
    assert rows(collections.rename(c, 1, "STONE")) == [(1, "STONE")]
    folders = spark.createDataFrame([(1, "E:\\a"), (1, "E:\\a\\sub"), (2, "e:\\AB\\")], "collection_id bigint, folder_path string")
    files = spark.createDataFrame([(1, "E:\\a\\1.png"), (2, "e:\\a\\1.png")], "collection_id bigint, file_path string")
    assert rows(collections.members(images, folders, files)) == [(1, "E:\\a\\1.png"), (1, "E:\\a\\sub\\2.png")]
    both = c.unionByName(spark.createDataFrame([(2, "b")], "id bigint, name string"))
    assert rows(collections.counts(both, images, images.limit(0), folders, files)) == [(1, 2, 0, 2), (2, 0, 0, 0)]
    on = spark.createDataFrame([(2, True)], "collection_id bigint, enabled boolean")
    assert rows(collections.in_face_scope(images, on, folders.withColumn("folder_path", F.regexp_replace("folder_path", r"\\$", "")), files), "path") == [("E:\\a\\1.png",), ("E:\\ab\\3.png",)]
    assert collections.in_face_scope(images, on.limit(0), folders, files).count() == 0
    assert rows(collections.set_face_flag(on, 2, False)) == [] and collections.set_face_flag(on, 1, True).count() == 2
    new = spark.createDataFrame([("E:\\A",), ("x",), ("X",), (None,)], "path string")
    merged, added = collections.add_rules(folders, 1, new, "folder_path")
    assert rows(added) == [(1, "X")] and merged.count() == 4
    assert collections.remove_rule(folders, 1, "E:\\A", "folder_path").count() == 2
    assert [x.count() for x in collections.delete(1, both, folders, files)] == [1, 1, 1]
    assert [x.count() for x in collections.assignable(spark.createDataFrame([("E:\\a\\1.png",), ("no",)], "path string"), images)] == [1, 1]


def test_snapshot(spark, images, tmp_path):
    folder = str(tmp_path / "t")
    assert snapshot.read_snapshot(spark, folder, images.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, folder)
    for k in (1, 2, 3):
        snapshot.write_snapshot(images.limit(k).drop("description"), folder)
        assert snapshot.read_snapshot(spark, folder, images.schema).count() == k
    assert snapshot.drop_old_versions(spark, folder, keep=1) >= 1
    assert snapshot.read_snapshot(spark, folder).count() == 3


def test_verify(spark):
    r = [("../x", 1, 1, 4, 0, 1), ("a.png", 1, 1, 4, 1, 1), ("b.png", 1, 1, 5, 1, 1), ("c.png", -3, 1, None, 0, None), ("d.png", 1, 1, 4, 1, 5)]
    df = spark.createDataFrame(r, "path string, size bigint, modified bigint, embedding_bytes int, embedding_dim int, content_fingerprint bigint")
    for n in ("color_histogram", "material_texture"):
        df = df.withColumn(f"{n}_bytes", F.lit(None).cast("int")).withColumn(f"{n}_dim", F.lit(0))
    listing = spark.createDataFrame([("a.png", 1, 1), ("b.png", 2, 3), ("c.png", 0, 1)], "path string, size bigint, modified bigint")
    assert rows(verify.problems(df, listing)) == sorted([("../x", "unsafe_relative_path"), ("b.png", "invalid_embedding"), ("b.png", "source_size_changed"), ("b.png", "source_modified_changed"), ("d.png", "missing_source")], key=str)
    prints = spark.createDataFrame([("a.png", 2), ("b.png", None), ("c.png", 4)], "path string, fingerprint bigint")
    deep = {x for x in rows(verify.problems(df, listing, prints)) if "fingerprint" in x[1] or "decode" in x[1]}
    assert deep == {("a.png", "fingerprint_mismatch"), ("b.png", "source_decode_failed"), ("c.png", "missing_fingerprint")}
    assert dict(rows(verify.report(verify.problems(df, listing), 5)))["records_checked"] == 5
    meta = lambda **kw: spark.createDataFrame(list(kw.items()), "key string, value string")
    assert verify.preflight(meta(schema_version="1", library_id="l"))["library_id"] == "l"
    for bad in ({"library_id": "l"}, {"schema_version": "2", "library_id": "l"}, {"schema_version": "1"}, {"schema_version": "1", "library_id": "l", "format": "other"}, {"schema_version": "x", "library_id": "l"}):
        with pytest.raises(ValueError):
            verify.preflight(meta(**bad))


def test_preview_repairs(spark):
    from vitrail.functions import hashing

    i = spark.createDataFrame([("a", 1, 1, 0), ("b", 2, 2, 0), ("c", 3, 3, 0)], "path string, size bigint, modified bigint, modified_nanos bigint")
    keys = {r.path: r.k for r in i.select("path", hashing.preview_key(F.col("path"), F.col("size"), F.col("modified"), F.col("modified_nanos")).alias("k")).collect()}
    cached = spark.createDataFrame([(keys["a"], True), (keys["b"], False), ("old", True)], "key string, valid boolean")
    assert {(r.path, r.action) for r in verify.preview_repairs(i, cached).collect()} == {("a", "keep"), ("b", "rebuild"), ("c", "build"), (None, "prune")}


def test_profile(spark):
    df = spark.createDataFrame([(0, 100, ""), (1000, 500, "JPG "), (2000, 1000, "jpg"), (100, 100, None), (None, 5, "png"), (1000, 2000, "png"), (6000, 4000, "tif")], "width int, height int, extension string")
    assert dict(rows(profile.extension_counts(df))) == {"<none>": 2, "jpg": 2, "png": 2, "tif": 1}
    assert dict(rows(profile.orientations(df))) == {"invalid": 2, "landscape": 3, "portrait": 1, "square": 1}
    assert dict(rows(profile.megapixel_buckets(df))) == {"up_to_0_5": 2, "0_5_to_2": 2, "over_20": 1}
    stats = {r.field: r for r in profile.dimension_stats(df).collect()}
    assert (stats["width"].n, stats["width"].smallest, stats["width"].p50, stats["width"].p90, stats["width"].largest) == (5, 100, 1000, 6000, 6000)
    assert profile.dimension_stats(df.limit(0)).count() == 0
    runs = spark.createDataFrame([("cpu", 1, 100, 10), ("cpu", 1, 200, 10), ("cpu", 1, 300, 10), ("gpu", 4, 50, 10)], "backend string, batch int, ms int, items int")
    assert {(r.backend, r.median_ms, r.speedup) for r in profile.timing_summary(runs).collect()} == {("cpu", 200.0, 1.0), ("gpu", 50.0, 4.0)}
    outcomes = spark.createDataFrame([("r", "processed"), ("r", "failed"), ("q", "skipped")], "root string, outcome string")
    assert rows(profile.run_summary(outcomes)) == [("q", 1, 0, 1, 0), ("r", 2, 1, 0, 1)]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_nearest_rank_against_sorting(spark, one_task):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([None, *range(20)])) for _ in range(500)]
    got = {r.g: r for r in profile.nearest_rank(spark.createDataFrame(data, "g string, v int"), ["g"], "v", {"a": 0.0, "m": 0.5, "z": 1.0}, one_task).collect()}
    for g in "ab":
        v = sorted(x for k, x in data if k == g and x is not None)
        assert (got[g].a, got[g].m, got[g].z) == (v[0], v[int((len(v) - 1) * 0.5 + 0.5)], v[-1])


def test_two_stage_candidates(spark):
    df = spark.range(500).select(
        F.col("id").alias("row_id"), (F.col("id") == 7).alias("is_exact"), (F.col("id") / 500).alias("histogram_score"), F.lit(None).cast("double").alias("hash_score"),
        (1 - F.col("id") / 500).alias("clip_score"), F.lit(0.5).alias("dominant_score"), (F.col("id") % 2 == 1).alias("passes_gate"),
    )
    s = SimilaritySettings(dominant_color_weight=0)
    got = {r.row_id for r in hybrid.candidates(df, s, 500, "row_id", most_results=10, most_candidates=20, min_rows=100).collect()}
    odd = list(range(1, 500, 2))
    assert got == set(odd[-20:]) | set([x for x in odd if x != 7][:20]) | {7}
    assert hybrid.candidates(df, s, 50, "row_id", min_rows=100).count() == 250
    assert hybrid.candidates(df, SimilaritySettings(0, 0, 0, 0), 500, "row_id", most_results=10, min_rows=100).count() == 250
    assert hybrid.candidates(df, s, 500, "row_id", most_results=200, most_candidates=20, min_rows=100).count() == 250
    assert [hybrid.component_limit(n) for n in (10, 5000, 10_000)] == [2000, 2500, 3000]


def test_top_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [1.0, 0.0])], "id int, v array<float>")
    assert rows(topk.exact_top_k(df, "id", "v", [1.0, 0.0], 3)) == [(1, 1.0), (2, 0.8), (6, 1.0)]
    got = topk.top_k_per_query(df.where("id <= 2"), df, "id", "v", 1)
    assert {(r.query_id, r.candidate_id) for r in got.collect()} == {(1, 6), (2, 1)}
    with pytest.raises(ValueError):
        topk.check_queries(df, "v", most_bytes=4)
    both = topk.overlap(got, topk.top_k_per_query(df.where("id <= 2"), df, "id", "v", 2), 2)
    assert rows(both) == [(0.5, 1.0)]
    assert rows(topk.even_sample(spark.range(10).toDF("id"), ["id"], 4)) == [(0,), (2,), (5,), (7,)]
    assert rows(topk.even_sample(spark.range(10).toDF("id"), ["id"], 4, endpoints=True)) == [(0,), (3,), (6,), (9,)]
    assert topk.even_sample(spark.range(0).toDF("id"), ["id"], 4).count() == 0


def test_approximate_index(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0]) for i in range(60)], "id int, v array<float>")
    index = topk.ApproximateIndex()
    points = index.fit(df, "id", "v")
    got = index.search(points, [0.0, 0.0, 1.0], 2).collect()
    assert len(got) == 2 and got[0].similarity == 1.0
    folder, signature = str(tmp_path), {"n_rows": 60, "mixed": 1}
    assert topk.index_state(folder, signature) == "missing"
    index.save(folder, signature)
    assert topk.index_state(folder, signature) == "current" and topk.index_state(folder, {"n_rows": 61}) == "stale"
    (tmp_path / "manifest.json").write_text("{")
    assert topk.index_state(folder, signature) == "corrupt"
    (tmp_path / "manifest.json").write_text('{"n_rows": 0}')
    assert topk.index_state(folder, {"n_rows": 0}) == "empty_current"


def test_index_is_rebuilt_when_rows_change(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5 - 2), 1.0]) for i in range(20)], "id int, v array<float>")
    states = []
    for table in (df, df, df.where("id < 19"), df.where("id < 19")):
        index = topk.ApproximateIndex()
        points, state = index.prepare(table, "id", "v", str(tmp_path))
        states.append(state)
        assert index.search(points, [0.0, 0.0, 1.0], 1).count() == 1
    assert states == ["missing", "current", "stale", "current"]


def test_snapshot_without_pointer_is_an_error(spark, tmp_path):
    """As a crash between deletion and renaming of the pointer would leave it."""
    folder = str(tmp_path)
    snapshot.write_snapshot(spark.range(3).toDF("id"), folder)
    snapshot.write_snapshot(spark.range(4).toDF("id"), folder)
    assert snapshot.read_snapshot(spark, folder).count() == 4
    (tmp_path / snapshot.POINTER).unlink()
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, folder, spark.range(1).schema)
    with pytest.raises(FileNotFoundError):
        snapshot.drop_old_versions(spark, folder, keep=0)


def test_reconciler(spark):
    done, busy = [], [False]
    r = changes.Reconciler(lambda batch, n: done.append((n, batch.count())), lambda: done.append("rescan"), lambda: busy[0])
    batch = lambda *kinds: spark.createDataFrame([(k, f"p{n}") for n, k in enumerate(kinds)], "kind string, path string")
    r(batch("create"), 0)
    busy[0] = True
    r(batch("create", "remove"), 1)
    r(batch("modify"), 2)
    assert done == [(0, 1)] and r.drain() == "waiting"
    busy[0] = False
    assert r.drain() == "applied" and done == [(0, 1), (1, 2), (2, 1)]
    r(batch("Error"), 3)
    assert done[-1] == "rescan" and len(done) == 4
    r(batch("create"), 4)
    assert done[-1] == (4, 1)


def test_visible_and_pages(spark):
    df = spark.createDataFrame([(1, "b.png", "B", "x stone", None, (250, 0, 0)), (2, "A.png", "a", None, "stone", (0, 0, 250)), (3, "c.png", "c", "", "", (250, 0, 0))], "row_id int, file_name string, path string, description string, keywords string, dominant struct<r:int,g:int,b:int>")
    assert rows(search.visible(df, query="STONE", color=(255, 0, 0)), "row_id") == [(1,)]
    assert search.visible(df).count() == 3
    assert rows(search.visible(df, members=spark.createDataFrame([("a",), ("a",)], "path string")), "row_id") == [(2,)]
    assert [r.path for r in search.page_after(df, "path", "A", 2, ignore_case=True).collect()] == ["B", "c"]
    assert [r.row_id for r in search.ordered_by_name(df).collect()] == [2, 1, 3]


def test_settings():
    s = settings.parse("batch_size = 9999\nworkers=0\nnothing=1\n# x=1\nbad", settings.IndexingSettings())
    assert (s.batch_size, s.workers) == (256, 1)
    assert settings.parse("enabled=TRUE\nmin_similarity=x", settings.FaceSettings()) == settings.FaceSettings(enabled=True)
    assert settings.parse(settings.render(s), settings.IndexingSettings()) == s
    assert settings.load("/none", settings.DetectorSettings()) == settings.DetectorSettings()


def test_schemas_and_new_libraries(spark, tmp_path):
    from vitrail.operators import faces
    from vitrail.sources import schema

    folder = str(tmp_path / "images")
    old = spark.createDataFrame([("a", 1)], "path string, size bigint")
    snapshot.write_snapshot(old, folder)
    got = snapshot.read_snapshot(spark, folder, schema.IMAGES)
    assert got.columns == schema.IMAGES.names and rows(got, "path", "size", "embedding") == [("a", 1, None)]
    meta = spark.createDataFrame(schema.new_library_meta(), schema.META)
    assert verify.preflight(meta)["schema_version"] == 1 and schema.new_library_id() != schema.new_library_id()
    a, b = faces.detector_revision("1", 0.6, 0.3, 5000), faces.detector_revision("1", 0.60001, 0.3, 5000)
    assert a != b and a == faces.detector_revision("1", 0.6, 0.3, 5000)


def test_row_numbers_over_many_partitions(spark):
    from vitrail.operators.ordering import row_numbers, running_totals

    ids = random.Random(7).sample(range(10**6), 5000)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(7)
    assert [r.id for r in row_numbers(df, ["id"]).orderBy("_row").collect()] == sorted(ids)
    assert [r._row for r in row_numbers(df, ["id"]).orderBy("id").collect()] == list(range(5000))
    counted = df.select((F.col("id") % 3).alias("g"), "id", F.lit(2).cast("bigint").alias("c"))
    for r in running_totals(counted, ["g"], "id", "c").where("id % 50 = 0").collect():
        group = [i for i in ids if i % 3 == r.g]
        assert r._upto == 2 * sum(i <= r.id for i in group) and r._n == 2 * len(group)
