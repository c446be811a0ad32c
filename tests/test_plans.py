"""Whole runs and reports on generated pictures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrail.operators import faces, features
from vitrail.plans import benchmarks, pipelines

IMAGE = "row_id bigint, path string, root string, file_name string, extension string, size bigint, modified bigint, width int, height int, description string, keywords string, dominant struct<r:int,g:int,b:int>, visual_hash bigint, color_histogram array<float>, material_texture array<float>, material_texture_version int, embedding array<float>, embedding_normalized boolean, last_seen_scan bigint, content_fingerprint bigint"


def png(seed, h=24, w=32):
    rng = np.random.default_rng(seed)
    return features.encode_png(np.clip(rng.normal(rng.integers(40, 200), 30, (h, w, 3)), 0, 255).astype(np.uint8))


def library(spark, names, content=png):
    listing = spark.createDataFrame([("/r", f"/r/{n}", 10 + i, 100) for i, n in enumerate(names)], "root string, path string, size bigint, modified bigint")
    files = spark.createDataFrame([(f"/r/{n}", bytearray(content(i) if not n.startswith("bad") else b"x")) for i, n in enumerate(names)], "path string, content binary")
    return listing, files


def test_rescan(spark):
    images = spark.createDataFrame([], IMAGE)
    discovered = spark.createDataFrame([("/r/old.png", "/r", 0)], "path string, root string, last_seen_scan bigint")
    listing, files = library(spark, ["a.png", "b.png", "bad.png"])
    images, discovered, outcomes = pipelines.rescan(images, discovered, listing, files, ["/r"])
    assert rows(outcomes, "path", "outcome") == [("/r/a.png", "processed"), ("/r/b.png", "processed"), ("/r/bad.png", "failed")]
    assert {(r.file_name, r.extension, r.width, r.height, r.material_texture_version) for r in images.collect()} == {("a.png", "png", 32, 24, 1), ("b.png", "png", 32, 24, 1)}
    assert rows(discovered, "path") == [("/r/a.png",), ("/r/b.png",), ("/r/bad.png",)]
    fewer = listing.where("path <> '/r/b.png'")
    kept, _, outcomes = pipelines.rescan(images, discovered, fewer, files, [])
    assert kept.count() == 2 and ("/r/a.png", "skipped") in rows(outcomes, "path", "outcome")
    swept, seen, _ = pipelines.rescan(images, discovered, fewer, files, ["/r"], force=True)
    assert rows(swept, "path") == [("/r/a.png",)] and seen.count() == 2


def test_backfill(spark):
    images = spark.createDataFrame([(1, "/r/a.png"), (2, "/r/bad.png")], "row_id bigint, path string")
    for f in spark.createDataFrame([], IMAGE).schema.fields[2:]:
        images = images.withColumn(f.name, F.lit(None).cast(f.dataType))
    _, files = library(spark, ["a.png", "bad.png"])
    done, outcomes = pipelines.backfill_descriptors(images, files)
    assert rows(outcomes, "path", "outcome") == [("/r/a.png", "processed"), ("/r/bad.png", "failed")]
    assert [len(r.material_texture or []) for r in done.orderBy("row_id").collect()] == [48, 0]
    done, outcomes = pipelines.backfill_embeddings(images, files, lambda: lambda contents: [[float(len(c)), 0.0] for c in contents], 2)
    assert [list(r.embedding) for r in done.collect()] == [[1.0, 0.0]] * 2


def test_face_pipelines(spark):
    images = spark.createDataFrame([("/r/a.png", 10, 100), ("/r/b.png", 11, 100), ("/r/bad.png", 12, 100), ("/r/gone.png", 13, 100)], "path string, size bigint, modified bigint")
    listing, contents = library(spark, ["a.png", "b.png", "bad.png"])
    files = contents.join(listing.drop("root"), "path").withColumns({"orientation": F.lit(1), "width": F.lit(32), "height": F.lit(24)})
    from tests.test_faces_and_evaluation import FACE, STATE, VECTOR

    state, stored, vectors = (spark.createDataFrame([], s) for s in (STATE, FACE, VECTOR))

    def detector():
        def run(content):
            picture = features.decode_png(content)
            return [{"confidence": 0.9, "x": 0.2, "y": 0.2, "width": 0.5, "height": 0.5, "landmarks": []}] if picture.sum() % 2 == png_parity else []

        return run

    png_parity = int(features.decode_png(png(0)).sum() % 2)
    d = faces.Detector("d", "1", "r")
    state, stored, outcomes = pipelines.detect_faces(images, images, state, stored, files, detector, d)
    assert dict(rows(outcomes, "path", "outcome")) == {"/r/a.png": "processed", "/r/b.png": "processed", "/r/bad.png": "failed", "/r/gone.png": "skipped"}
    assert ("/r/a.png", 1) in rows(state, "image_path", "face_count") and state.count() == 2
    again = pipelines.detect_faces(images.where("path like '%/a.png'"), images, state, stored, files, detector, d)
    assert again[2].count() == 0
    r = faces.EmbeddingRevision("m", "1", "c", "a", 3)
    vectors, outcomes = pipelines.embed_faces(stored, vectors, contents, lambda: lambda pictures: [[1.0, 2.0, float(p.shape[0])] for p in pictures], r)
    assert vectors.count() == stored.count() == outcomes.where("outcome = 'processed'").count()
    assert pipelines.embed_faces(stored, vectors, contents, lambda: lambda p: [], r)[1].count() == 0


def test_attach_library(spark):
    images = spark.createDataFrame([(1, "E:\\old\\a", "E:\\old")], "row_id bigint, path string, root string")
    tables = pipelines.attach_library(
        images, spark.createDataFrame([("E:\\old",)], "path string"), spark.createDataFrame([("lib", "E:\\old")], "library_id string, root_path string"),
        {"folder_path": spark.createDataFrame([(1, "E:\\old\\x")], "collection_id bigint, folder_path string")},
        spark.createDataFrame([("schema_version", "1"), ("library_id", "lib")], "key string, value string"),
        spark.createDataFrame([(7, "a", ""), (8, "s\\b", "")], "row_id bigint, path string, root string"), "G:\\new",
    )
    assert rows(tables["images"], "path") == [("G:\\new\\a",), ("G:\\new\\s\\b",)]
    assert rows(tables["roots"]) == [("G:\\new",)] and rows(tables["registry"]) == [("lib", "G:\\new")] and rows(tables["folder_path"]) == [(1, "G:\\new\\x")]


def test_previews(spark):
    files = spark.createDataFrame([("a", bytearray(png(1, 40, 60)), 1, 1, 0), ("b", bytearray(b""), 1, 1, 0)], "path string, content binary, size bigint, modified bigint, modified_nanos bigint")
    got = {r.path: r for r in pipelines.previews(files, 20).collect()}
    assert features.decode_png(bytes(got["a"].content)).shape[:2] == (13, 20) and got["b"].error and len(got["a"].key) == 16


def test_reports(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(40)], "row_id int, embedding array<float>")
    same = benchmarks.preview_benchmark(vectors, vectors, samples=20).first()
    assert (same.cosine_mean, same.recall_at_10, same.recall_at_25, same.top1_agreement) == (1.0, 1.0, 1.0, 1.0)
    ann = benchmarks.ann_benchmark(vectors, "row_id", "embedding", queries=3, ks=(5,))
    assert ann["recall_at_5"] > 0.9 and ann["queries"] == 3
    corpus = vectors.withColumnRenamed("row_id", "item_id")
    q = corpus.limit(5).withColumn("variant", F.lit("half_size"))
    r = {x.variant: x for x in benchmarks.robustness(corpus, q).collect()}
    assert r["overall"].recall_at_1 == 1.0 and r["half_size"].queries == 5
    table, failed = benchmarks.model_benchmark({"m": (corpus, q), "n": ValueError("no model")})
    assert table.count() == 2 and failed == {"n": "no model"}
    t = benchmarks.runtime_benchmark(spark, {"cpu": lambda: len, "bad": lambda: 1 / 0}, [b"x"] * 4, (1, 2), 2)
    assert {x.backend for x in t.collect()} == {"cpu"}
    manifest = tmp_path / "f.tsv"
    manifest.write_text("model\tm\t1\tcpu\tmit\ttrue\ttrue\tbundled\turl\nimage\ti1\ngt\ti1\t0\t0\t0.5\t0.5\npred\ti1\t0.9\t0\t0\t0.5\t0.5\nidentity\ta\tp\tb\tp\t0.9\n")
    f = benchmarks.face_benchmark(spark, str(manifest))
    assert f["detection"].first().f1 == 1.0 and f["identity"].first().recall_at_1 == 1.0
    manifest.write_text("image\ti1\n")
    with pytest.raises(ValueError):
        benchmarks.face_benchmark(spark, str(manifest))


def test_texture_material_and_profile_reports(spark, tmp_path):
    pictures = {f"{k}{i}": np.clip(np.random.default_rng(i).normal(base, 20, (40, 40, 3)), 0, 255).astype(np.uint8) for k, base in (("a", 60), ("b", 180)) for i in range(3)}
    listing = [(n, features.difference_hash(p), [float(x) for x in features.texture(p)]) for n, p in pictures.items()]
    table = spark.createDataFrame([(n, n[0], h, t) for n, h, t in listing], "item_id string, group string, visual_hash bigint, material_texture array<float>")
    numbered = table.withColumn("item_id", F.conv(F.hex("item_id"), 16, 10).cast("bigint"))
    r = {x["score"]: x for x in benchmarks.texture_benchmark(numbered, numbered).collect()}
    assert set(r) == set(benchmarks.TEXTURE_SCORES) and r["blend"].recall_at_1 == 1.0
    images = spark.createDataFrame(
        [(i, f"/base/{n}.png", "png", 100, p.shape[1], p.shape[0], dict(zip("rgb", features.dominant_color(p))), features.difference_hash(p), [float(x) for x in features.color_histogram(p)], [float(x) for x in features.texture(p)], [1.0, float(n[0] == "a")]) for i, (n, p) in enumerate(pictures.items())],
        "row_id bigint, path string, extension string, size bigint, width int, height int, dominant struct<r:int,g:int,b:int>, visual_hash bigint, color_histogram array<float>, material_texture array<float>, embedding array<float>",
    )
    m = tmp_path / "m.tsv"
    m.write_text("".join(f"{n[0]}\t{n}.png\n" for n in pictures))
    metrics, missing = benchmarks.material_benchmark(spark, str(m), "/base", images)
    got = {x["score"]: x for x in metrics.collect()}
    assert got["vector"].recall_at_1 == 1.0 and got["histogram"].queries == 6 and missing.count() == 0
    with pytest.raises(ValueError):
        benchmarks.material_benchmark(spark, str(m), "/base", images.limit(2))
    report = dict(rows(benchmarks.library_profile(images, images.select("path").limit(4))))
    assert report["n_rows"] == 6 and report["missing_sources"] == 2 and report["extension.png"] == 6 and report["width.p50"] == 40


def test_face_runner(spark):
    points = [{"x": float(x) / 112, "y": float(y) / 112} for x, y in features.ALIGNED_POINTS]
    pictures = {f"f{i}": features.encode_png(np.full((112, 112, 3), 40 + 60 * (i // 2), np.uint8)) for i in range(4)}
    found = spark.createDataFrame([(n, f"p{i // 2}", n, points) for i, n in enumerate(pictures)], "face_id string, person_id string, image_path string, landmarks array<struct<x:double,y:double>>")
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in pictures.items()], "path string, content binary")
    got = benchmarks.face_runner(found, files, lambda: lambda ps: [[float(p[56, 56, 0]), 50.0] for p in ps], 2).first()
    assert (got.queries, got.recall_at_1, got.same_pairs, got.different_pairs) == (4, 1.0, 4, 8)
