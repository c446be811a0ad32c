"""Faces, detection, evaluation, features, manifests, listings and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrail.operators import detection, evaluate, faces, features
from vitrail.sources import listing, manifests
from vitrail.streaming import changes

D = faces.Detector("d", "1", "r1")
R = faces.EmbeddingRevision("m", "1", "c1", "align", 2)
FACE = "face_id string, image_path string, face_ordinal int, detector_id string, detector_version string, detector_cache_revision string, schema_version bigint, confidence float, bbox struct<x:float,y:float,width:float,height:float>, landmarks array<struct<x:float,y:float>>, source_size bigint, source_modified bigint"
STATE = "image_path string, detector_id string, detector_version string, detector_cache_revision string, schema_version bigint, source_size bigint, source_modified bigint, exif_orientation int, oriented_width int, oriented_height int, face_count int, completed_at bigint"
VECTOR = "face_id string, model_id string, model_version string, model_cache_revision string, schema_version bigint, alignment_revision string, dimension int, normalized boolean, embedding array<float>, detector_id string, detector_version string, detector_cache_revision string, detection_schema_version bigint, source_size bigint, source_modified bigint"


def face(i, path, size=1, x=0.1):
    return (i, path, 0, "d", "1", "r1", 2, 0.9, (x, 0.1, 0.2, 0.2), [], size, 1)


def vec(i, v, model="1", size=1):
    return (i, "m", model, "c1", 1, "align", 2, True, v, "d", "1", "r1", 2, size, 1)


@pytest.fixture
def tables(spark):
    images = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("n", None, 1)], "path string, size bigint, modified bigint")
    state = spark.createDataFrame([(p, "d", "1", "r1", 2, s, 1, 1, 9, 9, 1, 0) for p, s in (("a", 1), ("b", 2), ("n", 1))], STATE)
    f = spark.createDataFrame([face("f1", "a"), face("f2", "a", x=0.5), face("f3", "b", 2), face("f4", "gone")], FACE)
    e = spark.createDataFrame([vec("f1", [1.0, 0.0]), vec("f2", [0.6, 0.8]), vec("f3", [0.0, 1.0], size=2), vec("f4", [1.0, 0.0], model="0"), vec("f1", [1.0, 0.0])], VECTOR)
    return images, state, f, e


def test_currency(spark, tables):
    images, state, f, e = tables
    assert rows(faces.needs_detection(images, state, D)) == [("b",), ("c",)]  # a null size makes no difference
    assert rows(faces.needs_detection(images, state, faces.Detector("d", "1", "r2"))) == [("a",), ("b",), ("c",), ("n",)]
    assert rows(faces.needs_embedding(f, e, R), "face_id") == [("f4",)]
    assert rows(faces.current_embeddings(e, f, R), "face_id") == [("f1",), ("f1",), ("f2",), ("f3",)]
    assert rows(faces.compatible(e, f, state, images, R), "face_id") == [("f1",), ("f2",)]
    assert rows(faces.compatible(e, f, state, None, R), "face_id") == [("f1",), ("f2",), ("f3",)]
    assert faces.detection_is_current(state, D, F.lit(1), F.lit(1)).count() == 2
    assert faces.compatible(e.limit(0), f, state, images, R).count() == 0
    fresh = images.withColumnRenamed("x", "y")
    assert rows(faces.source_still_matches(f, fresh), "face_id") == [("f1",), ("f2",)]


def test_replace_detections(spark, tables):
    images, state, f, _ = tables
    done = spark.createDataFrame([("a", 5, 5, 1, 10, 10), ("c", 5, 5, 3, 10, 10), ("gone", 5, 5, 1, 10, 10), ("b", 5, 5, 9, 10, 10)], "image_path string, source_size bigint, source_modified bigint, exif_orientation int, oriented_width int, oriented_height int")
    found = spark.createDataFrame([("a", 0.5, (0.5, 0.0, 0.2, 0.2), None), ("a", 0.9, (-0.1, 0.0, 0.2, 0.2), [(2.0, 0.5)]), ("a", 0.9, (0.5, 0.5, 0.0, 0.1), None)], "image_path string, confidence float, bbox struct<x:float,y:float,width:float,height:float>, landmarks array<struct<x:float,y:float>>")
    new_state, new_faces = faces.replace_detections(state, f, images, done, found, D)
    assert {(r.image_path, r.face_count) for r in new_state.collect()} == {("a", 2), ("b", 1), ("c", 0), ("n", 1)}
    got = [(r.face_ordinal, round(r.bbox.x, 3), round(r.bbox.width, 3)) for r in new_faces.where("image_path = 'a'").orderBy("face_ordinal").collect()]
    assert got == [(0, 0.0, 0.1), (1, 0.5, 0.2)]
    assert new_faces.where("image_path = 'b'").count() == 1
    with pytest.raises(ValueError):
        faces.stored_faces(found, faces.Detector(" ", "1", "r"))


def test_face_search(spark):
    lib = lambda v: spark.createDataFrame(v, "library_id string, image_path string, face_id string, embedding array<float>")
    df = lib([("l", "a", "q", [1.0, 0.0]), ("l", "a", "1", [0.8, 0.6]), ("l", "a", "2", [0.6, 0.8]), ("m", "a", "q", [0.8, 0.6]), ("m", "b", "3", [3.0, 0.0]), ("l", "c", "4", [0.0, 1.0]), ("l", "d", "5", None)])
    got = faces.search(df, [1.0, 0.0], "q", "l").collect()
    assert [(r.library_id, r.face_id) for r in got] == [("l", "1"), ("m", "q"), ("l", "4")]
    assert faces.search(df, [1.0, 0.0], "q", "l", collapse_image=False).count() == 4
    assert faces.search(df, [1.0, 0.0], "q", "l", limit=1).count() == 1
    assert [r.face_id for r in faces.search(df, [1.0, 0.0], "q", "l", min_similarity=0.45).collect()] == ["1", "q"]
    assert rows(faces.search_report(df, ["l", "m", "x"], ["l", "m"])) == [(3 - 0, 1, 7, 2)] or rows(faces.search_report(df, ["l", "m", "x"], ["l", "m"])) == [(2, 1, 7, 2)]
    for bad in ([1.0], [2.0, 0.0], [math.nan, 0.0]):
        with pytest.raises(ValueError):
            faces.check_query("q", "l", bad, R)
    with pytest.raises(ValueError):
        faces.check_query(" ", "l", [1.0, 0.0], R)


def test_merge_embeddings(spark, tables):
    _, _, f, e = tables
    new = spark.createDataFrame([vec("f1", [0.0, 1.0]), vec("f2", [5.0, 0.0]), vec("f3", [0.0, 1.0], size=9)], VECTOR)
    got = {r.face_id: list(r.embedding) for r in faces.merge_embeddings(e, new, f).collect()}
    assert got["f1"] == [0.0, 1.0] and got["f2"] == pytest.approx([0.6, 0.8]) and len(got) == 4


def boxes(spark, data):
    return spark.createDataFrame(data, "image_id string, kind string, confidence double, x double, y double, width double, height double")


def test_detection_metrics(spark):
    data = [
        ("i", "gt", 0.0, 0.0, 0.0, 0.09, 0.1), ("i", "gt", 0.0, 0.5, 0.5, 0.4, 0.4), ("i", "pred", 0.9, 0.0, 0.0, 0.09, 0.1), ("i", "pred", 0.8, 0.0, 0.0, 0.1, 0.1),
        ("e", "pred", 0.9, 0.0, 0.0, 0.1, 0.1), (None, "pred", 0.9, 0.0, 0.0, 0.1, 0.1),
    ]
    images = spark.createDataFrame([("i",), ("e",), ("z",)], "image_id string")
    r = detection.detection_metrics(images, boxes(spark, data)).first()
    assert (r.images, r.tp, r.fp, r.fn, r.no_face_images, r.no_face_images_with_fp) == (3, 1, 2, 1, 2, 1)
    assert (r.precision, r.recall, r.f1) == (0.333333, 0.5, 0.4) and (r.tiny_recall, r.large_recall) == (1.0, 0.0)
    none = detection.detection_metrics(images, boxes(spark, [])).first()
    assert (none.tp, none.precision, none.f1) == (0, 0.0, 0.0)


def test_whole_groups():
    import pandas as pd

    rng = random.Random(3)
    keys = sorted(rng.choice("abcdefg") for _ in range(60))
    df = pd.DataFrame({"k": keys, "v": range(60)})
    for size in (1, 2, 7, 60):
        parts = list(detection.whole_groups((df.iloc[s : s + size] for s in range(0, 60, size)), "k"))
        assert [v for rows, _ in parts for v in rows["v"]] == list(range(60))
        assert [len(set(rows["k"].iloc[a:b])) for rows, limits in parts for a, b in zip(limits[:-1], limits[1:])] == [1] * len(set(keys))
    assert list(detection.whole_groups(iter([]), "k")) == []


def test_suppression(spark):
    b = np.array([[0, 0, 1, 1], [0.05, 0, 1, 1], [3, 3, 1, 1]], float)
    assert detection.suppress_image(b, np.array([0.5, 0.9, 0.4])).tolist() == [1, 2]
    assert detection.suppress_image(b, np.array([0.5, 0.9, 0.4]), top=1).tolist() == [1]
    df = spark.createDataFrame([("i", 0.9, 0.0, 0.0, 1.0, 1.0), ("i", 0.8, 0.0, 0.0, 1.0, 1.0), ("j", 0.1, 0.0, 0.0, 1.0, 1.0)], "image_id string, score double, x double, y double, width double, height double")
    assert rows(detection.suppress(df), "image_id", "score") == [("i", 0.9), ("j", 0.1)]


def test_ranks(spark):
    s = spark.createDataFrame([(1, "a", 2, "b", 0.9), (1, "a", 3, "a", 0.9), (1, "a", 4, "a", 0.1), (5, "z", 2, "b", 0.3)], "query_id int, query_group string, candidate_id int, candidate_group string, score double")
    ranks = evaluate.first_relevant_rank(s)
    assert rows(ranks) == [(1, 2), (5, None)]
    m = evaluate.rank_metrics(ranks, (1, 5)).first()
    assert (m.queries, m.recall_at_1, m.recall_at_5, m.mrr, m.mean_rank) == (1, 0.0, 1.0, 0.5, 2.0)
    assert evaluate.rank_metrics(ranks, (5,), drop_unranked=False).first().recall_at_5 == 0.5
    assert evaluate.rank_metrics(ranks.limit(0)).first().mrr == 0.0
    t = spark.createDataFrame([(1, 4)], "query_id int, candidate_id int")
    assert rows(evaluate.target_rank(s, t)) == [(1, 3)]
    g = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "g string")
    assert rows(evaluate.with_group_positives(g, "g")) == [("a",), ("a",)]
    long = evaluate.score_variants(s.withColumn("other", F.lit(None).cast("double")), ["score", "other"])
    assert long.count() == 4 and evaluate.isolated({"a": 1, "b": ValueError("x")}) == ({"a": 1}, {"b": "x"})


def test_threshold_sweep_against_counting(spark):
    rng = random.Random(1)
    data = [(rng.random() < 0.4, float(np.float32(rng.choice([-1, 1, 0.9, 0.5, round(rng.uniform(-1, 1), 2)])))) for _ in range(400)]
    df = spark.createDataFrame(data, "same boolean, similarity float")
    best = None
    for r in evaluate.threshold_sweep(df).orderBy("step").collect():
        t = -1 + 2 * r.step / 200
        tp, fp = sum(s and x >= t for s, x in data), sum(not s and x >= t for s, x in data)
        assert (r.tp, r.fp, r.tp + r.fn, r.fp + r.tn) == (tp, fp, sum(s for s, _ in data), sum(not s for s, _ in data))
        key = (r.f1, -r.fp, r.threshold)
        best = max(best, key) if best else key
    assert evaluate.best_threshold(df).first().threshold == pytest.approx(best[2])
    assert evaluate.threshold_sweep(df.limit(0)).count() == 201


def test_identity_metrics(spark):
    df = spark.createDataFrame([(1, "p", 2, "q", 0.9), (1, "p", 3, "p", 0.8), (4, "r", 2, "q", 0.1)], "query_id int, query_person string, candidate_id int, candidate_person string, similarity float")
    m = evaluate.identity_metrics(df).first()
    assert (m.queries, m.recall_at_1, m.recall_at_5, m.mrr, m.same_pairs, m.different_pairs) == (2, 0.0, 0.5, 0.25, 1, 2)
    assert m.same_p50 == pytest.approx(0.2, abs=1e-5)


# Features


def picture(h=40, w=60, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), np.uint8)


def test_descriptors():
    flat = np.full((20, 30, 3), (200, 100, 50), np.uint8)
    assert features.dominant_color(flat) == (200, 100, 50)
    h = features.color_histogram(flat)
    assert h[3 * 16 + 1 * 4 + 0] == 1 and h.sum() == 1
    clear = np.dstack([flat, np.zeros((20, 30), np.uint8)])
    assert features.dominant_color(clear) == (0, 0, 0) and features.color_histogram(clear).sum() == 0
    falling = np.repeat(np.linspace(250, 5, 90).astype(np.uint8)[None, :, None], 80, 0).repeat(3, 2)
    assert features.difference_hash(falling) == -1 and features.difference_hash(falling[:, ::-1]) == 0
    t = features.texture(picture())
    assert t.shape == (48,) and [round(float(t[a:b].sum()), 4) for a, b in ((0, 8), (8, 16), (16, 32), (32, 48))] == [1] * 4
    assert features.texture(flat)[:16].sum() == 0
    assert features.gradient_histogram(np.zeros((2, 9))).sum() == 0 and features.pattern_histogram(np.zeros((9, 2), int)).sum() == 0
    stripes = np.tile((np.arange(96) % 8 < 4).astype(np.uint8) * 255, (96, 1))
    assert features.gradient_histogram(stripes)[0] == 1 and features.gradient_histogram(stripes.T)[4] == 1
    assert np.allclose(features.pattern_histogram(stripes), features.pattern_histogram(np.rot90(stripes)), atol=0.02)
    assert features.content_fingerprint(picture()) != features.content_fingerprint(picture(60, 40))


def test_tied_dominant_bins_take_the_last():
    p = np.zeros((2, 2, 3), np.uint8)
    p[0] = 250
    assert features.dominant_color(p) == (250, 250, 250)


def test_orientation():
    p = np.arange(6, dtype=np.uint8).reshape(2, 3)[..., None].repeat(3, 2)
    shapes = {1: (2, 3), 2: (2, 3), 3: (2, 3), 4: (2, 3), 5: (3, 2), 6: (3, 2), 7: (3, 2), 8: (3, 2), 9: (2, 3)}
    corner = {1: 0, 2: 2, 3: 5, 4: 3, 5: 0, 6: 3, 7: 5, 8: 2, 9: 0}
    for o, shape in shapes.items():
        q = features.orient(p, o)
        assert q.shape[:2] == shape and q[0, 0, 0] == corner[o]


def test_png_round_trip_and_variants():
    p = picture()
    assert np.array_equal(features.decode_png(features.encode_png(p)), p)
    for bad in (b"", b"GIF89a", features.encode_png(p)[:60]):
        with pytest.raises(ValueError):
            features.decode_png(bad)
    v = features.variants(p)
    assert {k: x.shape[:2] for k, x in v.items()} == {"centre_crop": (32, 48), "offset_crop": (28, 42), "half_size": (20, 30)}


def test_alignment():
    rng = np.random.default_rng(3)
    angle, scale, shift = 0.4, 1.7, np.array([20.0, 35.0])
    turn = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    source = features.ALIGNED_POINTS @ turn.T + shift
    m = features.similarity_transform(source, features.ALIGNED_POINTS)
    assert np.allclose(source @ m[:, :2].T + m[:, 2], features.ALIGNED_POINTS)
    with pytest.raises(ValueError):
        features.similarity_transform(np.ones((5, 2)), features.ALIGNED_POINTS)
    p = rng.integers(0, 256, (112, 112, 3), np.uint8)
    assert np.array_equal(features.align_face(p, features.ALIGNED_POINTS), p)
    assert features.align_face(p, features.ALIGNED_POINTS + 500).sum() == 0
    assert features.embedder_input(p).shape == (3, 112, 112) and features.detector_input(picture()).shape == (3, 64, 64)
    assert features.crop_face(picture(), (0.4, 0.4, 0.2, 0.2), []).size > 0
    out = {8: {"cls": np.array([1.0] + [0.0] * 63), "obj": np.ones(64), "bbox": np.zeros((64, 4)), "kps": np.zeros((64, 10))}}
    got = features.decode_detections(out, (64, 64), (64, 64))
    assert len(got) == 1 and got[0]["width"] == 8 / 64 and len(got[0]["landmarks"]) == 5


def test_inspect_isolates_failures(spark):
    p = features.encode_png(picture())
    df = spark.createDataFrame([("a", bytearray(p)), ("b", bytearray(b"no"))], "path string, content binary")
    got = {r.path: r for r in features.inspect(df).collect()}
    assert (got["a"].width, got["a"].height, got["a"].error) == (60, 40, None) and len(got["a"].material_texture) == 48
    assert got["b"].width is None and got["b"].error == "unsupported format"

    def model():
        return lambda contents: [[3.0, 4.0] if c[:1] == b"\x89" else [0.0, 0.0] for c in contents]

    e = {r.path: r for r in features.embed(df, model, 2).collect()}
    assert list(e["a"].embedding) == pytest.approx([0.6, 0.8]) and e["b"].error == "invalid vector"
    short = {r.error for r in features.embed(df, lambda: lambda c: [], 2).collect()}
    assert all("vectors for" in x for x in short)

    def detector():
        def run(content):
            if content == b"no":
                raise ValueError("broken")
            return [{"confidence": 0.9, "x": 0.1, "y": 0.1, "width": 0.2, "height": 0.2, "landmarks": [(0.1, 0.2)]}]

        return run

    f = {(r.image_path, r.error) for r in features.detect(df, detector).collect()}
    assert f == {("a", None), ("b", "broken")}


# Sources


def test_listing_and_metadata(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / listing.INDEX_FOLDER).mkdir()
    png = features.encode_png(picture(8, 8)) + b'<dc:title>Slab &amp; tile</dc:title><dc:subject>a</dc:subject><x xmp:Label="slab &amp; tile"/>'
    for name in ("a.PNG", "sub/b.png", "c.txt", f"{listing.INDEX_FOLDER}/d.png"):
        (tmp_path / name).write_bytes(png)
    got = listing.list_images(spark, [str(tmp_path)]).collect()
    assert {r.path.rsplit("/", 1)[1] for r in got} == {"a.PNG", "b.png"} and {r.size for r in got} == {len(png)}
    meta = listing.text_metadata(listing.read_files(spark, str(tmp_path / "sub"))).first()
    assert (meta.description, meta.keywords, meta.orientation) == ("Slab & tile | slab &amp; tile", "a", 1) or meta.description.startswith("Slab & tile")
    listing.write_report(spark.createDataFrame([("Rows n", 3), ("a", None)], "metric string, value int"), str(tmp_path / "report"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "report")).collect()) == ["a=", "rows_n=3"]


def test_exif():
    import struct

    def tiff(order):
        text = b"A  slab\0"
        head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
        entries = struct.pack(order + "HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack(order + "HHII", 0x010E, 2, len(text), 8 + 2 + 24 + 4)
        return head + struct.pack(order + "H", 2) + entries + struct.pack(order + "I", 0) + text

    for order in "<>":
        assert listing.exif_fields(tiff(order)) == {"Orientation": "6", "ImageDescription": "A  slab"}
    body = b"Exif\0\0" + tiff("<")
    assert listing.exif_fields(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body)["Orientation"] == "6"
    assert listing.exif_fields(b"\xff\xd8") == {} and listing.exif_fields(tiff("<")[:20]) in ({}, {"Orientation": "6"})


def write(tmp_path, text):
    p = tmp_path / "m.tsv"
    p.write_text(text)
    return str(p)


def test_material_manifest(spark, tmp_path):
    path = write(tmp_path, "# c\ngroup\tpath\ng1\ta.png\ng1\tA.png\ng1\tb.png\n\ng2\tx.png\ng3\tc.png\ng4\tC.png\ng5\n")
    good, bad = manifests.material_manifest(spark, path, "/base")
    assert rows(good) == [("g1", "/base/a.png"), ("g1", "/base/b.png")]
    assert sorted(r.reason for r in bad.collect()) == ["group of one", "path in several groups", "path in several groups", "two columns are needed"]
    have = spark.createDataFrame([("/BASE/A.png",)], "path string")
    assert rows(manifests.missing_from_catalog(good, have), "path") == [("/base/b.png",)] and manifests.labelled_rows(good, have).count() == 1


GOOD = "model\tm\t1\tcpu\tmit\ttrue\ttrue\tbundled\turl\nimage\ti1\ngt\ti1\t0\t0\t0.5\t0.5\npred\ti1\t0.9\t0\t0\t0.5\t0.5\nidentity\ta\tp\tb\tp\t0.9\n"


def test_face_manifest(spark, tmp_path):
    tables, bad = manifests.face_manifest(spark, write(tmp_path, GOOD))
    assert bad.count() == 0 and {k: t.count() for k, t in tables.items()} == {"model": 1, "image": 1, "gt": 1, "pred": 1, "identity": 1}
    for extra, reason in {
        "image\ti1\n": "image declared twice",
        "gt\tzz\t0\t0\t0.5\t0.5\n": "undeclared image",
        "gt\ti1\t0.9\t0\t0.5\t0.5\n": "box out of range",
        "gt\ti1\tx\t0\t0.5\t0.5\n": "box out of range",
        "pred\ti1\t1.9\t0\t0\t0.5\t0.5\n": "confidence out of range",
        "identity\ta\tp\ta\tp\t0.9\n": "face compared with itself",
        "identity\ta\tq\tc\tp\t0.9\n": "face of several persons",
        "identity\ta\tp\tb\tp\t0.8\n": "pair given twice",
        "identity\ta\tp\td\tp\t1.8\n": "similarity out of range",
        "what\t1\n": "unknown record",
        "image\n": "wrong number of columns",
        GOOD.split("\n")[0] + "\n": "more than one model",
    }.items():
        _, bad = manifests.face_manifest(spark, write(tmp_path, GOOD + extra))
        assert reason in {r.reason for r in bad.collect()}, reason
    _, bad = manifests.face_manifest(spark, write(tmp_path, GOOD.replace("true\ttrue", "true\tfalse")))
    assert [r.reason for r in bad.collect()] == ["restricted model marked bundled"]


def test_runner_manifest_and_folders(spark, tmp_path):
    good = "\t".join(["face", "f", "p", "a.png", *["0.5"] * 10])
    model, found, bad = manifests.runner_manifest(spark, write(tmp_path, "model\tm\tcpu\tmit\t1\t1\tu\n" + good + "\n" + good.replace("0.5", "1.5") + "\nface\tx\n"))
    assert (model.count(), found.count(), bad.count()) == (1, 1, 2)
    files = [("/r1", "/r1/oak/a.png"), ("/r1", "/r1/oak/b.png"), ("/r2", "/r2/Oak/c.png"), ("/r2", "/r2/Oak/d.png"), ("/r1", "/r1/ash/e.png"), ("/r1", "/r1/x.png"), ("/r1", "/r1/elm/s/f.png"), ("/r1", "/r1/elm/g.png")]
    got = manifests.from_folders(spark.createDataFrame(files, "root string, path string"), "")
    assert {r.group for r in got.collect()} == {"r1/oak", "r2/Oak", "elm"} and got.count() == 6


# Streams

EVENT = "library_id string, kind string, path string, ts timestamp"


def event(lib, kind, path, second):
    return (lib, kind, path, __import__("datetime").datetime(2024, 1, 1, 0, 0, 0) + __import__("datetime").timedelta(milliseconds=second))


def test_change_batches(spark, tmp_path):
    data = [event("l", "modify", "b", 0), event("l", "create", "a", 300), event("l", "modify", "b", 600), event("l", "access", "z", 700), event("l", "remove", "c", 2000), event("m", "modify", ".idx/x", 0), event("m", None, "y", 5)]
    df = spark.createDataFrame(data, EVENT)
    got = changes.batches(changes.relevant(df, ".idx"))
    assert {(r.library_id, r.n_events, tuple(r.paths)) for r in got.collect()} == {("l", 3, ("a", "b")), ("l", 1, ("c",)), ("m", 1, ("y",))}
    assert {(r.library_id, r.n_events) for r in changes.debounced_batch_table(changes.relevant(df, ".idx"), "library_id", 0.42).collect()} == {("l", 3), ("l", 1), ("m", 1)}
    folder = str(tmp_path / "in")
    df.union(spark.createDataFrame([event("l", "modify", "late", 3_600_000)], EVENT)).coalesce(1).write.parquet(folder)
    stream = changes.batches(changes.relevant(spark.readStream.schema(df.schema).parquet(folder), ".idx"), delay="1 second")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.library_id, r.n_events) for r in spark.sql("select * from bursts").collect()} == {("l", 3), ("l", 1), ("m", 1)}


def test_stream_into_catalog_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([event("l", "modify", "a", 0)], EVENT).write.parquet(folder)
    applied, state = [], {"done": -1}
    run = changes.once_per_batch(lambda b, i: applied.append((i, b.count())), lambda: state["done"], lambda i: state.update(done=i))
    stream = lambda: changes.stream_into(spark.readStream.schema(EVENT).parquet(folder), str(tmp_path / "cp"), run)
    stream().awaitTermination(60)
    stream().awaitTermination(60)
    spark.createDataFrame([event("l", "modify", "b", 0)], EVENT).write.mode("append").parquet(folder)
    stream().awaitTermination(60)
    assert [n for _, n in applied] == [1, 1]
    run(spark.range(1), 0)
    assert len(applied) == 2


def test_apply_changes_and_latest(spark):
    images = spark.createDataFrame([("E:\\a\\1", 1), ("E:\\A\\2", 1), ("E:\\b", 1), ("E:\\ab", 1)], "path string, size bigint")
    removed = spark.createDataFrame([("E:\\a",), ("e:\\AB",)], "path string")
    changed = spark.createDataFrame([("E:\\b",), ("E:\\n",)], "path string")
    inspected = spark.createDataFrame([("E:\\b", 2), ("E:\\n", 3), ("E:\\other", 4)], "path string, size bigint")
    assert rows(changes.apply_changes(images, changed, removed, inspected)) == [("E:\\ab", 1), ("E:\\b", 2), ("E:\\n", 3)]
    r = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b")], "k string, g int, v string")
    assert rows(changes.latest(r, "k", "g", "v")) == [("u", 3, "c")]
