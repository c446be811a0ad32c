"""Column functions on literal rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vitrail.functions import geometry, hashing, score, text, vector
from vitrail.functions.score import SimilaritySettings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def floats(*values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def null():
    return F.lit(None).cast("double")


def test_hash_similarity(spark):
    assert one(spark, score.hash_similarity(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 0
    assert one(spark, score.hash_similarity(F.lit(5).cast("bigint"), F.lit(5).cast("bigint"))) == 1
    assert one(spark, score.hash_similarity(F.lit(5).cast("bigint"), F.lit(None).cast("bigint"))) is None


def test_histogram(spark):
    assert one(spark, score.histogram_intersection(floats(0.5, 0.5), floats(0.25, 0.75))) == 0.75
    assert one(spark, score.histogram_intersection(floats(1), floats(0.5, 0.5))) == 0
    assert one(spark, score.histogram_intersection(floats(1), F.lit(None).cast("array<float>"))) is None


def test_texture_needs_48(spark):
    a = [1.0] + [0.0] * 7
    full = floats(*(a * 2 + ([1.0] + [0.0] * 15) * 2))
    assert one(spark, score.texture_similarity(full, full)) == 1
    assert one(spark, score.texture_similarity(full, floats(1))) is None


def test_blend(spark):
    f = lambda h, t: one(spark, score.blend_texture_and_hash(null() if h is None else F.lit(h), null() if t is None else F.lit(t)))
    assert f(None, None) is None
    assert f(0.4, None) == 0.4
    assert f(None, 0.3) == 0.3
    assert f(1.0, 0.0) == pytest.approx(0.92)
    assert f(0.5, 1.0) == pytest.approx(0.825)


def test_color(spark):
    c = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    assert one(spark, score.rgb_similarity(c(0, 0, 0), c(255, 255, 255))) == pytest.approx(0)
    assert one(spark, score.rgb_similarity(c(9, 9, 9), c(9, 9, 9))) == 1
    assert one(spark, score.redmean_distance(c(0, 0, 0), c(255, 255, 255))) == pytest.approx(1, abs=2e-3)


def test_gate(spark):
    s = SimilaritySettings()
    f = lambda h, dom, settings=s: one(spark, score.passes_color_gate(null() if h is None else F.lit(h), F.lit(dom), settings))
    assert f(None, 0.9) and f(0.3, 0.71) and not f(0.29, 1.0) and not f(0.9, 0.6)
    assert f(0.0, 0.0, SimilaritySettings(strict_color_rejection=False))


def test_hybrid_drops_weight_of_missing(spark):
    s = SimilaritySettings()
    got = one(spark, score.hybrid_score(null(), F.lit(0.5), null(), F.lit(1.0), s))
    assert got == pytest.approx((31 * 0.5 + 5) / 36)
    assert one(spark, score.hybrid_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), SimilaritySettings(0, 0, 0, 0))) == 0
    assert one(spark, score.hybrid_score(null(), null(), null(), null(), s)) == 0


def test_vector(spark):
    assert one(spark, vector.dot(floats(1, 2), floats(3, 4))) == 11
    assert list(one(spark, vector.normalise(floats(3, 4)))) == pytest.approx([0.6, 0.8])
    assert list(one(spark, vector.normalise(floats(0, 0)))) == [0, 0]
    assert one(spark, vector.cosine_to_unit_query(floats(1, 0), floats(2, 0), F.lit(False))) == 1
    assert one(spark, vector.cosine_to_unit_query(floats(1, 0), floats(1), F.lit(True))) == -1
    assert one(spark, vector.cosine_to_unit_query(floats(1, 0), floats(0, 0), F.lit(False))) == -1
    assert one(spark, vector.is_unit(floats(0.6, 0.8))) and not one(spark, vector.is_unit(floats(1, 1))) and not one(spark, vector.is_unit(floats(math.nan, 1)))
    assert not one(spark, vector.is_unit(F.lit(None).cast("array<float>")))
    for v, error in ((floats(1), "dimension"), (floats(0, 0), "zero"), (floats(math.inf, 1), "not finite"), (F.lit(None).cast("array<float>"), "missing")):
        assert one(spark, vector.strict_normalise(v, 2))["error"] == error


def test_float_codec(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, [])], "id int, v array<float>").withColumn("b", vector.encode_floats("v"))
    back = df.select("id", vector.decode_checked(F.col("b"), F.lit(2), strict=True).alias("v")).orderBy("id").collect()
    assert list(back[0].v) == [1.5, -2.0] and back[1].v is None and back[2].v is None
    broken = spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(vector.decode_floats("b")).first()[0]
    assert broken is None
    assert one(spark, vector.valid_dimension(F.lit(8), F.lit(2))) and not one(spark, vector.valid_dimension(F.lit(8), F.lit(0))) and one(spark, vector.valid_dimension(F.lit(None).cast("int"), F.lit(0)))


def test_text_search_terms(spark):
    df = spark.createDataFrame([("Warm STONE.png", "a 100% wool"), ("grey_cement", None), ("É", "")], "a string, b string")
    f = lambda q: [r.a for r in df.where(text.matches_all_tokens([F.col("a"), F.col("b")], q)).collect()]
    assert f("tone wo") == ["Warm STONE.png"] and f("0%") == ["Warm STONE.png"] and f("y_c") == ["grey_cement"] and f("") == [] and f("  ") == []
    assert f("é") == []  # only A to Z are folded
    assert text.like_pattern("a%b_\\") == "%a\\%b\\_\\\\%" and text.phrase('a"b') == '"a""b"'


def test_markup(spark):
    x = F.lit('<rdf><dc:title a="1">Hi &amp;lt; <b>you</b></dc:title><dc:title> </dc:title><x xmp:Label="L  1"/>')
    assert one(spark, text.elements(x, "dc:title")) == ["Hi < you"]
    assert one(spark, text.attribute(x, "xmp:Label")) == "L 1" and one(spark, text.attribute(x, "none")) is None
    described, keyed = text.packet_text(F.lit("<dc:description>A</dc:description><dc:title>a</dc:title><dc:title>B</dc:title><dc:subject><li>k</li></dc:subject>"))
    assert one(spark, described) == "A | B" and one(spark, keyed) == "k"
    assert one(spark, text.dedup_keep_first(F.array(*map(F.lit, ["b", "A", "a ", " ", "B", "c"])))) == ["b", "A", "c"]
    assert one(spark, text.tag_route(F.lit("XPSubject")))["keywords"] and one(spark, text.tag_route(F.lit("ImageDescription")))["description"]


def test_paths(spark):
    for path, name, ext, ok in (("C:\\a\\b.JPG", "b.JPG", "JPG", True), ("/x/y.tar.png", "y.tar.png", "png", True), ("/x/.png", ".png", "", False), ("noext", "noext", "", False), ("a.gif", "a.gif", "gif", False)):
        p = F.lit(path)
        assert (one(spark, text.file_name(p)), one(spark, text.extension(p)), one(spark, text.is_supported_image(p))) == (name, ext, ok)
    assert one(spark, text.relative_to(F.lit("E:\\a\\b"), F.lit("E:\\a"))) == "b" and one(spark, text.relative_to(F.lit("E:\\ab"), F.lit("E:\\a"))) is None
    assert one(spark, text.absolute_from(F.lit(""), F.lit("E:\\a"))) == "E:\\a" and one(spark, text.absolute_from(F.lit("b"), F.lit("E:\\a"))) == "E:\\a\\b"
    assert one(spark, text.folders_above(F.lit("a/b\\c"))) == ["a", "a/b", "a/b\\c"]
    for p, safe in (("a/b", True), ("../a", False), ("a/../b", False), ("/a", False), ("C:\\a", False), ("a..b", True)):
        assert one(spark, text.is_safe_relative(F.lit(p))) is safe
    assert one(spark, text.is_internal(F.lit(".idx\\a"), ".idx")) and not one(spark, text.is_internal(F.lit("x/.idx"), ".idx"))
    assert one(spark, text.key_folded_trimmed(F.lit("A/b\\\\"))) == "a\\b" and one(spark, text.key_native(F.lit("A/b"))) == "A\\b" and one(spark, text.key_forward(F.lit("A\\b"))) == "a/b"


def test_formats(spark):
    assert one(spark, text.format_bytes(F.lit(512))) == "512 B" and one(spark, text.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, text.truncate_middle(F.lit("abcdefghij"), 5)) == "ab…ij" and one(spark, text.truncate_middle(F.lit("abc"), 5)) == "abc"
    assert one(spark, text.report_key(F.lit("A b/C"))) == "a_b_c"
    assert one(spark, text.failure_class(F.lit("Unexpected EOF"))) == "truncated" and one(spark, text.failure_class(F.lit("what"))) == "other"


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x", "y", "width", "height"))])
    assert one(spark, geometry.iou(box(0, 0, 0.5, 0.5), box(0, 0, 0.5, 0.5))) == 1
    assert one(spark, geometry.iou(box(0, 0, 0.1, 0.1), box(0.5, 0.5, 0.1, 0.1))) == 0
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.iou(box(0, 0, 0.2, 0.2), box(0.1, 0, 0.2, 0.2))) == pytest.approx(1 / 3)
    assert tuple(one(spark, geometry.clamp_box(box(-0.5, 0.5, 1, 1)))) == pytest.approx((0, 0.5, 0.5, 0.5))
    assert one(spark, geometry.valid_box(box(0, 0, 1, 1))) and not one(spark, geometry.valid_box(box(0.5, 0, 0.6, 1))) and not one(spark, geometry.valid_box(box(0, 0, 0, 1)))
    points = F.array(*[F.struct(F.lit(1.0).alias("x"), F.lit(0.5).alias("y"))] * 5)
    assert tuple(one(spark, geometry.landmarks_to_pixels(points, F.lit(101), F.lit(11)))[0]) == (100, 5)
    assert tuple(one(spark, geometry.landmarks_to_pixels(points, F.lit(100), F.lit(10), last_pixel=False))[0]) == (100, 5)
    assert one(spark, geometry.landmarks_to_pixels(F.slice(points, 1, 4), F.lit(10), F.lit(10))) is None


def test_fnv(spark):
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325 and hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    data = [b"", b"a", b"ab", b"abc", None]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(data)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(hashing.fnv1a_binary("b")).collect()]
    assert got == [hashing.signed(hashing.fnv1a(b)) for b in data[:4]] + [None]
    for n in (511, 512, 700, 65_536, 65_537, 140_000):
        long = bytes((k * k + 7 * k + n) % 251 for k in range(n))
        h = 99
        for c in long:
            h = ((h ^ c) * hashing.PRIME) & hashing.MASK
        assert hashing.fnv1a(long, 99) == h
    a, b = (one(spark, hashing.face_id(F.lit(p), F.lit("d"), F.lit("1"), F.lit("r"), F.lit(2), F.lit(0))) for p in ("A\\b.png", "a/B.PNG"))
    assert a == b and len(a) == 21


def test_table_signature(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "i int, v array<float>")
    b = spark.createDataFrame([(2, [2.0]), (1, [1.0])], "i int, v array<float>")
    c = spark.createDataFrame([(2, [2.0]), (1, [1.5])], "i int, v array<float>")
    s = [rows(hashing.table_signature(x, "i", "v")) for x in (a, b, c)]
    assert s[0] == s[1] != s[2]
    assert rows(hashing.table_signature(a.limit(0), "i", "v")) == [(0, 0, 0)]
    x = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [2.0])], "i int, v array<float>")
    y = spark.createDataFrame([(7, [7.0]), (7, [7.0]), (2, [2.0])], "i int, v array<float>")
    assert rows(hashing.table_signature(x, "i", "v")) != rows(hashing.table_signature(y, "i", "v"))
    assert rows(hashing.table_signature(x.union(x), "i", "v")) != rows(hashing.table_signature(y.union(y), "i", "v"))


FAILURES = {
    "Format error decoding Jpeg: bad marker": "invalid_jpeg",
    "Format error decoding Jpeg: Error parsing image. Illegal start bytes:3842": "invalid_jpeg",
    "a JPEG with a format error": "invalid_jpeg",
    "unexpected end of file": "truncated",
    "unexpected end": "truncated",
    "Unexpected EOF": "truncated",
    "the image is truncated and unsupported": "truncated",
    "unsupported color": "unsupported",
    "Permission denied (13)": "access",
    "Access is denied.": "access",
    "something else": "other",
}


def test_failure_classes(spark):
    df = spark.createDataFrame(list(FAILURES.items()), "m string, c string")
    assert df.where(text.failure_class(F.col("m")) != F.col("c")).collect() == []
    assert one(spark, text.failure_class(F.lit(None).cast("string"))) == "other"


def test_vectors_that_must_fit(spark):
    good = spark.createDataFrame([(bytearray(b"\0\0\x80?"), 1), (None, 0)], "b binary, n int")
    assert {r[0] and tuple(r[0]) for r in good.select(vector.decode_or_fail(F.col("b"), F.col("n"))).collect()} == {(1.0,), None}
    with pytest.raises(Exception, match="corrupt"):
        rows(spark.createDataFrame([(bytearray(b"\0\0\x80"), 1)], "b binary, n int").select(vector.decode_or_fail(F.col("b"), F.col("n"))))
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert rows(pair.select(vector.unit_cosine(F.col("a"), F.col("b")))) == [(1.0,)]
    for a, b in (([1.0], [1.0, 0.0]), ([], []), ([float("nan")], [1.0])):
        with pytest.raises(Exception, match="vectors must be"):
            rows(spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(vector.unit_cosine(F.col("a"), F.col("b"))))


def test_ratio(spark):
    assert one(spark, score.ratio(F.lit(1), F.lit(0))) == 0 and one(spark, score.f1(F.lit(0.0), F.lit(0.0))) == 0 and one(spark, score.f1(F.lit(1.0), F.lit(1.0))) == 1
    assert np.isclose(one(spark, score.ratio(F.lit(1), F.lit(4))), 0.25)
