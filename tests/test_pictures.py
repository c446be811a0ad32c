"""JPEG and TIFF files decoded in the JVM, inspected like others."""

import numpy as np

from vitrail.operators import features
from vitrail.sources import pictures


def write(spark, picture, path, kind):
    """The picture as the JVM's image library writes it."""
    jvm = spark.sparkContext._jvm
    h, w = picture.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, picture[y, x])
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


def test_jpeg_tiff_and_broken_files(spark, tmp_path):
    picture = np.zeros((12, 20, 3), np.uint8)
    picture[:, :10] = (200, 40, 40)
    picture[:, 10:] = (30, 60, 220)
    for name, kind in (("a.jpg", "jpg"), ("b.tif", "tiff"), ("c.png", "png")):
        write(spark, picture, tmp_path / name, kind)
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8\xff not a picture")
    sideways = spark.createDataFrame([(str(tmp_path / "b.tif"), 6)], "path string, orientation int")
    rows = {r.path.rsplit("/", 1)[1]: r for r in features.inspect(pictures.read_pictures(spark, str(tmp_path), sideways)).collect()}
    assert set(rows) == {"a.jpg", "b.tif", "c.png", "broken.jpg"}
    assert (rows["a.jpg"].width, rows["a.jpg"].height, rows["b.tif"].width, rows["b.tif"].height) == (20, 12, 12, 20)
    assert rows["broken.jpg"].error and rows["broken.jpg"].width is None and rows["a.jpg"].error is None
    got = {r.path.rsplit("/", 1)[1]: features.decode(bytes(r.content)) for r in pictures.read_pictures(spark, str(tmp_path)).collect() if r.content}
    assert np.array_equal(got["b.tif"], picture) and np.array_equal(got["c.png"], picture)
    assert np.abs(got["a.jpg"].astype(int) - picture).mean() < 12
    assert rows["c.png"].content_fingerprint == features.content_fingerprint(picture)


def test_gray_and_alpha_pixels():
    gray = b"PIXELS 1 2 1 1\n" + bytes([7, 9])
    assert features.decode(gray).tolist() == [[[7, 7, 7], [9, 9, 9]]]
    alpha = b"PIXELS 1 1 4 1\n" + bytes([1, 2, 3, 200])
    assert features.decode(alpha).tolist() == [[[3, 2, 1, 200]]]
