"""Features of decoded pictures, as numpy kernels and as operators over tables of pictures.

A picture is an array of height x width x 3 or 4 bytes, RGB(A). Sizes are changed by area-weighted means, so descriptors agree with
others made from the same picture by another resampler only nearly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.functions import hashing

# Fixed values.
THUMBNAIL, MIN_ALPHA, SCALES, TEXTURE_DIM = 128, 24, (96, 48), 48
CROP_MARGIN, BOX_SHARE = 0.18, 0.75
#: The five points of an aligned face of 112 x 112 pixels.
ALIGNED_POINTS = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
ALIGNED_SIZE = 112
STRIDES, MIN_SCORE = (8, 16, 32), 0.6


def _weights(old: int, new: int) -> np.ndarray:
    """new x old matrix of the share of each old cell in each new one."""
    edges = np.linspace(0, old, new + 1)
    cells = np.arange(old)
    cover = np.minimum(edges[1:, None], cells[None, :] + 1) - np.maximum(edges[:-1, None], cells[None, :])
    cover = np.maximum(cover, 0)
    return cover / cover.sum(1, keepdims=True)


def resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    x = picture.astype(np.float64)
    x = np.tensordot(_weights(x.shape[0], height), x, axes=(1, 0))
    return np.moveaxis(np.tensordot(_weights(x.shape[1], width), x, axes=(1, 1)), 0, 1)


def thumbnail(picture: np.ndarray, most: int = THUMBNAIL) -> np.ndarray:
    h, w = picture.shape[:2]
    scale = min(1.0, most / max(h, w))
    return picture if scale == 1.0 else np.rint(resize(picture, max(1, round(h * scale)), max(1, round(w * scale)))).astype(np.uint8)


def luma(picture: np.ndarray) -> np.ndarray:
    """Brightness in bytes."""
    return np.rint(picture[..., :3].astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])).astype(np.uint8)


def dominant_color(picture: np.ndarray) -> tuple[int, int, int]:
    """Mean colour, cut to whole numbers, of the fullest of 8 x 8 x 8 bins; of equal bins the last; black without opaque pixels."""
    rgb = _opaque(thumbnail(picture))
    if not len(rgb):
        return 0, 0, 0
    bins = (rgb[:, 0] >> 5) * 64 + (rgb[:, 1] >> 5) * 8 + (rgb[:, 2] >> 5)
    counts = np.bincount(bins, minlength=512)
    best = 511 - int(np.argmax(counts[::-1]))
    return tuple(int(v) for v in rgb[bins == best].sum(0) // counts[best])


def _opaque(picture: np.ndarray) -> np.ndarray:
    flat = picture.reshape(-1, picture.shape[-1]).astype(np.int64)
    return flat[flat[:, 3] >= MIN_ALPHA][:, :3] if flat.shape[1] == 4 else flat


def color_histogram(picture: np.ndarray) -> np.ndarray:
    """Shares of 4 x 4 x 4 colour bins; zeros without opaque pixels."""
    rgb = _opaque(thumbnail(picture))
    counts = np.bincount((rgb[:, 0] >> 6) * 16 + (rgb[:, 1] >> 6) * 4 + (rgb[:, 2] >> 6), minlength=64).astype(np.float32)
    return counts / max(1, len(rgb))


def difference_hash(picture: np.ndarray) -> int:
    """64 bits, row by row from the lowest: whether a pixel of the 9 x 8 brightness is brighter than its right neighbour. Signed."""
    gray = luma(np.rint(resize(picture[..., :3], 8, 9)))
    bits = (gray[:, :-1] > gray[:, 1:]).ravel()
    return hashing.signed(int(sum(1 << k for k in np.flatnonzero(bits).tolist())))


def _share(h: np.ndarray) -> np.ndarray:
    total = h.sum()
    return (h / total if total > 0 else h).astype(np.float32)


def gradient_histogram(gray: np.ndarray, bins: int = 8) -> np.ndarray:
    """Directions of the gradient without sign, weighted by its size; zeros for pictures under 3 x 3."""
    if min(gray.shape) < 3:
        return np.zeros(bins, np.float32)
    g = gray.astype(np.float64)
    gx, gy = g[1:-1, 2:] - g[1:-1, :-2], g[2:, 1:-1] - g[:-2, 1:-1]
    size = np.hypot(gx, gy)
    angle = np.mod(np.arctan2(gy, gx), np.pi)
    bin_of = np.minimum((angle / np.pi * bins).astype(int), bins - 1)
    return _share(np.bincount(bin_of.ravel(), weights=size.ravel(), minlength=bins))


def pattern_histogram(gray: np.ndarray, bins: int = 16) -> np.ndarray:
    """Local binary patterns, least of their eight rotations, in 16 bins; zeros for pictures under 3 x 3."""
    if min(gray.shape) < 3:
        return np.zeros(bins, np.float32)
    h, w = gray.shape
    centre = gray[1:-1, 1:-1]
    code = np.zeros(centre.shape, np.int64)
    around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]  # (row, column), clockwise from the corner
    for bit, (dy, dx) in enumerate(around):
        code |= (gray[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] >= centre).astype(np.int64) << bit
    least = np.min([(code >> r | code << (8 - r)) & 255 for r in range(8)], axis=0)
    return _share(np.bincount((least >> 4).ravel(), minlength=bins).astype(np.float64))


def texture(picture: np.ndarray) -> np.ndarray:
    """48 values: gradients at both scales, then patterns at both scales; each part sums to 1, or is 0."""
    grays = [luma(np.rint(resize(picture[..., :3], s, s))) for s in SCALES]
    return np.concatenate([gradient_histogram(g) for g in grays] + [pattern_histogram(g) for g in grays])


def content_fingerprint(picture: np.ndarray) -> int:
    """FNV-1a of width and height (32 bits each, low byte first) and the pixels. Signed."""
    h, w = picture.shape[:2]
    return hashing.signed(hashing.fnv1a(picture.tobytes(), hashing.fnv1a(struct.pack("<II", w, h))))


def orient(picture: np.ndarray, orientation: int) -> np.ndarray:
    """The picture upright, by its stored orientation 1 to 8; others leave it as it is."""
    turned = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: p.swapaxes(0, 1)[:, ::-1], 7: lambda p: p.swapaxes(0, 1)[::-1, ::-1], 8: lambda p: p.swapaxes(0, 1)[::-1]}
    return np.ascontiguousarray(turned.get(orientation, lambda p: p)(picture))


def variants(picture: np.ndarray) -> dict[str, np.ndarray]:
    """Query pictures for robustness tests: a crop of the middle, one off the middle, and half the size."""
    h, w = picture.shape[:2]

    def crop(share: float, right: float, down: float) -> np.ndarray:
        ch, cw = max(1, int(h * share)), max(1, int(w * share))
        y, x = int((h - ch) * down), int((w - cw) * right)
        return picture[y : y + ch, x : x + cw]

    return {"centre_crop": crop(0.80, 0.5, 0.5), "offset_crop": crop(0.70, 0.85, 0.20), "half_size": np.rint(resize(picture, max(1, h // 2), max(1, w // 2))).astype(np.uint8)}


def decode_png(data: bytes) -> np.ndarray:
    """8-bit PNG, not interlaced: grey, RGB, palette, with or without alpha. Raises ValueError for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("unsupported format")
    at, packed, palette, alpha = 8, [], None, None
    width = height = kind = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise ValueError("truncated")
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                raise ValueError("unsupported format")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if not channels or not packed:
        raise ValueError("unsupported format")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as x:
        raise ValueError("truncated") from x
    stride = width * channels
    if len(raw) < height * (stride + 1):
        raise ValueError("truncated")
    lines = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(height):
        out[y] = _unfilter(lines[y, 0], lines[y, 1:].astype(np.int64), above, channels)
        above = out[y].astype(np.int64)
    p = out.reshape(height, width, channels)
    if kind == 3:
        rgb = palette[p[..., 0]]
        if alpha is None:
            return rgb
        full = np.full(256, 255, np.uint8)
        full[: len(alpha)] = alpha
        return np.dstack([rgb, full[p[..., 0]]])
    return p if channels >= 3 else np.dstack([p[..., :1]] * 3 + ([p[..., 1:]] if channels == 2 else []))


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
    out = np.zeros(len(line), np.int64)
    for x in range(len(line)):
        left, up, corner = (out[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            estimate = left + up - corner
            guess = min(((abs(estimate - left), 0, left), (abs(estimate - up), 1, up), (abs(estimate - corner), 2, corner)))[2]
        out[x] = (line[x] + guess) & 255
    return out


def encode_png(picture: np.ndarray) -> bytes:
    h, w = picture.shape[:2]
    kind = {3: 2, 4: 6}[picture.shape[2]]
    raw = b"".join(b"\0" + picture[y].tobytes() for y in range(h))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_pixels(content: bytes) -> np.ndarray:
    """The upright picture of a content of ``sources.pictures``: blue, green and red (and alpha) or gray bytes after a line that tells their number."""
    end = content.index(b"\n")
    height, width, channels, orientation = map(int, content[:end].split()[1:])
    p = np.frombuffer(content, np.uint8, height * width * channels, end + 1).reshape(height, width, channels)
    p = np.repeat(p, 3, axis=2) if channels == 1 else np.concatenate([p[..., 2::-1], p[..., 3:]], axis=2)
    return orient(p, orientation)


def decode(content: bytes) -> np.ndarray:
    """A picture decoded by the JVM, or a PNG."""
    if not content:
        raise ValueError("unsupported or truncated image")
    return decode_pixels(content) if content.startswith(b"PIXELS ") else decode_png(content)


INSPECTED = "path string, width int, height int, dominant struct<r:int,g:int,b:int>, visual_hash bigint, color_histogram array<float>, material_texture array<float>, content_fingerprint bigint, error string"


def inspect(files: DataFrame, decode: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, width, height, descriptors..., error) of files (path, content). A file that can't be decoded has only its path and error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    p = decode(bytes(content))
                    r, g, b = dominant_color(p)
                    rows.append((path, p.shape[1], p.shape[0], {"r": r, "g": g, "b": b}, difference_hash(p), color_histogram(p), texture(p), content_fingerprint(p), None))
                except Exception as x:  # noqa: BLE001 - one bad file mustn't end the others
                    rows.append((path, None, None, None, None, None, None, None, str(x) or type(x).__name__))
            columns = list(zip(*rows)) or [[]] * 9
            names = ["path", "width", "height", "dominant", "visual_hash", "color_histogram", "material_texture", "content_fingerprint", "error"]
            whole = {"width": "Int32", "height": "Int32", "visual_hash": "Int64", "content_fingerprint": "Int64"}
            # Each column by its own type: numbers of 64 bits beside nulls would become floats.
            yield pd.DataFrame({n: pd.array(list(c), whole[n]) if n in whole else pd.Series(list(c), dtype=object) for n, c in zip(names, columns)})

    return files.select("path", "content").mapInPandas(run, INSPECTED)


def embed(files: DataFrame, make_model: Callable[[], Callable[[list[bytes]], list]], dimension: int, batch_size: int = 16) -> DataFrame:
    """(path, embedding, error) by a model that each worker makes once; vectors are scaled to length 1. A failing batch is an error of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            for s in range(0, len(batch), batch_size):
                part = batch.iloc[s : s + batch_size]
                try:
                    got = model([bytes(c) for c in part["content"]])
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} pictures")
                    rows = []
                    for path, v in zip(part["path"], got):
                        v = np.asarray(v, np.float64)
                        n = np.linalg.norm(v)
                        good = len(v) == dimension and np.isfinite(v).all() and n > 1e-7
                        rows.append((path, (v / n).astype(np.float32) if good else None, None if good else "invalid vector"))
                except Exception as x:  # noqa: BLE001
                    rows = [(path, None, str(x) or type(x).__name__) for path in part["path"]]
                yield pd.DataFrame(rows, columns=["path", "embedding", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, embedding array<float>, error string")


# Faces


def detector_input(picture: np.ndarray) -> np.ndarray:
    """Planes in the order blue, green, red, padded with zeros at the right and bottom to multiples of 32."""
    h, w = picture.shape[:2]
    out = np.zeros((3, -(-h // 32) * 32, -(-w // 32) * 32), np.float32)
    out[:, :h, :w] = picture[..., 2::-1].transpose(2, 0, 1)
    return out


def decode_detections(outputs: dict[int, dict[str, np.ndarray]], padded: tuple[int, int], size: tuple[int, int], least: float = MIN_SCORE) -> list[dict]:
    """Faces of a detector's outputs by stride (cls, obj, bbox, kps), in shares of the picture's size, before suppression."""
    h, w = size
    found = []
    for stride, out in outputs.items():
        rows, columns = padded[0] // stride, padded[1] // stride
        s = np.sqrt(np.clip(out["cls"].ravel(), 0, 1) * np.clip(out["obj"].ravel(), 0, 1))
        for k in np.flatnonzero(s >= least):
            y, x = divmod(int(k), columns)
            if y >= rows:
                continue
            b = out["bbox"].reshape(-1, 4)[k]
            cx, cy, bw, bh = (x + b[0]) * stride, (y + b[1]) * stride, np.exp(b[2]) * stride, np.exp(b[3]) * stride
            points = out["kps"].reshape(-1, 5, 2)[k]
            marks = [((x + p[0]) * stride / max(w - 1, 1), (y + p[1]) * stride / max(h - 1, 1)) for p in points]
            found.append({"score": float(s[k]), "x": (cx - bw / 2) / w, "y": (cy - bh / 2) / h, "width": bw / w, "height": bh / h, "landmarks": marks})
    return found


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of the rotation, scale and shift that bring source points nearest to the target points."""
    sc, tc = source - source.mean(0), target - target.mean(0)
    power = (sc**2).sum()
    if power < 1e-12:
        raise ValueError("points coincide")
    a = (sc * tc).sum() / power
    b = (sc[:, 0] * tc[:, 1] - sc[:, 1] * tc[:, 0]).sum() / power
    m = np.array([[a, -b], [b, a]])
    return np.column_stack([m, target.mean(0) - m @ source.mean(0)])


def align_face(picture: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The face turned upright in 112 x 112 pixels, bilinear; black outside the picture. ``points``: five, in pixels."""
    m = similarity_transform(np.asarray(points, float), ALIGNED_POINTS)
    back = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    y, x = np.mgrid[0:ALIGNED_SIZE, 0:ALIGNED_SIZE]
    sx, sy, _ = back @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    h, w = picture.shape[:2]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((x.size, 3))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            weight = (1 - np.abs(sx - xi)) * (1 - np.abs(sy - yi))
            inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            out[inside] += weight[inside, None] * picture[yi[inside], xi[inside], :3]
    return np.rint(out).astype(np.uint8).reshape(ALIGNED_SIZE, ALIGNED_SIZE, 3)


def crop_face(picture: np.ndarray, box: tuple[float, float, float, float], landmarks: list[tuple[float, float]]) -> np.ndarray:
    """A square around a face: 18 per cent margin; the centre three parts box, one part mean of the landmarks."""
    h, w = picture.shape[:2]
    x, y, bw, bh = box
    cx, cy = x + bw / 2, y + bh / 2
    if landmarks:
        mx, my = np.mean(np.asarray(landmarks, float), axis=0)
        cx, cy = BOX_SHARE * cx + (1 - BOX_SHARE) * mx, BOX_SHARE * cy + (1 - BOX_SHARE) * my
    half = max(bw * w, bh * h) * (1 + 2 * CROP_MARGIN) / 2
    left, right = int(max(0, np.floor(cx * w - half))), int(min(w, np.ceil(cx * w + half)))
    top, bottom = int(max(0, np.floor(cy * h - half))), int(min(h, np.ceil(cy * h + half)))
    if right <= left or bottom <= top:
        raise ValueError("empty crop")
    return picture[top:bottom, left:right]


def embedder_input(aligned: np.ndarray) -> np.ndarray:
    """Planes in the order red, green, blue, not scaled."""
    return aligned.transpose(2, 0, 1).astype(np.float32)


def detect(files: DataFrame, make_detector: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """(image_path, confidence, bbox, landmarks, error) of files (path, content) by a detector that each worker makes once.

    A detector returns dicts of confidence, x, y, width, height and landmarks. An image without faces has no row; one that fails has one row with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    for f in detector(bytes(content)):
                        marks = [{"x": float(a), "y": float(b)} for a, b in f.get("landmarks", [])]
                        rows.append((path, float(f["confidence"]), {k: float(f[k]) for k in ("x", "y", "width", "height")}, marks, None))
                except Exception as x:  # noqa: BLE001
                    rows.append((path, None, None, None, str(x) or type(x).__name__))
            yield pd.DataFrame(rows, columns=["image_path", "confidence", "bbox", "landmarks", "error"])

    schema = "image_path string, confidence float, bbox struct<x:float,y:float,width:float,height:float>, landmarks array<struct<x:float,y:float>>, error string"
    return files.select("path", "content").mapInPandas(run, schema)


def supported_files(listing: DataFrame, decode_failures: bool = False) -> DataFrame:
    """Rows of a listing whose extension is supported."""
    from vitrail.functions.text import is_supported_image

    return listing.where(is_supported_image(F.col("path")))
