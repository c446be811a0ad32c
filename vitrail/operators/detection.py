"""Detected boxes against true ones, and suppression of overlapping boxes. Both are greedy, so they run image by image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.functions import score

MIN_IOU = 0.5
# Fixed values of the detector's post-processing.
NMS_IOU, NMS_TOP = 0.3, 5000
_MATCH = "image_id string, kind string, matched boolean, area double"


def _iou(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    low = np.maximum(box[:2], others[:, :2])
    high = np.minimum(box[:2] + box[2:], others[:, :2] + others[:, 2:])
    shared = np.prod(np.maximum(high - low, 0), axis=1)
    union = max(box[2], 0) * max(box[3], 0) + np.prod(np.maximum(others[:, 2:], 0), axis=1) - shared
    return np.divide(shared, union, out=np.zeros(len(others)), where=union > 0)


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come sorted by ``key``, in frames of whole groups, with the limits of the groups."""
    held: list[pd.DataFrame] = []

    def frame(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        out = pd.concat(parts, ignore_index=True)
        k = out[key].to_numpy()
        return out, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        last = int(np.argmax(k == k[-1]))  # where the last group begins
        if last:
            yield frame([*held, batch.iloc[:last]])
            held = [batch.iloc[last:]]
        elif held and held[-1][key].iloc[-1] != k[0]:
            yield frame(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield frame(held)


def match_boxes(predictions: np.ndarray, truth: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which predictions, in their order, take a free true box of greatest overlap, and which true boxes are taken."""
    taken = np.zeros(len(truth), bool)
    hit = np.zeros(len(predictions), bool)
    if len(truth):
        for k, box in enumerate(predictions):
            overlap = np.where(taken, -1.0, _iou(box, truth))
            best = int(np.argmax(overlap))
            if overlap[best] >= max(least, 0):
                hit[k] = taken[best] = True
    return hit, taken


def match(boxes: DataFrame, least: float = MIN_IOU) -> DataFrame:
    """(image_id, kind, matched, area) of each box of ``boxes`` (image_id, kind gt or pred, confidence, x, y, width, height).

    Predictions of an image go by falling confidence, then x and y. Boxes with a null image don't count. Images spread by hash; the boxes of one image, which
    must be matched one after another, are in one task.
    """
    names = ["x", "y", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, limits in whole_groups(batches, "image_id"):
            box = rows[names].to_numpy(float)
            is_truth = (rows["kind"] == "gt").to_numpy()
            matched = np.zeros(len(rows), bool)
            for a, b in zip(limits[:-1], limits[1:]):
                if b - a > 1:  # a box alone has nothing to match
                    t = a + int(is_truth[a:b].sum())  # true boxes come first
                    matched[t:b], matched[a:t] = match_boxes(box[t:b], box[a:t], least)
            area = np.where(is_truth, np.prod(np.maximum(box[:, 2:], 0), axis=1), 0.0)
            yield pd.DataFrame({"image_id": rows["image_id"], "kind": rows["kind"], "matched": matched, "area": area})

    rows = boxes.where(F.col("image_id").isNotNull() & F.col("kind").isin("gt", "pred")).select("image_id", "kind", "confidence", *names)
    return rows.repartition("image_id").sortWithinPartitions("image_id", "kind", F.col("confidence").desc(), *names).mapInPandas(run, _MATCH)


def detection_metrics(images: DataFrame, boxes: DataFrame, least: float = MIN_IOU) -> DataFrame:
    """One row: counts, precision, recall, F1, images without faces that got one, and recall by size of the true box."""
    m = match(boxes, least)
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name)
    pred, gt, hit = F.col("kind") == "pred", F.col("kind") == "gt", F.col("matched")
    sizes = {"tiny": F.col("area") <= 0.01, "small": (F.col("area") > 0.01) & (F.col("area") <= 0.04), "large": F.col("area") > 0.04}
    buckets = [x for name, c in sizes.items() for x in (n(gt & c, f"{name}_faces"), n(gt & c & hit, f"{name}_found"))]
    totals = m.agg(n(pred & hit, "tp"), n(pred & ~hit, "fp"), n(gt & ~hit, "fn"), *buckets)
    per = boxes.groupBy("image_id").agg(n(gt, "_gt"), n(pred, "_pred"))
    empty = images.select("image_id").distinct().join(per, "image_id", "left")
    none = F.coalesce("_gt", F.lit(0)) == 0
    plain = empty.agg(F.count(F.lit(1)).alias("images"), n(none, "no_face_images"), n(none & (F.coalesce("_pred", F.lit(0)) > 0), "no_face_images_with_fp"))
    precision, recall = score.ratio(F.col("tp"), F.col("tp") + F.col("fp")), score.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rounded = [F.round(c, 6).alias(name) for c, name in ((precision, "precision"), (recall, "recall"), (score.f1(precision, recall), "f1"))]
    by_size = [F.round(score.ratio(F.col(f"{s}_found"), F.col(f"{s}_faces")), 6).alias(f"{s}_recall") for s in sizes]
    return plain.join(F.broadcast(totals), F.lit(True)).select("images", "tp", "fp", "fn", *rounded, "no_face_images", "no_face_images_with_fp", *by_size)


def suppress_image(boxes: np.ndarray, scores: np.ndarray, most_iou: float = NMS_IOU, top: int = NMS_TOP) -> np.ndarray:
    """Places of the boxes that stay, by falling score: a box goes if it overlaps a kept one by more than ``most_iou``."""
    order = np.argsort(-scores, kind="stable")[:top]
    kept = []
    while len(order):
        first, order = order[0], order[1:]
        kept.append(first)
        order = order[_iou(boxes[first], boxes[order]) <= most_iou]
    return np.array(kept, int)


def suppress(boxes: DataFrame, most_iou: float = NMS_IOU, top: int = NMS_TOP) -> DataFrame:
    """The boxes (image_id, score, x, y, width, height) that stay in each image; rows with a null image don't count."""
    names = ["x", "y", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, limits in whole_groups(batches, "image_id"):
            box, value = rows[names].to_numpy(float), rows["score"].to_numpy(float)
            keep = [np.array([a]) if b - a == 1 else a + suppress_image(box[a:b], value[a:b], most_iou, top) for a, b in zip(limits[:-1], limits[1:])]
            yield rows.iloc[np.concatenate(keep)]

    slim = boxes.where(F.col("image_id").isNotNull()).select("image_id", "score", *names)
    return slim.repartition("image_id").sortWithinPartitions("image_id", F.col("score").desc(), *names).mapInPandas(run, slim.schema)
