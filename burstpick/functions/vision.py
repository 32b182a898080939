"""Vision: regions, boxes, landmarks as column expressions, and pixel work in vectorised functions.

A detection is ``struct<cx, cy, w, h, confidence>`` (centre form, model pixels), a box ``struct<x, y, width, height>``
(top left form, original pixels). Columns are double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.functions import geometry, imaging
from burstpick.functions.geometry import MIN_SIDE

#: Face-mesh points of each eye: outer corner, two above, inner corner, two below.
RIGHT_EYE = (33, 159, 158, 133, 153, 145)
LEFT_EYE = (362, 380, 374, 263, 386, 385)
MESH_POINTS = 468
#: Bytes of results that a batch of pixel functions holds before it goes on.
HELD = 4 << 20
#: What a letterbox tells of itself.
TRANSFORM = ("scale", "pad_x", "pad_y", "orig_width", "orig_height")

FOCUS = "sharpness_score double, raw_variance double, noise_estimate double, scored_region string, phash long"


def _region(x, y, w, h) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"))


def center_region(w: Column, h: Column) -> Column:
    """The middle half; null where a side of it is under 16 pixels."""
    half = lambda c, by: F.floor(c / by)
    return F.when(F.least(half(w, 2), half(h, 2)) >= MIN_SIDE, _region(half(w, 4), half(h, 4), half(w, 2), half(h, 2)))


def eye_region(box: Column, w: Column, h: Column) -> Column:
    """The upper 40 % of the face box without a tenth at each side, in the image; null where it is under 16 pixels."""
    x, y, across, down = geometry.eye_sides(box, w.cast("double"), h.cast("double"), geometry.COLUMNS)
    return F.when(F.least(across, down) >= MIN_SIDE, _region(x, y, across, down))


def face_crop(box: Column, w: Column, h: Column) -> Column:
    """The face box with a quarter more at each side, in the image, at least one pixel."""
    return _region(*geometry.crop_sides(box, w.cast("double"), h.cast("double"), geometry.COLUMNS))


def decode_yolo(output: Column, values: int, columns: int, min_confidence: float) -> Column:
    """Detections of a channel-major output of ``values`` rows, the most confident first; ties in column order. With one
    class its score is the confidence, else the largest class score, at least 0. Without a class row: none."""
    if values < 5 or columns < 1:
        return F.filter(F.array(_detection(*[F.lit(0.0)] * 5)), lambda d: F.lit(False))
    at = lambda row, i: F.get(output, row * columns + i).cast("double")
    best = lambda i: at(4, i) if values == 5 else F.greatest(F.lit(0.0), *[at(r, i) for r in range(4, values)], F.lit(0.0))
    ranked = F.transform(
        F.sequence(F.lit(0), F.lit(columns - 1)),
        lambda i: F.struct((-best(i)).alias("k"), i.alias("i"), _detection(at(0, i), at(1, i), at(2, i), at(3, i), best(i)).alias("d")),
    )
    kept = F.filter(ranked, lambda r: r["d"]["confidence"] >= min_confidence)
    return F.transform(F.sort_array(kept), lambda r: r["d"])


def _detection(cx, cy, w, h, confidence) -> Column:
    return F.struct(cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), confidence.alias("confidence"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two detections; 0 where the union is not positive."""
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2))
    shared = side("cx", "w") * side("cy", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union <= 0, F.lit(0.0)).otherwise(shared / union)


def non_max_suppression(detections: Column, threshold: float = 0.45) -> Column:
    """Of detections in order of confidence, those that overlap no kept one by more than ``threshold``."""
    none = F.filter(detections, lambda d: F.lit(False))
    return F.aggregate(
        detections, none,
        lambda kept, d: F.when(F.exists(kept, lambda k: iou(k, d) > threshold), kept).otherwise(F.concat(kept, F.array(d))),
    )


def to_original_coords(d: Column, t: Column) -> Column:
    """A detection's box in the original image; ``t``: struct of scale, pad_x, pad_y, orig_width, orig_height."""
    sides = geometry.original_sides(d, t, geometry.COLUMNS)
    return F.struct(*[c.alias(n) for c, n in zip(sides, ("x", "y", "width", "height"), strict=True)])


def letterbox_transform(w: Column, h: Column, to_w: int = 640, to_h: int = 640) -> Column:
    scale = F.least(F.lit(float(to_w)) / w, F.lit(float(to_h)) / h)
    pad = lambda to, side: F.floor((to - F.floor(side * scale + 0.5)) / 2).cast("double")
    return F.struct(
        scale.alias("scale"), pad(to_w, w).alias("pad_x"), pad(to_h, h).alias("pad_y"),
        w.cast("double").alias("orig_width"), h.cast("double").alias("orig_height"),
    )


def primary_face(detections: Column) -> Column:
    return F.try_element_at(detections, F.lit(1))


def landmark_stride(raw: Column) -> Column:
    """Numbers a landmark takes: 3, or 2 for a shorter output; null where there are fewer than 468 landmarks."""
    return F.when(F.size(raw) >= 3 * MESH_POINTS, 3).when(F.size(raw) >= 2 * MESH_POINTS, 2)


def landmarks(raw: Column) -> Column:
    """``array<struct<x, y>>``, empty where there are too few."""
    stride = landmark_stride(raw)
    n = F.coalesce(F.floor(F.size(raw) / stride), F.lit(0)).cast("int")
    point = lambda i: F.struct(F.get(raw, i * stride).cast("double").alias("x"), F.get(raw, i * stride + 1).cast("double").alias("y"))
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n), point)


def eye_aspect_ratio(raw: Column, eye: tuple[int, ...]) -> Column:
    """Mean height of the eye over its width; 1.0 where the width vanishes or the landmarks are missing."""
    stride = landmark_stride(raw)
    at = lambda p, c: F.get(raw, F.lit(eye[p]) * stride + c).cast("double")
    distance = lambda p, q: F.sqrt(F.pow(at(p, 0) - at(q, 0), 2) + F.pow(at(p, 1) - at(q, 1), 2))
    across = distance(0, 3)
    ratio = (distance(1, 5) + distance(2, 4)) / (2 * across)
    return F.when(stride.isNull() | (across < 1e-6), F.lit(1.0)).otherwise(F.coalesce(ratio, F.lit(1.0)))


def detect_blink(raw: Column, threshold: float = 0.21) -> Column:
    """Both eyes below the threshold."""
    right, left = eye_aspect_ratio(raw, RIGHT_EYE), eye_aspect_ratio(raw, LEFT_EYE)
    return F.struct(
        ((right < threshold) & (left < threshold)).alias("blink_detected"), right.alias("right_ear"), left.alias("left_ear"),
        ((right + left) / 2).alias("average_ear"),
    )


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """``image_id, image`` of the files ``{id}.jpg`` of a folder; one that cannot be decoded is kept (width -1)."""
    found = spark.read.format("image").option("dropInvalid", False).load(folder)
    name = F.regexp_extract("image.origin", r"([0-9]+)\.[^/]*$", 1)
    return found.select(name.try_cast("long").alias("image_id"), "image")


def pixels(image: Mapping) -> np.ndarray | None:
    """RGB pixels of a row of the image source (its bytes are blue first); None where it was not decoded."""
    h, w, n = image["height"], image["width"], image["nChannels"]
    if not image["data"] or not h or not w or h < 1 or w < 1:
        return None
    img = np.frombuffer(image["data"], np.uint8).reshape(h, w, n)
    return np.repeat(img, 3, axis=2) if n == 1 else img[..., 2::-1]


def _rows(images: pd.DataFrame) -> Iterator[dict]:
    """The rows of a column of images, one by one."""
    parts = (images[c] for c in ("height", "width", "nChannels", "data"))
    return ({"height": int(h), "width": int(w), "nChannels": int(n), "data": d} if d is not None else {"height": 0, "width": 0, "nChannels": 0, "data": None} for h, w, n, d in zip(*parts, strict=True))


def _arrow_rows(images: pa.StructArray) -> Iterator[dict]:
    """The same of a column in Arrow; the bytes are not copied."""
    parts = dict(zip((f.name for f in images.type), images.flatten(), strict=True))
    sides = (parts[c].to_pylist() for c in ("height", "width", "nChannels"))
    return ({"height": h, "width": w, "nChannels": n, "data": d.as_buffer()} for h, w, n, d in zip(*sides, parts["data"], strict=True))


def of_batches(of_pixels: Callable[[np.ndarray], object], kind: pa.DataType, batches: Iterable[pa.StructArray]) -> Iterator[pa.Array]:
    """The results of batches of images, in batches of their own that end at HELD bytes: a tensor is several times its photo."""
    for images in batches:
        held, size = [], 0
        for rgb in map(pixels, _arrow_rows(images)):
            held.append(None if rgb is None else of_pixels(rgb))
            size += getattr(held[-1], "nbytes", 0) or (len(held[-1]) if isinstance(held[-1], bytes) else 8)
            if size >= HELD:
                yield pa.array(held, kind)
                held, size = [], 0
        if held:
            yield pa.array(held, kind)


def pixel_function(of_pixels: Callable[[np.ndarray], object], return_type: str, kind: pa.DataType) -> Callable[[Column | str], Column]:
    """A column function of images from one of RGB pixels, with its result's type in Arrow; null where an image was not decoded."""

    def of_images(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return of_batches(of_pixels, kind, batches)

    return F.arrow_udf(of_images, return_type)


def to_gray(image: Column | str) -> Column:
    """8-bit luma, a byte a pixel, row by row."""
    return pixel_function(lambda rgb: imaging.to_gray(rgb).tobytes(), "binary", pa.binary())(image)


def variance_of_laplacian(image: Column | str) -> Column:
    return pixel_function(lambda rgb: imaging.variance_of_laplacian(imaging.to_gray(rgb)), "double", pa.float64())(image)


def estimate_noise(image: Column | str) -> Column:
    return pixel_function(lambda rgb: imaging.estimate_noise(imaging.to_gray(rgb)), "double", pa.float64())(image)


def perceptual_hash(image: Column | str) -> Column:
    return pixel_function(lambda rgb: imaging.perceptual_hash(imaging.to_gray(rgb)), "long", pa.int64())(image)


def resize_exact(image: Column | str, w: int, h: int) -> Column:
    """RGB bytes at the new size."""
    return pixel_function(lambda rgb: imaging.resize_exact(rgb, w, h).tobytes(), "binary", pa.binary())(image)


def letterbox(image: Column | str, w: int = 640, h: int = 640) -> Column:
    """RGB bytes of the canvas; its transform is ``letterbox_transform``."""
    return pixel_function(lambda rgb: imaging.letterbox(rgb, w, h)[0].tobytes(), "binary", pa.binary())(image)


def to_tensor(image: Column | str, mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0), layout: str = "NCHW") -> Column:
    return pixel_function(lambda rgb: imaging.to_tensor(rgb, mean, std, layout).ravel(), "array<float>", pa.list_(pa.float32()))(image)


def _focus(rgb: np.ndarray | None, box: Mapping | None) -> tuple:
    if rgb is None:
        return 0.0, 0.0, 0.0, "center", None
    gray = imaging.to_gray(rgb)
    bits, (h, w) = imaging.perceptual_hash(gray), gray.shape
    if box is not None:
        x, y, across, down = geometry.eye_sides(box, float(w), float(h), geometry.NUMBERS)
        if min(across, down) >= MIN_SIDE:
            return *imaging.crop_sharpness(gray, x, y, across, down), "eye", bits
    if min(w // 2, h // 2) < MIN_SIDE:
        return 0.0, 0.0, 0.0, "center", bits
    return *imaging.crop_sharpness(gray, w // 4, h // 4, w // 2, h // 2), "center", bits


def score_sharpness(images: DataFrame) -> DataFrame:
    """FOCUS for each row of ``images (image_id, image, face_bbox)``: score and perceptual hash in one pass over the pixels,
    which go no further. A failed decode scores 0 and has no hash."""
    return images.select("image_id", F.pandas_udf(focus, FOCUS)("image", "face_bbox").alias("_s")).select("image_id", *[f"_s.{f.split()[0]}" for f in FOCUS.split(", ")])


def score_with_model(make_predict: Callable, return_type: T.DataType, shape: list[int], batch_size: int = 32) -> Callable:
    """A column function that runs a model on tensors that stand in a column: ``make_predict()`` runs once a worker (there it
    opens a session, one thread) and returns a function from a batch of tensors of ``shape`` to a batch of outputs."""
    return predict_batch_udf(make_predict, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[shape])


def focus(images: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
    """FOCUS of images and their face boxes (null: none)."""
    found = [box if box["x"] is not None and box["x"] == box["x"] else None for box in boxes.to_dict("records")]
    scores = [_focus(pixels(image), box) for image, box in zip(_rows(images), found, strict=True)]
    out = pd.DataFrame(scores, columns=[f.split()[0] for f in FOCUS.split(", ")])
    return out.assign(phash=pd.array([s[-1] for s in scores], dtype="Int64"))


def best_detection(output: np.ndarray, values: int, columns: int, min_confidence: float) -> dict | None:
    """The first of ``decode_yolo``'s detections, which no other one suppresses."""
    if values < 5 or columns < 1:
        return None
    out = np.ravel(output)[: values * columns].reshape(values, columns).astype(np.float64)
    score = out[4] if values == 5 else np.maximum(out[4:].max(0), 0.0)
    at = int(score.argmax())
    return dict(zip(("cx", "cy", "w", "h"), out[:4, at].tolist(), strict=True)) if score[at] >= min_confidence else None


class Analysis(NamedTuple):
    """What ``analyzed`` finds in one photo."""

    score: float
    box: dict | None
    raw: np.ndarray | None
    phash: int | None


def analyzed(
    photos: Iterable[np.ndarray | None], min_confidence: float, detect: Callable | None, values: int, columns: int, mesh: Callable | None,
    side: int = 640, face_side: int = 192,
) -> list[Analysis]:
    """Photos of one batch (RGB, None: not decoded): faces in the letterboxed photos, then score, hash and landmarks. ``detect``
    and ``mesh`` take a batch of tensors, those of all photos or faces at hand."""
    photos = list(photos)
    boxes: list[dict | None] = [None] * len(photos)
    seen = [i for i, rgb in enumerate(photos) if rgb is not None]
    if detect and seen:
        fitted = [imaging.letterbox(photos[i], side, side) for i in seen]
        outputs = detect(np.concatenate([imaging.to_tensor(canvas) for canvas, _ in fitted]))
        for i, (_, t), output in zip(seen, fitted, outputs, strict=True):
            d = best_detection(output, values, columns, min_confidence)
            if d:
                sides = geometry.original_sides(d, dict(zip(TRANSFORM, t, strict=True)), geometry.NUMBERS)
                boxes[i] = dict(zip(("x", "y", "width", "height"), sides, strict=True))
    raws: list[np.ndarray | None] = [None] * len(photos)
    faces, of = [], []
    for i in seen if mesh and detect else []:
        if boxes[i]:
            high, wide = photos[i].shape[:2]
            x, y, w, h = geometry.crop_sides(boxes[i], float(wide), float(high), geometry.NUMBERS)
            if (cut := photos[i][y : y + h, x : x + w]).size:
                faces.append(imaging.to_tensor(imaging.resize_exact(cut, face_side, face_side), layout="NHWC"))
                of.append(i)
    if faces:
        for i, output in zip(of, mesh(np.concatenate(faces)), strict=True):
            raws[i] = np.ravel(output).astype(np.float32)
    scored = [_focus(rgb, box) for rgb, box in zip(photos, boxes, strict=True)]
    return [Analysis(s[0], box, raw, s[-1]) for s, box, raw in zip(scored, boxes, raws, strict=True)]
