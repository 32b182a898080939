"""The whole cull: photos to scenes, scores, keepers and verdicts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.config import CullConfig
from burstpick.functions import vision
from burstpick.functions.jpeg import decode_jpeg
from burstpick.operators import select, stack
from burstpick.operators.report import throughput
from burstpick.tables import discard, written


@dataclass(frozen=True)
class Cull:
    scenes: DataFrame
    keepers: DataFrame
    verdicts: DataFrame
    totals: DataFrame


def _placed(photos: DataFrame, scenes: DataFrame) -> DataFrame:
    """``photos`` with their scenes, written once: keepers and verdicts both read it."""
    return written(scenes.select("scene_id", "pos_in_scene", "image_id").join(photos.drop("scene_id", "pos_in_scene"), "image_id"), "scored")


def _judged(placed: DataFrame, keepers: DataFrame) -> DataFrame:
    return select.assign_verdicts_in_scene(placed.drop("verdict", "reject_reason").join(keepers, "scene_id"))


def _slim(photos: DataFrame, judged: DataFrame) -> DataFrame:
    return judged.select(*[f"`{c}`" for c in photos.columns if c not in ("scene_id", "pos_in_scene", "verdict", "reject_reason")], "verdict", "reject_reason")


def cull_scored(photos: DataFrame, config: CullConfig, by: list[str] | None = None) -> Cull:
    """From ``photos (image_id, ts_ms, phash, sharpness_score, has_face, blink_detected)``, already scored."""
    scenes = stack.stack_scenes(photos, config.burst_threshold_secs, config.phash_similarity_threshold, by)
    scenes = written(scenes, "scenes")
    placed = _placed(photos, scenes)
    keepers = select.pick_scene_keepers(placed)
    verdicts = _slim(photos, _judged(placed, keepers))
    return Cull(scenes, keepers, verdicts, select.cull_totals(scenes, verdicts))


@dataclass(frozen=True)
class Run:
    """A cull in a folder, and what was counted while its verdicts were written."""

    cull: Cull
    images: int
    scenes: int
    keepers: int
    rejects: int
    unrated: int
    seconds: float

    @property
    def ms_per_image(self) -> float:
        return throughput(self.seconds, self.images)


def run_cull(photos: DataFrame, config: CullConfig, folder: str, by: list[str] | None = None) -> Run:
    """``cull_scored``, run now: scenes, keepers and verdicts as Parquet in ``folder``. Totals are an ``Observation`` of the pass that
    writes the verdicts, in its last stage, so nothing is read again for them and a task that is repeated counts once."""
    began, seen = time.monotonic(), Observation("cull")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    scenes = kept(stack.stack_scenes(photos, config.burst_threshold_secs, config.phash_similarity_threshold, by), "scenes")
    placed = _placed(photos, scenes)
    keepers = kept(select.pick_scene_keepers(placed), "keepers")
    verdicts = kept(_slim(photos, _judged(placed, keepers).observe(seen, *select.observed_totals())), "verdicts")
    discard(placed)
    totals = seen.get
    row = photos.sparkSession.createDataFrame([tuple(totals.values())], ", ".join(f"{c} long" for c in totals))
    return Run(Cull(scenes, keepers, verdicts, row), **totals, seconds=time.monotonic() - began)


#: Bytes of decoded photos that a worker holds at once, but for one that is larger.
BUFFER = 256 << 20

BOX = "struct<x: double, y: double, width: double, height: double>"
FOUND = f"sharpness_score double, face_bbox {BOX}, raw array<float>, phash long"


def _found(rows: DataFrame, column: str, decode: Callable, config: CullConfig, detect, values: int, columns: int, mesh, batch_size: int) -> DataFrame:
    """``image_id`` and FOUND. Photos are decoded one after another, in the worker; a buffer of at most ``batch_size`` of them, and
    of about BUFFER bytes, goes through all steps and is let go."""
    box = pa.struct([(n, pa.float64()) for n in ("x", "y", "width", "height")])
    kinds = (pa.float64(), box, pa.list_(pa.float32()), pa.int64())

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: list[Callable | None] = []
        for batch in batches:
            begun = held = 0
            photos: list = []
            for at in range(batch.num_rows):
                photos.append(decode(batch[column][at].as_py()))
                held += 0 if photos[-1] is None else photos[-1].nbytes
                if len(photos) == batch_size or held >= BUFFER or at == batch.num_rows - 1:
                    if not models and held:
                        models = [make() if make else None for make in (detect, mesh)]
                    found = vision.analyzed(photos, config.face_detection_confidence, *(models[:1] or [None]), values, columns, *(models[1:] or [None]))
                    out = [pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch["image_id"].slice(begun, len(photos)), *out], names=["image_id", "sharpness_score", "face_bbox", "raw", "phash"])
                    begun, held, photos = at + 1, 0, []

    schema = T.StructType([rows.schema["image_id"], *T.StructType.fromDDL(FOUND)])
    return rows.select("image_id", column).mapInArrow(of_partition, schema)


def _features(found: DataFrame, config: CullConfig) -> DataFrame:
    blink = F.when(F.col("raw").isNotNull(), vision.detect_blink(F.col("raw"), config.blink_ear_threshold))
    return found.select("image_id", "sharpness_score", "face_bbox", "phash", blink.alias("_b")).select(
        "image_id", "sharpness_score", F.col("face_bbox").isNotNull().alias("has_face"), "face_bbox",
        F.coalesce("_b.blink_detected", F.lit(False)).alias("blink_detected"), F.col("_b.average_ear").alias("eye_aspect_ratio"), "phash",
    )


def analyze_previews(
    previews: DataFrame, config: CullConfig, detect: Callable | None = None, rows: int = 5, columns: int = 0, mesh: Callable | None = None,
    batch_size: int = 16, decode: Callable = decode_jpeg,
) -> DataFrame:
    """``image_id, sharpness_score, has_face, face_bbox, blink_detected, eye_aspect_ratio, phash`` from ``previews (image_id,
    preview_data)``, compressed files. ``decode`` makes RGB pixels of one (None: it can't). ``detect`` and ``mesh`` open the models
    and return functions from a batch of tensors to a batch of outputs: from letterboxed NCHW photos to ``rows`` x ``columns``,
    and from NHWC faces to landmarks. Whatever fails leaves its default: no face, score 0, no blink.

    Only compressed bytes reach the worker, once, and only slim rows leave it: no pixels are in a row, a column or an exchange."""
    return _features(_found(previews, "preview_data", decode, config, detect, rows, columns, mesh, batch_size), config)


def analyze_images(
    images: DataFrame, config: CullConfig, detect: Callable | None = None, rows: int = 5, columns: int = 0, mesh: Callable | None = None,
    batch_size: int = 16,
) -> DataFrame:
    """The same from ``images (image_id, image)``, photos that the image source has decoded."""
    decode = lambda image: None if image is None else vision.pixels(image)
    return _features(_found(images, "image", decode, config, detect, rows, columns, mesh, batch_size), config)


def cull(photos: DataFrame, features: DataFrame, config: CullConfig, by: list[str] | None = None) -> Cull:
    """From ``photos (image_id, ts_ms)`` and what ``analyze_images`` found; the slim table of features is written once, and
    every shuffle runs on that."""
    slim = photos.join(written(features, "features"), "image_id", "left")
    defaults = {"sharpness_score": F.lit(0.0), "has_face": F.lit(False), "blink_detected": F.lit(False)}
    return cull_scored(slim.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()}), config, by)
