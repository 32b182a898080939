"""Live shoots: bursts from a stream of photos. It has no counterpart in a batch cull but gives the same clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_bursts(photos: DataFrame, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """``shoot_id, started, ended, n_images, image_ids`` of each burst of ``photos (shoot_id, ts timestamp, image_id)``, once
    the watermark has passed it. A gap equal to ``gap`` still joins. Photos without a time are dropped here; a side branch of
    the stream (``singletons``) makes them scenes of their own."""
    timed = photos.filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    bursts = timed.groupBy("shoot_id", F.session_window("ts", gap).alias("w"))
    rows = bursts.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_images"), F.sort_array(F.collect_list(F.struct("ts", "image_id"))).alias("_i"))
    return rows.select("shoot_id", "started", "ended", "n_images", F.transform("_i", lambda x: x["image_id"]).alias("image_ids"))


def singletons(photos: DataFrame) -> DataFrame:
    return photos.filter(F.col("ts").isNull()).select("shoot_id", "image_id")
