"""Scenes: bursts by time gap, split where the look changes.

Tables: photos are ``image_id, ts_ms (null: unknown), phash`` and key columns; scenes are exploded, one row a photo:
``scene_id, pos_in_scene, image_id``. Order is (ts_ms, image_id). A null key is a key like any other. No step needs all rows, or
all rows of a key, a cluster or a scene, in one task: see ``burstpick.scan`` and ``burstpick.operators.anchors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.operators.anchors import anchor_groups
from burstpick.scan import segmented
from burstpick.tables import with_row_numbers, written

ORDER = ["ts_ms", "image_id"]


def gap_ms(threshold_secs: float) -> int:
    return int(threshold_secs * 1000)


def time_clusters(df: DataFrame, threshold_secs: float, by: list[str] | None = None) -> DataFrame:
    """Timed photos with ``cluster`` 0, 1, ... within ``by`` (none: over all photos): a gap over the threshold starts a new one."""
    timed = df.filter(F.col("ts_ms").isNotNull())
    found = segmented(timed, by or [], ORDER, gap=("ts_ms", gap_ms(threshold_secs)))
    return found.withColumnRenamed("_run", "cluster").drop("_nth")


def time_clusters_global(df: DataFrame, threshold_secs: float) -> DataFrame:
    return time_clusters(df, threshold_secs)


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def split_by_phash(clusters: DataFrame, threshold: int, by: list[str]) -> DataFrame:
    """``by, cluster``, ORDER and ``subgroup`` 0, 1, ...: within a cluster (``by`` and ``cluster``) a photo over ``threshold`` bits
    from the first one of the current group starts the next. A missing hash never splits, and a cluster that starts with
    one stays whole. Only ids, times and hashes go through Python."""
    return anchor_groups(clusters, [*by, "cluster"], ORDER, threshold)


def singleton_scenes(df: DataFrame) -> DataFrame:
    """Photos without a time: a scene each."""
    return df.filter(F.col("ts_ms").isNull())


def stack_scenes(df: DataFrame, threshold_secs: float, phash_threshold: int, by: list[str] | None = None, ts_unit: str = "ms") -> DataFrame:
    """``scene_id, pos_in_scene, image_id`` and ``by``. Scenes are numbered 1, 2, ... by their first photo, those without
    a time last. ``ts_unit``: what ``ts_ms`` counts, ``ms`` or ``s``."""
    if ts_unit not in ("ms", "s"):
        raise ValueError(f"ts_unit {ts_unit!r}: ms or s")
    if ts_unit == "s":
        df = df.withColumn("ts_ms", F.col("ts_ms") * 1000)
    keys = by or []
    timed = time_clusters(df.select(*keys, *ORDER, "phash"), threshold_secs, keys)
    split = split_by_phash(timed, phash_threshold, keys)
    placed = segmented(split, [*keys, "cluster", "subgroup"], ORDER, ORDER)
    first = placed.select(*keys, "image_id", F.col("_nth").alias("pos_in_scene"), F.col("_head").alias("_first"))
    alone = singleton_scenes(df).select(
        *keys, "image_id", F.lit(1).cast("long").alias("pos_in_scene"),
        F.struct(F.lit(None).cast("long").alias("ts_ms"), F.col("image_id")).alias("_first"),
    )
    photos = written(first.unionByName(alone), "photos")  # read twice below
    scenes = photos.filter(F.col("pos_in_scene") == 1).select("_first")
    ids = with_row_numbers(scenes, "scene_id", F.col("_first.ts_ms").asc_nulls_last(), F.col("_first.image_id"))
    ids = ids.select(F.col("_first.image_id").alias("_head"), "scene_id")
    return photos.withColumn("_head", F.col("_first.image_id")).join(ids, "_head").select(*keys, "scene_id", "pos_in_scene", "image_id")


def scene_arrays(scenes: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("pos_in_scene", "image_id")))
    return scenes.groupBy("scene_id").agg(F.transform(ordered, lambda x: x["image_id"]).alias("image_ids"))


def scene_stats(scenes: DataFrame) -> DataFrame:
    """One row: scenes, singletons, largest, average size (0.0 if there is none)."""
    sizes = scenes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("scenes"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("average_size"),
    )
