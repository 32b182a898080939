"""Keepers and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEPER, REJECT, UNRATED, BLINK = "keeper", "reject", "unrated", "blink"


def _keeper_rank() -> Column:
    return F.struct((~F.col("blink_detected")).alias("open"), "sharpness_score", "pos_in_scene")


def pick_keeper(df: DataFrame, group: list[str]) -> DataFrame:
    """``group, keeper_id``: the sharpest photo (``pos_in_scene`` breaks ties: the last)."""
    return df.groupBy(group).agg(F.max_by("image_id", F.struct("sharpness_score", "pos_in_scene")).alias("keeper_id"))


def select_keepers(scenes: DataFrame, scores: DataFrame) -> DataFrame:
    """``scene_id, keeper_id``: the sharpest photo without a blink, else the sharpest. Photos without a score don't count; a
    scene of such photos has no keeper. Aggregated before the shuffle, no sort."""
    own = scores.select("image_id", "sharpness_score", "blink_detected", F.lit(True).alias("_scored"))
    joined = scenes.select("scene_id", "pos_in_scene", "image_id").join(own, "image_id", "left")
    return joined.groupBy("scene_id").agg(F.max_by("image_id", F.when(F.col("_scored"), _keeper_rank())).alias("keeper_id"))


def pick_scene_keepers(scored: DataFrame) -> DataFrame:
    """The same from ``scored (scene_id, pos_in_scene, image_id, sharpness_score, blink_detected)``, all of them with a score."""
    return scored.groupBy("scene_id").agg(F.max_by("image_id", _keeper_rank()).alias("keeper_id"))


def assign_verdicts(scores: DataFrame, keepers: DataFrame) -> DataFrame:
    """``scores`` with ``verdict, reject_reason``: keepers first, whether they blink or not."""
    ids = keepers.select(F.col("keeper_id").alias("image_id")).filter(F.col("image_id").isNotNull()).distinct().withColumn("_k", F.lit(True))
    joined = scores.drop("verdict", "reject_reason").join(ids, "image_id", "left")
    return _verdicts(joined, F.col("_k").isNotNull()).drop("_k")


def assign_verdicts_in_scene(scored: DataFrame) -> DataFrame:
    """The same where ``keeper_id`` stands in each row: no join."""
    return _verdicts(scored, F.coalesce(F.col("image_id") == F.col("keeper_id"), F.lit(False)))


def _verdicts(df: DataFrame, kept) -> DataFrame:
    return df.withColumns(
        {
            "verdict": F.when(kept, KEEPER).when(F.col("blink_detected"), REJECT).otherwise(UNRATED),
            "reject_reason": F.when(~kept & F.col("blink_detected"), BLINK),
        }
    )


def cull_totals(scenes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: images, scenes, keepers, rejects, unrated; zeros where there is nothing."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    counts = verdicts.agg(F.count(F.lit(1)).alias("images"), of(KEEPER).alias("keepers"), of(REJECT).alias("rejects"), of(UNRATED).alias("unrated"))
    n = scenes.select("scene_id").distinct().agg(F.count(F.lit(1)).alias("scenes"))
    return counts.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")


def observed_totals() -> list[Column]:
    """The same of rows with ``pos_in_scene, verdict`` as aggregates for an ``Observation``: a scene is its first photo."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    scenes = F.count_if(F.col("pos_in_scene") == 1).alias("scenes")
    return [F.count(F.lit(1)).alias("images"), scenes, of(KEEPER).alias("keepers"), of(REJECT).alias("rejects"), of(UNRATED).alias("unrated")]
