"""Review: the user's overrides on top of the verdicts.

Tables: ``scenes`` (scene_id, pos_in_scene, image_id), ``keepers`` (scene_id, keeper_id), ``scores`` (image_id,
sharpness_score, verdict, ...), ``overrides`` (image_id, override; one row a photo).
"""

from __future__ import annotations

from collections.abc import Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.operators.select import KEEPER, REJECT, UNRATED
from burstpick.scan import segmented
from burstpick.tables import with_row_numbers


def verdict_label(json: Column) -> Column:
    """A manifest's verdict, a JSON string or object, as keeper, reject or unrated."""
    v = F.try_parse_json(json)
    rejected = F.schema_of_variant(F.try_variant_get(v, "$.Reject", "variant")).isNotNull()
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(F.try_variant_get(v, "$", "string") == "Keeper", KEEPER).when(is_object & rejected, REJECT).otherwise(UNRATED)


def effective_verdicts(images: DataFrame, scores: DataFrame, overrides: DataFrame) -> DataFrame:
    """``image_id, effective_verdict``: the override, else the verdict, else unrated."""
    joined = images.select("image_id").join(scores.select("image_id", "verdict"), "image_id", "left").join(overrides, "image_id", "left")
    return joined.select("image_id", F.coalesce("override", "verdict", F.lit(UNRATED)).alias("effective_verdict"))


def effective_keepers(scenes: DataFrame, keepers: DataFrame, overrides: DataFrame) -> DataFrame:
    """``scene_id, effective_keeper_id``: the first photo that an override keeps; else none where one has taken the chosen
    keeper away; else the chosen one."""
    joined = scenes.select("scene_id", "pos_in_scene", "image_id").join(overrides, "image_id", "left").join(keepers, "scene_id")
    kept = F.min_by("image_id", F.when(F.col("override") == KEEPER, F.col("pos_in_scene")))
    taken = F.coalesce(F.bool_or((F.col("image_id") == F.col("keeper_id")) & F.col("override").isin(UNRATED, REJECT)), F.lit(False))
    chosen = joined.groupBy("scene_id").agg(kept.alias("kept"), taken.alias("taken"), F.max("keeper_id").alias("keeper_id"))
    return chosen.select("scene_id", F.coalesce("kept", F.when(~F.col("taken"), F.col("keeper_id"))).alias("effective_keeper_id"))


def rank_scene_images(scenes: DataFrame, scores: DataFrame, effective: DataFrame) -> DataFrame:
    """``scene_id, image_id, rank, scene_size``: the effective keeper, then by sharpness (none: 0), then in scene order."""
    joined = scenes.join(scores.select("image_id", "sharpness_score"), "image_id", "left").join(effective, "scene_id")
    first = F.coalesce(F.col("image_id") == F.col("effective_keeper_id"), F.lit(False))
    rows = joined.select("scene_id", "image_id", first.alias("_first"), F.coalesce("sharpness_score", F.lit(0.0)).alias("_sharp"), "pos_in_scene")
    placed = segmented(rows, ["scene_id"], [F.col("_first").desc(), F.col("_sharp").desc(), F.col("pos_in_scene").asc()])
    ranked = placed.select("scene_id", "image_id", F.col("_nth").alias("rank"))
    return ranked.join(ranked.groupBy("scene_id").agg(F.max("rank").alias("scene_size")), "scene_id")


def filter_scenes(mode: str, scenes: DataFrame, effective_keeper: DataFrame, effective_verdict: DataFrame) -> DataFrame:
    """``scene_id, scene_index`` (from 1, dense) of all scenes, those with a keeper, or those with a rejected photo."""
    ids = scenes.select("scene_id").distinct()
    if mode == "keepers":
        ids = effective_keeper.filter(F.col("effective_keeper_id").isNotNull()).select("scene_id")
    elif mode == "rejects":
        gone = effective_verdict.filter(F.col("effective_verdict") == REJECT)
        ids = scenes.join(gone, "image_id", "left_semi").select("scene_id").distinct()
    elif mode != "all":
        raise ValueError(f"mode {mode!r}: all, keepers or rejects")
    return with_row_numbers(ids, "scene_index", "scene_id")


def override_stats(effective_verdict: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row: keepers, rejects, unrated after overrides, and how many overrides there are."""
    of = lambda v: F.count_if(F.col("effective_verdict") == v).alias(v)
    counts = effective_verdict.agg(of(KEEPER), of(REJECT), of(UNRATED)).toDF("keepers", "rejects", "unrated")
    n = overrides.agg(F.count(F.lit(1)).alias("overrides"))
    return counts.withColumn("_one", F.lit(1)).join(n.withColumn("_one", F.lit(1)), "_one").drop("_one")


def apply_action(state: dict[int, str], action: str, image: int, members: Container[int], keeper: int | None, verdict: str) -> None:
    """One key press on one photo of a scene, on the scene's overrides ``state``."""
    if action == "K":
        for other in [x for x, v in state.items() if v == KEEPER]:
            del state[other]
        if keeper != image and keeper in members:
            state[keeper] = UNRATED
        state[image] = KEEPER
    elif action == "X":
        state[image] = UNRATED if state.get(image, verdict) == REJECT else REJECT
    elif action == "U":
        state[image] = UNRATED


def fold_review_actions(actions: DataFrame, scenes: DataFrame, scores: DataFrame, keepers: DataFrame) -> DataFrame:
    """``image_id, override`` after all ``actions`` (seq, image_id, action), in order of seq within each scene.

    A scene's photos and actions arrive together, its actions sorted after its photos, so one pass over the sorted rows
    folds scene after scene; what is held is one scene's photos and overrides.
    """
    touched = scenes.join(actions.select("image_id"), "image_id", "left_semi").select("scene_id").distinct()
    members = scenes.join(touched, "scene_id", "left_semi").join(scores.select("image_id", "verdict"), "image_id", "left").join(keepers, "scene_id", "left")
    photos = members.select("scene_id", F.lit(None).cast("long").alias("seq"), "image_id", F.lit("").alias("action"), "keeper_id", F.coalesce("verdict", F.lit(UNRATED)).alias("verdict"))
    acts = actions.join(scenes.select("scene_id", "image_id"), "image_id").select("scene_id", "seq", "image_id", "action")
    rows = photos.unionByName(acts, allowMissingColumns=True).repartition("scene_id").sortWithinPartitions("scene_id", F.col("seq").asc_nulls_first(), "image_id")

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, verdicts, keeper, state = None, {}, None, {}
        for batch in batches:
            done = []
            for scene_id, image, action, keep, verdict in zip(*(batch[c].to_pylist() for c in ("scene_id", "image_id", "action", "keeper_id", "verdict")), strict=True):
                if scene_id != scene:
                    done += state.items()
                    scene, verdicts, keeper, state = scene_id, {}, None, {}
                if action == "":
                    verdicts[image], keeper = verdict, keep
                else:
                    apply_action(state, action, image, verdicts, keeper, verdicts.get(image, UNRATED))
            yield rows_of(done)
        yield rows_of(list(state.items()))

    def rows_of(pairs: list[tuple[int, str]]) -> pa.RecordBatch:
        ids, words = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["image_id", "override"])

    return rows.mapInArrow(of_partition, "image_id long, override string")


def scene_cards(scenes: DataFrame, images: DataFrame, scores: DataFrame, effective: DataFrame) -> DataFrame:
    """``scene_id, cover_id, n_images, is_burst`` of scenes whose photos are known; the cover ranks first."""
    ranked = rank_scene_images(scenes, scores, effective).join(images.select("image_id"), "image_id")
    cards = ranked.groupBy("scene_id").agg(F.min_by("image_id", "rank").alias("cover_id"), F.count(F.lit(1)).alias("n_images"))
    return cards.withColumn("is_burst", F.col("n_images") > 1)


def focus_point(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """``image_id, focus_x, focus_y``: the middle of the face box (``boxes``: image_id, face_bbox), else of the preview."""
    joined = images.join(boxes.select("image_id", "face_bbox"), "image_id", "left")
    middle = lambda at, side, whole: F.coalesce(F.col(f"face_bbox.{at}") + F.col(f"face_bbox.{side}") / 2, F.col(whole) / 2)
    return joined.select("image_id", middle("x", "width", "preview_width").alias("focus_x"), middle("y", "height", "preview_height").alias("focus_y"))
