"""Non-maximum suppression of very many boxes, as a table: of detections in order of confidence those stay that overlap no better one
that stays. No step compares all boxes of an image, or takes an image into one task.

Boxes are put down in grid cells by size: at the level of its longer side (cells of a power of two, as long as the box at least)
a box lies in four cells at most, and so it does at the next coarser levels. Boxes that overlap by more than ``threshold`` are
alike in size by that factor, so they meet in a cell at the level of the larger one. Each round, boxes that are the best ones left
in all their cells stay, and what they overlap goes; the best box of all is always among them, and where boxes lie apart, very many
decide in one round. Cells hold one best box each, found by partial sums, and few boxes that stay, as these hardly overlap; so a
crowd of boxes on one spot costs its number, not its pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.functions.vision import iou
from burstpick.tables import discard, written

SIDES = ("cx", "cy", "w", "h")


def _cells(boxes: DataFrame, finest: int, up: int) -> DataFrame:
    """``_id, _key`` and ``_cell`` of each box's cells at its own level and the ``up`` coarser ones."""
    longer = F.greatest(F.col("w"), F.col("h"))
    level = F.greatest(F.when(longer > 0, F.ceil(F.log2(longer))).otherwise(finest), F.lit(finest)).cast("int")
    side = F.pow(F.lit(2.0), F.col("level"))
    at = lambda c, s, sign: F.floor((F.col(c) + sign * F.greatest(F.col(s), F.lit(0.0)) / 2) / side).cast("long")
    spread = boxes.withColumn("_own", level).withColumn("level", F.explode(F.sequence(F.col("_own"), F.col("_own") + up)))
    spread = spread.withColumn("x", F.explode(F.sequence(at("cx", "w", -1), at("cx", "w", 1)))).withColumn("y", F.explode(F.sequence(at("cy", "h", -1), at("cy", "h", 1))))
    return spread.select("_id", "_key", F.struct("level", "x", "y").alias("_cell"))


def suppress(rows: DataFrame, key: str, threshold: float = 0.45, ties: list[str | Column] | None = None) -> DataFrame:
    """The rows of ``rows`` (``key, cx, cy, w, h, confidence`` and more) that stay, within each ``key`` (null is one, too). Of equal
    confidence the one that comes first by ``ties`` (the sides) is better. A box without an area overlaps nothing; a null side or
    confidence counts as 0."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    worth = F.struct((-number("confidence")).alias("c"), *[F.col(t) if isinstance(t, str) else t for t in ties or SIDES])
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.struct(F.col(key).alias("k")).alias("_key"), *[number(c).alias(c) for c in SIDES], worth.alias("_worth"))
    boxes = written(own.withColumn("_id", F.monotonically_increasing_id()), "boxes")
    smallest, largest = boxes.agg(F.min(F.greatest("w", "h")), F.max(F.greatest("w", "h"))).first()
    levels = lambda v: math.ceil(math.log2(v)) if v and v > 0 else -30
    finest = max(-30, levels(smallest))
    alike = math.ceil(-math.log2(threshold)) if 0 < threshold < 1 else 0 if threshold >= 1 else 1 << 30
    cells = _cells(boxes, finest, min(alike, max(0, levels(largest) - finest)))
    left = written(cells.join(boxes.select("_id", "_worth"), "_id").withColumn("_worth", F.struct("_worth", "_id")), "cells")
    slim = boxes.select("_id", F.struct(*SIDES).alias("_box"))
    kept: list[DataFrame] = []
    while True:
        best = left.groupBy("_key", "_cell").agg(F.min("_worth").alias("_best"))
        seen = left.join(best, ["_key", "_cell"]).groupBy("_id").agg(F.bool_and(F.col("_worth") == F.col("_best")).alias("first"))
        wins = written(seen.filter("first").select("_id"), "wins")
        if not wins.limit(1).count():
            discard(left, wins)
            break
        kept.append(wins)
        mine = left.join(wins, "_id").join(slim, "_id").select("_key", "_cell", F.col("_id").alias("_by"), F.col("_box").alias("_best"))
        rest = left.join(wins, "_id", "left_anti")
        met = rest.join(mine, ["_key", "_cell"]).join(slim, "_id").filter(iou(F.col("_box"), F.col("_best")) > threshold)
        after = written(rest.join(met.select("_id").distinct(), "_id", "left_anti"), "cells")
        discard(left)
        left = after
    if not kept:
        return boxes.select("_row.*")
    stay = kept[0]
    for more in kept[1:]:
        stay = stay.unionByName(more)
    out = written(boxes.join(stay, "_id").select("_row.*"), "stay")
    discard(boxes, *kept)
    return out
