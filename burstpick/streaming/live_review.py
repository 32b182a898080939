"""A running review: key presses come as a stream, and each scene's overrides are state.

What a batch folds in order of ``seq`` (``operators.review``) may arrive in any batches here, late presses too. A scene holds its
overrides up to the last settled press, and the presses since then; each batch folds these anew and tells the scene's overrides. Once
a scene has been quiet for ``settle_ms`` a timer folds its presses for good, so what it holds does not grow with the review.
The state store must be RocksDB's (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from burstpick.operators.review import apply_action
from burstpick.operators.select import UNRATED

TOLD = "scene_id long, last_seq long, image_ids array<long>, overrides array<string>"
PRESS = "image_id long, action string, keeper_id long, has_keeper boolean, verdict string"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class FoldReview(StatefulProcessor):
    def __init__(self, settle_ms: int):
        self.settle_ms = settle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getMapState("settled", "image_id long", "override string")
        self.presses = handle.getMapState("presses", "seq long", PRESS)

    def _folded(self) -> tuple[dict[int, str], int]:
        """Overrides after all presses, and the last one's number."""
        state, last = {k[0]: v[0] for k, v in self.settled.iterator()}, -1
        for seq, press in sorted((k[0], tuple(v)) for k, v in self.presses.iterator()):
            image, action, keeper, has_keeper, verdict = press
            apply_action(state, action, image, {keeper} if has_keeper else (), keeper if has_keeper else None, verdict)
            last = seq
        return state, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                self.presses.updateValue((int(r.seq),), (int(r.image_id), r.action, int(r.keeper_id), bool(r.has_keeper), r.verdict))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.settle_ms)
        state, last = self._folded()
        ids = sorted(state)
        yield pd.DataFrame({"scene_id": [key[0]], "last_seq": [last], "image_ids": [ids], "overrides": [[state[i] for i in ids]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _ = self._folded()
        self.settled.clear()
        for image, word in state.items():
            self.settled.updateValue((image,), (word,))
        self.presses.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_live_actions(actions: DataFrame, scenes: DataFrame, scores: DataFrame, keepers: DataFrame, settle_ms: int = 600_000) -> DataFrame:
    """TOLD for each scene that a batch touches, from the stream ``actions (seq, image_id, action)`` and the tables of the cull. The
    last row of a scene holds its overrides (``overrides_of``)."""
    known = scenes.select("scene_id", "image_id").join(scores.select("image_id", "verdict"), "image_id", "left").join(keepers, "scene_id", "left")
    here = scenes.select("scene_id", F.col("image_id").alias("keeper_id"), F.lit(True).alias("has_keeper"))
    known = known.join(here, ["scene_id", "keeper_id"], "left")
    presses = actions.select("seq", "image_id", "action").join(known, "image_id").select(
        "scene_id", "seq", "image_id", "action", F.coalesce("keeper_id", F.lit(0)).alias("keeper_id"), F.coalesce("has_keeper", F.lit(False)).alias("has_keeper"),
        F.coalesce("verdict", F.lit(UNRATED)).alias("verdict"),
    )
    return presses.groupBy("scene_id").transformWithStateInPandas(FoldReview(settle_ms), TOLD, "Update", "ProcessingTime")


def overrides_of(told: DataFrame, batch: str = "batch") -> DataFrame:
    """``image_id, override`` from all rows that a stream has told, each with the number of its ``batch``: a scene's last row counts."""
    last = told.groupBy("scene_id").agg(F.max_by(F.struct("image_ids", "overrides"), batch).alias("t"))
    return last.select(F.explode(F.arrays_zip("t.image_ids", "t.overrides")).alias("o")).select(F.col("o.image_ids").alias("image_id"), F.col("o.overrides").alias("override"))
