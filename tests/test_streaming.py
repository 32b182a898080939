import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from burstpick.operators import review
from burstpick.streaming import live_review
from burstpick.streaming.live_stack import live_bursts, singletons


def test_live_bursts(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(seconds=s), i) for i, s in enumerate((0, 2, 5, 9, 100, 5000))] + [(1, None, 99)]
    spark.createDataFrame(rows, "shoot_id long, ts timestamp, image_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("shoot_id long, ts timestamp, image_id long").parquet(str(tmp_path / "in"))
    query = live_bursts(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(r["image_ids"] for r in spark.table("bursts").collect())
    assert got == [[0, 1, 2], [3], [4]]  # the last one still waits for its watermark
    assert singletons(spark.read.parquet(str(tmp_path / "in"))).count() == 1


@pytest.mark.parametrize("settle_ms", [600_000, 0])
def test_live_review(spark, tmp_path, settle_ms):
    """Presses in several batches, with a restart between them: the batch fold's overrides. Late presses count in their place, as long
    as their scene has not settled."""
    rng = random.Random(settle_ms)
    big = 2**60 + 1
    rows = [(s, p + 1, big + 10 * s + p) for s in range(5) for p in range(4)]
    scenes = spark.createDataFrame(rows, "scene_id long, pos_in_scene long, image_id long")
    scores = spark.createDataFrame([(i, rng.choice(["keeper", "reject", "unrated"])) for _, _, i in rows if i % 7], "image_id long, verdict string")
    keepers = spark.createDataFrame([(0, big), (1, big + 11), (2, None), (3, 5), (4, big + 43)], "scene_id long, keeper_id long")
    presses = [(n, rng.choice(rows)[2], rng.choice("KXU")) for n in range(40)]
    batches = [presses[:9], presses[9:25], presses[25:]]
    if settle_ms:
        rng.shuffle(presses)
        batches = [presses[:9], presses[9:25], presses[25:]]
    schema = "seq long, image_id long, action string"
    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    live_review.with_state_store(spark)

    def keep(df, batch_id):
        rows = df.withColumn("batch", F.lit(batch_id)).collect()
        if rows:
            spark.createDataFrame(rows, f"{live_review.TOLD}, batch long").write.mode("overwrite").parquet(f"{out}/{batch_id}")

    try:
        for batch in batches:  # each one is a run of its own, from the checkpoint of the last
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            told = live_review.fold_live_actions(stream, scenes, scores, keepers, settle_ms)
            query = told.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", point).start()
            try:  # timers keep such a query going, so it is stopped once it has seen all
                for _ in range(600):
                    if sum(p["numInputRows"] for p in query.recentProgress) >= len(batch) or query.exception():
                        break
                    time.sleep(0.2)
                assert query.exception() is None
            finally:
                query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()])
    got = {r["image_id"]: r["override"] for r in live_review.overrides_of(told).collect()}
    want = review.fold_review_actions(spark.createDataFrame(presses, schema), scenes, scores, keepers)
    assert got == {r["image_id"]: r["override"] for r in want.collect()}
