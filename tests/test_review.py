"""Keepers, verdicts, overrides, the fold of key presses, sidecars and manifests."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from burstpick.config import CullConfig
from burstpick.jobs.cull import cull_scored, run_cull
from burstpick.operators import export, report, review, select
from burstpick.sources import files

SCORES = "image_id long, sharpness_score double, blink_detected boolean"
SCENES = "scene_id long, pos_in_scene long, image_id long"


def one_scene(spark, ids):
    return spark.createDataFrame([(1, n, i) for n, i in enumerate(ids, 1)], SCENES)


@pytest.mark.parametrize(
    "rows,keeper",
    [
        ([(1, 10.5, False), (2, 25.3, False), (3, 15.0, False)], 2),
        ([(1, 5.0, False), (2, 5.0, False)], 2),
        ([(1, 9.0, True), (2, 3.0, False)], 2),
        ([(1, 9.0, True), (2, 3.0, True)], 1),
    ],
)
def test_keeper(spark, rows, keeper):
    scores = spark.createDataFrame(rows, SCORES)
    scenes = one_scene(spark, [r[0] for r in rows])
    keepers = select.select_keepers(scenes, scores)
    assert keepers.first()["keeper_id"] == keeper
    verdicts = {r["image_id"]: (r["verdict"], r["reject_reason"]) for r in select.assign_verdicts(scores, keepers).collect()}
    for i, _, blink in rows:
        assert verdicts[i] == (("keeper", None) if i == keeper else ("reject", "blink") if blink else ("unrated", None))
    joined = scores.join(scenes, "image_id").join(keepers, "scene_id")
    assert {r["image_id"]: r["verdict"] for r in select.assign_verdicts_in_scene(joined).collect()} == {i: v for i, (v, _) in verdicts.items()}


def test_scene_without_scores(spark):
    scores = spark.createDataFrame([(9, 1.0, False)], SCORES)
    assert select.select_keepers(one_scene(spark, [1]), scores).first()["keeper_id"] is None


def test_totals_of_nothing(spark):
    photos = spark.createDataFrame([], "image_id long, ts_ms long, phash long, sharpness_score double, has_face boolean, blink_detected boolean, s long")
    assert cull_scored(photos, CullConfig(), ["s"]).totals.first().asDict() == {"images": 0, "keepers": 0, "rejects": 0, "unrated": 0, "scenes": 0}


def fold(spark, presses, ids=(1, 2, 3), keeper=1, verdicts=None):
    scenes = one_scene(spark, ids)
    verdicts = verdicts or {1: "keeper", 2: "unrated", 3: "reject"}
    scores = spark.createDataFrame(list(verdicts.items()), "image_id long, verdict string")
    actions = spark.createDataFrame([(n, i, a) for n, (a, i) in enumerate(presses)], "seq long, image_id long, action string")
    keepers = spark.createDataFrame([(1, keeper)], "scene_id long, keeper_id long")
    return {r["image_id"]: r["override"] for r in review.fold_review_actions(actions, scenes, scores, keepers).collect()}


@pytest.mark.parametrize(
    "presses,want",
    [
        ([("K", 2)], {1: "unrated", 2: "keeper"}),
        ([("K", 2), ("K", 3)], {1: "unrated", 3: "keeper"}),
        ([("K", 2), ("K", 3), ("X", 3)], {1: "unrated", 3: "reject"}),
        ([("K", 2), ("K", 3), ("X", 3), ("X", 3)], {1: "unrated", 3: "unrated"}),
        ([("X", 3)], {3: "unrated"}),
        ([("U", 1)], {1: "unrated"}),
    ],
)
def test_fold(spark, presses, want):
    assert fold(spark, presses) == want


def test_fold_random(spark):
    rng = random.Random(5)
    for _ in range(3):
        presses = [(rng.choice("KXU"), rng.randint(1, 6)) for _ in range(30)]
        verdicts = {i: rng.choice(["keeper", "reject", "unrated"]) for i in range(1, 7)}
        state = {}
        for a, i in presses:
            if a == "K":
                state = {k: v for k, v in state.items() if v != "keeper"}
                if i != 4:
                    state[4] = "unrated"
                state[i] = "keeper"
            elif a == "X":
                state[i] = "unrated" if state.get(i, verdicts[i]) == "reject" else "reject"
            else:
                state[i] = "unrated"
        assert fold(spark, presses, range(1, 7), 4, verdicts) == state


def test_fold_of_large_ids(spark):
    """Ids beyond 53 bits beside scenes without a keeper."""
    big = 2**60 + 1
    scenes = spark.createDataFrame([(1, 1, big), (1, 2, big + 1), (2, 1, big + 2)], SCENES)
    scores = spark.createDataFrame([(big, "keeper"), (big + 1, "unrated"), (big + 2, "unrated")], "image_id long, verdict string")
    actions = spark.createDataFrame([(1, big + 1, "K"), (2, big + 2, "X")], "seq long, image_id long, action string")
    keepers = spark.createDataFrame([(1, big), (2, None)], "scene_id long, keeper_id long")
    got = {r["image_id"]: r["override"] for r in review.fold_review_actions(actions, scenes, scores, keepers).collect()}
    assert got == {big: "unrated", big + 1: "keeper", big + 2: "reject"}


def test_keeper_taken_away(spark):
    scenes = one_scene(spark, [1, 2])
    keepers = spark.createDataFrame([(1, 1)], "scene_id long, keeper_id long")
    over = lambda rows: spark.createDataFrame(rows, "image_id long, override string")
    got = lambda rows: review.effective_keepers(scenes, keepers, over(rows)).first()["effective_keeper_id"]
    assert got([]) == 1
    assert got([(1, "unrated")]) is None
    assert got([(1, "reject"), (2, "keeper")]) == 2
    assert got([(1, "keeper"), (2, "keeper")]) == 1


@pytest.mark.parametrize(
    "path,want",
    [
        ("/home/user/photos/IMG_1234.CR3", "/home/user/photos/IMG_1234.xmp"),
        ("A:\\photos\\DSC_0571.NEF", "A:\\photos\\DSC_0571.xmp"),
        ("/a/.NEF", "/a/.NEF.xmp"),
        ("/a.b/name", "/a.b/name.xmp"),
        ("/a/x.y.dng", "/a/x.y.xmp"),
    ],
)
def test_xmp_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(export.xmp_path(F.col("p"))).first()[0] == want


def test_sidecar_text():
    keeper, reject = export.xmp_text("keeper"), export.xmp_text("reject")
    assert 'xmp:Rating="5"' in keeper and "Label" not in keeper
    assert '\n      xmp:CreatorTool="burstpick"\n      xmp:Label="Reject">' in reject and 'xmp:Rating="-1"' in reject
    assert keeper.startswith('<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>') and keeper.endswith('<?xpacket end="w"?>')


def test_write_sidecars(spark, tmp_path):
    rows = [(1, f"{tmp_path}/A.CR2", "keeper"), (2, f"{tmp_path}/A.DNG", "reject"), (3, f"{tmp_path}/B.NEF", "unrated"), (4, f"{tmp_path}/none/C.NEF", "keeper")]
    entries = spark.createDataFrame(rows, "image_id long, raw_file_path string, verdict string")
    images = entries.select("image_id", F.col("raw_file_path").alias("file_path"))
    summary, errors = export.export_xmp(images, entries.select("image_id", "verdict"))
    assert summary.first().asDict() == {"files_written": 2, "files_skipped": 1, "n_errors": 1}
    assert [r["error"] for r in errors.collect()] == [f"{tmp_path}/none/C.xmp: No such file or directory"]
    assert sorted(os.listdir(tmp_path)) == ["A.xmp"]
    assert (tmp_path / "A.xmp").read_text() == export.xmp_text("reject")


def test_run_of_an_export(spark, tmp_path):
    """Counts of one pass: two entries of one path count as written, skipped ones beside rated ones, an error of a file."""
    rows = [
        (1, f"{tmp_path}/A.CR2", "keeper"), (2, f"{tmp_path}/A.DNG", "reject"), (3, f"{tmp_path}/A.NEF", "unrated"), (4, f"{tmp_path}/B.NEF", "other"),
        (5, f"{tmp_path}/none/C.NEF", "keeper"),
    ]
    entries = spark.createDataFrame(rows, "image_id long, file_path string, verdict string")
    done = export.run_export(entries.drop("verdict"), entries.select("image_id", "verdict"))
    assert (done.files_written, done.files_skipped, done.n_errors) == (2, 2, 1) and done.seconds > 0
    assert [r["error"] for r in done.errors.collect()] == [f"{tmp_path}/none/C.xmp: No such file or directory"]
    assert sorted(os.listdir(tmp_path)) == ["A.xmp"] and (tmp_path / "A.xmp").read_text() == export.xmp_text("reject")
    none = export.run_export(entries.drop("verdict").limit(0), entries.select("image_id", "verdict"))
    assert (none.files_written, none.files_skipped, none.n_errors) == (0, 0, 0)


def test_run_of_a_cull(spark, tmp_path):
    """Totals are observed by the pass that writes: as those of the tables, and nothing where there are no photos."""
    rows = [(i, i // 3 * 5000, None, float(i % 4), True, i % 5 == 0, i % 2) for i in range(200)]
    photos = spark.createDataFrame(rows, "image_id long, ts_ms long, phash long, sharpness_score double, has_face boolean, blink_detected boolean, s long")
    done = run_cull(photos.repartition(7), CullConfig(), str(tmp_path / "run"), ["s"])
    want = cull_scored(photos, CullConfig(), ["s"])
    assert done.cull.totals.select(want.totals.columns).first() == want.totals.first()
    assert {c: getattr(done, c) for c in want.totals.columns} == want.totals.first().asDict() and done.ms_per_image == done.seconds * 5
    for name in ("scenes", "keepers", "verdicts"):
        assert sorted(map(repr, getattr(done.cull, name).collect())) == sorted(map(repr, getattr(want, name).collect()))
        assert spark.read.parquet(str(tmp_path / "run" / name)).count() == getattr(want, name).count()
    none = run_cull(photos.limit(0), CullConfig(), str(tmp_path / "none"), ["s"])
    assert (none.images, none.scenes, none.keepers, none.rejects, none.unrated) == (0, 0, 0, 0, 0) and none.cull.verdicts.count() == 0


def test_previews_written(spark, tmp_path):
    df = spark.createDataFrame([(1, b"abc"), (2, b"")], "image_id long, preview_data binary")
    assert all(r["error"] is None for r in export.write_previews(df, str(tmp_path)).collect())
    assert (tmp_path / "1.jpg").read_bytes() == b"abc"


def test_manifest_round_trip(spark, tmp_path):
    photos = spark.createDataFrame([(1, 0, None, 2.0, True, True, 0), (2, 1, None, 1.0, False, True, 0), (3, 99999, None, 3.0, True, False, 0)], "image_id long, ts_ms long, phash long, sharpness_score double, has_face boolean, blink_detected boolean, s long")
    done = cull_scored(photos, CullConfig(), ["s"])
    kept = done.verdicts.select("image_id", "sharpness_score", "has_face", "blink_detected", F.lit(None).cast("double").alias("eye_aspect_ratio"), "verdict", "reject_reason", "s")
    text = export.manifests(done.scenes, done.keepers, kept, ["s"], 1.5).first()["json"]
    assert text.startswith('{\n  "total_images"')
    doc = json.loads(text)
    assert doc["total_images"] == 3 and doc["total_scenes"] == 2 and doc["total_keepers"] == 2
    assert [s["verdict"] for s in doc["image_scores"]] == ["Keeper", {"Reject": {"reason": "Blink"}}, "Keeper"]
    (tmp_path / "m.json").write_text(text)
    scenes, scores, totals = export.read_manifest(spark, str(tmp_path / "m.json"))
    assert sorted(map(tuple, scenes.collect())) == [(1, 1, 1, 1), (1, 2, 2, 1), (2, 1, 3, 3)]
    assert [r["verdict"] for r in scores.orderBy("image_id").collect()] == ["keeper", "reject", "keeper"]
    assert totals.first()["processing_time_secs"] == 1.5
    export.write_manifest(str(tmp_path / "big"), done.scenes, done.keepers, kept.drop("s"))
    assert spark.read.json(str(tmp_path / "big/scenes")).count() == 2
    assert {tuple(map(tuple, (x.orderBy(x.columns[0], x.columns[1]).collect()))) for x in export.read_manifest(spark, str(tmp_path / "big"))[:1]} == {tuple(map(tuple, scenes.orderBy("scene_id", "pos_in_scene").collect()))}
    assert '"verdict":{"Reject":{"reason":"Blink"}}' in "".join(r[0] for r in spark.read.text(str(tmp_path / "big/image_scores")).collect())


def test_verdict_label(spark):
    rows = [('"Keeper"',), ('{"Reject":{"reason":"OutOfFocus"}}',), ('"Unrated"',), ("{}",), ("bad",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").coalesce(1).select(review.verdict_label(F.col("v"))).collect()]
    assert got == ["keeper", "reject", "unrated", "unrated", "unrated", "unrated"]


def test_metrics(spark):
    row = report.metrics(spark.createDataFrame([(8,)], "images long"), 4.0).first()
    assert (row["processing_time_secs"], row["ms_per_image"]) == (4.0, 500.0)


def test_throughput():
    assert report.throughput(8.0, 0) == 8000 and report.throughput(8.0, 8) == 1000


def test_config():
    with pytest.raises(ValueError):
        CullConfig(blink_ear_threshold=2)


def plain_rows(tables):
    return [sorted((tuple(r) for r in t.collect()), key=repr) for t in tables]


def test_document_of_any_size(spark, tmp_path):
    """One document of many pieces and partitions: the bytes of the small form; read by byte ranges, and as a folder, the same tables."""
    rng = random.Random(3)
    box = lambda i: (float(i), 2.0, 3.5, 4.0) if i % 3 else None
    rows = [(i, 10 * i, None, float(i % 17), bool(i % 3), i % 5 == 0, box(i), 0.25 if i % 4 else None, 7) for i in range(1, 400)]
    rng.shuffle(rows)
    schema = "image_id long, ts_ms long, phash long, sharpness_score double, has_face boolean, blink_detected boolean, face_bbox struct<x:double,y:double,width:double,height:double>, eye_aspect_ratio double, s long"
    done = cull_scored(spark.createDataFrame(rows, schema).withColumn("ts_ms", F.col("ts_ms") + F.floor(F.col("image_id") / 7) * 10_000), CullConfig(), ["s"])
    kept = done.verdicts.select("image_id", "sharpness_score", "has_face", "face_bbox", "blink_detected", "eye_aspect_ratio", "verdict", "reject_reason", "s")
    small = export.manifests(done.scenes, done.keepers, kept, ["s"], 1.5).first()["json"]
    path = str(tmp_path / "whole.json")
    export.write_manifest_document(path, done.scenes, done.keepers, kept.drop("s"), 1.5)
    assert open(path).read() == small
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    want = plain_rows(t.drop("s") for t in export.parse_manifest(export.manifests(done.scenes, done.keepers, kept, ["s"], 1.5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        assert plain_rows(export.read_manifest(spark, path)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    doc = json.loads(small)
    doc["processing_time_secs"] = doc.pop("processing_time_secs")  # another writer's order and white space
    for n, how in enumerate(({"indent": 2}, {}, {"separators": (",", ":")})):
        other = tmp_path / f"{n}.json"
        other.write_text(json.dumps(doc, **how))
        assert plain_rows(export.read_manifest(spark, str(other))) == want
    export.write_manifest(str(tmp_path / "folder"), done.scenes, done.keepers, kept.drop("s"), 1.5)
    assert plain_rows(export.read_manifest(spark, str(tmp_path / "folder"))) == want


def test_document_of_nothing_and_of_one(spark, tmp_path):
    schema = "image_id long, ts_ms long, phash long, sharpness_score double, has_face boolean, blink_detected boolean, s long"
    for n in (0, 1):
        done = cull_scored(spark.createDataFrame([(5, 0, None, 2.0, True, False, 0)][:n], schema), CullConfig(), ["s"])
        path = str(tmp_path / f"{n}.json")
        export.write_manifest_document(path, done.scenes, done.keepers, done.verdicts.select("image_id", "sharpness_score", "has_face", "blink_detected", "verdict", "reject_reason"), 0.5)
        assert json.loads(open(path).read())["total_images"] == n
        scenes, scores, totals = export.read_manifest(spark, path)
        assert (scenes.count(), scores.count(), totals.first()["total_scenes"], totals.first()["processing_time_secs"]) == (n, n, n, 0.5)


def test_files_of_one_folder_are_dealt_out(spark, tmp_path):
    """Sidecars are written by many tasks, however small their rows, into folders made on demand; the files of one folder are read by many."""
    paths = F.concat(F.lit(f"{tmp_path}/"), F.col("id") % 2, F.lit("/IMG_"), F.col("id"), F.lit(".CR2"))
    images = spark.range(200).select(F.col("id").alias("image_id"), paths.alias("file_path"))
    verdicts = images.select("image_id", F.lit("keeper").alias("verdict"))
    entries = export.export_entries(images, verdicts)
    assert export.sidecars(entries).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    summary, errors = export.export_xmp(images, verdicts, fan_out=True)
    assert summary.first()["files_written"] == 200 and errors.count() == 0
    found = files.list_folders(spark, spark.createDataFrame([(f"{tmp_path}/0",), (f"{tmp_path}/none",)], "folder string").coalesce(1))
    assert sum(1 for n in found.rdd.glom().map(len).collect() if n) > 8 and found.count() == 100
    assert {r["content"].decode() for r in files.read_bytes(found).collect()} == {export.xmp_text("keeper")}
