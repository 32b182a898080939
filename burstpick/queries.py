"""The queries of the library by name, over the stand-in views, and their SQL.

Scenes are by shoot with a gap of 14,400 s and 14 bits. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.config import CullConfig
from burstpick.functions import imaging, vision
from burstpick.jobs.cull import analyze_images, analyze_previews, cull, cull_scored, run_cull
from burstpick.jobs.ingest import ingest_photos
from burstpick.operators import export, report, review, select, stack
from burstpick.operators.file_sink import write_files
from burstpick.operators.suppress import suppress
from burstpick.sources import exif, files, previews, standin
from burstpick.tables import shared_dir, work_parts, written

CONFIG = CullConfig(burst_threshold_secs=14_400.0)
BY = ["shoot_id"]
GLOBAL_GAP = 60.0
#: Photos of a folder, where files of all photos are written.
FOLDER_HOLDS = 10_000


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.captures(spark, sf_dir)


def _scenes(photos: DataFrame) -> DataFrame:
    return stack.stack_scenes(photos, CONFIG.burst_threshold_secs, CONFIG.phash_similarity_threshold, BY)


def _reviewed(spark: SparkSession, sf_dir: str):
    """Photos, a cull of them, and the overrides with what follows from them."""
    photos = _photos(spark, sf_dir)
    done = cull_scored(photos, CONFIG, BY)
    over = standin.overrides(photos)
    return photos, done, over, review.effective_keepers(done.scenes, done.keepers, over)


def _r(c: str) -> Column:
    return F.round(c, 6).alias(c)


def filter_raw_files(spark, sf_dir):
    return files.filter_raw_files(_photos(spark, sf_dir).select("image_id", "file_path"))


def filter_jpegs(spark, sf_dir):
    paths = _photos(spark, sf_dir).select("image_id", "file_path", (F.col("image_id") % 4).alias("length"))
    return files.filter_jpegs(paths).select("image_id", "file_name", "ts_ms")


def assign_image_ids(spark, sf_dir):
    return files.assign_image_ids(_photos(spark, sf_dir).select("file_path"))


def pick_preview(spark, sf_dir):
    picked = previews.pick_preview(standin.previews(_photos(spark, sf_dir)))
    return picked.select("image_id", F.col("preview_data").cast("string").alias("preview"))


def preview_counts(spark, sf_dir):
    return previews.preview_counts(standin.previews(_photos(spark, sf_dir)))


def parse_exif(spark, sf_dir):
    parsed = exif.parse_exif_json(standin.exif(_photos(spark, sf_dir))).drop("json")
    return parsed.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("focal_length_mm", "aperture")})


def image_summary(spark, sf_dir):
    photos = _photos(spark, sf_dir).select("image_id", "file_path", F.lit("Acme").alias("camera_make"), F.lit(2.8).alias("aperture"))
    return previews.image_summary(photos, "/previews/")


def time_clusters(spark, sf_dir):
    return stack.time_clusters(_photos(spark, sf_dir).select("shoot_id", *stack.ORDER), CONFIG.burst_threshold_secs, BY).select("shoot_id", "image_id", "cluster")


def time_clusters_stitched(spark, sf_dir):
    return stack.time_clusters(_photos(spark, sf_dir).select("shoot_id", *stack.ORDER), CONFIG.burst_threshold_secs, BY).select("shoot_id", "image_id", "cluster")


def time_clusters_global(spark, sf_dir):
    return stack.time_clusters_global(_photos(spark, sf_dir).select(*stack.ORDER), GLOBAL_GAP).select("image_id", "cluster")


def singleton_scenes(spark, sf_dir):
    return stack.singleton_scenes(_photos(spark, sf_dir)).select("image_id")


def hamming(spark, sf_dir):
    p = _photos(spark, sf_dir).filter(F.col("phash").isNotNull())
    a, b = p.select("image_id", "phash"), p.select((F.col("image_id") - 1).alias("image_id"), F.col("phash").alias("other"))
    return a.join(b, "image_id").select("image_id", stack.hamming_distance(F.col("phash"), F.col("other")).cast("long").alias("distance"))


def split_by_phash(spark, sf_dir):
    clusters = stack.time_clusters(_photos(spark, sf_dir), CONFIG.burst_threshold_secs, BY)
    return stack.split_by_phash(clusters, CONFIG.phash_similarity_threshold, BY).select("shoot_id", "cluster", "image_id", "subgroup")


def stack_scenes(spark, sf_dir):
    return _scenes(_photos(spark, sf_dir))


def scene_arrays(spark, sf_dir):
    arrays = stack.scene_arrays(_scenes(_photos(spark, sf_dir)))
    return arrays.select("scene_id", F.array_join(F.col("image_ids").cast("array<string>"), ",").alias("image_ids"))


def scene_stats(spark, sf_dir):
    return stack.scene_stats(_scenes(_photos(spark, sf_dir)))


def pick_keeper(spark, sf_dir):
    photos = _photos(spark, sf_dir).withColumn("pos_in_scene", F.col("image_id"))
    return select.pick_keeper(photos, BY)


def select_keepers(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    return select.select_keepers(_scenes(photos), photos)


def assign_verdicts(spark, sf_dir):
    return cull_scored(_photos(spark, sf_dir), CONFIG, BY).verdicts.select("image_id", "verdict", "reject_reason")


def cull_totals(spark, sf_dir):
    return cull_scored(_photos(spark, sf_dir), CONFIG, BY).totals


def verdicts_by_shoot(spark, sf_dir):
    """How each shoot came out."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    verdicts = cull_scored(_photos(spark, sf_dir), CONFIG, BY).verdicts
    return verdicts.groupBy("shoot_id").agg(F.count(F.lit(1)).alias("images"), of("keeper").alias("keepers"), of("reject").alias("rejects"), of("unrated").alias("unrated"))


def verdict_label(spark, sf_dir):
    verdicts = cull_scored(_photos(spark, sf_dir), CONFIG, BY).verdicts
    told = verdicts.withColumn("json", export.verdict_json(F.col("verdict"), F.col("reject_reason")))
    return told.select("image_id", "json", review.verdict_label(F.col("json")).alias("label"))


def effective_verdicts(spark, sf_dir):
    photos, done, over, _ = _reviewed(spark, sf_dir)
    return review.effective_verdicts(photos, done.verdicts, over)


def effective_keepers(spark, sf_dir):
    return _reviewed(spark, sf_dir)[3]


def override_stats(spark, sf_dir):
    photos, done, over, _ = _reviewed(spark, sf_dir)
    return review.override_stats(review.effective_verdicts(photos, done.verdicts, over), over)


def rank_scene_images(spark, sf_dir):
    _, done, _, effective = _reviewed(spark, sf_dir)
    return review.rank_scene_images(done.scenes, done.verdicts, effective)


def _filtered(mode: str):
    def query(spark, sf_dir):
        photos, done, over, effective = _reviewed(spark, sf_dir)
        return review.filter_scenes(mode, done.scenes, effective, review.effective_verdicts(photos, done.verdicts, over))

    return query


def scene_cards(spark, sf_dir):
    photos, done, _, effective = _reviewed(spark, sf_dir)
    return review.scene_cards(done.scenes, photos, done.verdicts, effective)


def fold_review_actions(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    done = cull_scored(photos, CONFIG, BY)
    return review.fold_review_actions(standin.actions(photos), done.scenes, done.verdicts, done.keepers)


def focus_point(spark, sf_dir):
    photos = _photos(spark, sf_dir).withColumns({"preview_width": (F.col("image_id") % 700 + 1).cast("int"), "preview_height": (F.col("image_id") % 500 + 1).cast("int")})
    box = F.struct(*[(F.col("sharpness_score") * k).alias(n) for n, k in (("x", 1.0), ("y", 2.0), ("width", 3.0), ("height", 4.0))])
    boxes = photos.select("image_id", F.when(F.col("has_face"), box).alias("face_bbox"))
    return review.focus_point(photos, boxes).select("image_id", _r("focus_x"), _r("focus_y"))


def export_entries(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    return export.export_entries(photos, standin.export_requests(photos))


def xmp_path(spark, sf_dir):
    return _photos(spark, sf_dir).select("image_id", export.xmp_path(F.col("file_path")).alias("xmp_path"))


def xmp_sidecars(spark, sf_dir):
    """The sidecars as one table of paths and contents; photos of ten to a file name collide."""
    photos = _photos(spark, sf_dir)
    coarse = photos.withColumn("file_path", F.concat(F.lit("/shoots/IMG_"), F.floor(F.col("image_id") / 10).cast("string"), F.lit(".CR2")))
    return export.sidecars(export.export_entries(coarse, standin.export_requests(photos)))


def _export_status(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    entries = export.export_entries(photos, standin.export_requests(photos))
    told = F.when(F.col("verdict") == "unrated", "skipped").when(F.col("image_id") % 1009 == 0, "error").otherwise("written")
    path = export.xmp_path(F.col("raw_file_path")).alias("xmp_path")
    status = entries.select(path, told.alias("status"), F.lit("denied").alias("error"), F.lit(1).cast("long").alias("n"))
    return status


def export_summary(spark, sf_dir):
    return export.export_summary(_export_status(spark, sf_dir))


def export_errors(spark, sf_dir):
    return export.export_errors(_export_status(spark, sf_dir))


def scene_report(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    done = cull_scored(photos, CONFIG, BY)
    return report.scene_report(done.scenes, done.keepers, photos)


def score_report(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    verdicts = cull_scored(photos, CONFIG, BY).verdicts
    ear = F.when(F.col("image_id") % 3 != 0, F.col("image_id") % 500 / F.lit(1000.0))
    return report.score_report(verdicts.withColumn("eye_aspect_ratio", ear), photos)


def _sized(spark, sf_dir):
    raw = standin.yolo_raw(spark, sf_dir)
    at = lambda i: F.get("raw", F.lit(i))
    box = F.struct((at(0) - 50).alias("x"), (at(1) - 50).alias("y"), at(2).alias("width"), at(3).alias("height"))
    return raw.select("vec_id", box.alias("box"), (F.col("vec_id") % 300 + 1).alias("w"), (F.col("vec_id") % 200 + 1).alias("h"))


def regions(spark, sf_dir):
    """Eye, centre and face regions as text; none: empty."""
    w, h, box = F.col("w"), F.col("h"), F.col("box")
    text = lambda c: F.coalesce(F.concat_ws(",", c["x"], c["y"], c["width"], c["height"]), F.lit(""))
    return _sized(spark, sf_dir).select(
        "vec_id", text(vision.eye_region(box, w, h)).alias("eye"), text(vision.center_region(w, h)).alias("center"), text(vision.face_crop(box, w, h)).alias("face")
    )


def _detections(spark, sf_dir):
    return standin.yolo_raw(spark, sf_dir).select("vec_id", vision.decode_yolo(F.col("raw"), 5, standin.CELLS, 0.1).alias("d"))


def decode_yolo(spark, sf_dir):
    rows = _detections(spark, sf_dir).select("vec_id", F.posexplode("d").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), "x.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "w", "h", "confidence")})


def nms(spark, sf_dir):
    kept = _detections(spark, sf_dir).select("vec_id", vision.non_max_suppression(F.col("d"), CONFIG.nms_iou_threshold).alias("d"))
    return kept.select("vec_id", F.posexplode("d").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x.confidence", 6).alias("confidence"))


def nms_rows(spark, sf_dir):
    """The same suppression over a table of detections, a row each."""
    rows = _detections(spark, sf_dir).select("vec_id", F.posexplode("d").alias("place", "x")).select("vec_id", "place", "x.*")
    return suppress(rows, "vec_id", CONFIG.nms_iou_threshold, ["place"]).select("vec_id", F.round("confidence", 6).alias("confidence"))


def iou(spark, sf_dir):
    d = _detections(spark, sf_dir).filter(F.size("d") >= 2)
    return d.select("vec_id", F.round(vision.iou(F.get("d", F.lit(0)), F.get("d", F.lit(1))), 6).alias("iou"))


def original_coords(spark, sf_dir):
    """The primary face in an image of 1,000 x 600 pixels, and whether there is one."""
    face = vision.primary_face(F.col("d"))
    t = vision.letterbox_transform(F.lit(1000), F.lit(600))
    box = _detections(spark, sf_dir).select("vec_id", face.isNotNull().alias("has_face"), vision.to_original_coords(face, t).alias("b"), face.alias("f"))
    return box.select("vec_id", "has_face", *[F.when(F.col("f").isNotNull(), F.round(f"b.{c}", 6)).alias(c) for c in ("x", "y", "width", "height")])


def detect_blink(spark, sf_dir):
    b = standin.landmarks(spark, sf_dir).select("vec_id", F.size(vision.landmarks(F.col("raw"))).cast("long").alias("n_landmarks"), vision.detect_blink(F.col("raw"), 1.0).alias("b"))
    return b.select("vec_id", "n_landmarks", "b.blink_detected", *[F.round(f"b.{c}", 6).alias(c) for c in ("right_ear", "left_ear", "average_ear")])


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    path = f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def preview_dimensions(spark, sf_dir):
    return previews.preview_dimensions(standin.jpeg_headers(_photos(spark, sf_dir))).select("image_id", "preview_width", "preview_height")


def export_xmp(spark, sf_dir):
    """Sidecars as files, read back: those of ten photos share a name. The photos lie in folders of up to 10,000."""
    photos, folder = _photos(spark, sf_dir), _folder(spark, "sidecars")
    at = F.concat(F.lit(folder + "/"), F.floor(F.col("image_id") / FOLDER_HOLDS))
    coarse = photos.withColumn("file_path", F.concat(at, F.lit("/IMG_"), F.floor(F.col("image_id") / 10).cast("string"), F.lit(".CR2")))
    export.export_xmp(coarse, standin.export_requests(photos), fan_out=True)
    found = files.read_bytes(files.list_folders(spark, photos.select(at.alias("folder")).distinct()))
    return found.select("file_name", F.sha2("content", 256).alias("content_sha256"))


def export_run(spark, sf_dir):
    """The counts of a run that writes sidecars, observed as it writes."""
    photos, folder = _photos(spark, sf_dir), _folder(spark, "sidecars")
    coarse = photos.withColumn("file_path", F.concat(F.lit(folder + "/IMG_"), F.floor(F.col("image_id") / 10).cast("string"), F.lit(".CR2")))
    done = export.run_export(coarse, standin.export_requests(photos))
    return spark.createDataFrame([(done.files_written, done.files_skipped, done.n_errors)], "files_written long, files_skipped long, n_errors long")


def cull_run(spark, sf_dir):
    """The totals of a run that writes scenes, keepers and verdicts, observed as it writes, beside what stands in the folder."""
    done = run_cull(_photos(spark, sf_dir), CONFIG, _folder(spark, "cull"), BY)
    blinks = done.cull.verdicts.agg(F.count_if(F.col("reject_reason") == "blink").alias("blinks"))
    return done.cull.totals.withColumn("_one", F.lit(1)).join(blinks.withColumn("_one", F.lit(1)), "_one").drop("_one")


def manifest_scores(spark, sf_dir):
    """A manifest for each shoot, read back: its scores."""
    photos = _photos(spark, sf_dir)
    done = cull_scored(photos, CONFIG, BY)
    told = done.verdicts.select("shoot_id", "image_id", "sharpness_score", "has_face", "blink_detected", "verdict", "reject_reason")
    documents = export.manifests(done.scenes, done.keepers, told, BY, 1.5)
    return export.parse_manifest(documents)[1].select("shoot_id", "image_id", _r("sharpness_score"), "has_face", "blink_detected", "verdict")


def manifest_scenes(spark, sf_dir):
    photos = _photos(spark, sf_dir)
    done = cull_scored(photos, CONFIG, BY)
    documents = export.manifests(done.scenes, done.keepers, done.verdicts.select("shoot_id", "image_id", "verdict", "reject_reason"), BY, 1.5)
    return export.parse_manifest(documents)[0]


def manifest_totals(spark, sf_dir):
    """Totals of each shoot's manifest, and what a photo took."""
    photos = _photos(spark, sf_dir)
    done = cull_scored(photos, CONFIG, BY)
    documents = export.manifests(done.scenes, done.keepers, done.verdicts.select("shoot_id", "image_id", "verdict", "reject_reason"), BY, 1.5)
    totals = export.parse_manifest(documents)[2]
    return totals.withColumn("ms_per_image", F.round(report.ms_per_image(F.col("processing_time_secs"), F.col("total_images")), 6))


def _extracted(photos: DataFrame) -> DataFrame:
    """What a reader took out of photo files: previews in three fields, some empty or missing, and EXIF JSON."""
    held = lambda every, data: F.when(F.col("image_id") % every == 0, data)
    heads, fields = standin.jpeg_headers(photos), standin.exif(photos)
    parts = photos.select("image_id", "file_path").join(heads, "image_id").join(fields, "image_id")
    return parts.select(
        "file_path", F.coalesce(held(3, F.col("preview_data")), F.lit("").cast("binary")).alias("jpg_from_raw"),
        held(2, F.concat(F.lit("P"), "image_id").cast("binary")).alias("preview_image"), F.coalesce(held(5, F.concat(F.lit("O"), "image_id")), F.lit("")).cast("binary").alias("other_image"), "json",
    )


def _document(spark, sf_dir):
    """The whole cull as one manifest document, written and read back: scenes, scores, totals."""
    done = cull_scored(_photos(spark, sf_dir), CONFIG, BY)
    told = done.verdicts.select("image_id", "sharpness_score", "has_face", "blink_detected", "verdict", "reject_reason")
    path = _folder(spark, "manifest") + "/manifest.json"
    export.write_manifest_document(path, done.scenes, done.keepers, told, 1.5)
    return export.read_manifest(spark, path)


def manifest_document(spark, sf_dir):
    scenes, scores, _ = _document(spark, sf_dir)
    return scenes.join(scores, "image_id").select("scene_id", "pos_in_scene", "image_id", "keeper_id", _r("sharpness_score"), "has_face", "blink_detected", "verdict")


def manifest_document_totals(spark, sf_dir):
    return _document(spark, sf_dir)[2]


def ingested_photos(spark, sf_dir):
    """Paths and what was read from the files to numbered photos, with their previews as files, read back."""
    photos = _photos(spark, sf_dir)
    done = ingest_photos(photos.select("file_path"), _extracted(photos), _folder(spark, "ingested"))
    found = files.read_bytes(done.photos.withColumn("photo", F.col("file_path")).withColumn("file_path", F.col("preview_path")))
    return found.select(
        "image_id", F.col("photo").alias("file_path"), "file_name", "ts_ms", "camera_make", "camera_model", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("focal_length_mm", "aperture")],
        "iso", "preview_width", "preview_height", F.sha2("content", 256).alias("preview_sha256"), F.lit(done.n_kept).cast("long").alias("n_kept"), F.lit(done.n_skipped).cast("long").alias("n_skipped"),
    )


def list_files(spark, sf_dir):
    """The photos as files named in the manner of cameras, some hidden, in folders of up to 10,000 as cameras make them, and the tree
    listed again: whole URIs, and those of some kinds. The number of the folder is left out of the path told."""
    folder = _folder(spark, "tree")
    photos = _photos(spark, sf_dir).filter("ts_ms IS NOT NULL")
    name = F.concat(F.element_at(F.array(F.lit("_MG_"), F.lit("."), F.lit("IMG ")), (F.col("image_id") % 3 + 1).cast("int")), "image_id", F.substring_index("file_path", "IMG_", -1))
    path = F.concat(F.lit(folder + "/"), F.floor(F.col("image_id") / FOLDER_HOLDS), F.lit("/"), name)
    dealt = photos.repartitionByRange(work_parts(spark), "image_id")  # a task has its own folders
    write_files(dealt.select(path.alias("path"), F.repeat(F.lit("x"), (F.col("image_id") % 7).cast("int")).alias("content")), fan_out=True)
    found = files.filter_raw_files(written(files.list_files(spark, folder, 1), "listed"))  # once, not again for the sample of its order
    return found.select(F.regexp_replace(F.replace("file_path", F.lit(folder), F.lit("top")), "^top/[0-9]+/", "top/").alias("file_path"), "file_name", "length")


def _sha(c: Column) -> Column:
    return F.sha2(F.lower(F.hex(c)), 256)


def decoded_images(spark, sf_dir):
    """Photos written as files, read by the image source, as gray pixels."""
    folder = _folder(spark, "previews")
    done = previews_written(standin.bitmaps(spark, sf_dir), folder)
    found = vision.decode_images(spark, folder).join(done, "image_id")
    return found.select("image_id", "error", "image.width", "image.height", _sha(vision.to_gray("image")).alias("gray_sha256"))


def previews_written(df: DataFrame, folder: str) -> DataFrame:
    return export.write_previews(df, folder).select("image_id", "error")


def image_gray(spark, sf_dir):
    return standin.patches(spark, sf_dir).select("image_id", _sha(vision.to_gray("image")).alias("gray_sha256"))


def image_focus(spark, sf_dir):
    """Of the whole photo: Laplacian variance and noise."""
    p = standin.patches(spark, sf_dir)
    measured = p.select("image_id", vision.variance_of_laplacian("image").alias("laplacian_variance"), vision.estimate_noise("image").alias("noise"))
    return measured.select("image_id", _r("laplacian_variance"), _r("noise"))


def image_hash(spark, sf_dir):
    return standin.patches(spark, sf_dir).select("image_id", vision.perceptual_hash("image").alias("phash"))


def image_resize(spark, sf_dir):
    return standin.patches(spark, sf_dir).select("image_id", _sha(vision.resize_exact("image", 2 * standin.WIDE, standin.HIGH)).alias("rgb_sha256"))


def image_letterbox(spark, sf_dir):
    t = vision.letterbox_transform(F.col("image.width"), F.col("image.height"), 50, standin.HIGH)
    return standin.patches(spark, sf_dir).select("image_id", _sha(vision.letterbox("image", 50, standin.HIGH)).alias("rgb_sha256"), t["scale"].alias("scale"), t["pad_x"].alias("pad_x"))


def image_tensor(spark, sf_dir):
    """Some values of each photo's tensor, channel by channel."""
    tensor = vision.to_tensor("image", imaging.IMAGENET_MEAN, imaging.IMAGENET_STD)
    at = lambda n: F.get("t", F.lit(n)).cast("double")
    size = standin.WIDE * standin.HIGH
    return standin.patches(spark, sf_dir).select("image_id", tensor.alias("t")).select("image_id", F.size("t").cast("long").alias("n"), at(0).alias("red"), at(size + 45).alias("green"), at(3 * size - 1).alias("blue"))


def image_tensor_digest(spark, sf_dir):
    """All values of each photo's tensor, in its order, with the weights of their places: sums that any wrong value or place changes."""
    out = standin.patches(spark, sf_dir)
    for layout in ("NCHW", "NHWC"):
        tensor = vision.to_tensor("image", imaging.IMAGENET_MEAN, imaging.IMAGENET_STD, layout)
        placed = F.aggregate(F.transform("t", lambda x, i: F.round(x.cast("double") * 1000).cast("long") * (i % 1009 + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
        kept = F.struct(*[c for c in out.columns], placed.alias(layout.lower()))
        out = out.withColumn("t", tensor).select(F.inline(F.array(kept)))  # one tensor at a time: it ends here, and the photo goes on
    return out.drop("image")


def decode_yolo_classes(spark, sf_dir):
    """The detector outputs read as six rows of ten columns: two classes, the better one counts."""
    d = standin.yolo_raw(spark, sf_dir).select("vec_id", vision.decode_yolo(F.col("raw"), 6, 10, 0.1).alias("d"))
    rows = d.select("vec_id", F.posexplode("d").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), "x.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "w", "h", "confidence")})


def score_sharpness(spark, sf_dir):
    """The middle of each photo."""
    placed = standin.patches(spark, sf_dir).withColumn("face_bbox", F.lit(None).cast("struct<x:double,y:double,width:double,height:double>"))
    return vision.score_sharpness(placed).select("image_id", _r("sharpness_score"), _r("raw_variance"), _r("noise_estimate"), "scored_region")


def model_scores(spark, sf_dir):
    """A model over tensors of a column: two weighted sums of each vector."""

    def linear():
        w = np.stack([np.arange(64) % 5 - 2.0, np.arange(64) % 3 + 1.0])
        return lambda x: x.astype(np.float64) @ w.T

    score = vision.score_with_model(linear, T.ArrayType(T.DoubleType()), [64])
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", score(F.col("embedding")).alias("s"))
    return e.select("vec_id", F.round(F.get("s", F.lit(0)), 6).alias("a"), F.round(F.get("s", F.lit(1)), 6).alias("b"))


def _detector():
    """One face; sure of it where the first pixel is red enough."""
    return lambda x: np.stack([[320, 320, 520, 310, 0.9 if t[0, 0, 53] > 0.3 else 0.1] for t in x]).astype(np.float32)


def _mesher():
    """Closed eyes where the first pixel of the face is red enough."""

    def landmarks(height: float) -> np.ndarray:
        out = np.zeros((vision.MESH_POINTS, 3), np.float32)
        for eye in (vision.RIGHT_EYE, vision.LEFT_EYE):
            out[list(eye), :2] = [(0, 0), (1, height), (2, height), (3, 0), (2, -height), (1, -height)]
        return out.ravel()

    return lambda x: np.stack([landmarks(0.125 if t[0, 0, 0] > 0.5 else 1.0) for t in x])


def _analyzed(spark, sf_dir):
    return analyze_images(standin.patches(spark, sf_dir), CONFIG, _detector, 5, 1, _mesher)


def analyzed_images(spark, sf_dir):
    """Faces, sharpness and blinks of each photo in one analysis."""
    box = [F.round(f"face_bbox.{c}", 6).alias(f"face_{c}") for c in ("x", "y", "width", "height")]
    return _analyzed(spark, sf_dir).select("image_id", _r("sharpness_score"), "has_face", *box, "blink_detected", _r("eye_aspect_ratio"), "phash")


def decoded_jpegs(spark, sf_dir):
    """The same with JPEG files."""
    folder = _folder(spark, "previews")
    done = previews_written(standin.jpegs(spark, sf_dir), folder)
    found = vision.decode_images(spark, folder).join(done, "image_id")
    return found.select("image_id", "error", "image.width", "image.height", _sha(vision.to_gray("image")).alias("gray_sha256"))


def analyzed_previews(spark, sf_dir):
    """The analysis from JPEG bytes to slim rows, decoded in the worker."""
    found = analyze_previews(standin.jpegs(spark, sf_dir), CONFIG, _detector, 5, 1, _mesher)
    box = [F.round(f"face_bbox.{c}", 6).alias(f"face_{c}") for c in ("x", "y", "width", "height")]
    return found.select("image_id", _r("sharpness_score"), "has_face", *box, "blink_detected", _r("eye_aspect_ratio"), "phash")


def culled_previews(spark, sf_dir):
    """JPEG bytes to verdicts."""
    at = F.col("image_id")
    photos = standin.jpegs(spark, sf_dir).select("image_id", F.floor(at / 20).alias("shoot_id"), F.when(at % 17 != 0, at * 1500 + F.floor(at / 5) * 20_000_000).alias("ts_ms"))
    features = analyze_previews(standin.jpegs(spark, sf_dir), CONFIG, _detector, 5, 1, _mesher)
    return cull(photos, features, CONFIG, BY).verdicts.select("image_id", "verdict", "reject_reason")


def culled_images(spark, sf_dir):
    """Photos to verdicts: analysed, stacked by shoots of 20, keepers chosen."""
    at = F.col("image_id")
    photos = standin.patches(spark, sf_dir).select("image_id", F.floor(at / 20).alias("shoot_id"), F.when(at % 17 != 0, at * 1500 + F.floor(at / 5) * 20_000_000).alias("ts_ms"))
    return cull(photos, _analyzed(spark, sf_dir), CONFIG, BY).verdicts.select("image_id", "verdict", "reject_reason")


QUERIES = {
    f.__name__: f
    for f in (
        verdicts_by_shoot, filter_raw_files, filter_jpegs, assign_image_ids, pick_preview, preview_counts, parse_exif, image_summary,
        time_clusters, time_clusters_stitched, time_clusters_global, singleton_scenes, hamming, split_by_phash, stack_scenes,
        scene_arrays, scene_stats, pick_keeper, select_keepers, assign_verdicts, cull_totals, verdict_label, effective_verdicts,
        effective_keepers, override_stats, rank_scene_images, scene_cards, fold_review_actions, focus_point, export_entries, xmp_path,
        xmp_sidecars, export_summary, scene_report, score_report, regions, decode_yolo, nms, iou, original_coords, detect_blink,
        export_errors, export_xmp, manifest_scores, manifest_scenes, manifest_totals, preview_dimensions, decoded_images, image_gray,
        image_focus, image_hash, image_resize, image_letterbox, image_tensor, score_sharpness, model_scores, analyzed_images, culled_images,
        decoded_jpegs, nms_rows, manifest_document, manifest_document_totals, analyzed_previews, culled_previews, ingested_photos, list_files,
        image_tensor_digest, decode_yolo_classes, cull_run, export_run,
    )
} | {f"filter_scenes_{mode}": _filtered(mode) for mode in ("all", "keepers", "rejects")}
