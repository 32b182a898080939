"""Pixels, boxes, landmarks, and the analysis of decoded images."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.config import CullConfig
from burstpick.functions import imaging, jpeg, vision
from burstpick.jobs.cull import analyze_images, analyze_previews, cull
from burstpick.operators.suppress import suppress

X = np.arange(200)
SHARP = np.tile(np.where(X % 4 < 2, 0, 255), (200, 1)).astype(np.uint8)
BLURRY = np.tile((X / 200 * 255).astype(int), (200, 1)).astype(np.uint8)
FLAT = np.full((200, 200), 128, np.uint8)


@pytest.mark.parametrize(
    "gray,variance,noise,score",
    [(SHARP, 65025.0, 189.0315, 343.990287), (BLURRY, 0.545455, 8.1543, 0.066310), (FLAT, 0.0, 0.1, 0.0)],
)
def test_focus(gray, variance, noise, score):
    assert imaging.variance_of_laplacian(gray) == pytest.approx(variance, abs=1e-6)
    assert imaging.estimate_noise(gray) == pytest.approx(noise, abs=1e-6)
    assert imaging.crop_sharpness(gray, 50, 50, 100, 100)[0] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("side,noise", [(2, 1.0), (15, 1.0), (16, 1.0), (17, 0.1), (32, 0.1), (33, 0.1)])
def test_small_images(side, noise):
    img = np.full((side, side), 7, np.uint8)
    assert imaging.estimate_noise(img) == noise
    assert imaging.variance_of_laplacian(img) == 0.0


def test_last_full_patch_is_left_out():
    img = np.random.default_rng(0).integers(0, 255, (32, 32)).astype(np.uint8)
    img[16:, 16:] = 9  # flat, but it touches the edge
    assert imaging.estimate_noise(img) > 0.1


def test_hash():
    rng = np.random.default_rng(1)
    img = rng.integers(40, 200, (64, 64)).astype(np.uint8)
    bits = lambda a, b: bin(imaging.perceptual_hash(a) ^ imaging.perceptual_hash(b)).count("1")
    assert bits(img, img) == 0
    assert bits(img, img + 3) <= 4
    assert bits(np.tile(np.linspace(0, 255, 64), (64, 1)).astype(np.uint8), np.tile(np.linspace(255, 0, 64), (64, 1)).astype(np.uint8)) >= 15
    assert 0 <= imaging.perceptual_hash(img) < 1 << 40


def test_letterbox_and_tensor():
    canvas, t = imaging.letterbox(np.full((100, 200, 3), 50, np.uint8), 640, 640)
    assert t == (3.2, 0.0, 160.0, 200.0, 100.0)
    assert (canvas[:160] == 114).all() and (canvas[160:480] == 50).all()
    x = imaging.to_tensor(canvas, imaging.IMAGENET_MEAN, imaging.IMAGENET_STD)
    assert x.shape == (1, 3, 640, 640) and x[0, 0, 0, 0] == pytest.approx((114 / 255 - 0.485) / 0.229)
    assert imaging.to_tensor(canvas, layout="NHWC").shape == (1, 640, 640, 3)
    assert (imaging.resize_exact(np.full((7, 9, 3), 33, np.uint8), 20, 5) == 33).all()


def test_gray():
    assert imaging.to_gray(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], np.uint8)).tolist() == [[54, 182, 18, 255]]


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()["c"]


def box(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "width"), (h, "height"))])


@pytest.mark.parametrize(
    "b,want",
    [((10, 20, 100, 100), (20, 20, 80, 40)), ((-50, -50, 100, 100), (10, 0, 80, 40)), ((190, 190, 50, 50), None), ((0, 0, 5, 5), (0, 0, 16, 16)), ((500, 0, 10, 10), None)],
)
def test_eye_region(spark, b, want):
    got = one(spark, vision.eye_region(box(*b), F.lit(200), F.lit(200)))
    assert (tuple(got) if got else None) == want


def test_eye_region_agrees_with_pixels(spark):
    rng = np.random.default_rng(3)
    gray = rng.integers(0, 255, (90, 120)).astype(np.uint8)
    rgb = np.repeat(gray[..., None], 3, 2)
    for _ in range(12):
        b = [float(v) for v in rng.uniform(-40, 150, 4)]
        r = one(spark, F.coalesce(vision.eye_region(box(*b), F.lit(120), F.lit(90)), vision.center_region(F.lit(120), F.lit(90))))
        got = vision._focus(rgb, dict(zip(("x", "y", "width", "height"), b, strict=True)))
        assert got[0] == pytest.approx(imaging.crop_sharpness(imaging.to_gray(rgb), *r)[0])


def test_face_crop(spark):
    assert tuple(one(spark, vision.face_crop(box(100, 100, 40, 40), F.lit(200), F.lit(130)))) == (90, 90, 60, 40)
    assert tuple(one(spark, vision.face_crop(box(900, 900, 4, 4), F.lit(200), F.lit(130))))[2:] == (1, 1)


def test_detections(spark):
    out = [10.0, 11.0, 300.0, 10.0, 10.0, 300.0, 20.0, 20.0, 20.0, 20.0, 20.0, 20.0, 0.6, 0.9, 0.7]
    df = spark.createDataFrame([(out,)], "raw array<float>")
    d = vision.decode_yolo(F.col("raw"), 5, 3, 0.5)
    assert [round(x["confidence"], 4) for x in df.select(d).first()[0]] == [0.9, 0.7, 0.6]
    kept = df.select(vision.non_max_suppression(d)).first()[0]
    assert [round(x["confidence"], 4) for x in kept] == [0.9, 0.7]
    rows = df.select(F.lit(1).alias("k"), F.inline(d))
    assert sorted(round(r["confidence"], 4) for r in suppress(rows, "k").collect()) == [0.7, 0.9]
    assert df.select(vision.decode_yolo(F.col("raw"), 4, 3, 0.5)).first()[0] == []
    two = df.select(vision.decode_yolo(F.concat("raw", F.array(*[F.lit(v).cast("float") for v in (0.95, 0.1, 0.1)])), 6, 3, 0.5)).first()[0]
    assert round(two[0]["confidence"], 4) == 0.95


def test_original_coords(spark):
    t = vision.letterbox_transform(F.lit(200), F.lit(100))
    d = F.struct(*[F.lit(v).alias(n) for v, n in ((320.0, "cx"), (320.0, "cy"), (64.0, "w"), (64.0, "h"), (0.9, "confidence"))])
    assert [round(v, 6) for v in one(spark, vision.to_original_coords(d, t))] == [90.0, 40.0, 20.0, 20.0]


def mesh(eyes, stride=3):
    raw = [0.0] * (468 * stride)
    for points, height in zip((vision.RIGHT_EYE, vision.LEFT_EYE), eyes, strict=True):
        for p, (x, y) in zip(points, ((0, 0), (1, height), (2, height), (3, 0), (2, -height), (1, -height)), strict=True):
            raw[p * stride], raw[p * stride + 1] = float(x), float(y)
    return raw


@pytest.mark.parametrize("stride", [2, 3])
@pytest.mark.parametrize("eyes,blink,ears", [((1, 1), False, (0.666667, 0.666667)), ((0.1, 0.1), True, (0.066667, 0.066667)), ((0.225, 0.45), False, (0.15, 0.3)), ((0.225, 0.18), True, (0.15, 0.12))])
def test_blink(spark, eyes, blink, ears, stride):
    got = spark.createDataFrame([(mesh(eyes, stride),)], "raw array<float>").select(vision.detect_blink(F.col("raw"))).first()[0]
    assert got["blink_detected"] == blink
    assert (round(got["right_ear"], 6), round(got["left_ear"], 6)) == ears


def test_too_few_landmarks(spark):
    got = spark.createDataFrame([([0.0] * 900,)], "raw array<float>").select(vision.detect_blink(F.col("raw"))).first()[0]
    assert tuple(got) == (False, 1.0, 1.0, 1.0)


def write_jpeg(spark, path, gray):
    jvm = spark._jvm
    h, w = gray.shape
    img = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            v = int(gray[y, x])
            img.setRGB(x, y, v << 16 | v << 8 | v)
    assert jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(path)))


def python_nodes(plan):
    return sum(plan.count(x) for x in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "BatchEvalPython"))


def jpeg_of(spark, rgb, quality=0.9):
    """``rgb`` as a JPEG file and as the pixels that the JVM decodes from it."""
    jvm = spark._jvm
    h, w = rgb.shape[:2]
    img = jvm.java.awt.image.BufferedImage(w, h, 1 if rgb.ndim == 3 else 10)
    for y in range(h):
        for x in range(w):
            if rgb.ndim == 3:
                r, g, b = (int(v) for v in rgb[y, x])
                img.setRGB(x, y, r << 16 | g << 8 | b)
            else:  # setRGB would take gray as linear light
                img.getRaster().setSample(x, y, 0, int(rgb[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), how)
    writer.dispose()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    if rgb.ndim == 2:
        samples = [[back.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)]
        return data, np.repeat(np.array(samples)[..., None], 3, 2)
    packed = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return data, np.stack([packed >> 16, packed >> 8 & 255, packed & 255], 2)


@pytest.mark.parametrize("shape", [(24, 40, 3), (19, 33, 3), (17, 21), (1, 1, 3)])
def test_jpeg(spark, shape):
    """Files of the JVM's encoder (gray and colour with halved colour planes): pixels as its decoder has them, but for its rounding
    and its smoother colours."""
    rng = np.random.default_rng(sum(shape))
    y, x = np.mgrid[: shape[0], : shape[1]]
    smooth = np.stack([128 + 100 * np.sin(y / 9), 128 + 90 * np.cos(x / 11), (5 * x + 3 * y) % 256 if len(shape) < 3 else 100 + x], 2)
    rgb = smooth.astype(np.uint8) if len(shape) == 3 else rng.integers(0, 255, shape).astype(np.uint8)
    data, want = jpeg_of(spark, rgb)
    got = jpeg.decode_jpeg(data)
    assert got.shape == want.shape == (*shape[:2], 3)
    apart = np.abs(got.astype(int) - want)
    assert apart.max() <= (1 if len(shape) == 2 else 12) and apart.mean() < 2
    assert imaging.jpeg_size(data) == (shape[1], shape[0])


def test_jpeg_damaged(spark):
    data, _ = jpeg_of(spark, np.full((20, 20, 3), 77, np.uint8))
    for bad in (None, b"", b"\xff\xd8", b"GIF89a", data[:100], data.replace(b"\xff\xc0", b"\xff\xc2")):
        assert jpeg.decode_jpeg(bad) is None


def test_bytes_to_features(spark):
    """Compressed bytes go to one Python node, and no pixels are in the plan; the result does not depend on the buffer."""
    rng = np.random.default_rng(8)
    rows = [(n, bytearray(jpeg_of(spark, rng.integers(0, 255, (24, 40)).astype(np.uint8))[0])) for n in range(5)] + [(10**17, b"broken"), (7, None)]
    previews = spark.createDataFrame(rows, "image_id long, preview_data binary").repartition(2)

    def detector():
        return lambda x: np.tile(np.array([320, 320, 500, 300, 0.9], np.float32), (len(x), 1))

    closed = np.array(mesh((0.1, 0.1)), np.float32)

    def mesher():
        return lambda x: np.tile(closed, (len(x), 1))

    found = {}
    for batch_size in (1, 3, 16):
        features = analyze_previews(previews, CullConfig(), detector, 5, 1, mesher, batch_size)
        plan = features._jdf.queryExecution().executedPlan().toString()
        assert python_nodes(plan) == 1 and "image#" not in plan
        found[batch_size] = sorted(features.collect(), key=lambda r: r["image_id"])
    assert found[1] == found[3] == found[16]
    got = {r["image_id"]: r for r in found[1]}
    assert all(got[n]["has_face"] and got[n]["blink_detected"] and got[n]["phash"] is not None for n in range(5))
    assert [(got[n]["sharpness_score"], got[n]["has_face"], got[n]["phash"]) for n in (7, 10**17)] == [(0.0, False, None)] * 2
    assert analyze_previews(previews.limit(0), CullConfig(), detector, 5, 1, mesher).count() == 0


def test_best_detection_is_the_first(spark):
    rng = np.random.default_rng(9)
    for classes in (1, 3):
        for _ in range(6):
            out = rng.uniform(-1, 1, (4 + classes) * 7).astype(np.float32)
            first = spark.createDataFrame([(out.tolist(),)], "raw array<float>").select(vision.primary_face(vision.non_max_suppression(vision.decode_yolo(F.col("raw"), 4 + classes, 7, 0.4))).alias("d")).first()["d"]
            best = vision.best_detection(out, 4 + classes, 7, 0.4)
            assert (best is None) == (first is None)
            if best:
                assert [best[c] for c in ("cx", "cy", "w", "h")] == [first[c] for c in ("cx", "cy", "w", "h")]


def test_cull_of_images(spark, tmp_path):
    """Files to verdicts: a sharp, a flat and a broken photo, with models that find a face and closed eyes in each."""
    write_jpeg(spark, tmp_path / "1.jpg", SHARP[:48, :64])
    write_jpeg(spark, tmp_path / "2.jpg", FLAT[:48, :64])
    (tmp_path / "3.jpg").write_bytes(b"broken")
    images = vision.decode_images(spark, str(tmp_path))
    assert {r["image_id"]: r["image"]["width"] for r in images.collect()} == {1: 64, 2: 64, 3: -1}

    def detector():
        return lambda x: np.tile(np.array([320, 320, 500, 300, 0.9], np.float32), (len(x), 1))

    closed = np.array(mesh((0.1, 0.1)), np.float32)

    def mesher():
        return lambda x: np.tile(closed, (len(x), 1))

    features = analyze_images(images, CullConfig(), detector, 5, 1, mesher, 2)
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and python_nodes(plan) == 1 and plan.count("FileScan") == 1, plan
    got = {r["image_id"]: r for r in features.collect()}
    assert got[1]["has_face"] and got[1]["blink_detected"] and got[1]["sharpness_score"] > got[2]["sharpness_score"] == 0
    assert not got[3]["has_face"] and not got[3]["blink_detected"] and got[3]["phash"] is None
    photos = spark.createDataFrame([(1, 0), (2, 100), (3, None)], "image_id long, ts_ms long").withColumn("s", F.lit(0))
    done = cull(photos, features, CullConfig(phash_similarity_threshold=64), ["s"])
    assert {r["image_id"]: r["verdict"] for r in done.verdicts.collect()} == {1: "keeper", 2: "reject", 3: "keeper"}
    plain = analyze_images(images, CullConfig())
    assert {r["has_face"] for r in plain.collect()} == {False}


def greedy(boxes, threshold):
    """Ids that stay, one box after another."""

    def over(a, b):
        side = lambda i: max(0.0, min(a[i] + a[i + 2] / 2, b[i] + b[i + 2] / 2) - max(a[i] - a[i + 2] / 2, b[i] - b[i + 2] / 2))
        both = side(0) * side(1)
        union = a[2] * a[3] + b[2] * b[3] - both
        return both / union if union > 0 else 0.0

    kept = []
    for i, b in sorted(enumerate(boxes), key=lambda x: (-x[1][4], x[0])):
        if all(over(b, boxes[k]) <= threshold for k in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("threshold", [0.45, 0.1, 0.9])
def test_suppression_of_rows(spark, threshold):
    """Boxes of very different sizes, crowds on one spot, ties, equal ones, some without an area, over several keys."""
    rng = np.random.default_rng(int(100 * threshold))
    rows = []
    for key, n in ((1, 120), (2, 60), (None, 40)):
        for _ in range(n):
            size = 2.0 ** rng.uniform(-3, 7)
            x, y = (rng.uniform(-200, 200, 2) if rng.random() < 0.5 else rng.normal(10, 2, 2)).tolist()
            rows.append((key, x, y, size * rng.uniform(0.5, 2), size, float(rng.integers(0, 40)) / 40))
        rows += [rows[-1]] * 3 + [(key, 5.0, 5.0, 0.0, 0.0, 0.5), (key, 5.0, 5.0, 0.0, 3.0, 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, key long, cx double, cy double, w double, h double, confidence double").repartition(3)
    got = {r["i"] for r in suppress(df, "key", threshold, ["i"]).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[0] == key]
        want |= {own[k] for k in greedy([rows[i][1:] for i in own], threshold)}
    assert got == want
    assert suppress(df.limit(0), "key").count() == 0


def test_a_crowd_on_one_spot_is_many_tasks(spark):
    """All boxes of one image, in one place: one stays, the work is dealt, and pairs are not made."""
    n = 20_000
    df = spark.range(0, n, 1, 4).select(F.lit(1).alias("key"), (F.col("id") % 7 / 100 + 50).alias("cx"), F.lit(50.0).alias("cy"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"), (F.col("id") / n).alias("confidence"))
    got = suppress(df, "key").collect()
    assert len(got) == 1 and got[0]["confidence"] == (n - 1) / n


@pytest.mark.parametrize("size,to", [((48, 40), (24, 20)), ((30, 50), (7, 13)), ((9, 9), (20, 31))])
def test_resize_by_the_definition(size, to):
    """Triangle filter, widened when shrinking: each value as a weighted mean, one by one."""
    rng = np.random.default_rng(sum(size))
    img = rng.integers(0, 255, (*size, 3)).astype(np.uint8)
    got = imaging.resize_exact(img, to[1], to[0])
    assert got.shape == (*to, 3)

    def taps(n, m, o):
        ratio = n / m
        weights = [(k, max(0.0, 1 - abs(k + 0.5 - (o + 0.5) * ratio) / max(1.0, ratio))) for k in range(n)]
        return [(k, w) for k, w in weights if w > 0]

    for y in range(0, to[0], 3):
        for x in range(0, to[1], 3):
            pairs = [(i, j, a * b) for i, a in taps(size[0], to[0], y) for j, b in taps(size[1], to[1], x)]
            want = sum(w * img[i, j].astype(float) for i, j, w in pairs) / sum(w for *_, w in pairs)
            assert (np.abs(got[y, x] - want) <= 0.5 + 1e-9).all()


def test_letterbox_at_another_scale():
    img = np.random.default_rng(5).integers(0, 255, (60, 90, 3)).astype(np.uint8)
    canvas, t = imaging.letterbox(img, 45, 50)
    assert t == (0.5, 0.0, 10.0, 90.0, 60.0)
    assert (canvas[10:40] == imaging.resize_exact(img, 45, 30)).all() and (canvas[:10] == 114).all() and (canvas[40:] == 114).all()


def test_results_leave_in_small_batches():
    """A tensor is several times its photo, so the results of one batch of photos go on in several; null where none was decoded."""
    rgb = np.random.default_rng(0).integers(0, 255, (48, 40, 3)).astype(np.uint8)
    row = {"height": 48, "width": 40, "nChannels": 3, "data": rgb[..., ::-1].tobytes()}
    rows = [None if i == 7 else row | {"data": b""} if i == 8 else row for i in range(900)]
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())])
    tensor = lambda x: imaging.to_tensor(x).ravel()
    found = list(vision.of_batches(tensor, pa.list_(pa.float32()), iter([pa.array(rows, kind), pa.array([], kind), pa.array(rows[:1], kind)])))
    assert len(found) > 3 and max(b.nbytes for b in found) < vision.HELD + 100_000
    values = [v for b in found for v in b]
    assert [i for i, v in enumerate(values) if not v.is_valid] == [7, 8] and len(values) == 901
    assert all(np.array_equal(values[i].values.to_numpy(), tensor(rgb)) for i in (0, 9, 899, 900))


def test_pixel_functions_beside_each_other(spark):
    """Several of them in one row, of images that were decoded and of some that were not."""
    gray = np.arange(48 * 40, dtype=np.uint8).reshape(48, 40, 1)
    rows = [(1, ("", 48, 40, 1, 0, gray.tobytes())), (2, ("", -1, -1, -1, -1, b"")), (3, None)]
    df = spark.createDataFrame(rows, "id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = {r["id"]: r for r in df.select("id", vision.to_gray("image").alias("g"), vision.estimate_noise("image").alias("n"), vision.to_tensor("image").alias("t")).collect()}
    assert got[1]["g"] == gray.tobytes() and got[1]["n"] == imaging.estimate_noise(gray[..., 0]) and len(got[1]["t"]) == 3 * gray.size
    assert all(got[i][c] is None for i in (2, 3) for c in "gnt")


def test_photos_are_made_once_for_all_their_tensors(spark, tables):
    """The digest of both layouts is one pass over the photos: no join, and no photo or tensor in an exchange."""
    from burstpick import queries

    plan = queries.image_tensor_digest(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 2
