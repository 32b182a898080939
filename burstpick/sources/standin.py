"""Views of the given tables in the shape of a photo archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".CR2", ".cr3", ".NEF", ".arw", ".Raf", ".dng", ".ORF", ".rw2", ".jpg", ""]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a photo, from ``events``."""
    e = events(spark, sf_dir)
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("event_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("/shoots/"), "user_id", F.lit("/IMG_"), F.lpad(F.col("event_id").cast("string"), 7, "0"), ext)
    look = F.get_json_object("props", "$.k").cast("long")
    bits = F.floor(look / 25).cast("long") * F.lit(183251937962)
    return e.select(
        F.col("event_id").alias("image_id"), F.col("user_id").alias("shoot_id"),
        F.when(F.col("event_id") % 97 != 0, ms).alias("ts_ms"), path.alias("file_path"),
        F.col("value").alias("sharpness_score"), (F.col("event_type") != "view").alias("has_face"),
        (F.col("event_type") == "error").alias("blink_detected"),
        F.when(F.col("event_id") % 53 != 0, bits.bitwiseXOR(F.expr("shiftleft(1L, cast(event_id % 40 as int))"))).alias("phash"),
    )


CAPTURES_SQL = """captures AS (
  SELECT event_id AS image_id, user_id AS shoot_id, CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) // 1000 END AS ts_ms,
    '/shoots/' || user_id || '/IMG_' || lpad(event_id::VARCHAR, 7, '0')
      || ['.CR2', '.cr3', '.NEF', '.arw', '.Raf', '.dng', '.ORF', '.rw2', '.jpg', ''][(event_id % 10 + 1)::INTEGER] AS file_path,
    value AS sharpness_score, event_type <> 'view' AS has_face, event_type = 'error' AS blink_detected,
    CASE WHEN event_id % 53 <> 0 THEN xor(((props->>'$.k')::BIGINT // 25) * 183251937962, 1::BIGINT << (event_id % 40)::INTEGER) END AS phash
  FROM events
)"""


def overrides(captures_df: DataFrame) -> DataFrame:
    word = F.element_at(F.array(F.lit("keeper"), F.lit("reject"), F.lit("unrated")), (F.col("image_id") % 3 + 1).cast("int"))
    return captures_df.filter(F.col("image_id") % 13 == 0).select("image_id", word.alias("override"))


OVERRIDES_SQL = """overrides AS (
  SELECT image_id, ['keeper', 'reject', 'unrated'][(image_id % 3 + 1)::INTEGER] AS override FROM captures WHERE image_id % 13 = 0
)"""


#: Key presses: every so manieth photo, the word's place in ``KXUX``.
PRESSES = [(7, 0), (5, 1), (3, 2), (11, 0), (2, 3)]


def actions(captures_df: DataFrame) -> DataFrame:
    """Key presses, up to five on a photo, in rounds over the archive."""
    word = lambda n: F.element_at(F.array(*map(F.lit, "KXUX")), ((F.col("image_id") + n) % 4 + 1).cast("int"))
    rounds = [
        captures_df.filter(F.col("image_id") % every == 0).select((F.col("image_id") + k * 10**12).alias("seq"), "image_id", word(n).alias("action"))
        for k, (every, n) in enumerate(PRESSES)
    ]
    return reduce(DataFrame.unionAll, rounds)


ACTIONS_SQL = "actions AS (" + " UNION ALL ".join(
    f"SELECT image_id + {k * 10**12} AS seq, image_id, ['K', 'X', 'U', 'X'][((image_id + {n}) % 4 + 1)::INTEGER] AS action FROM captures WHERE image_id % {every} = 0"
    for k, (every, n) in enumerate(PRESSES)
) + ")"


def previews(captures_df: DataFrame) -> DataFrame:
    held = lambda letter, m: F.when(F.col("image_id") % m == 0, F.concat(F.lit(letter), "image_id"))
    return captures_df.select(
        "image_id", F.coalesce(held("J", 3), F.lit("")).cast("binary").alias("jpg_from_raw"),
        held("P", 2).cast("binary").alias("preview_image"), F.coalesce(held("O", 5), F.lit("")).cast("binary").alias("other_image"),
    )


#: The type cases of EXIF JSON, by ``image_id % 12``; ``%d`` holds the id's seconds.
EXIF_CASES = [
    '[{"DateTimeOriginal":"2024:03:15 14:30:%02d","Make":"Acme","Model":"X","FocalLength":"50.0 mm","FNumber":2.8,"ISO":100}]',
    '[{"DateTimeOriginal":"2023:02:31 01:02:%02d","Make":5,"Model":7,"FocalLength":50.0,"FNumber":"2.8","ISO":"100"}]',
    '[{"DateTimeOriginal":"0000:00:00 00:00:%02d","FNumber":4,"ISO":100.0}]',
    '[{"DateTimeOriginal":"2024:13:01 00:00:%02d","ISO":-1,"FocalLength":"35 mm"}]',
    '[{"DateTimeOriginal":"2024:03:32 00:00:%02d","ISO":4294967396}]',
    '[{"DateTimeOriginal":"2024:03:15 14:30:%02d.25","FocalLength":"mm"}]',
    '[{"DateTimeOriginal":"2024:03:15 14:30:%02d+02:00","FocalLength":"24.5"}]',
    '[{"DateTimeOriginal":"2024:03:15 14:30:%02d DST","Make":"","Model":null}]',
    '[{"DateTimeOriginal":"2000:02:29 23:59:%02d"},{"Make":"second"}]',
    "bad %02d",
    "[]",
    '{"Make":"no array %02d"}',
]


def exif(captures_df: DataFrame) -> DataFrame:
    second = F.lpad((F.col("image_id") % 60).cast("string"), 2, "0")
    case = F.element_at(F.array(*map(F.lit, EXIF_CASES)), (F.col("image_id") % len(EXIF_CASES) + 1).cast("int"))
    return captures_df.select("image_id", F.replace(case, F.lit("%02d"), second).alias("json"))


_CASES = ", ".join(f"'{c}'" for c in EXIF_CASES)
EXIF_SQL = f"""exif AS (
  SELECT image_id, replace([{_CASES}][(image_id % {len(EXIF_CASES)} + 1)::INTEGER], '%02d', lpad((image_id % 60)::VARCHAR, 2, '0')) AS json FROM captures
)"""


def export_requests(captures_df: DataFrame) -> DataFrame:
    """A wish for every photo and for as many ids that no photo has."""
    words = ["keeper", "reject", "unrated", "maybe"]
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("image_id") % 4 + 1).cast("int"))
    known = captures_df.select("image_id", word.alias("verdict"))
    return known.unionByName(known.select((-1 - F.col("image_id")).alias("image_id"), F.lit("keeper").alias("verdict")))


EXPORT_REQUESTS_SQL = """export_requests AS (
  SELECT image_id, ['keeper', 'reject', 'unrated', 'maybe'][(image_id % 4 + 1)::INTEGER] AS verdict FROM captures
  UNION ALL SELECT -1 - image_id, 'keeper' FROM captures
)"""


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face-mesh outputs of three lengths, from ``embeddings``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    times = F.when(F.col("vec_id") % 3 == 0, 22).when(F.col("vec_id") % 3 == 1, 15).otherwise(14)
    return e.select("vec_id", F.flatten(F.array_repeat("embedding", times)).alias("raw"))


LANDMARKS_SQL = """landmarks AS (
  SELECT vec_id, flatten(list_transform(range(CASE vec_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 15 ELSE 14 END), lambda k: embedding)) AS raw FROM embeddings
)"""


#: Columns of the detector outputs, and the number that the four rows of boxes hold together.
CELLS = 13
BOXED = 4 * CELLS


def yolo_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector outputs of 5 rows and CELLS columns, channel by channel, from ``embeddings`` (64 values and the first again)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = F.concat("embedding", F.slice("embedding", 1, 1))
    scaled = F.transform(whole, lambda x, i: F.abs(x.cast("double")) * F.when(i < BOXED, 640.0).otherwise(2.0))
    return e.select("vec_id", scaled.alias("raw"))


YOLO_SQL = f"""yolo AS (
  SELECT vec_id, list_transform(list_append(embedding, embedding[1]), lambda x, i: abs(x::DOUBLE) * CASE WHEN i <= {BOXED} THEN 640.0 ELSE 2.0 END) AS raw FROM embeddings
)"""

#: Photos made of embeddings: rows, columns. A tile of 8 x 8 values is repeated, scaled by 1, 2 or 3 from tile to tile; blue, green
#: and red are 31 apart.
HIGH, WIDE = 48, 40


def _tile() -> Column:
    return F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.6) * 200))).cast("int"))


def _hex_bytes(upwards: bool) -> Column:
    """Bytes of the photo as hex, blue first; ``upwards``: the last row first. The tile is computed once a row."""
    return F.get(F.transform(F.array(_tile()), lambda tile: _hex_of(tile, upwards)), F.lit(0))


def _hex_of(tile: Column, upwards: bool) -> Column:

    def value(k: Column) -> Column:
        row, x, c = F.floor(k / (3 * WIDE)), F.floor(k / 3) % WIDE, k % 3
        y = HIGH - 1 - row if upwards else row
        scale = 1 + (F.floor(y / 8) + 2 * F.floor(x / 8)) % 3
        return (F.get(tile, ((y % 8) * 8 + x % 8).cast("int")) * scale + 31 * c) % 256

    each = F.transform(F.sequence(F.lit(0), F.lit(3 * WIDE * HIGH - 1)), lambda k: F.lpad(F.hex(value(k)), 2, "0"))
    return F.array_join(each, "")


def _spread(slim: DataFrame) -> DataFrame:
    """The rows of a small file dealt to all cores, as each is much work later on; a table of many files as it is."""
    cores = slim.sparkSession.sparkContext.defaultParallelism
    return slim if len(slim.inputFiles()) >= cores else slim.repartition(cores, "image_id")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, image`` as the image source gives it."""
    e = _spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding"))
    image = F.struct(
        F.lit("").alias("origin"), F.lit(HIGH).alias("height"), F.lit(WIDE).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        F.unhex(_hex_bytes(False)).alias("data"),
    )
    return e.select("image_id", F.explode(F.array(image)).alias("image"))  # made once, whatever reads it


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, preview_data``: the same photos as BMP files."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding")
    size = 3 * WIDE * HIGH
    parts = [(b"BM").hex(), *((n.to_bytes(k, "little")).hex() for n, k in ((54 + size, 4), (0, 4), (54, 4), (40, 4), (WIDE, 4), (HIGH, 4), (1, 2), (24, 2), (0, 4), (size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)))]
    return e.select("image_id", F.unhex(F.concat(F.lit("".join(parts)), _hex_bytes(True))).alias("preview_data"))


def jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, preview_data``: photos of HIGH x WIDE pixels as JPEG files, gray, each block of 8 x 8 one value of the embedding.

    The files are baseline ones, told so that every field ends with a byte: one code of 8 bits for a first coefficient of 8 bits, one
    for the end of a block, a restart after each block."""
    e = _spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding"))
    table = lambda kind, symbol: f"ffc40014{kind}{'00' * 7}01{'00' * 8}{symbol}"
    frame = f"ffc0000b08{HIGH:04x}{WIDE:04x}01011100"
    head = "ffd8" + "ffdb004300" + "04" * 64 + frame + table("00", "08") + table("10", "00") + "ffdd00040001" + "ffda0008010100003f00"
    n = HIGH * WIDE // 64

    def block(k: Column) -> Column:
        level = F.least(F.lit(63), F.greatest(F.lit(0), F.floor((F.get("embedding", k.cast("int")).cast("double") + 0.6) * 50))).cast("int")
        bits = F.when((level + k) % 2 == 0, 128 + 2 * level).otherwise(127 - 2 * level)
        ends = F.when(k < n - 1, F.concat(F.lit("ffd"), (k % 8).cast("string"))).otherwise("ffd9")
        return F.concat(F.lit("00"), F.lpad(F.hex(bits), 2, "0"), F.lit("00"), ends)

    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), block), "")
    return e.select("image_id", F.unhex(F.concat(F.lit(head), body)).alias("preview_data"))


#: Their pixels.
JPEGS_SQL = f"""blocks AS (
  SELECT vec_id AS image_id, k, least(63, greatest(0, floor((embedding[k + 1]::DOUBLE + 0.6) * 50)))::BIGINT AS level FROM embeddings, unnest(range({HIGH * WIDE // 64})) AS u(k)
), px AS (
  SELECT image_id, y, x, v AS b, v AS g, v AS r FROM (SELECT image_id, k, CASE WHEN (level + k) % 2 = 0 THEN 192 + level ELSE 64 - level END AS v FROM blocks)
  JOIN (SELECT y, x, (y // 8) * {WIDE // 8} + x // 8 AS k FROM unnest(range({HIGH})) AS a(y), unnest(range({WIDE})) AS b(x)) USING (k)
), gray AS (
  SELECT image_id, y, x, r AS v FROM px
)"""

PATCHES_SQL = f"""patches AS (
  SELECT vec_id AS image_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings
), tile AS (
  SELECT image_id, n // 8 AS ty, n % 8 AS tx, least(255, greatest(0, floor((e::DOUBLE + 0.6) * 200)))::BIGINT AS t FROM patches
), grid AS (
  SELECT y, x, y % 8 AS ty, x % 8 AS tx FROM unnest(range({HIGH})) AS a(y), unnest(range({WIDE})) AS b(x)
), base AS (
  SELECT image_id, y, x, t * (1 + (y // 8 + 2 * (x // 8)) % 3) AS v FROM tile JOIN grid USING (ty, tx)
), px AS (
  SELECT image_id, y, x, v % 256 AS b, (v + 31) % 256 AS g, (v + 62) % 256 AS r FROM base
), gray AS (
  SELECT image_id, y, x, (2126 * r + 7152 * g + 722 * b) // 10000 AS v FROM px
)"""

#: Segments before the frame header of a preview, by ``image_id % 4``, as hex; the last two are no JPEG.
HEADS = ["ffd8", "ffd8ffe000046162ffff", "6162", ""]


def jpeg_headers(captures_df: DataFrame) -> DataFrame:
    side = lambda m: F.lpad(F.hex(F.col("image_id") % m + 1), 4, "0")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("image_id") % 4 + 1).cast("int"))
    return captures_df.select("image_id", F.unhex(F.concat(head, F.lit("ffc0001108"), side(500), side(700), F.lit("03" * 12))).alias("preview_data"))
