"""Sidecars, previews, manifests."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.operators.file_sink import write_files
from burstpick.operators.manifest_document import document_elements, manifest_rows, write_document
from burstpick.operators.review import verdict_label
from burstpick.operators.select import KEEPER, REJECT, UNRATED
from burstpick.tables import work_parts

TOOL = "burstpick"

#: Fixed value: the sidecar's text (XMP, ISO 16684-1). ``begin`` holds U+FEFF; no line feed at the end.
XMP = """<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
    <rdf:Description rdf:about=""
      xmlns:xmp="http://ns.adobe.com/xap/1.0/"
      xmlns:dc="http://purl.org/dc/elements/1.1/"
      xmp:Rating="{rating}"
      xmp:CreatorTool="{tool}"{label}>
      <dc:description>
        <rdf:Alt>
          <rdf:li xml:lang="x-default">Processed by {tool}</rdf:li>
        </rdf:Alt>
      </dc:description>
    </rdf:Description>
  </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>"""
#: Rating and label of each verdict.
RATINGS = {KEEPER: (5, ""), REJECT: (-1, '\n      xmp:Label="Reject"'), UNRATED: (0, "")}


def xmp_text(verdict: str, tool: str = TOOL) -> str:
    rating, label = RATINGS[verdict]
    return XMP.format(rating=rating, label=label, tool=tool)


def xmp_content(verdict: Column, tool: str = TOOL) -> Column:
    return F.when(verdict == KEEPER, xmp_text(KEEPER, tool)).when(verdict == REJECT, xmp_text(REJECT, tool)).otherwise(xmp_text(UNRATED, tool))


def xmp_path(path: Column) -> Column:
    """The last extension of the name becomes ``.xmp``; a name without one, or that only starts with a dot, gets it."""
    return F.concat(F.regexp_replace(path, r"([^/\\])\.[^./\\]*$", "$1"), F.lit(".xmp"))


def export_entries(images: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``image_id, raw_file_path, verdict`` of known photos; a word that is no verdict is unrated."""
    joined = verdicts.join(images.select("image_id", F.col("file_path").alias("raw_file_path")), "image_id")
    known = F.when(F.col("verdict").isin(KEEPER, REJECT), F.col("verdict")).otherwise(UNRATED)
    return joined.select("image_id", "raw_file_path", known.alias("verdict"))


def sidecars(entries: DataFrame, tool: str = TOOL) -> DataFrame:
    """``xmp_path, verdict, content, collisions``: one row a file. Where entries share a path the one with the largest
    image_id is written, and ``collisions`` says how many were not."""
    rated = entries.filter(F.col("verdict") != UNRATED).withColumn("xmp_path", xmp_path(F.col("raw_file_path")))
    rated = rated.repartition(work_parts(entries.sparkSession), "xmp_path")  # one exchange for the groups and the files
    won = rated.groupBy("xmp_path").agg(F.max_by("verdict", "image_id").alias("verdict"), (F.count(F.lit(1)) - 1).alias("collisions"))
    return won.select("xmp_path", "verdict", xmp_content(F.col("verdict"), tool).alias("content"), "collisions")


def write_xmp_sidecars(entries: DataFrame, tool: str = TOOL, fan_out: bool = False) -> DataFrame:
    """Writes the files, now, and returns ``xmp_path, status, error, n``: written, skipped (unrated) or error; a failed file fails
    nothing else. ``n``: entries that the row stands for. ``fan_out`` as of ``write_files``."""
    files = sidecars(entries, tool).select(F.col("xmp_path").alias("path"), "content", (F.col("collisions") + 1).alias("n"))
    done = write_files(files, fan_out).select(F.col("path").alias("xmp_path"), "status", "error", "n")
    skipped = entries.filter(F.col("verdict") == UNRATED).select(
        xmp_path(F.col("raw_file_path")).alias("xmp_path"), F.lit("skipped").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("n"),
    )
    return done.unionByName(skipped)


def export_summary(status: DataFrame) -> DataFrame:
    """One row: files_written, files_skipped, n_errors."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).cast("long")
    return status.agg(n("written").alias("files_written"), n("skipped").alias("files_skipped"), F.count_if(F.col("status") == "error").alias("n_errors"))


def export_errors(status: DataFrame) -> DataFrame:
    """``error``: a row ``path: error`` for each file that could not be written."""
    return status.filter(F.col("status") == "error").select(F.concat("xmp_path", F.lit(": "), "error").alias("error"))


def export_xmp(images: DataFrame, verdicts: DataFrame, tool: str = TOOL, fan_out: bool = False) -> tuple[DataFrame, DataFrame]:
    """Writes the sidecars, once, and returns their summary and errors."""
    status = write_xmp_sidecars(export_entries(images, verdicts), tool, fan_out)
    return export_summary(status), export_errors(status)


@dataclass(frozen=True)
class Exported:
    """Sidecars that were written: ``status`` as of ``write_files`` beside ``xmp_path, n``, and the counts of the run."""

    status: DataFrame
    files_written: int
    files_skipped: int
    n_errors: int
    seconds: float

    @property
    def errors(self) -> DataFrame:
        return export_errors(self.status)


def run_export(images: DataFrame, verdicts: DataFrame, tool: str = TOOL) -> Exported:
    """``export_xmp`` with counts: entries are read once, by the pass that writes the files, and an ``Observation`` behind its last
    shuffle counts those that ask for none."""
    began, seen = time.monotonic(), Observation("export")
    rated = F.col("verdict") != UNRATED
    entries = export_entries(images, verdicts).withColumn("xmp_path", xmp_path(F.col("raw_file_path")))
    won = entries.groupBy("xmp_path").agg(
        F.max_by("verdict", F.when(rated, F.col("image_id"))).alias("verdict"), F.count_if(rated).alias("n"), F.count_if(~rated).alias("n_skipped"),
    )
    won = won.observe(seen, F.coalesce(F.sum("n_skipped"), F.lit(0)).alias("files_skipped")).filter(F.col("n") > 0)
    status = write_files(won.select(F.col("xmp_path").alias("path"), xmp_content(F.col("verdict"), tool).alias("content"), "n"))
    status = status.withColumnRenamed("path", "xmp_path")
    done = export_summary(status).first()
    return Exported(status, done["files_written"], seen.get["files_skipped"], done["n_errors"], time.monotonic() - began)


def write_previews(df: DataFrame, folder: str) -> DataFrame:
    """Writes ``{image_id}.jpg``, now, and returns ``image_id, preview_path, error``; a failed write is told and the row stays."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    status = write_files(df.select("image_id", path.alias("path"), F.col("preview_data").alias("content")))
    return status.select("image_id", F.col("path").alias("preview_path"), "error")


def verdict_json(verdict: Column, reason: Column) -> Column:
    """A manifest's verdict: ``"Keeper"``, ``"Unrated"`` or ``{"Reject":{"reason":"Blink"}}``."""
    why = F.when(reason == "blink", "Blink").otherwise("OutOfFocus")
    rejected = F.concat(F.lit('{"Reject":{"reason":"'), why, F.lit('"}}'))
    return F.when(verdict == KEEPER, F.lit('"Keeper"')).when(verdict == REJECT, rejected).otherwise(F.lit('"Unrated"'))


def write_manifest(folder: str, scenes: DataFrame, keepers: DataFrame, verdicts: DataFrame, seconds: float = 0.0) -> None:
    """The manifest at any size: a folder of JSON lines each for scenes and scores, verdicts in the manifest's form, and for totals."""
    listed, scored, totals = manifest_rows(scenes, keepers, verdicts, seconds)
    listed.write.mode("overwrite").json(f"{folder}/scenes", ignoreNullFields=False)
    scored.write.mode("overwrite").json(f"{folder}/image_scores", ignoreNullFields=False)
    scenes.sparkSession.createDataFrame([tuple(totals.values())], list(totals)).coalesce(1).write.mode("overwrite").json(f"{folder}/totals")


def write_manifest_document(path: str, scenes: DataFrame, keepers: DataFrame, verdicts: DataFrame, seconds: float = 0.0) -> None:
    """The manifest as one pretty document of any size."""
    write_document(path, *manifest_rows(scenes, keepers, verdicts, seconds))


def manifests(scenes: DataFrame, keepers: DataFrame, verdicts: DataFrame, by: list[str], seconds: float = 0.0) -> DataFrame:
    """``by, json``: a whole manifest for each shoot, one pretty document. ``by`` stands in ``scenes`` and ``verdicts``; what has no
    value in them is null in the document. A document is one value, so a shoot must fit in one; ``write_manifest`` takes
    any size."""
    ordered = F.sort_array(F.collect_list(F.struct("pos_in_scene", "image_id")))
    listed = scenes.groupBy(*by, "scene_id").agg(F.transform(ordered, lambda x: x["image_id"]).alias("image_ids")).join(keepers, "scene_id", "left")
    listed = listed.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("scene_id").alias("id"), "image_ids", "keeper_id"))).alias("scenes"))
    kept = [c for c in verdicts.columns if c not in ("image_id", "verdict", "reject_reason", *by)]
    scored = F.struct("image_id", *kept, verdict_json(F.col("verdict"), F.col("reject_reason")).alias("_v"))
    of = lambda v: F.count_if(F.col("verdict") == v).alias(f"_{v}")
    scores = verdicts.groupBy(by).agg(F.sort_array(F.collect_list(scored)).alias("_s"), of(KEEPER), of(REJECT), of(UNRATED))
    told = F.transform("_s", lambda x: F.struct(x["image_id"].alias("image_id"), *[x[c].alias(c) for c in kept], F.parse_json(x["_v"]).alias("verdict")))
    n = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    totals = [
        n(F.size("_s"), "total_images"), n(F.size("scenes"), "total_scenes"), n(F.col(f"_{KEEPER}"), "total_keepers"), n(F.col(f"_{REJECT}"), "total_rejects"),
        n(F.col(f"_{UNRATED}"), "total_unrated"), F.lit(float(seconds)).alias("processing_time_secs"),
    ]
    document = F.struct(*totals, "scenes", told.alias("image_scores"))
    return scores.join(listed, by).select(*by, F.to_json(document, {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


MANIFEST = """
  total_images long, total_scenes long, total_keepers long, total_rejects long, total_unrated long, processing_time_secs double,
  scenes array<struct<id:long,image_ids:array<long>,keeper_id:long>>,
  image_scores array<struct<image_id:long,sharpness_score:double,has_face:boolean,
    face_bbox:struct<x:double,y:double,width:double,height:double>,blink_detected:boolean,eye_aspect_ratio:double,verdict:variant>>
"""


def parse_manifest(documents: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenes (exploded, with keeper_id), scores (with the verdict as a word) and totals of manifest documents, each beside the
    other columns of ``documents``."""
    kept = [c for c in documents.columns if c != json]
    doc = documents.select(*kept, F.from_json(json, MANIFEST).alias("_m"))
    each = doc.select(*kept, F.inline("_m.scenes")).select(*kept, F.col("id").alias("scene_id"), F.posexplode("image_ids").alias("pos", "image_id"), "keeper_id")
    scenes = each.select(*kept, "scene_id", (F.col("pos") + 1).cast("long").alias("pos_in_scene"), "image_id", "keeper_id")
    scores = doc.select(*kept, F.inline("_m.image_scores")).withColumn("verdict", verdict_label(F.to_json("verdict")))
    return scenes, scores, doc.select(*kept, "_m.*").drop("scenes", "image_scores")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scenes (exploded, with keeper_id), scores (with the verdict as a word) and totals of a manifest: a folder of
    ``write_manifest`` or a document, cut at its elements."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(MANIFEST)}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scenes")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        tables = {k: spark.read.schema("value string").text(f"{path}/{k}").select(F.col("value").alias("json")) for k in ("scenes", "image_scores", "totals")}
    else:
        elements = document_elements(spark, path)
        tables = {k: elements.filter(F.col("kind") == k).select("json") for k in ("scenes", "image_scores", "totals")}
    of = lambda k, schema: tables[k].select(F.from_json("json", schema).alias("_e")).select("_e.*")
    listed = of("scenes", kinds["scenes"].elementType).select(F.col("id").alias("scene_id"), F.posexplode("image_ids").alias("pos", "image_id"), "keeper_id")
    scenes = listed.select("scene_id", (F.col("pos") + 1).cast("long").alias("pos_in_scene"), "image_id", "keeper_id")
    scores = of("image_scores", kinds["image_scores"].elementType).withColumn("verdict", verdict_label(F.to_json("verdict")))
    return scenes, scores, of("totals", T.StructType([T.StructField(k, v) for k, v in kinds.items() if k not in ("scenes", "image_scores")]))
