"""A manifest as one JSON document of any size, out and back; ``export.manifests`` makes the same text where a shoot fits in a row.

Out: each scene and each score is a piece of text, pieces are range-sorted, the partitions write them as files whose order is the
document's, and the files are joined through the file system: by its own ``concat`` where it has one (HDFS), else by copying
them one after another through a buffer.

Back: the text reader takes the place between two elements as its line separator, so Spark cuts the file at array elements and
splits it by byte ranges as any text file. The separator follows from the document's head, as writers differ in white space.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstpick.operators.select import KEEPER, REJECT, UNRATED
from burstpick.scan import sort_into_parts

#: Bytes of a document that are looked at for its layout.
HEAD = 1 << 16
_PRETTY = {"ignoreNullFields": "false", "pretty": "true"}


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _element(row: Column) -> Column:
    """An element of a list, pretty, as deep as it stands in the document."""
    return F.replace(F.to_json(row, _PRETTY), F.lit("\n"), F.lit("\n  "))


def write_document(path: str, listed: DataFrame, scored: DataFrame, totals: dict[str, int | float]) -> None:
    """Writes the document: ``totals``, then ``listed (id, ...)`` as scenes and ``scored (image_id, ...)`` as image_scores, each in
    order of its id."""
    spark = listed.sparkSession
    parts = []
    for place, (rows, key) in enumerate(((listed, "id"), (scored, "image_id"))):
        last = rows.agg(F.max(key)).first()[0]
        text = F.concat(_element(F.struct("*")), F.when(F.col(key) == F.lit(last), F.lit("")).otherwise(F.lit(",")))
        parts.append(rows.select(F.lit(2 * place + 1).alias("place"), F.col(key).alias("key"), text.alias("text")))
    head = "{\n" + "".join(f'  "{k}" : {v},\n' for k, v in totals.items()) + '  "scenes" : ['
    marks = spark.createDataFrame([(0, 0, head), (2, 0, '],\n  "image_scores" : [')], "place int, key long, text string")
    pieces = sort_into_parts(marks.unionByName(parts[0]).unionByName(parts[1]), "place", "key").select("text")
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    pieces.write.option("lineSep", " ").text(folder)
    _join(spark, folder, path, b"]\n}")


def _join(spark: SparkSession, folder: str, path: str, tail: bytes) -> None:
    """The files of a folder in order, and ``tail``, as one; the folder goes."""
    store, at = _hadoop(spark, path)
    _, inside = _hadoop(spark, folder)
    Path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: N806
    names = sorted(s.getPath().getName() for s in store.listStatus(inside) if s.getPath().getName().startswith("part-"))
    ending = Path(f"{folder}/part-end")
    out = store.create(ending, True)
    out.write(bytearray(tail))
    out.close()
    parts = [Path(f"{folder}/{n}") for n in names] + [ending]
    first = Path(f"{folder}/whole")
    if store.getUri().getScheme() in ("hdfs", "viewfs"):
        array = spark.sparkContext._gateway.new_array(Path, len(parts) - 1)
        for i, p in enumerate(parts[1:]):
            array[i] = p
        store.concat(parts[0], array)
        first = parts[0]
    else:
        out = store.create(first, True)
        for p in parts:
            into = store.open(p)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 20, False)
            into.close()
        out.close()
    store.delete(at, False)
    if not store.rename(first, at):
        raise OSError(f"cannot write {path}")
    store.delete(inside, True)


def manifest_rows(scenes: DataFrame, keepers: DataFrame, verdicts: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame, dict[str, int | float]]:
    """``write_document``'s tables and totals of a cull."""
    from burstpick.operators.export import verdict_json

    ordered = F.sort_array(F.collect_list(F.struct("pos_in_scene", "image_id")))
    listed = scenes.groupBy("scene_id").agg(F.transform(ordered, lambda x: x["image_id"]).alias("image_ids")).join(keepers, "scene_id", "left")
    kept = [c for c in verdicts.columns if c not in ("image_id", "verdict", "reject_reason")]
    scored = verdicts.select("image_id", *kept, F.parse_json(verdict_json(F.col("verdict"), F.col("reject_reason"))).alias("verdict"))
    of = lambda v: F.count_if(F.col("verdict") == v)
    counts = verdicts.agg(F.count(F.lit(1)), of(KEEPER), of(REJECT), of(UNRATED)).first()
    names = ("total_images", "total_scenes", "total_keepers", "total_rejects", "total_unrated")
    n = dict(zip(names, (counts[0], scenes.select("scene_id").distinct().count(), *counts[1:]), strict=True))
    return listed.select(F.col("scene_id").alias("id"), "image_ids", "keeper_id"), scored, n | {"processing_time_secs": float(seconds)}


_OPENS = {name: rf'"{name}"\s*:\s*\[\s*' for name in ("scenes", "image_scores")}


def document_elements(spark: SparkSession, path: str) -> DataFrame:
    """``kind, json`` of a document's parts: ``scenes`` and ``image_scores``, a row an element, and ``totals``, one row."""
    store, at = _hadoop(spark, path)
    stream = store.open(at)
    try:
        head = bytes(stream.readNBytes(HEAD)).decode("utf-8", "ignore")
    finally:
        stream.close()
    between = re.search(r"\}(\s*),(\s*)\{", head[head.find("[") :]) if "[" in head else None
    sep = between[0] if between else "}, {"
    rows = spark.read.option("lineSep", sep).text(path).select(F.col("value").alias("t"))
    # a row may hold where one list ends and the next begins, the head before the first element, and the tail behind the last
    cut = lambda c, pattern: F.regexp_replace(c, pattern, "\u0000")
    t = cut(cut(F.col("t"), rf"\}}?\s*\],\s*{_OPENS['image_scores']}\{{?"), rf",\s*{_OPENS['scenes']}\{{?")
    pieces = rows.select(t.alias("t"), F.col("t").rlike(_OPENS["scenes"]).alias("first"))
    each = pieces.select("first", F.posexplode(F.split("t", "\u0000")).alias("at", "piece"))
    ending = r'\s*\}?\s*\],?((?:\s*"[a-z_]+"\s*:\s*[^\[\]{}"]*)?)\s*\}\s*$'
    tail, ended = F.regexp_extract("piece", ending, 1), F.regexp_replace("piece", ending, "")
    is_head = F.col("first") & (F.col("at") == 0)
    wrapped = F.concat(F.lit("{"), ended, F.lit("}"))
    kind = F.when(is_head, "head").when(F.col("piece").rlike('"image_ids"'), "scenes").otherwise("image_scores")
    told = each.select(kind.alias("kind"), F.when(is_head, F.concat("piece", F.lit("}"))).otherwise(wrapped).alias("json"), F.when(~is_head, F.trim(tail)).alias("tail"))
    parts = told.filter((F.col("kind") != "head") & (F.length(F.regexp_replace("json", r"\s", "")) > 2)).select("kind", "json")
    ends = told.agg(F.max(F.when(F.col("kind") == "head", F.col("json"))).alias("head"), F.max("tail").alias("tail"))
    more = F.when(F.col("tail") != "", F.concat(F.lit(", "), F.regexp_replace("tail", r",\s*$", ""))).otherwise("")
    return parts.unionByName(ends.select(F.lit("totals").alias("kind"), F.concat(F.regexp_replace("head", r"\}$", ""), more, F.lit("}")).alias("json")))
