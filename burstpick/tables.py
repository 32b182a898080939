"""Tables in the folder that all executors share, and row numbers over a whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that all executors share. Where it is unset a local session gets a temporary folder;
    on a cluster that is an error, as each machine would have its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends here, and a lost executor costs no more
    than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables from ``written`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def work_parts(spark: SparkSession) -> int:
    """Partitions for small rows that are much work each, such as a file: told, as adaptive execution puts partitions together by their
    bytes."""
    return 4 * spark.sparkContext.defaultParallelism


def with_row_numbers(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with ``name`` = 1, 2, 3, ... in ``order``, without a window over all rows in one task: a range sort,
    written once so that its partitions stand still, then each partition's place in it plus the rows before it."""
    place = F.monotonically_increasing_id()
    table = written(df.orderBy(*order).withColumn("_part", F.shiftright(place, 33)).withColumn("_row", place), name)
    counts = {r["_part"]: r["count"] for r in table.groupBy("_part").count().collect()}  # one row a partition
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _before long")
    number = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return table.join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_row", "_before")
