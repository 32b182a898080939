"""Segmented scans: running numbers within keys over rows in order, where one key may hold any share of the rows.

Rows are range-sorted by keys and order, so a key with many rows lies in many neighbouring partitions. Each partition numbers
its own rows in the same narrow pass, as if nothing were before it, and the result is a table of the shared folder. What a
partition can't know is what its first rows go on from: that follows from the ends of the partitions before, one row each, in
one sweep over these, and is added by partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.tables import written


def changed(batch: pa.RecordBatch, before: pa.RecordBatch | None, names: list[str]) -> np.ndarray:
    """Which rows differ in any of ``names`` from the row before them; ``before`` is the row before the batch (none: the first
    row differs). Nulls are equal."""
    out = np.zeros(batch.num_rows, bool)
    for name in names:
        column = batch[name] if before is None else pa.concat_arrays([before[name], batch[name]])
        codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        out[-len(codes) + 1 or len(out) :] |= codes[1:] != codes[:-1]
    if before is None:
        out[0] = True
    return out


def since(flags: np.ndarray) -> np.ndarray:
    """For each place the last one at or before it that is flagged, -1 where there is none."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


def _numbered(keys: list[str], head: list[str], gap: tuple[str, int] | None, schema: T.StructType):
    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, rows, run, nth, opened = TaskContext.get().partitionId(), None, 0, 0, 0, False
        first: list[pa.Array] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = changed(batch, before, keys)
            far = np.zeros(n, bool)
            if gap:
                value = batch[gap[0]].to_numpy()
                last = before[gap[0]].to_numpy()[0] if before is not None else value[0]
                far = (np.diff(value, prepend=last) > gap[1]) & ~key
            count, at_key, at_new = np.cumsum(far), since(key), since(key | far)
            runs = count - np.where(at_key >= 0, count[at_key], -run)
            nths = np.where(at_new >= 0, np.arange(1, n + 1) - at_new, np.arange(1, n + 1) + nth)
            heads = [pa.concat_arrays([first[i] if first else pa.nulls(1, batch[c].type), batch[c]]).take(pa.array(at_new + 1)) for i, c in enumerate(head)]
            opens = np.cumsum(key) + opened <= 1  # the first row of all opens the first key
            more = [
                pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(opens), pa.array(runs), pa.array(nths),
                *([pa.StructArray.from_arrays(heads, head)] if head else []),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)
            before, rows, run, nth = batch.slice(n - 1), rows + n, int(runs[-1]), int(nths[-1])
            opened = 1 if opens[-1] else 2
            first = [h.slice(n - 1) for h in heads]

    return of_partition


def sort_into_parts(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in ranges of ``order``, sorted within each."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def segmented(df: DataFrame, keys: list[str], order: list[str | Column], head: list[str] | None = None, gap: tuple[str, int] | None = None) -> DataFrame:
    """``df`` with ``_run, _nth`` and, with ``head``, ``_head``. Rows of equal ``keys`` are a segment, sorted by ``order``; with ``gap`` (a column and the
    most by which it may grow) a segment is cut into runs. ``_run`` counts the runs of the keys from 0, ``_nth`` the rows of a run
    from 1, and ``_head`` holds the columns ``head`` of its first row."""
    head = head or []
    heads = T.StructType([df.schema[c] for c in head])
    own = [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_open", T.BooleanType())]
    own += [T.StructField("_run", T.LongType()), T.StructField("_nth", T.LongType())]
    own += [T.StructField("_head", heads)] if head else []
    schema = T.StructType([*df.schema.fields, *own])
    table = written(sort_into_parts(df, *keys, *order).mapInArrow(_numbered(keys, head, gap, schema), schema), "scan")
    told = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], F.col(gap[0]).alias("value") if gap else F.lit(0).alias("value"), "_open", "_run", "_nth", *(["_head"] if head else []))
    ends = table.groupBy("_part").agg(F.min_by(told, "_row").alias("first"), F.max_by(told, "_row").alias("last")).collect()  # one row a partition
    fixes, last = [], None
    for e in sorted(ends, key=lambda e: e["_part"]):
        a, z, k = e["first"], e["last"], range(len(keys))
        goes_on = last is not None and all(a[i] == last[0][i] for i in k)
        far = bool(goes_on and gap and a["value"] - last[1] > gap[1])
        base, more = (last[2] + far if goes_on else 0), (last[3] if goes_on and not far else 0)
        start = last[4] if head and goes_on and not far else None
        fixes.append((e["_part"], base, more, start))
        on = z["_open"] and z["_run"] == 0
        last = [z[i] for i in k], z["value"], z["_run"] + (base if z["_open"] else 0), z["_nth"] + (more if on else 0), start if on and start is not None else z["_head"] if head else None
    kind = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_base", T.LongType()), T.StructField("_more", T.LongType()), T.StructField("_start", heads)])
    fixes = df.sparkSession.createDataFrame(fixes, kind)
    both = table.join(F.broadcast(fixes if head else fixes.drop("_start")), "_part")
    on = F.col("_open") & (F.col("_run") == 0)
    return both.select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_run") + F.when(F.col("_open"), F.col("_base")).otherwise(0)).alias("_run"),
        (F.col("_nth") + F.when(on, F.col("_more")).otherwise(0)).alias("_nth"),
        *([F.coalesce(F.when(on, F.col("_start")), F.col("_head")).alias("_head")] if head else []),
    )
