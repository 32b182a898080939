"""What the operators of this folder share: column helpers, and the tables of the shared folder (``burstpick.tables``)."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstpick.tables import discard, shared_dir, written

__all__ = ["WHITE", "WORD_BYTES", "arrow_rows", "blocks", "boxed", "discard", "give_back", "let", "read", "shared_dir", "written"]

#: The characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"

#: For ``bytes.translate``: A-Z as a-z; digits, letters and the bytes of characters outside ASCII as they are; a blank for the rest.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())

_BLANK = re.compile(b"[%s]" % WHITE.encode())


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` cut before blanks into blocks of about ``size`` bytes, longer ones where a word is."""
    at = 0
    while len(data) - at > size:
        blank = _BLANK.search(data, at + size)
        end = blank.start() if blank else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def give_back() -> None:
    """Gives the system the memory that earlier tasks of this worker have freed: workers are used again by later stages, and what they
    keep for themselves counts beside what those need."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row however often ``use`` (or a lambda within it) reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def boxed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, ``_row``: whatever they are called, they clash with nothing and come back by
    ``select("_row.*")``."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")


def arrow_rows(schema: str) -> Callable[[list[tuple]], pa.RecordBatch]:
    """A function from rows to a record batch of ``schema`` (a DDL string of long, int, double, string and binary): unlike a
    data frame it keeps integers beside nulls whole."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def of_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return of_rows


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
