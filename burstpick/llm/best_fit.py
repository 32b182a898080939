"""Best-fit packing: documents cut into pieces, and pieces packed into as few sequences as it can.

Pieces are ranked within their length (each partition counts its own; a table of counts by partition and length
gives every partition its first rank), which is the range sort: lengths are at most ``capacity``, so a sorted run
of equal lengths, or of equal gaps, is one row (length, first rank, how many). Each superstep takes the longest
length left and sweeps the gaps upwards from it: the i-th piece that wants a gap gets the i-th sequence that has
it, so no two conflict; gaps are updated and the next length follows. What the supersteps read and write are runs,
at most a few for each length, however many pieces there are; the pieces find their places from their ranks in one
distributed step. A sequence takes as many pieces of a length as fit before the next is touched, as best fit does.

Defined cases: a null text is an empty one; a document without words still has the id that ends it. Repeated rows
are packed each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstpick.llm.common import arrow_rows, give_back, written
from burstpick.llm.word_tokens import word_ids

CAPACITY = 2048
#: The id after each document.
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of ``docs (doc_id, text)``: ``rank`` counts the pieces of one length in the partition ``part``."""
    tokenizer = tokenizer or default_tokenizer()

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ids, part, rows_of = word_ids(tokenizer), TaskContext.get().partitionId(), arrow_rows(PIECES)
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = memoryview(ids.of_text(text or "") + END_ID.to_bytes(4, "little"))
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            yield rows_of(rows)

    return docs.select("doc_id", "text").mapInArrow(of_partition, PIECES)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of placed pieces ``(length, first rank, pieces a sequence takes, first sequence, offset there)``."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, how many)
    places, opened = [], 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        for gap in [*(g for g in range(length, capacity) if gaps[g]), capacity]:
            each = gap // length
            while left and (gaps[gap] or gap == capacity):
                need = -(-left // each)
                first, n = gaps[gap].pop() if gap < capacity else (opened, need)
                opened += n if gap == capacity else 0
                used = min(need, n)
                placed = min(left, used * each)
                places.append((length, rank, each, first, capacity - gap))
                full, over = divmod(placed, each)
                for run, rest in (((first, full), gap - each * length), ((first + full, over > 0), gap - over * length), ((first + used, n - used), gap)):
                    if run[1] and rest:
                        gaps[rest].append((run[0], int(run[1])))
                rank, left = rank + placed, left - placed
            if not left:
                break
    return places


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """PACKED from PIECES; ``pieces`` is read more than once, so it should be a written table."""
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    runs = np.array(supersteps(total, capacity), np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    places = pieces.sparkSession.sparkContext.broadcast(runs)  # its size is bounded by the capacity

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = places.value
        key = (run[:, 0] << 45) + run[:, 1]
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["rank"].to_numpy() + batch["first"].to_numpy()
            at = run[np.searchsorted(key, (length << 45) + rank, side="right") - 1]
            nth, place = np.divmod(rank - at[:, 1], at[:, 2])
            out = batch.drop_columns(["rank", "first"]).append_column("sequence_id", pa.array(at[:, 3] + nth))
            yield out.append_column("offset", pa.array(at[:, 4] + place * length))

    return pieces.join(first, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank", "first"
    ).mapInArrow(of_partition, PACKED)


def best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(cut(docs, tokenizer, capacity), "pieces"), capacity)
