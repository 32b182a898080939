"""Exact top-k inner products by a bit-sliced index.

Vectors become integers, ``floor(256 * x)``. Candidates are dealt into blocks; a block keeps, for each component,
the bitmaps (slices) of its values without their lowest ``DROP`` bits. For a query the slices, shifted by the bits
of the query's components, are added by carry-save bitmap arithmetic into the slices of all scores at once; from the
most significant one downward they give the k-th best score, then all rows whose score could reach it given the
dropped bits. Those boundary rows are resolved exactly. A block returns k rows a query, and the best k of the blocks
are the result.

The candidates are shuffled once for each QUERIES queries, the queries once for each block; an index is built once for all
queries of such a group.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a row with a
null vec_id. Vectors meet those of their own length. Every row is a candidate but the query's own: rows that repeat a vec_id
are candidates each, of one another too, and queries each (ranks start anew for each such row). Ties go to the smaller vec_id.
Queries without candidates have no rows, and an empty table gives an empty result. Scores beyond 64 bits are held at the
limits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstpick.llm.common import discard, written

#: Rows of a block, and queries that meet it in one task; a small table still gives each core a block, of LEAST_BLOCK rows or more.
BLOCK, QUERIES, LEAST_BLOCK = 49_152, 8_192, 4_096
#: Low bits left out of the index.
DROP = 2
FOUND = "query_id long, query_row long, vec_id long, score long"


class SlicedIndex:
    """Slices of the rows of ``values`` (rows x components, integers)."""

    def __init__(self, values: np.ndarray):
        self.values, n = values, len(values)
        high = values >> DROP
        self.low = high.min(0)
        self.span = (high - self.low).max(0)
        bits = max(1, int(self.span.max()).bit_length())
        self.words = -(-n // 64)
        self.rows = self._pack(np.ones((1, n), bool))[0]
        up = high - self.low
        self.up = [self._pack(((up >> b) & 1).T.astype(bool)) for b in range(bits)]
        down = self.span - up
        self.down = [self._pack(((down >> b) & 1).T.astype(bool)) for b in range(bits)]

    def _pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(flags), self.words * 8), np.uint8)
        packed = np.packbits(flags, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def _scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * w), lowest first; w is the component's value, or its complement where q < 0."""
        size, waiting = np.abs(query), defaultdict(list)
        for a in range(int(size.max()).bit_length()):
            has = (size >> a) & 1 == 1
            for side, own in ((self.up, has & (query > 0)), (self.down, has & (query < 0))):
                if own.any():
                    for b, s in enumerate(side):
                        waiting[a + b].append(s[own])
        out, p = [], 0
        while waiting:
            stack = waiting.pop(p, None)
            x = np.concatenate(stack) if stack else np.zeros((1, self.words), np.uint64)
            while len(x) > 1:
                if len(x) == 2:
                    waiting[p + 1].append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
                else:
                    m = len(x) // 3
                    a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
                    half = a ^ b
                    waiting[p + 1].append((a & b) | (c & half))
                    x = np.concatenate([half ^ c, x[3 * m :]])
            out.append(x[0])
            p += 1
        return out

    def top(self, query: np.ndarray, k: int, skip: int | None) -> np.ndarray:
        """Places of rows that hold the best k, and perhaps more; ``skip`` is the place of the query itself."""
        rows = self.rows.copy()
        if skip is not None:
            rows[skip // 64] &= ~(np.uint64(1) << np.uint64(skip % 64))
        if int(np.bitwise_count(rows).sum()) <= k or not query.any():
            return self._places(rows)
        slices = self._scores(query)
        sure, tied, kth = np.zeros_like(rows), rows, 0
        for p in range(len(slices) - 1, -1, -1):
            both = sure | (tied & slices[p])
            if int(np.bitwise_count(both).sum()) >= k:
                tied, kth = tied & slices[p], kth | (1 << p)
            else:
                sure, tied = both, tied & ~slices[p]
        lost = ((1 << DROP) - 1) * int(np.abs(query).sum())  # what the dropped bits can change
        least = kth - -(-lost >> DROP)
        if least <= 0:
            return self._places(rows)
        above, equal = np.zeros_like(rows), rows
        for p in range(len(slices) - 1, -1, -1):
            if least >> p & 1:
                equal = equal & slices[p]
            else:
                above |= equal & slices[p]
                equal = equal & ~slices[p]
        return self._places(above | equal)

    def _places(self, mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[: len(self.values)])


def search_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """FOUND: of each query its best k of the block. ``row`` tells rows apart."""
    if not len(queries) or not len(block):
        return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype="int64")
    rows = block["row"].to_numpy(np.int64)
    order = np.argsort(rows)
    rows, ids = rows[order], block["vec_id"].to_numpy(np.int64)[order]
    values, wanted = np.stack(block["v"].to_numpy())[order], np.stack(queries["v"].to_numpy())
    if not values.shape[1]:
        values, wanted = np.zeros((len(ids), 1), np.int64), np.zeros((len(wanted), 1), np.int64)
    most = int(np.abs(values.astype(object)).max()) * int(np.abs(wanted.astype(object)).max()) * values.shape[1]
    small = most < 1 << 62
    index = SlicedIndex(values) if small else None
    out = []
    for q_id, q_row, query in zip(queries["vec_id"], queries["row"], wanted, strict=True):
        at = int(np.searchsorted(rows, q_row))
        skip = at if at < len(rows) and rows[at] == q_row else None
        if small:
            places = index.top(query, k, skip)
            scores = values[places] @ query
        else:
            places = np.array([i for i in range(len(ids)) if i != skip], np.int64)
            scores = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in values[places].astype(object) @ query.astype(object)], np.int64)
        best = np.lexsort((ids[places], -scores.astype(object) if not small else -scores))[:k]
        out.append((np.full(len(best), q_id), np.full(len(best), q_row), ids[places[best]], scores[best]))
    return pd.DataFrame(dict(zip(("query_id", "query_row", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors (vec_id, embedding)`` whose id ``every`` divides."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = rows.select("vec_id", whole.alias("v"), F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "vectors")  # so that each row keeps its number
    is_query = F.col("vec_id") % every == 0
    n, n_q = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks, groups = max(1, -(-n // BLOCK), min(cores, n // LEAST_BLOCK)), max(1, -(-n_q // QUERIES))
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    by_block = rows.select("vec_id", "row", "v", "dim", deal(blocks).alias("block"), each(groups).alias("q_group"))
    by_query = rows.filter(is_query).select("vec_id", "row", "v", "dim", each(blocks).alias("block"), deal(groups).alias("q_group"))
    keys = ["dim", "block", "q_group"]
    found = by_query.groupBy(keys).cogroup(by_block.groupBy(keys)).applyInPandas(lambda q, b: search_block(q, b, k), FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    found = written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
    discard(rows)
    return found
