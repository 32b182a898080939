"""SentencePiece encoding with N best segmentations, and decoding.

Forward Viterbi gives each unit its best path and what the next one costs more. Only the ``N - 1`` units where that is least (the
earlier one where two cost the same) can leave their best path in an N best path of the text; their N best paths come from
A-star over the piece lattice, with the forward scores as exact heuristic (``unigram``), and the text's are the best
combinations of those. Equal costs: the paths are compared unit by unit from the last one, by the rank of the unit's path.

Defined cases: a null or empty text has one segmentation, the empty one; it decodes to the empty text. Repeated rows
count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from burstpick.llm.common import arrow_rows
from burstpick.llm.unigram import Memo, Vocabulary, default_vocabulary, vocabulary

#: Segmentations of a text.
N_BEST = 3
#: Units that a worker remembers (twice as many at most), and bytes of ids that it gathers before it hands them on.
CACHE, HELD = 400_000, 8 << 20
_MEMOS: dict[tuple[str, int], Paths] = {}

DIGESTS = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decoded_sha256 string"
ENCODED = "doc_id long, rank int, score double, n_pieces long, ids binary"


class Paths:
    """What a worker remembers of units: of each the best path and the next one's cost, and of a few their ``n`` best paths."""

    def __init__(self, words: Vocabulary, n: int):
        self.n, self.words = n, words
        self.first = Memo(words.best_two, CACHE)
        self.all = Memo(lambda u: [(s, np.array(i, "<u4").tobytes()) for s, i in words.n_best(u, n)], CACHE // 10)


def combined(paths: list[list[tuple[float, bytes]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` cheapest ways to take one path of each list: what each costs more than the best ones, and its ranks. Taken list by
    list, keeping the ``n`` best so far."""
    ways = [(0.0, ())]  # cost, ranks from the last list to the first
    for own in paths:
        ways = heapq.nsmallest(n, ((cost + own[0][0] - score, (r, *way)) for cost, way in ways for r, (score, _) in enumerate(own)))
    return [(cost, way[::-1]) for cost, way in ways]


def encode_text(text: str, paths: Paths) -> list[tuple[float, bytes]]:
    """Score and ids of the ``n`` best segmentations, best first."""
    units, n = paths.words.units(text), paths.n
    found = list(map(paths.first.__getitem__, units))
    if not found:
        return [(0.0, b"")]
    scores, ids, gaps = map(list, zip(*found, strict=True))
    total = float(sum(scores))
    free = sorted(at for gap, at in heapq.nsmallest(n - 1, zip(gaps, range(len(gaps)), strict=True)) if gap < float("inf"))
    own = [paths.all[units[at]] for at in free]
    out = []
    for cost, way in combined(own, n):
        for at, r, choice in zip(free, way, own, strict=True):
            ids[at] = choice[r][1]
        out.append((total - cost, b"".join(ids)))
    return out


def encode(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """ENCODED: a row for each of the ``n`` best segmentations (fewer, if there are fewer), ``rank`` from 1."""
    path = path or default_vocabulary()

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = arrow_rows(ENCODED)
        for batch in batches:
            rows, size = [], 0
            for doc_id, rank, score, ids in _encoded(batch, path, n):
                rows.append((doc_id, rank, score, len(ids) // 4, ids))
                size += len(ids)
                if size > HELD:
                    yield rows_of(rows)
                    rows, size = [], 0
            yield rows_of(rows)

    return docs.select("doc_id", "text").mapInArrow(of_partition, ENCODED)


def _encoded(batch: pa.RecordBatch, path: str, n: int) -> Iterator[tuple[int | None, int, float, bytes]]:
    words = vocabulary(path)
    if (path, n) not in _MEMOS:
        _MEMOS[path, n] = Paths(words, n)
    memo = _MEMOS[path, n]
    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
        for rank, (score, ids) in enumerate(encode_text(text.as_py() or "", memo), 1):
            yield doc_id.as_py(), rank, score, ids


def digests(docs: DataFrame, path: str | None = None, n: int = N_BEST) -> DataFrame:
    """DIGESTS: ``encode`` and ``decode`` in one pass that hands on neither ids nor texts; ``decoded_sha256`` is of the text
    that the ids spell."""
    path = path or default_vocabulary()

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows_of = vocabulary(path), arrow_rows(DIGESTS)
        for batch in batches:
            rows = []
            for doc_id, rank, score, ids in _encoded(batch, path, n):
                text = words.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((doc_id, rank, score, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text.encode()).hexdigest()))
            yield rows_of(rows)

    return docs.select("doc_id", "text").mapInArrow(of_partition, DIGESTS)


def decode(encoded: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``encoded`` and the ``text`` that its ``ids`` spell."""
    path = path or default_vocabulary()
    schema = T.StructType([*encoded.select(*keep).schema, T.StructField("text", T.StringType())])

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode(np.frombuffer(x.as_py(), "<u4").tolist()) for x in batch["_ids"]]
            yield batch.drop_columns(["_ids"]).append_column("text", pa.array(texts, pa.string()))

    return encoded.select(*keep, encoded["ids"].alias("_ids")).mapInArrow(of_partition, schema)
