"""Token counts: how many pieces the best unigram path of a text has, without making the pieces.

Defined cases: a null or empty text has no piece and score 0. Repeated rows count each; an empty table gives an empty
result; other columns are ignored. Ties: see ``unigram``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from burstpick.llm.common import arrow_rows
from burstpick.llm.unigram import Memo, default_vocabulary, vocabulary

CACHE = 250_000
COUNTED = "doc_id long, n_tokens long, score double"
_MEMOS: dict[str, Memo] = {}


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, score`` for each row of ``docs (doc_id, text)``."""
    path = path or default_vocabulary()

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows_of = vocabulary(path), arrow_rows(COUNTED)
        memo = _MEMOS.setdefault(path, Memo(words.count, CACHE))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = list(map(memo.__getitem__, words.units(text or "")))
                rows.append((doc_id, sum(n for n, _ in found), float(sum(s for _, s in found))))
            yield rows_of(rows)

    return docs.select("doc_id", "text").mapInArrow(of_partition, COUNTED)
