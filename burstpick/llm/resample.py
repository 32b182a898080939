"""Importance resampling: documents drawn so that their n-grams resemble those of a target.

Features are all runs of 1 to ``max_n`` consecutive words (A-Z lower-cased; a word is a run of digits, letters a-z and
characters outside ASCII), each hashed to a bucket by the crc32 of its bytes. The gain of a bucket is the logarithm of its
smoothed share in the target over that in the documents, the weight of a document is the mean gain of its features, and
adding Gumbel noise, which a document's id decides, makes taking the highest scores a draw without replacement.

Long texts are split at word boundaries into chunks, which are dealt to all tasks: a chunk owns the n-grams that start at its own
words and carries the ``max_n - 1`` words after them. Chunk counts and weights are summed by document. Texts of one chunk
stay where they are. The counts of the buckets are the only thing that reaches the driver, ``buckets`` numbers for each side.

Defined cases: a null text, or one without words, has no feature and weight 0. A null doc_id is the empty string in the hash, and
the last of a tie. Repeated rows count each and are drawn each. An empty target leaves the gains to the smoothing; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import WORD_BYTES, written
from burstpick.tables import with_row_numbers

MAX_N, BUCKETS = 2, 10_000
#: Bytes of a chunk, and of the chunks that a worker hashes at once; from so many bytes on a word is hashed by itself.
CHUNK, AT_ONCE, LONG_WORD = 1 << 16, 1 << 20, 64
#: Of what is drawn: percent of the documents with so many words, and the seed of the noise.
PERCENT, MIN_WORDS, SEED = 25, 20, 7


def _crc_table() -> np.ndarray:
    """The crc32 of single bytes, by its rule (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _crc(crc: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``zlib.crc32(text[start : start + size], crc)``, one by one, all at once: the k-th step takes the k-th byte of every word
    that has one. Long words don't keep the others waiting."""
    order = np.argsort(-size, kind="stable")
    start, size, state = start[order], size[order], ~crc[order]
    long = int(np.searchsorted(-size, -LONG_WORD, side="right"))
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(text[start[i] : start[i] + size[i]], int(~state[i])))
    start, size, own = start[long:], size[long:], state[long:]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))  # sizes above k
        own[:n] = _TABLE[(own[:n] ^ text[start[:n] + k]) & 255] ^ (own[:n] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def hashed(texts: list[bytes], own: list[int], max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all n-grams that start at the first ``own`` words of each text (words parted by blanks): the text's place in the list,
    and the bucket."""
    text = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], text != 32, [False]])
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    size = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1 - start
    before = np.cumsum([0, *(len(x) + 1 for x in texts)])
    row = np.searchsorted(before, start, side="right") - 1
    first = np.searchsorted(row, np.arange(len(texts)))  # each text's first word
    mine = np.flatnonzero(np.arange(len(start)) < first[row] + np.asarray(own, np.int64)[row])
    rows, found = [], []
    crc = np.zeros(len(mine), np.uint32)
    for n in range(max_n):
        if n:
            go = (mine + n < len(start)) & (row[np.minimum(mine + n, len(start) - 1)] == row[mine]) if len(start) else np.zeros(0, bool)
            mine, crc = mine[go], crc[go]
            crc = ~(_TABLE[(~crc ^ np.uint32(32)) & 255] ^ (~crc >> 8))  # the blank between
        crc = _crc(crc, text, start[mine + n], size[mine + n])
        rows.append(row[mine])
        found.append(crc % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found)


def _split(data: bytes, max_n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Own words and text of each chunk of ``data`` (words parted by blanks)."""
    carry, at = re.compile(b"( *[^ ]+){0,%d}" % (max_n - 1)), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield len(data[at:end].split()), data[at : carry.match(data, end).end()]
        at = end


def chunks(docs: DataFrame, max_n: int, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``docs (doc_id, text)`` as ``key, doc_id, own, text``: documents of one chunk (with a null key, one row each), and the chunks
    of longer ones, dealt anew; ``key`` names the document's row."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or b"").translate(WORD_BYTES) for x in batch["text"].to_pylist()]
            own = pa.array([len(x.split()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(texts), pa.int64()), batch["doc_id"], own, pa.array(texts, pa.binary())], names=["key", "doc_id", "own", "text"]
            )

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part: list[tuple[int, bytes]] = []
                for n, piece in enumerate(_split(batch["text"][at].as_py().translate(WORD_BYTES), max_n, size)):
                    part.append((n, *piece))
                    if len(part) == 64:
                        yield cut(batch, at, part)
                        part = []
                if part:
                    yield cut(batch, at, part)

    def cut(batch: pa.RecordBatch, at: int, part: list[tuple]) -> pa.RecordBatch:
        same = pa.array([at] * len(part), pa.int64())
        nth, own, text = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch["key"].take(same), batch["doc_id"].take(same), pa.array(own, pa.int64()), pa.array(text, pa.binary()), pa.array(nth, pa.int64())],
            names=["key", "doc_id", "own", "text", "nth"],
        )

    is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(whole, f"key long, doc_id {kind}, own long, text binary")
    long = rows.filter(is_long).withColumn("key", F.monotonically_increasing_id())
    long = long.mapInArrow(split, f"key long, doc_id {kind}, own long, text binary, nth long").repartition("key", "nth").drop("nth")
    return short, long


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """The batch's rows in groups of about AT_ONCE bytes: the first one's place, the texts, the own words."""
    texts, own = batch["text"].to_pylist(), batch["own"].to_pylist()
    first, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= AT_ONCE or at == len(texts) - 1:
            yield first, texts[first : at + 1], own[first : at + 1]
            first, held = at + 1, 0


def bucket_counts(pieces: DataFrame, max_n: int, buckets: int) -> list[int]:
    """How many features of all rows fall into each bucket. A task adds up its own rows first."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts, own in _groups(batch):
                total += np.bincount(hashed(texts, own, max_n, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = pieces.select("own", "text").mapInArrow(of_partition, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in counted.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of the B buckets."""
    total = [float(sum(x) + len(x)) for x in (source, target)]
    return [math.floor(1000 * math.log((t + 1.0) * total[0] / ((s + 1.0) * total[1]))) for s, t in zip(source, target, strict=True)]


def _weighed(pieces: DataFrame, gains: list[int], max_n: int) -> DataFrame:
    """``key, doc_id, n_words, n_features, gain`` of chunks."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(gains, np.int64)
        for batch in batches:
            features, gain = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, texts, own in _groups(batch):
                row, bucket = hashed(texts, own, max_n, len(of))
                features[first : first + len(texts)] = np.bincount(row, minlength=len(texts))
                gain[first : first + len(texts)] = np.bincount(row, weights=of[bucket], minlength=len(texts))  # whole numbers far below 2^53
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["doc_id"], batch["own"], pa.array(features), pa.array(gain)],
                names=["key", "doc_id", "n_words", "n_features", "gain"],
            )

    return pieces.mapInArrow(of_partition, f"key long, doc_id {kind}, n_words long, n_features long, gain long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def importance_scores(
    docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for each row of ``docs (doc_id, text)`` towards ``target (text)``."""
    of_target = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    short, long = chunks(docs, max_n, chunk)
    counts = bucket_counts(short.unionByName(long), max_n, buckets)
    gains = bucket_gains(counts, bucket_counts(DataFrame.unionByName(*chunks(of_target, max_n, chunk)), max_n, buckets))
    whole = _weighed(long, gains, max_n).groupBy("key", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    rows = _weighed(short, gains, max_n).unionByName(whole)
    n = F.col("n_features")
    weight = F.when(n > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **how) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of ``docs``: the ``floor(percent * N / 100)`` highest scores
    of the N documents with ``min_words`` words at least are drawn, ties to the smaller doc_id, and ranked from 1; the others' rank is null."""
    scored = written(importance_scores(docs, target, **how), "scores")
    enough = F.col("n_words") >= min_words
    drawn = percent * scored.filter(enough).count() // 100
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.monotonically_increasing_id()  # the last one splits rows of one doc_id
    ranked = with_row_numbers(scored.filter(enough), "place", *order)
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
