"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the hashed 1- to 3-grams of all labelled training texts are summed by task, then by Spark. The matrix of
log probabilities (languages x buckets) is broadcast in parts of ``most`` languages; with more labels than that, the
texts pass by one part after the other, and what is best so far goes along. Texts are scored in batches: their
counts of n-grams are a sparse matrix, whose product with the broadcast one is taken so many entries at a time that
memory is bounded whatever the number of languages or the length of a text. That score only weighs the learned languages
against each other and is 1 for most texts; whether a text is in any of them is told by its mean log probability an n-gram,
against those of the training texts of its language (``fit``). A close relative of a learned language can pass.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when nothing was
learned. Ties go to the language that sorts first. Rows with null text or null lang teach nothing. A null doc_id is
not held out. Repeated rows count each. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.llm.common import boxed, discard, written

BUCKETS = 1 << 14
#: Languages of one broadcast matrix (64 MB), and of the counts that a task holds.
MOST_LANGUAGES = 512
UNKNOWN = "und"
#: Characters taken at a time; slices overlap by two, so no n-gram is lost or seen twice.
SLICE = 1 << 20
#: Texts of a batch (at most BUCKETS entries each), and numbers of a product taken at a time (16 MB).
BATCH, PRODUCT = 64, 1 << 21
#: Added to each count.
SMOOTHING = 0.5
#: Least deviation among the texts of a language, for those with few.
MIN_SPREAD = 0.25


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams of the lower-cased text, slice by slice."""
    text = text.lower()
    for at in range(0, len(text), SLICE):
        own = np.frombuffer(text[max(0, at - 2) : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lead, found, h = min(at, 2), [], np.zeros(len(own), np.uint64)
        for n in (1, 2, 3):
            if len(own) < n:
                break
            h = (h[: len(own) - n + 1] + own[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            found.append(h[max(0, lead - n + 1) :] >> np.uint64(64 - 14))
        yield np.concatenate(found).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's n-grams and how many fall in each."""
    sums = np.zeros(BUCKETS, np.int64)
    for found in grams(text):
        sums += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(sums)
    return at, sums[at]


class Part(NamedTuple):
    """Languages, sorted, and their log probabilities: a column a bucket, and the prior's last."""

    langs: list[str]
    logs: np.ndarray


def _known(docs: DataFrame) -> DataFrame:
    return docs.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())


def learn(docs: DataFrame, most: int = MOST_LANGUAGES) -> list[Part]:
    """The languages of ``docs (text, lang)``, in parts of at most ``most``."""

    def of_partition(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}

        def taken() -> Iterator[pd.DataFrame]:
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang not in counts:
                    if len(counts) >= most:
                        yield from taken()
                    counts[lang] = np.zeros(BUCKETS + 1, np.int64)
                own = counts[lang]
                own[BUCKETS] += 1
                for found in grams(text):
                    own[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
        yield from taken()

    sums = _known(docs).mapInPandas(of_partition, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = written(sums, "grams")
    langs = [r["lang"] for r in sums.filter(F.col("bucket") == BUCKETS).select("lang").orderBy("lang").toLocalIterator()]
    parts = []
    for at in range(0, len(langs), most):
        own = langs[at : at + most]
        found = sums.filter(F.col("lang").between(own[0], own[-1])).toPandas()  # at most most * (BUCKETS + 1) rows
        counts = np.zeros((len(own), BUCKETS + 1))
        counts[found["lang"].map({x: i for i, x in enumerate(own)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
        logs = np.log(counts + SMOOTHING)
        logs[:, :BUCKETS] -= np.log((counts[:, :BUCKETS] + SMOOTHING).sum(1, keepdims=True))
        parts.append(Part(own, logs))
    discard(sums)
    return parts


def fit(docs: DataFrame, part: Part) -> np.ndarray:
    """By language of ``part``, over all its texts in ``docs (text, lang)`` that have a letter: mean and variance of their mean
    log probability an n-gram, and mean variance of the n-grams within a text."""
    langs, logs = part
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    at = {x: i for i, x in enumerate(langs)}

    def of_partition(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(at), 4))
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if lang in at and has_letter(text):
                    bucket, n = counted(text)
                    own = shared.value[at[lang], bucket]
                    mean = float(own @ n) / n.sum()
                    sums[at[lang]] += 1, mean, mean * mean, float(np.square(own - mean) @ n) / n.sum()
        seen = np.flatnonzero(sums[:, 0])
        yield pd.DataFrame({"i": seen, **{c: sums[seen, k] for k, c in enumerate("nmsw")}})

    found = _known(docs).mapInPandas(of_partition, "i long, n double, m double, s double, w double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "nmsw"])
    out = np.zeros((len(langs), 3))
    for i, n, m, s, w in found.collect():  # a row a language of the part
        out[i] = m / n, max(0.0, s / n - (m / n) ** 2), w / n
    return out


def totals(texts: list[str], by_bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text in each language (with the prior), and how many n-grams a text has: the texts' counts, a sparse
    matrix by rows, times ``by_bucket`` (buckets, and the prior last, x languages)."""
    found = [counted(x) for x in texts]
    row = np.repeat(np.arange(len(texts)), [len(b) for b, _ in found])
    bucket, n = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    out = np.repeat(by_bucket[BUCKETS:], len(texts), axis=0)
    step = max(1, PRODUCT // by_bucket.shape[1])
    for at in range(0, len(bucket), step):
        own = row[at : at + step]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[starts]] += np.add.reduceat(by_bucket[bucket[at : at + step]] * n[at : at + step, None], starts, axis=0)
    return out, np.bincount(row, n, len(texts))


_STATE = [("_lang_pred", T.StringType()), ("_best", T.DoubleType()), ("_mass", T.DoubleType()), ("_deviation", T.DoubleType())]


def _meet(docs: DataFrame, part: Part, fitted: np.ndarray | None) -> DataFrame:
    """``docs`` (``_text``, what it keeps, and the state after the parts before): the state after this part too. ``_best`` is the best
    log probability so far, ``_mass`` the sum of all, as a share of it."""
    langs, logs = part
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    state, names = pa.schema([(n, pa.string() if isinstance(t, T.StringType) else pa.float64()) for n, t in _STATE]), [n for n, _ in _STATE]

    def of_texts(texts: list[str]) -> list[tuple[str, float, float, float | None]]:
        by_bucket = shared.value
        total, n = totals(texts, by_bucket)
        best = total.argmax(1)
        top = total[np.arange(len(texts)), best]
        mass = np.exp(total - top[:, None]).sum(1)
        below = [None] * len(texts)
        if fitted is not None:
            mean, between, within = fitted[best].T
            below = ((mean - (top - by_bucket[BUCKETS, best]) / n) / np.sqrt(np.maximum(between, MIN_SPREAD**2) + within / n)).tolist()
        return [(langs[b], t, m, d) for b, t, m, d in zip(best, top.tolist(), mass.tolist(), below, strict=True)]

    def merged(old: tuple, new: tuple) -> tuple:
        if old[1] is None:
            return new
        first, second = (old, new) if old[1] >= new[1] else (new, old)
        return first[0], first[1], first[2] + second[2] * float(np.exp(second[1] - first[1])), first[3]

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                texts = batch["_text"].to_pylist()
                rows = list(zip(*(batch[c].to_pylist() for c in names), strict=True))
                known = [i for i, x in enumerate(texts) if has_letter(x)]
                for i, new in zip(known, of_texts([texts[i] for i in known]) if known else [], strict=True):
                    rows[i] = merged(rows[i], new)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), state, strict=True)]
                out = batch.drop_columns(names)
                for name, column in zip(names, columns, strict=True):
                    out = out.append_column(name, column)
                yield out

    return docs.mapInArrow(of_partition, docs.schema)


def predict(docs: DataFrame, parts: list[Part], *keep: Column | str, fitted: list[np.ndarray] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs``, untouched, and ``_lang_pred, _score, _deviation`` of its ``text``. The last is null without
    ``fitted``: by how many standard deviations the text's mean log probability is below that of its language."""
    out = docs.select(*keep, F.col("text").alias("_text"), *[F.lit(None).cast(t).alias(n) for n, t in _STATE])
    for k, part in enumerate(parts):
        before, out = out, _meet(out, part, fitted[k] if fitted else None)
        if k + 1 < len(parts):  # one pass, so one Python worker, at a time
            out = written(out, "scored")
            if k:
                discard(before)
    score = F.coalesce(1 / F.col("_mass"), F.lit(0.0)).alias("_score")
    return out.withColumn("_lang_pred", F.coalesce("_lang_pred", F.lit(UNKNOWN))).select(*[c for c in out.columns if c not in ("_text", "_best", "_mass", "_deviation")], score, "_deviation")


def held_out():
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, most: int = MOST_LANGUAGES) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs (doc_id, text, lang)``."""
    parts = learn(docs.filter(~held_out()), most)
    out = predict(docs.select("doc_id", "text"), parts, "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def keep_known(docs: DataFrame, min_score: float = 0.5, max_deviation: float = 8.5, most: int = MOST_LANGUAGES) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with some certainty: it stands out among them, and the text is not
    too far below their training texts. The model is learned from all of ``docs``."""
    parts = learn(docs, most)
    out = predict(docs, parts, boxed(docs), fitted=[fit(docs, p) for p in parts])
    return out.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= min_score) & (F.col("_deviation") <= max_deviation)).select("_row.*")
