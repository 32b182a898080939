"""Phrase collocation mining: the phrases whose words stand together more often than chance, by language.

Texts (A-Z lower-cased) are split into pieces at sentence marks and line ends, and pieces into words at blanks and tabs. A phrase is
a run of words within a piece. Phrases are counted as in Suffix-sigma (Berberich and Bedathur, 2013):

1. Words are counted first, then pairs of frequent words, by the hashes of both. A phrase is no more frequent than its rarest word
   or pair, so one that is too rare ends a suffix as a piece's end does. What is frequent goes to the tasks as bits of two tables of
   fixed size (``BITS``): a rare word or pair whose bit is set by another one is kept, which costs rows but changes no count.
2. With that, phrases of one and two words are counted. Each position that three words or more go on from gives its suffix, cut to
   ``max_words`` words; equal suffixes are added up in the task. Should two words share a hash, pairs are counted by suffixes too.
3. Suffixes are shuffled by language and first word, and by the further words where one first word holds more than a
   partition's share (ranges of the sorted order, so one frequent word, pair or passage is split), and sorted
   reverse-lexicographically. One stack counts all prefixes: a phrase leaves it when the next suffix doesn't start with it. Only
   prefixes of a partition's first and last suffix can go on in another one; these come out whatever their count, and are added up.
4. Both parts of a phrase are phrases too, so each cut of a candidate is a join with the counts twice, and the lowest score of
   its cuts is its score, in exact decimals.

Defined cases: a null text is an empty one; a null lang is ``und``. Repeated rows count each. An empty table gives an empty result.
Other columns are ignored. Ties of cuts go to the shorter first part; ranks are by score, count and the phrase's bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstpick.llm.common import blocks, discard, let, written

MAX_WORDS, LEAST, MOST_RANKS, COVER_PERCENT = 5, 100, 2000, 100
#: The table of frequent words has 2^BITS bits (8 MB).
BITS = 26
#: A task adds up equal words, and equal suffixes, over about so many words.
TOGETHER = 1_000_000
#: Salts of a language's top list: each salt's own list is made first.
SALTS = 64

#: The characters that part pieces; all are told to the tokenizer as full stops.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(46 if b in _BREAKS else 32 if b == 9 else b for b in bytes(range(256)).lower())
_BREAK = b"."


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def _words(text: bytes | None) -> Iterator[list[bytes]]:
    """The text's words, a full stop where a piece ends, block by block."""
    for block in blocks((text or b"").translate(_PLAIN)):
        yield block.replace(_BREAK, b" . ").split()


def _by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], bool]]:
    """Language, words and whether a document ends with them."""
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            for words in _words(text.as_py()):
                yield lang, words, False
            yield lang, [_BREAK], True


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, phrase, f, h`` of all words of ``docs (lang, text)``; ``h`` is a hash of the word in its language."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                own.pop(_BREAK, None)
                hashes = np.fromiter((_hash(lang, w) for w in own), np.uint64, len(own)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array(hashes)],
                    names=["lang", "phrase", "f", "h"],
                )
            counts.clear()

        for lang, words, ends in _by_language(batches):
            counts.setdefault(lang, Counter()).update(words)
            if ends and sum(map(len, counts.values())) > TOGETHER // 4:
                yield from rows()
        yield from rows()

    found = _texts(docs).mapInArrow(of_partition, "lang string, phrase string, f long, h long")
    return found.groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))


def _bits(hashes: DataFrame) -> Broadcast:
    """The highest BITS bits of ``hashes (h)`` as a table of flags: 2^BITS of them in all, however many rows there are."""
    one = F.shiftrightunsigned("h", 64 - BITS) + 1  # Spark's bitmaps begin at 1
    own = hashes.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    flags = np.zeros(1 << BITS >> 3, np.uint8)
    for r in own.toLocalIterator():
        flags[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(flags)


def _flagged(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _hash(lang: str, word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8, salt=blake2b(lang.encode(), digest_size=16).digest()).digest(), "little")


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash for each pair of words of these hashes."""
    both = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    both = (both ^ (both >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return both ^ (both >> np.uint64(32))


class _Codes(dict):
    """Word -> its number from 1 on, or 0 where a piece ends or the word is rare."""

    def __init__(self, lang: str, flags: np.ndarray):
        super().__init__({_BREAK: 0})
        self.lang, self.flags, self.words, self.hashes = lang, flags, [b""], [0]

    def __missing__(self, word: bytes) -> int:
        h, code = _hash(self.lang, word), 0
        at = h >> (64 - BITS)
        if self.flags[at >> 3] >> (at & 7) & 1:
            code = len(self.words)
            self.words.append(word + b" ")
            self.hashes.append(h)
        self[word] = code
        return code


Block = Callable[[_Codes, np.ndarray, int], pa.RecordBatch]


def _in_blocks(docs: DataFrame, flags: Broadcast, carry: int, of_block: Block, schema: str) -> DataFrame:
    """``of_block`` of the coded words of all documents, block by block: a block has the first places that it owns, and up to
    ``carry`` more behind them that begin the next one."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, _Codes] = {}
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def rows(going_on: str | None) -> Iterator[pa.RecordBatch]:
            for lang, parts in list(held.items()):
                ids = np.concatenate(parts)
                keep = 0 if lang != going_on else min(carry, len(ids))
                if len(ids) > keep:
                    yield of_block(codes[lang], ids, len(ids) - keep)
                held[lang] = [ids[len(ids) - keep :]]

        for lang, words, ends in _by_language(batches):
            own = codes.get(lang)
            if own is None:
                own = codes[lang] = _Codes(lang, flags.value)
            held.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
            n += len(words)
            if n >= TOGETHER:
                yield from rows(None if ends else lang)
                n = 0
                if ends:
                    codes.clear()
                    held.clear()
        yield from rows(None)

    return _texts(docs).mapInArrow(of_partition, schema)


def _hashes_of(codes: _Codes, ids: np.ndarray) -> np.ndarray:
    return np.array(codes.hashes, np.uint64)[ids]


def _pair_block(codes: _Codes, ids: np.ndarray, starts: int) -> pa.RecordBatch:
    ids = ids[: starts + 1]
    both, n = np.unique((ids[:-1] << 32 | ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)], return_counts=True)
    a, b = _hashes_of(codes, both >> 32), _hashes_of(codes, both & 0xFFFFFFFF)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n, pa.int64())], names=["a", "b", "n"])


def _suffix_block(pair_flags: Broadcast, max_words: int, min_words: int) -> Block:
    """The suffixes of ``min_words`` words or more at the places that a block owns, each once with its count."""

    def of_block(codes: _Codes, ids: np.ndarray, starts: int) -> pa.RecordBatch:
        h = _hashes_of(codes, ids)
        after = np.zeros(len(ids), bool)  # whether a suffix goes on behind a place
        after[:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & _flagged(pair_flags.value, _pairs(h[:-1], h[1:]))
        grid = np.zeros((max_words, starts), np.int64)
        grid[0], alive = ids[:starts], np.ones(starts, bool)
        for k in range(1, max_words):
            on = after[k - 1 : k - 1 + starts]
            alive[: len(on)] &= on
            alive[len(on) :] = False
            at = np.flatnonzero(alive)
            grid[k, at] = ids[at + k]
        grid = grid[:, grid[min_words - 1] > 0]
        pairs = [grid[k] << 32 | (grid[k + 1] if k + 1 < max_words else 0) for k in range(0, max_words, 2)]
        order = np.lexsort(pairs[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([p[order][1:] != p[order][:-1] for p in pairs], axis=0)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(order)))
        words = pa.array(codes.words, pa.binary())
        parts = [words.take(pa.array(column)) for column in grid[:, order[at]]]
        suffix = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary())) if len(parts) > 1 else parts[0]
        return pa.RecordBatch.from_arrays([pa.array([codes.lang] * len(at), pa.string()), suffix.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "suffix", "n"])

    return of_block


def frequent_pairs(docs: DataFrame, words: Broadcast, least: int) -> DataFrame:
    """``a, b, n``: hashes of both words of the pairs of frequent words that stand ``least`` times or more, and how often they do."""
    found = _in_blocks(docs, words, 1, _pair_block, "a long, b long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _hashed(pairs: DataFrame) -> DataFrame:
    """``h`` of ``pairs (a, b)``."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch[c].to_numpy().view(np.uint64) for c in "ab")
            yield pa.RecordBatch.from_arrays([pa.array(_pairs(a, b).view(np.int64))], names=["h"])

    return pairs.select("a", "b").mapInArrow(of_partition, "h long")


def _ambiguous(words: DataFrame) -> bool:
    """Whether two words share a hash."""
    return bool(words.groupBy("h").count().filter(F.col("count") > 1).limit(1).count())


def suffixes(docs: DataFrame, words: Broadcast, pairs: Broadcast, max_words: int = MAX_WORDS, min_words: int = 1) -> DataFrame:
    """``lang, suffix, n``: the suffixes of all pieces that have ``min_words`` words or more, cut to ``max_words``, each word followed
    by a blank."""
    return _in_blocks(docs, words, max_words - 1, _suffix_block(pairs, max_words, min_words), "lang string, suffix string, n long")


def _count_prefixes(least: int, min_words: int):
    """The stack over one partition's sorted suffixes; prefixes of fewer than ``min_words`` words don't come out."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, words, counts = None, [], []  # the open prefixes: words[:k] has stood counts[k - 1] times beside those inside longer ones
        old = -1  # so many of them are prefixes of the partition's first suffix
        found: list[tuple[str, str, int]] = []

        def close(depth: int, ends: bool) -> None:
            nonlocal old
            while len(words) > depth:
                f = counts.pop()
                if counts:
                    counts[-1] += f
                if len(words) >= min_words and (f >= least or ends or len(words) <= old):
                    found.append((lang, " ".join(words), f))
                words.pop()
            old = min(old, depth)

        def rows() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [()] * 3
            kinds = pa.string(), pa.string(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "phrase", "f"])

        for batch in batches:
            for of, suffix, n in zip(batch["lang"].to_pylist(), batch["suffix"].to_pylist(), batch["n"].to_pylist(), strict=True):
                new = suffix.split(" ")
                new.pop()
                shared, old = 0, len(new) if old < 0 else old
                if of == lang:
                    for a, b in zip(words, new, strict=False):
                        if a != b:
                            break
                        shared += 1
                if len(words) > shared:
                    close(shared, False)
                if len(new) > shared:
                    lang = of
                    words += new[shared:]
                    counts += [0] * (len(new) - shared)
                counts[-1] += n
            yield rows()
            found.clear()
        if words:
            close(0, True)
            yield rows()

    return of_partition


def phrase_counts(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, words: DataFrame | None = None) -> DataFrame:
    """``lang, phrase, n_words, f``: all phrases of 1 to ``max_words`` words of ``docs (lang, text)`` that stand ``least`` times or more.
    ``words`` may give their ``word_counts``."""
    words = words if words is not None else written(word_counts(docs), "words")
    often = words.filter(F.col("f") >= least)
    found = often.select("lang", "phrase", F.lit(1).alias("n_words"), "f")
    if max_words < 2:
        return found
    frequent = _bits(often.select("h"))
    pairs = written(frequent_pairs(docs, frequent, least), "pairs")
    flags = _bits(_hashed(pairs))
    counted = 1 if _ambiguous(words) else 2
    if counted == 2:
        side = lambda h, part: often.select("lang", F.col("h").alias(h), F.col("phrase").alias(part))
        both = pairs.join(side("a", "left"), "a").join(side("b", "right"), ["lang", "b"])
        found = found.unionByName(both.select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), F.lit(2).alias("n_words"), F.col("n").alias("f")))
    if max_words == counted:
        return found
    # a table: its ranges are told from a sample, so it is read twice
    table = written(suffixes(docs, frequent, flags, max_words, counted + 1), "suffixes")
    order = F.col("lang").desc(), F.col("suffix").desc()
    sorted_ = table.repartitionByRange(*order).sortWithinPartitions(*order)
    counts = sorted_.mapInArrow(_count_prefixes(least, counted + 1), "lang string, phrase string, f long")
    counts = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return found.unionByName(counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "f"))


def cut_score() -> Column:
    """floor(1000 a n / (l r)), exactly: counts below 10^17, products of up to 38 digits."""
    return F.expr(
        "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    )


def _top(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` of each language, ranked: first of each salt, so that a language's rows are no one task's."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    own = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= most)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("_salt")


def collocations(
    docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, most: int = MOST_RANKS, cover_percent: int = COVER_PERCENT
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``most`` best phrases of 2 to ``max_words`` words of each language: ``a``, ``l``
    and ``r`` count the phrase and the two parts of its lowest-scoring cut, ``n`` all words, and the score is
    ``floor(1000 a n / (l r))``. Phrases inside a longer one that stands ``cover_percent`` in a hundred as often, or more, are left out."""
    words = written(word_counts(docs), "words")
    phrases = written(phrase_counts(docs, least, max_words, words), "phrases")
    total = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")  # a table, so that Spark knows how small it is
    discard(words)
    many = phrases.filter(F.col("n_words") > 1).withColumn("w", F.split("phrase", " "))

    cut = lambda w, k: F.struct(
        k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(w, k + 1, F.size(w) - k), " ").alias("right")
    )
    cuts = many.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: cut(F.col("w"), k))))
    side = lambda part, f: phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(cut_score().alias("score"), "k", "a", "l", "r", "n")).alias("best"))

    inner = let(F.col("w"), lambda w: F.flatten(F.transform(
        F.sequence(F.lit(2), F.size(w) - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.array_join(F.slice(w, i, m), " ")),
    )))
    inside = many.filter(F.col("n_words") > 2).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("_f").isNull() | (100 * F.col("_f") < cover_percent * F.col("best.a")))
    kept = kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
    out = _top(kept, most, F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = written(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(phrases, total)
    return out
