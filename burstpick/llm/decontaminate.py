"""Benchmark decontamination: where windows of benchmark items stand in documents.

Texts are normalised to words: A-Z lower-cased, a word is a run of digits, letters a-z and characters outside ASCII. A
window is ``window`` consecutive words of an item (question and answer text), or all words of an item that has fewer. One
Aho-Corasick automaton holds the windows of all items. Its letters are words: each word of the benchmark has a code, every
other word of a text is code 0, so a match begins and ends with a word, and a state is at most ``window`` deep. A text is read
once, block by block, the automaton's state going on from block to block. Matches become runs of words, and runs become
offsets of the original text, in code points.

The automaton goes to the executors, so its size is checked: entries (windows times the items that have them) are counted
first, and beyond ``ENTRIES`` the windows are dealt by hash to several automata, each read over the texts in a job branch of its
own; only rows with a match leave those branches, and they meet by the text's digest.

Defined cases: a null text, or one without words, has no word and no hit. Items without words have no window. Items that share
an item_id are one item; an item without an id hits words, but is neither counted nor listed. Repeated rows of either table
count each as they stand (documents) or once (windows). An empty table of documents gives an empty result, an empty benchmark
no hit. Other columns are ignored by ``find_contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.llm.common import WORD_BYTES, arrow_rows, blocks, boxed, discard, written

WINDOW = 10
#: Entries of one automaton: about 1 KB each in a worker.
ENTRIES = 100_000
#: Of a match: its first and last word, counted from 0, and where these begin and end in the text, in code points.
RUN = "struct<first:long, last:long, begin:long, end:long>"
FOUND = f"n_words long, digest binary, items array<string>, runs array<{RUN}>"
_FOUND = {
    "n_words": pa.int64(),
    "digest": pa.binary(),
    "items": pa.list_(pa.string()),
    "runs": pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "begin", "end")])),
}

_BUILT: dict[str, tuple] = {}


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window, item``: each window of ``items (item_id, text)``, its words parted by blanks, once for each item."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = arrow_rows("window string, item string")
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = (text or b"").translate(WORD_BYTES).decode().split(" ")
                words = [w for w in words if w]
                n = min(window, len(words))
                rows += {(" ".join(words[i : i + n]), item) for i in range(len(words) - n + 1 if n else 0)}
            yield rows_of(rows)

    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(of_partition, "window string, item string").distinct()


def _automaton(listed: Broadcast) -> tuple:
    """The automaton of the listed windows and the words' codes; a worker keeps the last one it has made."""
    import ahocorasick

    name, entries = listed.value
    if name not in _BUILT:
        codes: dict[bytes, str] = {}
        letters = (chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
        built = ahocorasick.Automaton()
        for window, items in entries:
            words = window.encode().split(b" ")
            for w in words:
                if w not in codes:
                    codes[w] = next(letters)
            built.add_word("".join(codes[w] for w in words), (len(words), items))
        built.make_automaton()
        _BUILT.clear()
        _BUILT[name] = built, codes
    return _BUILT[name]


def _matches(data: bytes, built, codes: dict[bytes, str]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of a text, the runs of words under windows (first and last, apart from each other, in order), and the items."""
    n, runs, items, search = 0, [], set(), None
    for block in blocks(data.translate(WORD_BYTES)):
        words = block.split()
        n += len(words)
        if not len(built):
            continue
        said = "".join([codes.get(w, "\0") for w in words])
        if search is None:
            search = built.iter(said)
        else:
            search.set(said)
        for last, (length, of) in search:
            first = last - length + 1
            while runs and runs[-1][1] >= first - 1:
                first = min(first, runs.pop()[0])
            runs.append((first, last))
            items.update(of)
    return n, runs, items


_WORD = re.compile(rb"[^ ]+")


def _placed(data: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Where runs of words begin and end in the text, in code points."""
    plain, out, at, chars, nth = data.translate(WORD_BYTES), [], 0, 0, -1
    bytes_of = np.frombuffer(data, np.uint8)
    edges = iter(sorted({e for run in runs for e in run}))
    place, edge = {}, next(edges, None)
    for word in _WORD.finditer(plain):
        nth += 1
        if nth != edge:
            continue
        for stop in (word.start(), word.end()):
            chars += int(np.count_nonzero((bytes_of[at:stop] & 0xC0) != 0x80))
            at = stop
            place.setdefault(nth, []).append(chars)
        if (edge := next(edges, None)) is None:
            break
    for first, last in runs:
        out.append({"first": first, "last": last, "begin": place[first][0], "end": place[last][1]})
    return out


def _scan(docs: DataFrame, listed: Broadcast, every: bool) -> DataFrame:
    """The columns of ``docs`` but ``_text`` (bytes), and FOUND: for every row, or for rows with a match only."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, codes = _automaton(listed)
        for batch in batches:
            found, kept = [], []
            for at, text in enumerate(batch["_text"]):
                data = text.as_py() or b""
                n, runs, items = _matches(data, built, codes)
                if every or runs:
                    kept.append(at)
                    found.append((n, sha256(data).digest() if runs else None, sorted(items), _placed(data, runs) if runs else []))
            rows = batch.drop_columns(["_text"])
            rows = rows if every else rows.take(pa.array(kept, pa.int64()))
            columns = zip(*found, strict=True) if found else [()] * len(_FOUND)
            more = [pa.array(values, kind) for values, kind in zip(columns, _FOUND.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, *_FOUND])

    return docs.mapInArrow(of_partition, T.StructType(docs.drop("_text").schema.fields + T.StructType.fromDDL(FOUND).fields))


def _merged(runs: Column) -> Column:
    """Runs in order, those that overlap or touch as one."""
    last = lambda a: F.element_at(a, -1)
    longer = lambda x, y: F.struct(
        x["first"].alias("first"), F.greatest(x["last"], y["last"]).alias("last"), x["begin"].alias("begin"), F.greatest(x["end"], y["end"]).alias("end")
    )
    add = lambda a, r: F.when(
        (F.size(a) > 0) & (last(a)["last"] >= r["first"] - 1), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer(last(a), r)))
    ).otherwise(F.concat(a, F.array(r)))
    return F.aggregate(F.array_sort(runs), F.lit(None).cast(f"array<{RUN}>"), lambda a, r: F.when(a.isNull(), F.array(r)).otherwise(add(a, r)))


def _found(docs: DataFrame, items: DataFrame, window: int, entries: int) -> DataFrame:
    """``docs`` (with ``_text``) and ``n_words, items, runs``."""
    spark = docs.sparkSession
    listed = written(windows(items, window), "windows")
    parts = max(1, -(-listed.count() // entries))

    def of_part(part: int) -> Broadcast:
        own = listed.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        rows = own.groupBy("window").agg(F.collect_set("item").alias("items")).collect()  # about ``entries`` of them
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["window"], r["items"]) for r in rows]))

    out = _scan(docs, of_part(0), every=parts == 1)
    if parts == 1:
        discard(listed)
        return out.drop("digest")
    texts = docs.select("_text")
    hits = reduce(DataFrame.unionAll, [_scan(texts, of_part(p), every=False).withColumn("part", F.lit(p)) for p in range(parts)])
    discard(listed)
    hits = hits.groupBy("digest", "part").agg(F.first("items").alias("items"), F.first("runs").alias("runs"))  # copies of a text say the same
    hits = hits.groupBy("digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs")
    )
    none = spark.sparkContext.broadcast((uuid.uuid4().hex, []))
    plain = _scan(docs.withColumn("_sha", F.unhex(F.sha2("_text", 256))), none, every=True).select(*docs.drop("_text").columns, "_sha", "n_words")
    both = plain.join(hits, plain["_sha"] == hits["digest"], "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return both.select(
        *docs.drop("_text").columns, "n_words", empty(F.col("items"), "array<string>").alias("items"),
        empty(_merged(F.col("runs")), f"array<{RUN}>").alias("runs"),
    )


def n_hit(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, entries: int = ENTRIES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, runs`` for each row of ``docs (doc_id, text)``: how many words it has, how many of them
    are under windows of ``items (item_id, text)``, the ids of these items as sorted strings, and the runs of such words with
    their offsets in the text (RUN)."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    return _found(rows, items, window, entries).select("doc_id", "n_words", n_hit(F.col("runs")).alias("n_hit"), "items", "runs")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_percent: float = 0.0, entries: int = ENTRIES) -> DataFrame:
    """The rows of ``docs``, with all their columns, of whose words at most ``max_percent`` in a hundred are hit."""
    found = _found(docs.select(boxed(docs), F.col("text").cast("binary").alias("_text")), items, window, entries)
    return found.filter(100 * n_hit(F.col("runs")) <= F.lit(max_percent) * F.col("n_words")).select("_row.*")


def contamination_digest(found: DataFrame) -> DataFrame:
    """Of ``find_contamination``'s rows the counts, and a digest of the items."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
