"""Line dedup: repeated runs of lines across all documents; later copies go. DataFrame functions only.

The lines of a document that hold a word are its sequence. A line's identifier is the rank of its 128-bit digest among
the lines that stand twice or more. Prefix doubling ranks the runs of 1, 2, 4, ... lines that repeat: the pair of
two neighbouring runs' ranks is sorted among all such pairs. Only distinct pairs are sorted, never their rows, so a
line or run that stands a million times is one row there; runs that stand once leave. A run of any length is
told by the ranks of the two powers of two that cover it, as with a suffix array's common prefixes. So the suffixes that
share ``min_words`` words (an interval of common prefixes) are one group, and all but its first are later copies.

A line goes if it lies in a run of at least ``min_words`` words that also stands earlier, where earlier goes by (doc_id,
text hash, line). Such runs are found by the shortest ones that start, and that end, at each line; their union is that
of the maximal runs.

Defined cases: a null text stays null, and a text without words stays as it is. A null doc_id counts as the
smallest. Rows that repeat both doc_id and text are one document and come out alike. Lines without words stay. A
document whose lines all go becomes the empty text (``drop_repeated`` leaves it out). An empty table gives an empty
result. Other columns are kept by ``drop_repeated`` and ignored by ``line_dedup``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import WHITE, boxed, discard, let, written

#: A repeated run counts from this many words on.
MIN_WORDS = 50

_KEY = ["d", "h"]


def _n_words(line: Column) -> Column:
    plain = F.trim(F.translate(line, WHITE, " " * len(WHITE)))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +")))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_d", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("_h", F.xxhash64("text"))


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """``d, h, i, code, ahead, behind``: the i-th line with a word, and how many lines from it on, and up to it, first hold
    ``min_words`` words (null: too few)."""

    def shortest(counts: Column) -> Column:
        step = lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + x).alias("w"), (a["n"] + 1).alias("n")))
        return F.aggregate(counts, F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")), step, lambda a: F.when(a["w"] >= min_words, a["n"]))

    def of_counts(rows: Column, w: Column) -> Column:
        first = lambda i: F.greatest(F.lit(1), i + 2 - min_words)
        return F.transform(
            rows,
            lambda r, i: F.struct(
                i.alias("i"), F.unhex(F.substring(F.sha2(r["line"].cast("binary"), 256), 1, 32)).alias("code"),
                shortest(F.slice(w, i + 1, min_words)).alias("ahead"),
                shortest(F.reverse(F.slice(w, first(i), i + 2 - first(i)))).alias("behind"),
            ),
        )

    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), _n_words(x).alias("w")))
    rows = let(
        F.filter(lines, lambda r: r["w"] > 0),
        lambda rows: let(F.transform(rows, lambda r: r["w"]), lambda w: of_counts(rows, w)),
    )
    keyed = _with_key(docs.select("doc_id", "text").filter(F.col("text").isNotNull()))
    return keyed.select(F.col("_d").alias("d"), F.col("_h").alias("h"), F.inline(rows))


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, rank`` of the distinct ``by`` that stand twice or more; ranks keep their order."""
    twice = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return written(twice.orderBy(by).select(*by, F.monotonically_increasing_id().alias("rank")), "ranks")


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``d, h, first, n``: runs of ``n`` lines from line ``first`` on that are later copies."""
    lines = written(line_table(docs, min_words), "lines")
    ranks = _ranked(lines, ["code"])
    known = written(lines.join(ranks, "code").drop("code").dropDuplicates([*_KEY, "i"]), "known")
    discard(lines, ranks)
    levels = {1: known.select(*_KEY, "i", "rank")}
    longest = known.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0
    k = 1
    while 2 * k <= longest:
        own = levels[k]
        after = own.select(*_KEY, (F.col("i") - k).alias("i"), F.col("rank").alias("then"))
        pairs = written(own.join(after, [*_KEY, "i"]), "pairs")
        ranks = _ranked(pairs.select(F.col("rank").alias("a"), F.col("then").alias("b")), ["a", "b"])
        new = ranks.select(F.col("a").alias("rank"), F.col("b").alias("then"), F.col("rank").alias("new"))
        levels[2 * k] = written(pairs.join(new, ["rank", "then"]).select(*_KEY, "i", F.col("new").alias("rank")), "level")
        discard(pairs, ranks)
        k *= 2

    i = F.col("i")
    runs = known.select(*_KEY, F.lit(0).alias("side"), i.alias("first"), F.col("ahead").alias("n")).unionByName(
        known.select(*_KEY, F.lit(1).alias("side"), (i - F.col("behind") + 1).alias("first"), F.col("behind").alias("n"))
    )
    parts = []
    for k, level in levels.items():
        own = runs.filter((F.col("n") >= k) & (F.col("n") < 2 * k)).withColumn("last", F.col("first") + F.col("n") - k)
        head = level.select(*_KEY, F.col("i").alias("first"), F.col("rank").alias("head"))
        tail = level.select(*_KEY, F.col("i").alias("last"), F.col("rank").alias("tail"))
        own = own.join(head, [*_KEY, "first"])
        parts.append(own.withColumn("tail", F.col("head")) if k == 1 else own.join(tail, [*_KEY, "last"]))
    told = written(reduce(DataFrame.unionByName, [p.select(*_KEY, "side", "first", "n", "head", "tail") for p in parts]), "runs")
    discard(known, *[level for k, level in levels.items() if k > 1])
    group, place = ["side", "n", "head", "tail"], F.struct("d", "h", "first")
    origin = told.groupBy(group).agg(F.min(place).alias("origin"), F.max(place).alias("end")).filter(F.col("origin") < F.col("end"))
    origin = written(origin.drop("end"), "origins")  # a table: so the join below can split a run that stands very often
    return told.join(origin, group).filter(place > F.col("origin")).select(*_KEY, "first", "n")


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """``_row, doc_id, n_lines, n_deleted`` and the new ``text``; ``_row`` is the whole row of ``docs``."""
    gone = later_runs(docs, min_words).select(*_KEY, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i"))
    gone = gone.groupBy(F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.collect_set("i").alias("gone"))
    all_lines = F.split("text", "\n")
    places = lambda a: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda j: F.translate(F.get(a, j), WHITE, "") != "")
    without = lambda a, p: F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.transform(F.col("gone"), lambda i: F.get(p, i)))
    kept = let(all_lines, lambda a: let(places(a), lambda p: F.array_join(F.transform(without(a, p), lambda j: F.get(a, j)), "\n")))
    n_lines = F.size(F.filter(all_lines, lambda x: F.translate(x, WHITE, "") != ""))
    text = F.when(F.col("gone").isNull(), F.col("text")).when(F.size("gone") == n_lines, F.lit("")).otherwise(kept)
    rows = _with_key(docs.select(boxed(docs), "doc_id", "text")).join(gone, ["_d", "_h"], "left")
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return rows.select("_row", "doc_id", count(n_lines, "n_lines"), count(F.size("gone"), "n_deleted"), text.alias("text"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, text`` for each row of ``docs (doc_id, text)``: lines with a word, how many of them
    go, and the text without them."""
    return _deduped(docs.select("doc_id", "text"), min_words).drop("_row")


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with shorter texts, without the rows that have lost all of theirs."""
    out = _deduped(docs, min_words).filter((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
