"""Quality rules on documents, with a verdict on their host. DataFrame functions only.

A document fails by itself when it is short or repeats itself. Its host (``source``) is judged by the share of
its documents that fail any rule: that share is shrunk towards the share of all hosts by a beta prior, whose two
parameters are fitted to the hosts' shares by the method of moments, so that a host with a few documents is not
condemned by one of them. Documents of a condemned host go.

Defined cases: a null text counts as the empty text (it fails: too few words). A null host is a host of its own.
An empty table gives an empty result. Repeated rows count each. Other columns are ignored, whatever their names.
The 8-word windows of one text are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import WHITE, boxed, let, written

#: Words in a window of ``n_repeat_words``.
WINDOW = 8
#: A document with fewer words fails.
MIN_WORDS = 20
#: A document fails when more than this percentage of its words repeats.
MAX_REPEAT_PCT = 30
#: For hosts only: more symbols than this percentage of the words, or more repeated lines than this one of the lines.
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
#: A host whose shrunk share of failures is above this is condemned.
MAX_HOST_RATE = 0.5
#: The prior counts as this many documents at least.
MIN_STRENGTH = 1.0

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def words(text: Column) -> Column:
    spaces = F.translate(text, WHITE[1:], " " * (len(WHITE) - 1))
    return F.filter(F.split(spaces, " "), lambda w: w != "")


def _covered(windows: Column) -> Column:
    """Words under the windows whose hash stands twice or more in ``windows``: equal hashes are neighbours once
    sorted; then each such window adds its words up to the next one's start."""

    def of_positions(p: Column) -> Column:
        step = lambda at, j: F.when(j < F.size(p) - 1, F.least(F.lit(WINDOW), F.get(p, j + 1) - at)).otherwise(WINDOW)
        return F.aggregate(F.transform(p, step), F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)) | (
            (j > 0) & F.coalesce(F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == e["h"], F.lit(False))
        )
        return let(F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"])), of_positions)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.sort_array(pairs), of_sorted)


def repeat_words(w: Column) -> Column:
    def of_windows(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g))

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])), of_windows)

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))


def document_stats(text: Column) -> Column:
    """A struct of STATS, all long, from one pass over the text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    long = lambda c, name: c.cast("long").alias(name)
    return let(
        F.struct(words(text).alias("w"), lines.alias("l"), text.alias("t")),
        lambda v: F.struct(
            long(F.size(v["w"]), "n_words"),
            long(F.length(F.translate(v["t"], WHITE, "")), "word_chars"),
            long(F.length(v["t"]) - F.length(F.translate(v["t"], "#*$%&|<>", "")), "n_symbols"),
            long(F.size(v["l"]) - F.size(F.array_distinct(v["l"])), "n_dup_lines"),
            long(repeat_words(v["w"]), "n_repeat_words"),
            long(F.size(v["l"]), "n_lines"),
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def any_failed() -> Column:
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
    )


def host_verdicts(stats: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed, rate, host_kept`` from ``stats`` (``host`` and STATS). The sums of a host are
    taken before the shuffle; to the driver goes one row, the mean and variance of the hosts' shares."""
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(any_failed()).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    mean, var = hosts.agg(F.avg(share), F.coalesce(F.var_samp(share), F.lit(0.0))).first()
    mean, var = mean or 0.0, var or 0.0
    strength = max(MIN_STRENGTH, mean * (1 - mean) / var - 1) if var > 0 else MIN_STRENGTH
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= F.lit(max_rate))


def quality_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id, host``, STATS, ``base_failed, host_rate, kept`` for each row of ``docs (doc_id, text, source)``."""
    stats = docs.select("doc_id", F.col("source").alias("host"), document_stats(F.col("text")).alias("s"))
    stats = written(stats.select("doc_id", "host", *[f"s.{c}" for c in STATS]), "quality")
    hosts = host_verdicts(stats, max_rate).select(F.col("host").alias("_host"), "rate", "host_kept")
    out = stats.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left")
    failed = base_failed()
    return out.select(
        "doc_id", "host", *STATS, failed.alias("base_failed"), F.col("rate").alias("host_rate"),
        (~failed & F.col("host_kept")).alias("kept"),
    )


def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The rules run once: a table holds each row's host and stats, and the row itself where it has not failed. Condemned hosts
    are a table too, so that Spark knows its size and, while that is small, broadcasts it; the texts are shuffled only
    beside more condemned hosts than a broadcast may hold."""
    rows = docs.select(boxed(docs), F.col("source").alias("_host"), document_stats(F.col("text")).alias("_s"))
    rows = rows.select("_row", F.col("_host").alias("host"), *[f"_s.{c}" for c in STATS]).withColumn("_row", F.when(~base_failed(), F.col("_row")))
    judged = written(rows, "judged")
    condemned = host_verdicts(judged.select("host", *STATS), max_rate).filter(~F.col("host_kept"))
    condemned = written(condemned.select(F.col("host").alias("_host")), "condemned")
    good = judged.select("_row", "host").filter(F.col("_row").isNotNull())
    return good.join(condemned, F.col("host").eqNullSafe(F.col("_host")), "left_anti").select("_row.*")
