"""The pipeline's stages, one after another, against plain versions."""

import random

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burstpick.llm import best_fit
from burstpick.llm.common import written


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, tables), "stage")
        outs.append(docs)
    assert all(o.columns == columns for o in outs[:-1])

    rows = {d: t for d, t in rows.items() if not brute.base_failed(brute.quality(t))}
    assert {r["doc_id"] for r in outs[0].collect()} == set(rows)  # no host is condemned here
    assert {r["doc_id"] for r in outs[1].collect()} == set(rows)  # and every text has a language
    lines = brute.line_dedup(rows)
    rows = {d: t for d, (n, gone, t) in lines.items() if not gone or gone < n}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in outs[2].collect()}
    assert got == {d: (t, len(t)) for d, t in rows.items()}
    rows = {d: rows[d] for d, (_, c) in brute.near_groups(list(rows.items()), 5, 80).items() if c == d}
    assert {r["doc_id"]: r["text"] for r in outs[3].collect()} == rows
    t = Tokenizer.from_file(best_fit.default_tokenizer())
    want = sorted((d, *p) for d, text in rows.items() for p in brute.pieces(t, text))
    packed = outs[4].collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert brute.check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in packed]) == brute.best_fit_bins([w[3] for w in want], 2048)


def odd_documents(spark):
    """Nulls in every column, empty and short texts, copies, repeated rows, a long text, a passage of two documents, columns that clash."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choices("aeinorst", k=rng.randint(3, 8))) for _ in range(n))
    a, b, c, d, passage, long = (words(n) for n in (60, 40, 40, 45, 60, 30_000))
    near, big = f"{a} more", 2**60 + 1
    rows = [
        (1, a.replace(" ", "\n", 1), "s", "en"), (2, a.replace(" ", "\t", 1), None, None), (3, near.replace(" ", "  ", 1), "s", "en"), (None, c, None, None),
        (4, None, "s", "en"), (5, "", None, None), (6, "too short", "s", "en"), (big, f"{b}\n{passage}", "s", "en"), (7, f"{d}\n{passage}", "s", None),
        (8, words(30), "t", "en"), (9, long, "s", "en"),
    ]
    rows.append(rows[-2])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    kept = {1: [rows[0][1]], 7: [rows[8][1]], 8: [rows[9][1]] * 2, 9: [long], None: [c], big: [b]}
    return df.withColumn("_row", F.lit("_row")).withColumn("component_id", F.lit(None).cast("long")).withColumn("a.b", F.lit("a.b")).withColumn("n", F.lit(1.5)), kept


def test_odd_documents(spark):
    docs, kept = odd_documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), "odd")
        assert docs.columns == columns, name
    got = {}
    for r in docs.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["_row"] == "_row" and r["a.b"] == "a.b" and r["n"] == 1.5
    assert got == kept
    t = Tokenizer.from_file(best_fit.default_tokenizer())
    want = sorted((str(d), *p) for d, texts in kept.items() for text in texts for p in brute.pieces(t, text))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    assert brute.check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in packed]) == brute.best_fit_bins([w[3] for w in want], 2048)


def test_no_documents(spark, tmp_path):
    """The whole run over an empty table."""
    odd_documents(spark)[0].limit(0).drop("n").withColumn("n_chars", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert "pipeline" in queries and all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(queries)
