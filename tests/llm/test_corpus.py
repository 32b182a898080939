"""Benchmark decontamination, importance resampling and phrase collocations against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstpick.llm import collocations, decontaminate, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def hits(text, items, window):
    """Words of a text, which of them are hit, and the items that hit them, word by word."""
    own, hit, found = words(text), set(), set()
    for item, said in items:
        w = words(said)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found |= {str(item)} if item is not None else set()
    return len(own), hit, sorted(found)


ITEMS = [
    (1, "What is the capital of the Republic of X? Answer: the Town of Y and Z."), (2, "one two three"), (2, "three four"), (10, "É è"),
    (None, "no name here"), (3, None), (4, ""), (5, " .,"), (6, "three four five six seven eight"), (1, "one two three"),
]


@pytest.mark.parametrize("entries", [100_000, 4])
def test_contamination(spark, edges, entries):
    rng = random.Random(5)
    some = ["one", "Two", "three", "FOUR", "five", "six", "É", "è", "no", "name", "here", "the", "x1"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", ", ", "\n", "–", "--"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "...", "\U0001f600 one-two;THREE", "é È", "what is the capital of the republic of x answer the town", "one two three" * 3, texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit("clash"))
    for window in (3, 10):
        found = decontaminate.find_contamination(docs, items, window, entries)
        for r in found.collect():
            n, hit, of = hits(texts[r["doc_id"]], ITEMS, window)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), of), texts[r["doc_id"]]
            assert {i for x in r["runs"] for i in range(x["first"], x["last"] + 1)} == hit
            for x in r["runs"]:  # the offsets lead to the same words in the original text
                own = texts[r["doc_id"]][x["begin"] : x["end"]]
                assert words(own) == words(texts[r["doc_id"]])[x["first"] : x["last"] + 1]
                assert WORD.match(own.translate(UPPER)) and WORD.match(own.translate(UPPER)[-1])
        assert found.count() == len(texts)
    kept = decontaminate.drop_contaminated(edges, items, 3, entries=entries)
    assert kept.columns == edges.columns
    assert kept.count() == sum(not hits(r["text"], ITEMS, 3)[1] for r in edges.select("text").collect())


def test_contamination_edges(spark, edges):
    items = spark.createDataFrame([(1, "same text same text"), (2, "w29999x29999")], "item_id long, text string")
    got = decontaminate.contamination_digest(decontaminate.find_contamination(edges, items)).collect()
    want = sorted(((r["doc_id"], *hits(r["text"], [], 10)[:1]) for r in edges.select("doc_id", "text").collect()), key=repr)
    assert sorted(((r["doc_id"], r["n_words"]) for r in got), key=repr) == want
    assert sorted(r["doc_id"] for r in got if r["contaminated"]) == [7, 7, 8]
    assert {r["items_sha256"] for r in got if not r["contaminated"]} == {sha256(b"").hexdigest()}
    assert decontaminate.find_contamination(edges.limit(0), items).count() == 0
    assert decontaminate.find_contamination(edges, items.limit(0)).filter("n_hit > 0").count() == 0


def test_a_run_over_blocks(spark):
    """A window that stands where a long text is cut into blocks is found, and found where it stands."""
    size = 1 << 20
    text = "ab " * ((size - 12) // 3) + "ONE two three four five " + "cd " * 100_000
    runs, items = [], []
    for docs in (spark.createDataFrame([(1, text)], "doc_id long, text string"),):
        r = decontaminate.find_contamination(docs, spark.createDataFrame([(9, "one two three four five")], "item_id long, text string")).first()
        runs, items = r["runs"], r["items"]
    assert items == ["9"] and len(runs) == 1
    assert text[runs[0]["begin"] : runs[0]["end"]] == "ONE two three four five"


def drawn(docs, target, percent=25, least=20, max_n=2, buckets=10_000, seed=7):
    """The rows of importance_resample, one document after another."""

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(f for x in texts for f in features(x)) for texts in ([x for _, x in docs], target))
    total = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1])))
    rows = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = n
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize(("max_n", "chunk"), [(2, 1 << 16), (2, 64), (1, 64), (3, 50)])
def test_resample(spark, edges, max_n, chunk):
    rng = random.Random(6)
    some = ["alpha", "Beta", "gamma", "é", "x" * 70, "7", "delta" * 20, "\U0001f600"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) + rng.choice(["", ". ", "\n"]) for _ in range(120)]
    docs = [(n, x) for n, x in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    target = ["alpha beta gamma", None, "", "é 7 alpha", "x" * 70]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("own", F.lit(1)).repartition(3)
    got = resample.importance_resample(df, spark.createDataFrame([(x,) for x in target], "text string"), max_n=max_n, chunk=chunk)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(docs, target, max_n=max_n)


def test_resample_empty(spark, edges):
    none = spark.createDataFrame([], "text string")
    assert resample.importance_resample(edges.limit(0), edges).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect()]
    assert sorted(map(tuple, resample.importance_resample(edges, none).collect()), key=repr) == drawn(rows, [])


def test_crc():
    rng = random.Random(7)
    data = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 63, 64, 65, 1000, 5, 5, 5]]
    text, start = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data[:-1])])
    got = resample._crc(np.full(len(data), 77, np.uint32), text, start, np.array(list(map(len, data))))
    assert got.tolist() == [zlib.crc32(x, 77) for x in data]


def mined(docs, least, max_words=5, most=2000, cover=100):
    """The rows of collocations from counts of all phrases."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    long = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    covered = Counter()
    for p, c in long.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) - 1:
                    inner = (p[0], *p[i:j])
                    covered[inner] = max(covered[inner], c)
    rows = []
    for p, a in long.items():
        lang, w = p[0], p[1:]
        if p in covered and 100 * covered[p] >= cover * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, " ".join(w), a, left, right, n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        out += [(lang, at, *r[1:]) for at, r in enumerate(own, 1)]
    return sorted(out)


def phrases_of(rng, n):
    some = ["a", "B", "the", "a\x01", "é", "\U0001f600", "new york", "the end of the day", "x"]
    return ["".join(rng.choice(some) + rng.choice([" ", " ", " ", ". ", "\t", "\n", ",", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("least", "max_words", "most", "cover"), [(5, 5, 2000, 100), (3, 4, 20, 80), (1, 2, 7, 100)])
def test_collocations(spark, monkeypatch, least, max_words, most, cover):
    rng = random.Random(least)
    docs = [(rng.choice(["en", "fr", None, "und", "e n"]), x) for x in [*phrases_of(rng, 150), None, "", " \t ", "..."]]
    df = spark.createDataFrame(docs, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0)).repartition(5)
    got = collocations.collocations(df, least, max_words, most, cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined(docs, least, max_words, most, cover)


def test_phrases_over_partitions_and_flushes(spark, monkeypatch):
    """One frequent pair and one long passage over many partitions of suffixes, and texts longer than what is added up at once."""
    monkeypatch.setattr(collocations, "TOGETHER", 50)
    rng = random.Random(9)
    docs = [("en", " ".join(rng.choice(["hot pair", "cold", "hot pair", "rare%d" % rng.randrange(500)]) for _ in range(80))) for _ in range(120)] + [("en", "one two three four five six seven " * 40)]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["lang"], *r["phrase"].split(" ")): r["f"] for r in collocations.phrase_counts(df, 5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = Counter()
    for lang, text in docs:
        w = text.split()
        want.update((lang, *w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    assert got == {p: c for p, c in want.items() if c >= 5}


@pytest.mark.parametrize("shared", [False, True])
def test_short_phrases_need_no_suffixes(spark, monkeypatch, shared):
    """Words and pairs are counted before suffixes are made, unless two words share a hash."""
    rng = random.Random(3)
    docs = [("en", f"{x} alone. two words! a few words go on {x}") for x in phrases_of(rng, 60)]
    tables, write = {}, collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    monkeypatch.setattr(collocations, "_ambiguous", lambda words: shared, raising=False)
    got = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), 5)
    assert sorted(map(tuple, got.collect())) == mined(docs, 5)
    sizes = {len(r["suffix"].split()) for r in tables["suffixes"].collect()}
    assert min(sizes) == (2 if shared else 3) and max(sizes) == 5


def test_collocations_edges(spark, edges):
    assert collocations.collocations(edges.limit(0)).count() == 0
    rows = [(r["lang"], r["text"]) for r in edges.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations.collocations(edges, 10).collect())) == mined(rows, 10)


def test_scores_pass_64_bits(spark):
    """Counts of a large corpus: the product is exact, and only the score must fit in 64 bits."""
    rows = spark.createDataFrame([(10**13, 10**16 + 7, 3 * 10**13, 10**13 + 1)], "a long, n long, l long, r long")
    got = rows.select(collocations.cut_score().alias("s")).first()["s"]
    assert got == 1000 * 10**13 * (10**16 + 7) // (3 * 10**13 * (10**13 + 1))
