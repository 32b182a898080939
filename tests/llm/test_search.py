"""Language ID, the n-gram join, components, top-k search."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from burstpick.llm import components, exact_topk, language_id, ngram_join
from burstpick.llm.queries import QUERIES


def test_held_out_accuracy(spark, tables, duck):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    langs = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = language_id.language_id(docs).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, edges):
    rows = language_id.language_id(edges).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == edges.count() and [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3
    assert got[1]["lang_pred"] != "und" and got[None]["held_out"] is False
    assert language_id.language_id(edges.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_known(edges)
    assert kept.columns == edges.columns and 2**60 + 1 in {r["doc_id"] for r in kept.collect()}


def test_language_against_plain_bayes(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    taught = [(t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 3 != 1 and t is not None and x is not None]
    model = brute.bayes(taught)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op4_language_id"](spark, tables).collect()}
    assert set(got) == {d for d, _, _ in rows}
    for d, t, _ in rows:
        lang, score = brute.language(model, t)
        assert got[d][0] == lang and got[d][1] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_more_languages_than_a_part(spark, most, monkeypatch):
    """Short texts, of which several languages are likely: scores do not depend on the parts, nor on how much is taken at a time."""
    monkeypatch.setattr(language_id, "BATCH", 3)
    monkeypatch.setattr(language_id, "PRODUCT", 50)
    rng = random.Random(most)
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 6))), lang) for i in range(60) for lang, letters in [rng.choice([("aa", "ab "), ("bb", "abc"), ("cc", "bcd1"), ("dd", "abcd"), ("ee", "ab ")])]]
    rows += [(100, None, "aa"), (101, "abc", None), (102, "12", "ff"), (103, "abcd" * 3000, "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_best", F.lit("clash")).repartition(3)
    model = brute.bayes([(t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 3 != 1 and t is not None and x is not None])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(docs, most=most).collect()}
    for d, t, _ in rows:
        lang, score = brute.language(model, t)
        assert got[d] == (lang, pytest.approx(score, abs=1e-6))
    kept = [[tuple(r) for r in language_id.keep_known(docs, most=m).orderBy("doc_id").collect()] for m in (most, 512)]
    assert kept[0] == kept[1] and language_id.keep_known(docs).columns == docs.columns


def test_grams_of_slices(monkeypatch):
    text = "".join(random.Random(1).choices("abcé \U0001f600", k=500))
    whole = np.sort(np.concatenate(list(language_id.grams(text))))
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert (np.sort(np.concatenate(list(language_id.grams(text)))) == whole).all()
    assert len(whole) == 500 + 499 + 498


def copies(seed, n_docs=120):
    """Groups of near copies at all distances round the bound, short ones too."""
    rng = random.Random(seed)
    docs = []
    for _ in range(n_docs // 8):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 30])):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            docs.append(" ".join(x.upper() if rng.random() < 0.2 else x for x in own))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,words,percent", [(1, 4, 85), (2, 5, 80), (3, 4, 85)])
def test_near_copies(spark, seed, words, percent):
    docs = copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), words, percent).collect()}
    assert got == brute.near_groups(docs, words, percent)


def test_near_copies_in_blocks(spark, monkeypatch):
    """Groups larger than a block meet block by block."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    docs = copies(9, 64)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.near_groups(docs, 4, 85)


@pytest.mark.parametrize("hot", [0, 2])
def test_common_passages(spark, monkeypatch, hot):
    """Long passages that many documents share, few of which are copies; and groups of near copies around the bound."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 6)
    rng = random.Random(hot)
    passages = [[f"p{n}w{i}" for i in range(60)] for n in range(3)]
    docs = []
    for _ in range(90):
        own = [f"o{rng.randint(0, 400)}" for _ in range(rng.choice([5, 20, 60]))]
        docs.append(" ".join(own + rng.choice(passages)))
        if rng.random() < 0.3:
            docs.append(docs[-1] + " more")
    base = [f"b{i}" for i in range(120)]
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            own[at] = f"x{rng.random()}"
        docs.append(" ".join(own))
    docs = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.near_groups(docs, 4, 85)


def test_exact_sets_only(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "a b c d e f g h i"), (4, None)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_word_hashes(monkeypatch, chunk):
    """One hash for each word, equal for equal words whatever their case and place, and however the text is cut."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng, seen = random.Random(chunk), {}
    texts = ["".join(rng.choices("aAbBZ \t\n\r\x0b\x0cé\x85\0", k=rng.randint(0, 40))) for _ in range(500)] + [("w" * 1000 + " ab") * 3, "x" * 5000, "x" * 4999, None, ""]
    for text in texts:
        words = (text or "").encode().lower().split()
        hashes = np.concatenate([ngram_join._word_hashes(part) for part in ngram_join._chunks((text or "").encode())])
        assert len(hashes) == len(words)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
        sets = {tuple(words[i : i + min(4, len(words))]) for i in range(max(1, len(words) - 3))} if words else set()
        assert len(ngram_join.shingles(text, 4)) == len(sets)
    assert len(set(seen.values())) == len(seen)


def test_leading_shingles():
    """They hold the first places of the order; the first part alone where it is enough."""
    rng = np.random.default_rng(1)
    for n in (1, 5, 6, 7, 30, 400):
        h = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        lead, first = ngram_join.leading(h, 85)
        need = n - int(ngram_join.least_shared(n, 85)) + 2
        if need < 2:
            assert len(lead) == 0
            continue
        assert first == (h % 4 == 0).sum() and len(lead) == max(first, min(n, need)) and (lead[:first] % 4 == 0).all()


@pytest.mark.parametrize("small", [0, 10, 40, 500])
def test_any_boundary(spark, monkeypatch, small):
    """Small sets, large sets, and links between the two: the boundary changes the cost alone."""
    monkeypatch.setattr(ngram_join, "boundary", lambda *_: small)
    docs = copies(21, 96)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.near_groups(docs, 4, 85)


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(45)]
    want = [[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = ngram_join.overlaps(sets)
    np.fill_diagonal(got, 0)
    assert (got == want).all()


def test_join_edges(spark, edges):
    got = ngram_join.ngram_join(edges)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()]
    by = {d: (n, c) for d, n, c in rows}
    assert len(rows) == edges.count()
    assert by[2] == (0, 2) and by[4] == (0, 4) and by[8] == by[7] == (2, 7) and by[None][1] is None and by[2**60 + 1][1] == 2**60 + 1
    assert ngram_join.ngram_join(edges.limit(0)).count() == 0
    kept = ngram_join.one_of_each(edges)
    assert kept.columns == edges.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 7, None, 2**60 + 1]))


def test_sets_travel_once(spark, monkeypatch):
    """Hardly any set but the wanted ones leaves its text's task, and none is dealt out twice before it is written."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), "id").alias("text"))
    classes = docs.filter("doc_id < 3000").select(F.col("doc_id").alias("cid"), F.col("doc_id").alias("first"), "text")
    digest = F.udf(lambda x: ngram_join.digest_of(ngram_join.shingles(x, 4)), "binary")
    classes = ngram_join.written(classes.select("cid", "first", digest("text").alias("digest")), "classes")
    filters, plans, make, write = [], {}, ngram_join._filter, ngram_join.written
    monkeypatch.setattr(ngram_join, "_filter", lambda *a: filters.append(make(*a)) or filters[-1])
    monkeypatch.setattr(ngram_join, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join._sets(docs.unionByName(docs), classes, classes.select("cid"), 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["cid"]: r["shingles"] for r in got.collect()} == {i: ngram_join.shingles(f"a b c {i}", 4).view(np.int64).tolist() for i in range(3000)}
    assert got.count() == 3000
    assert plans["sets"].count("Exchange hashpartitioning") == 2  # the sets, and the wanted classes
    (bitmap, bits), rng = filters[0], np.random.default_rng(1)
    assert ngram_join._passes(bitmap.value, bits, rng.integers(-(2**63), 2**63 - 1, 100_000)).mean() < 0.02


def test_rows_of_one_id(spark):
    """Two texts under one doc_id are one node: what either links with is joined."""
    base = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    rows = [(1, " ".join(base[0])), (2, " ".join([*base[0], "x"])), (2, " ".join([*base[1], "y"])), (3, " ".join(base[1])), (4, "alone " * 9)]
    got = [tuple(r) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).select("doc_id", "component_id").collect()]
    assert sorted(got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 260)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(60)] + [(500, 500 + i) for i in range(1, 60)]
    rng.shuffle(links)
    parent = {x: x for e in links for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def top(rows, k, every):
    vs = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n_q, (q, own) in enumerate(vs):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for n, (i, v) in enumerate(vs) if n != n_q and len(v) == len(own))[:k]
            out += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 70)
    monkeypatch.setattr(exact_topk, "LEAST_BLOCK", 30)
    monkeypatch.setattr(exact_topk, "QUERIES", 4)
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.12, 16).tolist()) for i in range(300)]
    rows += [(i, [round(float(x), 1) for x in rng.normal(0, 0.1, 16)]) for i in range(300, 400)]  # ties
    rows += [(400, [0.0] * 16), (401, None), (402, [None] + [1.0] * 15), (403, [float("nan")] + [1.0] * 15), (404, [float("inf")] * 16), (410, [0.5] * 3), (420, [0.25] * 3), (None, [1.0] * 16), (430, [])]
    rows += [(7, [0.9] * 16), (10, [0.8] * 16), (10, [0.8] * 16), (10, rows[10][1])]  # ids and rows that repeat
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("v", F.lit("clash"))
    got = sorted(tuple(r) for r in exact_topk.exact_topk(df, 5, 10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == top([(i, v if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 5, 10)


def test_top_k_of_few_and_huge(spark):
    rows = [(0, [1e30, -1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(df.filter("vec_id in (0, 3)"), 5, 50).select("query_id", "rank", "vec_id", "score").collect())
    assert [r[:3] for r in got] == [(0, 1, 3)]
    assert exact_topk.exact_topk(df.limit(0)).count() == 0
    assert exact_topk.exact_topk(df.filter("vec_id = 0")).count() == 0


FOREIGN = [
    "Мы долго шли по тёмному лесу и наконец увидели дом на берегу реки, где старый рыбак чинил сети и рассказывал нам истории о море и кораблях.",
    "Vanha mies istui talon edessä ja katseli kuinka lapset leikkivät pihalla samalla kun aurinko laski hitaasti metsän taakse ja ilta alkoi hämärtyä kylän yllä.",
    "我们 昨天 一起 去 了 北京 的 一个 很 大 的 公园 看见 许多 孩子 在 湖边 跑步 和 唱歌 然后 我们 吃 了 晚饭 回家",
]


def test_unlearned_languages_go(spark, tables):
    """The score of each is above the bound; only what is in a learned language stays."""
    rng = random.Random(8)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(3, 9))) for _ in range(25)) for _ in range(100)]
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").filter("size(split(trim(text), ' ')) >= 20")
    more = spark.createDataFrame([(-1 - n, t, None) for n, t in enumerate(FOREIGN + noise)], "doc_id long, text string, lang string")
    kept = [r["doc_id"] for r in language_id.keep_known(docs.unionByName(more)).select("doc_id").collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_fit(spark):
    rows = [("aa ab", "x"), ("ab ba aa", "x"), ("zz", "y"), ("12", "y"), (None, "y")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    [(langs, logs)] = language_id.learn(docs)
    got = language_id.fit(docs, language_id.Part(langs, logs))
    for i, lang in enumerate(langs):
        own = [logs[i][np.concatenate(list(language_id.grams(t)))] for t, x in rows if x == lang and language_id.has_letter(t)]
        means = [x.mean() for x in own]
        assert got[i] == pytest.approx([np.mean(means), np.var(means), np.mean([x.var() for x in own])])
