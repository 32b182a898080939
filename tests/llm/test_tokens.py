"""Token counts, the codec, packing."""

import hashlib
import random
import zlib
from itertools import product

import brute
import numpy as np
import pytest
from conftest import LONG

from burstpick.llm import best_fit, piece_codec, token_counts, unigram, word_tokens


@pytest.fixture(scope="module")
def words():
    return unigram.vocabulary(unigram.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    """The same vocabulary and scores under the unigram model of the ``tokenizers`` library, over the lattice of the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=unigram.default_vocabulary())
    special = lambda i: model.is_control(i) or model.is_unknown(i)
    vocab = [(f"\U0010ffff{i}", 0.0) if special(i) else (model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="never", split=False)
    return lambda text: t.encode(unigram.MARK + text.replace(" ", unigram.MARK), add_special_tokens=False).ids if text else []


def random_texts(n):
    rng = random.Random(n)
    parts = ["a", "b", "e", "th", "he", "in", " ", "  ", "\n", "é", "中", "\U0001f600", "\t", "T", ".", " the", "1", "\x00"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_best_path_is_the_tokenizer_s(words, reference, duck):
    texts = random_texts(800) + [r[0] for r in duck.sql("SELECT text FROM documents WHERE text IS NOT NULL LIMIT 60").fetchall()]
    memo = unigram.Memo(words.count, 50)
    paths = piece_codec.Paths(words, 1)
    for text in texts:
        want = reference(text)
        assert sum(memo[u][0] for u in words.units(text)) == len(want)
        assert ids(piece_codec.encode_text(text, paths)[0][1]) == want


def all_paths(words, unit):
    unit = unit.replace(" ", unigram.MARK)
    out = []

    def go(at, starts, score):
        if at == len(unit):
            out.append((-score, starts[::-1], words.ids(unit, list(zip(starts, [*starts[1:], at], strict=True)))))
        single = False
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in words.pieces:
                single |= end == at + 1
                go(end, [*starts, at], score + words.pieces[unit[at:end]][1])
        if at < len(unit) and not single:
            go(at + 1, [*starts, at], score + words.unknown)

    go(0, [], 0.0)
    return sorted(out)


def test_n_best_of_a_unit(words):
    rng = random.Random(4)
    for _ in range(150):
        unit = rng.choice([" ", ""]) + "".join(rng.choices("anthei中", k=rng.randint(1, 8)))
        want = all_paths(words, unit)[:6]
        got = words.n_best(unit, 6)
        assert [i for _, i in got] == [i for _, _, i in want]
        assert [s for s, _ in got] == pytest.approx([-s for s, _, _ in want])


def test_best_two(words):
    rng = random.Random(14)
    for _ in range(200):
        unit = rng.choice([" ", "", "   "]) + "".join(rng.choices("anthei中", k=rng.randint(1, 8)))
        paths = words.n_best(unit, 2)
        score, own, gap = words.best_two(unit)
        assert (score, ids(own)) == paths[0]
        assert gap == (paths[0][0] - paths[1][0] if len(paths) > 1 else float("inf"))


@pytest.mark.parametrize("n", [1, 3, 8])
def test_combined(n):
    rng = random.Random(n)
    paths = [[(-float(c), b"") for c in sorted(rng.choices(range(6), k=rng.randint(1, 4)))] for _ in range(4)]
    ways = sorted((sum(p[0][0] - p[r][0] for p, r in zip(paths, way, strict=True)), way[::-1]) for way in product(*(range(len(p)) for p in paths)))
    assert piece_codec.combined(paths, n) == [(c, w[::-1]) for c, w in ways[:n]]


def test_many_segmentations_are_quick(words):
    """Ten words, eight ways: no list of all combinations."""
    found = piece_codec.encode_text("and the thing in the other hand is then there", piece_codec.Paths(words, 12))
    assert len(found) == 12 and len({i for _, i in found}) == 12 and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_n_best_of_a_text(words):
    memo = piece_codec.Paths(words, 4)
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(rng.choices("anthe.,", k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4)))
        scores = [0.0]
        for unit in words.units(text):
            scores = [a - s for a in scores for s, _, _ in all_paths(words, unit)]
        got = piece_codec.encode_text(text, memo)
        assert [s for s, _ in got] == pytest.approx(sorted(scores, reverse=True)[:4])
        assert len({i for _, i in got}) == len(got)
        assert all(words.decode(ids(i)) == text for _, i in got)


def test_counts_edges(spark, edges, reference):
    got = token_counts.token_counts(edges)
    want = sorted((str(r["doc_id"]), len(reference(r["text"] or ""))) for r in edges.collect() if "▁" not in (r["text"] or ""))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect() if r["doc_id"] != 2**60 + 1) == want
    assert got.filter(f"doc_id = {2**60 + 1}").count() == 1
    assert token_counts.token_counts(edges.limit(0)).count() == 0


def test_codec_edges(spark, edges):
    encoded = piece_codec.encode(edges, n=2)
    back = piece_codec.decode(encoded, ["doc_id", "rank"])
    got = sorted(((str(r["doc_id"]), r["text"]) for r in back.collect() if r["rank"] == 1), key=repr)
    assert got == sorted(((str(r["doc_id"]), r["text"] or "") for r in edges.collect()), key=repr)
    assert piece_codec.encode(edges.limit(0)).count() == 0
    own = {(str(r["doc_id"]), r["rank"], r["n_pieces"], r["ids_crc32"], r["decoded_sha256"]) for r in piece_codec.digests(edges, n=2).collect()}
    text = {str(r["doc_id"]): hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in edges.collect()}
    assert own == {(str(r["doc_id"]), r["rank"], r["n_pieces"], zlib.crc32(r["ids"]), text[str(r["doc_id"])]) for r in encoded.collect()}


def test_memo():
    calls = []
    memo = unigram.Memo(lambda k: calls.append(k) or len(k), 3)
    for k in ["a", "b", "c", "d", "a", "x" * 100, "x" * 100]:
        assert memo[k] == len(k)
    assert calls == ["a", "b", "c", "d", "x" * 100, "x" * 100]


def test_word_ids(duck, monkeypatch):
    from tokenizers import Tokenizer

    path = best_fit.default_tokenizer()
    t, own = Tokenizer.from_file(path), word_tokens.WordIds(path)
    rng = random.Random(6)
    parts = ["a", "Z", "é", "É", "'s", "'LL", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "İ", "Σ", "ς", "́", "<|endoftext|>", "<|", "1", "２", "?!", "中", "\U0001f600", "ß", "ﬁ", "\x00", "Å", "K", "'"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [r[0] for r in duck.sql("SELECT text FROM documents WHERE text IS NOT NULL LIMIT 60").fetchall()]
    for text in texts:
        assert ids(own.of_text(text)) == t.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(word_tokens, "LONG", 1000)
    assert ids(own.of_text(LONG[:5000])) == t.encode(LONG[:5000], add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_supersteps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 2048])
    counts = {n: rng.randint(0, 40) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 60)))}
    runs, rows = best_fit.supersteps(counts, capacity), []
    for n, count in counts.items():
        own = sorted(r[1:] for r in runs if r[0] == n)
        for rank in range(count):
            first, each, sequence, offset = [r for r in own if r[0] <= rank][-1]
            nth, place = divmod(rank - first, each)
            rows.append((sequence + nth, offset + place * n, n))
    assert brute.check_packing(rows, capacity) == brute.best_fit_bins([n for n, c in counts.items() for _ in range(c)], capacity)


def test_packing_edges(spark, edges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(best_fit.default_tokenizer())
    rows = best_fit.best_fit(edges).collect()
    want = sorted((str(r["doc_id"]), *p) for r in edges.collect() for p in brute.pieces(t, r["text"]))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert brute.check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in rows]) == brute.best_fit_bins([w[3] for w in want], 2048)
    assert best_fit.best_fit(edges.limit(0)).count() == 0


def test_best_path_of_the_whole_text(words, reference, duck):
    rng = random.Random(7)
    blanks = ["".join(rng.choice(["a", "the", "x =", "\n", "中", ""]) + " " * rng.choice([1, 2, 3, 4, 7, 16, 17, 40]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = random_texts(800) + blanks + [b + "x" for b in blanks] + ["a   b", "def f():\n    return 1", "x         y", " ", " " * 9]
    texts += [r[0] for r in duck.sql("SELECT text FROM documents WHERE text IS NOT NULL LIMIT 60").fetchall()]
    memo, paths = unigram.Memo(words.count, 50), piece_codec.Paths(words, 1)
    for text in texts:
        want = reference(text)
        assert sum(memo[u][0] for u in words.units(text)) == len(want)
        assert ids(piece_codec.encode_text(text, paths)[0][1]) == want


def test_n_best_over_blanks(words):
    memo = piece_codec.Paths(words, 3)
    for text in ["a   b", "x    y", "   a", "a  ", "  ", "a\n   b", "a  b   c"]:
        want = [-s for s, _, _ in all_paths(words, " " + text)[:3]]
        got = piece_codec.encode_text(text, memo)
        assert [s for s, _ in got] == pytest.approx(want, rel=0, abs=1e-3)
        assert len({i for _, i in got}) == 3 and all(words.decode(ids(i)) == text for _, i in got)


@pytest.mark.parametrize("more", ["a▁b", "\n", "a▁\nb"])
def test_no_piece_crosses_units(words, more):
    own = unigram.Vocabulary.__new__(unigram.Vocabulary)
    own.__dict__ |= {k: v for k, v in words.__dict__.items() if k != "automaton"} | {"pieces": words.pieces | {more: (99, -1.0)}}
    own.cut = own.units_of(own.pieces)
    for text in ["xa b", "x\n\n y", "a \nb  c", "   "]:
        want = all_paths(own, " " + text)[0]
        assert sum(own.count(u)[1] for u in own.units(text)) == pytest.approx(-want[0])
        assert "".join(own.units(text)) == " " + text


@pytest.mark.parametrize("char", ["\U0010fffe", "\U0010ffff", "\ue000", "\ud7ff", "▁", "\x00", "\ufffe"])
def test_rare_code_points(words, reference, char):
    """No code point of a text is taken for another: pieces as the tokenizer's, and the text comes back."""
    for text in (f"a {char} b", char, f"{char}{char} x", f" {char}\n{char}"):
        memo, paths = unigram.Memo(words.count, 50), piece_codec.Paths(words, 2)
        encoded = piece_codec.encode_text(text, paths)
        assert sum(memo[u][0] for u in words.units(text)) == len(ids(encoded[0][1]))
        assert {words.decode(ids(x)) for _, x in encoded} == {text}
        if char != "▁":
            assert ids(encoded[0][1]) == reference(text)
