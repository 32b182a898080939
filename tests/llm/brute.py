"""Plain versions of the operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def base_failed(stats):
    return stats[0] < 20 or 100 * stats[4] > 30 * stats[0]


def line_dedup(docs, min_words=50):
    """{key: new text} for ``docs`` {key: text}; keys in order say what is earlier. By the definition: a line goes if a run of
    at least min_words words around it stands earlier."""
    lines = {k: [(n, x) for n, x in enumerate(t.split("\n")) if WORD.search(x)] for k, t in docs.items()}
    first, out = {}, {}
    for k in sorted(lines):
        own = [x for _, x in lines[k]]
        for p in range(len(own)):
            for e in range(p + 1, len(own) + 1):
                first.setdefault(tuple(own[p:e]), (k, p))
    for k, rows in lines.items():
        own, gone = [x for _, x in rows], set()
        for p in range(len(own)):
            for e in range(p + 1, len(own) + 1):
                if sum(len(WORD.findall(x)) for x in own[p:e]) >= min_words and first[tuple(own[p:e])] < (k, p):
                    gone |= set(range(p, e))
        drop = {rows[i][0] for i in gone}
        out[k] = (len(rows), len(gone), "" if len(gone) == len(rows) and gone else "\n".join(x for n, x in enumerate(docs[k].split("\n")) if n not in drop))
    return out


def shingle_set(text, k):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_groups(docs, k, percent):
    """{doc_id: (set size, smallest doc_id of its component)}."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    lists, parent = defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for g in s:
            lists[g].append(d)
    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in lists[g] if e < d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def pieces(tokenizer, text, capacity=2048):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    cut = [(at, ids[at : at + capacity]) for at in range(0, len(ids), capacity)]
    return [(n, at, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))) for n, (at, x) in enumerate(cut)]


def best_fit_bins(lengths, capacity):
    """How many bins best fit takes, longest first, one by one."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def check_packing(rows, capacity=2048):
    """rows: (sequence_id, offset, length). Gapless from 0, none too long. Returns how many sequences there are."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def grams(text):
    """Hashed 1- to 3-grams, one by one."""
    text, out = text.lower(), []
    for i in range(len(text)):
        h = 0
        for n, c in enumerate(text[i : i + 3], 1):
            h = (h + ord(c)) * (0x9E3779B97F4A7C15 + 2 * n) % 2**64
            out.append(h >> 50)
    return out


def bayes(rows):
    """{language: (how many texts, counts of n-grams)} of rows (text, language)."""
    out = {}
    for text, lang in rows:
        n, counts = out.get(lang, (0, Counter()))
        counts.update(grams(text))
        out[lang] = n + 1, counts
    return out


def language(model, text):
    """The likeliest language, the first of several, and its probability."""
    if not model or text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    logs = {}
    for lang in sorted(model):
        n, counts = model[lang]
        total = counts.total() + 0.5 * 2**14
        logs[lang] = math.log(n + 0.5) + math.fsum(math.log((counts[g] + 0.5) / total) for g in grams(text))
    best = max(logs.values())
    return next(x for x in logs if logs[x] == best), 1 / math.fsum(math.exp(x - best) for x in logs.values())
