"""The queries of this folder by name, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burstpick.llm import (
    best_fit,
    chat_format,
    collocations,
    decontaminate,
    exact_topk,
    language_id,
    license_scan,
    line_dedup,
    ngram_join,
    piece_codec,
    quality_rules,
    resample,
    token_counts,
)
from burstpick.llm.common import read


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    both = turns.unionByName(more)
    return chat_format.chat_digests(chat_format.format_chats(both))


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS opens FROM t
), e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '<', ''), chr(92), '')) AS text_chars,
    length(role) + length(role) - length(replace(replace(role, '<', ''), chr(92), '')) AS role_chars FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN opens THEN 9 + role_chars + 8 + 8 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines) AS k
  FROM f GROUP BY source
), p AS (
  SELECT avg(k / n) AS m, coalesce(var_samp(k / n), 0) AS v FROM h
), q AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1, m * (1 - m) / v - 1) ELSE 1 END AS g FROM p
), verdict AS (
  SELECT source, (k + m * g) / (n + g) <= 0.5 AS host_kept FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(read(spark, sf_dir, "embeddings"), k=5, every=50)


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document; ``decoded_sha256`` is of the text that the ids spell."""
    return piece_codec.digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents WHERE text IS NOT NULL
), li AS (
  SELECT doc_id, i, l[i] AS line, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) AS w, l FROM d, unnest(range(1, len(l) + 1)) AS u(i)
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM li
), win AS (
  SELECT a.doc_id, 0 AS side, a.i AS lo, min(b.i) AS hi, any_value(a.l) AS l FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 50 AND b.s - a.s + a.w >= 50 GROUP BY a.doc_id, a.i
  UNION ALL
  SELECT a.doc_id, 1, max(b.i), a.i, any_value(a.l) FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 50 AND a.i AND a.s - b.s + b.w >= 50 GROUP BY a.doc_id, a.i
), k AS (
  SELECT *, row_number() OVER (PARTITION BY side, array_to_string(l[lo:hi], chr(10)) ORDER BY doc_id, lo) AS n FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM k WHERE n > 1
), g AS (SELECT doc_id, list(i) AS i FROM gone GROUP BY doc_id
), parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS a, l, coalesce(g.i, []) AS gone FROM d LEFT JOIN g USING (doc_id)
), placed AS (
  SELECT *, list_filter(range(1, len(a) + 1), lambda j: regexp_matches(a[j], '[^\x20\x09-\x0D]')) AS p FROM parts
)
SELECT doc_id, len(l)::BIGINT AS n_lines, len(gone)::BIGINT AS n_deleted,
  CASE WHEN len(gone) = 0 THEN text WHEN len(gone) = len(l) THEN ''
    ELSE array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda j: NOT list_contains(list_transform(gone, lambda x: p[x]), j)), lambda j: a[j]), chr(10)) END AS text
FROM placed UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination_digest(decontaminate.find_contamination(docs, items))


#: ``translate`` lower-cases A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), spot AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS u(i)
), hit AS (
  SELECT row, i, spot.n, item_id FROM spot JOIN win USING (g)
), covered AS (
  SELECT row, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS j FROM hit) GROUP BY row
), found AS (
  SELECT row, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN found USING (row)
"""


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text")
    return resample.importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, x)) AS tab
), t AS (
  SELECT row_number() OVER () AS row, doc_id, 's' AS side, {_WORDS} AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, 't', {_WORDS} FROM benchmark
), f AS (
  SELECT row, side, array_to_string(w[i:i + n - 1], ' ') AS g FROM t, range(1, 3) AS m(n), unnest(range(1, len(w) - n + 2)) AS u(i)
), b AS (
  SELECT g, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(tab[xor(c, y) % 256 + 1], c // 256), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)), tab
), c AS (
  SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM f JOIN b USING (g) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c
), docs AS (
  SELECT row, count(*) AS n, sum(gain)::BIGINT AS gain FROM f JOIN b USING (g) JOIN gain USING (b) WHERE side = 's' GROUP BY row
), scored AS (
  SELECT row, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    CASE WHEN n > 0 THEN ((gain - ((gain % n) + n) % n) // n)::BIGINT ELSE 0 END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM t LEFT JOIN docs USING (row) WHERE side = 's'
), r AS (
  SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 25 * r.n // 100 THEN rank END::BIGINT AS rank FROM scored LEFT JOIN r USING (row)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ 	]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?
-]')) AS piece FROM documents)
), f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i:i + m - 1] AS w, count(*) AS f
  FROM p, range(1, 6) AS k(m), unnest(range(1, len(w) - m + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), cut AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM f c, unnest(range(1, c.m)) AS u(k), f l, f r, total
  WHERE c.m > 1 AND l.lang = c.lang AND r.lang = c.lang AND total.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longer
  FROM f, unnest(range(2, m)) AS v(j), unnest(range(1, m - j + 2)) AS u(i) WHERE m > 2 GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_piece_codec": op5_piece_codec,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_best_fit": op8_best_fit,
    "op9_quality_rules": op9_quality_rules,
    "op10_exact_topk": op10_exact_topk,
    "op11_decontaminate": op11_decontaminate,
    "op12_importance_resample": op12_importance_resample,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op2_chat_format": OP2_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_decontaminate": OP11_SQL,
    "op12_importance_resample": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
