"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their components.

A set links with another when ``100 * intersection >= percent * union``. The join is size-aware:

1. Sets are 64-bit shingle hashes. Equal sets (told by a 128-bit digest) become one class, a node of the join. All sets
   are read in one order: shingles whose hash is 0 modulo ``LEVELS`` come first, the rarest of them first; then the
   others by hash; last those that very many documents hold, by hash, such as the words of a common passage. Only the first ones
   (a quarter) need counting, over all documents; which ones are common a table of counts by leading bits of the hash tells,
   also over all documents. Any order that is the same for all sets gives the same result.
2. A set of n shares at least ``ceil(percent * n / 100)`` shingles with any it links with. So of its first
   ``n - that + 1`` shingles it shares one, and of one more than those it shares two. Shingles of one class fill the
   first places and drop out. Large sets give each of the rest as an inverted-list entry; small sets give every pair
   of the rest, and single ones too if a large set can be near enough in size. The boundary between small and
   large is where the pairs of a set begin to outnumber its entries times the mean length of the lists that they scan.
3. Each list of one signature is scanned. First every node meets the list's smallest one. A pair is decided by sizes, then
   by bitmaps of the two sets (a bit that only one of them has is a shingle that only it has, which bounds the
   overlap from above), then by the overlap itself. What they link are components already.
4. Where a list still holds nodes of several components, those of different ones meet: as rows where the list is short, in
   blocks of bounded size where it is long. Long lists that share their node of the smallest hash are scanned as one: near
   copies share many lists, each of nearly the same nodes. A block pair counts the overlap of all its pairs exactly and
   returns the components of its true links, as a star around the smallest.
   So every pair with a signature in common is decided or connected already, and copies are not paired with each other.
5. The components of all true links, and of the classes that share a doc_id, are the result.

Defined cases: a null text, or one without words, has the empty set and links with nothing. With fewer words than a
shingle, the whole sequence is the only shingle. Rows with a null doc_id have a null component and link with nothing;
rows that share a doc_id are one node. Repeated rows each come out. An empty table gives an empty result. Other
columns are ignored by ``ngram_join`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstpick.llm.common import WHITE, boxed, discard, let, written
from burstpick.llm.components import components

#: One shingle in so many stands in the first part of the order.
LEVELS = 4
#: Bits a key of the filters that keep out of shuffles what surely has no partner (some passes; a join follows), the same where
#: whole sets pass, and the most bits of one (log 2: 32 MB). Beyond that a filter lets more pass, and the join does the work.
KEY_BITS, SET_BITS, MOST_BITS = 8, 128, 28
#: A list of so many nodes is scanned in blocks; a block's nodes and shingles: about these many.
LONG_LIST, BLOCK_DOCS, BLOCK_SHINGLES = 12, 512, 1 << 18
#: Rows of a table of ids that is broadcast (8 bytes each).
MOST_IDS = 4_000_000
#: A shingle is common from so many times the mean count of a value of its leading bits on, and from so many more; and how many
#: bits those are (256 KB of flags).
HOT, HOT_LEAST, COUNTERS = 2, 8, 18
#: Bytes of a text that are hashed at once (about 40 times as much memory), but for a word that is longer.
CHUNK = 1 << 20

_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _spread(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers without a pattern, odd ones."""
    return _mixed(_mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MIX[0]) + np.uint64(seed))) | np.uint64(1)


_BLANK = re.compile(b"[%s]" % WHITE.encode())
#: A number for each byte, the same for A-Z as for a-z, and 0 for the blanks between words.
_OF_BYTE = _spread(256, _MIX[1])[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_OF_BYTE[np.frombuffer(WHITE.encode(), np.uint8)] = 0
_OF_PLACE = _spread(256, _MIX[2])


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, in order: the sum over its bytes of a number for the byte times one for its place in the word."""
    value = _OF_BYTE[np.frombuffer(data, np.uint8)]
    inside = value != 0
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64)
    value = value[start[0] :]
    size = np.diff(np.append(start, len(data)))
    place = np.arange(len(value)) - np.repeat(start - start[0], size)
    longest = int(size.max())
    value *= (_OF_PLACE if longest <= len(_OF_PLACE) else _spread(longest, _MIX[2]))[place]
    return np.add.reduceat(value, start - start[0])


def _chunks(data: bytes) -> Iterator[bytes]:
    """``data`` cut at blanks."""
    at = 0
    while len(data) - at > CHUNK:
        blank = _BLANK.search(data, at + CHUNK)
        end = blank.start() if blank else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def shingles(text: str | None, k: int) -> np.ndarray:
    """The text's set, sorted."""
    w = np.concatenate([_word_hashes(part) for part in _chunks((text or "").encode())])
    if not len(w):
        return w
    n = min(k, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out * np.uint64(_MIX[0]) + w[j : len(w) - n + 1 + j])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def least_shared(n: np.ndarray | int, percent: int):
    """The fewest shingles that a set of ``n`` shares with another set that it links with."""
    return np.maximum(-(-percent * np.asarray(n, np.int64) // 100), _apart(percent))


def _apart(percent: int) -> int:
    """The same for sets of any size, as different sets differ in one shingle at least."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def boundary(mean_list: float, percent: int, most: int = 256) -> int:
    """The largest size of a small set, by cost."""
    out = 0
    for n in range(1, most):
        p = n - int(least_shared(n, percent)) + 1
        if p >= 1 and (p + 1) * p / 2 <= p * (1 + mean_list):
            out = n
    return out


def leading(h: np.ndarray, percent: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Of a set's shingles, those that its first ``n - least + 2`` are among, and how many of them are of the first part. ``hot``
    marks the shingles that come last."""
    n = len(h)
    need = n - int(least_shared(n, percent)) + 2
    if need < 2:
        return h[:0], 0
    level = h % np.uint64(LEVELS)
    if hot is not None and hot.any():
        level = np.where(hot, np.uint64(LEVELS), level)
    first = h[level == 0]
    if len(first) < need:
        rest, level = h[level != 0], level[level != 0]
        order = np.lexsort((rest, level))
        return np.concatenate([first, rest[order[: need - len(first)]]]), len(first)
    return first, len(first)


def _hot(docs: DataFrame, k: int) -> tuple[Broadcast[np.ndarray], int]:
    """A flag for each value of the leading bits of a shingle's hash, and their number: whether its shingles stand in more than
    HOT times as many documents as those of a value do on average. The counts are over all documents; a task sums its own before
    the shuffle, so their number grows with the tasks. The larger the input, the more a shingle must stand out; what does not is
    left to the lists."""
    bits = COUNTERS

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                sets = [shingles(x, k) for x in batch["text"].slice(at, 1024).to_pylist()]
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        held = np.flatnonzero(counts)
        for at in range(0, len(held), 1 << 16):
            own = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], names=["value", "n"])

    sums = docs.select("text").mapInArrow(of_partition, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    sums = written(sums, "counts")
    total = sums.agg(F.sum("n")).first()[0] or 0
    found = np.zeros(1 << bits, bool)
    for row in sums.filter(F.col("n") > HOT * total / (1 << bits) + HOT_LEAST).select("value").toLocalIterator():
        found[row["value"]] = True  # fewer than 1 in HOT of 2 ** COUNTERS values
    discard(sums)
    return docs.sparkSession.sparkContext.broadcast(found), bits


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit for each shingle, by its lowest bits, in 64-bit words: a power of two of them, two to four bits a shingle."""
    bits = max(64, min(1 << 16, 1 << int(2 * len(h) - 1).bit_length())) if len(h) else 64
    flags = np.zeros(bits, np.uint8)
    flags[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view("<i8")


def _survey(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``doc_id, n, digest, lead, n_first, bits`` of each document: its set's size and digest, ``leading``, ``bitmap``."""
    hot, bits = _hot(docs, k)
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("lead", longs), ("n_first", pa.int64()), ("bits", longs)])

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, k) for x in batch["text"].to_pylist()]
            lead = [leading(x, percent, hot.value[(x >> np.uint64(64 - bits)).astype(np.int64)]) for x in sets]
            digest = [digest_of(s) if len(s) else None for s in sets]
            columns = [
                batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                lists([x.view(np.int64) for x, _ in lead]), pa.array([n for _, n in lead], pa.int64()), lists(list(map(bitmap, sets))),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(of_partition, "doc_id long, n long, digest binary, lead array<long>, n_first long, bits array<long>")


def digest_of(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _prefix(shared: Column, n: Column, n_first: Column, percent: int) -> Column:
    """Of a set's leading shingles that other documents hold too (``shared``: structs ``rest, df, shingle``), those among its
    first ``n - least + 2``: the first part's rarest, as far as its shingles that no other holds leave places, and all
    of the rest."""
    need = n - F.greatest(F.ceil(n * percent / 100), F.lit(_apart(percent))) + 2
    of_sorted = lambda s: let(
        F.size(F.filter(s, lambda x: x["rest"] == 0)),
        lambda held: F.concat(
            F.slice(s, F.lit(1), F.greatest(F.lit(0), F.least(need, n_first) - (n_first - held)).cast("int")),
            F.filter(s, lambda x: x["rest"] == 1),
        ),
    )
    return F.transform(let(F.sort_array(shared), of_sorted), lambda x: x["shingle"])


def _signatures(prefix: Column, n: Column, percent: int, small: int) -> Column:
    """Singles of large sets and of those near their size, pairs of small ones."""
    singles = F.transform(prefix, lambda x: F.xxhash64(x))
    pairs = F.flatten(F.transform(F.sort_array(prefix), lambda x, i: F.transform(F.slice(F.sort_array(prefix), i + 2, F.size(prefix)), lambda y: F.xxhash64(x, y))))
    none = F.filter(singles, lambda x: F.lit(False))
    return F.concat(F.when(100 * n >= percent * small, singles).otherwise(none), F.when(n <= small, pairs).otherwise(none))


def _filter(keys: DataFrame, a_key: int = KEY_BITS) -> tuple[Broadcast[np.ndarray], int]:
    """A bitmap for the 64-bit hashes ``keys (key)``, by their highest bits (``a_key`` for each), and log 2 of its size; built by
    Spark, 4 KB a row."""
    bits = min(MOST_BITS, max(15, (a_key * keys.count()).bit_length()))
    one = F.shiftrightunsigned("key", 64 - bits) + 1  # Spark counts bits from 1 on, 32,768 to a row
    own = keys.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in own.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out), bits  # at most 2 ** MOST_BITS bits


def _passes(bitmap: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    at = key.view(np.uint64) >> np.uint64(64 - bits)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _block_links(block: pa.Table, percent: int) -> pa.Table:
    docs = block["cid"].to_numpy()
    root = _linked([x.values.to_numpy().view(np.uint64) for x in block["shingles"]], docs, percent)
    return pa.table({"a": docs[docs != root], "b": root[docs != root]})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: shingles of few sets pair by pair, those of many by a product of matrices."""
    m = len(sets)
    shingle = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(shingle) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(shingle)])
    total = np.zeros(m * m, np.float64)
    for n in range(2, 17):
        at = start[size == n]
        for i in range(n if len(at) else 0):
            for j in range(i + 1, n):
                total += np.bincount(owner[at + i] * m + owner[at + j], minlength=m * m)
    total = total.reshape(m, m)
    total += total.T
    many = np.flatnonzero(size > 16)
    for c in range(0, len(many), 2048):
        has = np.zeros((m, len(many[c : c + 2048])), np.float32)
        for col, g in enumerate(many[c : c + 2048]):
            has[owner[start[g] : start[g] + size[g]], col] = 1
        total += has @ has.T
    return total


def _linked(sets: list[np.ndarray], docs: np.ndarray, percent: int) -> np.ndarray:
    """Each document's root: the smallest doc_id that true links within the block reach."""
    shared, n = overlaps(sets), np.array([len(s) for s in sets], np.float64)
    link = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    link |= docs[:, None] == docs[None, :]
    root = docs.copy()
    while True:
        new = np.where(link, root[None, :], np.iinfo(np.int64).max).min(1)
        if (new == root).all():
            return root
        root = new


def _enough(shared: Column, percent: int) -> Column:
    """Whether ``shared`` is overlap enough for sets of ``na`` and ``nb``."""
    return 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)


def _near_by_bits(a: Column, b: Column) -> Column:
    """The most shingles that sets of ``na`` and ``nb`` with these bitmaps can share."""
    halved = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseOR(q))).otherwise(x)
    only = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, c: t + c)
    most = lambda v: F.least(F.col("na") - only(v["a"], v["b"]), F.col("nb") - only(v["b"], v["a"]))
    return let(F.struct(halved(a, b).alias("a"), halved(b, a).alias("b")), most)


def _maybe(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the distinct ``pairs (a, na, b, nb)`` those whose bitmaps let them link."""
    bits = classes.select("cid", "bits")
    both = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return both.filter(_enough(_near_by_bits(F.col("bits_a"), F.col("bits_b")), percent)).select("a", "na", "b", "nb")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cid, shingles`` of the ``wanted (cid)`` classes, from the texts of their documents."""
    own = written(classes.join(wanted.distinct(), "cid").select("cid", "digest", F.col("first").alias("doc_id")), "wanted")
    known = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc_id").alias("key")
    maybe, bits = _filter(own.select(key), SET_BITS)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_passes(maybe.value, bits, batch["key"].to_numpy())))
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [shingles(x, words) for x in part["text"].to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(digest_of, sets), pa.binary()), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "digest", "shingles"])

    sets = known.select("doc_id", "text", key).mapInArrow(take, "doc_id long, digest binary, shingles array<long>")
    sets = sets.dropDuplicates(["doc_id", "digest"]).join(own, ["doc_id", "digest"])  # one class each: the sets are shuffled once for both
    sets = written(sets.select("cid", "shingles"), "sets")
    discard(own)
    return sets


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs (a, na, b, nb)`` those that link, as ``a, b``."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return both.filter(_enough(F.size(F.array_intersect("set_a", "set_b")), percent)).select("a", "b")


def _entries(docs: DataFrame, survey: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``cid, n, signature``: a written table."""
    held = survey.filter(_known()).select(F.explode("lead").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    held = written(held.filter(F.col("df") > 1), "held")
    entries, squares = held.agg(F.sum("df"), F.sum(F.col("df") * F.col("df"))).first()
    small = boundary((squares or 0) / (entries or 1), percent)
    maybe, bits = _filter(held.select(F.col("shingle").alias("key")))

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = batch["lead"]
            flat = lead.flatten().to_numpy()
            passes = _passes(maybe.value, bits, flat)
            sizes = lead.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rest = (place >= batch["n_first"].to_numpy()[row]).astype(np.int32)[passes]
            row = pa.array(row[passes])
            columns = [*(batch[c].take(row) for c in ("cid", "n", "n_first")), pa.array(rest), pa.array(flat[passes])]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "n_first", "rest", "shingle"])

    stands = classes.select(F.col("first").alias("doc_id"), "digest", "cid")
    leads = survey.filter(_known()).select("doc_id", "digest", "n", "n_first", "lead").join(stands, ["doc_id", "digest"])
    leads = leads.select("cid", "n", "n_first", "lead").mapInArrow(thin, "cid long, n long, n_first long, rest int, shingle long")
    leads = leads.join(held, "shingle").groupBy("cid", "n", "n_first").agg(F.collect_set(F.struct("rest", "df", "shingle")).alias("shared"))
    signed = leads.select("cid", "n", _prefix(F.col("shared"), F.col("n"), F.col("n_first"), percent).alias("prefix"))
    signed = written(signed.select("cid", "n", F.explode(_signatures(F.col("prefix"), F.col("n"), percent, small)).alias("signature")), "entries")
    discard(held)
    return signed


def _known() -> Column:
    return F.col("digest").isNotNull() & F.col("doc_id").isNotNull()


def _class_links(docs: DataFrame, survey: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: links between classes that leave none of two linked ones in different components."""
    near_in_size = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    entries = _entries(docs, survey, classes, percent)
    node = F.struct("cid", "n")
    lists = entries.groupBy("signature").agg(F.min(node).alias("low"), F.max("cid").alias("high")).filter(F.col("low.cid") < F.col("high"))
    lists = written(lists.select("signature", "low"), "lists")
    stars = entries.join(lists, "signature").select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("low.cid").alias("b"), F.col("low.n").alias("nb"))
    stars = written(_maybe(stars.filter((F.col("a") != F.col("b")) & near_in_size).distinct(), classes, percent), "stars")
    one = stars.groupBy("a", "na").agg(F.min(F.struct("b", "nb")).alias("low")).select("a", "na", "low.*")
    nodes = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("cid"))
    sets = _sets(docs, classes, nodes(stars), words)
    links = written(_links(one, sets, percent), "links")
    met = written(components(links), "met")

    roots = met.select(F.col("node").alias("cid"), "root")
    entries_of = entries.join(lists.select("signature"), "signature").join(roots, "cid", "left").select("cid", "n", "signature", F.coalesce("root", "cid").alias("root"))
    entries_of = written(entries_of, "scanned")
    mark = F.sum(F.xxhash64("cid").cast("decimal(20,0)"))
    hub = F.min(F.struct(F.xxhash64("cid").alias("h"), "cid"))
    many = entries_of.groupBy("signature").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("root").alias("low"), F.max("root").alias("high"), mark.alias("mark"), hub.alias("hub"))
    many = written(many.filter(F.col("low") < F.col("high")).groupBy("size", "total", "mark").agg(F.min("signature").alias("signature"), F.first("hub.cid").alias("hub")), "lists")
    short, long = (many.filter(c).select("signature", "hub") for c in (F.col("size") < LONG_LIST, F.col("size") >= LONG_LIST))
    own = entries_of.join(short.select("signature"), "signature")
    left, right = own.toDF("signature", "a", "na", "ra"), own.toDF("signature", "b", "nb", "rb")
    pairs = left.join(right, "signature").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near_in_size)
    ends = lambda c, r: roots.toDF(c, r)
    rest = stars.join(ends("a", "ra"), "a", "left").join(ends("b", "rb"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    pairs = _maybe(pairs.select("a", "na", "b", "nb").distinct(), classes, percent).unionByName(rest.select("a", "na", "b", "nb"))
    pairs = written(pairs.distinct(), "pairs")
    members = written(entries_of.join(long, "signature").select("cid", "n", F.col("hub").alias("cluster")).distinct(), "members")
    together = members
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    members = members.join(sizes, "cluster").select("cid", "cluster", "size", "total")
    more = _sets(docs, classes, nodes(pairs).unionByName(members.select("cid")), words)
    links = links.unionByName(_links(pairs, more, percent)).unionByName(_long_lists(members, more, percent))
    links = written(links, "links")
    discard(entries, lists, stars, sets, met, entries_of, many, pairs, together, more)
    return links


def _long_lists(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the clusters ``members (cid, cluster, size, total)``: their blocks meet, all pairs of them."""
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("size") / BLOCK_DOCS)).cast("int")
    met = members.select("cid", "cluster", blocks.alias("blocks")).join(sets, "cid")
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "cluster", "shingles", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return met.groupBy("cluster", "low", "high").applyInArrow(lambda t: _block_links(t, percent), "a long, b long")


def ngram_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs (doc_id, text)``."""
    survey = written(_survey(docs, words, percent), "survey")
    own = survey.select("doc_id", "n", "digest")
    classes = survey.filter(_known()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    links = _class_links(docs, survey, classes, words, percent)

    firsts = classes.select("digest", "cid", "first")
    twice = own.filter(_known()).groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter(F.col("low") < F.col("high"))
    twice = own.join(twice.select("doc_id"), "doc_id").join(firsts, "digest").groupBy("doc_id", "cid").agg(F.min("first").alias("first"))
    hub = twice.groupBy("doc_id").agg(F.min("cid").alias("b"))
    same = twice.join(hub, "doc_id").select(F.col("cid").alias("a"), "b").filter(F.col("a") != F.col("b"))
    found = components(links.unionByName(same))
    discard(links)

    roots = found.select(F.col("node").alias("cid"), "root")
    rooted = firsts.join(roots, "cid").select("digest", "root", "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    moved = rooted.join(least, "root").filter(F.col("least") < F.col("first")).select("digest", "least")
    named = written(firsts.join(moved, "digest", "left").select("digest", F.coalesce("least", "first").alias("component_id")), "named")
    discard(found, classes)
    out = own.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows with a null doc_id stay."""
    found = ngram_join(docs, words, percent)
    gone = written(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    if gone.count() <= MOST_IDS:  # else the texts are shuffled
        gone = F.broadcast(gone)
    return docs.select(boxed(docs), "doc_id").join(gone, "doc_id", "left_anti").select("_row.*")
