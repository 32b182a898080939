"""The hash split as a chain of anchors, for clusters of any size.

A cluster's first photo is the first anchor; the next one is the first later photo whose hash is more than ``threshold`` bits
away, and so on. So each photo has a successor, and the groups are the chain from the first photo. Clusters are range-sorted, and
most of them lie within one partition, which walks their chain. A cluster that goes on over partitions is done in parts:

1. In every partition that such a cluster enters, each photo gets its successor within the partition, and by pointer doubling the
   last anchor of the chain from it, with the number of steps: what leaves the partition if the chain comes in there.
2. Only the hashes that can leave a partition are nodes of the chain between partitions. A node's successor is found through an
   index: for runs of 1, 2, 4, ... partitions the distinct hashes, each with the first place where it stands. One lookup compares a
   node with all hashes of such a run, and tells the first far photo in it or that there is none, whatever the photos' number;
   a node that finds none goes on to the run behind, and to longer ones as it goes.
3. The chain from the cluster's first photo is told by pointer doubling over the nodes: in round k the nodes reached so far are
   joined with pointers of 2^k steps, then these with themselves. Rounds are as many as the logarithm of the partitions.
4. What the chain brings into each partition is one row; with it the partitions walk their rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstpick.scan import changed, sort_into_parts
from burstpick.tables import discard, written

#: Photos to look ahead one by one before a hash is compared with a whole partition; comparisons at once.
NEAR, AT_ONCE = 32, 1 << 22


def walk(bits: np.ndarray, known: np.ndarray, threshold: int, anchor: np.uint64 | None, group: int) -> tuple[np.ndarray, np.uint64 | None, int]:
    """Group of each photo, when ``anchor`` and ``group`` come in; and what goes out. It jumps from anchor to anchor."""
    out, at = np.zeros(len(bits), np.int64), 0
    while at < len(bits):
        end, size = len(bits), 64
        while anchor is not None and at + size // 2 < len(bits) + 32:  # ever longer looks ahead
            ahead = slice(at if size == 64 else at + size // 2, at + size)
            far = np.flatnonzero(known[ahead] & (np.bitwise_count(bits[ahead] ^ anchor) > threshold))
            if len(far):
                end = ahead.start + int(far[0])
                break
            size *= 2
        out[at:end] = group
        if end < len(bits):
            anchor, group = bits[end], group + 1
        at = end
    return out, anchor, group


def successors(bits: np.ndarray, known: np.ndarray, threshold: int) -> np.ndarray:
    """For each photo the first later one that is known and far from it, or -1; -1 for those without a hash."""
    n = len(bits)
    out, left = np.full(n, -1, np.int64), np.flatnonzero(known)
    for k in range(1, NEAR + 1):
        left = left[left + k < n]
        found = known[left + k] & (np.bitwise_count(bits[left] ^ bits[left + k]) > threshold)
        out[left[found]] = left[found] + k
        left = left[~found]
    if len(left):
        values, which = np.unique(bits[left], return_inverse=True)
        for v, of in zip(values, np.split(left[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which))[:-1]), strict=True):
            far = np.flatnonzero(known & (np.bitwise_count(bits ^ v) > threshold))
            at = np.searchsorted(far, of, side="right")
            out[of] = np.where(at < len(far), far[np.minimum(at, len(far) - 1)], -1) if len(far) else -1
    return out


def leaving(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of the chain of successors from each photo, and its steps, by pointer doubling."""
    n = len(after)
    to, steps = np.where(after < 0, np.arange(n), after), (after >= 0).astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            return to, steps
        steps += steps[to]
        to = further


def _own_parts(keys: list[str], threshold: int, schema: T.StructType):
    """Groups of one partition as if its first cluster began there, and for that cluster's photos what leaves when the chain
    comes in at them."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, rows, opened, head = TaskContext.get().partitionId(), None, 0, 0, []
        anchor, group = None, 0

        def out(batch: pa.RecordBatch, opens: bool, groups: np.ndarray, anchors: list, exits: pa.Array, steps: np.ndarray) -> pa.RecordBatch:
            nonlocal rows
            n = batch.num_rows
            more = [np.full(n, part, np.int32), np.arange(rows, rows + n), np.full(n, opens), groups]
            rows += n
            return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more), anchors, exits, pa.array(steps)], names=schema.names)

        def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            """The first cluster, all at once: ids, times and hashes of one partition."""
            table = pa.Table.from_batches(parts).combine_chunks()
            batch = table.to_batches()[0]
            bits, known = hashes(batch)
            groups, last = grouped(bits, known, True)
            to, steps = leaving(successors(bits, known, threshold))
            exits = pa.array(bits.view(np.int64)[to], mask=~known)
            return out(batch, True, groups, last, exits, steps)

        def hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            return batch["phash"].fill_null(0).to_numpy().view(np.uint64), batch["phash"].is_valid().to_numpy(zero_copy_only=False)

        def grouped(bits: np.ndarray, known: np.ndarray, new: bool) -> tuple[np.ndarray, pa.Array]:
            """Groups, and at the last row the anchor that goes out (elsewhere null)."""
            nonlocal anchor, group
            if new:
                anchor, group = (bits[0] if known[0] else None), 0
            groups, anchor, group = walk(bits, known, threshold, anchor, group)
            last = np.zeros(len(bits), np.int64)
            last[-1] = np.uint64(anchor or 0).view(np.int64)
            mask = np.ones(len(bits), bool)
            mask[-1] = anchor is None
            return groups, pa.array(last, mask=mask)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = changed(batch, before, keys)
            before = batch.slice(batch.num_rows - 1)
            starts = [0, *(i for i in np.flatnonzero(new) if i), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                opened += bool(new[a])
                piece = batch.slice(a, b - a)
                if opened == 1:
                    head.append(piece)
                    continue
                if head:
                    yield whole(head)
                    head = []
                groups, last = grouped(*hashes(piece), bool(new[a]))
                yield out(piece, False, groups, last, pa.nulls(b - a, pa.int64()), np.zeros(b - a, np.int64))
        if head:
            yield whole(head)

    return of_partition


def _first_far(threshold: int):
    """Of one run of partitions: the nodes that look into it, and the distinct hashes in it. For each node the first far photo."""

    def of_group(nodes: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        seen = seen.sort_values(["first_part", "first_row"])
        bits, step = seen["hash"].to_numpy().view(np.uint64), max(1, AT_ONCE // max(1, len(nodes)))
        own = nodes["node"].to_numpy().view(np.uint64)
        found = np.full(len(nodes), -1, np.int64)
        for at in range(0, len(bits), step):  # in order, so the first far hash of all is the first far photo
            left = np.flatnonzero(found < 0)
            if not len(left):
                break
            far = np.bitwise_count(own[left, None] ^ bits[None, at : at + step]) > threshold
            hit = far.any(axis=1)
            found[left[hit]] = at + far[hit].argmax(axis=1)
        out = nodes[["chain", "part", "node", "at", "level"]].copy()
        ok = found >= 0
        for name, column in (("to_part", "first_part"), ("to_node", "exit"), ("steps", "steps")):
            values = seen[column].to_numpy()
            out[name] = pd.array(np.where(ok, values[np.maximum(found, 0)] if len(values) else 0, 0), "Int64")
            out.loc[~ok, name] = pd.NA
        out["steps"] += 1
        return out

    return of_group


NODES = "chain long, part long, node long"
LOOK = f"{NODES}, at long, level long, to_part long, to_node long, steps long"


def _links(nodes: DataFrame, firsts: DataFrame, ends: DataFrame, levels: int, threshold: int) -> DataFrame:
    """``chain, part, node, to_part, to_node, steps`` of the nodes that have a successor; ``ends`` (chain, end) says how far each
    cluster goes."""
    place = F.struct("first_part", "first_row", "exit", "steps")
    index = firsts.withColumn("level", F.lit(0).cast("long")).withColumn("at", F.col("first_part"))
    index = written(index, "index")
    tables = [index]
    for level in range(1, levels + 1):
        up = tables[-1].groupBy("chain", "hash", F.floor(F.col("at") / 2).cast("long").alias("at")).agg(F.min(place).alias("m"))
        tables.append(written(up.select("chain", "hash", "at", "m.*", F.lit(level).cast("long").alias("level")).select(*index.columns), "index"))
    looking = nodes.withColumn("at", F.col("part") + 1).withColumn("level", F.lit(0).cast("long"))
    looking = looking.join(F.broadcast(ends), "chain").filter(F.col("at") <= F.col("end")).drop("end")
    found = []
    while True:
        all_levels = tables[0]
        for t in tables[1:]:
            all_levels = all_levels.unionByName(t)
        looked = looking.groupBy("chain", "level", "at").cogroup(all_levels.groupBy("chain", "level", "at"))
        looked = written(looked.applyInPandas(_first_far(threshold), LOOK), "looked")
        found.append(looked)
        # the run behind; a run of twice the size where it begins one
        end = F.expr("shiftleft(at + 1, CAST(level AS INT))")
        on = looked.filter(F.col("to_part").isNull()).join(F.broadcast(ends), "chain").filter(end <= F.col("end"))
        wider = (F.col("level") < levels) & ((F.col("at") + 1) % 2 == 0)
        looking = on.select(
            "chain", "part", "node", F.when(wider, ((F.col("at") + 1) / 2).cast("long")).otherwise(F.col("at") + 1).alias("at"),
            (F.col("level") + F.when(wider, 1).otherwise(0)).cast("long").alias("level"),
        )
        if not looking.limit(1).count():
            break
    out = found[0]
    for t in found[1:]:
        out = out.unionByName(t)
    out = written(out.filter(F.col("to_part").isNotNull()).select("chain", "part", "node", "to_part", "to_node", "steps"), "links")
    discard(*tables, *found)
    return out


def _reached(starts: DataFrame, links: DataFrame) -> DataFrame:
    """``chain, part, node, group``: the nodes on the chains from ``starts`` (the same columns), by pointer doubling."""
    reached, jumps = written(starts, "reached"), links
    while jumps.limit(1).count():
        here = jumps.withColumnsRenamed({"part": "from_part", "node": "from_node", "steps": "more"})
        same = (F.col("r.chain") == F.col("j.chain")) & (F.col("r.part") == F.col("j.from_part")) & (F.col("r.node") == F.col("j.from_node"))
        new = reached.alias("r").join(here.alias("j"), same).select("r.chain", F.col("to_part").alias("part"), F.col("to_node").alias("node"), (F.col("group") + F.col("more")).alias("group"))
        more = written(reached.unionByName(new).distinct(), "reached")
        second = jumps.select("chain", F.col("part").alias("to_part"), F.col("node").alias("to_node"), F.col("to_part").alias("then_part"), F.col("to_node").alias("then_node"), F.col("steps").alias("then"))
        twice = jumps.join(second, ["chain", "to_part", "to_node"]).select("chain", "part", "node", F.col("then_part").alias("to_part"), F.col("then_node").alias("to_node"), (F.col("steps") + F.col("then")).alias("steps"))
        twice = written(twice, "jumps")
        discard(reached, jumps)
        reached, jumps = more, twice
    discard(jumps)
    return reached


def _walk_on(carried: dict[int, tuple[int | None, int]], threshold: int, names: list[str]):
    """Rows sorted by partition and place, with what comes into each partition."""

    def of_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, anchor, group = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changed(batch, before, ["_part"])
            before = batch.slice(batch.num_rows - 1)
            parts = batch["_part"].to_numpy()
            bits, known = batch["phash"].fill_null(0).to_numpy().view(np.uint64), batch["phash"].is_valid().to_numpy(zero_copy_only=False)
            groups = np.zeros(batch.num_rows, np.int64)
            starts = [0, *(i for i in np.flatnonzero(new) if i), batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                if new[a]:
                    came, group = carried[int(parts[a])]
                    anchor = None if came is None else np.int64(came).view(np.uint64)
                groups[a:b], anchor, group = walk(bits[a:b], known[a:b], threshold, anchor, group)
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(groups)], names=[*names, "subgroup"])

    return of_partition


def anchor_groups(rows: DataFrame, keys: list[str], order: list[str], threshold: int) -> DataFrame:
    """``rows`` (``keys``, ``order`` and ``phash``) with ``subgroup``, and without the hash."""
    spark, names = rows.sparkSession, [*keys, *order]
    own = [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_open", T.BooleanType())]
    own += [T.StructField(c, T.LongType()) for c in ("subgroup", "_anchor", "_exit", "_steps")]
    rows = rows.select(*names, "phash")
    schema = T.StructType([*rows.schema.fields, *own])
    table = written(sort_into_parts(rows, *names).mapInArrow(_own_parts(keys, threshold, schema), schema), "anchors")

    told = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)], "_open", F.col("subgroup").alias("group"), F.col("_anchor").alias("anchor"))
    ends = table.groupBy("_part").agg(F.min_by(told, "_row").alias("first"), F.max_by(told, "_row").alias("last")).collect()  # one row a partition
    parts, last, chain = sorted(ends, key=lambda e: e["_part"]), None, None
    chains, starts, carried = [], [], {}  # of clusters that go on: (chain, its last partition), what leaves the first one, its partitions
    for e in parts:
        if last is not None and all(e["first"][i] == last["last"][i] for i in range(len(keys))):
            if chain is None:
                chain = len(chains)
                chains.append([chain, 0])
                starts.append((chain, last["_part"], last["last"]["anchor"], last["last"]["group"]))
            chains[chain][1] = e["_part"]
            carried[e["_part"]] = chain
            if not e["last"]["_open"]:
                chain = None
        else:
            chain = None
        last = e
    done = table.select(*names, "subgroup", "_part", "_open")
    if not carried:
        return done.drop("_part", "_open")

    of_part = spark.createDataFrame(list(carried.items()), "_part int, chain long")
    entered = table.filter("_open").join(F.broadcast(of_part), "_part")
    place = F.min(F.struct(F.col("_part").cast("long").alias("first_part"), F.col("_row").alias("first_row"), F.col("_exit").alias("exit"), F.col("_steps").alias("steps")))
    firsts = entered.filter(F.col("phash").isNotNull()).groupBy("chain", "_part", F.col("phash").alias("hash")).agg(place.alias("m"))
    firsts = written(firsts.select("chain", "hash", "m.*"), "firsts")
    begins = spark.createDataFrame([s for s in starts if s[2] is not None], "chain long, part long, node long, group long")
    nodes = firsts.select("chain", F.col("first_part").alias("part"), F.col("exit").alias("node")).unionByName(begins.drop("group")).distinct()
    links = _links(nodes, firsts, spark.createDataFrame(chains, "chain long, end long"), len(parts).bit_length(), threshold)
    reached = _reached(begins, links)
    visited: dict[int, list[tuple]] = {}
    for r in reached.collect():  # as many as partitions, and one more a cluster
        visited.setdefault(r["chain"], []).append((r["part"], r["node"], r["group"]))
    for c, _, _, group in (s for s in starts if s[2] is None):
        visited[c] = [(-1, None, group)]
    brought = {}
    for part, c in carried.items():
        _, anchor, group = max((v for v in visited[c] if v[0] < part), key=lambda v: v[0])
        brought[part] = anchor, group
    going = table.filter("_open").join(F.broadcast(of_part), "_part").select(*names, "phash", "_part", "_row")
    going = going.repartition("_part").sortWithinPartitions("_part", "_row")
    kept = T.StructType([*rows.drop("phash").schema.fields, T.StructField("subgroup", T.LongType())])
    walked = going.mapInArrow(_walk_on(brought, threshold, names), kept)
    rest = done.join(F.broadcast(of_part.select("_part", F.lit(True).alias("_entered"))), "_part", "left").filter(~(F.col("_open") & F.col("_entered").isNotNull()))
    discard(firsts, reached)
    return rest.select(*names, "subgroup").unionByName(walked)
