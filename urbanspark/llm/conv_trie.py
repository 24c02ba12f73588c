"""Prefix trie of conversations, with subtree totals by time-forward processing.

Every conversation is rebuilt with the first turns of the conversation that opens its
block of 20; each distinct sequence of leading turns is a node. Nodes are numbered so that
a parent comes before its children and neighbours in the trie are mostly neighbours in
number; a shard is a stretch of 2**SHARD_BITS numbers, whatever the shape of the trie.

Totals flow from children to parents in reverse level order. Spark's external sort brings
a shard's nodes in that order; a node takes its children's messages out of a priority
queue, which spills sorted runs to a temporary file, adds them to its own and sends the sum
to its parent. Then the same is done across shards: trees of a shard that hang on the same
outer parent are one node of a smaller tree, whose totals are found in the same way, and
enter the shards as messages in a second pass. Each round divides the number of nodes by
up to 2**SHARD_BITS; shard 0 always shrinks to one node, so the rounds end.

Turns are ordered by (turn, role, text), nulls first; null role or text is empty. A node's
key is a polynomial over turn hashes modulo the prime 2**127 - 1, so that a conversation
may lie across sorted partitions: each starts from the key at the end of the one before.

Edge cases: rows with a null conv_id are one conversation, borrowing nothing; in the digest
of ends its id is an empty text that comes first, and a node's conv_id ignores it unless
it is the only member. Repeated rows are turns of their own. A negative id's block is
c - c % 20 with the sign of c. An empty table has only the root, of no member. Other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions.session import checkpointed
from urbanspark.llm.ranks import ROW_BITS, ordered, ranked

BLOCK, HEADS = 20, 4
SHARD_BITS = 16
#: Messages that a queue keeps in memory before it spills a sorted run.
QUEUE_LIMIT = 1 << 15
#: Ids of one end joined at a time before they are hashed.
PIECE_BITS = 10
#: Turn keys that lead a node's sort key.
LEAD = 4
WORDS = "[^\\x20\\x09-\\x0D]+"

PRIME, BASE = (1 << 127) - 1, 0x2D358DCCAA6C78A58BB84B93962EACC9
ROOT = bytes(16)


def heads(conv_id: Column) -> Column:
    """How many turns a conversation borrows: CRC-32 of its decimal id, modulo 4; null: none."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % HEADS, F.lit(0))


# Keys along sorted conversations


def _element(h1: int, h2: int) -> int:
    return (((h1 & 0xFFFFFFFFFFFFFFFF) << 63) ^ (h2 & 0xFFFFFFFFFFFFFFFF)) % PRIME + 1


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _lead(keys: list[int]) -> list[int]:
    return [(k & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for k in keys]


_SUMMARY = "part long, first long, first_n long, first_key binary, first_lead array<binary>, last long, last_n long, last_key binary, last_lead array<binary>, single boolean"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and its last conversation, as if they began here."""
    part, runs, conv = None, [], None
    for r, c, h1, h2 in _rows(batches, "r", "conv_id", "h1", "h2"):
        if part is None or c != conv:
            runs = [*runs[:1], [c, 0, 0, []]]
            part, conv = r >> ROW_BITS, c
        run = runs[-1]
        run[1] += 1
        run[2] = (run[2] * BASE + _element(h1, h2)) % PRIME
        if run[1] <= LEAD:
            run[3].append(run[2])
    if part is not None:
        first, last = runs[0], runs[-1]
        flat = lambda run: (run[0], run[1], run[2].to_bytes(16), [k.to_bytes(16) for k in run[3]])
        row = (part, *flat(first), *flat(last), len(runs) == 1)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())] + [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.bool_()]
        names = [f.split()[0] for f in _SUMMARY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def _carries(rows: DataFrame) -> dict[int, tuple[int, int, list[int], bool]]:
    """For each partition: turns and key of its first conversation before it, and whether its last goes on after it.

    The driver sees one row a partition.
    """
    found = sorted(rows.select("r", "conv_id", "h1", "h2").mapInArrow(_summary, _SUMMARY).collect(), key=lambda s: s["part"])
    out: dict[int, tuple[int, int, list[int], bool]] = {}
    conv, n, key, lead, before = None, 0, 0, [], None
    for s in found:
        goes_on = before is not None and s["first"] == conv
        if goes_on:
            out[before] = (*out[before][:3], True)
        else:
            n, key, lead = 0, 0, []
        out[s["part"]] = (n, key, lead, False)
        if s["single"]:
            local = [int.from_bytes(k) for k in s["first_lead"]]
            lead = (lead + [(key * pow(BASE, j, PRIME) + k) % PRIME for j, k in enumerate(local, 1)])[:LEAD]
            key = (key * pow(BASE, s["first_n"], PRIME) + int.from_bytes(s["first_key"])) % PRIME
            n += s["first_n"]
        else:
            n, key, lead = s["last_n"], int.from_bytes(s["last_key"]), [int.from_bytes(k) for k in s["last_lead"]]
        conv, before = s["last"], s["part"]
    return out


_CHAINED = "conv_id long, k long, h1 long, h2 long, tokens long, node binary, parent binary, lead array<long>, ends boolean"


def _chain(carries: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place in its conversation and the keys of its node and parent; the last row of a conversation is told."""
    types = [pa.int64()] * 5 + [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
    names = [f.split()[0] for f in _CHAINED.split(", ")]
    block: list[list] = []
    conv, n, key, lead, more = None, 0, 0, [], False
    fresh = True

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for r, c, h1, h2, tokens in _rows(batches, "r", "conv_id", "h1", "h2", "tokens"):
        if fresh:
            n, key, lead, more = carries[r >> ROW_BITS]
            conv, fresh, lead = c, False, list(lead)
        elif c != conv:
            block[-1][-1] = True
            conv, n, key, lead = c, 0, 0, []
        if len(block) >= 4096:  # the last row waits until it is known whether its conversation goes on
            yield batch(block[:-1])
            block = block[-1:]
        above, n = key, n + 1
        key = (key * BASE + _element(h1, h2)) % PRIME
        if n <= LEAD:
            lead = [*lead, key]
        block.append([c, n, h1, h2, tokens, key.to_bytes(16), above.to_bytes(16), _lead(lead), False])
    if block:
        block[-1][-1] = not more
        yield batch(block)


def chained(rows: DataFrame) -> DataFrame:
    """Rows of ``ordered`` (r, conv_id, h1, h2, tokens) with the columns of ``_CHAINED``."""
    return rows.select("r", "conv_id", "h1", "h2", "tokens").mapInArrow(partial(_chain, _carries(rows)), _CHAINED)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations as ``chained``, conversations (conv_id))."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    slim = turns.orderBy("conv_id", "turn", "role", "text").select("conv_id", F.xxhash64(F.lit(1), F.length("role"), "role", "text").alias("h1"), F.xxhash64(F.lit(2), F.length("role"), "role", "text").alias("h2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("tokens"))
    own = checkpointed(chained(checkpointed(slim.withColumn("r", F.monotonically_increasing_id()))).select("conv_id", "k", "h1", "h2", "tokens"))
    convs = own.where("k = 1").select("conv_id")
    c = F.col("conv_id")
    opens = F.coalesce(c % BLOCK == 0, F.lit(True))
    first = own.where((c % BLOCK == 0) & (F.col("k") < HEADS)).withColumnRenamed("conv_id", "donor")
    asking = convs.where(~opens).withColumn("donor", c - c % BLOCK)
    borrowed = asking.join(first, "donor").where(F.col("k") <= heads(c)).select("conv_id", "k", "h1", "h2", "tokens")
    kept = own.where(opens | (F.col("k") > heads(c)))
    rows = ordered(kept.unionByName(borrowed), "conv_id", "k")
    return checkpointed(chained(rows)), convs


# The tree


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(id, node, depth, tokens, n_convs, conv_id): the trie's nodes; id 0 is the root."""
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")]
    each = turns.groupBy("node", "parent", F.col("k").alias("depth"), "tokens", "lead").agg(*members)
    root = convs.agg(*members).select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("tokens"), F.array().cast("array<long>").alias("lead"), *("n_convs", "conv_id"))
    return checkpointed(ranked(root.unionByName(each), "lead", F.col("conv_id").asc_nulls_last(), "depth").drop("lead").withColumnRenamed("rank", "id"))


class SpillingQueue:
    """Least-first queue of (time, target, leaves, saved) in bounded memory.

    Beyond ``limit`` messages the heap is written as a sorted run to a temporary file, which
    goes away with the task; runs are read back block by block.
    """

    BLOCK = 4096

    def __init__(self, limit: int = QUEUE_LIMIT):
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        np.array(sorted(self.heap), np.int64).tofile(file)
        self.heap, self.spilled = [], self.spilled + 1
        file.seek(0)
        self._advance(self._read(file), len(self.runs))

    def _read(self, file) -> Iterator[tuple[int, int, int, int]]:
        with file:
            while len(block := np.fromfile(file, np.int64, 4 * self.BLOCK)):
                yield from map(tuple, block.reshape(-1, 4).tolist())

    def _advance(self, run: Iterator, number: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, self.spilled, number, run))

    def pop_to(self, time: int, target: int) -> tuple[int, int]:
        """Sum of all messages to the target."""
        leaves = saved = 0
        key = (time, target)
        while self.heap and self.heap[0][:2] == key:
            _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][:2] == key:
            head, born, number, run = heapq.heappop(self.runs)
            leaves, saved = leaves + head[2], saved + head[3]
            following = next(run, None)
            if following is not None:
                heapq.heappush(self.runs, (following, born, number, run))
        return leaves, saved


MESSAGE, NODE, REQUEST = 0, 1, 2
_IN = ("shard", "kind", "depth", "id", "parent", "up", "leaves", "saved")
_OUT = "kind int, id long, leaves long, saved long"


def _pass(bits: int, limit: int, contract: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Time-forward pass over shards that come whole and in order.

    A shard is: messages from other shards; its nodes in reverse level order; requests for
    the group that a node's tree belongs to. With ``contract`` the output has each group's
    totals (kind NODE) and the answers (kind REQUEST: id of who asks, group, its depth); else every
    node's totals.
    """
    out: list[tuple] = []

    def flush():
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["kind", "id", "leaves", "saved"])

    def close():
        out.extend((NODE, first, *groups[outer][2:4]) for outer, (first, *_) in groups.items())

    shard, queue, groups, parents, labels = None, None, {}, None, None
    for s, kind, depth, i, parent, up, leaves, saved in _rows(batches, *_IN):
        if s != shard:
            if contract and shard is not None:
                close()
            shard, queue, groups = s, SpillingQueue(limit), {}
            parents, labels = array("q", bytes(8 << bits)) if contract else None, None
        base = s << bits
        if kind == MESSAGE:
            queue.push((-depth, -i, leaves, saved))
        elif kind == NODE:
            more = queue.pop_to(-depth, -i)
            leaves, saved = leaves + more[0], saved + more[1]
            inner = parent is not None and parent >> bits == s
            if inner:
                queue.push((-up, -parent, leaves, saved))
            if not contract:
                out.append((NODE, i, leaves, saved))
            else:
                parents[i - base] = parent if inner else -1 if parent is None else -2 - parent
                if not inner:
                    first, level, a, b = groups.get(parent, (i, depth, 0, 0))
                    groups[parent] = (min(first, i), min(level, depth), a + leaves, b + saved)
        else:
            if labels is None:
                labels = array("q", bytes(8 << bits))
                for at, p in enumerate(parents):
                    labels[at] = labels[p - base] if p >= base and p >> bits == s else p
            own = labels[i - base]
            first, level, *_ = groups[None if own == -1 else -2 - own]
            out.append((REQUEST, parent, first, level))
        if len(out) >= 4096:
            yield flush()
    if contract and shard is not None:
        close()
    if out:
        yield flush()


def _through(stream: DataFrame, bits: int, limit: int, contract: bool) -> DataFrame:
    """A pass over the shards: Spark's external sort brings each in reverse level order."""
    dealt = stream.select(*_IN).repartition("shard").sortWithinPartitions("shard", "kind", F.desc("depth"), F.desc("id"))
    return dealt.mapInArrow(partial(_pass, bits, limit, contract), _OUT)


def totals(tree: DataFrame, bits: int = SHARD_BITS, limit: int = QUEUE_LIMIT) -> DataFrame:
    """(id, leaves, saved): subtree sums of a tree (id, parent, depth, up, leaves, saved).

    ids are dense from 0 and a parent's is less than its children's; up is its depth.
    """
    shard = lambda c: F.shiftright(c, bits)
    own = tree.withColumn("shard", shard("id")).withColumn("kind", F.lit(NODE))
    if tree.where(F.col("id") >= 1 << bits).limit(1).count():
        hung = own.where(F.col("parent").isNull() | (shard("parent") != F.col("shard")))
        groups = checkpointed(hung.groupBy("shard", "parent").agg(F.min("id").alias("id"), F.min("depth").alias("depth"), F.min("up").alias("up")))
        asks = groups.where("parent IS NOT NULL").select(shard("parent").alias("shard"), F.lit(REQUEST).alias("kind"), "depth", F.col("parent").alias("id"), F.col("id").alias("parent"), "up", *(F.lit(0).cast("long").alias(c) for c in ("leaves", "saved")))
        found = checkpointed(_through(own.select(*_IN).unionByName(asks.select(*_IN)), bits, limit, True))
        answers = found.where(F.col("kind") == REQUEST).select("id", F.col("leaves").alias("outer"), F.col("saved").alias("up"))
        small = ranked(groups.select("id", "depth").join(found.where(F.col("kind") == NODE).select("id", "leaves", "saved"), "id").join(answers, "id", "left"), "id")
        small = checkpointed(small)
        numbers = small.select(F.col("id").alias("outer"), F.col("rank").alias("parent"))
        sums = totals(small.join(numbers, "outer", "left").select(F.col("rank").alias("id"), "parent", "depth", "up", "leaves", "saved"), bits, limit)
        back = groups.where("parent IS NOT NULL").select("id", "parent", "up").join(small.select("id", "rank"), "id").join(sums.withColumnRenamed("id", "rank"), "rank")
        sent = back.select(shard("parent").alias("shard"), F.lit(MESSAGE).alias("kind"), F.col("up").alias("depth"), F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("up"), "leaves", "saved")
        own = own.select(*_IN).unionByName(sent.select(*_IN))
    return checkpointed(_through(own, bits, limit, False).select("id", "leaves", "saved"))


# Ends


_ENDS = "node binary, ends_sha256 string"


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    out: list[tuple] = []
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], names=["node", "ends_sha256"])
    for key, piece in _rows(batches, "node", "piece"):
        if key != node:
            if node is not None:
                out.append((node, state.hexdigest()))
            node, state = key, hashlib.sha256()
        else:
            state.update(b",")
        state.update(piece.encode())
        if len(out) >= 4096:
            yield flush(out)
            out = []
    if node is not None:
        yield flush([*out, (node, state.hexdigest())])


def ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    Ids are sorted over all partitions and joined to pieces first; one task then hashes the
    pieces of a node as they come, which holds none of them.
    """
    last = turns.where("ends").select("conv_id", "node")
    turnless = convs.join(last.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").select("conv_id", F.lit(ROOT).alias("node"))
    rows = ordered(last.union(turnless), "node", "conv_id")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("conv_id"))), lambda s: F.coalesce(s["conv_id"].cast("string"), F.lit("")))
    pieces = rows.groupBy("node", F.shiftright("r", PIECE_BITS).alias("at")).agg(F.array_join(texts, ",").alias("piece"))
    return pieces.repartition("node").sortWithinPartitions("node", "at").select("node", "piece").mapInArrow(_hash_ends, _ENDS)


def trie(conversations: DataFrame, bits: int = SHARD_BITS, limit: int = QUEUE_LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    turns, convs = rebuilt(conversations)
    each = nodes(turns, convs)
    above = each.select(F.col("node").alias("above"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    root = above.where("parent_id = 0").select("parent_id", "parent_conv_id")
    top = each.where("depth = 1").crossJoin(F.broadcast(root))  # the root has the most children: no join on its key
    deeper = each.where("depth > 1").join(above, F.col("parent") == F.col("above")).drop("above")
    linked = checkpointed(top.unionByName(deeper).unionByName(each.where("depth = 0").withColumns({"parent_id": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})))
    children = linked.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    full = checkpointed(linked.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = full.select("id", F.col("parent_id").alias("parent"), "depth", (F.col("depth") - 1).alias("up"), (F.col("n_children") == 0).cast("long").alias("leaves"), (F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("tokens")).alias("saved"))
    sums = totals(own, bits, limit)
    out = full.join(sums, "id").join(ends(turns, convs), "node", "left")
    none = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
