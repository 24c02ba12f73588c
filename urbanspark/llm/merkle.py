"""Merkle manifest of a data set: a tree of SHA-256 digests whose parents keep midstates.

Leaf: the digest of a row's fields, each ``-`` when null, else byte count, ``:`` and value.
Per language the leaves ascend by doc_id (nulls first, equal ids by leaf); every ``FAN``
consecutive nodes become their parent until one is left, the subroot; subroots ordered by
language (null first) likewise give the root. Digests are hashed as hex text, so each
child is one block of the hash.

A parent keeps a copy of its hash state from before each child. To fold a changed child it
resumes the state of that slot with the replacement and the right siblings only; nothing
to its left is hashed again.

Trees of any size go up in rounds of runs of ``RUN`` consecutive nodes (``LEVELS`` levels).
A run is sorted by Spark and streamed through a task, which holds one run; its root is a
node of the next round. On the way down each run gets the path from its root to the top,
one record for the run, so the rows of a round are dealt twice and joined with nothing.
Hash states cannot leave a process: a task builds a run's states from its digests, once,
and resumes them for all its rows.

Rows: a null field is a leaf part of its own; repeated rows are leaves of their own, side by
side; a null doc_id comes first; a null or long text needs no care. Languages are told
apart bytewise. An empty table has no rows, no subroots and no root. Columns beyond the
five fields are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions.session import broadcast_if_small, checkpointed
from urbanspark.llm.ranks import ranked

FAN, LEVELS = 8, 3
RUN = FAN**LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Languages up to this many are broadcast; more are joined by shuffle.
BROADCAST_TREES = 50_000


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hex digest of a row."""
    parts = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts)), 256)


def tampered_text() -> Column:
    """The text a tamperer shows: A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(F.col("text").cast("string"), UPPER, LOWER))


class Parent:
    """A run of children, as one byte string, and the hash states from before each."""

    __slots__ = ("joined", "states")

    def __init__(self, joined: bytes):
        self.joined = joined
        self.states = []
        state = hashlib.sha256()
        for at in range(0, len(joined), HEX):
            self.states.append(state.copy())
            state.update(joined[at : at + HEX])
        self.states.append(state)

    def digest(self) -> bytes:
        return self.states[-1].hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.joined[(slot + 1) * HEX :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.joined[: slot * HEX] + self.joined[(slot + 1) * HEX :]


def build(digests: list[bytes], size: int) -> tuple[list[list[Parent]], bytes]:
    """The levels of a run and its root, where ``size`` nodes are in the whole tree's round.

    A run that is a whole tree stops at one node; any other goes up all levels, even alone.
    """
    levels: list[list[Parent]] = []
    while len(digests) > 1 if size <= RUN else len(levels) < LEVELS:
        level = [Parent(b"".join(digests[a : a + FAN])) for a in range(0, len(digests), FAN)]
        levels.append(level)
        digests = [p.digest() for p in level]
    return levels, digests[0]


def pack(path: list[tuple[int, bytes]]) -> bytes:
    """Bytes of a path, lowest level first: slot, number of children, children."""
    return b"".join(bytes((slot, len(joined) // HEX)) + joined for slot, joined in path)


def unpack(data: bytes) -> list[tuple[int, bytes]]:
    path, at = [], 0
    while at < len(data):
        slot, end = data[at], at + 2 + data[at + 1] * HEX
        path.append((slot, data[at + 2 : end]))
        at = end
    return path


def _own_path(levels: list[list[Parent]], place: int) -> list[tuple[int, bytes]]:
    out = []
    for level in levels:
        out.append((place % FAN, level[place // FAN].joined))
        place //= FAN
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Lists of the rows of each (tree, run), which come sorted."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["run"]) != key:
                if held:
                    yield held
                held, key = [], (row["tree"], row["run"])
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 2048) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), schema.types, strict=True)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), schema.types, strict=True)], schema=schema)


_ROOTS = pa.schema([("tree", pa.int64()), ("i", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each():
        for run in _runs(batches):
            size = run[0]["size"]
            _, top = build([r["digest"].hex().encode() for r in run], size)
            yield run[0]["tree"], run[0]["run"], -(-size // RUN), bytes.fromhex(top.decode())

    return _batches(each(), _ROOTS)


_PATHS = pa.schema([("tree", pa.int64()), ("run", pa.int64()), ("subroot", pa.binary()), ("path", pa.binary())])


def _descend(forest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every node of a round; in the forest a node is a subroot and becomes a tree."""

    def each():
        for head, *run in _runs(batches):
            levels, _ = build([r["digest"].hex().encode() for r in run], run[0]["size"])
            for place, row in enumerate(run):
                path = pack(_own_path(levels, place)) + head["path"]
                yield (row["i"], 0, row["digest"], path) if forest else (row["tree"], row["i"], head["subroot"], path)

    return _batches(each(), _PATHS)


_FOLDED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each():
        for head, *run in _runs(batches):
            levels, _ = build([r["digest"].hex().encode() for r in run], run[0]["size"])
            above = [(slot, Parent(joined)) for slot, joined in unpack(head["path"])]
            far = b"".join(p.siblings(slot) for slot, p in above)
            subroot = head["subroot"].hex()
            for place, row in enumerate(run):
                original = row["digest"].hex()
                node = original.encode() if row["shown"] is None else row["shown"].hex().encode()
                proof = hashlib.sha256()
                for level in levels:
                    parent, slot = level[place // FAN], place % FAN
                    proof.update(parent.siblings(slot))
                    node = parent.fold(slot, node)
                    place //= FAN
                proof.update(far)
                for slot, parent in above:
                    node = parent.fold(slot, node)
                yield row["doc_id"], original, subroot, proof.hexdigest(), node.decode()

    return _batches(each(), _FOLDED)


_NODE = ("tree", "i", "size", "digest")
_STREAM = "tree long, run long, i long, size long, digest binary"


def _run_of(i: Column | str) -> Column:
    return F.shiftright(i, 3 * LEVELS)


def _streamed(rows: DataFrame) -> DataFrame:
    """Each run whole in one partition, in order."""
    return rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "i")


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds from ``nodes`` (tree, i, size, digest) up, and what is left: one node a tree."""
    rounds = []
    while nodes.where("size > 1").limit(1).count():
        rounds.append(nodes)
        nodes = checkpointed(_streamed(nodes.select("tree", _run_of("i").alias("run"), "i", "size", "digest")).mapInArrow(_roots, _ddl(_ROOTS)))
    return rounds, nodes


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _with_heads(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of a round, each run led by the record of its path."""
    own = rows.withColumn("run", _run_of("i"))
    return _streamed(own.unionByName(paths.withColumn("i", F.lit(-1).cast("long")), allowMissingColumns=True))


def manifest(docs: DataFrame, shown_text: Column | None = None) -> DataFrame:
    """(tree, lang, i, size, doc_id, digest, shown): the leaves in their places.

    ``shown`` is the leaf with ``shown_text`` in place of the text where that isn't null. The
    table is what a data set would publish beside its root.
    """
    digest = leaf(*(F.col(c) for c in FIELDS))
    shown = F.lit(None).cast("binary")
    if shown_text is not None:
        shown = F.when(shown_text.isNotNull(), F.unhex(leaf(*(F.col(c) for c in FIELDS[:-1]), shown_text)))
    rows = checkpointed(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.unhex(digest).alias("digest"), shown.alias("shown")))
    placed = checkpointed(ranked(rows.withColumn("tie", F.monotonically_increasing_id()), "lang", "doc_id", "digest", "tie").drop("tie"))
    langs = placed.groupBy("lang").agg(F.min("rank").alias("first"), F.count("*").alias("size"))
    trees = ranked(langs, "lang").withColumnsRenamed({"rank": "tree", "lang": "tree_lang"})
    joined = placed.join(broadcast_if_small(trees, BROADCAST_TREES), F.col("lang").eqNullSafe(F.col("tree_lang")))
    return checkpointed(joined.select("tree", "lang", (F.col("rank") - F.col("first")).alias("i"), "size", "doc_id", "digest", "shown"))


def audit(docs: DataFrame, shown_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    folded_root is computed from the row as shown (else as it is) and the original siblings.
    """
    leaves = manifest(docs, shown_text)
    rounds, subroots = _rounds(leaves.select(*_NODE))
    trees = subroots.count()
    tops, root = _rounds(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(trees).cast("long").alias("size"), "digest"))
    found = root.select(F.lower(F.hex("digest")).alias("root")).first()

    paths = root.select("tree", F.lit(0).cast("long").alias("run"), F.lit(None).cast("binary").alias("subroot"), F.lit(b"").alias("path"))
    for nodes in reversed(tops):
        forest = nodes is tops[0]
        paths = checkpointed(_with_heads(nodes, paths).select(*_COLUMNS).mapInArrow(partial(_descend, forest), _ddl(_PATHS)))
    if not tops:  # a single language: its subroot is the root
        paths = subroots.select("tree", F.lit(0).cast("long").alias("run"), F.col("digest").alias("subroot"), F.lit(b"").alias("path"))
    for nodes in reversed(rounds[1:]):
        paths = checkpointed(_with_heads(nodes, paths).select(*_COLUMNS).mapInArrow(partial(_descend, False), _ddl(_PATHS)))
    folded = _with_heads(leaves.drop("lang"), paths).select(*_COLUMNS, "doc_id", "shown").mapInArrow(_audit, _ddl(_FOLDED))
    top = F.lit(None if found is None else found["root"]).cast("string")
    return folded.select("doc_id", "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


_COLUMNS = ("tree", "run", "i", "size", "digest", "subroot", "path")
