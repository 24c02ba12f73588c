r"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share tree nodes: a node is a sequence of turns
from the start, its key the chained digest of those turns, so the tree is built by
aggregation over keys and never gathered. Each node's segment is emitted once, in
depth-first order of its tree, with

* ``start``: where the segment begins in the tree's packed stream of code points,
* ``position``: the position id of its first code point, counted along its own path,
* ``attend``: the intervals [start, end) of its ancestors, which it may attend to.

A leaf row maps each conversation to the node of its last turn. Offsets are prefix sums
over range-sorted partitions, so that no task holds all the conversations that share a
first turn, and a long conversation costs no more jobs than a short one.

Template: ``<|im_start|>role\ntext<|im_end|>\n``. A control string inside a role or a text
gets a backslash after its first character, one more if it has some already, so each is
read back exactly. Inside a role a line end is written ``\n`` and a backslash ``\s``.

Rows: turns are ordered by (turn, role, text), nulls first; a null role or text is empty;
rows with a null conv_id form one conversation. Repeated rows are turns of their own. An
empty table has no conversations. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions.session import checkpointed

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings of this and other common templates that a text must not smuggle in: fixed values.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPED = r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Each backslash is followed by s or n here, so neither replacement makes what the other looks for.
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"), escape(text), F.lit(f"{CLOSE}\n"))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, k, role, text, node, parent): each turn and the tree node it is, k from 1."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    digest = lambda above, t: F.sha2(F.concat(above, F.length(t["role"]).cast("string"), F.lit("\x00"), t["role"], t["text"]), 256)
    chain = F.aggregate("ts", F.array(F.lit("")), lambda acc, t: F.concat(acc, F.array(digest(F.element_at(acc, -1), t))))
    chained = gathered.select("conv_id", "ts", chain.alias("chain"))
    each = chained.select("conv_id", "chain", F.posexplode("ts").alias("i", "t"))
    return each.select("conv_id", (F.col("i") + 1).alias("k"), F.col("t.role").alias("role"), F.col("t.text").alias("text"), F.element_at("chain", F.col("i") + 2).alias("node"), F.element_at("chain", F.col("i") + 1).alias("parent"))


def tree(turned: DataFrame) -> DataFrame:
    """(node, parent, k, role, segment, tree, length, start, position, attend) of each node.

    Distinct conversations are sorted by their paths. The first in that order that goes
    through a node emits it, so nodes in the order of (emitting conversation, depth) are in
    depth-first order; ``start`` is a prefix sum in that order, in three steps: along a
    conversation, over the conversations of a sorted partition, over the partitions. The
    number of jobs doesn't depend on the length of any conversation.
    """
    nodes = checkpointed(turned.groupBy("node", "parent", "k").agg(F.min(F.struct("role", "text")).alias("t")).select("node", "parent", "k", F.col("t.role").alias("role"), segment(F.col("t.role"), F.col("t.text")).alias("segment")))
    paths = turned.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "node"))).alias("p")).select(F.transform("p", lambda s: s["node"]).alias("path"))
    distinct = paths.groupBy(F.element_at("path", -1).alias("leaf")).agg(F.first("path").alias("path"))
    ordered = checkpointed(distinct.select("path").orderBy("path").withColumn("r", F.monotonically_increasing_id()))
    steps = ordered.select("r", F.posexplode("path").alias("i", "node"))

    sizes = nodes.select("node", "k", F.char_length("segment").cast("long").alias("length"))
    owned = sizes.join(steps.groupBy("node").agg(F.min("r").alias("r")), "node")
    along = W.partitionBy("r").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    owned = checkpointed(owned.withColumn("before", F.coalesce(F.sum("length").over(along), F.lit(0))).join(ordered.select("r", F.col("path")[0].alias("tree")), "r"))

    totals = owned.groupBy("r").agg(F.sum("length").alias("total")).withColumn("part", F.shiftright("r", 33))
    inner = W.partitionBy("part").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("total").alias("s")).select("part", F.coalesce(F.sum("s").over(outer), F.lit(0)).alias("skip"))
    bases = totals.withColumn("earlier", F.coalesce(F.sum("total").over(inner), F.lit(0))).join(parts, "part").select("r", (F.col("skip") + F.col("earlier")).alias("base"))
    at = owned.join(bases, "r").withColumn("at", F.col("base") + F.col("before")).drop("base", "before")
    first = at.where("k = 1").select("tree", F.col("at").alias("origin"))
    placed = checkpointed(at.join(first, "tree").select("r", "node", "k", "tree", "length", (F.col("at") - F.col("origin")).alias("start")))

    span = F.struct("i", F.col("start"), (F.col("start") + F.col("length")).alias("end"))
    spans = steps.join(placed.select("node", "start", "length"), "node").groupBy("r").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    above = F.transform(F.slice("spans", 1, F.col("k") - 1), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    position = F.aggregate("attend", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = placed.join(spans, "r").select("node", "tree", "length", "start", above.alias("attend")).withColumn("position", position)
    return nodes.join(out, "node")


def read_back(leaves: DataFrame, emitted: DataFrame) -> DataFrame:
    """Each conversation's turns from the packed output: (conv_id, k, role, text, segment).

    A conversation's path is its leaf's attention intervals and the leaf itself; each
    names a segment by tree and start.
    """
    own = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end")))
    paths = leaves.join(emitted.select("node", "tree", "start", "length", "attend"), leaves["leaf"] == emitted["node"])
    steps = paths.select("conv_id", "tree", F.posexplode(F.concat("attend", own)).alias("i", "at")).select("conv_id", "tree", (F.col("i") + 1).alias("k"), F.col("at.start").alias("start"))
    texts = emitted.select("tree", "start", "segment")
    body = F.substring(F.col("segment"), len(OPEN) + 1, F.char_length("segment") - len(OPEN) - len(CLOSE) - 1)
    cut = F.instr(body, "\n")
    return steps.join(texts, ["tree", "start"]).select("conv_id", "k", unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.char_length(body))).alias("text"), "segment")


def format_chats(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(emitted nodes, leaves): see the module's text. leaves: (conv_id, leaf)."""
    turned = checkpointed(turns(conversations, **columns))
    leaves = turned.groupBy("conv_id").agg(F.max_by("node", "k").alias("leaf"))
    return checkpointed(tree(turned)), leaves


def digests(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output.

    The loss mask covers the text of each assistant turn.
    """
    emitted, leaves = format_chats(conversations, **columns)
    read = read_back(leaves, emitted)
    turn = F.struct("k", "role", "text", F.char_length("segment").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("ts"))
    said = F.array_join(F.transform(F.filter("ts", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    every = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda acc, t: acc + t["chars"]).alias("formatted_chars"),
    )


#: The conversation that tests the escapes: fixed values.
CONTROL_TURNS = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    named = conversations.select("conv_id", "turn", "role", "text")
    return named.union(conversations.sparkSession.createDataFrame(list(CONTROL_TURNS), "conv_id long, turn long, role string, text string"))
