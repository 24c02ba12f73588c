r"""Line dedup by a log-template tree of fixed depth.

A line (between ``\n``) goes down a tree: first by its token count, then by its leading
``DEPTH`` tokens; tokens with a digit are the field ``<*>`` at every level. In the leaf
the rest is generalised place by place: a token that at least ``min_docs`` documents have
at its place in the leaf stays, any other is a variable field. A line's template is its
count, leading tokens and staying tokens. A template is used if at least ``constant`` of
its places stay, and recurs if at least ``min_docs`` documents have it. The lines of a
recurring template are dropped from all documents but the first, the one of least
doc_id, which keeps them.

Repeats that no template is needed for go too (``exact_lines``): a line whose tokens,
digits too, stand in at least two documents goes from all but the first, and a line of
fewer than ``min_tokens`` tokens if at least ``short_docs`` have it. A leaf of one kind of
line meets the constant share like any other, so rows of different numbers stay.

Only leaves that enough documents reach are generalised, and only their distinct lines
are read by token; a line that thousands share is one row there, with its document count.

Rows: tokens are runs outside space and U+0009..U+000D. Lines of fewer than ``min_tokens``
tokens never belong to a template. Null texts have no lines and stay null. Rows with the same
doc_id count as one document for recurrence and each lose the lines that the other has
too; documents with null doc_id count as one document. An empty table gives an empty
result. Other columns are kept by ``drop_lines`` and neither read nor returned otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions.session import checkpointed
from urbanspark.llm import rowkeys
from urbanspark.llm import textbytes as tb

DEPTH, MIN_TOKENS, MIN_DOCS = 3, 5, 3
#: Documents that make an identical line of fewer than MIN_TOKENS tokens recur; two make a longer one recur.
SHORT_DOCS = 3
#: Share of a template's places that must stay, in tenths.
CONSTANT_TENTHS = 8
_FIELD = np.uint64(0x2A3C2A3E)


def parse(data: np.ndarray, offsets: np.ndarray, depth: int, masked: bool = True) -> tuple[np.ndarray, ...]:
    """(row, line number, token count, leaf, line hash, token bounds, tokens) of the lines with a token."""
    starts, ends, rows = tb.words(data, offsets)
    token = tb.hashes(data, starts, ends)
    if masked:
        digits = np.concatenate([[0], np.cumsum(tb.DIGIT[data])])
        token[digits[ends] > digits[starts]] = _FIELD
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[starts] - breaks[offsets[rows]]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])
    at = np.append(np.flatnonzero(new), len(starts))
    first = at[:-1]
    count = np.diff(at)
    leaf = tb.mix(count.astype(np.uint64))
    for k in range(depth):
        has = count > k
        leaf[has] = tb.mix(leaf[has] * np.uint64(3) + token[first[has] + k])
    place = np.arange(len(starts)) - np.repeat(first, count)
    whole = tb.mix(token + tb.mix(place.astype(np.uint64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64)])
    text = tb.mix(total[at[1:]] - total[at[:-1]] + leaf)
    return rows[first], line[first], count, leaf, text, at, token


def _lines(batches: Iterator[pa.RecordBatch], depth: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in tb.text_slices(batch.column(1)):
            row, line, count, leaf, text, _, _ = parse(data, offsets, depth)
            keep = np.flatnonzero(count >= min_tokens)
            ids = batch.column(0).slice(first, end - first).take(pa.array(row[keep]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(line[keep].astype(np.int32)), pa.array(count[keep].astype(np.int32)), pa.array(tb.signed(leaf[keep])), pa.array(tb.signed(text[keep]))], ["doc_id", "line", "n", "leaf", "text"])


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in tb.text_slices(batch.column(1)):
            row, line, count, _, text, _, _ = parse(data, offsets, 0, masked=False)
            ids = batch.column(0).slice(first, end - first).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(line.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(tb.signed(text))], ["doc_id", "line", "n", "text"])


def _tokens(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The tokens of the wanted lines of each text: column 1 holds their numbers."""
    for batch in batches:
        wanted = [set(x) for x in batch.column(1).to_pylist()]
        for first, end, data, offsets in tb.text_slices(batch.column(0)):
            row, line, count, leaf, text, at, token = parse(data, offsets, depth)
            keep = [i for i, (r, k) in enumerate(zip(row.tolist(), line.tolist(), strict=True)) if k in wanted[first + r]]
            bounds = np.concatenate([[0], np.cumsum(count[keep])]).astype(np.int32)
            values = np.concatenate([token[at[i] : at[i + 1]] for i in keep]) if keep else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(leaf[keep])), pa.array(tb.signed(text[keep])), pa.ListArray.from_arrays(pa.array(bounds), pa.array(tb.signed(values)))], ["leaf", "text", "tokens"])


def recurring_lines(docs: DataFrame, *, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, constant_tenths: int = CONSTANT_TENTHS) -> DataFrame:
    """(doc_id, line) of every line of a recurring template in ``docs`` (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lines = checkpointed(docs.select("doc_id", "text").mapInArrow(partial(_lines, depth=depth, min_tokens=min_tokens), f"doc_id {id_type}, line int, n int, leaf long, text long").distinct())
    once = lines.groupBy("leaf", "text", "n", "doc_id").agg(F.min("line").alias("line"))
    distinct = once.groupBy("leaf", "text", "n").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "line")).alias("carrier"))
    reached = distinct.groupBy("leaf").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs).select("leaf")
    mixed = checkpointed(distinct.join(reached, "leaf"))

    # Each distinct line of a leaf is read once, from the document that carries it.
    wanted = mixed.groupBy(F.col("carrier.doc_id").alias("__id")).agg(F.collect_set("carrier.line").alias("wanted"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"])).select("text", "wanted")
    tokens = texts.mapInArrow(partial(_tokens, depth=depth), "leaf long, text long, tokens array<long>").dropDuplicates(["leaf", "text"])
    placed = checkpointed(mixed.select("leaf", "text", "n", "docs").join(tokens, ["leaf", "text"]).select("leaf", "text", "n", "docs", F.posexplode("tokens").alias("place", "token")))
    staying = placed.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs).drop("d")
    stays = placed.join(staying, ["leaf", "place", "token"]).where(F.col("token") != int(_FIELD))
    forms = stays.groupBy("leaf", "text", "n").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("place", "token")).alias("form"))
    template = forms.where(F.col("c") * 10 >= F.col("n") * constant_tenths).select("leaf", "text", "form")
    held = checkpointed(lines.join(template, ["leaf", "text"]).select("leaf", "form", "doc_id", "line"))
    owners = held.groupBy("leaf", "form", "doc_id").agg(F.lit(1).alias("one"))
    recurring = owners.groupBy("leaf", "form").agg(F.count("*").alias("d"), F.min("doc_id").alias("first")).where(F.col("d") >= min_docs)
    return held.join(recurring, ["leaf", "form"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "line").distinct()


def exact_lines(docs: DataFrame, *, min_tokens: int = MIN_TOKENS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """(doc_id, line) of every line of ``docs`` (doc_id, text) that stands identically in an earlier document, if enough have it.

    The least and the greatest doc_id of a line tell whether it has two documents, so nothing is gathered by line;
    null doc_ids are one document beside them.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    lines = checkpointed(docs.select("doc_id", "text").mapInArrow(_whole_lines, f"doc_id {id_type}, line int, n int, text long"))
    owners = lines.groupBy("text", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed"))
    two = owners.where((F.col("first") != F.col("last")) | (F.col("unnamed") & F.col("first").isNotNull())).select("text", "n", "first")
    short = lines.where(F.col("n") < min_tokens).select("text", "n", "doc_id").distinct().groupBy("text", "n").agg(F.count("*").alias("d"))
    enough = short.where(F.col("d") >= short_docs).select("text", "n")
    recurring = two.where(F.col("n") >= min_tokens).union(two.join(enough, ["text", "n"], "left_semi"))
    return lines.join(recurring, ["text", "n"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "line").distinct()


def repeats(docs: DataFrame, *, min_tokens: int = MIN_TOKENS, short_docs: int = SHORT_DOCS, **options) -> DataFrame:
    """(doc_id, line) of every line to drop from ``docs`` (doc_id, text): of a recurring template, or an identical repeat."""
    return recurring_lines(docs, min_tokens=min_tokens, **options).union(exact_lines(docs, min_tokens=min_tokens, short_docs=short_docs))


def drop_lines(docs: DataFrame, drops: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines named in ``drops`` (doc_id, line); adds __dropped, their numbers."""
    per_doc = drops.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("line")).alias("__dropped"))
    joined = docs.join(per_doc, docs[id_col].eqNullSafe(per_doc["__id"]), "left").drop("__id")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, i: ~F.array_contains("__dropped", i))
    return joined.withColumn(text_col, F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped_lines, text): each text without its recurring lines."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    left = drop_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")), repeats(docs, **options))
    dropped = F.coalesce("__dropped", F.array().cast("array<int>"))
    n_lines = F.when(F.col("text").isNull() & (F.size(dropped) == 0), F.lit(0)).otherwise(F.col("n_lines")).cast("long")
    return left.select("doc_id", n_lines.alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped_lines"), "text")


@rowkeys.apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document whose every word was in them goes too. n_chars is renewed.

    Rows are judged by (doc_id, text): a null id is an id, repeated rows lose the same lines. A null or
    blank text stays as it is. A template's field values that stood only in dropped lines are gone
    with them. An empty table gives an empty one; columns of any name are kept.
    """
    rows = rowkeys.keyed(docs)
    named = rowkeys.named(rows)
    left = drop_lines(rows, repeats(named), id_col=rowkeys.KEY)
    emptied = F.col("__dropped").isNotNull() & (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") == "")
    left = left.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(length))
    return left.select(*docs.columns)
