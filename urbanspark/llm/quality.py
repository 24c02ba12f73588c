r"""Quality rules: fixed text rules, then a hashed n-gram likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over buckets
are counted, one over all documents and one over the trusted ones (label quality 1). A
document's score is the mean log ratio, trusted to raw, over its n-grams, so its length
doesn't matter. The threshold is the score that best separates the labelled documents of
either quality (the middle of the best gap); every document is held against it.

Base rules: ``n_words`` under 50, or more than half of the words in repeated 3-word
windows. Words are runs outside space and U+0009..U+000D of the whole text as it is.

Rows: one for each row of the documents. Null and empty texts have no words and fail the
base rules. Of several labels of a document the greatest quality counts, null labels are
ignored; without labels of both kinds the threshold keeps whatever passes the base rules.
An empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanspark.functions.session import broadcast_if_small, checkpointed
from urbanspark.llm import textbytes as tb

BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Labels up to this many are broadcast to the texts (about 16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
BIN, BINS = 0.02, 1000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def ngrams(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word and of each pair of neighbours."""
    pair = rows[1:] == rows[:-1]
    both = tb.mix(word[:-1][pair] * np.uint64(3) + word[1:][pair])
    bucket = np.concatenate([word, both]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.concatenate([rows, rows[:-1][pair]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a task's texts, raw and trusted."""
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        for first, end, data, offsets in tb.text_slices(batch.column(0)):
            starts, ends, rows = tb.words(data, offsets)
            bucket, row = ngrams(data, offsets, starts, ends, rows, tb.hashes(data, starts, ends))
            raw += np.bincount(bucket, minlength=BUCKETS)
            trusted += np.bincount(bucket[good[first:end][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The table of log ratios, from (bucket, raw, trusted): BUCKETS entries whatever the corpus."""
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():
        raw[r["bucket"]], trusted[r["bucket"]] = r["raw"], r["trusted"]
    p = (trusted + SMOOTHING) / (trusted.sum() + SMOOTHING * BUCKETS)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log(p) - np.log(q)


def repeated_words(word: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row, the words inside 3-word windows that occur twice or more in it."""
    same = rows[2:] == rows[:-2] if len(rows) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(same)
    if not len(at):
        return np.zeros(n, np.int64)
    window = tb.mix(tb.mix(word[at] + np.uint64(1)) * np.uint64(3) + tb.mix(word[at + 1]) * np.uint64(5) + word[at + 2])
    key = tb.mix(window + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    twin = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][twin]] = True
    often[order[:-1][twin]] = True
    inside = np.zeros(len(word), bool)
    for k in range(3):
        inside[at[often] + k] = True
    return np.bincount(rows[inside], minlength=n)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each row, its lines with a word that equal an earlier line."""
    edge = np.zeros(len(data) + 1, bool)
    edge[np.flatnonzero(data == 10) + 1] = True
    edge[offsets[:-1]] = True
    begins = np.flatnonzero(edge[: len(data)])
    if not len(begins):
        return np.zeros(n, np.int64)
    ends = np.append(begins[1:], len(data))
    row = np.searchsorted(offsets, begins, "right") - 1
    ends = np.where(data[np.maximum(ends - 1, begins)] == 10, ends - 1, ends)
    worded = np.diff(np.searchsorted(starts, np.append(begins, len(data)))) > 0
    begins, ends, row = begins[worded], ends[worded], row[worded]
    key = tb.mix(tb.hashes(data, begins, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return np.bincount(row[later], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the score of each text."""
    n = len(offsets) - 1
    starts, ends, rows = tb.words(data, offsets)
    word = tb.hashes(data, starts, ends)
    bounds = tb.row_starts(rows, n)
    if len(data):
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    else:
        heads = symbols = np.zeros(1, np.int64)
    bucket, row = ngrams(data, offsets, starts, ends, rows, word)
    total = np.bincount(row, weights=ratios[bucket], minlength=n)
    score = total / np.maximum(np.bincount(row, minlength=n), 1)
    return [
        np.diff(bounds),
        tb.row_sums(heads[ends] - heads[starts], bounds),
        symbols[offsets[1:]] - symbols[offsets[:-1]],
        repeated_lines(data, offsets, starts, rows, n),
        repeated_words(word, rows, n),
        np.round(score, 9),
    ]


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(1)):
                *counts, score = features(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(score)], ["doc_id", *NAMES, "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {', '.join(f'{k} long' for k in NAMES)}, score double")


def best_threshold(bins: dict[int, tuple[int, int]]) -> float:
    """The cut between score bins that keeps most of the good and rejects most of the poor.

    ``bins``: bin -> (poor, good). Of equally good cuts, the middle one.
    """
    poor, good = (sum(c[k] for c in bins.values()) for k in (0, 1))
    if not poor or not good:
        return float("-inf")
    best, cuts, below = -1.0, [], [0, 0]
    for b in range(-BINS, BINS + 2):
        value = below[0] / poor + 1 - below[1] / good
        if value > best + 1e-12:
            best, cuts = value, [b]
        elif value > best - 1e-12:
            cuts.append(b)
        below = [x + y for x, y in zip(below, bins.get(b, (0, 0)), strict=True)]
    return (cuts[0] + cuts[-1]) / 2 * BIN


def assess(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_id_col).alias("__id")).agg(F.max(label_col).alias("quality"))
    held = broadcast_if_small(known, BROADCAST_LABELS)
    flagged = docs.join(held, docs["doc_id"] == held["__id"], "left").select("text", (F.col("quality") == 1).alias("trusted"))
    ratios = log_ratios(flagged.mapInArrow(_count, "bucket long, raw long, trusted long"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = checkpointed(_scored(docs, ratios).withColumn("base_failed", base))
    binned = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS)).alias("bin")
    sure = scored.where("NOT base_failed").join(held, scored["doc_id"] == held["__id"]).groupBy(binned, "quality").count().collect()
    bins: dict[int, tuple[int, int]] = {}
    for r in sure:
        poor, good = bins.get(r["bin"], (0, 0))
        bins[r["bin"]] = (poor + r["count"], good) if r["quality"] == 0 else (poor, good + r["count"])
    cut = best_threshold(bins)
    return scored.select("doc_id", *NAMES, "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= cut)).alias("kept"))
