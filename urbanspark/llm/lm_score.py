"""Language-model scoring by masked pseudo-likelihood.

A text's score is the sum over its words of log P(word | the words on both sides). A
window network gives it: each of the ``WINDOW`` words before and after has an embedding
by place, their sum goes through tanh, and a softmax predicts the masked word's unit.
The most frequent words are units of their own; the others share class units, bands of
the frequency order of about equal mass, and P(word) inside a class is the word's share
of the class in the corpus.

Everything comes from the whole corpus: each distinct word is counted over all documents
over a shuffle that grows with the corpus, never broadcast, and the network is
trained in numpy by all tasks at once, each passing over every text of its partition with
every word masked once, all from the same start; their weights are averaged by the number
of masked words. What is broadcast has a fixed size. A different partitioning gives
slightly different weights, and so scores.

Texts are cut into slices of whole documents. A slice sends each of its distinct words once,
with how often it occurs there, and gets the word's count in the corpus back: one shuffle by
word and one by slice. Units and shares follow from the counts, so the words themselves don't
travel back, but for those common enough to be units of their own. Words are held by 64-bit
hashes.

Rows: one for each row of the documents. Words are runs outside space and U+0009..U+000D,
A-Z lower-cased, of whole texts; null and empty texts have no words, log_prob 0 and a null
mean. Repeated rows count as often as they occur. An empty table gives an empty result.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanspark.functions.session import checkpointed
from urbanspark.llm import textbytes as tb

FREQUENT, CLASSES = 128, 63
UNITS = FREQUENT + CLASSES
#: The unit of a place beyond either end of a text.
OUTSIDE = UNITS
WINDOW, WIDTH = 2, 24
#: Words scored at once; the scores of a block stay in a core's cache.
BLOCK = 256
SLICE_BYTES = 4 << 20
#: Frequency bins for each factor e of the count; classes are runs of bins.
BINS = 16
_CODEC = "zstd"
#: Scores within this bound of 0 need no shift before exp, and neither sums nor their inverses leave float32.
_SAFE = 40


class Lookup:
    """A column of the word table by word hash, fetched to the driver for the words asked for only."""

    def __init__(self, table: DataFrame, column: str, unseen: float):
        self.table, self.column, self.unseen, self.known = table, column, unseen, {}

    def __getitem__(self, word):
        asked = np.atleast_1d(word).tolist()
        new = list(set(asked) - set(self.known))
        if new:
            found = dict(self.table.where(F.col("word").isin(new)).select("word", self.column).collect())
            self.known.update((w, found.get(w, self.unseen)) for w in new)
        values = np.array([self.known[w] for w in asked])
        return values if np.ndim(word) else values[0]


def bins(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) * BINS).astype(np.int64)


def least(b: int) -> int:
    """The least count in frequency bin ``b`` or above."""
    n = max(int(np.exp(b / BINS)), 1)
    while bins(n) < b:
        n += 1
    while n > 1 and bins(n - 1) >= b:
        n -= 1
    return n


@dataclass
class Coding:
    """Units and log shares of words from their counts; a count of 0 is a word that the corpus lacks."""

    own: dict[int, int]  # unit of each of the most frequent words
    own_from: int  # the least count of these
    classes: np.ndarray  # the least count of each class, descending
    unseen: tuple[int, float]
    log_mass: np.ndarray

    def __call__(self, n: np.ndarray, common: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words with counts ``n``, of which those at the places ``common`` are ``words``."""
        unit = np.minimum(FREQUENT + np.searchsorted(-self.classes, -n), self.unseen[0])
        for i, word in zip(common.tolist(), words.tolist(), strict=True):
            unit[i] = self.own.get(word, unit[i])
        share = np.log(np.maximum(n, 1)) - self.log_mass[unit]
        share[unit < FREQUENT] = 0
        share[n == 0] = self.unseen[1]
        return unit, share


@dataclass
class Units:
    """(word, unit, share, n) of each word of the corpus, share in logs; log P(unit); what gives unit and share of any word."""

    table: DataFrame
    log_p: np.ndarray
    coding: Coding

    def __post_init__(self):
        self.unit, self.share = (Lookup(self.table, c, u) for c, u in zip(("unit", "share"), self.coding.unseen, strict=True))


@dataclass
class Weights:
    context: np.ndarray  # 2 WINDOW x (UNITS + 1) x WIDTH
    hidden: np.ndarray  # WIDTH
    out: np.ndarray  # WIDTH x UNITS
    bias: np.ndarray  # UNITS
    seen: int = 0  # words trained on

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.hidden, self.out, self.bias)])

    @staticmethod
    def of(flat: np.ndarray, seen: int = 0) -> Weights:
        shapes = [(2 * WINDOW, UNITS + 1, WIDTH), (WIDTH,), (WIDTH, UNITS), (UNITS,)]
        parts = np.split(flat.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return Weights(*(p.reshape(s).copy() for p, s in zip(parts, shapes, strict=True)), seen)


def start(units: Units, seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return Weights(draw(2 * WINDOW, UNITS + 1, WIDTH), np.zeros(WIDTH, np.float32), draw(WIDTH, UNITS), units.log_p.astype(np.float32))


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    lower = tb.LOWER[data]
    starts, ends, rows = tb.words(lower, offsets)
    return tb.signed(tb.hashes(lower, starts, ends)), rows


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice: its ids, their numbers of words, the distinct words, most frequent first, how often the first of them, and each word's place among them."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for first, end, _, _ in tb.text_slices(batch.column(1), SLICE_BYTES):
            found, n = [], []
            for start, stop, data, offsets in tb.text_slices(batch.column(1).slice(first, end - first)):
                word, rows = buckets(data, offsets)
                found.append(word)
                n.append(np.bincount(rows, minlength=stop - start))
            words, at, often = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ids = batch.column(0).slice(first, end - first)
            lists = (_list(pa.array(x)) for x in (np.concatenate(n), words[order], often[order[:FREQUENT]]))
            columns = [pa.array([number]), _list(ids), *lists, pa.array([_packed(place[at], np.int32)])]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "ids", "n", "words", "often", "at"])
            number += 1


def _packed(values: np.ndarray, kind: type) -> bytes:
    """Small numbers, all first bytes before all second ones."""
    planes = values.astype(kind)[:, None].view(np.uint8).T
    return pa.compress(planes.tobytes(), _CODEC, asbytes=True)


def _opened(packed: bytes, size: int, kind: type) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, size * width, _CODEC), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def sliced(docs: DataFrame) -> DataFrame:
    """The slices of ``docs`` (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"slice long, ids array<{id_type}>, n array<long>, words array<long>, often array<long>, at binary"
    return checkpointed(docs.select("doc_id", "text").mapInArrow(_slices, columns))


def bands(mass: dict[int, int]) -> dict[int, int]:
    """The class of each frequency bin, from the most frequent down, in at most CLASSES of about equal mass."""
    out, left, own, k = {}, sum(mass.values()), 0, 0
    share = left / CLASSES
    for b in sorted(mass, reverse=True):
        if own and own + mass[b] / 2 > share and k < CLASSES - 1:
            left -= own
            own, k = 0, k + 1
            share = left / (CLASSES - k)
        out[b] = k
        own += mass[b]
    return out


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, n = batch.column("words").slice(i, 1).flatten(), batch.column("n").slice(i, 1).flatten()
            often = np.bincount(_opened(batch.column("at")[i].as_py(), int(n.to_numpy().sum()), np.int32), minlength=len(words))
            numbers = pa.array(np.full(len(words), batch.column("slice")[i].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([numbers, pa.array(np.arange(len(words), dtype=np.int32)), words, pa.array(often)], ["slice", "i", "word", "often"])


def asked(slices: DataFrame) -> DataFrame:
    """(slice, i, word, often): each distinct word of each slice."""
    return slices.select("slice", "n", "words", "at").mapInArrow(_asked, "slice long, i int, word long, often long")


def common_from(slices: DataFrame) -> int:
    """A count that each of the FREQUENT commonest words reaches: sums over the commonest of each slice are at most a word's count."""
    own = F.arrays_zip(F.slice("words", 1, FREQUENT).alias("word"), F.col("often").alias("n"))
    top = slices.select(F.explode(own).alias("x")).groupBy("x.word").agg(F.sum("x.n").alias("n")).orderBy(F.desc("n")).limit(FREQUENT).select("n").collect()
    return min(r["n"] for r in top) if len(top) == FREQUENT else 1


def _counted(slice: pa.Table, found: pa.Table) -> pa.Table:
    """A slice with the counts of its distinct words, and its share of the mass of each frequency bin."""
    own = slice.column("n").combine_chunks().flatten().to_numpy()
    at = _opened(slice.column("at")[0].as_py(), int(own.sum()), np.int32)
    often = np.bincount(at)
    total, places = often.copy(), found.column("i").to_numpy()
    total[places] = found.column("total").to_numpy()
    known = total > 0
    bin_, at_bin = np.unique(bins(total[known]), return_inverse=True)
    mass = np.bincount(at_bin, often[known], len(bin_)).astype(np.int64)
    word = found.column("word").combine_chunks()
    common = np.flatnonzero(word.is_valid().to_numpy(zero_copy_only=False))
    lists = [_list(pa.array(x)) for x in (places[common].astype(np.int32), word.drop_null().to_numpy(), total[places[common]], bin_, mass)]
    columns = [*(slice.column(c).combine_chunks() for c in ("ids", "n", "at")), pa.array([_packed(total, np.int64)]), *lists]
    return pa.table(columns, ["ids", "n", "at", "total", "common", "words", "counts", "bins", "mass"])


def counted(slices: DataFrame, found: DataFrame, common: int) -> DataFrame:
    """Slices with the counts from ``found`` (slice, i, word, often, total); words that occur ``common`` times or more stay named.

    A slice knows the counts of the words that it alone has.
    """
    found = found.where((F.col("total") != F.col("often")) | (F.col("total") >= common)).select(F.col("slice").alias("of"), "i", "total", F.when(F.col("total") >= common, F.col("word")).alias("word"))
    own = slices.select("slice", "ids", "n", "at")
    kinds = slices.schema["ids"].dataType.simpleString()
    columns = f"ids {kinds}, n array<long>, at binary, total binary, common array<int>, words array<long>, counts array<long>, bins array<long>, mass array<long>"
    return checkpointed(own.groupBy("slice").cogroup(found.groupBy("of")).applyInArrow(_counted, columns))


def counted_here(slices: DataFrame) -> DataFrame:
    """Slices with the counts of their words in all of them."""
    total = F.sum("often").over(Window.partitionBy("word"))
    return counted(slices, asked(slices).withColumn("total", total), common_from(slices))


def counted_there(slices: DataFrame, units: Units) -> DataFrame:
    """Slices with the counts of their words in the corpus of ``units``."""
    found = asked(slices).join(units.table.select("word", F.col("n").alias("total")), "word", "left").fillna(0, ["total"])
    return counted(slices, found, units.coding.own_from)


def units_of(slices: DataFrame, texts: DataFrame) -> Units:
    """Units from all slices, ``texts`` with their counts."""
    pairs = lambda a, b: F.explode(F.arrays_zip(a, b)).alias("x")
    named = texts.select(pairs("words", "counts")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    top = named.distinct().orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    binned = texts.select(pairs("bins", "mass")).groupBy("x.bins").agg(F.sum("x.mass").alias("n")).collect()
    rest = {r["bins"]: r["n"] for r in binned}
    mass = np.zeros(UNITS)
    for i, r in enumerate(top):
        mass[i] = r["n"]
        rest[int(bins(r["n"]))] -= r["n"]
    band = bands({b: n for b, n in rest.items() if n})
    for b, k in band.items():
        mass[FREQUENT + k] += rest[b]
    lowest = {k: b for b, k in band.items()}  # bands() goes down, so the last is the lowest
    classes = np.array([least(lowest[k]) for k in sorted(lowest)], np.int64)
    rarest = FREQUENT + max(band.values(), default=0)
    unseen = rarest, float(np.log(0.5) - np.log(max(mass[rarest], 1)))
    log_mass = np.log(np.maximum(mass, 1))
    coding = Coding({r["word"]: i for i, r in enumerate(top)}, min((r["n"] for r in top), default=1), classes, unseen, log_mass)
    return Units(word_table(asked(slices).groupBy("word").agg(F.sum("often").alias("n")), coding), np.log((mass + 1) / (mass.sum() + UNITS)), coding)


def word_table(counts: DataFrame, coding: Coding) -> DataFrame:
    """(word, unit, share, n) of ``counts`` (word, n)."""
    spark = counts.sparkSession
    own = spark.createDataFrame(list(coding.own.items()), "word long, own int")
    masses = spark.createDataFrame([(i, float(m)) for i, m in enumerate(coding.log_mass)], "unit int, log_mass double")
    above = F.size(F.filter(F.array(*map(F.lit, coding.classes.tolist())).cast("array<long>"), lambda c: c > F.col("n")))
    unit = F.coalesce("own", F.least(F.lit(FREQUENT) + above, F.lit(coding.unseen[0])))
    share = F.when(F.col("unit") < FREQUENT, 0.0).otherwise(F.log("n") - F.col("log_mass"))
    return counts.join(F.broadcast(own), "word", "left").withColumn("unit", unit).join(F.broadcast(masses), "unit").select("word", "unit", share.alias("share"), "n")


def _unpacked(batch: pa.RecordBatch, coding: Coding) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, numbers of words of the documents, unit, log share, row) of each slice."""
    for i in range(batch.num_rows):
        ids, n, common, words = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "n", "common", "words"))
        n = n.to_numpy(zero_copy_only=False)
        at = _opened(batch.column("at")[i].as_py(), int(n.sum()), np.int32)
        total = _opened(batch.column("total")[i].as_py(), int(at.max(initial=-1)) + 1, np.int64)
        unit, share = coding(total, common.to_numpy(zero_copy_only=False), words.to_numpy(zero_copy_only=False))
        yield ids, n, unit.astype(np.int16)[at], share[at], np.repeat(np.arange(len(n)), n)


def windows(unit: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """2 WINDOW x words: the unit at each place around each word, OUTSIDE beyond its text."""
    around = np.full((2 * WINDOW, len(unit)), OUTSIDE, np.int16)
    for k in range(1, WINDOW + 1):
        same = rows[k:] == rows[:-k]
        around[2 * k - 2, k:][same] = unit[:-k][same]
        around[2 * k - 1, : len(unit) - k][same] = unit[k:][same]
    return around


#: Where each place's embeddings start among the rows of all.
_PLACES = (np.arange(2 * WINDOW) * (UNITS + 1))[:, None]


class Network:
    """Weights, and room for ``size`` words at once: arrays of this size would be asked of the system again in each step."""

    def __init__(self, weights: Weights, size: int):
        # The bias is one more row of output weights, met by a column of ones.
        self.net = np.vstack([weights.out, weights.bias])
        self.weights = weights
        weights.out, weights.bias = self.net[:-1], self.net[-1]
        self.embeddings = weights.context.reshape(-1, WIDTH)
        self.numbers = np.arange(self.embeddings.size).reshape(self.embeddings.shape)
        self.around, self.where = (np.empty(2 * WINDOW * size * WIDTH, kind) for kind in (np.float32, np.int64))
        self.hidden, self.score = np.ones((size, WIDTH + 1), np.float32), np.empty((size, UNITS), np.float32)
        self.rows, self.ones = np.arange(size), np.ones(UNITS, np.float32)

    def _room(self, buffer: np.ndarray, n: int) -> np.ndarray:
        return buffer[: 2 * WINDOW * n * WIDTH].reshape(2 * WINDOW, n, WIDTH)

    def scores(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden, scores of all units) of words with the rows ``at`` (place x words) of all embeddings around them."""
        n = at.shape[1]
        hidden = self.hidden[:n]
        around = self.embeddings.take(at, axis=0, out=self._room(self.around, n), mode="clip")
        total = around[0]
        for k in range(1, 2 * WINDOW):
            total += around[k]
        total += self.weights.hidden
        np.tanh(total, out=hidden[:, :WIDTH])
        hidden[:, WIDTH] = 1
        return hidden, np.matmul(hidden, self.net, out=self.score[:n])

    def step(self, at: np.ndarray, unit: np.ndarray, rate: float) -> None:
        """One gradient step on a batch of masked words."""
        n, at = len(unit), np.ascontiguousarray(at)
        h, p = self.scores(at)
        if not (p.max() < _SAFE and p.min() > -_SAFE):
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        total = p @ self.ones
        p[self.rows[:n], unit] -= total
        # p / total, less 1 at the word's own unit, is the gradient; the division waits for the narrow side.
        pace = (np.float32(rate / n) / total)[:, None]
        d = p @ self.net[:-1].T
        d *= 1 - np.square(h[:, :WIDTH])
        d *= pace
        h *= pace
        self.net -= (p.T @ h).T
        self.weights.hidden -= d.sum(axis=0)
        where = self.numbers.take(at, axis=0, out=self._room(self.where, n), mode="clip")
        each = self._room(self.around, n)
        each[:] = d
        np.subtract.at(self.embeddings.reshape(-1), where.reshape(-1), each.reshape(-1))


def log_probabilities(weights: Weights, around: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """log P(unit | both sides) of every word."""
    network, out = Network(replace(weights), BLOCK), np.empty(len(unit))
    safe = np.abs(network.net).sum(axis=0).max() < _SAFE  # tanh is at most 1
    at = around + _PLACES
    for i in range(0, len(unit), BLOCK):
        block, own = slice(i, i + BLOCK), unit[i : i + BLOCK]
        score = network.scores(np.ascontiguousarray(at[:, block]))[1]
        if not safe:
            score -= score.max(axis=1, keepdims=True)
        out[block] = score[network.rows[: len(own)], own]
        out[block] -= np.log(np.exp(score, out=score) @ network.ones)
    return out


def _train(batches: Iterator[pa.RecordBatch], weights: Weights, coding: Coding, batch_size: int, rate: float) -> Iterator[pa.RecordBatch]:
    """One task's weights times its number of masked words, and that number at index -1."""
    weights, seen = Weights.of(weights.flat()), 0  # a copy: the next task of this worker starts from the same
    network = Network(weights, batch_size)
    rng = np.random.default_rng(5)
    for batch in batches:
        for _, _, unit, _, rows in _unpacked(batch, coding):
            masked = rng.permutation(len(unit))
            at = windows(unit, rows)[:, masked] + _PLACES
            target = unit[masked]
            for i in range(0, len(masked), batch_size):
                pace = rate / (1 + (seen + i) / 100_000)
                network.step(at[:, i : i + batch_size], target[i : i + batch_size], pace)
            seen += len(masked)
    if seen:
        flat = weights.flat().astype(np.float64) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.concatenate([[seen], flat]))], ["at", "value"])


def trained(texts: DataFrame, units: Units, batch_size: int, rate: float) -> Weights:
    """The network from all counted slices."""
    first = start(units)
    shared = texts.sparkSession.sparkContext.broadcast((first, units.coding))
    each = texts.mapInArrow(lambda batches: _train(batches, *shared.value, batch_size, rate), "at long, value double")
    sums = each.groupBy("at").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return first
    flat = np.zeros(len(sums))
    for r in sums:
        flat[r["at"]] = r["value"]
    return Weights.of(flat[:-1] / flat[-1], int(flat[-1]))


def _modelled(docs: DataFrame, batch_size: int, rate: float) -> tuple[Units, Weights, DataFrame]:
    slices = sliced(docs)
    texts = counted_here(slices)
    units = units_of(slices, texts)
    return units, trained(texts, units, batch_size, rate), texts


def fit(docs: DataFrame, *, batch_size: int = 128, rate: float = 1.0) -> tuple[Units, Weights]:
    """Units and network from all of ``docs`` (doc_id, text)."""
    return _modelled(docs, batch_size, rate)[:2]


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: tuple[Units, Weights] | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob), one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        units, weights, texts = _modelled(docs, 128, 1.0)
    else:
        units, weights = model
        texts = counted_there(sliced(docs), units)
    shared = docs.sparkSession.sparkContext.broadcast((weights, units.coding))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, coding = shared.value
        for batch in batches:
            for ids, n, unit, share, rows in _unpacked(batch, coding):
                each = log_probabilities(weights, windows(unit, rows), unit) + share
                total = np.round(np.bincount(rows, weights=each, minlength=len(n)).astype(float), 6)  # of no words it is a whole number
                mean = pa.array(np.round(total / np.maximum(n, 1), 6), mask=n == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(total), mean], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, n_words long, log_prob double, mean_log_prob double")
