"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read each word's bytes, with a space at both ends, from left
to right and from right to left; a softmax over both states labels every byte position
with a language. A document's probabilities are the mean over the positions of all its
words. The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents, and broadcast (its size depends on no table). Its context
ends at word borders, so equal words get equal labels: each distinct word of a slice is
run once and counted as often as it occurs, whatever the text's length.

Rows: one for each row of the documents. Texts that are null or have no letter get
``und`` and score 0; with no labelled document to learn from, every text does. Labels
are learned as they are; a language beyond the ``max_languages`` most frequent isn't
learned. An empty table gives an empty result. Other columns are neither read nor
returned; label and id decide only which documents are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.llm import rowkeys
from urbanspark.llm import textbytes as tb

#: Longer runs are cut into pieces of so many bytes; every byte is read.
PIECE = 32
CACHED_WORDS = 300_000


@dataclass
class Layer:
    """One direction: input table, gate and candidate weights."""

    table: np.ndarray  # 256 x 3H
    gates: np.ndarray  # H x 2H
    candidate: np.ndarray  # H x H


@dataclass
class Network:
    languages: list[str]
    forward: Layer
    backward: Layer
    out: np.ndarray  # 2H x C
    bias: np.ndarray  # C

    def arrays(self) -> list[np.ndarray]:
        return [*(getattr(d, k) for d in (self.forward, self.backward) for k in ("table", "gates", "candidate")), self.out, self.bias]


def new_network(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    def layer() -> Layer:
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Layer(draw(256, 3 * hidden, scale=0.3), draw(hidden, 2 * hidden, scale=hidden**-0.5), draw(hidden, hidden, scale=hidden**-0.5))

    out = (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32)
    return Network(languages, layer(), layer(), out, np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(layer: Layer, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step, T x B x H, for bytes x, B x T."""
    n, steps = x.shape
    size = layer.candidate.shape[0]
    h = np.zeros((n, size), np.float32)
    states = np.empty((steps, n, size), np.float32)
    for t in range(steps):
        a = layer.table[x[:, t]]
        g = _sigmoid(a[:, : 2 * size] + h @ layer.gates)
        z, r = g[:, :size], g[:, size:]
        rh = r * h
        c = np.tanh(a[:, 2 * size :] + rh @ layer.candidate)
        if keep is not None:
            keep.append((h, z, r, rh, c))
        h = h + z * (c - h)
        states[t] = h
    return states


def _back(layer: Layer, x: np.ndarray, kept: list, d_states: np.ndarray) -> Layer:
    """Gradients of a layer by backpropagation through time."""
    size = layer.candidate.shape[0]
    grad = Layer(np.zeros_like(layer.table), np.zeros_like(layer.gates), np.zeros_like(layer.candidate))
    dh = np.zeros_like(d_states[0])
    ones = np.eye(256, dtype=np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, rh, c = kept[t]
        dh = dh + d_states[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - h) * z * (1 - z)
        drh = dc @ layer.candidate.T
        dr = drh * h * r * (1 - r)
        dg = np.concatenate([dz, dr], axis=1)
        grad.candidate += rh.T @ dc
        grad.gates += h.T @ dg
        grad.table += ones[x[:, t]].T @ np.concatenate([dg, dc], axis=1)
        dh = dh * (1 - z) + drh * r + dg @ layer.gates.T
    return grad


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """T x B x C label probabilities of every position."""
    both = np.concatenate([_run(net.forward, x), _run(net.backward, x[:, ::-1])[::-1]], axis=2)
    score = both @ net.out + net.bias
    score = np.exp(score - score.max(axis=2, keepdims=True))
    return score / score.sum(axis=2, keepdims=True)


def loss_and_gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    steps = x.shape[1]
    kept_f: list = []
    kept_b: list = []
    flipped = x[:, ::-1]
    both = np.concatenate([_run(net.forward, x, kept_f), _run(net.backward, flipped, kept_b)[::-1]], axis=2)
    score = both @ net.out + net.bias
    p = np.exp(score - score.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    loss = -np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-12)).mean()
    p[:, np.arange(len(y)), y] -= 1
    p /= len(y) * steps
    d_out = np.tensordot(both, p, axes=((0, 1), (0, 1)))
    d_both = p @ net.out.T
    size = net.forward.candidate.shape[0]
    f = _back(net.forward, x, kept_f, d_both[:, :, :size])
    b = _back(net.backward, flipped, kept_b, d_both[::-1, :, size:])
    return float(loss), [f.table, f.gates, f.candidate, b.table, b.gates, b.candidate, d_out.astype(np.float32), p.sum(axis=(0, 1))]


def padded(pieces: list[bytes]) -> np.ndarray:
    """Equal-length byte strings as rows, a space at both ends."""
    body = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
    edge = np.full((len(pieces), 1), 32, np.uint8)
    return np.concatenate([edge, body, edge], axis=1)


def train(examples: list[tuple[bytes, int]], languages: list[str], *, hidden: int = 16, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over minibatches of equal-length words."""
    rng = np.random.default_rng(seed)
    net = new_network(languages, hidden, rng)
    groups: dict[int, list[tuple[bytes, int]]] = {}
    for word, y in sorted(examples):
        groups.setdefault(len(word), []).append((word, y))
    sets = [(padded([w for w, _ in g]), np.array([y for _, y in g])) for _, g in sorted(groups.items())]
    params = net.arrays()
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        jobs = []
        for k, (_, y) in enumerate(sets):
            order = rng.permutation(len(y))
            jobs += [(k, order[i : i + batch]) for i in range(0, len(order), batch)]
        pace = rate * (1 - epoch / epochs)
        for j in rng.permutation(len(jobs)):
            k, rows = jobs[j]
            _, grads = loss_and_gradients(net, sets[k][0][rows], sets[k][1][rows])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Runs a network over the distinct words of each slice; keeps what it has read."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.known: dict[int, int] = {}
        self.sums = np.zeros((1024, len(net.languages)))

    def word_sums(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each distinct word, the sum of its positions' probabilities."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        missing = [i for i, k in enumerate(keys.tolist()) if k not in known]
        if missing:
            base = len(known)
            while base + len(missing) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            at = np.array(missing)
            length = ends[at] - starts[at]
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                for part in np.array_split(rows, len(rows) // 4096 + 1):
                    grid = data[starts[at[part]][:, None] + np.arange(size)]
                    edge = np.full((len(part), 1), 32, np.uint8)
                    p = position_probabilities(self.net, np.concatenate([edge, grid, edge], axis=1))
                    self.sums[base + part] = p[1:-1].sum(axis=0)
            known.update((int(keys[i]), base + j) for j, i in enumerate(missing))
        return self.sums[[known[k] for k in keys.tolist()]]

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row x language mean probability, has a letter) of each text of a slice."""
        starts, ends, rows = pieces(data, offsets)
        n = len(offsets) - 1
        total = np.zeros((n, len(self.net.languages)))
        if len(starts):
            keys, first, inverse = np.unique(tb.hashes(data, starts, ends), return_index=True, return_inverse=True)
            sums = self.word_sums(data, starts[first], ends[first], keys)
            bounds = tb.row_starts(rows, n)
            total = tb.row_sums(sums[inverse], bounds)
            positions = tb.row_sums((ends - starts).astype(float), bounds)
            total /= np.maximum(positions, 1)[:, None]
        return total, letters(data, offsets)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, long ones cut into pieces of ``PIECE`` bytes."""
    starts, ends, rows = tb.words(data, offsets)
    count = -(-(ends - starts) // PIECE)
    if (count > 1).any():
        owner = np.repeat(np.arange(len(starts)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts, ends, rows = starts[owner] + k * PIECE, np.minimum(ends[owner], starts[owner] + (k + 1) * PIECE), rows[owner]
    return starts, ends, rows


_LATIN = np.zeros(256, bool)
_LATIN[65:91] = _LATIN[97:123] = True


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LATIN[data])])
    has = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return has


def learnable(id_col: Column) -> Column:
    """Documents that may be learned from: crc32 of the id's text, mod 3, isn't 1."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def _sampled_words(per_doc: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(0)):
                starts, ends, rows = pieces(data, offsets)
                bounds = tb.row_starts(rows, end - first)
                take = [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b, max(1, -(-(b - a) // per_doc)))]
                lang = batch.column(1).slice(first, end - first).take(pa.array(rows[take]))
                yield pa.RecordBatch.from_arrays([lang, pa.array([bytes(data[starts[i] : ends[i]]) for i in take], pa.binary())], ["lang", "word"])

    return words


def fit(docs: DataFrame, *, docs_per_language: int = 200, words_per_doc: int = 40, max_languages: int = 64, **training) -> Network | None:
    """Train on at most about ``docs_per_language`` learnable documents of each language.

    The sample is drawn by a hash of the id, ``words_per_doc`` evenly spaced words from
    each document; only these words reach the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & learnable(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, docs_per_language / r["count"])).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    index = {k: i for i, k in enumerate(languages)}
    words = drawn.select("text", "lang").mapInArrow(_sampled_words(words_per_doc), "lang string, word binary")
    return train([(bytes(r["word"]), index[r["lang"]]) for r in words.collect()], languages, **training)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text)."""
    if net is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        names = np.array(shared.value.languages, dtype=object)
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(1)):
                p, has = reader.read(data, offsets)
                best = p.argmax(axis=1)
                score = np.where(has, np.round(p[np.arange(len(p)), best], 6), 0.0)
                label = pa.array(np.where(has, names[best], "und").tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), label, pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs``."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = predict(named, fit(named, **options))
    return found.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@rowkeys.apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Documents in no learned language go: ``und``, or pooled probability below ``min_score``.

    A null text and one without letters are ``und`` and stay out too. Rows are judged by (doc_id, text):
    repeated rows go or stay together, a null id is an id. An empty table gives an empty one; columns of
    any name are kept as they are.
    """
    rows = rowkeys.keyed(docs)
    net = fit(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    rejected = predict(rowkeys.named(rows), net).where((F.col("lang_pred") == "und") | (F.col("score") < min_score))
    return rowkeys.without(rows, rejected).select(*docs.columns)
