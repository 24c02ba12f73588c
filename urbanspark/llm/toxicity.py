"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexicon, a trie over characters, turns a word into a symbol with a weight: an insult, a
threat, a target, a negation, a reporting verb, a future marker or nothing. Four
transducers over these symbols follow it, each a set of states and weighted arcs. The
negation transducer damps what follows within ``NEGATION_SCOPE`` words, the
reported-speech transducer damps the rest of its clause, the threat transducer lets a
threat pass only after a future marker or a target, and the target transducer raises a
clause that also names whom it is about. They are composed into one, compiled to arrays
over (state, symbol), and numpy runs all clauses of a slice through it abreast. A clause
runs to sentence punctuation or a line end. A path through it marks one insult or threat
and weighs what the lexicon, the arc and the final state give; a clause's score is the
sum over its paths, a document's a logistic function of its clauses' scores.

Insults are learned from labelled documents: words and word beginnings that mark toxic
documents, chosen greedily so that each toxic document of the sample has three of them.
The other word lists are fixed. Everything is learned from a bounded sample of the
labelled rows that may be learned from.

Rows: one for each row of the documents. Null and empty texts have no clause and get the
score of a text without matches. Documents with several labels count as toxic if any
says so, null labels are ignored; with no labels to learn from, every score is 0. An
empty table gives an empty result. Other columns are neither read nor returned; label
and id decide only which documents are learned from.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions.session import broadcast_if_small
from urbanspark.llm import textbytes as tb

#: Words as the scoring finds them.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Function words of the grammar in English, German, French and Spanish.
NEGATIONS = frozenset("not no never don't isn't wasn't aren't cannot nicht kein keine nie niemals pas jamais nunca".split())
REPORTS = frozenset("said says say called calls wrote quoted claimed reported sagte sagt schrieb dit disait dijo dice".split())
TARGETS = frozenset("you your you're he she they them him her this that du dich dein ihr sie tu te ton vous il elle usted ustedes ellos ese esa".split())
FUTURES = frozenset("will shall gonna going werde wirst wird vais vas va voy".split())
THREATS = frozenset("kill hurt destroy beat shoot burn stab murder töten vernichten schlagen tuer frapper détruire matar golpear destruir".split())

NEGATION_SCOPE = 3
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.5, 0.6, 1.25, 3.0
PREFIXES = (4, 5, 6, 7, 8)
CACHED_WORDS = 300_000
NOTHING, INSULT, THREAT, TARGET, NEGATION, REPORT, FUTURE = range(7)
SYMBOLS, MATCHED = 7, (INSULT, THREAT)
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;:"]] = True


def normal(word: str) -> str:
    word = word.lower()
    if not word.isalpha():
        word = word.strip("".join(c for c in set(word) if not c.isalnum()))
    return word


def features(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends with ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Transducer:
    """A deterministic transducer over symbols.

    ``arcs`` holds (next state, symbol put out, weight) by (state, symbol read), ``final`` the
    weight of ending in each state. State 0 is the start.
    """

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    final: list[float]

    @staticmethod
    def built(states: int, arc, final=lambda state: 1.0) -> Transducer:
        """From ``arc(state, symbol)`` and ``final(state)``."""
        return Transducer({(q, a): arc(q, a) for q in range(states) for a in range(SYMBOLS)}, [final(q) for q in range(states)])

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` makes of this one's output: reachable pairs of states, weights multiplied."""
        number, queue, arcs, final = {(0, 0): 0}, [(0, 0)], {}, []
        for p, q in queue:
            final.append(self.final[p] * other.final[q])
            for a in range(SYMBOLS):
                p2, b, w = self.arcs[p, a]
                q2, c, v = other.arcs[q, b]
                if (p2, q2) not in number:
                    number[p2, q2] = len(queue)
                    queue.append((p2, q2))
                arcs[number[p, q], a] = number[p2, q2], c, w * v
        return Transducer(arcs, final)

    def compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state and weight by (state, symbol), and final weights. An arc that puts out no match weighs 0."""
        following = np.zeros((len(self.final), SYMBOLS), np.int64)
        weight = np.zeros((len(self.final), SYMBOLS))
        for (q, a), (q2, b, w) in self.arcs.items():
            following[q, a] = q2
            weight[q, a] = w if b in MATCHED else 0.0
        return following, weight, np.array(self.final)


def negation() -> Transducer:
    """The state is the number of words still damped."""
    return Transducer.built(NEGATION_SCOPE + 1, lambda q, a: (NEGATION_SCOPE if a == NEGATION else max(0, q - 1), a, NEGATED if q else 1.0))


def reported_speech() -> Transducer:
    return Transducer.built(2, lambda q, a: (1 if a == REPORT else q, a, REPORTED if q else 1.0))


def threat() -> Transducer:
    """Passes threats only where a future marker or a target came before."""
    return Transducer.built(2, lambda q, a: (1 if a in (FUTURE, TARGET) else q, NOTHING if a == THREAT and not q else a, 1.0))


def target() -> Transducer:
    return Transducer.built(2, lambda q, a: (1 if a == TARGET else q, a, 1.0), lambda q: TARGETED if q else 1.0)


def pattern() -> Transducer:
    return negation().compose(reported_speech()).compose(threat()).compose(target())


def run_clauses(table: tuple[np.ndarray, np.ndarray, np.ndarray], symbol: np.ndarray, weight: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The scores of the clauses ``begins[i]:ends[i]`` of a symbol sequence, all advanced a word at a time."""
    following, factor, final = table
    order = np.argsort(begins - ends, kind="stable")
    at, length = begins[order], (ends - begins)[order]
    state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
    longest = int(length.max(initial=0))
    # Clauses come longest first, so those that still have a word t are the first going[t].
    going = np.searchsorted(-length, -np.arange(longest), "left")
    for t, n in enumerate(going.tolist()):
        read = symbol[at[:n] + t]
        total[:n] += weight[at[:n] + t] * factor[state[:n], read]
        state[:n] = following[state[:n], read]
    out = np.empty(len(at))
    out[order] = total * final[state]
    return out


class Lexicon:
    """Words to symbols: a trie whose states may put out a match for the whole word or for any longer one."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[int, float]] = {}
        self.beginning: dict[int, tuple[int, float]] = {}
        for symbol, words in ((TARGET, TARGETS), (FUTURE, FUTURES), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS)):
            for w in sorted(words):
                self.whole[self._state(w)] = symbol, THREAT_WEIGHT if symbol == THREAT else 0.0
        for f, weight in insults.items():
            if f.endswith("*"):
                self.beginning[self._state(f[:-1])] = INSULT, weight
            else:
                self.whole[self._state(f)] = INSULT, weight

    def _state(self, word: str) -> int:
        state = 0
        for c in word:
            if c not in self.arcs[state]:
                self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
            state = self.arcs[state][c]
        return state

    def read(self, word: str) -> tuple[int, float]:
        """A whole insult, else its shortest beginning that is one, else a function word, else nothing."""
        state, begun = 0, None
        for c in word:
            if begun is None:
                begun = self.beginning.get(state)
            state = self.arcs[state].get(c, -1)
            if state < 0:
                return begun or (NOTHING, 0.0)
        own = self.whole.get(state)
        if own and own[0] == INSULT:
            return own
        return begun or own or (NOTHING, 0.0)


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=dict)
    #: Weights of bias, log total, greatest clause, log matched clauses; none before fitting.
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.lexicon = Lexicon(self.insults)
        self.table = pattern().compiled()

    def lexical(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a normalised word."""
        return self.lexicon.read(word)

    def clauses(self, symbol: np.ndarray, weight: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return run_clauses(self.table, symbol, weight, begins, ends)

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        """The score of one clause."""
        symbol, weight = np.array([s for s, _ in symbols], np.int64), np.array([w for _, w in symbols], float)
        return float(self.clauses(symbol, weight, np.array([0]), np.array([len(symbols)]))[0])


def summary(clauses: list[float]) -> tuple[float, float, float, float]:
    hit = [c for c in clauses if c > 0]
    return 1.0, math.log1p(sum(hit)), max(hit, default=0.0) / 10, math.log1p(len(hit))


class Matcher:
    """Applies a grammar to slices of texts; remembers the symbols of words it has seen."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.known: dict[int, tuple[int, float]] = {}

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        keys, first, inverse = np.unique(tb.hashes(data, starts, ends), return_index=True, return_inverse=True)
        found = []
        for key, i in zip(keys.tolist(), first.tolist(), strict=True):
            got = self.known.get(key)
            if got is None:
                got = self.known[key] = self.grammar.lexical(normal(bytes(data[starts[i] : ends[i]]).decode("utf-8", "replace")))
            found.append(got)
        symbol = np.array([s for s, _ in found], np.int8)
        weight = np.array([w for _, w in found])
        return symbol[inverse], weight[inverse]

    def clauses(self, data: np.ndarray, offsets: np.ndarray) -> list[list[float]]:
        """The scores of each text's clauses that hold an insult or a threat."""
        n = len(offsets) - 1
        out: list[list[float]] = [[] for _ in range(n)]
        starts, ends, rows = tb.words(data, offsets)
        if not len(starts):
            return out
        symbol, weight = self.symbols(data, starts, ends)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        new = np.ones(len(starts), bool)
        new[1:] = (rows[1:] != rows[:-1]) | _CLAUSE_END[data[ends[:-1] - 1]] | (lines[starts[1:]] != lines[starts[:-1]])
        clause = np.cumsum(new) - 1
        begins = np.append(np.flatnonzero(new), len(starts))
        matched = np.unique(clause[np.isin(symbol, MATCHED)])
        scores = self.grammar.clauses(symbol, weight, begins[matched], begins[matched + 1])
        for row, s in zip(rows[begins[matched]].tolist(), scores.tolist(), strict=True):
            out[row].append(s)
        return out


def learnable(id_col: Column) -> Column:
    """Labels that may be learned from: crc32 of the id's text, mod 5, isn't 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"], strict=True):
            words = {normal(w) for w in set(_WORD.findall(text or ""))}
            counts[int(y)].update({f for w in words if w for f in features(w)})
    rows = [(f, n, counts[0][f]) for f, n in counts[1].items()]
    yield pd.DataFrame(rows, columns=["f", "n1", "n0"])
    rest = [(f, 0, n) for f, n in counts[0].items() if f not in counts[1]]
    yield pd.DataFrame(rest, columns=["f", "n1", "n0"])


def _cover(texts: list[list[list[str]]], candidates: dict[str, tuple[int, int]], demand: int = 3, penalty: float = 6.0) -> list[str]:
    """Features chosen greedily until ``demand`` words of each text have one, or none is left that pays.

    A text is a list of words, a word the list of its candidate features. A feature pays by
    the texts in need that it gives a new word, less ``penalty`` for each clean text.
    """
    having: dict[str, list[tuple[int, int]]] = {}
    for i, words in enumerate(texts):
        for j, fs in enumerate(words):
            for f in fs:
                having.setdefault(f, []).append((i, j))
    need = [demand] * len(texts)
    covered: set[tuple[int, int]] = set()

    def worth(f: str) -> float:
        return len({i for i, j in having[f] if need[i] > 0 and (i, j) not in covered}) - penalty * candidates[f][1]

    heap = [(-worth(f), len(f), f) for f in having]
    heapq.heapify(heap)
    least = max(2, len(texts) // 1000)
    chosen: list[str] = []
    while heap:
        # Gains only fall, so a renewed gain that is still the greatest is true.
        _, size, f = heapq.heappop(heap)
        now = worth(f)
        if now < least:
            continue
        if heap and (-now, size, f) > heap[0]:
            heapq.heappush(heap, (-now, size, f))
            continue
        chosen.append(f)
        for i, j in having[f]:
            if (i, j) not in covered:
                covered.add((i, j))
                need[i] -= 1
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a small ridge; classes weigh the same."""
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 3000, max_clean: int = 6000, max_candidates: int = 20_000) -> Grammar:
    """Learn from at most about ``max_toxic`` and ``max_clean`` labelled documents, drawn by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Grammar()
    share = F.when(F.col("toxic") == 1, min(1.0, max_toxic / n[1])).otherwise(min(1.0, max_clean / n[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    sample = docs.join(broadcast_if_small(drawn, 2 * (max_toxic + max_clean)), "doc_id").select("text", "toxic")
    counted = sample.mapInPandas(_count_features, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    t, c = min(n[1], max_toxic), min(n[0], max_clean)
    least = max(3, t // 500)
    odds = F.log((F.col("n1") + 0.5) / (t + 1)) - F.log((F.col("n0") + 0.5) / (c + 1))
    top = counted.where((F.col("n1") >= least) & (odds > 2.5)).withColumn("odds", odds).orderBy(F.desc("n1"), "f").limit(max_candidates)
    rows = top.collect()
    candidates = {r["f"]: (r["n1"], r["n0"]) for r in rows}
    weight = {r["f"]: min(6.0, r["odds"]) for r in rows}

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [{normal(w) for w in set(_WORD.findall(text or ""))} for text in batch["text"]]
            marked = [[[f for f in features(w) if f in candidates] for w in sorted(ws) if w] for ws in words]
            yield pd.DataFrame({"ws": [[fs for fs in ws if fs] for ws in marked]})

    found = [r["ws"] for r in sample.where("toxic = 1").mapInPandas(marks, "ws array<array<string>>").collect()]
    grammar = Grammar({f: weight[f] for f in _cover(found, candidates)})
    fitted = sample.mapInArrow(_summaries(grammar), "a double, b double, c double, d double, toxic int").collect()
    y = np.array([r["toxic"] for r in fitted], float)
    if len(set(y.tolist())) < 2:  # labels of documents that aren't there
        return Grammar()
    grammar.weights = _logistic(np.array([[r["a"], r["b"], r["c"], r["d"]] for r in fitted]), y)
    return grammar


def _summaries(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(0)):
                s = np.array([summary(c) for c in matcher.clauses(data, offsets)]).reshape(-1, 4)
                toxic = batch.column(1).slice(first, end - first).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([*(pa.array(s[:, k]) for k in range(4)), toxic], ["a", "b", "c", "d", "toxic"])

    return run


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, n_clauses) of each row of ``docs`` (doc_id, text)."""
    if grammar.weights is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_clauses"))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            for first, end, data, offsets in tb.text_slices(batch.column(1)):
                clauses = matcher.clauses(data, offsets)
                x = np.array([summary(c) for c in clauses]).reshape(-1, 4) @ shared.value.weights
                p = np.round(1 / (1 + np.exp(-np.clip(x, -30, 30))), 9)
                matched = pa.array([sum(v > 0 for v in c) for c in clauses], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(p), matched], ["doc_id", "score", "n_clauses"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, n_clauses long")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses), one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labels = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    found = score(docs, fit(docs, labels, **options))
    return found.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_clauses")
