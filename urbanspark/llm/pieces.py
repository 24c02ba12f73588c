"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text is cut where no piece crosses: before each run of spaces. The distinct words of a
slice, grouped by length, advance together through the lattice of their substrings. For
each piece length the hashes of all substrings, at all places of all words at once, probe
the sorted piece keys; then place by place the vectorised maximum over the pieces that
end there is kept with its back-pointer.

What is maximised depends on the vocabulary's model type, read from the file:

* unigram: the sum of the pieces' log-probabilities; a character that is no piece costs
  ten more than the least likely piece.
* merges (BPE): scores are ranks, and their plain sums would give other ids. A transition
  has weight 0 where merging the characters of both pieces, in order of rank, leaves
  exactly these two, and minus infinity elsewhere. A sequence all of whose neighbours pass
  is the one that merging leaves, so one finite path reaches each place and the maximum
  finds it. The ids are those of the sentencepiece library for the same file.

Few words of one length are advanced one by one over the same candidates, so that an
unbroken text of a million characters costs seconds.

A character that is no piece is written as its byte pieces. As the vocabulary's
normaliser is the identity, decoding gives back every text exactly; the space mark U+2581
in a text is written as bytes, so that it isn't read back as a space. The vocabulary's
path is a parameter; a name without a folder is looked for among the files that
``SparkContext.addFile`` has sent to the executors.

Rows: one for each row of the documents. Null texts have null ids and decode to null;
empty texts have no ids. Repeated rows are encoded one by one, an empty table gives an
empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.llm import rowkeys
from urbanspark.llm import textbytes as tb

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, SPACE, NO_MARK = 0x2581, 32, 0x110000
#: Distinct words whose ids a worker keeps (some 60 bytes each); then it starts anew.
CACHED_WORDS = 200_000
UNIGRAM, MERGES = 1, 2
START, UNKNOWN = -1, -2
#: Code points of one lattice block; words of a length are advanced one by one if they are at most so many.
BLOCK, FEW = 1 << 18, 24
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_DIRECTORY_BITS = 18
SLICE_BYTES = 1 << 20
_PAIR_BITS = 20


def model_type(path: str) -> int:
    """trainer_spec.model_type of a model file (a protocol buffer message); 1 where it isn't set."""
    with open(path, "rb") as f:
        data = f.read()

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(field number, value or start, end) of a message in data[at:end]."""

        def varint(at: int) -> tuple[int, int]:
            value = shift = 0
            while True:
                b = data[at]
                value |= (b & 127) << shift
                at, shift = at + 1, shift + 7
                if b < 128:
                    return value, at

        while at < end:
            tag, at = varint(at)
            if tag & 7 == 0:
                value, at = varint(at)
                yield tag >> 3, value, at
            else:
                size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
                yield tag >> 3, at, at + size
                at += size

    for number, start, end in fields(0, len(data)):
        if number == 2:
            return next((value for k, value, _ in fields(start, end) if k == 3), UNIGRAM)
    return UNIGRAM


class Vocabulary:
    """Sorted piece keys, gains or merge ranks, byte pieces and the bytes of every id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.kind = model_type(path)
        if self.kind not in (UNIGRAM, MERGES):
            raise ValueError(f"model type {self.kind}: only unigram and merge vocabularies are known")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        if sum(model.is_byte(i) for i in range(n)) != 256:
            raise ValueError("the vocabulary has no byte pieces, so not every text can be read back")
        spelled = [b""] * n
        for i in plain:
            spelled[i] = pieces[i].replace("▁", " ").encode()
            if "▁" in pieces[i].lstrip("▁"):
                raise ValueError(f"piece {pieces[i]!r} crosses a word border")
        for b, i in enumerate(self.byte_ids.tolist()):
            spelled[i] = bytes([b])
        self.sizes = np.array([len(b) for b in spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        if self.kind == MERGES:
            # Ranks: single characters first, then merges from the first made to the last.
            plain.sort(key=lambda i: (len(pieces[i]) > 1, -model.get_score(i), i))
        self.ids = np.array(plain, np.int64)
        own = [pieces[i] for i in plain]
        self.gain = np.array([model.get_score(i) if self.kind == UNIGRAM else 0.0 for i in plain], np.float32)
        self.unknown_gain = np.float32(self.gain.min() - np.float32(10)) if self.kind == UNIGRAM else np.float32(0)
        reachable = self._merges(own) if self.kind == MERGES else list(range(len(own)))
        self.longest = max(len(own[r]) for r in reachable)
        self._index([(key_of(own[r]), r) for r in reachable])
        #: Code of a pair of ranks and whether the second may follow the first, by the code's hash.
        self.pairs = np.full(1 << _PAIR_BITS, -1, np.int64)
        self.forget()

    def forget(self) -> None:
        """Hash, first id and number of ids of each word met so far, sorted by hash; the ids of all."""
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.stored: np.ndarray = np.zeros(0, np.int32)

    def _merges(self, own: list[str]) -> list[int]:
        """Ranks that merging can make; each one's halves."""
        rank = {p: r for r, p in enumerate(own)}
        split, merged, out = [], {}, []
        for r, p in enumerate(own):
            halves = next((h for k in range(len(p) - 1, 0, -1) if (h := (rank.get(p[:k], r), rank.get(p[k:], r)))[0] < r and h[1] < r and _leaves(split, merged, *h)), None)
            split.append(halves or (r, r))
            if halves:
                merged[halves] = r
            if halves or len(p) == 1:
                out.append(r)
        self.halves, self.merged = split, merged
        self.split = np.array(split, np.int64).T.copy()
        codes = np.array([a * len(own) + b for a, b in merged], np.int64)
        order = np.argsort(codes)
        self.merge_codes, self.merge_ranks = np.append(codes[order], -1), np.append(np.array(list(merged.values()), np.int64)[order], -1)
        return out

    def _index(self, keyed: list[tuple[int, int]]) -> None:
        """Sorted keys, and where those with each run of leading bits begin."""
        keyed.sort()
        self.keys = np.array([k for k, _ in keyed] + [(1 << 64) - 1], np.uint64)
        self.ranks = np.array([r for _, r in keyed] + [START], np.int32)
        heads = (self.keys[:-1] >> np.uint64(64 - _DIRECTORY_BITS)).astype(np.int64)
        self.directory = np.searchsorted(heads, np.arange(1 << _DIRECTORY_BITS)).astype(np.int32)
        self.steps = int(np.bincount(heads).max())

    def probe(self, key: np.ndarray) -> np.ndarray:
        """The rank of the piece with each key, START where there is none."""
        at = self.directory[key >> np.uint64(64 - _DIRECTORY_BITS)]
        for _ in range(self.steps - 1):
            at = at + (self.keys[at] < key)
        return np.where(self.keys[at] == key, self.ranks[at], START)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both would leave exactly these two pieces, for each pair of ranks."""
        code = left * len(self.ids) + right
        slot = (code.view(np.uint64) * _BASE >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)
        held = self.pairs[slot]
        new = np.flatnonzero(held >> 1 != code)
        if len(new):
            held[new] = code[new] << 1 | self._leaves_each(left[new], right[new])
            self.pairs[slot[new]] = held[new]
        return (held & 1).astype(bool)

    def _leaves_each(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_leaves`` for arrays: all pairs are undone one merge at a time together."""
        out = np.ones(len(left), bool)
        at, limit = np.arange(len(left)), np.full(len(left), len(self.ids) + 1)
        while len(at):
            code = left * len(self.ids) + right
            found = np.searchsorted(self.merge_codes[:-1], code)
            crossed = (self.merge_codes[found] == code) & (self.merge_ranks[found] < limit)
            out[at[crossed]] = False
            in_left, in_right = self.split[0][left] != left, self.split[0][right] != right
            undo_left = in_left & ((left > right) | ~in_right)
            go = ~crossed & (in_left | in_right)
            limit = np.where(undo_left, left, right + 1)[go]
            at, left, right = at[go], np.where(undo_left, self.split[1][left], left)[go], np.where(undo_left, right, self.split[0][right])[go]
        return out


def _leaves(split: list[tuple[int, int]], merged: dict[tuple[int, int], int], left: int, right: int) -> bool:
    """Whether merging the characters of both would leave exactly these two pieces.

    Undoes the later of the two merges step by step; a merge across the border that
    would have come before the one undone forbids the pair.
    """
    limit = len(split) + 1
    while True:
        across = merged.get((left, right))
        if across is not None and across < limit:
            return False
        if split[left][0] != left and (left > right or split[right][0] == right):
            limit, left = left, split[left][1]
        elif split[right][0] != right:
            limit, right = right + 1, split[right][0]
        else:
            return True


def key_of(piece: str) -> int:
    """The 64-bit hash of a piece's code points, as ``substring_keys`` has it."""
    total = 0
    for c in piece:
        total = (total * int(_BASE) + (ord(c) + 1) * int(_ODD)) & ((1 << 64) - 1)
    return total


def substring_keys(points: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For lengths 1, 2, ...: the hashes of the substrings that end at each place (rows: words) from that length on."""
    value = (points.astype(np.uint64) + np.uint64(1)) * _ODD
    key = value
    for k in range(1, min(longest, points.shape[1]) + 1):
        if k > 1:
            key = key[:, :-1] * _BASE + value[:, k - 1 :]
        yield key


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path if os.path.dirname(path) else SparkFiles.get(path))


def lattice(vocabulary: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back-pointers of equal-length words (rows of code points): the last piece's length and rank at each place."""
    n, size = points.shape
    # found[k - 1][:, e - k]: the piece of length k that ends at place e.
    found = [vocabulary.probe(key) for key in substring_keys(points, vocabulary.longest)]
    length, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), START, np.int64)
    best = np.full((n, size + 1), -np.inf, np.float32)  # as the library adds them up, so that ties end alike
    best[:, 0] = 0
    (_advance_each if n <= FEW else _advance)(vocabulary, found, length, piece, best)
    return length, piece


def _advance(vocabulary: Vocabulary, found: list[np.ndarray], length: np.ndarray, piece: np.ndarray, best: np.ndarray) -> None:
    """All words move on together, place by place."""
    merges, met = vocabulary.kind == MERGES, [(f >= 0).any(axis=0).tolist() for f in found]
    for end in range(1, best.shape[1]):
        for k in range(min(end, len(found)), 0, -1):
            if not met[k - 1][end - k]:
                continue
            rank = found[k - 1][:, end - k]
            own = np.flatnonzero(rank >= 0)
            rank, before = rank[own].astype(np.int64), piece[own, end - k]
            score = best[own, end - k] + vocabulary.gain[rank]
            if merges:
                bound = np.flatnonzero(before >= 0)
                score[bound[~vocabulary.may_follow(before[bound], rank[bound])]] = -np.inf
            better = score > best[own, end]
            own = own[better]
            best[own, end], length[own, end], piece[own, end] = score[better], k, rank[better]
        # A character that is no piece is a step of its own.
        score = best[:, end - 1] + vocabulary.unknown_gain
        alone = (found[0][:, end - 1] < 0) & (score > best[:, end])
        best[alone, end], length[alone, end], piece[alone, end] = score[alone], 1, UNKNOWN


def _advance_each(vocabulary: Vocabulary, found: list[np.ndarray], length: np.ndarray, piece: np.ndarray, best: np.ndarray) -> None:
    """The same maximum for few, perhaps very long words, one after the other."""
    merges = vocabulary.kind == MERGES
    gain = [0] * len(vocabulary.gain) if merges else list(vocabulary.gain)
    zero, unknown = (0, 0) if merges else (np.float32(0), vocabulary.unknown_gain)
    known: dict[tuple[int, int], bool] = {}

    def may(left: int, right: int) -> bool:
        ok = known.get((left, right))
        if ok is None:
            if len(known) > CACHED_WORDS:
                known.clear()
            ok = known[left, right] = _leaves(vocabulary.halves, vocabulary.merged, left, right)
        return ok

    for w in range(len(best)):
        at: list[list[tuple[int, int]]] = [[] for _ in range(best.shape[1])]
        for k, f in enumerate(found, 1):
            for e in np.flatnonzero(f[w] >= 0).tolist():
                at[e + k].append((k, int(f[w, e])))
        value, back, last = [zero] + [-np.inf] * (len(at) - 1), [0] * len(at), [START] * len(at)
        for end in range(1, len(at)):
            top, by, of = -np.inf, 0, START
            for k, r in reversed(at[end]):  # long pieces first, so that ties end as they do above
                score = value[end - k] + gain[r]
                if score > top and (not merges or last[end - k] < 0 or may(last[end - k], r)):
                    top, by, of = score, k, r
            if not (at[end] and at[end][0][0] == 1):
                score = value[end - 1] + unknown
                if score > top:
                    top, by, of = score, 1, UNKNOWN
            value[end], back[end], last[end] = top, by, of
        best[w], length[w], piece[w] = value, back, last


def segment(vocabulary: Vocabulary, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each) of the words points[bounds[i]:bounds[i + 1]]."""
    sizes, n = np.diff(bounds), len(bounds) - 1
    marked = np.where(points == SPACE, MARK, np.where(points == MARK, NO_MARK, points)).astype(np.uint32)
    words, orders, ids = [], [], []
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        for part in np.array_split(own, len(own) * size // BLOCK + 1):
            block = marked[bounds[part][:, None] + np.arange(size)]
            length, piece = lattice(vocabulary, block)
            at, row, step = np.full(len(part), size), np.arange(len(part)), 0
            while len(row):
                last = piece[row, at]
                plain = last >= 0
                words.append(part[row[plain]])
                orders.append(np.full(plain.sum(), -step * 4))
                ids.append(vocabulary.ids[last[plain]])
                for r, e in zip(row[~plain].tolist(), at[~plain].tolist(), strict=True):
                    code = chr(int(points[bounds[part[r]] + e - 1])).encode()
                    words.append(np.full(len(code), part[r]))
                    orders.append(np.arange(len(code)) - step * 4 - len(code) + 1)
                    ids.append(vocabulary.byte_ids[np.frombuffer(code, np.uint8)].astype(np.int64))
                at = at - length[row, at]
                go = at > 0
                at, row, step = at[go], row[go], step + 1
    if not words:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    word, order, flat = (np.concatenate(x) for x in (words, orders, ids))
    return flat[np.lexsort((order, word))].astype(np.int32), np.bincount(word, minlength=n)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begins[i] .. begins[i] + sizes[i] - 1 for each i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with one more space before each text that isn't empty."""
    worded = np.diff(offsets) > 0
    shift = np.cumsum(worded)
    out = np.full(len(data) + int(worded.sum()), SPACE, np.uint8)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out[np.arange(len(data)) + shift[rows]] = data
    return out, offsets + np.concatenate([[0], shift])


def encode_slice(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each text's begin) of a slice of texts."""
    data, offsets = _spaced(data, offsets)
    space = data == SPACE
    first = space.copy()
    first[1:] &= ~space[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    hashes, where, inverse = np.unique(tb.hashes(data, starts, ends), return_index=True, return_inverse=True)
    known = vocabulary.known[0]
    at = np.searchsorted(known, hashes)
    new = np.flatnonzero(np.append(known, np.uint64(0))[at] != hashes) if len(known) else np.arange(len(hashes))
    if len(new):
        _learn(vocabulary, hashes[new], data, starts[where[new]], ends[where[new]])
        at = np.searchsorted(vocabulary.known[0], hashes)
    _, begins, counts = vocabulary.known
    each = at[inverse]
    flat = vocabulary.stored[ragged(begins[each], counts[each])]
    total = np.concatenate([[0], np.cumsum(counts[each])])
    bounds = total[np.searchsorted(starts, offsets)]
    if len(vocabulary.known[0]) > CACHED_WORDS:
        vocabulary.forget()
    return flat, bounds


def _learn(vocabulary: Vocabulary, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Segments new words and keeps their ids."""
    own = data[ragged(starts, ends - starts)]
    heads = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
    bounds = heads[np.concatenate([[0], np.cumsum(ends - starts)])]
    points = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    flat, counts = segment(vocabulary, points, bounds)
    begins = len(vocabulary.stored) + np.cumsum(counts) - counts
    vocabulary.stored = np.concatenate([vocabulary.stored, flat])
    joined = [np.concatenate([a, b]) for a, b in zip(vocabulary.known, (hashes, begins, counts), strict=True)]
    order = np.argsort(joined[0], kind="stable")
    vocabulary.known = tuple(x[order] for x in joined)


def decode_slice(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts of ids[bounds[i]:bounds[i + 1]]."""
    sizes = vocabulary.sizes[ids]
    data = vocabulary.spelled[ragged(vocabulary.begins[ids], sizes)].tobytes()
    at = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
    texts = (data[a:b] for a, b in zip(at, at[1:], strict=False))
    return [(t[1:] if t.startswith(b" ") else t).decode("utf-8", "replace") for t in texts]


class Codec:
    """Encoding and decoding of lists of texts with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.vocabulary = load(path)

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        out: list[list[int] | None] = []
        column = pa.array(texts, pa.string())
        for first, end, data, offsets in tb.text_slices(column, SLICE_BYTES):
            out += self.lists(column.slice(first, end - first), data, offsets)[0].to_pylist()
        return out

    def lists(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Ids of a slice of texts as a list column, and plain with their bounds."""
        ids, bounds = encode_slice(self.vocabulary, data, offsets)
        mask = texts.is_null() if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=mask), ids, bounds

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else decode_slice(self.vocabulary, np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for first, end, data, offsets in tb.text_slices(batch.column(1), SLICE_BYTES):
            yield batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), data, offsets


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for ids, texts, data, offsets in _texts(batches):
        yield pa.RecordBatch.from_arrays([ids, codec.lists(texts, data, offsets)[0]], ["doc_id", "ids"])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids), one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda batches: _encode(batches, vocabulary), f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.decode(x) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def round_trips(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, exact): the ids, and the text read back from them."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for own, texts, data, offsets in _texts(batches):
            lists, ids, bounds = codec.lists(texts, data, offsets)
            back = [None if t is None else b for t, b in zip(texts.to_pylist(), decode_slice(codec.vocabulary, ids, bounds), strict=True)]
            digest = [None if b is None else hashlib.sha256(b.encode()).hexdigest() for b in back]
            same = [a == b for a, b in zip(texts.to_pylist(), back, strict=True)]
            n = pa.array(np.diff(bounds), mask=np.array([b is None for b in back], bool))
            yield pa.RecordBatch.from_arrays([own, n, lists, pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded_sha256", "exact"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>, decoded_sha256 string, exact boolean")


@rowkeys.apart
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, exact) of every document that is left.

    One row for each row, whatever its id; null texts have null ids, empty ones none. An
    empty table stays empty. Other columns, whatever their names, are not read.
    """
    return round_trips(docs, vocabulary=vocabulary)
