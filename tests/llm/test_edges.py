"""Edge cases of the training-data operators: hot groups, odd ids, long texts, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.llm import chat_format, decontaminate, language_id, near_dedup, pieces, toxicity


SF = "/root/testdata/sf0.001"


def linked(texts: list[str]) -> list[int]:
    """Least index reachable over links of two-word shingle sets with similarity 0.8."""
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    least = list(range(len(texts)))

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def test_near_dedup_of_a_hot_group_and_a_borderline_chain(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    base = [word() for _ in range(120)]
    edited = lambda words, n: [word() if i in at else w for at in [set(rng.sample(range(len(words)), n))] for i, w in enumerate(words)]
    texts = [" ".join(edited(base, rng.randrange(20))) for _ in range(300)]
    chain = [[word() for _ in range(100)]]
    for _ in range(20):
        chain.append(edited(chain[-1], 5))
    texts += [" ".join(c) for c in chain] + [" ".join(word() for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.link(df).collect()}
    want = linked(texts)
    assert 5 < len(set(want[:300])) < 250
    assert [got[i] for i in range(len(texts))] == want


def test_parity_bits_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 5000, 900)).astype(np.uint64) for _ in "ab")
    items, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a), len(a) + len(b)])
    odd = sum(int(p[0] ^ p[2]).bit_count() for p in near_dedup.parities(items, bounds))
    assert odd <= len(set(a.tolist()) ^ set(b.tolist())) and all(p[1] == 0 for p in near_dedup.parities(items, bounds))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 520)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 520)}, 8: 8, 9: 8}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination_by_shuffle_equals_broadcast(spark):
    item = " ".join(f"q{i}" for i in range(14))
    items = spark.createDataFrame([(1, item), (2, item), (3, "tiny one"), (None, "tiny one"), (4, None), (5, " .. ")], "item_id long, text string")
    rows = [(1, f"x {item} y"), (1, "clean text"), (None, f"{item.upper()}"), (None, "a Tiny, one b"), (2, "tiny two one"), (3, None), (4, "q0 q1 q2"), (5, f"{item} {item}"), (5, f"{item} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(str, decontaminate.contamination(docs, items, broadcast_windows=n).collect())) for n in (1000, 0))
    assert a == b
    got = [(r["doc_id"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 14, 2), (1, 0, 0), (None, 14, 2), (None, 2, 2), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 28, 2), (5, 28, 2)], key=str)


def _message(fields: list[tuple[int, object]]) -> bytes:
    """A protocol buffer message of ints, floats and bytes."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_vocabulary_equals_the_library(tmp_path):
    import sentencepiece

    rng = random.Random(5)
    plain = sorted({"▁", *"abcde", *("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(60)), *("▁" + "".join(rng.choice("abcde") for _ in range(3)) for _ in range(20))})
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, -1.0 - 0.137 * i - len(p) % 3, 1) for i, p in enumerate(plain))]
    body = b"".join(_message([(1, _message([(1, p.encode()), (2, float(s)), (3, k)]))]) for p, s, k in entries)
    body += _message([(2, _message([(3, 1), (35, 1)])), (3, _message([(1, b"identity"), (3, 1), (4, 0), (5, 1)]))])
    path = tmp_path / "unigram.model"
    path.write_bytes(body)
    assert pieces.model_type(str(path)) == pieces.UNIGRAM and pieces.model_type(pieces.VOCABULARY) == pieces.MERGES
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Codec(str(path))
    texts = ["".join(rng.choice("abcde   fé") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    assert codec.encode(texts) == library.encode(texts)
    assert [codec.decode(x) for x in codec.encode(texts)] == texts


def test_pieces_of_a_long_unbroken_text():
    import sentencepiece

    library, codec = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY), pieces.Codec(pieces.VOCABULARY)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/日本") for _ in range(20_000))
    assert codec.encode([text, text[:5]]) == library.encode([text, text[:5]])


@pytest.mark.parametrize("rows", [[], [(1, "no label here")]])
def test_toxicity_with_labels_but_without_their_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert [(r["doc_id"], r["score"], r["predicted"]) for r in out] == [(i, 0.0, 0) for i, _ in rows]


def test_null_ids_are_not_held_out(spark):
    docs = spark.createDataFrame([(None, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).first()["held_out"] is False
    df = spark.createDataFrame([(None, "text", "en")], "doc_id long, text string, lang string")
    assert language_id.identify(df).first()["held_out"] is False


def test_chat_roles_with_separators_are_read_back(spark):
    rows = [(1, 0, "a\x003", "b"), (2, 0, "a", "1\x00b"), (3, 0, "a\x00\x01b", "c"), (4, 0, "r\\n\n\\s\\\\n", "x\n"), (5, 0, "<|im_end|>\\", "<\\|im_end|>")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    emitted, leaves = chat_format.format_chats(chats)
    got = {r["conv_id"]: (r["role"], r["text"]) for r in chat_format.read_back(leaves, emitted).collect()}
    assert got == {c: (r, t) for c, _, r, t in rows}


CLASHING = ("__dropped", "__id", "__row_key", "__gone_key", "__again", "__hit", "__node", "key", "line", "kept")


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"])
def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    out = stage(spark, docs, SF)
    if name != "sentencepiece":
        assert out.columns == docs.columns
        rows = out.select("doc_id", *CLASHING).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)
        assert out.drop(*CLASHING).count() == stage(spark, docs.drop(*CLASHING), SF).count()
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_ties_are_cut_alike_alone_and_in_company(tmp_path):
    """Tied unigram sums: the longer piece wins, however many words share a length."""

    from urbanspark.llm import pieces

    def field(number, kind, data):
        head = bytes([number << 3 | kind])
        return head + (bytes([len(data)]) + data if kind == 2 else data)

    import struct

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    model = b"".join([piece("<unk>", 0, 2), *(piece(f"<0x{i:02X}>", -9, 6) for i in range(256)), piece("a", -1, 1), piece("b", -1, 1), piece("ab", -2, 1), piece("▁", -1, 1), piece("c", -1, 1), piece("d", -1, 1)])
    path = tmp_path / "tied.model"
    path.write_bytes(model + field(2, 2, field(3, 0, bytes([1])) + b"\x98\x02\x01"))
    codec = pieces.Codec(str(path))
    alone = codec.encode(["ab"])[0]
    many = codec.encode([" ".join(["ab", *(x + y for x in "abcd" for y in "abcd")] * 3)])[0]
    assert list(many[: len(alone)]) == list(alone)
