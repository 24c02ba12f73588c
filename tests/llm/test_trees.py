"""Merkle manifest, conversation trie and mixing, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.llm import conv_trie, merkle, mixing, ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def frame(spark, rows, schema, parts=3):
    df = spark.createDataFrame(rows, schema)
    clashing = {c: F.lit("x") for c in ("tree", "run", "i", "digest", "shown", "r", "s", "b", "rank", "k", "node", "id", "part", "size", "start")}
    return df.withColumns(clashing).repartition(parts)


# 11


def merkle_by_hand(rows):
    def leaf(d, text):
        out = ""
        for v in (d[0], d[3], d[2], d[4], text):
            out += "-" if v is None else f"{len(str(v).encode())}:{v}"
        return sha(out)

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][a : a + 8])) for a in range(0, len(levels[-1]), 8)])
        return levels

    def walk(levels, place, node):
        proof = ""
        for level in levels[:-1]:
            first = place // 8 * 8
            run = level[first : first + 8]
            proof += "".join(run[: place - first] + run[place - first + 1 :])
            node = sha("".join([*run[: place - first], node, *run[place - first + 1 :]]))
            place //= 8
        return proof, node

    low = lambda v, null: (v is not None, v if v is not None else null)
    langs = sorted({r[2] for r in rows}, key=lambda v: low(None if v is None else v.encode(), b""))
    trees = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (low(r[0], 0), leaf(r, r[1]))) for g in langs}
    built = {g: up([leaf(r, r[1]) for r in trees[g]]) for g in langs}
    top = up([built[g][-1][0] for g in langs])
    root = top[-1][0]
    out = []
    for at, g in enumerate(langs):
        for place, r in enumerate(trees[g]):
            lower = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if lower else r[1]
            proof, node = walk(built[g], place, leaf(r, shown))
            more, node = walk(top, at, node)
            out.append((r[0], leaf(r, r[1]), built[g][-1][0], root, sha(proof + more), node, node == root))
    return out


def merkle_rows(n, langs, seed=0):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["Some Text", "plain", "ÄÖ é Ü", ""]) + str(i), rnd.choice(langs), rnd.choice(["web", None]), i % 7) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        merkle_rows(1, ["en"]),
        merkle_rows(8, ["en"]),
        merkle_rows(9, ["en", None]),
        merkle_rows(40, [f"l{i}" for i in range(20)] + ["é", "Z"]),
        merkle_rows(1300, ["en"] * 8 + ["de", None]),
        [(None, "A", "en", None, None), (None, "A", "en", None, None), (3, None, "en", "s", 1), (3, None, "en", "s", 1), (7, "", None, "", 0), (2, "X" * 300_000, "fr", "s", 300_000), (-5, "Minus", "fr", "s", 2)],
    ],
    ids=["one", "full_run", "two_trees", "many_trees", "rounds", "odd"],
)
def test_merkle_equals_brute_force(spark, rows):
    got = merkle.audit(frame(spark, rows, DOCS), merkle.tampered_text()).collect()
    assert Counter(map(tuple, got)) == Counter(merkle_by_hand(rows))
    assert {r["verified"] for r in got if r["folded_root"] != r["root"]} <= {False}


def test_merkle_empty_table_and_plain_audit(spark):
    assert merkle.audit(frame(spark, [], DOCS), merkle.tampered_text()).collect() == []
    got = merkle.audit(frame(spark, merkle_rows(70, ["en", "de"]), DOCS)).collect()
    assert len(got) == 70 and all(r["verified"] for r in got)


def test_merkle_paths_pack_and_parents_resume():
    runs = [b"a" * 64 * k for k in (1, 8, 3)]
    path = [(0, runs[0]), (7, runs[1]), (1, runs[2])]
    assert merkle.unpack(merkle.pack(path)) == path
    children = [sha(str(i)).encode() for i in range(5)]
    parent = merkle.Parent(b"".join(children))
    for slot in range(5):
        other = sha("new").encode()
        assert parent.fold(slot, other).decode() == sha(b"".join([*children[:slot], other, *children[slot + 1 :]]))
        assert parent.fold(slot, children[slot]) == parent.digest()


# 12

CONVS = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows):
    low = lambda v: (v is not None, v if v is not None else 0)
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((low(t), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        if c is None:
            built[c] = tuple(ts)
            continue
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(donor, [])[:h] + ts[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                kids[ts[: d - 1]].add(ts[:d])
    members.setdefault((), [])
    least = lambda m: min((c for c in m if c is not None), default=None)
    out = []

    def sums(n):
        words = len(WORD.findall(n[-1][1])) if n else 0
        leaves, saved = (0 if kids[n] else 1), max(len(members[n]) - 1, 0) * words
        for k in kids[n]:
            a, b = sums(k)
            leaves, saved = leaves + a, saved + b
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c, ts in built.items() if ts == n), key=low))
        out.append((least(members[n]), len(n), least(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves, saved, sha(ends)))
        return leaves, saved

    sums(())
    return out


def conv_rows(n, turns, vocabulary, seed=0, deep=0):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant"]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 2)))) for c in range(n) for t in range(rnd.randint(1, turns))]
    rows += [(5000, t, "user", f"deep {t // 2}") for t in range(deep)] + [(5001, t, "user", f"deep {t // 2}") for t in range(deep // 2)]
    return rows


ODD_CONVS = [
    (None, 0, "user", "hello"), (None, None, "user", None), (41, 0, None, None), (41, 0, None, None), (41, 1, "user", "x"),
    (-7, 0, "user", "minus"), (-7, 1, "user", "one two"), (0, 0, "user", "hello"), (0, 1, "assistant", "w " * 50_000),
    (19, 2, "user", "b"), (19, 2, "user", "a"), (19, None, "system", "first"), (39, 0, "user", "nothing before"),
]


@pytest.mark.parametrize(
    ("rows", "bits", "limit"),
    [
        (conv_rows(150, 6, ["a", "b"]), 16, 1 << 15),
        (conv_rows(150, 6, ["a", "b"]), 3, 2),
        (conv_rows(120, 9, ["a"], seed=1), 2, 1),
        (conv_rows(60, 4, ["a", "b", "c", "d", "e"], seed=2, deep=150), 3, 4),
        (ODD_CONVS, 2, 1),
        ([(c, 0, "user", "same") for c in range(300)], 4, 3),
    ],
    ids=["one_shard", "shards", "dense", "deep", "odd", "copies"],
)
def test_trie_equals_brute_force(spark, rows, bits, limit):
    got = conv_trie.trie(frame(spark, rows, CONVS), bits, limit).collect()
    assert Counter(map(tuple, got)) == Counter(trie_by_hand(rows))


def test_trie_of_no_conversations(spark):
    got = conv_trie.trie(frame(spark, [], CONVS)).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, 0, 0, 1, 0, sha(""))]


def test_chain_goes_on_across_partitions(spark):
    rows = [(c, k, hash((c, k)) % 5, k % 3, 1) for c, n in ((1, 40), (2, 1), (3, 25)) for k in range(n)]
    df = ranks.ordered(frame(spark, rows, "conv_id long, k0 long, h1 long, h2 long, tokens long").repartition(9), "conv_id", "k0")
    got = conv_trie.chained(df).collect()
    key, expected = {}, {}
    for c, k, h1, h2, _ in rows:
        key[c] = (key.get(c, 0) * conv_trie.BASE + conv_trie._element(h1, h2)) % conv_trie.PRIME
        expected[c, k + 1] = key[c].to_bytes(16)
    assert {(r["conv_id"], r["k"]): bytes(r["node"]) for r in got} == expected
    assert sorted((r["conv_id"], r["k"]) for r in got if r["ends"]) == [(1, 40), (2, 1), (3, 25)]


def test_spilling_queue_equals_a_sorted_list():
    rnd = random.Random(3)
    messages = [(-rnd.randint(0, 5), -rnd.randint(0, 20), rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(12_000)]
    queue = conv_trie.SpillingQueue(100)
    for m in messages:
        queue.push(m)
    assert queue.spilled > 100 and len(queue.heap) <= 100
    expected = Counter(), Counter()
    for t, i, a, b in messages:
        expected[0][t, i] += a
        expected[1][t, i] += b
    for key in sorted({m[:2] for m in messages}):
        assert queue.pop_to(*key) == (expected[0][key], expected[1][key])
    assert not queue.heap and not queue.runs


# 13


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        rest = budget - sum(held.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return held | {s: level * weight[s] for s in free}
        held |= {s: most * sizes[s] for s in over}


def mixing_rows(seed=0, n=300):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), "en", rnd.choice(["a", "b", "b", "b", "ü", "Z", None]), 1) for i in range(n)]


ODD_MIX = [(None, "a b", "en", None, 1), (None, "a b", "en", None, 1), (1, None, "en", "x", 1), (1, "", "en", "x", 1), (2, "w " * 30_000, "en", "y", 1), (3, "   ", "en", "", 1), (4, None, "en", "empty source", 0)]


@pytest.mark.parametrize(("rows", "block", "per_shard"), [(mixing_rows(), 16, 8), (mixing_rows(1), 1024, 8192), (ODD_MIX, 64, 5), (mixing_rows(2, 40), 1, 3)], ids=["shards", "default", "odd", "single_words"])
def test_mix_takes_its_targets_to_the_word(spark, rows, block, per_shard):
    got = mixing.taken(frame(spark, rows, DOCS), block=block, per_shard=per_shard).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    expected = targets_by_hand(sizes)
    source = {r[0]: r[3] for r in rows}
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is not None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    used = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        used[s] += r["taken"]
    for s, target in expected.items():
        assert abs(used[s] - target) <= 0.5
    again = mixing.taken(frame(spark, rows, DOCS, parts=7).repartition(5, "n_chars"), block=block, per_shard=per_shard).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_of_nothing(spark):
    assert mixing.taken(frame(spark, [], DOCS)).collect() == []
    got = mixing.taken(frame(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_shards_get_disjoint_blocks_and_exact_places(spark):
    _, sources, mixed = mixing.mix(frame(spark, mixing_rows(), DOCS), block=16, per_shard=8)
    rows = mixed.collect()
    spent = Counter((r["pass"], r["r"], r["b"], r["first"]) for r in rows)
    assert set(spent.values()) == {1}  # no piece is taken twice in a pass
    blocks = {(r["shard"], r["position"]): (r["s"], r["b"], r["pass"]) for r in rows}
    assert len(set(blocks.values())) == len(blocks)
    fill = Counter(shard for shard, _ in blocks)
    assert max(fill.values()) <= 8 and max(fill.values()) - min(fill.values()) <= 1
    for shard, n in fill.items():
        assert sorted(p for s, p in blocks if s == shard) == list(range(n))


def test_split_keeps_quotas_and_is_hypergeometric(spark):
    quotas = [700, 250, 0, 50]
    row = spark.createDataFrame([(quotas,)], "quotas array<long>")
    for shards in (1, 7, 40):
        got = mixing.split(row, shards).collect()
        assert sorted(r["shard"] for r in got) == list(range(shards))
        assert reduce(np.add, (np.array(r["quotas"]) for r in got)).tolist() == quotas
        begins = np.zeros(4, int)
        for r in sorted(got, key=lambda r: r["shard"]):
            assert r["begins"] == begins.tolist()
            begins += r["quotas"]
        assert {sum(r["quotas"]) for r in got} <= {1000 // shards, 1000 // shards + 1}
    # moments of many draws of 100 against a multivariate-hypergeometric distribution
    draws = spark.range(400).withColumn("quotas", F.array(*(F.lit(q).cast("long") for q in quotas)))
    many = [r[0] for r in draws.select(mixing.left_quotas(F.col("quotas"), F.lit(100).cast("long"), F.lit(7), F.col("id"))).collect()]
    assert {sum(m) for m in many} == {100}
    mean, deviation = np.mean(many, axis=0), np.std(many, axis=0)
    p = np.array(quotas) / 1000
    expected = np.sqrt(100 * p * (1 - p) * 900 / 999)
    assert (np.abs(mean - 100 * p) <= 4 * expected / np.sqrt(400)).all() and (np.abs(deviation - expected) <= 0.2 * expected + 1e-9).all()


def test_hypergeometric_is_the_inverse_of_the_distribution(spark):
    from math import comb

    cases = [(g, n, d, u) for g, n, d in ((3, 10, 4), (0, 5, 2), (5, 5, 2), (40, 100, 50), (1, 1000, 999), (7, 9, 0)) for u in (0.0, 0.1, 0.5, 0.77, 0.999999)]
    df = spark.createDataFrame(cases, "g long, n long, d long, u double")
    for r in df.withColumn("x", mixing.hypergeometric(*(F.col(c) for c in "gndu"))).collect():
        total, x = 0.0, max(0, r["d"] - (r["n"] - r["g"]))
        while (total := total + comb(r["g"], x) * comb(r["n"] - r["g"], r["d"] - x) / comb(r["n"], r["d"])) < r["u"] - 1e-12:
            x += 1
        assert r["x"] == x
    big = df.sparkSession.range(1).select(mixing.hypergeometric(*(F.lit(v).cast("long") for v in (3_000_000, 9_000_000, 4_500_000)), F.lit(0.5)).alias("x")).first()["x"]
    assert abs(big - 1_500_000) < 1000


def test_mixing_plan_has_no_python(spark):
    plan = mixing.taken(frame(spark, mixing_rows(n=20), DOCS))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas", plan)
