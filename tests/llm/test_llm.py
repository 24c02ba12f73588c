"""Small cases of every training-data operator, most of them against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urbanspark.llm import chat_format, decontaminate, language_id, line_dedup, lm_score, near_dedup, pieces, quality, queries, textbytes, toxicity, url_filter

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(6000))
ODD = [
    (1, "The quick brown fox, jumps over 12 lazy dogs.\nSecond line"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "one"),
    (6, "Ünïcode ÀÉ 日本語 \U0001f600 ▁ </s> [INST]  two  spaces "),
    (7, LONG),
    (8, "x" * 5000),
    (9, "one"),
    (9, "one"),
    (None, "null id text here"),
]
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"node": F.lit("x"), "n": F.lit(1), "keys": F.lit("k"), "line": F.lit(0), "ids": F.lit("i"), "score": F.lit(2.0), "kept": F.lit("no")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# Words and hashes


def test_words_never_cross_texts():
    column = pa.array(["ab cd", None, "", "ab\ncd", "ab"])
    for part in (column, column.slice(1), pa.chunked_array([column])):
        for first, end, data, offsets in textbytes.text_slices(part, 4):
            starts, ends, rows = textbytes.words(data, offsets)
            texts = [t or "" for t in part.to_pylist()[first:end]]
            assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == [w for t in texts for w in t.split()]
            assert rows.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
            same = {}
            for a, b, h in zip(starts, ends, textbytes.hashes(data, starts, ends), strict=True):
                assert same.setdefault(bytes(data[a:b]), h) == h
            assert len(set(same.values())) == len(same)


# 1


def test_pieces_equal_the_library_and_round_trip(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    codec = pieces.Codec(pieces.VOCABULARY)
    texts = [r["text"] for r in docs.limit(80).collect()] + ["  a  b ", "\n\n x", "aaaaaaaaaaaaaaa", " " * 40 + "z", "日本語 \U0001f600", "a" * 600]
    assert codec.encode(texts) == library.encode(texts)
    odd = [t for _, t in ODD]
    assert [codec.decode(x) for x in codec.encode(odd)] == odd


def test_pieces_query(spark, odd, docs):
    out = pieces.round_trips(odd).collect()
    assert len(out) == len(ODD) and all(r["exact"] for r in out)
    assert all((r["ids"] is None) == (r["n_tokens"] is None) for r in out)
    encoded = pieces.encode(docs)
    back = pieces.decode(encoded).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.where(~F.col("text").eqNullSafe(F.col("t"))).count() == 0
    assert pieces.round_trips(odd.where("false")).count() == 0


# 2


def test_line_dedup_generalises_fields(spark):
    template = "The order of customer {} was sent on day {} to the store in town"
    rows = [(i, f"Own words number only of text {chr(97 + i) * 5} here.\n{template.format('abcdefg'[i] * 4, i)}\nshort") for i in range(5)]
    df = spark.createDataFrame([*rows, (None, None), (77, "")], "doc_id long, text string").withColumn("line", F.lit("clash"))
    out = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    # The short line stands in five documents, so it recurs as well.
    assert [out[i]["dropped_lines"] for i in range(5)] == [[], [0, 1, 2], [0, 1, 2], [0, 1, 2], [0, 1, 2]]
    assert out[0]["text"] == rows[0][1] and out[3]["text"] == "" and out[None]["text"] is None and out[77]["text"] == ""


def test_line_dedup_odd_rows(spark, odd):
    out = line_dedup.dedup(odd).collect()
    assert len(out) == len(ODD) and all(r["n_dropped"] == 0 for r in out)
    assert line_dedup.dedup(odd.where("false")).count() == 0
    assert sorted(line_dedup.stage(spark, odd, SF).columns) == sorted(odd.columns)


def test_line_dedup_stage_drops_lines_of_two_documents(spark):
    twice = " ".join(f"passage{i}" for i in range(60))
    own = "Own line of text {} stays where it is"
    rows = [(i, f"{own.format('abcd'[i] * 3)}\n" + (twice if i in (1, 3) else f"Text {'abcd'[i]} has no passage at all") + ("\nAll rights reserved." if i < 3 else "\nTwo only") + ("\nTwo only" if i == 2 else "")) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, df, SF).collect()}
    assert [twice in out[i] for i in range(4)] == [False, True, False, False]
    assert ["All rights" in out[i] for i in range(3)] == [True, False, False] and "Two only" in out[2] and "Two only" in out[3]
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()} == out


def test_line_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    names = ["doc_id", "n_lines", "n_dropped", "dropped_lines", "text_sha256"]
    got = queries.op2_line_dedup(spark, SF).select(names).collect()
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op2_line_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n_dropped"] for r in got) > 0


def test_exact_lines_count_unnamed_documents_once(spark):
    line = "one line of six tokens stays"
    rows = [(None, f"{line}\nb"), (None, f"{line}\nb"), (4, f"a\n{line}\nb"), (7, f"{line}\nshort b")]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    key = lambda r: (r[0] is not None, r)
    out = [tuple(r) for r in line_dedup.exact_lines(frame(rows)).collect()]
    assert sorted(out, key=key) == [(None, 0), (7, 0)]
    assert line_dedup.exact_lines(frame(rows[:2])).count() == 0


def test_line_dedup_stage_tests_constants_in_every_leaf(spark):
    numbers = ["12 7 3 9 4", "5 5 8 1 2", "1 2 3 4 5", "6 6 6 7 8"]
    call = "Call 555-1234 or 555-5678 today please"
    rows = [(i, f"{numbers[i]}\n{call}\nCall 1 or 2 on {'abcd'[i]}") for i in range(4)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert [numbers[i] in out[i] for i in range(4)] == [True] * 4
    assert [call in out[i] for i in range(4)] == [True, False, False, False]


# 3


def brute_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(AZ))
        n = min(10, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark, odd):
    items = [(1, "quick brown fox"), (2, None), (3, ""), (10, " ".join(f"w{i % 97}x{i % 13}" for i in range(50, 75))), (10, "one"), (4, "ÀÉ 日本語"), (5, "absent words only")]
    got = decontaminate.contamination(odd, spark.createDataFrame(items, "item_id long, text string"))
    want = sorted(repr((i, *brute_contamination(t, items))) for i, t in ODD)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    empty = decontaminate.contamination(odd, spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("contaminated").count() == 0 and empty.count() == len(ODD)


def test_contamination_runs_no_python(docs, spark):
    plan = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# 4


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size=2):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, len(s), least.get(find(k), i), i == least.get(find(k), i))) for k, (i, s) in enumerate(sets))


def test_near_dedup_equals_brute_force(spark, odd, docs):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in rng.integers(0, 50, 120)]
    chain = []
    for i in range(60):
        chain.append((100 + i, " ".join(base)))
        base[int(rng.integers(0, 120))] = f"new{i}"
    rows = ODD + chain + [(r["doc_id"] + 1000, r["text"]) for r in docs.limit(100).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(repr(tuple(r)) for r in near_dedup.link(df).collect())
    assert got == brute_components(rows)
    assert near_dedup.link(odd.where("false")).count() == 0


# 5


def test_quality_base_features(spark, odd, labels):
    out = quality.assess(odd, labels).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], r)
    for i, text in ODD:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        inside = {k + j for k, g in enumerate(windows) if often[g] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if x.split()]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
        r = by[i]
        assert tuple(r[k] for k in quality.NAMES) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_separates_labels(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.assess(docs, labels).join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_threshold_is_the_middle_of_the_gap():
    assert quality.best_threshold({-10: (5, 0), 10: (0, 5)}) == pytest.approx(0.0 + quality.BIN / 2, abs=quality.BIN)
    assert quality.best_threshold({}) == float("-inf")


# 6


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language_id.new_network(["a", "b", "c"], 5, rng)
    x, y = rng.integers(0, 256, (4, 6)), np.array([0, 1, 2, 1])
    _, grads = language_id.loss_and_gradients(net, x, y)
    for p, g in zip(net.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 0.01
        up, _ = language_id.loss_and_gradients(net, x, y)
        p[at] = old - 0.01
        down, _ = language_id.loss_and_gradients(net, x, y)
        p[at] = old
        assert (up - down) / 0.02 == pytest.approx(float(g[at]), rel=0.02, abs=1e-4)


def test_language_id(spark, odd, docs):
    out = language_id.identify(docs, docs_per_language=60).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok")).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert held > 0.9
    net = language_id.train([(b"the", 0), (b"der", 1), (b"and", 0), (b"und", 1)], ["en", "de"], hidden=4, epochs=1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd.select("doc_id", "text"), net).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[6][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language_id.identify(odd.where("lang = 'none'").union(odd.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


# 7


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"fool": 4.0, "dolt*": 4.0})
    run = lambda s: g.clause([g.lexical(toxicity.normal(w)) for w in s.split()])
    assert run("a fool") == 4.0 and run("the doltish one") == 4.0 and run("nothing here") == 0.0
    assert run("you fool") > run("a fool") > run("not a fool") and run("someone said a fool") < run("a fool")
    assert run("will kill") > 0 == run("kill time")


def plain_clause(symbols):
    """The grammar's rules, one word after the other."""
    negated, reported, targeted, armed, total = 0, False, False, False, 0.0
    for symbol, weight in symbols:
        damp = (toxicity.NEGATED if negated else 1.0) * (toxicity.REPORTED if reported else 1.0)
        if symbol == toxicity.INSULT or (symbol == toxicity.THREAT and armed):
            total += weight * damp
        negated = toxicity.NEGATION_SCOPE if symbol == toxicity.NEGATION else max(0, negated - 1)
        reported |= symbol == toxicity.REPORT
        targeted |= symbol == toxicity.TARGET
        armed |= symbol in (toxicity.TARGET, toxicity.FUTURE)
    return total * toxicity.TARGETED if targeted else total


def test_composed_transducers_equal_plain_rules():
    rng = np.random.default_rng(3)
    symbol = rng.integers(0, toxicity.SYMBOLS, 4000)
    weight = np.where(symbol == toxicity.INSULT, rng.random(4000) * 6, np.where(symbol == toxicity.THREAT, toxicity.THREAT_WEIGHT, 0.0))
    cuts = np.unique(np.concatenate([[0, 4000], rng.integers(0, 3000, 300)]))  # the last clause is long
    got = toxicity.Grammar().clauses(symbol, weight, cuts[:-1], cuts[1:])
    want = [plain_clause(zip(symbol[a:b].tolist(), weight[a:b].tolist(), strict=True)) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert got == pytest.approx(want)
    # A composition does what its parts do one after the other.
    one, two = toxicity.threat(), toxicity.target()
    both = one.compose(two)
    p = q = r = 0
    for a in symbol[:500].tolist():
        p, b, w = one.arcs[p, a]
        q, c, v = two.arcs[q, b]
        r, d, u = both.arcs[r, a]
        assert (c, w * v, one.final[p] * two.final[q]) == (d, u, both.final[r])


def test_lexicon_equals_plain_lookup():
    insults = {"fool": 4.0, "dolt*": 3.0, "dolti*": 2.0, "doltish": 1.0, "kille*": 5.0, "your": 2.5}
    g = toxicity.Grammar(insults)
    lists = ((toxicity.THREAT, toxicity.THREATS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.FUTURE, toxicity.FUTURES), (toxicity.TARGET, toxicity.TARGETS))
    words = ["", "fool", "fools", "foo", "dolt", "dolts", "doltis", "doltish", "doltishly", "killer", "kille", "your", "\u4f60\u597d", *(w for _, ws in lists for w in ws)]
    for w in words:
        found = [(toxicity.INSULT, insults[f]) for f in toxicity.features(w) if f in insults]
        found += [(s, toxicity.THREAT_WEIGHT if s == toxicity.THREAT else 0.0) for s, ws in lists if w in ws]
        assert g.lexical(w) == (found + [(toxicity.NOTHING, 0.0)])[0], w


def test_toxicity_scores_equal_brute_force(spark, odd):
    g = toxicity.Grammar({"one": 4.0, "lazy": 2.0, "seco*": 1.5, "null": 3.0, "w5x5": 0.5}, np.array([-2.0, 1.0, 0.7, 0.3]))
    more = spark.createDataFrame([(20, "You fool. She said: you lazy one!\nNot one; will kill second"), (21, "one\x0btwo one \u00e9one (one) One?one")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    want = []
    for r in docs.collect():
        scores = []
        for line in (r["text"] or "").split("\n"):
            clause = []
            for w in re.findall(r"[^\x20\x09-\x0D]+", line) + [None]:
                if w is not None:
                    clause.append(g.lexical(toxicity.normal(w)))
                if w is None or w[-1] in ".!?;:":
                    scores.append(plain_clause(clause))
                    clause = []
        hit = [c for c in scores if c > 0]
        x = np.array([1.0, np.log1p(sum(hit)), max(hit, default=0.0) / 10, np.log1p(len(hit))]) @ g.weights
        want.append((r["doc_id"] or -1, round(1 / (1 + np.exp(-x)), 6), len(hit)))
    got = [(r["doc_id"] or -1, round(r["score"], 6), r["n_clauses"]) for r in toxicity.score(docs, g).collect()]
    assert sorted(got) == sorted(want) and len({s for _, s, _ in got}) > 3


def test_toxicity(spark, odd, labels, docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] > 4 * n.get((1, 0), 0) and n.get((0, 1), 0) < 0.02 * n[0, 0]
    none = toxicity.toxicity(odd, labels.where("false")).collect()
    assert len(none) == len(ODD) and {r["score"] for r in none} == {0.0}


# 8


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/", "http://a.example.com/en", "http://notexample.com/en/", "https://x.net/es/1?a#b", "http://net?x/fr/", "http://u:p@example.com:80/en/", "http://x.org/://y.net/fr/", "http://example.net/fr/#x"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.verdicts(df, url_filter.PAGE_RULES).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(AZ), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(h + p, v) for v, h, p in url_filter.PAGE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert got[i] == (host, path, *best)
    assert url_filter.verdicts(df.where("false"), url_filter.PAGE_RULES).count() == 0


def test_block_beats_allow_at_equal_length():
    root = url_filter.build([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "a.b", "/x/long")])
    assert url_filter.judge(root, "c.a.b", "/xyz")[0] == "block" and url_filter.judge(root, "a.b", "/x/longer")[0] == "allow"
    with pytest.raises(ValueError):
        url_filter.build([("maybe", "a", "/")])


# 9


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(1, 0, "system", "be\\nice"), (1, 1, "user", "hi"), (2, 0, "system", "be\\nice"), (2, 1, "user", "hi"), (2, 2, "assistant", "<|im_end|> x </s> <\\/s> [INST]"), (3, 0, "system", "be\\nice"), (3, 1, "user", "other"), (4, 0, None, None), (5, 0, "user", "solo"), (5, 0, "user", "solo"), (6, 1, "ro\nle\\", "a\nb"), (6, 0, "user", "first")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit("clash"))


def test_chat_digests(chats):
    got = {r["conv_id"]: r for r in chat_format.digests(chats).collect()}
    convs = {}
    for r in chats.collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    for c, ts in convs.items():
        ts.sort()
        said = "".join(t for _, r, t in ts if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
    assert chat_format.digests(chats.where("false")).count() == 0


def test_chat_tree_shares_turns_and_attends_to_ancestors(chats):
    emitted, leaves = chat_format.format_chats(chats)
    nodes = {r["node"]: r for r in emitted.collect()}
    assert len(nodes) == 9 and leaves.count() == 6
    for tree in {r["tree"] for r in nodes.values()}:
        own = sorted((r for r in nodes.values() if r["tree"] == tree), key=lambda r: r["start"])
        at = 0
        for r in own:  # the segments follow each other without a gap
            assert r["start"] == at
            at += r["length"]
            above = nodes.get(r["parent"])
            want = [] if above is None else [tuple(x) for x in above["attend"]] + [(above["start"], above["start"] + above["length"])]
            assert [tuple(x) for x in r["attend"]] == want and r["position"] == sum(b - a for a, b in want)
        for r in own:  # depth first: a subtree is one interval
            end = max(x["start"] + x["length"] for x in own if x is r or (r["start"], r["start"] + r["length"]) in [tuple(i) for i in x["attend"]])
            inside = [x for x in own if r["start"] <= x["start"] < end]
            assert all(x is r or (r["start"], r["start"] + r["length"]) in [tuple(i) for i in x["attend"]] for x in inside)


# 10


def test_lm_scores_equal_brute_force(spark, docs):
    texts = ["a b c", "", None, "b", "a a b c d e " * 20, LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units, weights = model = lm_score.fit(df)
    got = {r["doc_id"]: r for r in lm_score.score(df, model=model).collect()}
    for i, t in enumerate(texts[:5]):
        w = (t or "").split()
        total = 0.0
        if w:
            data = np.frombuffer((t).encode(), np.uint8)
            bucket, _ = lm_score.buckets(data, np.array([0, len(data)]))
            unit = units.unit[bucket]
            for k in range(len(w)):
                h = weights.hidden.astype(float).copy()
                for d in range(1, lm_score.WINDOW + 1):
                    h += weights.context[2 * d - 2][unit[k - d] if k >= d else lm_score.OUTSIDE]
                    h += weights.context[2 * d - 1][unit[k + d] if k + d < len(w) else lm_score.OUTSIDE]
                s = np.tanh(h) @ weights.out + weights.bias
                total += s[unit[k]] - np.log(np.exp(s).sum()) + units.share[bucket[k]]
        assert got[i]["n_words"] == len(w) and got[i]["log_prob"] == pytest.approx(total, abs=2e-3) and (got[i]["mean_log_prob"] is None) == (not w)


def test_lm_training_helps(spark, docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    units, trained = lm_score.fit(docs)
    mean = lambda w: lm_score.score(docs, model=(units, w)).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    assert mean(trained) > mean(lm_score.start(units)) + 0.02
    assert lm_score.score(docs.where("false")).count() == 0


def test_lm_counts_every_word_and_trains_on_every_position(spark):
    texts = [" ".join(f"w{(i * i + 7 * j) % 3001}" for i in range(j, j + 400)) for j in range(40)] + ["A rare\tword", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    units, weights = lm_score.fit(df)
    words = Counter(w for t in texts for w in (t or "").translate(AZ).split())
    assert weights.seen == sum(words.values())
    of = lambda w: lm_score.buckets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]
    table = {r["word"]: r for r in units.table.collect()}
    assert len(table) == len(words)
    own = {w: table[of(w)] for w in words}
    mass = Counter()
    for w, n in words.items():
        mass[own[w]["unit"]] += n
    assert all(own[w]["share"] == pytest.approx(np.log(n / mass[own[w]["unit"]])) for w, n in words.items())
    # Classes follow the frequency order.
    by_unit = {}
    for w, n in words.items():
        by_unit.setdefault(own[w]["unit"], []).append(n)
    order = [by_unit[u] for u in sorted(by_unit)]
    assert all(min(a) >= max(b) for a, b in zip(order, order[1:], strict=False))
    assert sorted(by_unit)[: lm_score.FREQUENT] == list(range(lm_score.FREQUENT))


def _shuffled(spark) -> int:
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(spark._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_lm_words_cross_the_shuffle_once_and_their_counts_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(6, "doc_id").localCheckpoint()
    words = lm_score.sliced(docs).agg(F.sum(F.size("words"))).first()[0]
    before = _shuffled(spark)
    lm_score.score(docs).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < 40 * words


def test_lm_scores_tables_without_words(spark):
    none = spark.createDataFrame([("a", None), ("b", ""), (None, " \n")], "doc_id string, text string").repartition(2)
    assert sorted(map(tuple, lm_score.score(none).collect()), key=str) == [("a", 0, 0.0, None), ("b", 0, 0.0, None), (None, 0, 0.0, None)]
    assert lm_score.score(none.where("false")).count() == 0
    assert lm_score.fit(none)[0].table.count() == 0


def test_lm_step_is_the_plain_gradient(spark):
    rng = np.random.default_rng(3)
    for scale, size in ((0.1, 40), (30.0, 40), (0.1, 7)):  # of the second, scores are too large for exp in float32
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32) * np.float32(scale)  # noqa: B023, E731
        w = lm_score.Weights(draw(2 * lm_score.WINDOW, lm_score.UNITS + 1, lm_score.WIDTH), draw(lm_score.WIDTH), draw(lm_score.WIDTH, lm_score.UNITS), draw(lm_score.UNITS))
        unit, around = rng.integers(0, lm_score.UNITS, size), rng.integers(0, 5, (2 * lm_score.WINDOW, size))
        c, hid, o, b = (x.astype(float) for x in (w.context, w.hidden, w.out, w.bias))
        h = np.tanh(hid + sum(c[k][around[k]] for k in range(2 * lm_score.WINDOW)))
        z = h @ o + b
        z -= z.max(axis=1, keepdims=True)
        log_p = (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(size), unit]
        assert lm_score.log_probabilities(w, around, unit) == pytest.approx(log_p, rel=1e-4, abs=1e-4)
        g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        g[np.arange(size), unit] -= 1
        g *= 0.5 / size
        d = (g @ o.T) * (1 - h * h)
        for k in range(2 * lm_score.WINDOW):
            np.subtract.at(c[k], around[k], d)
        lm_score.Network(w, 40).step(around + lm_score._PLACES, unit, 0.5)
        for got, want in ((w.context, c), (w.hidden, hid - d.sum(axis=0)), (w.out, o - h.T @ g), (w.bias, b - g.sum(axis=0))):
            assert got == pytest.approx(want, rel=1e-3, abs=1e-4 * scale)


# SQL and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs):
    import corpus_pipeline

    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF).cache()
        assert after.columns == docs.columns, name
        assert 0.6 * left.count() < after.count() <= left.count(), name
        left = after
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(brute_contamination(r["text"], items)[4] for r in left.limit(20).collect())
    last = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert last.count() == left.count() and last.where("NOT exact").count() == 0


def test_stages_judge_rows_not_ids(spark, docs):
    clean = [r["text"] for r in docs.where("lang = 'en' AND n_chars BETWEEN 400 AND 3000").orderBy("doc_id").limit(6).collect()]
    frame = lambda rows: spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    texts = lambda df: sorted(r["text"] for r in df.collect())

    base = " ".join(f"n{i}" for i in range(80))
    other = " ".join(f"k{i}" for i in range(80))
    out = near_dedup.stage(spark, frame([(1, base), (None, base), (None, other), (2, "own words of two"), (2, base), (3, "same row twice"), (3, "same row twice")]), SF)
    assert texts(out) == sorted([base, other, "own words of two", "same row twice"])

    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) > 10)
    out = decontaminate.stage(spark, frame([(None, item), (None, "zzq clean"), (7, item), (7, "zzq seven")]), SF)
    assert texts(out) == ["zzq clean", "zzq seven"]

    line = "This very line stands here word by word"
    out = line_dedup.stage(spark, frame([(1, line), (None, f"{line}\nfirst of its own"), (None, "zero line of another one stays\nsecond of its own")]), SF)
    assert "zero line of another one stays\nsecond of its own" in texts(out) and sum(line in t for t in texts(out)) == 1

    train = docs.select("doc_id", "text", "lang").union(frame([(None, clean[0] + " unique"), (None, "12 34 56")]))
    left = texts(language_id.stage(spark, train, SF))
    assert clean[0] + " unique" in left and "12 34 56" not in left
