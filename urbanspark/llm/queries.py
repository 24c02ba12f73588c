"""The thin opN queries over the given tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.llm import chat_format, conv_trie, decontaminate, language_id, line_dedup, lm_score, merkle, mixing, near_dedup, pieces, quality, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"), F.sha2("text", 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), url_filter.PAGE_RULES)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_control_conversation(table(spark, sf_dir, "conversations")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"), merkle.tampered_text())


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.trie(table(spark, sf_dir, "conversations"))


def op13_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_chat_format": op9_chat_format,
    "op10_lm_score": op10_lm_score,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_mix_sources": op13_mix_sources,
}

LOWER_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of an integer's decimal text, unsigned, by half bytes; the table follows from the polynomial.
_HALF_BYTES = []
for _v in range(16):
    for _ in range(4):
        _v = _v >> 1 ^ (0xEDB88320 if _v & 1 else 0)
    _HALF_BYTES.append(_v)
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT & 15, ascii(c)::BIGINT >> 4]))), "
    f"lambda a, x: xor(a >> 4, ({_HALF_BYTES}::BIGINT[])[CAST(xor(a, x) & 15 AS INTEGER) + 1])), 4294967295::BIGINT)"
)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE = {
    "op2_line_dedup": r"""
        WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        cut AS (SELECT doc_id, i - 1 AS line, ls[i] AS body FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
        toks AS (SELECT doc_id, line, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM cut),
        each AS (
          SELECT doc_id, line, len(w) AS n, p, CASE WHEN regexp_matches(w[p], '[0-9]') THEN '<*>' ELSE w[p] END AS t
          FROM (SELECT doc_id, line, w, unnest(range(1, len(w) + 1)) AS p FROM toks WHERE len(w) >= 5)),
        lines AS (
          SELECT doc_id, line, n, string_agg(t, ' ' ORDER BY p) AS body, n || ' ' || string_agg(t, ' ' ORDER BY p) FILTER (p <= 3) AS leaf
          FROM each GROUP BY doc_id, line, n),
        kinds AS (SELECT leaf, body, n, count(DISTINCT doc_id) AS docs FROM lines GROUP BY 1, 2, 3),
        leaves AS (SELECT leaf FROM kinds GROUP BY 1 HAVING sum(docs) >= 3),
        cand AS (SELECT kinds.* FROM kinds JOIN leaves USING (leaf)),
        placed AS (SELECT leaf, body, n, docs, p, string_split(body, ' ')[p] AS t FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM cand)),
        staying AS (SELECT leaf, p, t FROM placed GROUP BY 1, 2, 3 HAVING sum(docs) >= 3),
        forms AS (
          SELECT leaf, body, n, string_agg(p || ':' || t, ' ' ORDER BY p) AS form, count(*) AS c
          FROM placed JOIN staying USING (leaf, p, t) WHERE t <> '<*>' GROUP BY 1, 2, 3),
        template AS (SELECT leaf, body, form FROM forms WHERE c * 10 >= n * 8),
        held AS (SELECT lines.leaf, form, doc_id, line FROM lines JOIN template USING (leaf, body)),
        recurring AS (SELECT leaf, form, min(doc_id) AS owner FROM held GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3),
        whole AS (SELECT doc_id, line, len(w) AS n, array_to_string(w, ' ') AS body FROM toks WHERE len(w) > 0),
        same AS (SELECT body, min(doc_id) AS owner FROM whole GROUP BY body, n HAVING count(DISTINCT doc_id) >= CASE WHEN n < 5 THEN 3 ELSE 2 END),
        dropped AS (
          SELECT doc_id, line FROM held JOIN recurring USING (leaf, form) WHERE doc_id <> owner
          UNION SELECT doc_id, line FROM whole JOIN same USING (body) WHERE doc_id <> owner),
        per_doc AS (
          SELECT cut.doc_id, count(*) AS n_lines, count(d.line) AS n_dropped, string_agg(CAST(d.line AS VARCHAR), ',' ORDER BY d.line) AS ds,
                 string_agg(body, chr(10) ORDER BY cut.line) FILTER (d.line IS NULL) AS left_over
          FROM cut LEFT JOIN dropped d ON d.doc_id = cut.doc_id AND d.line = cut.line GROUP BY cut.doc_id)
        SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
               coalesce(ds, '') AS dropped_lines, CASE WHEN text IS NOT NULL THEN sha256(coalesce(left_over, '')) END AS text_sha256
        FROM documents LEFT JOIN per_doc USING (doc_id)""",
    "op3_decontaminate": rf"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        wins AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM wins),
        placed AS (
          SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, s, p.n FROM placed p JOIN wins USING (n, win)),
        covered AS (
          SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY 1),
        found AS (
          SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op4_near_dedup": rf"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, CASE WHEN len(w) >= 2 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        inter AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
          SELECT x, y FROM inter JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (
          SELECT doc_id AS node, doc_id AS seen FROM documents
          UNION
          SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.seen),
        least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
        SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id""",
    "op8_url_filter": """
        WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
        c AS (
          SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                          ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best AS (
          SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
          FROM c JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
        SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM c LEFT JOIN best ON best.page_id = c.page_id""",
    "op9_chat_format": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        s AS (
          SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(12 + length(role) + 1 + length(text) + escaped + 11) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op11_merkle_manifest": rf"""
        WITH RECURSIVE placed AS (
          SELECT doc_id, lang, leaf, shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
          FROM (SELECT *, {_leaf("text")} AS leaf, CASE WHEN {CRC32.format("doc_id")} % 3 = 0 THEN {_leaf(LOWER_AZ.format("text"))} ELSE {_leaf("text")} END AS shown FROM documents)),
        up AS (
          SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
          UNION ALL
          SELECT lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, level, i // 8, n),
        subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (
          SELECT 0 AS level, i, n, h FROM subroots
          UNION ALL
          SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8, n),
        fold AS (
          SELECT doc_id, lang, leaf, i AS own, 0 AS level, i, n, shown AS h, '' AS proof FROM placed
          UNION ALL
          SELECT f.doc_id, f.lang, f.leaf, f.own, f.level + 1, f.i // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN u.i = f.i THEN f.h ELSE u.h END, '' ORDER BY u.i)), f.proof || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> f.i), '')
          FROM fold f JOIN up u ON u.lang IS NOT DISTINCT FROM f.lang AND u.level = f.level AND u.i // 8 = f.i // 8
          WHERE f.n > 1 GROUP BY f.doc_id, f.lang, f.leaf, f.own, f.level, f.i, f.n, f.h, f.proof),
        over AS (
          SELECT f.doc_id, f.leaf, f.own, s.h AS subroot, 0 AS level, s.i, s.n, f.h, f.proof FROM fold f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
          UNION ALL
          SELECT f.doc_id, f.leaf, f.own, f.subroot, f.level + 1, f.i // 8, (f.n + 7) // 8, sha256(string_agg(CASE WHEN u.i = f.i THEN f.h ELSE u.h END, '' ORDER BY u.i)), f.proof || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> f.i), '')
          FROM over f JOIN top u ON u.level = f.level AND u.i // 8 = f.i // 8
          WHERE f.n > 1 GROUP BY f.doc_id, f.leaf, f.own, f.subroot, f.level, f.i, f.n, f.h, f.proof)
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, over.h AS folded_root, over.h = r.h AS verified
        FROM over, (SELECT h FROM top WHERE n = 1) r WHERE over.n = 1""",
    "op12_conversation_trie": rf"""
        WITH RECURSIVE own AS (
          SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
        convs AS (SELECT conv_id, {CRC32.format("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS donor FROM (SELECT DISTINCT conv_id FROM own)),
        seq AS (
          SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM (
            SELECT c.conv_id, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.donor AND o.k <= c.h
            UNION ALL SELECT c.conv_id, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h)),
        chain AS (
          SELECT conv_id, 0::BIGINT AS d, '' AS node, '' AS parent, 0::BIGINT AS tokens FROM convs
          UNION ALL
          SELECT c.conv_id, c.d + 1, sha256(c.node || ':' || length(s.role) || ':' || s.role || s.text), c.node, len(regexp_extract_all(s.text, '[^\x20\x09-\x0D]+'))
          FROM chain c JOIN seq s ON s.conv_id = c.conv_id AND s.d = c.d + 1),
        nodes AS (SELECT node, d, parent, any_value(tokens) AS tokens, min(conv_id) AS conv_id, count(*) AS n FROM chain GROUP BY node, d, parent),
        kids AS (SELECT parent, count(*) AS n FROM nodes WHERE d > 0 GROUP BY parent),
        under AS (SELECT DISTINCT a.node AS top, b.node FROM chain a JOIN chain b ON b.conv_id = a.conv_id AND b.d >= a.d),
        sums AS (SELECT top, count(*) FILTER (k.n IS NULL) AS leaves, sum((n.n - 1) * n.tokens) AS saved FROM under u JOIN nodes n ON n.node = u.node LEFT JOIN kids k ON k.parent = n.node GROUP BY top),
        ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, d) AS node FROM chain GROUP BY conv_id) GROUP BY node)
        SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN p.conv_id END AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.parent = n.node JOIN sums s ON s.top = n.node LEFT JOIN ends e ON e.node = n.node""",
}
