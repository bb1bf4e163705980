"""SQL for DuckDB that must give the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality import ALPHA, DELTA, LEVELS, MIN_WORDS

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM g"""

_WORD = r"[^\x20\x09-\x0D]"
_PER = {"r_symbols": ("n_symbols", "word_chars"), "r_dup_lines": ("n_dup_lines", "n_lines"), "r_repeat": ("n_repeat_words", "n_words"), "r_exclaim": ("n_exclaim", "word_chars"), "r_capitals": ("n_capitals", "word_chars")}
_RATIOS = ", ".join(f"CAST(floor({a} * 1000 / greatest({b}, 1)) AS BIGINT) AS {r}" for r, (a, b) in _PER.items())
_FIRST = "least(" + ", ".join(f"len(list_filter({list(cutoffs)}, lambda c: {r} <= c))" for r, cutoffs in LEVELS.items()) + ")"
_N = len(LEVELS["r_symbols"])

QUALITY = f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
 i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
 r AS (SELECT doc_id, i FROM i QUALIFY count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1),
 c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
 s AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaim, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals FROM d LEFT JOIN c USING (doc_id)),
 v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_RATIOS} FROM s),
 f AS (SELECT *, {_FIRST} AS first FROM v),
 good AS (SELECT lang, first FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
 k AS (SELECT lang, level, count(*) AS n, count(*) FILTER (first <= level) AS k FROM good, (SELECT unnest(range(0, {_N})) AS level) GROUP BY 1, 2),
 p AS (SELECT *, CASE WHEN k < n * {ALPHA} THEN list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) ELSE 1 END AS p FROM k),
 cuts AS (SELECT lang AS stratum, coalesce(min(level) FILTER (p > {DELTA} / (SELECT count(*) FROM k WHERE level = 0)), {_N}) - 1 AS level FROM p GROUP BY 1)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(first > level, true) AS kept FROM f LEFT JOIN cuts ON lang IS NOT DISTINCT FROM stratum"""


_FIELD = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
#: crc32 of an ASCII text, bit by bit; its last bit says whether it is even.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, len(id) + 1), lambda i: [CAST(ascii(id[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384), 4294967295), 4294967295)"

MANIFEST = f"""WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, {_LEAF("text")} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS bare, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM documents),
 e AS MATERIALIZED (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN bare ELSE leaf END AS shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS rank FROM d),
 low(lvl, tree, rank, n, h) AS (SELECT 0, tree, rank, count(*) OVER (PARTITION BY tree), leaf FROM e UNION ALL SELECT lvl + 1, tree, rank // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY rank)) FROM low WHERE n > 1 GROUP BY lvl, tree, rank // 3, n),
 subroots AS MATERIALIZED (SELECT tree, h AS subroot FROM low WHERE n = 1),
 high(lvl, tree, rank, n, h) AS (SELECT 0, -1, tree, count(*) OVER (), subroot FROM subroots UNION ALL SELECT lvl + 1, tree, rank // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY rank)) FROM high WHERE n > 1 GROUP BY lvl, tree, rank // 3, n),
 nodes AS MATERIALIZED (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1),
 sides AS MATERIALIZED (SELECT a.lvl, a.tree, a.rank, coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS r FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.tree = b.tree AND a.rank // 3 = b.rank // 3 GROUP BY 1, 2, 3),
 a(own, pos, lvl, tree, rank, h, proof) AS (SELECT tree, rank, 0, tree, rank, shown, '' FROM e UNION ALL SELECT a.own, a.pos, a.lvl + 1, a.tree, a.rank // 3, sha256(l || h || r), proof || l || r FROM a JOIN sides s ON s.lvl = a.lvl AND s.tree = a.tree AND s.rank = a.rank),
 b AS MATERIALIZED (SELECT own, pos, h, proof FROM a QUALIFY row_number() OVER (PARTITION BY own, pos ORDER BY lvl DESC) = 1),
 c(own, pos, lvl, tree, rank, h, proof) AS (SELECT own, pos, 0, -1, own, h, proof FROM b UNION ALL SELECT c.own, c.pos, c.lvl + 1, c.tree, c.rank // 3, sha256(l || h || r), proof || l || r FROM c JOIN sides s ON s.lvl = c.lvl AND s.tree = c.tree AND s.rank = c.rank),
 f AS (SELECT own, pos, h, proof FROM c QUALIFY row_number() OVER (PARTITION BY own, pos ORDER BY lvl DESC) = 1)
 SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified FROM e JOIN f ON own = e.tree AND pos = e.rank JOIN subroots USING (tree), (SELECT h AS root FROM high WHERE n = 1)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}+') AS w FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
 SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)"""
