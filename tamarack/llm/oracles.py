"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORD = "'[^\\x20\\x09-\\x0D]+'"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r)
  SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, m = documents.doc_id AS kept
  FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(r) AS m FROM reach GROUP BY d) ON d = documents.doc_id"""

_TURNS = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t),
  x AS (SELECT *, CASE WHEN b IS NULL THEN role IN ('system', 'user') WHEN b = 'system' THEN role = 'user' WHEN b = 'user' THEN role = 'assistant' WHEN b = 'assistant' THEN role = 'user' ELSE false END AS fine,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 23 + length(role) + length(regexp_replace(role, '[^\\[<\\\\]', '', 'g')) END AS around FROM o)"""
OP5 = f"""{_TURNS} SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(around + length(text) + length(regexp_replace(text, '[^\\[<\\\\]', '', 'g'))) AS BIGINT) AS formatted_chars, bool_and(fine) AND arg_max(role, turn) = 'assistant' AS valid FROM x GROUP BY conv_id"""


#: The measures of rules and their constants, stated here on their own.
_VALUES = {"symbols": "1000 * n_symbols // n_words", "repeats": "1000 * n_repeat_words // n_words", "lines": "1000 * n_dup_lines // n_words", "length": "100 * word_chars // n_words", "words": "n_words"}
_POINTS = ", ".join(f"min(CASE WHEN 100 * upto >= {k} * total THEN CAST(floor(CASE WHEN bucket = 0 THEN 0 ELSE 2 * pow(1.02, bucket - 1) / 2.02 END + 0.5) AS BIGINT) END) AS p{k}" for k in (20, 50, 80))


def _ranked(by: str) -> str:
    keys = f"{by}, measure" if by else "measure"
    merged = f"SELECT {keys}, bucket, sum(n) AS n FROM sketch GROUP BY {keys}, bucket"
    return f"SELECT {keys}, CAST(max(total) AS BIGINT) AS n, {_POINTS} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM ({merged})) GROUP BY {keys}"


def _lean(n: str, p: str, q: str) -> str:
    return f"({n} * {p} + 100 * {q}) // ({n} + 100)"


OP7 = f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, {_WORD}) GROUP BY doc_id),
  grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
  twice AS (SELECT doc_id, i FROM grams JOIN (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
  repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
  counts AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
  each AS (SELECT lang, source, unnest([{', '.join(f"{{'measure': '{m}', 'value': {x}}}" for m, x in _VALUES.items())}], recursive := true) FROM counts WHERE n_words > 0),
  sketch AS (SELECT lang, source, measure, CASE WHEN value <= 0 THEN 0 ELSE 1 + CAST(ceil(ln(value) / ln(1.02)) AS INTEGER) END AS bucket, count(*) AS n FROM each GROUP BY ALL),
  own AS ({_ranked('lang, source')}), language AS ({_ranked('lang')}), whole AS ({_ranked('')}),
  named AS (SELECT l.lang, l.measure, {', '.join(f"{_lean('l.n', f'l.p{k}', f'w.p{k}')} AS p{k}, w.p{k} AS w{k}" for k in (20, 50, 80))} FROM language l JOIN whole w USING (measure)),
  placed AS (SELECT o.lang, o.source, o.measure, {', '.join(f"{_lean('o.n', f'o.p{k}', f'l.p{k}')} AS p{k}, l.p{k} AS l{k}, l.w{k}" for k in (20, 50, 80))} FROM own o JOIN named l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure),
  spread AS (SELECT *, greatest(p80 - p50, p50 - p20, l80 - l50, l50 - l20, w80 - w50, w50 - w20, p80 // 50) AS wide FROM placed),
  middle AS (SELECT lang, source, greatest(p50, 1) AS words FROM spread WHERE measure = 'words'),
  fences AS (SELECT s.lang, s.source, {', '.join(f"max(CASE WHEN measure = '{m}' THEN p80 + 3 * greatest(wide, {least} // words) END) AS {m}_high" for m, least in (("symbols", 1000), ("repeats", 24000), ("lines", 2000), ("length", 0)))},
    max(CASE WHEN measure = 'length' THEN p20 - 3 * wide END) AS length_low
    FROM spread s JOIN middle m ON s.lang IS NOT DISTINCT FROM m.lang AND s.source IS NOT DISTINCT FROM m.source GROUP BY s.lang, s.source)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {' AND '.join(f"{_VALUES[m]} <= {m}_high" for m in ("symbols", "repeats", "lines", "length"))} AND {_VALUES['length']} >= length_low AS kept
  FROM counts LEFT JOIN fences ON counts.lang IS NOT DISTINCT FROM fences.lang AND counts.source IS NOT DISTINCT FROM fences.source"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
  good AS (SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
  edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  reach(d, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r)
  SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = vec_id AS kept
  FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM edges GROUP BY a) ON a = vec_id JOIN (SELECT d, min(r) AS m FROM reach GROUP BY d) ON d = vec_id"""

_BITS = " + ".join(f"CASE WHEN {x} THEN {1 << k} ELSE 0 END" for k, x in enumerate(("len(w) < 200", "100 * len(list_distinct(w)) < 50 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)", "regexp_matches(t, '[#$%&*|]')", "w.doc_id > m.least")))
OP12 = f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
  m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
  known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
  failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {_BITS} AS fails FROM w JOIN m USING (t) LEFT JOIN known ON known.doc_id = w.doc_id),
  l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  each AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
  firsts AS (SELECT *, coalesce(list_position(list_transform(bits, lambda b: (fails & b) > 0), true), 6) AS first FROM each, orders),
  steps AS (SELECT *, unnest(bits) AS bit, unnest([1, 2, 3, 4, 5]) AS step FROM firsts),
  counted AS (SELECT part, filter_order, step, any_value(bit) AS bit, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (fails & bit) > 0 AND first < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN first = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN first = step THEN toxic ELSE 0 END) AS toxic_lost FROM steps GROUP BY part, filter_order, step)
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted"""

#: An unsigned crc32 of a short ASCII string, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda y: CAST(ascii(y) AS BIGINT))), lambda s, y: list_reduce(list_prepend(xor(s, y), range(8)), lambda z, k: xor(z >> 1, (z & 1) * 3988292384))))"
OP13 = f"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, c - c % 100 AS b, {_CRC.format(x="CAST(c AS VARCHAR)")} % 6 AS h FROM o GROUP BY c),
  sized AS (SELECT c, b, h, least(h, (SELECT count(*) FROM o WHERE o.c = convs.b)) AS m FROM convs),
  turns AS (SELECT s.c, o.i AS d, r, x FROM sized s JOIN o ON o.c = s.b AND o.i <= s.m UNION ALL SELECT s.c, s.m + o.i - s.h, r, x FROM sized s JOIN o ON o.c = s.c AND o.i > s.h),
  paths AS (SELECT c, d, length(x) AS chars, string_agg(sha256(length(r) || ':' || r || x), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS p FROM turns UNION ALL SELECT c, 0, 0, '' FROM convs),
  tops AS (SELECT c, max(d) AS top FROM paths GROUP BY c),
  nodes AS (SELECT p, max(d) AS d, min(paths.c) AS conv, count(*) AS n, max(chars) AS chars, sha256(coalesce(string_agg(CAST(paths.c AS VARCHAR), ',' ORDER BY paths.c) FILTER (d = top), '')) AS ends FROM paths JOIN tops ON tops.c = paths.c GROUP BY p),
  kids AS (SELECT left(p, length(p) - 64) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
  own AS (SELECT nodes.*, coalesce(k, 0) AS k, (n - 1) * chars AS saved FROM nodes LEFT JOIN kids USING (p)),
  below AS (SELECT paths.p, sum(CASE WHEN own.k = 0 THEN 1 ELSE 0 END) AS leaves, sum(own.saved) AS saved FROM own JOIN paths ON paths.c = own.conv AND paths.d <= own.d GROUP BY paths.p)
  SELECT own.conv AS conv_id, CAST(own.d AS BIGINT) AS depth, up.conv AS parent_conv_id, own.n AS n_convs, own.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, own.ends AS ends_sha256
  FROM own JOIN below USING (p) LEFT JOIN nodes up ON own.d > 0 AND up.p = left(own.p, length(own.p) - 64)"""

SQL = {"op1_minhash": OP1, "op5_chat": OP5, "op7_quality_rules": OP7, "op9_embedding_dedup": OP9, "op12_filter_audit": OP12, "op13_prefix_trie": OP13}
