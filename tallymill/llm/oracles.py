"""DuckDB SQL for the queries of this subpackage that SQL can express, over unique ids."""

from __future__ import annotations

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM win JOIN m USING (s), range(0, 13) t(k) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE gone.j IS NULL) AS text
  FROM words LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Bare base32 of a SHA-1: five hex digits are four base32 digits.
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
  (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 1, 1)) - 1) * 65536 + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 2, 1)) - 1) * 4096
  + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 3, 1)) - 1) * 256 + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 4, 1)) - 1) * 16
  + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 5, 1)) - 1)) // CAST(power(32, 3 - i % 4) AS BIGINT) % 32 AS BIGINT), 1)), '')"""

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS load, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT load, max(page_id) AS owner FROM p GROUP BY load)
SELECT page_id, CAST(strlen(load) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN o USING (load)
"""

OP3 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_ALNUM}') AS ws FROM benchmark),
bw AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, ws[i:i + 12] AS s FROM bw),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{_ALNUM}') AS ws FROM documents),
sizes AS (SELECT DISTINCT len(s) AS k FROM win),
p AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, sizes),
hit AS (SELECT doc_id, i, k, item FROM (SELECT doc_id, i, k, ws[i:i + k - 1] AS s FROM p) JOIN win USING (s)),
words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, range(0, 13) t(o) WHERE o < k GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = f"""
WITH r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_FOLD}) AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
       AND starts_with(path, substr(rule, instr(rule, '/')))
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
"""

#: CRC-32 by its table, built from the polynomial, one byte of all texts at a time.
OP10 = """
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
    FROM range(0, 256) r(n))
),
text_bytes AS (
  SELECT doc_id, list_transform(range(0, strlen(coalesce(text, ''))), lambda i:
           (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS b
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents)
),
crc AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS text_crc32
  FROM text_bytes, tab
),
j AS (
  SELECT doc_id, n, CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS key, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS nxt
  FROM documents, (VALUES (24), (25)) v(n)
  UNION ALL
  SELECT doc_id, n, k2, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, n, nxt, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE nxt < n)
),
s AS (SELECT doc_id, max(b) FILTER (WHERE n = 24) AS shard, max(b) FILTER (WHERE n = 25) AS grown FROM j GROUP BY doc_id)
SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM documents JOIN s USING (doc_id) JOIN crc USING (doc_id)
"""

_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))"
_RULES = "(VALUES ('symbols_per_1000_words', 'upper', 100), ('word_length_x100', 'upper', 150), ('word_length_x100', 'lower', 150), ('repeated_lines_per_1000', 'upper', 500), ('repeated_words_per_1000', 'upper', 350)) r(signal, side, margin)"


def _levels(name: str, keys: str) -> str:
    """Quartiles of the sketches of these keys: bucket counts added up."""
    return f"""{name}_b AS (SELECT {keys}signal, b, count(*) AS n FROM sig GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}signal ORDER BY b) AS run, sum(n) OVER (PARTITION BY {keys}signal) AS total FROM {name}_b),
{name} AS (SELECT {keys}signal, any_value(total) AS total, min(lo(b)) FILTER (WHERE 4 * run >= total) AS q1, min(lo(b)) FILTER (WHERE 4 * run >= 2 * total) AS q2,
  min(lo(b)) FILTER (WHERE 4 * run >= 3 * total) AS q3 FROM {name}_r GROUP BY ALL)"""


_LO = "(CASE WHEN b < 64 THEN b ELSE (b - 32 * (b // 32 - 1)) * CAST(power(2, b // 32 - 1) AS BIGINT) END)"
OP11 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws, {_LINES} AS ls FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 2], ' ')) AS k FROM p),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM win, range(0, 3) x(o) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ 	-
]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT doc_id, lang, source, unnest([{{'signal': 'symbols_per_1000_words', 'value': 1000 * n_symbols // n_words}}, {{'signal': 'word_length_x100', 'value': 100 * word_chars // n_words}},
  {{'signal': 'repeated_lines_per_1000', 'value': 1000 * n_dup_lines // n_lines}}, {{'signal': 'repeated_words_per_1000', 'value': 1000 * n_repeat_words // n_words}}], recursive := true) FROM m WHERE n_words > 0),
sig AS (SELECT *, CASE WHEN value < 64 THEN value ELSE 32 * (length(bin(value)) - 6) + value // CAST(power(2, length(bin(value)) - 6) AS BIGINT) END AS b FROM v),
{_levels("own", "lang, source, ").replace("lo(b)", _LO)},
{_levels("tongue", "lang, ").replace("lo(b)", _LO)},
{_levels("whole", "").replace("lo(b)", _LO)},
q AS (SELECT own.lang, own.source, own.signal, CASE WHEN own.total >= 200 THEN [own.q1, own.q2, own.q3] WHEN tongue.total >= 200 THEN [tongue.q1, tongue.q2, tongue.q3] ELSE [whole.q1, whole.q2, whole.q3] END AS q
  FROM own JOIN tongue ON own.lang IS NOT DISTINCT FROM tongue.lang AND own.signal = tongue.signal JOIN whole ON own.signal = whole.signal),
f AS (SELECT q.lang, q.source, r.signal, r.side, CASE WHEN side = 'upper' THEN q[2] + greatest(8 * (q[3] - q[2]), margin) ELSE q[2] - greatest(8 * (q[2] - q[1]), margin) END AS fence FROM q JOIN {_RULES} ON q.signal = r.signal),
bad AS (SELECT doc_id, string_agg(sig.signal || ' ' || side, ', ' ORDER BY list_position(['symbols_per_1000_words', 'word_length_x100', 'repeated_lines_per_1000', 'repeated_words_per_1000'], sig.signal), side DESC) AS failed
  FROM sig JOIN f ON sig.lang IS NOT DISTINCT FROM f.lang AND sig.source IS NOT DISTINCT FROM f.source AND sig.signal = f.signal
  WHERE CASE WHEN side = 'upper' THEN value > fence ELSE value < fence END GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM m LEFT JOIN bad USING (doc_id)
"""

def _round(i: int) -> str:
    """The nearest entries of book i, and book i + 1: means rounded down."""
    far = " + ".join(f"(p.c[{k}] - b.c[{k}]) * (p.c[{k}] - b.c[{k}])" for k in range(1, 5))
    mean = ", ".join(f"(sum(p.c[{k}]) - ((sum(p.c[{k}]) % count(*)) + count(*)) % count(*)) // count(*)" for k in range(1, 5))
    return f"""a{i} AS (SELECT vec_id, part, min({{'d': {far}, 'e': entry}}) AS m FROM p JOIN b{i} b USING (part) GROUP BY vec_id, part),
m{i} AS (SELECT part, m.e AS entry, [{mean}] AS c FROM a{i} JOIN p USING (vec_id, part) GROUP BY ALL),
b{i + 1} AS (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, entry))"""


#: For vectors of 64 components.
OP12 = f"""
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT vec_id, part, v[4 * part + 1:4 * part + 4] AS c FROM x, range(0, 16) t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM p WHERE vec_id IN (SELECT vec_id FROM x ORDER BY vec_id LIMIT 64)),
{_round(0)},
{_round(1)},
{_round(2)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN x USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY part, entry, k)) FROM (SELECT part, entry, unnest(c) AS n, unnest(range(0, 4)) AS k FROM b2)) AS codebooks_sha256
FROM coded JOIN x USING (vec_id) JOIN totals ON x.label IS NOT DISTINCT FROM totals.label
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 of the decimal id, bit by bit.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"""


def _tree(name: str, leaves: str) -> str:
    """All levels of the trees over leaves (g, i, h): a node (g, level, i, h, n) with n nodes on its level."""
    return f"""{name}(g, level, i, h, n) AS (
  SELECT g, 0, i, h, count(*) OVER (PARTITION BY g) FROM {leaves}
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, i // 2, n
)"""


def _proofs(tree: str) -> str:
    """The siblings of each leaf of a tree, from below."""
    return f"""SELECT l.g, l.i, coalesce(string_agg(s.h, '' ORDER BY s.level), '') AS proof FROM {tree} l
  LEFT JOIN {tree} s ON l.g = s.g AND s.n > 1 AND s.i = xor(l.i >> s.level, 1) WHERE l.level = 0 GROUP BY l.g, l.i"""


OP13 = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS changed, {_CRC} AS crc FROM documents),
l AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, leaf, leaf AS h,
  CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN changed ELSE leaf END AS present FROM d),
{_tree("t", "l")},
sub AS (SELECT '' AS g, t.g AS name, row_number() OVER (ORDER BY t.g) - 1 AS i, h FROM t WHERE n = 1),
{_tree("o", "sub")},
top AS (SELECT h AS root FROM o WHERE n = 1),
up AS ({_proofs("t")}),
over AS ({_proofs("o")}),
f(doc_id, g, level, i, h) AS (
  SELECT doc_id, g, 0, i, present FROM l
  UNION ALL
  SELECT f.doc_id, f.g, f.level + 1, f.i // 2, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.i % 2 = 0 THEN f.h || s.h ELSE s.h || f.h END)
  FROM f JOIN (SELECT DISTINCT g, level FROM t WHERE n > 1) x ON f.g = x.g AND f.level = x.level LEFT JOIN t s ON s.g = f.g AND s.level = f.level AND s.i = xor(f.i, 1)
),
g(doc_id, level, i, h) AS (
  SELECT f.doc_id, 0, sub.i, f.h FROM f JOIN t ON f.g = t.g AND f.level = t.level AND t.n = 1 JOIN sub ON sub.name = f.g
  UNION ALL
  SELECT g.doc_id, g.level + 1, g.i // 2, sha256(CASE WHEN s.h IS NULL THEN g.h WHEN g.i % 2 = 0 THEN g.h || s.h ELSE s.h || g.h END)
  FROM g JOIN (SELECT DISTINCT level FROM o WHERE n > 1) x ON g.level = x.level LEFT JOIN o s ON s.level = g.level AND s.i = xor(g.i, 1)
)
SELECT l.doc_id, l.leaf, sub.h AS subroot, top.root, sha256(up.proof || over.proof) AS proof_sha256, g.h AS folded_root, g.h = top.root AS verified
FROM l JOIN sub ON sub.name = l.g JOIN up ON up.g = l.g AND up.i = l.i JOIN over ON over.i = sub.i CROSS JOIN top
JOIN g ON g.doc_id = l.doc_id JOIN (SELECT max(level) AS level FROM o) z ON g.level = z.level
"""

SQL = {
    "op11_quality": OP11,
    "op12_vector_codes": OP12,
    "op13_merkle_manifest": OP13,
    "op1_substring_dedup": OP1,
    "op2_warc": OP2,
    "op3_decontamination": OP3,
    "op5_url_filter": OP5,
    "op10_sharding": OP10,
}
