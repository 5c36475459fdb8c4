"""DuckDB SQL for the queries of this subpackage that SQL can express at a bearable cost.

The others are held against brute force in tests: packing and token counts
against the tokenizers library,
and the two trained operators by held-out accuracy.
"""

from .feistel import _keys
from .line_clean import BOILERPLATE
from .secrets_scan import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, WEAK_ID, WEAK_KEY

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_ASCII_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.doc_id <> b.doc_id AND len(a.s) > 0
  AND 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s))
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
r AS (SELECT doc_id AS node, doc_id AS low FROM s UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """(doc_id, kind number, start, stop) of the leftmost non-overlapping matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {KINDS.index(kind)} AS k, start, start + length(hit) AS stop FROM (
  SELECT doc_id, hit, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS start FROM (
    SELECT doc_id, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS hit, unnest(g[:len(h)]) AS gap, unnest(list_concat([NULL::VARCHAR], h[:len(h) - 1])) AS before
    FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM t) WHERE len(h) > 0)) WHERE {keep}"""


_NAMES = "['" + "', '".join(KINDS) + "'][k + 1]"
_VALUE = ASSIGN.replace("'", "''")
_BESIDE = "EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.k IN {} AND q.stop >= p.start - 200 AND q.start <= p.stop + 200)"
_ID, _SECRET = _BESIDE.format("(1, 3)"), _BESIDE.format("(0, 2, 4)")

_SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS ({_spans("assign", ASSIGN, f"length(regexp_extract(hit, '{_VALUE}', 2)) >= 6")} UNION ALL {_spans("access", ACCESS)} UNION ALL {_spans("hex", HEX)}),
p AS (SELECT * FROM b UNION ALL {_spans("weak_id", WEAK_ID)} UNION ALL
  {_spans("weak_key", WEAK_KEY, "length(hit) = 40 AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')")} UNION ALL {_spans("endpoint", ENDPOINT)}),
x AS (SELECT * FROM p WHERE k <= 2 OR (k = 3 AND {_SECRET}) OR (k = 4 AND {_ID}) OR (k = 5 AND {_ID} AND {_SECRET})),
n AS (SELECT doc_id, sum((k = 0)::INT) AS n_assign, sum((k = 1)::INT) AS n_access, sum((k = 2)::INT) AS n_hex,
  string_agg({_NAMES} || ':' || start || ':' || stop, ',' ORDER BY start, k) AS base FROM b GROUP BY doc_id),
m AS (SELECT doc_id, string_agg({_NAMES} || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM x GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN m ON m.doc_id = t.doc_id
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OVERLAPS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
u AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT u.doc_id, u.n, u.i, v.item_id FROM u JOIN v ON v.win = u.win AND v.n = u.n),
x AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
"""

_NOTICES = "|".join(BOILERPLATE)
_LINES = rf"""
WITH t AS (SELECT doc_id, text, {_ASCII_WORDS.format("text")} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
l AS (SELECT doc_id, i, line, {_ASCII_WORDS.format("line")} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS repeated, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
  len(regexp_extract_all(line, '\s[|>»•·/]\s')) AS bars, len(regexp_extract_all(line, '\p{{Lu}}')) AS upper, len(regexp_extract_all(line, '\p{{L}}')) AS letters FROM l WHERE len(lw) > 0),
f AS (SELECT doc_id, sum(repeated::INT) AS dup, sum(CASE WHEN repeated OR symbols >= 0.3 * len(lw) + 1 OR (bars >= 2 AND 2 * bars >= len(lw) // 2)
    OR (len(lw) <= 30 AND regexp_matches(line, '(?i){_NOTICES}')) OR (len(lw) >= 4 AND upper > 0.7 * letters AND upper > 0)
    OR (len(lw) >= 10 AND NOT regexp_matches(line, '[.!?,;:。！？]')) THEN length(array_to_string(lw, '')) ELSE 0 END) AS lost FROM r GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5))),
h AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM g WHERE twice) GROUP BY doc_id),
b AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars FROM t LEFT JOIN f ON f.doc_id = t.doc_id LEFT JOIN h ON h.doc_id = t.doc_id),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM k
"""

_REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, b[p + 1:p + 100] AS s FROM (SELECT doc_id, b, unnest(range(n - 99)) AS p FROM n WHERE n >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS turn FROM w) WHERE turn > 1),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1))::INT AS fresh FROM r)),
g AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM i GROUP BY doc_id, island),
k AS (SELECT n.doc_id, g.a, n.b[coalesce(lag(g.e) OVER (PARTITION BY n.doc_id ORDER BY g.a), 0) + 1:g.a] AS piece FROM n JOIN g ON g.doc_id = n.doc_id),
x AS (SELECT doc_id, string_agg(hex(piece), '' ORDER BY a) AS kept FROM k GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_spans, sum(e - a)::BIGINT AS n_removed, max(e) AS last FROM g GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(n.b[coalesce(last, 0) + 1:n.n]))) AS kept_sha256 FROM n LEFT JOIN x ON x.doc_id = n.doc_id LEFT JOIN y ON y.doc_id = n.doc_id
"""

_WRAP = "18446744073709551616::UHUGEINT"


def _mixed(x: str) -> str:
    """splitmix64's finaliser, each step bound by a lambda of its own."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"list_transform([{x}], lambda v: (xor(v, v >> {shift})::UHUGEINT * {factor}::UHUGEINT % {_WRAP})::UBIGINT)[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> 31))[1]"


def _shards(shards: int, seed: int) -> str:
    keys = ", ".join(f"{int(k)}::UBIGINT" for k in _keys(seed))
    once = f"""list_reduce([{keys}], lambda s, k: {{'l': s.r, 'r': xor(s.l, {_mixed("xor(s.r, k.r)")} & mask)}}, {{'l': x >> half, 'r': x & mask}})"""
    once = once.replace(f"[{keys}]", f"list_transform([{keys}], lambda k: {{'l': 0::UBIGINT, 'r': k}})")
    crc = "xor(list_reduce(list_transform(range(octet_length(b)), lambda i: ('0x' || hex(b[i + 1:i + 1]))::INT::UBIGINT), lambda c, y: xor(c >> 8, crcs[((xor(c, y) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"
    step = "list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
    return f"""
WITH RECURSIVE q AS (SELECT list({step}::UBIGINT ORDER BY i) AS crcs FROM range(256) AS t(i)),
d AS (SELECT doc_id, octet_length(b)::BIGINT + 1 AS size, {crc} AS text_crc32 FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), q),
n AS (SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS row_number FROM d),
c AS (SELECT total, half, ((1::UBIGINT << half) - 1)::UBIGINT AS mask FROM (SELECT count(*)::UBIGINT AS total, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2)::UBIGINT AS half FROM d)),
w AS (SELECT row_number, row_number::UBIGINT AS x, true AS first FROM n UNION ALL
  SELECT row_number, (s.r << half) | s.l, false FROM (SELECT row_number, half, {once} AS s FROM w, c WHERE first OR x >= total))
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {shards})::INT AS shard, (x // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, n.row_number
  FROM n JOIN w ON w.row_number = n.row_number, c WHERE NOT first AND x < total
"""


_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""

_PHRASES = rf"""
WITH p AS (SELECT lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
o AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, a, k, n, unnest(range(1, k - n + 2)) AS i FROM c, (VALUES (2), (3)) AS t(n) WHERE n < k) GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN o ON o.lang = c.lang AND o.phrase = c.phrase WHERE 100::HUGEINT * coalesce(around, 0) < 80::HUGEINT * a),
x AS (SELECT d.lang, d.phrase, d.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * d.a // (l.f + r.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM d) d
  JOIN g l ON l.lang = d.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN g r ON r.lang = d.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b JOIN t ON t.lang = b.lang QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op5_shard": _shards(8, 20240201), "op8_suffix_dedup": _REPEATS, "op9_line_clean": _LINES, "op2_near_duplicates": _NEAR_DUPLICATES, "op6_secrets": _SECRETS, "op10_decontaminate": _OVERLAPS, "op11_phrases": _PHRASES, "op13_hard_negatives": _NEGATIVES}
