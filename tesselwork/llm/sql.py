"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .fair_mixing import WEIGHTS

_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[ \t\n\x0B\f\r]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lowered(text: str) -> str:
    """A-Z alone lowered."""
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _normalised(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{_BLANK}+', ' ', 'g'))"


def _parts(source: str, columns: str) -> str:
    """The bodies of source as a whole, and their paragraphs and lines where there are several."""
    pieces = ("[body]", rf"string_split_regex(body, '\n{_BLANK}*\n')", "string_split(body, chr(10))")
    lists = [f"SELECT {columns}, {k} AS kind, [{_normalised('x')} FOR x IN {p} IF {_normalised('x')} <> ''] AS l FROM {source}" for k, p in enumerate(pieces)]
    return f"SELECT {columns}, kind, unnest(l) AS n FROM ({' UNION ALL '.join(lists)}) WHERE kind = 0 OR len(l) > 1"


#: Messages as lines with quote levels, runs of lines as passages, their parts met by what was
#: said; threads by recursion.
OP2 = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text, coalesce(md5(text), '') AS mark FROM conversations),
raws AS (SELECT r, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM m WHERE text IS NOT NULL),
levels AS (
  SELECT r, line, raw, length(regexp_replace(regexp_extract(raw, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
    regexp_replace(raw, '^((?:[ \t]*>)+)[ \t]?', '') AS body
  FROM raws),
turned AS (
  SELECT *, coalesce(lead(level) OVER o, 0) AS following, CASE WHEN level <> lag(level) OVER o THEN 1 ELSE 0 END AS turned
  FROM levels WINDOW o AS (PARTITION BY r ORDER BY line)),
runs AS (
  SELECT *, sum(turned) OVER (PARTITION BY r ORDER BY line) AS run,
    level = 0 AND following > 0 AND regexp_matches(body, '(?i)(wrote|schrieb|a écrit|escribió){_BLANK}*:{_BLANK}*$') AS intro
  FROM turned),
marked AS (
  SELECT r, line, raw, CASE WHEN NOT intro THEN body END AS body, run + intro::INTEGER AS passage, CASE WHEN intro THEN following ELSE level END AS level FROM runs),
passages AS (
  SELECT r, passage, level, coalesce(string_agg(body, chr(10) ORDER BY line), '') AS body, string_agg(raw, chr(10) ORDER BY line) AS raw FROM marked GROUP BY r, passage, level),
own AS (SELECT * FROM passages WHERE level = 0),
quoted AS (SELECT * FROM passages WHERE level > 0),
whole AS (SELECT r, string_agg(body, chr(10) ORDER BY passage) AS body FROM own GROUP BY r),
asked AS (
  SELECT row_number() OVER () AS q, r, passage, level, kind, n, length(n) AS size, conv_id, turn
  FROM ({_parts('quoted', 'r, passage, level')}) JOIN m USING (r)),
said AS (SELECT DISTINCT r, n FROM (SELECT r, n FROM ({_parts('whole', 'r')}) UNION ALL SELECT r, n FROM ({_parts('own', 'r')})) WHERE n IN (SELECT n FROM asked)),
places AS (SELECT DISTINCT n, conv_id, turn FROM said JOIN m USING (r)),
near AS (
  SELECT a.*, p.from_turn FROM asked a LEFT JOIN (
    SELECT q, max(p.turn) AS from_turn FROM asked a JOIN places p ON p.n = a.n AND p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.turn < a.turn GROUP BY q) p USING (q)),
votes AS (SELECT r, passage, kind, conv_id, from_turn AS t, sum(size) AS n FROM near WHERE from_turn IS NOT NULL GROUP BY ALL),
candidates AS (
  SELECT DISTINCT r, passage, kind, conv_id, t FROM votes
  QUALIFY row_number() OVER (PARTITION BY r, passage, kind ORDER BY n DESC, t DESC) = 1 OR t = min(t) OVER (PARTITION BY r, passage, kind)),
held AS (
  SELECT a.r, a.passage, a.kind, c.t, sum(a.size) AS n
  FROM near a JOIN candidates c ON a.r = c.r AND a.passage = c.passage AND a.kind = c.kind
  JOIN places p ON p.n = a.n AND p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.turn = c.t GROUP BY ALL),
totals AS (SELECT r, passage, kind, sum(size) AS total FROM near GROUP BY ALL),
best AS (
  SELECT r, passage, t AS near_turn FROM held JOIN totals USING (r, passage, kind) WHERE 2 * n >= total
  QUALIFY row_number() OVER (PARTITION BY r, passage ORDER BY kind, n DESC, t DESC) = 1),
by_conv AS (
  SELECT n, conv_id, min(turn) AS turn, row_number() OVER (PARTITION BY n ORDER BY conv_id NULLS FIRST) AS k FROM places GROUP BY n, conv_id),
links AS (
  SELECT a.r, a.passage, level, near_turn IS NOT NULL AS here,
    CASE WHEN near_turn IS NOT NULL THEN a.conv_id WHEN f.conv_id IS DISTINCT FROM a.conv_id THEN f.conv_id ELSE s.conv_id END AS from_conv,
    CASE WHEN near_turn IS NOT NULL THEN near_turn WHEN f.conv_id IS DISTINCT FROM a.conv_id THEN f.turn ELSE s.turn END AS from_turn
  FROM (SELECT * FROM asked WHERE kind = 0) a LEFT JOIN best b ON a.r = b.r AND a.passage = b.passage
  LEFT JOIN by_conv f ON f.n = a.n AND f.k = 1 LEFT JOIN by_conv s ON s.n = a.n AND s.k = 2),
found AS (
  SELECT r, count(*) AS n_quotes, count(from_turn) AS n_linked, max(level) AS max_level,
    max(CASE WHEN here AND level = 1 THEN from_turn END) AS reply_to
  FROM links GROUP BY r),
origins AS (
  SELECT r, from_conv AS origin_conv, from_turn AS origin_turn FROM links WHERE NOT here AND from_turn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY from_conv NULLS FIRST, from_turn) = 1),
pieces AS (
  SELECT p.r, p.passage, CASE WHEN p.level = 0 THEN p.body WHEN l.r IS NOT NULL AND l.from_turn IS NULL THEN p.raw END AS piece
  FROM passages p LEFT JOIN links l ON l.r = p.r AND l.passage = p.passage),
clean AS (SELECT r, string_agg(piece, chr(10) ORDER BY passage) AS body FROM pieces WHERE piece IS NOT NULL GROUP BY r),
heads AS (SELECT conv_id, turn, r AS parent FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY mark, r) = 1),
parents AS (
  SELECT m.r, parent, m.turn, m.mark FROM found JOIN m USING (r) JOIN heads h ON h.conv_id IS NOT DISTINCT FROM m.conv_id AND h.turn = reply_to),
threads AS (
  SELECT r, r AS root, 0 AS depth, []::STRUCT(turn BIGINT, mark VARCHAR, r BIGINT)[] AS path FROM m WHERE r NOT IN (SELECT r FROM parents)
  UNION ALL
  SELECT p.r, t.root, t.depth + 1, list_append(t.path, {{'turn': p.turn, 'mark': p.mark, 'r': p.r}}) FROM threads t JOIN parents p ON p.parent = t.r)
SELECT m.conv_id, m.turn, m.role, coalesce(regexp_replace(body, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '') AS text,
  coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::INTEGER AS max_level,
  reply_to, origin_conv, origin_turn, root.turn AS thread_root, depth::INTEGER AS depth,
  (row_number() OVER (PARTITION BY m.conv_id ORDER BY root.turn NULLS FIRST, root.mark, t.root, path) - 1)::BIGINT AS position
FROM m JOIN threads t USING (r) JOIN m root ON root.r = t.root LEFT JOIN clean USING (r) LEFT JOIN found USING (r) LEFT JOIN origins USING (r)
"""

_LEADS = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, 8))

#: Windows of documents and items by size, joined on their words.
OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS r, item_id, least(len(w), 8) AS k, w
  FROM (SELECT item_id, regexp_extract_all({_lowered('text')}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT r, item_id, k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b),
bl AS (SELECT item_id, k, [word, {_LEADS}] AS l FROM bw WINDOW o AS (PARTITION BY r ORDER BY i)),
items AS (SELECT DISTINCT item_id, k, array_to_string(l[1:k], ' ') AS g FROM bl WHERE l[k] IS NOT NULL),
dw AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
dl AS (SELECT r, i, [word, {_LEADS}] AS l FROM dw WINDOW o AS (PARTITION BY r ORDER BY i)),
windows AS (SELECT r, i, k, array_to_string(l[1:k], ' ') AS g FROM dl, (SELECT DISTINCT k FROM items) WHERE l[k] IS NOT NULL),
hits AS (SELECT r, i, k, item_id FROM windows JOIN items USING (k, g)),
hit_words AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS word FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

#: The queue in full; of the levels that would fill the sources up to one more cap each, the
#: first that leaves none above its cap.
OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACE}')), 0)::BIGINT AS size,
    md5('mix' || coalesce(':' || doc_id, '') || coalesce(':' || md5(text), ''))[1:16] AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INTEGER] AS weight
  FROM sizes),
held AS (
  SELECT cap, weight, row_number() OVER o AS k, coalesce(sum(cap) OVER f, 0) AS caps, coalesce(sum(weight) OVER f, 0) AS weights
  FROM s WINDOW o AS (ORDER BY cap / weight), f AS (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT k, cap, weight, ((SELECT sum(source_size) FROM s)::DOUBLE - caps) / ((SELECT sum(weight) FROM s) - weights) AS level FROM held),
level AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM s, level),
q AS (
  SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT q.*, round, (cum + source_size * round::DOUBLE) / target AS finish FROM q, (VALUES (0), (1), (2)) rounds(round)
  WHERE size > 0 AND target > 0 AND (round = 0 OR source_size * round::DOUBLE <= target)),
summed AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, key, doc_id::VARCHAR, size ROWS UNBOUNDED PRECEDING) AS upto FROM e),
mixed AS (SELECT r, count(*) AS repeats FROM summed WHERE upto <= (SELECT sum(size) FROM d) GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(repeats, 0))::BIGINT AS taken FROM q LEFT JOIN mixed USING (r)
"""

#: Every 200-byte string of every text in hexadecimal, cut from blocks of 1000 starts.
OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (
  SELECT r, base, substr(h, 2 * base + 1, 2400) AS piece
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199, 1000)) AS base FROM d)),
starts AS (
  SELECT r, base + offs AS p, md5_number(substr(piece, 2 * offs + 1, 400)) AS key
  FROM (SELECT r, base, piece, unnest(range(0, least(1000, len(piece) // 2 - 199))) AS offs FROM blocks)),
again AS (SELECT r, p FROM starts JOIN (SELECT key FROM starts GROUP BY key HAVING count(*) > 1) USING (key)),
opened AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM again),
runs AS (
  SELECT r, min(p) AS lo, max(p) + 200 AS hi
  FROM (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM opened) GROUP BY r, run),
gaps AS (
  SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS after FROM runs),
kept AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS head
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Words and lines as rows; lines are counted by host in the words of their lowered form.
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{_SPACE}') AS w FROM d)),
threes AS (SELECT r, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, third IS NOT NULL AND count(*) OVER (PARTITION BY r, word, second, third) > 1 AS again FROM threes),
near AS (SELECT r, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS repeated FROM twice WINDOW o AS (PARTITION BY r ORDER BY i)),
counts AS (SELECT r, count(*) AS n_words, count(*) FILTER (repeated) AS n_repeat_words FROM near GROUP BY r),
lines AS (
  SELECT r, source, line, array_to_string(w, ' ') AS norm, len(w) AS n
  FROM (SELECT *, regexp_extract_all({_lowered('line')}, '{_SPACE}') AS w FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(w) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
often AS (SELECT source, norm, count(DISTINCT r) AS n_docs FROM lines GROUP BY source, norm),
common AS (
  SELECT source, norm FROM often WHERE n_docs > 10),
removed AS (
  SELECT r, sum(n) AS n_common_words FROM lines l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY r),
stats AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_common_words, 0)::BIGINT AS n_common_words
  FROM d LEFT JOIN counts USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_common_words <= 70 * n_words AS kept
FROM stats
"""

# XXH64: fixed values of the hash, then its steps as SQL on UHUGEINT, whose products do not overflow.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_MOD = 1 << 64


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {_u(_MOD)})"


def _rotated(x: str, by: int) -> str:
    """x turned left: multiplied modulo 2**64 - 1, which is wrong for x = 2**64 - 1 alone."""
    return f"((({x}) * {_u(1 << by)}) % {_u(_MOD - 1)})"


def _round(a: str, lane: str) -> str:
    return _mod(f"{_rotated(_mod(f'{a} + {_mod(f"{lane} * {_u(_P2)}")}'), 31)} * {_u(_P1)}")


def _lane(at: str, size: int) -> str:
    """Bytes of the hexadecimal text x as a number, the last one first."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _stripes(i: int, start: int) -> str:
    """One of the four sums over all stripes of 32 bytes."""
    lanes = f"list_transform(range(n // 32), lambda t: {_lane(f'32 * t + {8 * i}', 8)})"
    return f"list_reduce(list_concat([{_u(start % _MOD)}], {lanes}), lambda a, l: {_round('a', 'l')})"


def _merged(h: str, v: str) -> str:
    return _mod(f"{_mod(f'xor({h}, {_round(_u(0), v)}) * {_u(_P1)}')} + {_u(_P4)}")


def _xxh64(strings: str, seed: int = 42) -> str:
    """CTEs from strings (s) to hashed (s, h): the XXH64 of each as UBIGINT."""
    starts = (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)
    long = _mod(" + ".join(_rotated(f"v{i}", by) for i, by in enumerate((1, 7, 12, 18))))
    for i in range(4):
        long = _merged(long, f"v{i}")
    eights = f"list_transform(range((n % 32) // 8), lambda t: {_lane('n // 32 * 32 + 8 * t', 8)})"
    ones = f"list_transform(range(n % 4), lambda t: {_lane('n // 4 * 4 + t', 1)})"
    eight = _mod(f"{_mod(f"{_rotated(f'xor(a, {_round(_u(0), "l")})', 27)} * {_u(_P1)}")} + {_u(_P4)}")
    four = _mod(f"{_mod(f"{_rotated(f'xor(h, {_mod(f"{_lane('n // 8 * 8', 4)} * {_u(_P1)}")})', 23)} * {_u(_P2)}")} + {_u(_P3)}")
    one = _mod(f"{_rotated(f'xor(a, {_mod(f"l * {_u(_P5)}")})', 11)} * {_u(_P1)}")
    return f"""
bytes AS (SELECT s, hex(s) AS x, strlen(s) AS n FROM ({strings})),
stripes AS (SELECT *, {', '.join(f'CASE WHEN n >= 32 THEN {_stripes(i, v)} END AS v{i}' for i, v in enumerate(starts))} FROM bytes),
begun AS (SELECT s, x, n, {_mod(f"CASE WHEN n >= 32 THEN {long} ELSE {_u((seed + _P5) % _MOD)} END + n::UHUGEINT")} AS h FROM stripes),
eights AS (SELECT s, x, n, list_reduce(list_concat([h], {eights}), lambda a, l: {eight}) AS h FROM begun),
fours AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM eights),
ones AS (SELECT s, list_reduce(list_concat([h], {ones}), lambda a, l: {one}) AS h FROM fours),
mixed1 AS (SELECT s, {_mod(f"xor(h, h // {_u(1 << 33)}) * {_u(_P2)}")} AS h FROM ones),
mixed2 AS (SELECT s, {_mod(f"xor(h, h // {_u(1 << 29)}) * {_u(_P3)}")} AS h FROM mixed1),
hashed AS MATERIALIZED (SELECT s, xor(h, h // {_u(1 << 32)})::UBIGINT AS h FROM mixed2)"""


#: Hashes of all shingles, the bits set in over half of them, all pairs of fingerprints within
#: two bits, and their components by recursion.
OP6 = rf"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lowered('text')}, '{_SPACE}') AS w FROM documents),
words AS (SELECT r, len(w) AS k, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM m),
shingles AS MATERIALIZED (
  SELECT r, s FROM (SELECT r, i, k, concat_ws(' ', s, lead(s, 1) OVER o, lead(s, 2) OVER o) AS s FROM words WINDOW o AS (PARTITION BY r ORDER BY i))
  WHERE i <= greatest(k - 2, 1)),{_xxh64('SELECT DISTINCT s FROM shingles')},
counted AS (SELECT r, ({' + '.join(f'CASE WHEN 2 * count(*) FILTER (WHERE (h >> {b}) & 1 = 1) > count(*) THEN {_u(1 << b)} ELSE {_u(0)} END' for b in range(64))})::UBIGINT AS fp FROM shingles JOIN hashed USING (s) GROUP BY r),
prints AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM m LEFT JOIN counted USING (r)),
f AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM prints GROUP BY fp),
links AS MATERIALIZED (SELECT x.fp AS a, y.fp AS b FROM f x JOIN f y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= 2),
walk AS (SELECT fp AS a, fp AS b FROM f UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a),
named AS (SELECT a, min(low) AS component_id FROM walk JOIN f ON b = fp GROUP BY a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN named ON fp = a
"""

ORACLE_SQL = {"op2_quotation_linking": OP2, "op3_decontamination": OP3, "op5_fair_mixing": OP5, "op6_simhash_popcount": OP6, "op7_suffix_dedup": OP7, "op8_line_rules": OP8}
