"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from siteframe.llm import chat, decontaminate, mixture, quality, urlrules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINE = "trim(regexp_replace(regexp_replace(" + _LOWER.format("l") + r", '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"

_TURN = f"{1 << 64}::HUGEINT"
_SHINGLE = " + ".join(f"coalesce(cs[i + {i + 1}], 0) * {f}::HUGEINT % {_TURN}" for i, f in enumerate(quality.WORD_FACTORS))
_FACTORS = ", ".join(f"({j}, {f}::HUGEINT)" for j, f in enumerate(quality.SIGN_FACTORS))

QUALITY = rf"""
WITH t AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS host, coalesce(text, '') AS text,
         md5(coalesce(text, '')) AS th, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {quality.REPEAT_WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {quality.REPEAT_WINDOW - 1})) AS i FROM t)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(generate_series(i, i + {quality.REPEAT_WINDOW - 1})) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT host, th, h, no, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT host, th, l, no, ('0x' || substr(md5({_LINE}), 1, 15))::BIGINT AS h
        FROM (SELECT host, th, unnest(ls) AS l, unnest(generate_series(1, len(ls))) AS no
              FROM (SELECT DISTINCT host, th, ls FROM t)))),
likely AS (
  SELECT host, h, docs FROM (SELECT host, h, count(DISTINCT th) AS docs FROM lines GROUP BY host, h)
  JOIN (SELECT host, count(*) AS on_host FROM t GROUP BY host) USING (host)
  WHERE docs >= {quality.MIN_DOCS} AND docs >= {quality.MIN_SHARE}::DOUBLE * on_host),
holders AS (SELECT DISTINCT host, h, th FROM lines JOIN likely USING (host, h)),
codes AS (
  SELECT th, list_transform(ws, lambda w: ('0x' || substr(md5(w), 1, 15))::BIGINT::HUGEINT) AS cs
  FROM (SELECT DISTINCT th, ws FROM t WHERE th IN (SELECT th FROM holders))),
shingles AS (
  SELECT th, ({_SHINGLE}) % {_TURN} // 16 AS s
  FROM (SELECT th, cs, unnest(range(0, greatest(len(cs) - {quality.SHINGLE}, 0) + 1)) AS i FROM codes)),
signs AS (
  SELECT th, j, min((s * factor) % {_TURN}) // 2 AS sign
  FROM shingles, (VALUES {_FACTORS}) AS f(j, factor) GROUP BY th, j),
spread AS (
  SELECT host, h, count(*) AS signs FROM (SELECT DISTINCT host, h, j, sign FROM holders JOIN signs USING (th)) GROUP BY host, h),
frequent AS (
  SELECT host, h FROM likely JOIN spread USING (host, h)
  WHERE {1 + quality.COPY}::DOUBLE * (signs - {quality.SIGNS}) > {(1 - quality.COPY) * quality.SIGNS}::DOUBLE * (docs - 1)),
cuts AS (SELECT host, th, sum(words)::BIGINT AS removed_words FROM lines JOIN frequent USING (host, h) GROUP BY host, th),
counts AS (
  SELECT doc_id, host, th, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT c.*, coalesce(removed_words, 0) AS removed_words,
         n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_REPEAT_PERCENT} * n_words AS base_failed
  FROM counts c LEFT JOIN cuts USING (host, th))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
       NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {quality.MIN_WORDS}
                                OR n_words - removed_words < {quality.MIN_REST}::DOUBLE * n_words)) AS kept
FROM judged"""


def url_rules() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n    ".join(f"({r.number}, {quoted(r.name)}, {quoted(r.action)}, {quoted(r.regex)}, {r.host_rule}, {r.length})"
                          for r in urlrules.compile_rules())
    return rf"""
WITH rules(number, name, action, regex, host_rule, length) AS (VALUES
    {rows}),
p AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hits AS (SELECT page_id, rules.* FROM p, rules WHERE regexp_matches(host || path, regex)),
best AS (
  SELECT page_id, arg_min(name, -1000 * length + number) FILTER (host_rule) AS rule,
         arg_min(action, -1000 * length + number) FILTER (host_rule) AS action,
         count(*) FILTER (NOT host_rule AND action = 'block') AS blocks, count(*) FILTER (NOT host_rule AND action = 'allow') AS allows
  FROM hits GROUP BY page_id)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN best.action WHEN blocks > 0 AND allows = 0 THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN best USING (page_id)"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(payload) AS hex FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source),
w AS (SELECT *, list_extract({list(map(float, mixture.WEIGHTS))}, (1 + (k - 1) % {len(mixture.WEIGHTS)})::INT)::DOUBLE AS weight,
             {mixture.CAP}::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER a AS n, sum(most) OVER a AS held, sum(weight) OVER a AS held_weight FROM w
      WINDOW a AS (ORDER BY most / weight, k ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT n, ({mixture.SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) - (held - most)) / ((SELECT sum(weight) FROM w) - (held_weight - weight)) AS level,
         most / weight AS ratio FROM o),
lev AS (SELECT coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY n LIMIT 1), 0) AS level),
t AS (SELECT source, source_size, least(weight * level, most) AS target FROM w, lev),
r AS (SELECT d.*, source_size, target, CASE WHEN size = 0 OR source_size = 0 THEN 0 ELSE target / source_size END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(rate + {0.5 / mixture.UNIT!r}) AS whole,
             greatest(round((rate - floor(rate + {0.5 / mixture.UNIT!r})) * {mixture.UNIT}), 0)::BIGINT AS part,
             ceil(count(*) OVER (PARTITION BY source, size) / {mixture.BUCKET}.0)::BIGINT AS fan FROM r),
g AS (SELECT *, sum(part) OVER (PARTITION BY source ORDER BY size, (tie >> 8) % fan, tie, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM f)
SELECT doc_id, size, source_size, target,
       size * (whole::BIGINT + (upto + {mixture.UNIT // 2}) // {mixture.UNIT} - (upto - part + {mixture.UNIT // 2}) // {mixture.UNIT}) AS taken
FROM g"""

_SAYS = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAYS}'), (-7, 1, 'assistant', '{_SAYS}')),
f AS (
  SELECT *, {len(chat.TURN + chat.TEXT_BEGIN + chat.TURN_END) + 1} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})
            + CASE WHEN role = '{chat.LEARNT_ROLE}' THEN {len(chat.LOSS_BEGIN + chat.LOSS_END)} ELSE 0 END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{chat.LEARNT_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{chat.LEARNT_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
items AS (SELECT item_id, ws, least({decontaminate.WINDOW}, len(ws)) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT *, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM items)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM items))),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, w)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontaminate.MIN_SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

PREFIX_TRIE = """
WITH t AS (
  SELECT conv_id AS conv, turn, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv, list({'id': id, 'n': length(text)} ORDER BY turn NULLS FIRST, id) AS turns FROM t GROUP BY conv),
h AS (
  SELECT c.conv, c.turns, coalesce(b.turns, []) AS base, c.h::BIGINT AS h
  FROM (SELECT o.*, crc.h FROM own o JOIN crc USING (conv)) c LEFT JOIN own b ON b.conv = c.conv - c.conv % 100),
r AS (SELECT conv, base[1:h] || turns[h + 1:] AS turns FROM h),
p AS (SELECT conv, turns, unnest(generate_series(0, len(turns))) AS d FROM r),
k AS (
  SELECT conv, d, len(turns) AS whole, sha256(array_to_string(list_transform(turns[1:d], lambda x: x.id), ',')) AS key,
         CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: x.id), ',')) END AS up,
         CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS chars FROM p),
nodes AS (
  SELECT key, d AS depth, any_value(up) AS up, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (d = whole), '')) AS ends_sha256
  FROM k GROUP BY key, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
told AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN kids c ON c.up = n.key),
above AS (
  SELECT DISTINCT a.key AS top, b.key AS below FROM (SELECT DISTINCT conv, key, d FROM k) a
  JOIN (SELECT k.conv, k.key, k.d FROM k JOIN nodes ON nodes.key = k.key AND nodes.conv_id = k.conv) b ON a.conv = b.conv AND a.d <= b.d),
sums AS (
  SELECT a.top AS key, sum((t.n_children = 0)::INT) AS n_leaves, sum(t.saved) AS saved_tokens FROM above a JOIN told t ON t.key = a.below GROUP BY a.top)
SELECT t.conv_id, t.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, t.ends_sha256
FROM told t LEFT JOIN nodes u ON u.key = t.up JOIN sums s ON s.key = t.key"""

# CRC-32 of the decimal number, bit by bit.
PREFIX_TRIE = PREFIX_TRIE.replace("own AS (", """crc AS (
  SELECT conv, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv FROM t)),
own AS (""", 1)

_TERM = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERM} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
tf AS (SELECT row, doc_id, term, len(ts)::BIGINT AS words, count(*) AS tf FROM (SELECT row, doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
b AS (SELECT item_id, unnest({_TERM}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
x AS (
  SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * words * n) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 20"""
