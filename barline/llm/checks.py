"""Check SQL (DuckDB) for the queries of this package that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(text, '{UPPER}', '{UPPER.lower()}')"

OP1 = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
rows_ AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM met JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
), copies AS (SELECT s, count(*) AS c FROM (SELECT list_sort(s) AS s FROM sets) GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id,
  (CASE WHEN d.n = 0 THEN 1 ELSE c.c END)::BIGINT AS n_copies
FROM sizes d JOIN sets t USING (doc_id) JOIN copies c ON c.s = list_sort(t.s)
"""

OP6 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
found AS (SELECT r, i, p.size, item FROM places p JOIN windows v ON p.size = v.size AND array_to_string(p.w[i:i + p.size - 1], ' ') = v.win),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""

# Scripts without blanks: one character is a unit there; elsewhere a unit is what lies between such characters in a word.
WIDE = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"

# Lines by (doc_id, place); equal by lower-cased words; near, from a weight of eight (a wide unit is one, another two): one
# unit replaced, or one inserted or deleted.
OP8 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, k, line, regexp_extract_all({LOWERED.replace("text", "line")}, '[^\x20\x09-\x0D]+') AS w FROM lines
), different AS (
  SELECT w, min(struct_pack(d := doc_id, k := k)) AS first, flatten(list_transform(w, lambda x: regexp_extract_all(x, '[{WIDE}]|[^{WIDE}]+'))) AS u
  FROM worded WHERE len(w) > 0 GROUP BY w
), heavy AS (
  SELECT w, first, u, len(u) AS n FROM different WHERE list_sum(list_transform(u, lambda x: CASE WHEN regexp_full_match(x, '[{WIDE}]') THEN 1 ELSE 2 END)) >= 8
), placed AS (
  SELECT w, n, first, i, u[1:i - 1] || u[i + 1:n] AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM heavy)
), replaced AS (
  SELECT w, first FROM (SELECT w, first, min(first) OVER (PARTITION BY i, rest) AS best FROM placed) WHERE best < first
), inserted AS (
  SELECT p.w AS long_, p.first AS long_first, d.w AS short_, d.first AS short_first FROM placed p JOIN heavy d ON d.u = p.rest
), near AS (
  SELECT w FROM replaced
  UNION SELECT long_ FROM inserted WHERE short_first < long_first
  UNION SELECT short_ FROM inserted WHERE long_first < short_first
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY k) AS text FROM worded
  WHERE len(w) = 0 OR (struct_pack(d := doc_id, k := k) IN (SELECT first FROM different) AND w NOT IN (SELECT w FROM near))
  GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

# CRC-32 by its table: the reflected polynomial 0xEDB88320, eight steps for each of 256 bytes.
CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def _jump(shards: int) -> str:
    """The walk of a key until it passes the last shard, as a fold over shard numbers."""
    r = DRAW.format("key || ':' || w.after")
    return f"""list_reduce(list_transform(range({shards}), lambda i: {{'at': -1::BIGINT, 'after': 0::BIGINT}}), lambda w, i:
      CASE WHEN w.after < {shards} THEN {{'at': w.after, 'after': ((w.after + 1) * 2147483648) // (({r} >> 1) + 1)}} ELSE w END,
      {{'at': -1::BIGINT, 'after': 0::BIGINT}}).at::INTEGER"""


OP3 = f"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, {CRC_STEP.format("c")}, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents
), rows_ AS (
  SELECT doc_id, len(h) // 2 + 1 AS size, key,
    xor(4294967295, list_reduce(list_transform(list_filter(string_split(regexp_replace(h, '(..)', '\\1 ', 'g'), ' '), lambda x: x <> ''),
      lambda x: try_cast('0x' || x AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS text_crc32,
    {_jump(16)} AS shard, {_jump(17)} AS grown_shard
  FROM docs, crc
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY {DRAW.format("key || ':lane'")} % 256, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM rows_
"""

OP4 = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role NOT IN ('system', 'developer')),
parts AS (
  SELECT t.conv_id, speaker, coalesce(floor(turn / 64)::BIGINT, 9223372036854775807) AS chunk, turn, role, text, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role IN ('system', 'developer') THEN 'system'
      ELSE 'user name=' || replace(replace(role, '<|', '<\|'), chr(10), ' ') END || chr(10) AS head,
    replace(text, '<|', '<\|') || '<|im_end|>' AS body
  FROM turns t JOIN speakers USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(len(head) + len(body) + 1) OVER (PARTITION BY conv_id, speaker, chunk ORDER BY turn NULLS LAST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM parts
)
SELECT conv_id, speaker, chunk, count(*)::INTEGER AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS text,
  coalesce(string_agg((pos + len(head)) || '-' || (pos + len(head) + len(body)), ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, chunk
"""

OP5 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
), roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a), degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON a = vec_id LEFT JOIN degree ON x = vec_id
"""

# A fold over each conversation's rows that holds, for each state, the least (cost, audit) and its turns. Inserts come
# before each row and at the end: first into `user`, then into `assistant`.
NOWHERE = "{'c': 1000000000::BIGINT, 'a': '', 'o': ''}"


def _say(state: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': (w.{state}.c + {cost})::BIGINT, 'a': w.{state}.a || '{letter}', 'o': w.{state}.o || chr(10) || {line}}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _drop(state: str) -> str:
    return f"{{'c': w.{state}.c + 4, 'a': w.{state}.a || 'D', 'o': w.{state}.o}}"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN r.ok AND r.initial = '{initial}' THEN {_say(state, 'r.late', 'K', 'r.line')} ELSE {NOWHERE} END"


def _reroled(state: str, role: str) -> str:
    return f"CASE WHEN r.ok THEN {_say(state, '3 + r.late', 'R', f"'{role}:' || r.said")} ELSE {NOWHERE} END"


_BEFORE_USER = ("n", "s", "a")
_MOVES = {
    "n": _drop("n"),
    "s": _least(_drop("s"), _kept("n", "s")),
    "u": _least(_drop("u"), *(_kept(q, "u") for q in _BEFORE_USER), *(_reroled(q, "user") for q in _BEFORE_USER)),
    "a": _least(_drop("a"), _kept("u", "a"), _reroled("u", "assistant")),
}
_STATES = ", ".join(f"'{q}': CASE WHEN r.kind = 'row' THEN {move}" + {
    "u": f" WHEN r.kind = 'user' THEN {_least('w.u', *(_say(x, '3', 'I', repr('user:')) for x in _BEFORE_USER))}",
    "a": f" WHEN r.kind = 'assistant' THEN {_least('w.a', _say('u', '3', 'I', repr('assistant:')))}",
}.get(q, "") + f" ELSE w.{q} END" for q, move in _MOVES.items())
_EMPTY = "'initial': '', 'ok': false, 'late': 0, 'line': '', 'said': ''"
_NONE = ", ".join(f"'{q}': {NOWHERE}" for q in "nsua")
_INSERTS = f"[{{'kind': 'user', {_EMPTY}, {_NONE}}}, {{'kind': 'assistant', {_EMPTY}, {_NONE}}}]"
_ROW = f"{{'kind': 'row', 'initial': x.initial, 'ok': x.fault NOT IN ('b', 'd'), 'late': CASE x.fault WHEN 't' THEN 3 ELSE 0 END, 'line': x.role || ':' || x.text, 'said': x.text, {_NONE}}}"

OP11 = rf"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, {CRC_STEP.format("c")}, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 20 AS k FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, i, role[1] AS initial, regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS final,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), faulted AS (
  SELECT *, CASE WHEN final = '' THEN 'b' WHEN again THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault FROM judged
), folded AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce({_INSERTS} || flatten(list_transform(list(struct_pack(initial, fault, role, text) ORDER BY i), lambda x: [{_ROW}] || {_INSERTS})),
      lambda w, r: {{'kind': '', {_EMPTY}, {_STATES}}},
      {{'kind': '', {_EMPTY}, {_NONE.replace(NOWHERE, "{'c': 0::BIGINT, 'a': '', 'o': ''}", 1)}}}) AS w
  FROM faulted GROUP BY conv_id
), best AS (SELECT *, {_least("w.n", "w.a")} AS least FROM folded)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(least.c, 0)::BIGINT AS cost,
  coalesce(least.a, '') AS audit, sha256(coalesce(substr(least.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""

CHECKS = {
    "op1_ngram_jaccard": OP1,
    "op3_jump_sharding": OP3,
    "op4_perspective_rotation": OP4,
    "op5_embedding_cells": OP5,
    "op6_fm_decontamination": OP6,
    "op8_line_dedup": OP8,
    "op11_conversation_repair": OP11,
}
