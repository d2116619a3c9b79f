"""SQL of the fingerprints and of the conversation repair for another engine, in pieces: a text without macros must hold it all."""

from __future__ import annotations

from declq.llm import fingerprints as fp

_ANCHORS = ", ".join(f"'{w}'" for w in fp.ANCHORS)


def _signed(source: str, text: str, name: str) -> str:
    """CTEs that end with `name`: `source` with s, the distinct signatures of its column `text`."""
    after = ", ".join(f"k[p - j + {x + 1}]" for x in range(fp.CHAIN))
    here = ", ".join(f"k[q + {x}]" for x in range(fp.CHAIN + 1))
    return f"""
{name}_w AS (SELECT *, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}),
{name}_c AS (SELECT *, list_transform(w, lambda x: x IN ({_ANCHORS})) AS c, range(1, len(w) + 1) AS i FROM {name}_w),
{name}_k AS (SELECT *, list_filter(i, lambda x: c[x]) AS a, list_filter(i, lambda x: NOT c[x]) AS o, list_filter(w, lambda x, j: NOT c[j]) AS k FROM {name}_c),
{name}_r AS (SELECT *, list_transform(o, lambda p, q: p - 1 - CASE WHEN p > q THEN a[p - q] ELSE 0 END) AS r FROM {name}_k),
{name} AS (
  SELECT * EXCLUDE (w, c, i, a, o, k, r), list_distinct(list_concat(
    list_transform(a, lambda p, j: concat(w[p], ':', concat_ws(' ', {after}))),
    list_filter(list_transform(o, lambda p, q: CASE WHEN r[q] % {fp.GAP} = 0 AND (r[q] > 0 OR p = q) THEN concat(':', concat_ws(' ', {here})) END), lambda x: x IS NOT NULL))) AS s
  FROM {name}_r)"""


def _likeness(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    far = f"len({a}) = 0 OR len({b}) = 0 OR abs(floor(log2(len({a}))) - floor(log2(len({b})))) >= {fp.APART}"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN {far} THEN 0.0 ELSE {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) END::DOUBLE"


_MD5 = "md5(array_to_string(list_sort({}), chr(10)))"
FINGERPRINTS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_signed('docs', 'text', 'signed')},
paired AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text, coalesce(lead(s) OVER o, first_value(s) OVER o) AS next_s
  FROM signed WINDOW o AS (ORDER BY doc_id DESC)),
edits AS (
  SELECT doc_id, length(text) AS n, s AS own, next_s,
         substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM paired),
{_signed('edits', 'edited', 'done')}
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_MD5.format('own')} AS fingerprint, {_MD5.format('s')} AS edited_fingerprint,
       {_likeness('own', 's')} AS near_edited, {_likeness('own', 'next_s')} AS near_next
FROM done
"""

# crc32 by bits: a byte of the text is mixed in, then eight steps (-1) follow.
_KEY = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
_BITS = f"flatten(list_transform(string_split({_KEY}, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
_STEP = "CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, 3988292384 * (h & 1)) END"
_CRC = f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_BITS}), lambda h, x: {_STEP}))"

#: Ways to a state: condition, state before, cost, letter, what the repaired text gains. States are columns n, s, u and a.
_Way = tuple[str, str, str, str, str]
_NONE = "struct_pack(c := CAST(1000000000 AS BIGINT), t := '', r := '')"
_START = "struct_pack(c := CAST(0 AS BIGINT), t := '', r := '')"


def _best(*ways: _Way) -> str:
    """The least: structs of cost, audit and repaired text compare in this order."""
    each = [f"CASE WHEN {c} THEN struct_pack(c := {s}.c + {cost}, t := {s}.t || '{letter}', r := {s}.r || {turn}) ELSE {_NONE} END" for c, s, cost, letter, turn in ways]
    return f"list_min([{', '.join(each)}])"


def _kept(state: str, initial: str) -> _Way:
    return (f"NOT must_go AND k = '{initial}'", state, "pay", "K", "chr(10) || role || ':' || text")


def _reroled(state: str, initial: str, role: str) -> _Way:
    return (f"NOT must_go AND k <> '{initial}'", state, "pay + 1", "R", f"chr(10) || '{role}:' || text")


def _inserted(state: str, role: str) -> _Way:
    return ("true", state, "5", "I", f"chr(10) || '{role}:'")


def _same(state: str) -> _Way:
    return ("true", state, "0", "", "''")


def _deleted(state: str) -> _Way:
    return ("true", state, "2", "D", "''")


def _closed(source: str) -> str:
    """Two rounds of inserts over the states of `source`."""
    u, a = _best(_same("u"), *[_inserted(x, "user") for x in "nsa"]), _best(_same("a"), _inserted("u", "assistant"))
    for _ in range(2):
        source = f"SELECT conv_id, i, n, s, {u} AS u, {a} AS a FROM ({source})"
    return source


_TO_USER = [way for x in "nsa" for way in (_kept(x, "u"), _reroled(x, "u", "user"))]
_FIRST = _closed(f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {_START} AS n, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM conversations")
_NEXT = _closed(f"""SELECT conv_id, j AS i, {_best(_deleted("n"))} AS n, {_best(_deleted("s"), _kept("n", "s"))} AS s,
    {_best(_deleted("u"), *_TO_USER)} AS u, {_best(_deleted("a"), _kept("u", "a"), _reroled("u", "a", "assistant"))} AS a
    FROM (SELECT w.conv_id, w.n, w.s, w.u, w.a, x.j, x.role, x.text, x.k, x.must_go, x.pay FROM walk w JOIN steps x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.j = w.i + 1)""")
_COUNTED = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
REPAIR = f"""
WITH RECURSIVE crcs AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM crcs WHERE kind <> 0),
placed AS (
  SELECT *, substr(role, 1, 1) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS j,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM damaged),
faulty AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated,
         lag(k) OVER (PARTITION BY conv_id ORDER BY j) || k NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
steps AS (SELECT conv_id, j, role, text, k, blank OR duplicate AS must_go, CASE WHEN truncated THEN 5 ELSE 0 END AS pay FROM faulty),
walk AS ({_FIRST} UNION ALL {_NEXT}),
ends AS (SELECT conv_id, arg_max(list_min([n, a]), i) AS best FROM walk GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM faulty GROUP BY conv_id)
SELECT e.conv_id, {_COUNTED}, best.c AS cost, best.t AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
