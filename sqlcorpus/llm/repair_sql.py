"""The repair of conversations in SQL: one recursion step per row, four states side by side."""

from __future__ import annotations

DELETE, ROLE, INSERT, UNFINISHED = 4, 3, 3, 3


def _way(state: str, cost: str, letter: str, out: str) -> str:
    """A state's best edits with one more; null where the state has none."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}} END"


def _best(*ways: str) -> str:
    return "list_sort(list_filter([" + ", ".join(ways) + "], lambda w: w IS NOT NULL))[1]"


def _inserted(state: str, role: str) -> str:
    return _way(state, str(INSERT), "I", f"list_append({state}.o, '{role}:')")


def _closed(source: str) -> str:
    """Rows put in: a user from nothing, a system or an assistant row, then an assistant."""
    users = [_inserted(s, "user") for s in ("n", "s", "a")]
    return f"""SELECT conv_id, i, n, s, u, {_best("a", _inserted("u", "assistant"))} AS a
  FROM (SELECT conv_id, i, n, s, {_best("u", *users)} AS u, a FROM {source})"""


def _gone(state: str) -> str:
    return _way(state, str(DELETE), "D", f"{state}.o")


def _kept(state: str, initial: str) -> str:
    way = _way(state, f"(CASE WHEN unfinished THEN {UNFINISHED} ELSE 0 END)", "K", f"list_append({state}.o, role || ':' || text)")
    return f"CASE WHEN NOT must_go AND left(role, 1) = '{initial}' THEN {way} END"


def _renamed(state: str, initial: str, role: str) -> str:
    way = _way(state, f"{ROLE} + (CASE WHEN unfinished THEN {UNFINISHED} ELSE 0 END)", "R", f"list_append({state}.o, '{role}:' || text)")
    return f"CASE WHEN NOT must_go AND left(role, 1) <> '{initial}' THEN {way} END"


def _step() -> str:
    users = [w for s in ("n", "s", "a") for w in (_kept(s, "u"), _renamed(s, "u", "user"))]
    assistants = [_kept("u", "a"), _renamed("u", "a", "assistant")]
    return f"""SELECT p.conv_id, r.i, {_gone("n")} AS n, {_best(_gone("s"), _kept("n", "s"))} AS s,
      {_best(_gone("u"), *users)} AS u, {_best(_gone("a"), *assistants)} AS a
    FROM paths p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1"""


REPAIR_SQL = rf"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) ORDER BY v) AS t
  FROM (SELECT unnest(range(256)) AS v)),
places AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_transform(string_split(place, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda h, c: xor(h >> 8, t[1 + (xor(h, c) & 255)]), 4294967295), 4294967295) % 20 AS kind FROM places, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS k,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN k > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated'
      ELSE 'none' END AS fault, fault IN ('blank', 'duplicate') AS must_go, fault = 'truncated' AS unfinished,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
begun AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}} AS n,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS s, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS u,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])) AS a FROM (SELECT DISTINCT conv_id FROM conversations)),
paths AS (
  {_closed("begun")}
  UNION ALL
  {_closed("(" + _step() + ") t")}),
ends AS (
  SELECT conv_id, {_best("n", "a")} AS w FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE i = last),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (illegal) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit,
  sha256(array_to_string(w.o, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
