"""The DuckDB SQL of the conversation and archive queries."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, lambda crc, code: list_reduce([xor(crc, code), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {bit})))"


def _way(state: str, cost: str, edit: str, turn: str | None = None) -> str:
    """What has been done until ``state``, and one edit more: its cost, the edits and the turns put out."""
    text = f"{state}.t" if turn is None else f"CASE WHEN {state}.t = '' THEN {turn} ELSE {state}.t || chr(10) || {turn} END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}}"


def _repair() -> str:
    far, states = "{'c': 1000000000, 'a': '', 't': ''}", ("nothing", "sys", "asked", "answered")
    row, asks = "role || ':' || text", ("nothing", "sys", "answered")
    kept = lambda s, c: f"CASE WHEN class = '{c}' AND NOT lost THEN {_way(s, 'extra', 'K', row)} ELSE {far} END"
    made = lambda s, who: f"CASE WHEN NOT lost THEN {_way(s, 'extra + 1', 'R', f'{who!r} || text')} ELSE {far} END"
    after = {
        "nothing": _way("nothing", "2", "D"),
        "sys": f"least({_way('sys', '2', 'D')}, {kept('nothing', 's')})",
        "asked": f"least({_way('asked', '2', 'D')}, {', '.join([kept(s, 'u') for s in asks] + [made(s, 'user:') for s in asks])})",
        "answered": f"least({_way('answered', '2', 'D')}, {kept('asked', 'a')}, {made('asked', 'assistant:')})",
    }
    put = lambda s, who: _way(s, "5", "I", f"'{who}:'")
    return f"""
WITH RECURSIVE rows AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
hurt AS (SELECT *, {_crc32("name")} % 20 AS kind FROM rows),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM hurt WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
judged AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS class FROM placed),
signed AS (SELECT *, fault IN ('b', 'd') AS lost, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra, lag(class) OVER (PARTITION BY conv_id ORDER BY pos) || class AS pair FROM judged),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM signed GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': ''}} AS nothing, {far} AS sys, {{'c': 5, 'a': 'I', 't': 'user:'}} AS asked, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS answered FROM counted
  UNION ALL
  SELECT conv_id, pos, nothing, sys, asked, least(answered, {put("asked", "assistant")}) AS answered FROM (
    SELECT conv_id, pos, nothing, sys, least(asked, {", ".join(put(s, "user") for s in asks)}) AS asked, answered FROM (
      SELECT w.conv_id, s.pos, {", ".join(f"{after[s]} AS {s}" for s in states)} FROM walk w JOIN signed s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1) AS steps) AS asks),
mended AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, least(nothing, answered) AS best FROM walk JOIN counted USING (conv_id) WHERE pos = n)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM e.conv_id
"""


REPAIR = _repair()

WARC = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to
FROM (SELECT *, strlen(html) >= 1000 AND page_id <> top AS again FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))
"""

TRIE = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
names AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations),
wanted AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("name")} % 6 AS h FROM names),
rebuilt AS (SELECT w.conv_id, pos, role, text FROM wanted w JOIN turns t ON t.conv_id = base AND pos <= h UNION ALL SELECT w.conv_id, pos, role, text FROM wanted w JOIN turns t ON t.conv_id = w.conv_id AND pos > h),
placed AS (SELECT conv_id, row_number() OVER w AS d, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS path, length(text) AS points FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
members AS (SELECT conv_id, d, path, points, lag(path, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM placed UNION ALL SELECT conv_id, 0, '', 0, NULL FROM wanted),
nodes AS (SELECT path, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points FROM members GROUP BY path, d),
families AS (SELECT parent, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM members) WHERE d = last GROUP BY path),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN families f ON f.parent = n.path),
below AS (SELECT m.path, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * w.points) AS saved FROM whole w JOIN members m ON m.conv_id = w.conv_id AND m.d <= w.d GROUP BY m.path)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM whole w JOIN below USING (path) LEFT JOIN nodes p ON p.path = w.parent LEFT JOIN ends e ON e.path = w.path
"""
