"""DuckDB SQL of the operators on conversations, plain: all prefixes of all conversations; edits by recursion."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    bits = "x"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda b: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))[1]"
    step = bits.replace("[x]", "[xor(x, y)]")
    return (f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform("
            f"string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: {step}))")


_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL),
i AS (SELECT *, substr(sha256(length(role) || ':' || role || text), 1, 32) AS id FROM t),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, role, id) AS ids,
               list(length(text) ORDER BY turn NULLS FIRST, role, id) AS lens FROM i GROUP BY conv_id),
h AS (SELECT *, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS INT) AS h FROM own),
re AS (SELECT h.conv_id, coalesce(b.ids, [])[1:h] || h.ids[h+1:] AS ids, coalesce(b.lens, [])[1:h] || h.lens[h+1:] AS lens
       FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
pre AS (SELECT conv_id, d AS depth, len(ids) AS n, array_to_string(ids[1:d], '') AS path,
               CASE WHEN d > 0 THEN array_to_string(ids[1:d-1], '') END AS up, CASE WHEN d > 0 THEN lens[d] ELSE 0 END AS len
        FROM re, unnest(range(0, len(ids) + 1)) x(d)),
node AS (SELECT path, any_value(up) AS up, any_value(depth) AS depth, any_value(len) AS len, min(conv_id) AS conv_id,
                count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends
         FROM pre GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
under AS (SELECT substr(b.path, 1, 32 * d) AS path, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves,
                 CAST(sum((n_convs - 1) * len) AS BIGINT) AS saved_tokens
          FROM whole b, unnest(range(0, b.depth + 1)) x(d) GROUP BY ALL)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, u.n_leaves,
       u.saved_tokens, a.ends AS ends_sha256
FROM whole a JOIN under u USING (path) LEFT JOIN node p ON p.path = a.up"""


def _cheapest(own: str, other: str) -> str:
    """The better of a plan and an insertion followed by another; plans are the cost in 9 digits and the audit."""
    return f"least({own}, {_plus(2, 'I', other)})"


def _plus(cost: int | str, edit: str, plan: str) -> str:
    return f"lpad(CAST(CAST({plan}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || {plan}[10:]"


_INF = "'500000000'"


def _edit_row(q: int) -> str:
    """The best plan that uses the row ``s`` (lower case, ``x`` to be deleted) first, from grammar state q."""
    given = 3 if q == 2 else 2
    kept = {0: "WHEN s = 's' THEN v1 WHEN s = 'u' THEN v2", 1: "WHEN s = 'u' THEN v2", 2: "WHEN s = 'a' THEN v3",
            3: "WHEN s = 'u' THEN v2"}[q]
    keep = f"(CASE {kept} ELSE {_INF} END)"
    return (f"least({_plus(3, 'D', f'v{q}')}, CASE WHEN s = 'x' THEN {_INF} ELSE least("
            f"{_plus('cut', 'K', keep)}, {_plus('2 + cut', 'R', f'v{given}')}) END)")


_REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
  FROM conversations),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
          CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM c, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) x(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
        substr(sha256(length(role) || ':' || role || text), 1, 32)) AS i FROM dam),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        rtrim(text, {_SPACE}) AS body, substr(role, 1, 1) AS ini,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r),
k AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n,
         list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END
              ORDER BY i) AS sym, list(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END ORDER BY i) AS cut,
         list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts
       FROM k GROUP BY conv_id),
ends AS (SELECT conv_id, n AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3, sym, cut FROM st),
dp AS (SELECT * FROM ends UNION ALL
  SELECT conv_id, i - 1, {_cheapest('w0', 'x2')}, {_cheapest('w1', 'x2')}, x2, x3, sym, cut FROM (
    SELECT *, {_cheapest('w2', 'w3')} AS x2, {_cheapest('w3', 'w2')} AS x3 FROM (
      SELECT conv_id, i, sym, cuts AS cut, {_edit_row(0)} AS w0, {_edit_row(1)} AS w1, {_edit_row(2)} AS w2, {_edit_row(3)} AS w3
      FROM (SELECT dp.* EXCLUDE (cut), cut AS cuts, sym[i] AS s, cut[i] AS cut FROM dp WHERE i > 0)))),
plan AS (SELECT conv_id, CAST(v0[1:9] AS BIGINT) AS cost, v0[10:] AS audit FROM dp WHERE i = 0),
walk AS (SELECT st.conv_id, audit, 0 AS p, 0 AS row, 0 AS q, [] :: VARCHAR[] AS lines, roles, texts
         FROM st JOIN plan ON st.conv_id IS NOT DISTINCT FROM plan.conv_id
  UNION ALL
  SELECT conv_id, audit, p + 1, CASE WHEN e = 'I' THEN row ELSE row + 1 END,
    CASE WHEN e = 'D' THEN q WHEN e = 'K' THEN CASE substr(roles[row + 1], 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
         WHEN q = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN lines WHEN e = 'K' THEN list_append(lines, roles[row + 1] || ':' || texts[row + 1])
         ELSE list_append(lines, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END
                                 || CASE WHEN e = 'R' THEN texts[row + 1] ELSE '' END) END, roles, texts
  FROM (SELECT *, substr(audit, p + 1, 1) AS e FROM walk WHERE p < length(audit))),
done AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walk WHERE p = length(audit)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN plan ON plan.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id"""
SQL = {"op11_prefix_trie": _PREFIX_TRIE, "op12_conversation_repair": _REPAIR}
