"""DuckDB SQL for the queries that SQL can express."""

OP4 = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
parts AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS l FROM rates WHERE rate > 0),
terms AS (SELECT source, parts, k, exp(-l) * pow(l, k) / gamma(k + 1) AS p FROM parts, range(0, 73) AS r(k)),
cdf AS (SELECT source, parts, round(sum(p) OVER (PARTITION BY source ORDER BY k), 12) AS c FROM terms),
draws AS (
  SELECT d.doc_id, d.source, d.text, j,
    ('0x' || substr(sha256('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.parts + 1)) AS x(j)),
counts AS (
  SELECT doc_id, source, any_value(text) AS text, sum(k)::BIGINT AS n FROM (
    SELECT doc_id, source, text, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM draws.source AND cdf.c <= draws.u) AS k FROM draws)
  GROUP BY doc_id, source)
SELECT doc_id, source, copy::INT AS copy,
  ('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, '') || ':' || copy || ':order'), 1, 13))::BIGINT AS shuffle_key,
  sha256(coalesce(text, '')) AS text_sha256
FROM counts, unnest(range(1, n + 1)) AS y(copy)
"""

OP5 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""



def crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII string, eight shifts a byte."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


def _role_and_text(role: str) -> str:
    return f"list_prepend({role} || ':' || r.text, {{}}.lines)"


def _state(s: int) -> str:
    """SQL for the cheapest and then least repair of the rows from r on in state s, without an insert before r: a struct (cost, audit, lines)."""
    given = {0: "u", 1: "u", 2: "a", 3: "u"}[s]
    to = {"s": "b1", "u": "b2", "a": "b3"}
    made = [f"{{'cost': b{s}.cost + 2, 'audit': 'D' || b{s}.audit, 'lines': b{s}.lines}}"]
    for x in "su" if s == 0 else given:
        made.append(f"CASE WHEN r.fault NOT IN (1, 2) AND r.initial = '{x}' THEN {{'cost': {to[x]}.cost + r.more, 'audit': 'K' || {to[x]}.audit, 'lines': {_role_and_text('r.role').format(to[x])}}} END")
    role = {"u": "'user'", "a": "'assistant'"}[given]
    made.append(f"CASE WHEN r.fault NOT IN (1, 2) THEN {{'cost': {to[given]}.cost + 1 + r.more, 'audit': 'R' || {to[given]}.audit, 'lines': {_role_and_text(role).format(to[given])}}} END")
    return f"list_min([{', '.join(made)}])"


def _insert(s: str, to: str, role: str) -> str:
    return f"list_min([{s}, {{'cost': {to}.cost + 5, 'audit': 'I' || {to}.audit, 'lines': list_prepend('{role}:', {to}.lines)}}])"


_END = "{{'cost': {0}::BIGINT, 'audit': '{1}', 'lines': {2}::VARCHAR[]}}"
OP11 = rf"""
WITH RECURSIVE damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, {crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS initial,
    substr(rtrim(text, E' \t\n\x0b\f\r'), -1) AS last FROM damaged),
r AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2 WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
    CASE WHEN fault = 3 THEN 5 ELSE 0 END AS more,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM placed),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (wrong) AS illegal
  FROM r GROUP BY conv_id),
repair(conv_id, i, b0, b1, b2, b3) AS (
  SELECT conv_id, n + 1, {_END.format(0, "", "[]")}, {_END.format(10, "II", "['user:', 'assistant:']")}, {_END.format(5, "I", "['assistant:']")}, {_END.format(0, "", "[]")}
  FROM counts
  UNION ALL
  SELECT conv_id, i, {_insert("e0", "f2", "user")}, {_insert("e1", "f2", "user")}, f2, f3 FROM (
    SELECT *, {_insert("e2", "e3", "assistant")} AS f2, {_insert("e3", "e2", "user")} AS f3 FROM (
      SELECT p.conv_id, r.i, {_state(0)} AS e0, {_state(1)} AS e1, {_state(2)} AS e2, {_state(3)} AS e3
      FROM repair p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b0.cost, 0)::BIGINT AS cost, coalesce(b0.audit, '') AS audit,
  sha256(coalesce(array_to_string(b0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repair p ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = 1
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return f"sha256(concat({', '.join(f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen({x}), ':', {x}) END" for x in fields)}))"


def _siblings(table: str, group: str) -> str:
    run = f"PARTITION BY lvl, {group} i // 3 ORDER BY i ROWS BETWEEN"
    left = f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
    right = f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"
    return f"SELECT lvl, {group} i, {left} || '|' || {right} AS s FROM {table} WHERE n > 1"


OP13 = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, coalesce('+' || source, '') AS g, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS altered FROM documents),
num AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM f),
t(lvl, g, i, n, h) AS (
  SELECT 0, g, i, n, leaf FROM num
  UNION ALL SELECT lvl + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, g, i // 3, n),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS si, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, n, h) AS (
  SELECT 0, si, n, subroot FROM subs UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
low AS ({_siblings("t", "g,")}), high AS ({_siblings("u", "")}),
below AS (
  SELECT num.g, num.i, list(low.s ORDER BY low.lvl) FILTER (low.s IS NOT NULL) AS path
  FROM num LEFT JOIN low ON low.g = num.g AND low.i = num.i // (3::BIGINT ** low.lvl)::BIGINT GROUP BY num.g, num.i),
above AS (
  SELECT g, list(high.s ORDER BY high.lvl) FILTER (high.s IS NOT NULL) AS path
  FROM subs LEFT JOIN high ON high.i = subs.si // (3::BIGINT ** high.lvl)::BIGINT GROUP BY g),
whole AS (
  SELECT doc_id, leaf, altered, subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(below.path, []::VARCHAR[]), coalesce(above.path, []::VARCHAR[])) AS path
  FROM num JOIN subs USING (g) JOIN below ON below.g = num.g AND below.i = num.i JOIN above ON above.g = num.g),
folded AS (
  SELECT *, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(altered, leaf), path), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

SQL = {"op4_poisson_mix": OP4, "op5_bloom_dedup": OP5, "op11_conversation_repair": OP11, "op13_merkle_manifest": OP13}
