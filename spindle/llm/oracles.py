"""DuckDB SQL of the operators that SQL can express beyond a few lines."""

from __future__ import annotations

from spindle.llm.shard_tree import DIGITS, OVERHEAD, Node


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte through the table of its polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    each = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda b: ('0x' || b)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {each}), "
            f"lambda acc, b: xor(({table}::BIGINT[])[(xor(acc, b) & 255) + 1], acc >> 8)))::BIGINT")


def shards_sql(tree: Node, more: Node) -> str:
    """Operator 12 over ``documents``: the draws of all nodes, descents by ``CASE``."""
    def named(n: Node) -> list[Node]:
        return [x for c in n.children for x in (c, *named(c))]

    def at(n: Node) -> str:
        return f"(-ln((\"{n.name}\" + 0.5) / {float(16 ** DIGITS)!r}) / {float(n.weight)!r})"

    def descend(n: Node) -> str:
        if not n.children:
            return str(n.shard)
        if len(n.children) == 1:
            return descend(n.children[0])
        least = f"least({', '.join(map(at, n.children))})"
        return "CASE " + " ".join(f"WHEN {at(c)} = {least} THEN {descend(c)}" for c in n.children) + " END"

    names = dict.fromkeys(n.name for n in (*named(tree), *named(more)))
    hashes = ", ".join(f"('0x' || substr(md5(k || ':{name}'), 1, {DIGITS}))::BIGINT AS \"{name}\"" for name in names)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
c AS (SELECT *, strlen(t)::BIGINT + {OVERHEAD} AS size, {crc32_sql("t")} AS text_crc32 FROM d),
h AS (SELECT doc_id, size, text_crc32, {hashes} FROM c),
p AS (SELECT doc_id, size, text_crc32, ({descend(tree)})::INTEGER AS shard, ({descend(more)})::INTEGER AS grown_shard FROM h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM p
"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Operator 11 over ``embeddings``: every part compared with every entry in every round."""
    ctes = [f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x
      FROM v, (SELECT unnest(range({parts})) AS p) q),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
      FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    nearest = """a{t} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS m
      FROM x JOIN b{t} USING (p) GROUP BY r, p)"""
    for t in range(rounds):
        ctes.append(nearest.format(t=t))
        ctes.append(f"""s{t} AS (SELECT p, m.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
      FROM x JOIN a{t} USING (r, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS i) q GROUP BY p, m.e, i),
n{t} AS (SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM s{t} GROUP BY p, e),
b{t + 1} AS MATERIALIZED (SELECT b{t}.p, b{t}.e, coalesce(n{t}.c, b{t}.c) AS c FROM b{t} LEFT JOIN n{t} USING (p, e))""")
    ctes.append(nearest.format(t=rounds))
    return f"""
WITH {','.join(ctes)},
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
o AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error
      FROM x JOIN a{rounds} USING (r, p) GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o, k
"""


def repair_sql() -> str:
    """Operator 13 over ``conversations``: costs to go row by row from the end, then one choice a step from the start."""
    edit = lambda own, keep, change, to: f"CASE WHEN must THEN NULL WHEN kind = '{own}' THEN {keep} + cut ELSE {change} + cut END"
    # fixed values: Delete 2, Rerole 1, Insert 5, a truncated row that stays 5; states: 0 start, 1 after s, 2 after u, 3 after a
    e = {0: "least(2 + n0, CASE WHEN NOT must AND kind = 's' THEN n1 + cut END, " + edit("u", "n2", "1 + n2", "u") + ")",
         1: "least(2 + n1, " + edit("u", "n2", "1 + n2", "u") + ")", 2: "least(2 + n2, " + edit("a", "n3", "1 + n3", "a") + ")",
         3: "least(2 + n3, " + edit("u", "n2", "1 + n2", "u") + ")"}
    at = lambda name: f"CASE st WHEN 0 THEN {name}0 WHEN 1 THEN {name}1 WHEN 2 THEN {name}2 ELSE {name}3 END"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, (SELECT unnest([0, 1]) AS again) q WHERE k <> 0 AND (again = 0 OR k = 3)),
ord AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam),
f AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM ord) z),
r AS MATERIALIZED (
  SELECT conv_id, i, n, role, text, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut, left(role, 1) AS kind FROM f),
-- costs to go before row i (n0 to n3 behind it)
back(conv_id, i, n0, n1, n2, n3, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, n + 1, 0, 0, 0, 0, 0, 10, 5, 0 FROM r
  UNION ALL
  SELECT conv_id, i, n0, n1, n2, n3, least(e0, 5 + e2, 10 + e3), least(e1, 5 + e2, 10 + e3), least(e2, 5 + e3), least(e3, 5 + e2)
  FROM (SELECT q.*, {e[0]} AS e0, {e[1]} AS e1, {e[2]} AS e2, {e[3]} AS e3
        FROM (SELECT r.*, back.b0 AS n0, back.b1 AS n1, back.b2 AS n2, back.b3 AS n3
              FROM back JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1) q) z),
cost AS MATERIALIZED (SELECT * FROM back),
steps AS MATERIALIZED (SELECT r.*, n0, n1, n2, n3, b0, b1, b2, b3 FROM r JOIN cost ON r.conv_id IS NOT DISTINCT FROM cost.conv_id AND r.i = cost.i),
walk(conv_id, i, st, audit, lines) AS (
  SELECT DISTINCT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM r
  UNION ALL
  SELECT conv_id, CASE what WHEN 'I' THEN i ELSE i + 1 END,
         CASE what WHEN 'D' THEN st WHEN 'K' THEN CASE WHEN st = 0 AND kind = 's' THEN 1 WHEN st = 2 THEN 3 ELSE 2 END ELSE CASE st WHEN 2 THEN 3 ELSE 2 END END,
         audit || what,
         CASE what WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
           WHEN 'I' THEN list_append(lines, CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END)
           ELSE list_append(lines, CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END || text) END
  FROM (SELECT *, CASE WHEN total = 2 + {at("n")} THEN 'D'
                       WHEN total = 5 + CASE st WHEN 2 THEN b3 ELSE b2 END THEN 'I'
                       WHEN NOT must AND (kind = 's' AND st = 0 AND total = cut + n1 OR kind = 'u' AND st <> 2 AND total = cut + n2
                                          OR kind = 'a' AND st = 2 AND total = cut + n3) THEN 'K' ELSE 'R' END AS what
        FROM (SELECT s.*, w.st, w.audit, w.lines, {at("b")} AS total
              FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i) y) z),
ends AS (
  SELECT w.conv_id, w.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         list_concat(w.lines, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS lines
  FROM walk w JOIN (SELECT DISTINCT conv_id, n FROM r) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = m.n + 1),
pairs AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank,
         count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated,
         count_if(before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM pairs GROUP BY conv_id)
SELECT a.conv_id AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost.b0, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN cost ON cost.conv_id IS NOT DISTINCT FROM a.conv_id AND cost.i = 1
"""
