"""Longer SQL texts of this subpackage's queries."""

from __future__ import annotations


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, size: int = 64, scale: int = 1024) -> str:
    """Rounds of assignment and floored means as a chain of tables; ``size`` is the number of dimensions."""
    width = size // parts
    square = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (p.part[i] - c.entry[i]) * (p.part[i] - c.entry[i])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT n, p, v[p * {width} + 1 : p * {width} + {width}] AS part FROM kept, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, n - 1 AS e, part AS entry FROM parts WHERE n <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT p.n, p.p, arg_min(c.e, struct_pack(d := {square}, e := c.e)) AS e, CAST(min({square}) AS BIGINT) AS d
  FROM parts p JOIN c{k} c ON c.p = p.p GROUP BY p.n, p.p)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, i, CAST(floor(sum(part[i])::DOUBLE / count(*)) AS BIGINT) AS x FROM a{k} JOIN parts USING (n, p), range(1, {width + 1}) t(i) GROUP BY p, e, i)""")
            steps.append(f"""m{k} AS (SELECT p, e, list(x ORDER BY i) AS entry FROM s{k} GROUP BY p, e)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.entry, c.entry) AS entry FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)")
    steps += [
        f"books AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})",
        f"coded AS (SELECT n, string_agg(lower(format('{{:02x}}', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n)",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (n), books"""


SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(h[i + 1 : i + 50]) AS w FROM d, range(0, octet_length(h) - 49) t(i)),
f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT w.doc_id, w.i FROM w JOIN f USING (w) WHERE first < w.doc_id),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM gone),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
pieces AS (SELECT s.doc_id, a, b, hex(h[coalesce(lag(b) OVER w, 0) + 1 : a]) AS piece FROM spans s JOIN d USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)),
summed AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id)
SELECT d.doc_id, octet_length(h) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || hex(h[coalesce(last, 0) + 1 : octet_length(h)]))) AS kept_sha256
FROM d LEFT JOIN summed USING (doc_id)
"""

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
_CRC = """list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT),
  lambda crc, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT)"""


def _row(text: str) -> str:
    return " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text))


MERKLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('1' || source, '0') AS t, sha256({_row('text')}) AS leaf,
    CASE WHEN ({_CRC}) % 2 = 1 THEN sha256({_row("replace(text, chr(10), '')")}) ELSE sha256({_row('text')}) END AS shown FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, leaf) - 1 AS i FROM rows
), nodes AS (
  SELECT t, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM leaves
  UNION ALL
  SELECT t, level, i, sha256(string_agg(h, '' ORDER BY k)) AS h, n
  FROM (SELECT t, level + 1 AS level, i // 3 AS i, i AS k, h, (n + 2) // 3 AS n FROM nodes WHERE n > 1) GROUP BY t, level, i, n
), subroots AS MATERIALIZED (
  SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, i, h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level, i, sha256(string_agg(h, '' ORDER BY k)) AS h, n
  FROM (SELECT level + 1 AS level, i // 3 AS i, i AS k, h, (n + 2) // 3 AS n FROM tops WHERE n > 1) GROUP BY level, i, n
), root AS (SELECT h AS root FROM tops WHERE n = 1),
sides AS MATERIALIZED (
  SELECT a.t, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON b.t = a.t AND b.level = a.level AND b.i // 3 = a.i // 3 WHERE a.n > 1 GROUP BY ALL
), top_sides AS MATERIALIZED (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM tops a JOIN tops b ON b.level = a.level AND b.i // 3 = a.i // 3 WHERE a.n > 1 GROUP BY ALL
), climb AS (
  SELECT doc_id, leaf, t, 0 AS level, i, shown AS h, '' AS proof, false AS top FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.t, CASE WHEN c.top OR s.t IS NOT NULL THEN c.level + 1 ELSE 0 END, CASE WHEN c.top OR s.t IS NOT NULL THEN c.i // 3 ELSE sub.i END,
    CASE WHEN s.t IS NOT NULL THEN sha256(s.l || c.h || s.r) WHEN c.top THEN sha256(u.l || c.h || u.r) ELSE c.h END,
    CASE WHEN s.t IS NOT NULL THEN c.proof || s.l || s.r WHEN c.top THEN c.proof || u.l || u.r ELSE c.proof END, c.top OR s.t IS NULL
  FROM climb c LEFT JOIN sides s ON NOT c.top AND s.t = c.t AND s.level = c.level AND s.i = c.i
  LEFT JOIN top_sides u ON c.top AND u.level = c.level AND u.i = c.i LEFT JOIN subroots sub ON sub.t = c.t
  WHERE NOT c.top OR u.i IS NOT NULL
)
SELECT c.doc_id, c.leaf, s.h AS subroot, root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = root AS verified
FROM climb c JOIN subroots s ON s.t = c.t, root
WHERE c.top AND NOT EXISTS (SELECT 1 FROM top_sides u WHERE u.level = c.level AND u.i = c.i)
"""
