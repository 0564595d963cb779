"""SQL twins of the conversation, main-text and clustering queries."""

from __future__ import annotations

_STATES = "(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))"
_SAYS = "CASE WHEN {} = 3 THEN 'assistant:' ELSE 'user:' END"
#: Damage and facts row by row; the edits as a relation of states over the rows, of which the cheapest and then the least in ASCII is kept for each state.
CONVERSATIONS = f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crcs AS (SELECT k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(k)), lambda i: CAST(ascii(substr(k, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]))) % 20 AS kind FROM (SELECT DISTINCT k FROM named), bits),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM named JOIN crcs USING (k) WHERE kind <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM hurt),
facts AS MATERIALIZED (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pre FROM placed),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pre IS NOT NULL AND pre || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM facts GROUP BY conv_id),
whole(a, x, b) AS (SELECT * FROM {_STATES}),
turned(a, b) AS (SELECT a, b FROM whole WHERE x <> 's'),
inserts(a, pre, mid, extra, said) AS (SELECT a, '', a, 0, CAST([] AS VARCHAR[]) FROM (VALUES (0), (1), (2), (3)) v(a) UNION ALL SELECT a, 'I', b, 5, [{_SAYS.format('b')}] FROM turned UNION ALL SELECT x.a, 'II', y.b, 10, [{_SAYS.format('x.b')}, {_SAYS.format('y.b')}] FROM turned x JOIN turned y ON y.a = x.b),
edits AS MATERIALIZED (SELECT f.conv_id, f.i, s.a, e.q, s.extra + e.cost AS cost, s.pre || e.edit AS edit, list_concat(s.said, e.said) AS said FROM facts f, inserts s,
  LATERAL (SELECT s.mid AS q, 2 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS said
    UNION ALL SELECT b, CASE WHEN f.fault = 't' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM whole WHERE a = s.mid AND x = f.ini AND f.fault NOT IN ('b', 'd')
    UNION ALL SELECT b, CASE WHEN f.fault = 't' THEN 6 ELSE 1 END, 'R', [{_SAYS.format('b')} || f.text] FROM turned WHERE a = s.mid AND f.fault NOT IN ('b', 'd')) e),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS path, CAST([] AS VARCHAR[]) AS said FROM per
  UNION ALL
  SELECT conv_id, i, q, m.cost, m.path, m.said FROM (
    SELECT w.conv_id, e.i, e.q, min({{'cost': CAST(w.cost + e.cost AS BIGINT), 'path': w.path || e.edit, 'said': list_concat(w.said, e.said)}}) AS m
    FROM walk w JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.a = w.q GROUP BY w.conv_id, e.i, e.q)
),
ended AS (SELECT w.conv_id, min({{'cost': w.cost + s.extra, 'path': w.path || s.pre, 'said': list_concat(w.said, s.said)}}) AS m FROM walk w JOIN per p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.n = w.i JOIN inserts s ON s.a = w.q AND s.mid IN (0, 3) GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.path, '') AS audit, sha256(coalesce(array_to_string(m.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""

_DECODED = "x"
for _found, _for in (("<[^>]*>", "' '"), ("&quot;?", "'\"'"), ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&amp;?", "'&'"), ("\\s+", "' '")):
    _DECODED = f"regexp_replace({_DECODED}, '{_found}', {_for}, 'g')"
#: For pages whose article is marked, as those of the tables are.
MAIN_TEXT = f"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(h, '</?(?:h1|p)>'), lambda x: trim({_DECODED})), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM b"""


def centroids(k: int = 16, rounds: int = 3) -> str:
    """Distances by lists; the mean of whole numbers is rounded down after an exact sum."""
    far = "CAST(list_sum(list_transform(range(1, 65), lambda j: (v[j] - x[j]) * (v[j] - x[j]))) AS BIGINT)"

    def assign(r: int) -> str:
        return f"d{r} AS MATERIALIZED (SELECT vec_id, i, v, c, d FROM (SELECT n.*, c{r}.c, {far} AS d FROM n, c{r}) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)"

    def move(r: int) -> str:
        mean = f"SELECT c, list(x ORDER BY j) AS x FROM (SELECT c, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS x FROM d{r}, range(1, 65) AS t(j) GROUP BY c, j) GROUP BY c"
        return f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN ({mean}) m ON m.c = c{r}.c)"

    steps = ",\n".join(f"{assign(r)},\n{move(r)}" for r in range(rounds))
    return f"""WITH n AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, v AS x FROM n ORDER BY c LIMIT {k}),
{steps},
{assign(rounds)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM d{rounds} JOIN c{rounds} USING (c)"""
