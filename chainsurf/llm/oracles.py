"""SQL twins of the queries, for an independent engine.

The classifier, the piece lattice, decontamination and the pipeline have none: training,
lattice search and item-sized windows are tested against brute force instead.
"""

from __future__ import annotations

from . import licenses, quality_rules, sharding, twins, url_filters

_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licenses() -> str:
    phrases = licenses.PHRASES.items()
    at = [f"list_filter(range(n), lambda i: i + {len(p.split())} <= n AND {' AND '.join(f'w[i + {j + 1}] = {x!r}' for j, x in enumerate(p.split()))})" for p, _ in phrases]
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(phrases))
    more = ", ".join(f"CASE WHEN regexp_matches(s, '{licenses.pattern(t)}') THEN '{label}' END" for t, label in licenses.TEMPLATES)
    every = "flatten([" + ", ".join(f"p{i}" for i in range(len(at))) + "])"
    join = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL))), ',')"
    return f"""WITH a AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
b AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, ' ' || array_to_string(w, ' ') || ' ' AS s FROM a),
c AS (SELECT *, {", ".join(f"{x} AS p{i}" for i, x in enumerate(at))} FROM b),
d AS (SELECT doc_id, n, {every} AS places, [{base}] AS base, [{more}] AS more FROM c)
SELECT doc_id, n AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  {join("base")} AS base_labels, {join("list_concat(base, more)")} AS labels,
  CAST(CASE WHEN len(list_filter(more, lambda v: v IS NOT NULL)) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM d"""


_SUBSTRINGS = f"""WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
b AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM a),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(n - 49)) AS i FROM b WHERE n >= 50)),
firsts AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM wins JOIN firsts USING (h) WHERE doc_id > d),
per AS (SELECT doc_id, list(i) AS g, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i - 1)) END, ' '), '')) AS kept_sha256
FROM b LEFT JOIN per USING (doc_id)"""

_NEAR = f"""WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1:i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM a))),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM a UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) LEFT JOIN z USING (doc_id)"""


def _quality() -> str:
    """The same counts and votes; expectation maximisation as one table of parameters per round."""
    rules, prior_texts, prior_good = quality_rules.RULES, quality_rules.PRIOR_TEXTS, quality_rules.PRIOR_GOOD
    chars = lambda x: f"length(t) - length(translate(t, '{x}', ''))"
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good or 'false'} THEN 1 ELSE 0 END AS vote_{k}" for k, (bad, good, _, _) in rules.items())
    cells = [(k, v, on_bad, on_good) for k, (_, _, bad, good) in rules.items() for v, on_bad, on_good in zip((-1, 0, 1), bad, good)]
    name = {-1: "m", 0: "z", 1: "p"}
    columns = ["good", *[f"{k}_{name[v]}_{y}" for k, v, _, _ in cells for y in ("bad", "good")], "moved"]
    first = [prior_good, *[x for c in cells for x in c[2:]], 1]
    odds = "ln(good / (1 - good)) + " + " + ".join("CASE vote_" + k + " " + " ".join(f"WHEN {v} THEN ln({k}_{name[v]}_good / {k}_{name[v]}_bad)" for c, v, _, _ in cells if c == k) + " END" for k in rules)
    q = f"1 / (1 + exp(-({odds})))"
    rate = f"(sum(n * q) + {prior_texts * prior_good}) / (sum(n) + {prior_texts})"
    step = [rate]
    for k, v, on_bad, on_good in cells:
        for r, x in (("(1 - q)", on_bad), ("q", on_good)):
            step.append(f"(coalesce(sum(n * {r}) FILTER (WHERE vote_{k} = {v}), 0) + {prior_texts * x}) / (sum(n * {r}) + {prior_texts})")
    step.append(f"abs({rate} - any_value(good))")
    rounds = [f"p0 AS (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for x, c in zip(first, columns, strict=True))})"]
    for i in range(quality_rules.ROUNDS):
        rounds.append(f"q{i} AS MATERIALIZED (SELECT pat.*, p{i}.*, {q} AS q FROM pat, p{i})")
        rounds.append(f"p{i + 1} AS MATERIALIZED (SELECT " + ", ".join(f"CASE WHEN any_value(moved) < {quality_rules.SETTLED} THEN any_value({c}) ELSE {x} END AS {c}" for x, c in zip(step, columns, strict=True)) + f" FROM q{i})")
    cols = ", ".join(f"vote_{k}" for k in rules)
    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, {_WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM a),
tri AS (SELECT doc_id, i, w[i + 1:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM b WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS r FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, {chars('#*$%&|<>')} AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
  len(l) AS n_lines, {chars('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS n_capitals, {chars('!')} AS n_bangs, {chars('.')} AS n_stops, {chars(',')} AS n_commas FROM b LEFT JOIN rep USING (doc_id)),
v AS MATERIALIZED (SELECT *, {votes} FROM c),
pat AS MATERIALIZED (SELECT {cols}, count(*) AS n FROM v GROUP BY {cols}),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {q} >= 0.5 AS kept, round({q}, 4) AS p_good FROM v, p{quality_rules.ROUNDS}"""


def _urls() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filters.RULES)
    blocked = ", ".join(f"'{h}'" for h in url_filters.BLOCKED_HOSTS)
    return f"""WITH rules(verdict, host, path) AS (VALUES {rules}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT b.*, r.host || r.path AS rule, r.verdict FROM b LEFT JOIN rules r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN len(list_filter([{blocked}], lambda x: host = x OR ends_with(host, '.' || x))) > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""


_WARC = """WITH a AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM a)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM b"""



def _shards(shards: int = 16) -> str:
    """CRC-32 folded over the bytes with its table; a draw's order is that of its bits, as all weights are equal."""
    bits = lambda s: f"CAST('0x' || substr(md5(k || ':{s}'), 1, 13) AS BIGINT)"
    return f"""WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
u AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
h AS (SELECT text, hex(encode(text)) AS x, strlen(text) AS n FROM u),
c AS (SELECT text, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(n), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]))) AS text_crc32 FROM h, crcs),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(n + 1 AS BIGINT) AS size, text_crc32 FROM documents JOIN c ON c.text = coalesce(documents.text, '')),
e AS (SELECT *, [{", ".join(bits(s) for s in range(shards + 1))}] AS b FROM d),
f AS (SELECT doc_id, size, text_crc32, CAST(list_position(b, list_max(b[1:{shards}])) - 1 AS INTEGER) AS shard, CAST(list_position(b, list_max(b)) - 1 AS INTEGER) AS grown_shard, CAST('0x' || substr(md5(k || '/' || text_crc32), 1, 8) AS BIGINT) % {sharding.CELLS} AS cell FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM f"""


ORACLES: dict[str, str] = {
    "op3_license_scans": _licenses(),
    "op4_recompression": _SUBSTRINGS,
    "op5_bottom_k_near_duplicates": _NEAR,
    "op6_quality_rules": _quality(),
    "op8_url_filters": _urls(),
    "op9_warc": _WARC,
    "op10_rendezvous_sharding": _shards(),
    "op11_conversation_repair": twins.CONVERSATIONS,
    "op12_host_suffix_arrays": twins.MAIN_TEXT,
    "op13_centroid_clustering": twins.centroids(),
}
