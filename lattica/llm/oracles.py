"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from lattica.llm import secret_scan as s

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m LEFT JOIN comp c ON c.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t FROM w, range(1, len(w) - 33) r(i)),
rep AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
hit AS (SELECT doc_id, list(i) AS at FROM win SEMI JOIN rep USING (t) GROUP BY doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM win SEMI JOIN rep USING (t), range(0, 35) r(k)),
word AS (SELECT doc_id, p, w[p] AS x FROM w, range(1, len(w) + 1) r(p)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

OP8 = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""


def _spans(name: str, pattern: str, rank: str, where: str, group: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS v, string_split_regex(t, '{quoted}') AS g FROM d),
{name}_s AS (SELECT doc_id, m[i] AS m, v[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM {name}_m, range(1, len(m) + 1) r(i)),
{name} AS (SELECT doc_id, s, {rank} AS rank, s + length(m) AS e FROM {name}_s WHERE {where})"""


OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("a", s.ASSIGN, f"CASE WHEN length(v) >= {s.ASSIGN_LEAST} THEN 0 ELSE 3 END", f"length(v) >= {s.WEAK_SECRET_LEAST}", 2)},
{_spans("k", s.ACCESS, f"CASE WHEN length(m) >= {s.ACCESS_LEAST} THEN 1 ELSE 4 END", f"length(m) >= {s.WEAK_ACCESS_LEAST}")},
{_spans("h", s.HEX, "2", f"length(m) >= {s.HEX_LEAST}")},
{_spans("l", s.LOGIN, "5", "true")},
{_spans("p", s.ENDPOINT, "6", "true")},
every AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p),
told AS (SELECT * FROM every x WHERE rank < 3 OR EXISTS (SELECT 1 FROM every y WHERE y.doc_id = x.doc_id AND y.s <= x.e + {s.SCOPE} AND x.s <= y.e + {s.SCOPE}
  AND (x.rank IN (0, 2, 3)) <> (y.rank IN (0, 2, 3)))),
named AS (SELECT doc_id, s, rank, e, (['{"', '".join(s.KINDS)}'])[rank + 1] || ':' || s || ':' || e AS t FROM told),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(t, ',' ORDER BY s, rank, e) FILTER (WHERE rank < 3) AS base, string_agg(t, ',' ORDER BY s, rank, e) AS spans FROM named GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

ORACLES = {"op1_embedding_neardup": OP1, "op3_substring_dedup": OP3, "op8_warc_archive": OP8, "op9_secret_scan": OP9}


def _op11(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds unrolled: c<r> holds the centroids of round r, a<r> the assignment to them."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, min(d) AS d, arg_min(c, (d, c)) AS c FROM
  (SELECT v.vec_id, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{r} c) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (WITH s AS (SELECT a.c, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (vec_id), range(1, {dims + 1}) r(i) GROUP BY 1, 2),
  m AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s GROUP BY c)
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)
"""


OP13 = r"""
WITH RECURSIVE r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda s, x: xor(s >> 8, list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(s, x) & 255)),
  CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
del AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v, range(1, length(word) + 1) t(i)),
pairs AS (SELECT a.word AS a, b.word AS b FROM del a JOIN del b USING (d, i) WHERE a.word <> b.word
  UNION SELECT d, word FROM del SEMI JOIN v ON v.word = del.d UNION SELECT word, d FROM del SEMI JOIN v ON v.word = del.d),
near AS (SELECT p.a, p.b, v.n FROM pairs p JOIN v ON v.word = p.b),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS n FROM near GROUP BY a),
told AS MATERIALIZED (SELECT v.word, CASE WHEN best.n >= 2 * v.n THEN best.b END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN best ON best.a = v.word),
walk AS (SELECT word, word AS at FROM told UNION SELECT walk.word, told.form FROM walk JOIN told ON told.word = walk.at WHERE told.form IS NOT NULL)
SELECT told.word, told.form, walk.at AS root, told.n, told.n_near, told.form_n
FROM told JOIN walk ON walk.word = told.word JOIN told AS last ON last.word = walk.at AND last.form IS NULL
"""

ORACLES |= {"op11_centroid_clustering": _op11(), "op13_spelling_variants": OP13}
