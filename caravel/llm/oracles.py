"""DuckDB SQL for the queries that SQL can express, straight from their definitions and over whole tables."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = """WITH RECURSIVE d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT doc_id, c, substr(h, CAST(c * 1024 + 1 AS BIGINT), 1024 + 198) AS part, least(512, greatest(0, length(h) // 2 - 99 - c * 512)) AS n FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1024 + 1)) AS c FROM d)),
win AS (SELECT doc_id, c * 512 + i AS pos, md5_number(substr(part, CAST(2 * i + 1 AS BIGINT), 200)) AS k FROM (SELECT doc_id, c, part, unnest(range(0, n)) AS i FROM cut WHERE n > 0)),
first AS (SELECT k, min((doc_id, pos)) AS f FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT w.doc_id, w.pos FROM win w JOIN first USING (k) WHERE (w.doc_id, w.pos) <> f),
runs AS (SELECT doc_id, pos, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, -1) AS opens FROM gone),
spans AS (SELECT doc_id, s, min(pos) AS a, max(pos) + 100 AS b FROM (SELECT doc_id, pos, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM runs) GROUP BY doc_id, s),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, list((a, b) ORDER BY a) AS l FROM spans GROUP BY doc_id),
keep AS (SELECT doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo) AS kept FROM (
  SELECT d.doc_id, h, unnest(list_concat([0], list_transform(l, lambda x: x[2]))) AS lo, unnest(list_concat(list_transform(l, lambda x: x[1]), [length(h) // 2])) AS hi FROM d JOIN sums USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, CASE WHEN removed IS NULL THEN h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN keep USING (doc_id)"""

OP6 = f"""WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
cut AS (SELECT doc_id, c, w[c * 64 + 1 : c * 64 + 113] AS part FROM (SELECT doc_id, w, unnest(range(0, len(w) // 64 + 1)) AS c FROM d)),
win AS (SELECT doc_id, c * 64 + i AS i, md5_number(array_to_string(part[i : i + 49], ' ')) AS k FROM (SELECT doc_id, c, part, unnest(range(1, least(64, len(part) - 49) + 1)) AS i FROM cut WHERE len(part) >= 50)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT w.doc_id, w.i FROM win w JOIN first USING (k) WHERE w.doc_id > f),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
flag AS (SELECT word.doc_id, x, j, coalesce(max(gone.i) OVER (PARTITION BY word.doc_id ORDER BY j) > j - 50, FALSE) AS cut FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = j)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(sum(CAST(cut AS INTEGER)), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY j) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM d LEFT JOIN flag ON flag.doc_id = d.doc_id GROUP BY d.doc_id, w"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, edge.y FROM reach JOIN edge ON edge.x = reach.b)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = documents.doc_id"""
