"""SQL counterparts of the queries that SQL can express."""

_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

_QUOTED = r"""\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""


def _value(name: str) -> str:
    return " || ".join(f"regexp_extract(tag, '(?is)\\s{name}{_QUOTED}', {i})" for i in (1, 2, 3))


def _host(url: str) -> str:
    return f"""translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _key(url: str) -> str:
    whole = f"regexp_replace({url}, '(?s)#.*$', '')"
    head = f"regexp_extract({whole}, '(?s)^.*?://[^/?#]*')"
    return f"lower({head}) || substr({whole}, length({head}) + 1)"


def _clusters(rounds: int = 10) -> str:
    """Rounds of assignment and exact floor means, each a table of components in long form."""
    def nearest(r: int) -> str:
        return f"""near{r} AS MATERIALIZED (
  SELECT vec, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (
    SELECT v.vec, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d
    FROM parts v JOIN means{r} m USING (i) GROUP BY v.vec, m.c) GROUP BY vec)"""

    def means(r: int) -> str:
        return f"""means{r + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM means{r} m LEFT JOIN (
    SELECT n.c, v.i, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM parts v JOIN near{r} n USING (vec) GROUP BY n.c, v.i) s USING (c, i))"""

    steps = ",\n".join(f"{nearest(r)},\n{means(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS vec, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (
  SELECT vec, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
means0 AS MATERIALIZED (
  SELECT c, i, x FROM parts JOIN (
    SELECT vec, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c
    FROM kept QUALIFY c < 8) USING (vec)),
{steps},
{nearest(rounds)},
named AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256
  FROM means{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance,
       sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN kept USING (vec) JOIN named USING (c)
"""


ORACLE = {
    "op12_integer_centroids": _clusters(),

    "op13_byte_transducer": r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs),
judged AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
                regexp_matches(t, '[#$%&*|]'),
                first_id IS NOT NULL AND (doc_id IS NULL OR first_id < doc_id)] AS fails,
         coalesce(quality, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN (
    SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic
    FROM labels GROUP BY doc_id) USING (doc_id)),
patterns AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM judged GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order,
         unnest([1, 2, 3, 4, 5]) AS step, o FROM orders),
counted AS (
  SELECT part, filter_order, step, o[step] AS own,
    sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda x: fails[x]))) AS kept,
    sum(n) FILTER (fails[o[step]] AND NOT coalesce(list_bool_or(
      list_transform(o[1:step - 1], lambda x: fails[x])), false)) AS removed,
    sum(n) FILTER (fails[o[step]] AND coalesce(list_bool_or(
      list_transform(o[1:step - 1], lambda x: fails[x])), false)) AS redundant,
    sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (fails[o[step]] AND NOT coalesce(list_bool_or(
      list_transform(o[1:step - 1], lambda x: fails[x])), false)) AS good_lost,
    sum(toxic) FILTER (fails[o[step]] AND NOT coalesce(list_bool_or(
      list_transform(o[1:step - 1], lambda x: fails[x])), false)) AS toxic_lost
  FROM patterns, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted
""",

    "op3_redirect_equivalence": rf"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE url LIKE '%://%'),
named AS (
  SELECT url, replace(trim({_value('href')}), '&amp;', '&') AS t FROM tags
  WHERE lower({_value('rel')}) = 'canonical'
  UNION ALL
  SELECT url, replace(trim(regexp_extract({_value('content')},
    '(?is)^[^;,]*[;,]\s*url\s*=\s*[''"]?([^''"]*)', 1)), '&amp;', '&') FROM tags
  WHERE lower({_value('http-equiv')}) = 'refresh'),
resolved AS (
  SELECT url, CASE
      WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t
      WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
      WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || t
      WHEN {_path('url')} LIKE '%/%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*/') || t
      ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || '/' || t END AS target
  FROM named WHERE t <> ''),
edges AS (
  SELECT {_key('url')} AS a, {_key('target')} AS b FROM resolved WHERE target LIKE '%://%'),
address AS (
  SELECT {_key('url')} AS node, url FROM resolved WHERE target LIKE '%://%'
  UNION SELECT {_key('target')}, target FROM resolved WHERE target LIKE '%://%'),
reach(a, b) AS (
  SELECT a, a FROM (SELECT a FROM edges UNION SELECT b FROM edges)
  UNION
  SELECT r.a, x.b FROM reach r
  JOIN (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges) x ON r.b = x.a),
judged AS (
  SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT url FROM pages UNION SELECT url FROM address) u
  JOIN rules ON ({_host('url')} = rhost OR {_host('url')} LIKE '%.' || rhost)
    AND starts_with({_path('url')}, rpath)
  GROUP BY url),
spread AS (
  SELECT r.a AS node, CASE WHEN bool_or(j.verdict = 'allow') THEN 'allow'
                           WHEN bool_or(j.verdict = 'block') THEN 'block' END AS verdict
  FROM reach r JOIN address n ON n.node = r.b JOIN judged j ON j.url = n.url GROUP BY r.a)
SELECT page_id, {_host('p.url')} AS host, {_path('p.url')} AS path, j.rule AS rule,
       coalesce(j.verdict, s.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN judged j ON j.url = p.url
LEFT JOIN spread s ON p.url LIKE '%://%' AND s.node = {_key('p.url')}
""",

    "op10_positional_index": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT item_id, n, w[s:s + n - 1] AS words FROM (
    SELECT item_id, w, least(10, len(w)) AS n,
           unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s
    FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
places AS (
  SELECT doc_id, n, s, w[s:s + n - 1] AS words FROM (
    SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s
    FROM d, sizes WHERE len(w) >= n)),
found AS (
  SELECT DISTINCT doc_id, s, p.n, item_id FROM places p JOIN item_windows x
  ON p.n = x.n AND p.words = x.words),
hits AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (
    SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS spot FROM found) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id),
spots AS MATERIALIZED (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
known AS MATERIALIZED (SELECT word, count(*) AS n FROM spots GROUP BY word),
item_rows AS (SELECT row_number() OVER () AS r, item_id, w FROM i WHERE len(w) > 0),
item_spots AS (
  SELECT r, item_id, len(w) AS size, unnest(w) AS word, unnest(range(len(w))) AS place FROM item_rows),
ranked AS (
  SELECT x.r, x.item_id, s, place, x.word, coalesce(n, 0) AS n,
         row_number() OVER (PARTITION BY x.r, s ORDER BY coalesce(n, 0), place) AS rk,
         min(coalesce(n, 0)) OVER (PARTITION BY x.r, s) AS least, least(10, size) AS wide
  FROM item_spots x
  JOIN (SELECT r, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM item_rows) y
    ON x.r = y.r AND place BETWEEN s AND s + least(10, size) - 1
  LEFT JOIN known USING (word)),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.item_id, a.word AS wa, a.place AS pa, b.word AS wb, b.place AS pb
  FROM ranked a JOIN ranked b ON a.r = b.r AND a.s = b.s AND a.rk = 1 AND b.rk = least(2, b.wide)
  WHERE a.least > 0),
firsts AS MATERIALIZED (
  SELECT item_id, pa, pb, doc_id, p - pa AS shift FROM pairs JOIN spots ON word = wa),
seconds AS MATERIALIZED (
  SELECT item_id, pa, pb, doc_id, p - pb AS shift FROM pairs JOIN spots ON word = wb),
close AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM firsts f JOIN seconds s USING (item_id, pa, pb, doc_id)
  WHERE abs(f.shift - s.shift) <= 3 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id) LEFT JOIN close USING (doc_id)
""",
}
