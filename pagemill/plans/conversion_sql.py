"""DuckDB SQL of whole conversions with the offline provider."""

from __future__ import annotations

from pagemill.plans.base import PAGED_SQL
from pagemill.plans.content_queries import FIX_SQL, TRIM, clean_sql, marked_sql
from pagemill.plans.text_queries import frequency_sql, presence_sql

NL = "chr(10)"
OPEN = "NOT regexp_matches({}, '[.!?:;''\"]$')"
GOES_ON = "(regexp_matches({0}, '^[a-z]') OR NOT starts_with({0}, '#'))"
LAST = f"coalesce(right([q FOR q IN regexp_split_to_array({{}}, '\\n\\n+') IF {TRIM.format('q')} <> '' AND NOT starts_with({TRIM.format('q')}, '#')][-1], 500), '')"
HEADING = "'^(#{1,6})\\s+(.+)$'"


def noted(x: str, empty_too: bool) -> str:
    x = f"regexp_replace({x}, '!\\[(.*?)\\]\\((img_placeholder_[a-zA-Z0-9_]+)\\)', '> *[Image: \\1]*', 'g')"
    return f"regexp_replace({x}, '!\\[(.*?)\\]\\(\\s*\\)', '> *[Image: \\1]*', 'g')" if empty_too else x


def common(x: str) -> str:
    often = f"[v FOR v IN {x} IF len([w FOR w IN {x} IF w = v]) >= len({x}) * 0.5 AND length(v) > 2][1]"
    return f"CASE WHEN len({x}) >= 3 THEN coalesce({often}, CASE WHEN len([v FOR v IN {x} IF NOT regexp_matches(v, '^\\d+$')]) = 0 THEN '\\d+' END) END"


def edges(k: int, more: int) -> str:
    """CTE ed (doc_id, header, footer)."""
    lines = f"[v FOR v IN [{TRIM.format('w')} FOR w IN string_split(p, {NL})] IF v <> '']"
    return f"""sm AS (SELECT doc_id, CASE WHEN n > {more} THEN [pages[CAST(ceil(i::DOUBLE * n / (least({k}, n) + 1)) AS BIGINT)] FOR i IN range(1, least({k}, n) + 1)] ELSE [] END AS ps FROM paged),
 sl AS (SELECT doc_id, [x[1] FOR x IN l IF len(x) >= 1] AS f, [x[-1] FOR x IN l IF len(x) >= 2] AS z FROM (SELECT doc_id, [{lines} FOR p IN ps] AS l FROM sm)),
 ed AS (SELECT doc_id, {common('f')} AS header, {common('z')} AS footer FROM sl)"""


def merged(tail: str) -> str:
    """Aggregate over (i, c, t, nx, header, footer): parts t in order, of which tail (of t or s) tells whether one is open."""
    out = f"coalesce(regexp_replace(t, '(?m)^' || regexp_escape(header) || '\\s*\\n?', '', 'g'), t)"
    out = f"coalesce(regexp_replace({out}, '(?m)\\n?' || regexp_escape(footer) || '\\s*$', '', 'g'), {out})"
    return f"""st AS (SELECT *, {out} AS s, regexp_replace(coalesce(nx, ''), '^\\s+', '') AS ns FROM mp),
 mg AS (SELECT doc_id, string_agg(CASE WHEN i < c AND {tail} AND {GOES_ON.format('ns')} THEN regexp_replace(s, '\\s+$', '') || ' ' ELSE {TRIM.format('s')} END, {NL} || {NL} ORDER BY i) AS markdown FROM st GROUP BY doc_id)"""


def told(language: tuple[str, str], of: str, name: str) -> str:
    return f"SELECT doc_id, md5(markdown) AS markdown_md5, language, n AS n_pages, '{name}' AS pipeline FROM (SELECT doc_id, n, {language[1]} AS language FROM (SELECT doc_id, n, {language[0]} FROM ({of}))) JOIN mg USING (doc_id)"


LIGHT = f"""WITH {PAGED_SQL}, {edges(5, 3)},
 pg AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, pages FROM paged),
 mp AS (SELECT doc_id, i, n AS c, header, footer, {noted('pages[i]', True)} AS t, {noted('pages[i + 1]', True)} AS nx FROM pg JOIN ed USING (doc_id)),
 {merged(OPEN.format("regexp_replace(s, '\\s+$', '')"))}
 {told(presence_sql('x'), f"SELECT doc_id, n, array_to_string(pages[1:5], {NL} || {NL}) AS x FROM paged", 'light')}"""

FULL = f"""WITH {PAGED_SQL}, {edges(7, 4)},
 pg AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, pages FROM paged),
 hs AS (SELECT doc_id, list(i ORDER BY i) AS s FROM (SELECT doc_id, i, unnest(string_split(pages[i], {NL})) AS line FROM pg) WHERE regexp_matches(line, {HEADING}) GROUP BY doc_id),
 w0 AS (SELECT doc_id, n, coalesce(s, []) AS s FROM paged LEFT JOIN hs USING (doc_id)),
 wn AS (WITH RECURSIVE w AS (SELECT doc_id, n, s, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z FROM w0 UNION ALL SELECT doc_id, n, s, k + 1, z + 1, CASE WHEN b > z + 1 THEN b ELSE e END FROM (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), [p FOR p IN s IF p >= e - 10 AND p <= e]), lambda b, p: CASE WHEN b = 0 OR p > b THEN p - 1 ELSE b END) AS b FROM (SELECT *, least(z + 50, n) AS e FROM w WHERE z < n))) SELECT doc_id, k, a, z FROM w WHERE k > 0),
 wt AS (SELECT doc_id, k AS i, count(*) OVER (PARTITION BY doc_id) AS c, array_to_string([{noted('p', False)} FOR p IN pages[a:z]], {NL} || {NL}) AS t FROM wn JOIN paged USING (doc_id)),
 mp AS (SELECT doc_id, i, c, header, footer, t, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS nx, {LAST.format('t')} AS tl FROM wt JOIN ed USING (doc_id)),
 {merged("tl <> '' AND " + OPEN.format('tl'))}
 {told(presence_sql('x'), f"SELECT doc_id, n, array_to_string([p || {NL} || {NL} FOR p IN list_concat(pages[1:5], CASE WHEN n > 10 THEN [pages[n // 2], pages[n]] ELSE [] END)], '') AS x FROM paged", 'full')}"""


def organized(pages: str, depth: int, link: bool, images: bool) -> str:
    """CTEs from src (doc_id, page, text, last): rs (raw sections, k in order) and mg (doc_id, markdown)."""
    content = TRIM.format(f"coalesce(string_agg(CASE WHEN NOT h THEN line END, {NL} ORDER BY j), '')")
    shown = marked_sql("content")
    shown = f"regexp_replace({shown}, '\\{{\\{{image:([^}}]+)\\}}\\}}|\\[image:([^\\]]+)\\]', '', 'g')" if images else shown
    body = f"CASE WHEN {TRIM.format('c')} = '' THEN '' ELSE c END"
    return f"""src AS ({pages}),
 ln AS (SELECT doc_id, page, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS j FROM src),
 hl AS (SELECT *, regexp_matches(line, {HEADING}) AS h FROM ln),
 gr AS (SELECT *, sum(CASE WHEN h OR j = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY j) AS g FROM hl),
 s0 AS (SELECT doc_id, page, g, max(CASE WHEN h THEN least({depth}, length(regexp_extract(line, {HEADING}, 1))) ELSE 0 END) AS level, coalesce(max(CASE WHEN h THEN {TRIM.format(f"regexp_extract(line, {HEADING}, 2)")} END), '') AS title, {content} AS content FROM gr GROUP BY doc_id, page, g),
 s1 AS (SELECT * FROM s0 QUALIFY content <> '' OR title <> '' OR g < max(g) OVER (PARTITION BY doc_id, page)),
 rs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, g) AS k FROM s1),
 pe AS (SELECT doc_id, page + 1 AS page, {TRIM.format('last')} AS last FROM src WHERE {str(link).lower()} AND length(regexp_replace(text, '\\s+$', '')) > 0 AND {OPEN.format("regexp_replace(text, '\\s+$', '')")}),
 lk AS (SELECT doc_id, page + 1 AS page, max(k) AS pk FROM rs GROUP BY doc_id, page),
 ch AS (SELECT rs.*, CASE WHEN last <> '' AND content <> '' AND {OPEN.format('last')} AND {GOES_ON.format('content')} THEN pk END AS parent FROM rs LEFT JOIN pe USING (doc_id, page) LEFT JOIN lk USING (doc_id, page)),
 wk AS (WITH RECURSIVE t AS (SELECT doc_id, k AS root, k, [k] AS path FROM ch WHERE parent IS NULL UNION ALL SELECT c.doc_id, t.root, c.k, list_append(t.path, c.k) FROM t JOIN ch c ON c.doc_id = t.doc_id AND c.parent = t.k) SELECT * FROM t),
 mc AS (SELECT w.doc_id, w.root AS k, string_agg(c.content, {NL} || {NL} ORDER BY w.path) AS content FROM wk w JOIN ch c ON c.doc_id = w.doc_id AND c.k = w.k GROUP BY w.doc_id, w.root),
 ms AS (SELECT m.doc_id, m.k, r.level, r.title, m.content, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.k) AS o FROM mc m JOIN rs r ON r.doc_id = m.doc_id AND r.k = m.k),
 fx AS (SELECT doc_id, {FIX_SQL.replace('ORDER BY ord', 'ORDER BY o')} AS fixed FROM ms GROUP BY doc_id),
 md AS (SELECT doc_id, o, CASE WHEN title <> '' AND lv > 0 THEN repeat('#', CAST(lv AS INT)) || ' ' || title || {NL} || CASE WHEN {body} <> '' THEN {NL} ELSE '' END ELSE '' END || {body} AS m FROM (SELECT doc_id, o, title, fixed[o] AS lv, {shown} AS c FROM ms JOIN fx USING (doc_id))),
 ja AS (SELECT d.doc_id, coalesce(string_agg(CASE WHEN {TRIM.format('m')} <> '' THEN m || {NL} END, {NL} ORDER BY o), '') AS x FROM (SELECT DISTINCT doc_id FROM src) d LEFT JOIN md USING (doc_id) GROUP BY d.doc_id),
 mg AS (SELECT doc_id, {clean_sql('x')} AS markdown FROM ja)"""


NUMBERED = TRIM.format("regexp_replace(regexp_replace(p, '(?m)^\\s*(?:Page\\s+)?\\d+(?:\\s+of\\s+\\d+)?\\s*$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
PAGES = f"SELECT doc_id, i AS page, {NUMBERED} AS text, {LAST.format('p')} AS last FROM (SELECT doc_id, i, pages[i] AS p FROM (SELECT doc_id, pages, unnest(range(1, n + 1)) AS i FROM paged))"
INTELLIGENT = f"""WITH {PAGED_SQL}, {organized(PAGES, 2, True, True)}
 {told(frequency_sql('x'), "SELECT doc_id, n, coalesce(x, '') AS x FROM paged LEFT JOIN (SELECT doc_id, string_agg(content, ' ' ORDER BY k) AS x FROM rs WHERE k <= 5 GROUP BY doc_id) USING (doc_id)", 'intelligent')}"""

HTML = "regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<title>.*?</title>|<nav\\b.*?</nav>', '', 'g')"
HTML = f"regexp_replace({HTML}, '(?is)<h1[^>]*>', chr(10) || '# ', 'g')"
for _level in range(2, 7):
    HTML = f"regexp_replace({HTML}, '(?is)<h{_level}[^>]*>', chr(10) || '{'#' * _level} ', 'g')"
HTML = f"regexp_replace(regexp_replace({HTML}, '(?is)<li[^>]*>', chr(10) || '- ', 'g'), '(?is)</h[1-6]>|</p>|</div>|</ul>|<br\\s*/?>', chr(10), 'g')"
HTML = TRIM.format(f"regexp_replace(regexp_replace(regexp_replace({HTML}, '(?s)<[^>]+>', '', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
