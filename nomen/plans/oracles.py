"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from nomen import model

_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_STATIC = _LIST(model.STATIC_NODE_TYPES)

_EL = """
el AS MATERIALIZED (SELECT 'app' || l_suppkey AS app, l_returnflag = 'R' AS own, l_linestatus = 'F' AS vol,
  CASE WHEN l_returnflag = 'R' THEN 'com.app' || l_suppkey || '.' || lower(replace(p_brand, '#', ''))
       WHEN l_suppkey % 4 = 3 THEN 'o.' || substr(md5(lower(replace(p_brand, '#', ''))), 1, 3)
       ELSE 'com.lib.' || lower(replace(p_brand, '#', '')) END AS pkg,
  'C' || p_partkey AS cls, 'm' || l_orderkey || '_' || l_linenumber AS mth,
  lower(replace(p_brand, '#', '')) || 'S' || (p_size % 2) AS ref, CASE WHEN p_size % 4 < 2 THEN 'NICKEL' ELSE 'BRASS' END AS ret
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _graph(raw: bool = False) -> str:
    r = (lambda qualified, plain: plain if raw else qualified)
    ret = "CASE WHEN vol THEN ret || '[]' ELSE ret END" if raw else "ret"
    method = "'<' || pkg || '.' || cls || ': void ' || mth || '(int)>'"
    return f"""{_EL},
named AS MATERIALIZED (
  SELECT DISTINCT app, 'package' AS st, pkg AS ss, '{r('P_C_contains', 'XX_contains')}' AS relation, 'class' AS tt, pkg || '.' || cls AS ts FROM el
  UNION SELECT app, 'class', pkg || '.' || cls, '{r('C_M_contains', 'XX_contains')}', 'method', {method} FROM el
  UNION SELECT app, 'method', {method}, '{r('M_C_refer', 'MX_refer')}', 'class_lib', 'lib.' || ref FROM el
  UNION SELECT app, 'method', {method}, '{r('M_T_return', 'MT_return')}', 'type', {ret} FROM el
  UNION SELECT app, 'method', {method}, '{r('M_C_parameter', 'MT_parameter')}', 'class_lib', 'lib.' || app FROM el WHERE own
  UNION SELECT app, 'method', {method}, '{r('M_M_modifier', 'MX_modifier')}', 'modifier', 'volatile' FROM el WHERE vol),
ends AS (SELECT app, st AS type, ss AS sig FROM named UNION SELECT app, tt, ts FROM named),
nodes AS MATERIALIZED (SELECT app, row_number() OVER (PARTITION BY app ORDER BY type, sig) - 1 AS id, type,
  CASE WHEN type IN ('package', 'class', 'class_lib') THEN regexp_extract(sig, '([^.]*)$', 1) WHEN type = 'method' THEN regexp_extract(sig, ' ([^ (]+)\\(', 1) ELSE sig END AS name, sig FROM ends),
edges AS MATERIALIZED (SELECT n.app, a.id AS source, b.id AS target, relation FROM named n JOIN nodes a ON a.app = n.app AND a.type = st AND a.sig = ss JOIN nodes b ON b.app = n.app AND b.type = tt AND b.sig = ts)"""


_GRAPH = _graph()
_SETS = f"""{_GRAPH},
child AS (SELECT e.app, e.source AS id, string_agg(t.name, chr(10) ORDER BY t.name) AS names, count(*) AS c FROM edges e JOIN nodes t ON t.app = e.app AND t.id = e.target
  WHERE t.type IN {_STATIC} AND NOT (t.type = 'modifier' AND t.name = 'volatile') AND e.relation IN {_LIST(model.LIBRARY_RELATIONS)} GROUP BY ALL),
hashes AS (SELECT n.app, n.id, n.type, n.sig, md5(coalesce(c.names, '')) AS hash FROM nodes n LEFT JOIN child c ON c.app = n.app AND c.id = n.id WHERE n.type IN ('class', 'method')),
own AS MATERIALIZED (SELECT app, id, sig AS package, NULL AS hash, true AS marked FROM nodes WHERE type = 'package'
  UNION ALL SELECT h.app, h.id, regexp_replace(regexp_replace(CASE WHEN h.type = 'class' THEN h.sig ELSE regexp_extract(h.sig, '^<(.*?): ', 1) END, '$', ''), '\\.[^.]*$', ''), h.hash, c.c IS NOT NULL FROM hashes h LEFT JOIN child c ON c.app = h.app AND c.id = h.id),
sets AS MATERIALIZED (SELECT DISTINCT app, package, coalesce(hash, '∅') AS hash FROM own UNION SELECT app, package, '∅' FROM own WHERE marked),
prints AS (SELECT app, package, sha256(string_agg(hash, ',' ORDER BY hash)) AS lib_id, count(*) AS n FROM sets GROUP BY ALL),
libs AS (SELECT lib_id, count(*) AS n_members, count(DISTINCT package) AS n_names, string_agg(DISTINCT package, ',' ORDER BY package) AS packages, string_agg(app, ',' ORDER BY app) AS paths FROM prints GROUP BY lib_id HAVING count(*) >= 2 AND count(DISTINCT package) < 3),
ranked AS (SELECT lib_id, package, row_number() OVER (PARTITION BY lib_id ORDER BY c DESC, package) AS r FROM (SELECT lib_id, package, count(*) AS c FROM prints GROUP BY lib_id, package)),
lib_names AS (SELECT l.lib_id, r.package AS lib_name FROM libs l JOIN ranked r ON r.lib_id = l.lib_id AND r.r = 1),
lib_hashes AS (SELECT DISTINCT p.lib_id, s.hash FROM sets s JOIN prints p USING (app, package) JOIN libs USING (lib_id)),
common AS (SELECT s.app, s.package, h.lib_id, count(*) AS n_common FROM sets s JOIN lib_hashes h USING (hash) GROUP BY ALL),
matched AS (SELECT c.app, c.package, l.lib_name, c.n_common FROM (SELECT c.*, row_number() OVER (PARTITION BY c.app, c.package ORDER BY c.lib_id) AS r FROM common c JOIN prints p USING (app, package)
  WHERE c.n_common >= 3 AND 10 * c.n_common > 9 * p.n) c JOIN lib_names l USING (lib_id) WHERE c.r = 1)"""

_MAPS = """
base AS (SELECT p_partkey AS k, 'app' || (p_partkey % 20) AS app, ['p', 'c', 'f', 'm'][p_partkey % 4 + 1] AS kind, CAST(p_partkey AS VARCHAR) AS key, replace(p_name, ' ', '_') AS short, replace(p_name, ' ', '_') || '_' || lower(p_type) AS full_name FROM part),
truth AS (SELECT app, kind, key, full_name AS value FROM base WHERE k % 11 <> 0),
pred AS (SELECT b.app, b.kind, b.key, CASE WHEN b.k % 3 = 0 THEN b.full_name ELSE o.short END AS value FROM base b LEFT JOIN base o ON o.k = b.k + 1 - 2 * (b.k % 2) WHERE b.k % 5 <> 0),
both_sides AS (SELECT app, kind, key, t.value AS truth, p.value AS pred, coalesce(t.value = p.value, false) AS matched, CAST(key AS INT) % 20 % 4 = 3 AS is_lib, CAST(key AS INT) % 10 AS pass,
  coalesce(t.value = p.value OR list_has_any(list_transform(range(1, CAST(len(t.value) AS BIGINT) - 1), lambda i: substr(lower(t.value), CAST(i AS INT), 3)), list_transform(range(1, CAST(len(p.value) AS BIGINT) - 1), lambda i: substr(lower(p.value), CAST(i AS INT), 3))), false) AS near
  FROM truth t FULL JOIN pred p USING (app, kind, key)),
by_mode AS (SELECT *, 'exact' AS mode, matched AS hit FROM both_sides UNION ALL SELECT *, 'common_substr', near FROM both_sides)"""

_DIV = "CASE WHEN {b} <= 0 THEN 1.0 ELSE CAST({a} AS DOUBLE) / {b} END"


def _div(a: str, b: str) -> str:
    return _DIV.format(a=a, b=b)


_LINES = """
rows_ AS (SELECT p_partkey AS k, 'app' || (p_partkey % 20) AS app, CASE WHEN p_partkey % 6 = 0 THEN 'com.same.K' || p_partkey ELSE 'com.lib' || (p_partkey % 7) || '.' || replace(p_name, ' ', '_') || p_partkey END AS origin,
  CASE WHEN p_partkey % 6 = 0 THEN 'com.same.K' || p_partkey ELSE 'o.' || (p_partkey % 5) || '.c' || p_partkey END AS fresh FROM part),
lines AS (SELECT app, k * 3 AS line, origin || ' -> ' || fresh || ':' AS value FROM rows_
  UNION ALL SELECT app, k * 3 + 1, '    ' || CASE WHEN k % 4 = 0 THEN 'int' ELSE origin END || ' field_' || k || ' -> ' || CASE WHEN k % 3 = 0 THEN 'field_' || k ELSE 'a' END FROM rows_
  UNION ALL SELECT app, k * 3 + 2, '    ' || CASE WHEN k % 2 = 0 THEN '12:34:' ELSE '' END || 'void run_' || k || '(int,' || origin || ') -> b' FROM rows_)"""

_PARSED = _LINES + r""",
p0 AS (SELECT app, line, value, regexp_extract(value, '([^ ]+) -> ([^ ]+):$', 2) AS c_new, regexp_extract(value, '([^ ]+) -> ([^ ]+):$', 1) AS c_old, regexp_matches(value, '([^ ]+) ([^ )]+) -> ([^ ]+)$') AS is_f, regexp_matches(value, '([^ ]+) ([^ ]+)\((.*)\) -> ([^ ]+)$') AS is_m FROM lines),
p1 AS (SELECT *, max(CASE WHEN c_new <> '' THEN line END) OVER (PARTITION BY app ORDER BY line) AS head FROM p0),
p2 AS (SELECT p1.app, p1.line, p1.value, h.c_new AS cls, h.c_old AS origin_cls, CASE WHEN p1.c_new <> '' THEN 'c' WHEN p1.is_f THEN 'f' WHEN p1.is_m THEN 'm' END AS kind FROM p1 JOIN p0 h ON h.app = p1.app AND h.line = p1.head),
changed AS (SELECT app, origin_cls AS t, arg_max(cls, line) AS goes FROM p2 WHERE kind = 'c' AND cls <> origin_cls GROUP BY ALL),
mem AS (SELECT app, line, cls, origin_cls, kind,
  CASE WHEN kind = 'f' THEN regexp_extract(value, '([^ ]+) ([^ )]+) -> ([^ ]+)$', 1) ELSE regexp_extract(value, '([^ ]+) ([^ ]+)\((.*)\) -> ([^ ]+)$', 1) END AS type,
  CASE WHEN kind = 'f' THEN regexp_extract(value, '([^ ]+) ([^ )]+) -> ([^ ]+)$', 2) ELSE regexp_extract(value, '([^ ]+) ([^ ]+)\((.*)\) -> ([^ ]+)$', 2) END AS origin,
  CASE WHEN kind = 'f' THEN regexp_extract(value, '([^ ]+) ([^ )]+) -> ([^ ]+)$', 3) ELSE regexp_extract(value, '([^ ]+) ([^ ]+)\((.*)\) -> ([^ ]+)$', 4) END AS obfus,
  CASE WHEN kind = 'm' THEN regexp_extract(value, '([^ ]+) ([^ ]+)\((.*)\) -> ([^ ]+)$', 3) END AS params FROM p2 WHERE kind IN ('f', 'm')),
tt AS (SELECT m.app, m.line, u.i, coalesce(c.goes, u.t) AS t FROM (SELECT app, line, unnest(string_split(CASE WHEN kind = 'f' THEN type ELSE params END, ',')) AS t, generate_subscripts(string_split(CASE WHEN kind = 'f' THEN type ELSE params END, ','), 1) AS i FROM mem) u JOIN mem m ON m.app = u.app AND m.line = u.line LEFT JOIN changed c ON c.app = u.app AND c.t = u.t),
types AS (SELECT app, line, string_agg(t, ',' ORDER BY i) AS types FROM tt GROUP BY ALL)"""

_WORDS = """
w AS (SELECT doc_id AS doc, lang, source, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents)),
bw AS (SELECT item_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
freq AS (SELECT word, count(*) AS n FROM w GROUP BY word),
vocab AS (SELECT word, 2 + row_number() OVER (ORDER BY n DESC, word) AS idx, n FROM freq WHERE n >= 3)"""

_FILTERED = _WORDS + ", kept AS (SELECT word, n FROM freq WHERE n > 700 OR (length(word) > 2 AND word IN (SELECT word FROM bw)))"

_PROFILES = """
pb AS (SELECT p_partkey AS k, p_size AS size, p_type || ':' || (p_size % 7) || ':' || p_brand AS sig, lower(replace(p_brand, '#', '')) AS brand FROM part),
lib AS (SELECT sig, 'com.' || brand || '.Klass' || (k % 3) || '.run' || (k % 5) AS id FROM pb WHERE size <= 25),
meth AS (SELECT 'app' || (k % 20) AS app, k AS node, sig, 'com.' || substr(brand, 1, 1) || '.' || CASE WHEN k % 2 = 0 THEN 'a' ELSE 'bc' END || '.b' AS id, brand FROM pb),
paths AS (SELECT app, node, unnest(['com', 'com.' || brand, 'com.' || brand || '.' || (node % 3)]) AS container, unnest([1, 2, 3]) AS level FROM meth),
cnt AS (SELECT sig, count(*) AS n FROM lib GROUP BY sig),
fit AS (SELECT m.app, m.node, m.id AS minified_id, coalesce(list_sort(list_distinct(list(l.id) FILTER (WHERE l.id IS NOT NULL
    AND len(string_split(l.id, '.')) = len(string_split(m.id, '.'))
    AND len(list_filter(list_zip(string_split(l.id, '.'), string_split(m.id, '.')), lambda p: length(p[2]) > 3 AND p[1] <> p[2])) = 0))), []) AS lib_ids
  FROM meth m LEFT JOIN cnt c ON c.sig = m.sig LEFT JOIN lib l ON l.sig = m.sig WHERE coalesce(c.n, 0) <= 10 GROUP BY ALL),
placed_at AS (SELECT f.app, p.container, p.level, f.node, f.lib_ids FROM fit f JOIN paths p USING (app, node)),
mc AS (SELECT app, container AS node, count(*) AS method_count FROM placed_at GROUP BY ALL),
vt AS (SELECT app, container AS node, choice, count(*) AS votes FROM (SELECT DISTINCT app, container, level, node, array_to_string(string_split(id, '.')[1:level], '.') AS choice FROM (SELECT *, unnest(lib_ids) AS id FROM placed_at) WHERE len(string_split(id, '.')) >= level) GROUP BY ALL),
votes AS (SELECT app, node, choice, votes, method_count FROM vt JOIN mc USING (app, node)),
best AS (SELECT app, node, choice, CAST(votes AS DOUBLE) / method_count AS confidence FROM (SELECT *, rank() OVER (PARTITION BY app, node ORDER BY votes DESC) AS r, count(*) OVER (PARTITION BY app, node, votes) AS ties FROM votes) WHERE r = 1 AND ties = 1 AND CAST(votes AS DOUBLE) / method_count >= 0.6)"""

_MINIFIED = "(len(string_split({x}, '.')) >= 2 AND (length(string_split(string_split({x}, '.')[-1], '$')[1]) = 1 OR length(string_split(string_split({x}, '.')[-2], '$')[1]) = 1))"

_FEATURES = """
fe AS (SELECT 'app' || l_suppkey AS app, l_orderkey % 97 AS a, l_partkey % 89 AS b, ['OO_C', 'TY_F', 'MD_M', 'CR_M', 'DU_F', 'UO_MF_MF', 'UA_MF_MF'][l_linenumber % 7 + 1] AS kind FROM lineitem),
valid AS (SELECT DISTINCT app, a, b, CASE WHEN (a % 5 = 0) <> (b % 5 = 0) THEN kind || '_LIB' ELSE kind END AS kind FROM fe WHERE a <> b AND NOT (a % 5 = 0 AND b % 5 = 0))"""

_SHORT = model.SHORT_NAMES
_RATES = f"""
{_WORDS},
elem AS (SELECT lang AS app, source || '.' || (doc % 40) AS package, CAST(doc AS VARCHAR) AS cls, pos = 0 AS is_class, word AS name FROM w),
crate AS (SELECT app, package, cls, count(*) FILTER (WHERE length(name) < 2 OR (length(name) = 2 AND NOT contains('{_SHORT}', name))) AS obfuscated, count(*) AS total FROM elem GROUP BY ALL),
up AS (SELECT CASE grouping(app, package) WHEN 0 THEN 'package' WHEN 1 THEN 'app' ELSE 'all' END AS level, app, package, CAST(NULL AS VARCHAR) AS cls, count(*) FILTER (WHERE obfuscated * 10 > total) AS obfuscated, count(*) AS total FROM crate GROUP BY ROLLUP (app, package)),
rates AS (SELECT 'class' AS level, app, package, cls, obfuscated, total FROM crate UNION ALL SELECT * FROM up)"""

_HIER = """
inh AS (SELECT 'app' || (p_partkey % 20) AS app, 'C' || p_partkey AS child, 'C' || (p_partkey - 20 * (1 + p_partkey % 2)) AS parent FROM part WHERE p_partkey >= 60),
hm AS (SELECT 'app' || (p_partkey % 20) AS app, 'C' || p_partkey AS cls, 'M' || p_partkey || 'a' AS method, 'void f' || (p_size % 5) || '()' AS sub_sig FROM part
  UNION ALL SELECT 'app' || (p_partkey % 20), 'C' || p_partkey, 'M' || p_partkey || 'b', CASE WHEN p_partkey % 3 = 0 THEN 'void <init>()' ELSE 'int g' || (p_size % 3) || '()' END FROM part),
calls AS (SELECT 'app' || (p_partkey % 20) AS app, 'M' || p_partkey || 'a' AS caller, 'M' || (p_partkey - 40) || CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS callee FROM part WHERE p_partkey >= 40
  UNION ALL SELECT 'app' || (p_partkey % 20), 'M' || p_partkey || 'b', 'M' || p_partkey || 'a' FROM part WHERE p_partkey % 7 = 0),
clos AS (SELECT app, child, parent AS ancestor FROM inh UNION SELECT c.app, c.child, i.parent FROM clos c JOIN inh i ON i.app = c.app AND i.child = c.ancestor),
reach AS (SELECT app, cls AS root, method FROM hm WHERE cls LIKE '%9' UNION SELECT r.app, r.root, c.callee FROM reach r JOIN calls c ON c.app = r.app AND c.caller = r.method)"""

_RINGS = f"""
{_HIER},
rings AS (SELECT * FROM calls UNION SELECT 'app' || (p_partkey % 20), 'M' || p_partkey || 'b', 'M' || (p_partkey % 20 + 20 * (p_partkey // 20 - p_partkey // 20 % 5 + (p_partkey // 20 + 1) % 5)) || 'b' FROM part),
meets AS (SELECT app, caller, callee FROM rings UNION SELECT m.app, m.caller, r.callee FROM meets m JOIN rings r ON r.app = m.app AND r.caller = m.callee),
rung AS (SELECT app, cls AS root, method FROM hm WHERE cls LIKE '%9' UNION SELECT r.app, r.root, c.callee FROM rung r JOIN rings c ON c.app = r.app AND c.caller = r.method)"""

_TREE = f"""
{_EL},
pk AS (SELECT DISTINCT app, pkg AS package FROM el),
tree AS (SELECT DISTINCT app, array_to_string(string_split(package, '.')[1:d], '.') AS prefix, string_split(package, '.')[d] AS segment, CASE WHEN d > 1 THEN array_to_string(string_split(package, '.')[1:d - 1], '.') END AS parent, CAST(d AS INTEGER) AS depth FROM (SELECT app, package, unnest(range(1, len(string_split(package, '.')) + 1)) AS d FROM pk))"""

_DU = """
us0 AS (SELECT 'app' || (p_partkey % 20) AS app, 'm' || (p_partkey // 1000) AS method, p_size AS d0, CASE WHEN p_partkey % 37 = 0 THEN p_size - 7 ELSE p_size + 1 + p_partkey % 3 END AS x0 FROM part),
u AS (SELECT DISTINCT app, method, 'v' || d0 AS d, 'v' || x0 AS x, ['field', 'local', 'parameter', 'return'][d0 % 4 + 1] AS dk, ['field', 'local', 'parameter', 'return'][(x0 + 8) % 4 + 1] AS xk FROM us0),
uk AS (SELECT app, method, d AS v, dk AS kind FROM u UNION SELECT app, method, x, xk FROM u),
uc AS (SELECT app, method, d, x FROM u UNION SELECT uc.app, uc.method, uc.d, u.x FROM uc JOIN u ON u.app = uc.app AND u.method = uc.method AND u.d = uc.x)"""

_ORDER = """
us AS (SELECT DISTINCT 'app' || (p_partkey % 20) AS app, 'm' || (p_partkey // 1000) AS method, p_size AS stmt, 'x' || (p_partkey // 1000 // 2) || '_' || (p_partkey % 13) AS member FROM part),
fl AS (SELECT DISTINCT 'app' || (p_partkey % 20) AS app, 'm' || (p_partkey // 1000) AS method, p_size AS stmt, CASE WHEN p_partkey % 37 = 0 THEN p_size - 7 ELSE p_size + 1 + p_partkey % 4 END AS nxt FROM part),
af AS (SELECT app, method, stmt, nxt FROM fl UNION SELECT af.app, af.method, af.stmt, fl.nxt FROM af JOIN fl ON fl.app = af.app AND fl.method = af.method AND fl.stmt = af.nxt),
pairs AS (SELECT DISTINCT af.app, a.member AS earlier, b.member AS later FROM af JOIN us a ON a.app = af.app AND a.method = af.method AND a.stmt = af.stmt JOIN us b ON b.app = af.app AND b.method = af.method AND b.stmt = af.nxt WHERE a.member <> b.member)"""

_KG = f"""
{_GRAPH},
ent AS (SELECT *, CASE WHEN type IN {_LIST(model.KNOWN_NODE_TYPES)} THEN type || ':' || replace(sig, ' ', '~') END AS known FROM nodes),
kn AS (SELECT known AS name, row_number() OVER (ORDER BY known) - 1 AS kg_id FROM (SELECT DISTINCT known FROM ent WHERE known IS NOT NULL)),
un AS (SELECT app, id, (SELECT count(*) FROM kn) + row_number() OVER (ORDER BY app, id) - 1 AS kg_id FROM ent WHERE known IS NULL),
ids AS (SELECT app, id, kg_id FROM ent JOIN kn ON kn.name = ent.known UNION ALL SELECT * FROM un),
rel AS (SELECT unnest({str(sorted(model.RELATIONS))}) AS relation, unnest(range({len(model.RELATIONS)})) AS rid),
entities AS (SELECT name, kg_id FROM kn UNION ALL SELECT app || '->node:' || id, kg_id FROM un)"""

_POINTS = """
pts AS (SELECT user_id, avg(value) AS x, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) / count(*) AS y, CASE WHEN user_id % 2 = 0 THEN 'exact' ELSE 'similar' END AS mode FROM events GROUP BY user_id)"""

_ART = r"""
paths AS (SELECT CASE page_id % 6 WHEN 0 THEN '/src/proj' || (page_id % 36 % 5) || '/build/outputs/mapping/v' || (page_id % 7) || '/release/mapping.txt' WHEN 1 THEN '/src/proj' || (page_id % 5) || '/build/outputs/apk/app-v' || (page_id % 7) || '-debug.apk'
  WHEN 2 THEN '/src/proj' || (page_id % 5) || '/build/outputs/apk/v' || (page_id % 7) || '-release-unsigned.apk' WHEN 3 THEN '/src/ant' || (page_id % 4) || '/bin/proguard/mapping.txt'
  WHEN 4 THEN '/src/ant' || (page_id % 4) || '/bin/x' || page_id || CASE WHEN page_id % 4 = 0 THEN '-debug' ELSE '-release' END || '.apk' ELSE '/src/other/' || page_id || CASE WHEN page_id % 2 = 0 THEN '-unaligned.apk' ELSE '.zip' END END AS path FROM pages WHERE page_id IS NOT NULL),
art AS (SELECT DISTINCT path, CASE WHEN path LIKE '/src/proj%' THEN regexp_extract(path, '^(/src/proj[0-9])', 1) ELSE regexp_extract(path, '^(/src/ant[0-9])', 1) END AS project,
  CASE WHEN path LIKE '%/mapping/v%' THEN regexp_extract(path, '/mapping(/v[0-9])', 1) WHEN path LIKE '%/apk/%' THEN regexp_extract(path, '/apk/(.*)-(?:debug|release)', 1) ELSE '' END AS variant,
  CASE WHEN path LIKE '%mapping.txt' THEN 'mapping' WHEN path LIKE '%-debug.apk' THEN 'debug' ELSE 'release' END AS kind FROM paths WHERE path NOT LIKE '/src/other/%')"""

_STATES = """
c AS (SELECT 'com.c' || conv_id AS package, role, turn, text FROM conversations),
st AS (SELECT DISTINCT package, package || '.' || role AS activity, text || '/id' || (turn % 3) || '/TextView' AS view FROM c WHERE role <> 'system' AND EXISTS (SELECT 1))"""

_STRICT = """e AS (SELECT 'u' || user_id AS app, event_id AS line, CASE event_type WHEN 'signup' THEN 'pass' WHEN 'view' THEN 'predict_start' WHEN 'purchase' THEN 'predict_stop' WHEN 'click' THEN 'train_start' ELSE 'train_end' END AS event, CASE WHEN event_type = 'signup' THEN CAST(event_id % 10 AS VARCHAR) END AS named, CAST(event_id AS DOUBLE) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
m(s, event, after) AS (VALUES (1, 'train_start', 2), (2, 'train_end', 3), (3, 'predict_start', 4), (3, 'pass', 1), (4, 'predict_stop', 3)),
r AS (SELECT app, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS line, CAST(NULL AS VARCHAR) AS event, 3 AS s, 3 AS state, true AS accepted, CAST(NULL AS DOUBLE) AS since, CAST(NULL AS DOUBLE) AS seconds, CAST(NULL AS VARCHAR) AS pass, CAST(NULL AS BIGINT) AS pass_line FROM (SELECT DISTINCT app FROM e)
UNION ALL SELECT e.app, e.i, e.line, e.event, coalesce(m.after, r.s), r.s, m.after IS NOT NULL, CASE WHEN m.after IN (2, 4) THEN e.moment ELSE r.since END, CASE WHEN m.after = 3 THEN e.moment - r.since END, CASE WHEN m.after = 1 THEN e.named ELSE r.pass END, CASE WHEN m.after = 1 THEN e.line ELSE r.pass_line END FROM r JOIN e ON e.app = r.app AND e.i = r.i + 1 LEFT JOIN m ON m.s = r.s AND m.event = e.event)"""

SQL: dict[str, str] = {
    "library_tagging": f"WITH {_SETS} SELECT m.app, m.package, m.lib_name, count(*) AS n_nodes, count(*) FILTER (WHERE n.type = 'method') AS n_methods FROM matched m JOIN (SELECT app, package, 'method' AS type FROM own JOIN hashes USING (app, id) WHERE type = 'method' UNION ALL SELECT o.app, o.package, 'other' FROM own o JOIN nodes n USING (app, id) WHERE n.type <> 'method') n ON n.app = m.app AND n.package = m.package GROUP BY ALL",
    "node_hash": f"WITH {_SETS} SELECT app, id, hash FROM hashes",
    "package_hash_sets": f"WITH {_SETS} SELECT app, package, hash FROM sets",
    "library_groups": f"WITH {_SETS} SELECT lib_name, n_members, packages, paths FROM libs JOIN lib_names USING (lib_id)",
    "library_matches": f"WITH {_SETS} SELECT app, package, lib_name, n_common FROM matched",
    "superset_candidates": f"WITH {_SETS} SELECT c.app, c.package, l.lib_name FROM common c JOIN prints p USING (app, package) JOIN lib_names l ON l.lib_id = c.lib_id WHERE c.n_common = p.n",
    "package_subgraph": f"""WITH {_SETS}, pn AS (SELECT o.app, o.id, o.package AS member_of, h.hash FROM own o LEFT JOIN hashes h ON h.app = o.app AND h.id = o.id),
g AS (SELECT DISTINCT a.app, b.package, a.member_of FROM (SELECT DISTINCT app, member_of FROM pn) a JOIN (SELECT DISTINCT app, package FROM sets) b ON b.app = a.app AND starts_with(a.member_of, b.package)),
inside AS (SELECT pn.app, g.package, pn.id, pn.hash FROM pn JOIN g ON g.app = pn.app AND g.member_of = pn.member_of),
ke AS (SELECT i.app, i.package, e.source, e.target FROM edges e JOIN nodes t ON t.app = e.app AND t.id = e.target JOIN inside i ON i.app = e.app AND i.id = e.source WHERE t.type IN {_STATIC} AND NOT (t.type = 'modifier' AND t.name = 'volatile')),
n1 AS (SELECT app, package, count(*) AS n, count(DISTINCT hash) AS h FROM inside GROUP BY ALL), n2 AS (SELECT app, package, count(DISTINCT target) AS n, count(*) AS e FROM ke GROUP BY ALL)
SELECT n1.app, n1.package, n1.n + n2.n AS n_nodes, n2.n AS n_static, n1.h AS n_hashes, n2.e AS n_edges FROM n1 JOIN n2 USING (app, package)""",
    "common_package_names": f"WITH {_EL} SELECT cls, pkg, n FROM (SELECT cls, pkg, count(*) AS n, row_number() OVER (PARTITION BY cls ORDER BY count(*) DESC, pkg) AS r FROM el GROUP BY cls, pkg) WHERE r = 1",
    "known_entities": f"WITH {_KG} SELECT name FROM kn",
    "unknown_names": f"WITH {_GRAPH} SELECT app || '->node:' || id AS gid, upper(name) AS original_name FROM nodes WHERE type IN ('package', 'class', 'method') AND id % 3 > 0",
    "graph_predictions": f"""WITH {_GRAPH} SELECT app, type[1] AS kind, CASE WHEN type = 'method' THEN regexp_extract(sig, '^<(.*): void', 1) || ';->' || name || '(int)' ELSE sig END AS key, name || 'X' AS value,
type IN ('class', 'method') AND id % 4 = 0 AS is_lib, type IN ('class', 'method') AND id % 4 = 0 AS third_party FROM nodes WHERE type IN ('package', 'class', 'method') AND id % 3 = 0""",
    "report_lib_packages": """WITH r AS (SELECT 'app' || (p_partkey % 20) AS app, ['p', 'c', 'f', 'm'][p_partkey % 4 + 1] AS kind, 'p' || (p_partkey % 60) AS pkg, 'p' || (p_partkey % 60) || CASE WHEN p_partkey % 4 > 0 THEN '.K' || p_partkey ELSE '' END || CASE WHEN p_partkey % 4 > 1 THEN ';->m' || p_partkey ELSE '' END AS key, p_partkey % 3 = 0 AND p_partkey % 5 = 0 AND p_partkey % 4 < 2 AS hit FROM part)
SELECT app, kind, key, EXISTS (SELECT 1 FROM r l WHERE l.hit AND l.app = r.app AND l.pkg = r.pkg) AS is_lib FROM r""",
    "normalised_edges": f"""WITH {_graph(True)},
goes AS (SELECT a.app, a.id, t.id AS to_id, substr(a.name, 1, instr(a.name, '[') - 1) AS element FROM nodes a LEFT JOIN (SELECT app, id, name FROM nodes WHERE regexp_matches(type, '^(class|type)')) t ON t.app = a.app AND t.name = substr(a.name, 1, instr(a.name, '[') - 1) WHERE a.type = 'type' AND a.name LIKE '%[]'),
x AS (SELECT e.app, s.type AS source_type, s.name AS source_name, upper(s.type[1]) || '_' || CASE WHEN g.id IS NULL THEN upper(t.type[1]) WHEN g.to_id IS NULL THEN '[C' ELSE '[T' END || substr(e.relation, 3) AS relation,
  CASE WHEN g.id IS NULL THEN t.type WHEN g.to_id IS NULL THEN 'class_lib' ELSE 'type' END AS target_type, coalesce(g.element, t.name) AS target_name
FROM edges e JOIN nodes s ON s.app = e.app AND s.id = e.source JOIN nodes t ON t.app = e.app AND t.id = e.target LEFT JOIN goes g ON g.app = e.app AND g.id = e.target)
SELECT app, source_type, relation, target_type, count(*) AS n, count(DISTINCT source_name || '/' || target_name) AS n_names, min(source_name || '/' || target_name) AS first, max(source_name || '/' || target_name) AS last FROM x GROUP BY ALL""",
    "renumbered_nodes": f"""WITH {_graph(True)},
arr AS (SELECT app, substr(name, 1, instr(name, '[') - 1) AS element FROM nodes WHERE type = 'type' AND name LIKE '%[]'),
missing AS (SELECT app, element FROM arr WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.app = arr.app AND n.name = arr.element AND regexp_matches(n.type, '^(class|type)'))),
kept AS (SELECT app, id, type, name, sig FROM nodes WHERE NOT (type = 'type' AND name LIKE '%[]') UNION ALL SELECT app, 1000000000 + row_number() OVER (PARTITION BY app ORDER BY element), 'class_lib', element, element FROM missing)
SELECT app, row_number() OVER (PARTITION BY app ORDER BY id) - 1 AS id, type, name, sig FROM kept""",
    "attached_names": f"WITH {_GRAPH} SELECT app, id, type, name, CASE WHEN type IN ('class', 'method') AND id % 3 = 0 THEN 'Orig' || name ELSE name END AS original_name FROM nodes WHERE type IN ('package', 'class', 'method')",
    "containment_paths": f"""WITH RECURSIVE {_GRAPH},
held AS (SELECT app, target, source FROM edges WHERE relation LIKE '%_contains'),
walk AS (SELECT app, id, id AS ancestor, 0 AS depth FROM nodes UNION ALL SELECT w.app, w.id, h.source, w.depth + 1 FROM walk w JOIN held h ON h.app = w.app AND h.target = w.ancestor)
SELECT app, id, ancestor, CAST(depth AS INTEGER) AS depth FROM walk""",
    "package_sigs": f"WITH {_TREE} SELECT app, prefix, prefix AS sig FROM tree UNION ALL SELECT DISTINCT app, '', '' FROM tree",
    "package_prefix_tree": f"WITH {_TREE} SELECT app, prefix, segment, parent, depth FROM tree",
    "predicted_package_names": f"""WITH {_TREE}, each AS (SELECT app, package, unnest(range(1, len(string_split(package, '.')) + 1)) AS d FROM pk),
named AS (SELECT app, package, d, array_to_string(string_split(package, '.')[1:d], '.') AS prefix, string_split(package, '.')[d] AS segment FROM each)
SELECT app, package, string_agg(CASE WHEN length(prefix) % 3 <> 0 THEN upper(segment) ELSE '<unknown>' END, '.' ORDER BY d) AS predicted FROM named GROUP BY ALL""",
    "inherit_closure": f"WITH RECURSIVE {_HIER} SELECT app, child, ancestor FROM clos",
    "subtree_sizes": f"WITH RECURSIVE {_HIER}, ends AS (SELECT app, child AS node FROM inh UNION SELECT app, parent FROM inh) SELECT e.app, e.node, count(c.child) AS descendants FROM ends e LEFT JOIN clos c ON c.app = e.app AND c.ancestor = e.node GROUP BY ALL",
    "override_edges": f"WITH RECURSIVE {_HIER} SELECT DISTINCT a.app, a.method, b.method AS overridden FROM hm a JOIN clos c ON c.app = a.app AND c.child = a.cls JOIN hm b ON b.app = a.app AND b.cls = c.ancestor AND b.sub_sig = a.sub_sig WHERE a.sub_sig NOT LIKE '%<init>%'",
    "reachable_methods": f"WITH RECURSIVE {_HIER} SELECT app, root, method FROM reach",
    "ring_reach": f"WITH RECURSIVE {_RINGS} SELECT app, root, method FROM rung",
    "call_circles": f"""WITH RECURSIVE {_RINGS}
SELECT a.app, a.caller AS method, min(a.callee) AS circle FROM meets a JOIN meets b ON b.app = a.app AND b.caller = a.callee AND b.callee = a.caller GROUP BY a.app, a.caller HAVING count(DISTINCT a.callee) > 1""",
    "async_reach": f"""WITH RECURSIVE {_HIER}, r AS (SELECT reach.app, root, hm.cls, reach.method FROM reach JOIN hm ON hm.app = reach.app AND hm.method = reach.method),
d AS (SELECT DISTINCT app, child AS cls FROM clos WHERE ancestor IN ('C0', 'C1', 'C2', 'C3')),
m AS (SELECT DISTINCT r.app, r.root, r.cls, hm.method FROM r JOIN d ON d.app = r.app AND d.cls = r.cls JOIN hm ON hm.app = r.app AND hm.cls = r.cls),
a AS (SELECT * FROM r UNION SELECT * FROM m)
SELECT app, root, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM a GROUP BY ALL""",
    "structural_edges": f"""WITH {_EL}, e AS (SELECT *, pkg || '.' || cls AS c FROM el), k AS (
SELECT app, c AS source, pkg AS target, 'belongs_to' AS kind FROM e UNION SELECT app, c, min(ref), 'inherit' FROM e GROUP BY ALL UNION SELECT app, c, 'public', 'modifier' FROM e
UNION SELECT app, c, c || '.f' || ref, 'has_field' FROM e UNION SELECT app, c || '.f' || ref, ret, 'type' FROM e UNION SELECT app, c, c || '.' || mth, 'has_method' FROM e UNION SELECT app, c || '.' || mth, ret, 'return' FROM e
UNION SELECT app, c || '.' || mth, 'int', 'parameter_0' FROM e UNION SELECT app, c || '.' || mth, ref, 'parameter_1' FROM e UNION SELECT app, c || '.' || mth, c || '.f' || ref, 'use_field' FROM e WHERE own UNION SELECT app, c || '.' || mth, 'volatile', 'modifier' FROM e WHERE vol)
SELECT DISTINCT * FROM k WHERE source <> target""",
    "def_use_edges": f"WITH RECURSIVE {_DU} SELECT DISTINCT uc.app, uc.method, uc.d AS source, uc.x AS target, 'DU_' || upper(a.kind[1]) || '_' || upper(b.kind[1]) AS kind FROM uc JOIN uk a ON a.app = uc.app AND a.method = uc.method AND a.v = uc.d JOIN uk b ON b.app = uc.app AND b.method = uc.method AND b.v = uc.x WHERE a.kind <> 'local' AND b.kind <> 'local' AND NOT (a.kind = 'parameter' AND b.kind <> 'field')",
    "usage_order_edges": f"WITH RECURSIVE {_ORDER} SELECT app, earlier, later FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.app = p.app AND q.earlier = p.later AND q.later = p.earlier)",
    "kg_entities": f"WITH {_KG} SELECT name, kg_id FROM entities",
    "kg_triples": f"WITH {_KG} SELECT rid AS relation, count(*) AS n, CAST(sum(a.kg_id) AS BIGINT) AS heads, CAST(sum(b.kg_id) AS BIGINT) AS tails, CAST(sum((a.kg_id * 31 + b.kg_id * 17) % 10007 * (b.kg_id % 101 + 1)) AS BIGINT) AS mixed FROM edges e JOIN rel USING (relation) JOIN ids a ON a.app = e.app AND a.id = e.source JOIN ids b ON b.app = e.app AND b.id = e.target GROUP BY rid",
    "embedded_names": f"WITH {_KG} SELECT app || '->node:' || u.id AS gid, n.name AS original_name, u.kg_id, CAST(len(embedding) AS INTEGER) AS dims FROM un u JOIN nodes n USING (app, id) JOIN embeddings ON vec_id = u.kg_id WHERE u.id % 2 = 0",
    "parsed_mapping": f"""WITH {_PARSED}, r AS (
SELECT app, line, 'c' AS kind, cls AS key, regexp_extract(origin_cls, '([^.]*)$', 1) AS value FROM p2 WHERE kind = 'c' AND cls <> origin_cls
UNION ALL SELECT app, line, 'p', regexp_replace(cls, '\\.[^.]*$', ''), regexp_extract(regexp_replace(origin_cls, '\\.[^.]*$', ''), '([^.]*)$', 1) FROM p2 WHERE kind = 'c' AND regexp_replace(cls, '\\.[^.]*$', '') <> regexp_replace(origin_cls, '\\.[^.]*$', '')
UNION ALL SELECT m.app, m.line, m.kind, cls || ';->' || obfus || CASE WHEN m.kind = 'f' THEN ':' || t.types ELSE '(' || t.types || ')' END, origin FROM mem m JOIN types t USING (app, line) WHERE origin <> obfus)
SELECT app, kind, key, arg_max(value, line) AS value FROM r GROUP BY ALL""",
    "tool_mapping": f"""WITH {_PARSED}, r AS (
SELECT app, line, 'c' AS kind, cls AS key, regexp_extract(origin_cls, '([^.]*)$', 1) AS value FROM p2 WHERE kind = 'c' AND cls <> origin_cls
UNION ALL SELECT app, line, 'p', regexp_replace(cls, '\\.[^.]*$', ''), regexp_extract(regexp_replace(origin_cls, '\\.[^.]*$', ''), '([^.]*)$', 1) FROM p2 WHERE kind = 'c' AND regexp_replace(cls, '\\.[^.]*$', '') <> regexp_replace(origin_cls, '\\.[^.]*$', '')
UNION ALL SELECT app, line, kind, cls || ';->' || obfus || CASE WHEN kind = 'f' THEN ':' || type ELSE '(' || params || ')' END, origin FROM mem WHERE origin <> obfus)
SELECT app, kind, key, arg_max(value, line) AS value FROM r GROUP BY ALL""",
    "signature_map": f"""WITH {_PARSED}, ft AS (SELECT m.*, coalesce(c.goes, m.type) AS new_type FROM mem m LEFT JOIN changed c ON c.app = m.app AND c.t = m.type),
s AS (SELECT f.app, '<' || origin_cls || ': ' || type || ' ' || origin || CASE WHEN kind = 'm' THEN '(' || params || ')' ELSE '' END || '>' AS origin_sig, '<' || cls || ': ' || new_type || ' ' || obfus || CASE WHEN kind = 'm' THEN '(' || t.types || ')' ELSE '' END || '>' AS new_sig FROM ft f JOIN types t ON t.app = f.app AND t.line = f.line)
SELECT DISTINCT app, origin_cls AS origin_sig, cls AS new_sig FROM p2 WHERE kind = 'c' AND cls <> origin_cls UNION SELECT app, origin_sig, new_sig FROM s WHERE origin_sig <> new_sig""",
    "rendered_mapping": """WITH p AS (SELECT p_partkey AS k, 'app' || (p_partkey % 20) AS app, 'K' || p_partkey AS cls, CASE WHEN p_partkey % 3 = 0 THEN 'K' || p_partkey ELSE replace(p_name, ' ', '_') END AS pred FROM part)
SELECT app, cls, cls || ' -> ' || pred || ':' || CASE WHEN k % 2 <> 0 THEN chr(10) || '    int f' || k || ' -> count' ELSE '' END || CASE WHEN k % 6 <> 0 THEN chr(10) || '    void m' || k || '(int,long) -> run' ELSE '' END AS block FROM p WHERE cls <> pred OR k % 2 <> 0 OR k % 6 <> 0""",
    "compare_report": f"WITH {_MAPS} SELECT app, '[' || CASE WHEN matched THEN kind ELSE upper(kind) END || '](' || CASE WHEN is_lib THEN '3lib' ELSE 'degd' END || ') ' || key || ' ' || coalesce(truth, '?') || '/' || coalesce(pred, '?') AS value FROM both_sides",
    "parsed_report": f"WITH {_MAPS} SELECT app, kind, matched, is_lib, key, truth, pred FROM both_sides",
    "mapping_stats": f"""WITH {_MAPS}, tot AS (SELECT app, key, truth, pred FROM both_sides),
s AS (SELECT app, kind, count(truth) AS n_truth, count(pred) AS n_pred, count(*) FILTER (WHERE matched) AS tp FROM both_sides GROUP BY ALL UNION ALL SELECT app, 'total', count(truth), count(pred), count(*) FILTER (WHERE matched) FROM both_sides GROUP BY app)
SELECT *, {_div('tp', 'n_truth')} AS recall, {_div('tp', 'n_pred')} AS precision FROM s""",
    "merged_predictions": f"WITH {_MAPS} SELECT app, kind, key, coalesce(pred, truth) AS value FROM both_sides",
    "key_sets": f"WITH {_MAPS} SELECT app, count(*) AS n_keys, count(*) FILTER (WHERE matched) AS n_same FROM both_sides GROUP BY app",
    "report_metrics": f"WITH {_MAPS}, s AS (SELECT app, mode, CASE WHEN grouping(kind) = 1 THEN 's' ELSE kind END AS kind, count(truth) AS origin, count(pred) AS predict, count(*) FILTER (WHERE hit) AS tp FROM by_mode GROUP BY GROUPING SETS ((app, mode, kind), (app, mode))) SELECT *, {_div('tp', 'predict')} AS precision, {_div('tp', 'origin')} AS recall FROM s",
    "overall_metrics": f"WITH {_MAPS}, s AS (SELECT mode, CASE WHEN grouping(pass) = 1 THEN 'all' ELSE CAST(pass AS VARCHAR) END AS pass, CASE WHEN grouping(app) = 1 THEN 'all' ELSE app END AS app, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(truth) AS origin, count(pred) AS predict, count(*) FILTER (WHERE hit) AS tp FROM by_mode GROUP BY GROUPING SETS ((mode), (mode, pass), (mode, pass, app), (mode, pass, app, kind))) SELECT *, {_div('tp', 'predict')} AS precision, {_div('tp', 'origin')} AS recall FROM s",
    "lib_split_metrics": f"WITH {_MAPS}, s AS (SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, CASE WHEN grouping(is_lib) = 1 THEN 'all' WHEN is_lib THEN 'lib' ELSE 'nonlib' END AS lib_type, count(truth) AS minified, count(pred) AS recovered, count(*) FILTER (WHERE matched) AS tp, count(*) AS n FROM both_sides GROUP BY CUBE (kind, is_lib)) SELECT kind, lib_type, minified, recovered, tp, {_div('tp', 'recovered')} AS precision, {_div('tp', 'minified')} AS recall, printf('%.2f%%', 100.0 * n / (SELECT count(*) FROM both_sides)) AS share FROM s",
    "metric_tables": f"WITH {_MAPS}, s AS (SELECT CASE WHEN grouping(kind) = 1 THEN 's' ELSE kind END AS kind, mode, count(truth) AS origin, count(pred) AS predict, count(*) FILTER (WHERE hit) AS tp FROM by_mode GROUP BY GROUPING SETS ((mode, kind), (mode))) SELECT kind, "
    + ", ".join(f"max(tp) FILTER (WHERE mode = '{m}') AS {m}_tp, max(round({_div('tp', 'predict')}, 4)) FILTER (WHERE mode = '{m}') AS {m}_precision, max(round({_div('tp', 'origin')}, 4)) FILTER (WHERE mode = '{m}') AS {m}_recall" for m in ("exact", "common_substr"))
    + " FROM s GROUP BY kind",
    "report_flag_counts": f"WITH {_MAPS} SELECT CASE WHEN matched THEN kind ELSE upper(kind) END AS flag, count(*) FILTER (WHERE is_lib) AS lib, count(*) FILTER (WHERE NOT is_lib) AS nonlib FROM both_sides GROUP BY 1",
    "common_substr_matches": f"WITH {_MAPS} SELECT app, kind, key, truth, pred FROM both_sides WHERE near",
    "compare_totals": f"WITH {_MAPS}, t AS (SELECT count(*) AS total, count(*) FILTER (WHERE matched) AS matched FROM both_sides) SELECT total, matched, {_div('matched', 'total')} AS precision, 1.0 - {_div('matched', 'total')} AS diff_rate FROM t",
    "inference_totals": f"""WITH a AS (SELECT p_partkey AS v, p_partkey % 4 = 0 AS known, CASE WHEN p_partkey % 9 = 0 THEN '?' ELSE p_name END AS label FROM part),
b AS (SELECT p_partkey AS v, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 9 = 0 THEN '?' WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS label FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 4 <> 0),
t AS (SELECT count(*) AS total, count(*) FILTER (WHERE a.label = b.label AND a.label <> '?') AS matched FROM (SELECT * FROM a WHERE NOT known) a FULL JOIN b ON a.v = b.v)
SELECT total, matched, {_div('matched', 'total')} AS precision, 1.0 - {_div('matched', 'total')} AS diff_rate FROM t""",
    "vocabulary": f"WITH {_WORDS} SELECT word, idx, n FROM vocab UNION ALL SELECT '<start>', 0, NULL UNION ALL SELECT '<end>', 1, NULL UNION ALL SELECT '<unknown>', 2, NULL",
    "word_counts_by_type": f"WITH {_WORDS} SELECT lang AS type, word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY ALL",
    "filtered_words": f"WITH {_FILTERED} SELECT word, n FROM kept",
    "ordered_words": f"WITH {_FILTERED} SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM kept",
    "encoded_names": f"""WITH {_WORDS}, it AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark),
each AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM it),
coded AS (SELECT it.id, list_concat(list_concat([0], coalesce(e.l, [])), [1]) AS ids FROM it LEFT JOIN (SELECT e.id, list(coalesce(v.idx, 2) ORDER BY i) AS l FROM each e LEFT JOIN vocab v USING (word) GROUP BY e.id) e ON e.id = it.id),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 16) AS BIGINT) AS batch, len(ids) AS length FROM coded)
SELECT id, batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY length DESC, id) - 1 AS INTEGER) AS place, array_to_string(list_resize(ids, max(length) OVER (PARTITION BY batch), 0), ',') AS ids, CAST(length AS INTEGER) AS length FROM b""",
    "decoded_names": f"""WITH {_WORDS}, it AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark),
each AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM it)
SELECT it.id, coalesce(n.name, '') AS name FROM it LEFT JOIN (SELECT e.id, string_agg(e.word, '_' ORDER BY i) AS name FROM each e JOIN vocab v USING (word) GROUP BY e.id) n ON n.id = it.id""",
    "pattern_overlap": f"WITH {_WORDS}, a AS (SELECT DISTINCT doc AS origin_id, word FROM bw), b AS (SELECT DISTINCT doc AS pattern_id, word FROM w) SELECT origin_id, pattern_id, CAST(count(*) AS INTEGER) AS n, min(word) AS first, max(word) AS last FROM a JOIN b USING (word) GROUP BY origin_id, pattern_id",
    "profile_counts": f"WITH {_PROFILES}, a AS (SELECT sig, id FROM lib UNION ALL SELECT sig, id FROM meth) SELECT sig, id, count(*) AS \"count\" FROM a WHERE NOT {_MINIFIED.format(x='id')} GROUP BY sig, id",
    "profile_totals": f"WITH {_PROFILES}, a AS (SELECT sig, id FROM lib UNION ALL SELECT sig, id FROM lib UNION ALL SELECT sig, id FROM meth) SELECT sig, id, count(*) AS \"count\" FROM a WHERE NOT {_MINIFIED.format(x='id')} GROUP BY sig, id",
    "profile_match": f"WITH {_PROFILES} SELECT app, node, minified_id, array_to_string(lib_ids, ',') AS lib_ids FROM fit",
    "name_votes": f"WITH {_PROFILES} SELECT app, node, choice, votes, method_count FROM votes",
    "best_names": f"WITH {_PROFILES} SELECT app, node, choice, confidence FROM best",
    "ranked_choices": f"WITH {_PROFILES} SELECT app, node, CAST(row_number() OVER (PARTITION BY app, node ORDER BY votes DESC, choice) AS INTEGER) AS place, choice, votes FROM votes",
    "recover_by_profiles": f"""WITH {_PROFILES}, placed AS (SELECT p.app, p.node, p.level, b.choice FROM paths p JOIN best b ON b.app = p.app AND b.node = p.container),
hit AS (SELECT pl.app, pl.node, pl.level, count(DISTINCT l.id) AS n, min(l.id) AS lib_id FROM placed pl JOIN meth m ON m.app = pl.app AND m.node = pl.node JOIN lib l ON l.sig = m.sig AND starts_with(l.id, pl.choice) WHERE pl.level IN (2, 3) GROUP BY ALL)
SELECT app, node, arg_max(lib_id, level) AS lib_id FROM hit WHERE n = 1 GROUP BY app, node""",
    "extended_relations": f"""WITH s AS (SELECT p_type AS sig, 'com.' || lower(replace(p_brand, '#', '')) || '.run' || (p_partkey % 40) AS id, ['ret:' || p_size, 'para:int'] AS r FROM part WHERE p_size <= 30),
n AS (SELECT p_type AS sig, 'com.' || lower(replace(p_brand, '#', '')) || '.run' || (p_partkey % 40) AS id, ['refer:' || p_size, 'para:int'] AS r FROM part WHERE p_size > 15),
one AS (SELECT sig, id FROM s GROUP BY ALL HAVING count(*) = 1),
more AS (SELECT sig, id, list_distinct(flatten(list(r))) AS m FROM n JOIN one USING (sig, id) WHERE NOT {_MINIFIED.format(x='id')} GROUP BY sig, id)
SELECT s.sig, s.id, array_to_string(CASE WHEN more.m IS NULL THEN s.r ELSE list_sort(list_distinct(list_concat(s.r, more.m))) END, ',') AS relations FROM s LEFT JOIN more USING (sig, id)""",
    "library_members": f"WITH {_GRAPH}, p AS (SELECT app, id, sig FROM nodes WHERE type = 'package' AND sig LIKE 'com.lib.%') SELECT app, id AS node FROM p UNION SELECT n.app, n.id FROM nodes n JOIN p ON p.app = n.app AND ((n.type = 'class' AND regexp_replace(n.sig, '\\.[^.]*$', '') = p.sig) OR (n.type = 'method' AND starts_with(n.sig, '<' || p.sig || '.')))",
    "applied_names": f"""WITH {_GRAPH}, f AS (SELECT app, id AS node, 'org.x.K' || (id % 11) || '.' || name AS sig, id AS ord FROM nodes WHERE type = 'method' AND id % 5 = 0),
a AS (SELECT * FROM f UNION ALL SELECT f.app, e.source, regexp_replace(f.sig, '\\.[^.]*$', ''), f.ord FROM f JOIN edges e ON e.app = f.app AND e.target = f.node AND e.relation = 'C_M_contains'),
l AS (SELECT app, node, arg_max(sig, ord) AS sig FROM a GROUP BY ALL) SELECT app, node, sig, regexp_extract(sig, '([^.]*)$', 1) AS name FROM l""",
    "obfuscation_rates": f"WITH {_RATES} SELECT * FROM rates",
    "training_filter": f"WITH {_RATES} SELECT app, package, cls FROM rates r WHERE level = 'class' AND NOT obfuscated * 10 > total AND NOT EXISTS (SELECT 1 FROM rates p WHERE p.level = 'package' AND p.obfuscated * 10 > p.total AND p.app IS NOT DISTINCT FROM r.app AND p.package IS NOT DISTINCT FROM r.package)",
    "edge_family_counts": f"WITH {_FEATURES} SELECT CASE WHEN grouping(substr(kind, 1, 2)) = 1 THEN 'all' ELSE substr(kind, 1, 2) END AS family, count(*) AS n FROM fe WHERE substr(kind, 1, 2) IN {_LIST(model.DEFAULT_FAMILIES)} GROUP BY ROLLUP (substr(kind, 1, 2))",
    "ablation_counts": f"WITH {_FEATURES}, s AS ({' UNION ALL '.join(f'''SELECT '{"+".join(model.ABLATION_ORDER[: i + 1])}' AS feature_set, {i + 1} AS k''' for i in range(6))}) SELECT feature_set, count(kind) AS n FROM s LEFT JOIN fe ON list_position({model.ABLATION_ORDER}, substr(kind, 1, 2)) <= k GROUP BY feature_set",
    "valid_edges": f"WITH {_FEATURES} SELECT app, a, b, kind FROM valid",
    "order_edges": f"WITH {_FEATURES} SELECT app, a, b, kind FROM valid v WHERE kind <> 'UO_MF_MF' OR NOT EXISTS (SELECT 1 FROM valid o WHERE o.app = v.app AND o.kind = 'UO_MF_MF' AND o.a = v.b AND o.b = v.a)",
    "scopes": f"WITH {_FEATURES} SELECT app, kind AS scope, array_to_string(list_sort(list_distinct(list(a))), ',') AS members FROM fe GROUP BY app, kind",
    "vertex_labels": f"""WITH p AS (SELECT 'app' || (p_partkey % 20) AS app, p_partkey AS v, ['class', 'method', 'field', 'type', 'modifier', 'constructor'][p_partkey % 6 + 1] AS kind, CASE WHEN p_partkey % 13 = 1 THEN '<init>' WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 2) ELSE p_name END AS name, 'sig.' || p_partkey AS sig, p_partkey % 5 = 0 AS is_library FROM part)
SELECT app, v, CASE WHEN is_library AND kind IN ('class', 'method', 'field') THEN sig ELSE name END AS label, (is_library AND kind IN ('class', 'method', 'field')) OR kind IN ('type', 'modifier', 'constructor') OR (kind = 'method' AND name = '<init>') OR NOT (length(name) < 2 OR (length(name) = 2 AND NOT contains('{_SHORT}', lower(name)))) AS known FROM p""",
    "graph_split": f"""WITH {_FEATURES}, d AS (SELECT DISTINCT * FROM fe), k AS (SELECT app, count(*) FILTER (WHERE a % 3 = b % 3) AS kept, count(*) FILTER (WHERE a % 3 <> b % 3) AS lost FROM d GROUP BY app),
c AS (SELECT app, sum(n) AS m FROM (SELECT app, kind, a % 3, count(DISTINCT a) AS n FROM fe GROUP BY ALL HAVING count(DISTINCT a) > 1) GROUP BY app) SELECT k.app, kept, lost, CAST(m AS BIGINT) AS scope_members FROM k JOIN c USING (app)""",
    "adjacency": f"""WITH {_FEATURES}, p AS (SELECT DISTINCT app, least(a, b) AS x, greatest(a, b) AS y FROM fe WHERE a <> b), v AS (SELECT app, v, row_number() OVER (PARTITION BY app ORDER BY v) AS i FROM (SELECT app, x AS v FROM p UNION SELECT app, y FROM p)),
b AS (SELECT app, x, y FROM p UNION ALL SELECT app, y, x FROM p), l AS (SELECT b.app, u.i AS id, array_to_string(list(w.i ORDER BY w.i), ',') AS neighbours FROM b JOIN v u ON u.app = b.app AND u.v = b.x JOIN v w ON w.app = b.app AND w.v = b.y GROUP BY ALL)
SELECT l.app, CAST(id AS INTEGER) AS id, neighbours, (SELECT count(*) FROM v WHERE v.app = l.app) AS vertices, (SELECT count(*) FROM p WHERE p.app = l.app) AS edges FROM l""",
    "phase_timings": """WITH e AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS was, lag(ts) OVER w AS since FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, (epoch_us(ts) - epoch_us(since)) / 1e6 AS s FROM e WHERE event_type = 'purchase' AND was = 'view')
SELECT user_id, count(*) AS n, round(sum(s), 3) AS total, round(max(s), 3) AS longest, round(sum(s) / count(*), 3) AS mean FROM s GROUP BY user_id""",
    "test_log_phases": f"""WITH e AS (SELECT 'u' || user_id AS app, event_id AS line, CASE event_type WHEN 'signup' THEN 'pass' WHEN 'view' THEN 'predict_start' WHEN 'purchase' THEN 'predict_stop' WHEN 'click' THEN 'train_start' ELSE 'train_end' END AS event, CASE WHEN event_type = 'signup' THEN CAST(event_id % 10 AS VARCHAR) END AS pass, CAST(event_id AS DOUBLE) AS moment FROM events),
d AS (SELECT app, line, event, moment, last_value(pass IGNORE NULLS) OVER (PARTITION BY app ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pass FROM e),
g AS (SELECT *, lag(event) OVER w AS was, lag(moment) OVER w AS since FROM d WHERE event <> 'pass' WINDOW w AS (PARTITION BY app ORDER BY line)),
s AS (SELECT app, pass, CASE WHEN event = 'train_end' AND was = 'train_start' THEN moment - since END AS t, CASE WHEN event = 'predict_stop' AND was = 'predict_start' THEN moment - since END AS p FROM g)
SELECT app, pass, sum(t) AS train_seconds, count(p) AS predict_count, sum(p) AS predict_total, max(p) AS predict_max, CASE WHEN count(p) <= 0 THEN 1.0 ELSE sum(p) / count(p) END AS predict_mean FROM s GROUP BY app, pass""",
    "strict_log_phases": f"""WITH RECURSIVE {_STRICT},
v AS (SELECT *, CASE WHEN accepted AND event = 'train_end' THEN seconds END AS t, CASE WHEN accepted AND event = 'predict_stop' THEN seconds END AS p FROM r WHERE i > 0),
g AS (SELECT app, pass, pass_line, max(t) AS train_seconds, count(p) AS predict_count, sum(p) AS predict_total, max(p) AS predict_max, count(*) FILTER (NOT accepted) AS ignored FROM v GROUP BY ALL)
SELECT app, pass, train_seconds, predict_count, predict_total, predict_max, ignored, CASE WHEN predict_count <= 0 THEN 1.0 ELSE predict_total / predict_count END AS predict_mean
FROM g QUALIFY row_number() OVER (PARTITION BY app, pass ORDER BY pass_line DESC NULLS LAST) = 1""",
    "ill_formed_events": f"WITH RECURSIVE {_STRICT} SELECT app, line, event, state FROM r WHERE NOT accepted",
    "score_table": """WITH e AS (SELECT 'u' || user_id AS app, round(value, 2) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), l AS (SELECT app, arg_max(v, i) AS end_score, max(i) AS edge_count FROM e GROUP BY app)
SELECT app, end_score, edge_count, round(end_score / edge_count, 9) AS score FROM l""",
    "score_regression": f"WITH {_POINTS} SELECT mode, count(*) AS n, round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 8) AS intercept, round(corr(x, y), 8) AS r FROM pts GROUP BY mode",
    "estimated_scores": f"WITH {_POINTS}, f AS (SELECT mode, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pts WHERE user_id % 3 <> 0 GROUP BY mode) SELECT f.mode, round(avg(f.s * p.x + f.i), 8) AS estimate FROM f, (SELECT x FROM pts WHERE user_id % 3 = 0) p GROUP BY f.mode",
    "similarity_cdf": "WITH c AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL) SELECT event_type, v, n, round(coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY event_type), 9) AS y FROM c",
    "folds": f"""WITH {_EL}, a AS (SELECT DISTINCT app FROM el), r AS (SELECT app, row_number() OVER (ORDER BY md5('0' || app), app) - 1 AS i, count(*) OVER () AS n, ntile(10) OVER (ORDER BY md5('0' || app), app) - 1 AS b FROM a)
SELECT app, CAST(b AS INTEGER) AS block, CASE WHEN i < n // 10 * 10 THEN CAST(i // (n // 10) AS INTEGER) END AS rolling, CASE WHEN i < n // 10 THEN 0 END AS held FROM r""",
    "first_apps": f"WITH {_EL} SELECT DISTINCT app FROM el ORDER BY app LIMIT 5",
    "rate_log": """WITH l AS (SELECT 'f' || (p_partkey % 10) AS file, p_partkey AS line, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_retailprice AS VARCHAR) ELSE CASE WHEN p_partkey % 4 = 0 THEN 'a/' || p_name ELSE CAST(p_size AS VARCHAR) END END AS value FROM part),
n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS rate FROM l), d AS (SELECT file, line, rate, last_value(CASE WHEN rate IS NULL THEN value END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM n)
SELECT file, line, name, rate FROM d WHERE rate IS NOT NULL AND name IS NOT NULL AND NOT contains(name, '/')""",
    "word_freq_lines": "SELECT p_name AS word, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS freq FROM part WHERE p_partkey % 5 <> 0 AND p_size > 10 GROUP BY p_name",
    "parsed_artifacts": f"WITH {_ART} SELECT path, project, variant, kind FROM art",
    "paired_artifacts": rf"""WITH {_ART}, l AS (SELECT project, kind, variant, max(path) AS path FROM art GROUP BY ALL), m AS (SELECT project, variant AS wanted, path AS mapping FROM l WHERE kind = 'mapping'),
b AS (SELECT *, count(*) OVER (PARTITION BY project, kind) AS n FROM l WHERE kind <> 'mapping'),
c AS (SELECT m.mapping, b.kind, b.path, b.variant, CASE WHEN b.n = 1 THEN 0 WHEN b.variant = wanted THEN 1 WHEN contains(regexp_replace(lower(b.variant), '[^a-z0-9]', '', 'g'), regexp_replace(lower(wanted), '[^a-z0-9]', '', 'g')) THEN 2 END AS rank FROM m JOIN b USING (project)),
t AS (SELECT mapping, kind, path FROM (SELECT *, row_number() OVER (PARTITION BY mapping, kind ORDER BY rank, variant) AS r FROM c WHERE rank IS NOT NULL) WHERE r = 1)
SELECT d.mapping, d.path AS debug, r.path AS release FROM t d JOIN t r ON r.mapping = d.mapping AND r.kind = 'release' WHERE d.kind = 'debug'""",
    "activity_texts": f"WITH {_STATES} SELECT package, activity, string_agg(view, '|' ORDER BY view) AS views FROM st GROUP BY package, activity",
    "package_sets": f"WITH {_EL}, o AS (SELECT DISTINCT app, pkg AS package FROM el WHERE NOT own EXCEPT SELECT app, pkg FROM el WHERE own), s AS (SELECT pkg AS package FROM el WHERE app IN ('app1', 'app5') AND pkg IN (SELECT pkg FROM el WHERE app IN ('app2', 'app6'))) SELECT app, package, package IN (SELECT package FROM s) AS shared FROM o",
}
SQL["chained_signatures"] = f"{SQL['signature_map'].replace('SELECT DISTINCT app, origin_cls AS origin_sig', 'SELECT app, origin_sig, new_sig, upper(new_sig) AS pred FROM (SELECT DISTINCT app, origin_cls AS origin_sig', 1)}) WHERE length(new_sig) % 2 = 0"


# -- files and streams

SQL["mapping_files"] = SQL["parsed_mapping"]
SQL["graph_files"] = f"""WITH {_GRAPH}
SELECT n.app, n_nodes, ids, first, last, n_edges, ends
FROM (SELECT app, count(*) AS n_nodes, CAST(sum(id) AS BIGINT) AS ids, min(sig) AS first, max(sig) AS last FROM nodes GROUP BY app) n
JOIN (SELECT app, count(*) AS n_edges, CAST(sum(source * 3 + target) AS BIGINT) AS ends FROM edges GROUP BY app) e USING (app)"""
SQL["appended_graphs"] = f"WITH {_GRAPH} SELECT app, type, count(*) AS n, count(*) FILTER (WHERE app >= 'app2') AS n_extra FROM nodes GROUP BY app, type"
SQL["feature_graph_files"] = f"""WITH {_FEATURES},
v AS (SELECT DISTINCT app, a AS v FROM fe UNION SELECT app, b FROM fe)
SELECT kind AS what, count(*) AS n, CAST(sum(a * 100 + b) AS BIGINT) AS total FROM fe GROUP BY kind
UNION ALL SELECT CASE WHEN v % 5 = 0 THEN 'known' ELSE 'inferred' END, count(*), CAST(sum(v) AS BIGINT) FROM v GROUP BY 1
UNION ALL SELECT 'scope', count(*), CAST(sum(m) AS BIGINT) FROM (SELECT app, kind, sum(DISTINCT a) AS m FROM fe GROUP BY app, kind)"""
SQL["kg_files"] = f"""WITH {_KG},
triples AS (SELECT b.kg_id AS tail FROM edges e JOIN rel USING (relation) JOIN ids a ON a.app = e.app AND a.id = e.source JOIN ids b ON b.app = e.app AND b.id = e.target)
SELECT CASE WHEN contains(name, '->node:') THEN 'node' ELSE string_split(name, ':')[1] END AS what, count(*) AS n, CAST(sum(kg_id) AS BIGINT) AS total FROM entities GROUP BY 1
UNION ALL SELECT 'relation2id', count(*), CAST(sum(rid) AS BIGINT) FROM rel UNION ALL SELECT 'train2id', count(*), CAST(sum(tail) AS BIGINT) FROM triples"""
SQL["embedding_files"] = """SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS length FROM embeddings"""
SQL["library_files"] = f"""WITH {_SETS}
SELECT lib_name, n_members, n_hashes, first FROM libs JOIN lib_names USING (lib_id)
JOIN (SELECT lib_id, count(*) AS n_hashes, min(hash) AS first FROM lib_hashes GROUP BY lib_id) USING (lib_id)"""
SQL["stored_library_matches"] = SQL["library_matches"]
SQL["activity_files"] = """SELECT DISTINCT 'com.c' || conv_id AS package, 'com.c' || conv_id || '.' || role AS activity
FROM conversations WHERE role <> 'system'"""
SQL["streamed_profiles"] = SQL["profile_counts"]
SQL["streamed_scores"] = """WITH e AS (SELECT 'u' || user_id AS log, round(value, 2) AS v FROM events)
SELECT log, count(v) AS n, CASE WHEN count(*) > 1 THEN count(*) - 1 END AS edges, round(sum(v), 4) AS total FROM e GROUP BY log"""

# -- words of names
#
# RE2 has no look-ahead: a capital before a small letter starts a word of its own, and the last capital of a run before
# any other character but an underscore is in no word; both are marked before the words are taken.

_SPLIT = r"""list_transform(regexp_extract_all(regexp_replace(regexp_replace({x}, '([A-Z])([a-z])', '#\\1\\2', 'g'), '[A-Z]([^A-Za-z_])', '#\\1', 'g'), '<init>|<clinit>|[A-Z]?[a-z]+|[A-Z]+|\$'), lambda w: lower(w))"""
_SPLIT = _SPLIT.replace("\\\\", "\\")


def _similarity(a: str, b: str) -> str:
    """1 - edit distance of word lists over the longer length: each word of a pair becomes a letter."""
    letters = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(CAST(64 + list_position(list_distinct(list_concat({a}, {b})), w) AS INTEGER))), '')"
    d = f"levenshtein({letters(a)}, {letters(b)})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} = {b} THEN 1.0 ELSE 1 - CAST({d} AS DOUBLE) / greatest(len({a}), len({b})) END"


_OBFUSCATED = f"""
o AS (SELECT 'app' || (p_partkey % 20) AS app, p_partkey AS id, ['package', 'class', 'field', 'method'][p_partkey % 4 + 1] AS type,
  substr('abcdef', CAST(p_partkey % 5 AS INT) + 1, CAST(p_partkey % 3 AS INT) + 1) AS name,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '_' || p_type AS original_name,
  CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') END AS tool_name FROM part)"""
SQL["split_names"] = f"WITH {_OBFUSCATED} SELECT app, id, array_to_string({_SPLIT.format(x='original_name')}, ' ') AS words FROM o"
SQL["name_similarity"] = f"""WITH {_MAPS}, n AS (SELECT app, key, truth, pred, {_SPLIT.format(x='truth')} AS a, {_SPLIT.format(x='pred')} AS b FROM both_sides)
SELECT app, key, truth, pred, {_similarity('a', 'b')} AS similarity FROM n"""
SQL["average_scores"] = f"""WITH {_OBFUSCATED},
p AS (SELECT app, id, coalesce(tool_name, 'get') || 'Name' AS value FROM o WHERE id % 4 <> 1 OR id % 5 = 0),
n AS (SELECT {_SPLIT.format(x='original_name')} AS a, {_SPLIT.format(x="coalesce(o.tool_name, '')")} AS b, {_SPLIT.format(x="coalesce(p.value, '')")} AS c FROM o LEFT JOIN p USING (app, id)
  WHERE o.type IN ('class', 'method', 'field') AND length(o.name) < 3 AND length(o.original_name) >= 3)
SELECT count(*) AS n, avg({_similarity('a', 'b')}) AS tool_score, avg({_similarity('a', 'c')}) AS model_score FROM n"""
