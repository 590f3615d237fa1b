"""The catalogue's queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from ..functions.scalars import COMMIT_KINDS
from ..schema import TOKENS

CODE = "CAST(('0x' || substr(md5({0}), 1, 4)) AS INT) % 94"

DOCS = f"""
src AS (SELECT doc_id, coalesce(source, '') AS package, coalesce(lang, '') AS lang,
        list_filter(list_transform(regexp_extract_all(lower(text), '[^.!?\\n\\r]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
fns AS (SELECT doc_id AS fn_id, 'doc' || doc_id AS name, package, lang, '/work/repo/' || package || '/' || lang || '/' || doc_id AS file_path,
        list_transform(s, lambda x: {CODE.format('x')}) AS t, list_sort(list_distinct(list_transform(s, lambda x: regexp_extract(x, '^[^ ]+')))) AS imps,
        list_sort(list_distinct(list_transform(s, lambda x: regexp_extract(x, '[^ ]+$')))) AS calls FROM src)"""

_PAIRS = "list_transform(range(1, greatest(len({0}), 2)), lambda i: array_to_string({0}[i:i + 1], '>'))"

PAGES = f"""
src AS (SELECT page_id, coalesce(url, '') AS url, regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1) AS s FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL),
fns AS (SELECT page_id AS fn_id, 'page' || page_id AS name, regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS package, 'html' AS lang, url AS file_path, list_transform(s, lambda x: {CODE.format('x')}) AS t,
        list_sort(list_distinct(s)) AS imps, list_sort(list_distinct({_PAIRS.format('s')})) AS calls FROM src)"""

EVENTS = f"""
src AS (SELECT user_id, date_trunc('week', ts) AS week, list(coalesce(event_type, '') ORDER BY ts, event_id, event_type) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
fns AS (SELECT CAST(user_id * 100000000 + CAST(strftime(week, '%Y%m%d') AS BIGINT) AS BIGINT) AS fn_id, 'user' || user_id AS name, strftime(week, '%Y%m%d') AS package, 'events' AS lang, '/work/repo/' || user_id AS file_path,
        list_transform(s, lambda x: {CODE.format('x')}) AS t, list_sort(list_distinct(s)) AS imps, list_sort(list_distinct({_PAIRS.format('s')})) AS calls FROM src)"""

ORDERS = f"""
src AS (SELECT l_orderkey, list(concat_ws('/', l_returnflag, l_linestatus, CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS VARCHAR)) ORDER BY l_linenumber, concat_ws('/', l_returnflag, l_linestatus, CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS VARCHAR))) AS s,
        list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))) AS imps, list_sort(list_distinct(list(p_brand) FILTER (p_brand IS NOT NULL))) AS calls FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
fns AS (SELECT o_orderkey AS fn_id, 'order' || o_orderkey AS name, coalesce(o_orderpriority, '') AS package, 'orders' AS lang, '/work/repo/' || o_orderkey AS file_path, list_transform(s, lambda x: {CODE.format('x')}) AS t, imps, coalesce(calls, []) AS calls
        FROM src JOIN orders ON l_orderkey = o_orderkey)"""

_COUNT = "len(list_filter(t, lambda x: x IN ({})))"
FEATURES = f"""
ft AS (SELECT *, array_to_string(t, ',') AS key, array_to_string(list_transform(t, lambda x: chr(x + 33)), '') AS enc, package || '/' || name AS okey,
       1 + {_COUNT.format('0,1,2,4,6,13')} AS cyclo, {_COUNT.format('3,5')} AS nesting, {_COUNT.format('7')} AS early, {_COUNT.format('10')} AS defers, {_COUNT.format('14,17,18')} AS ncalls, {_COUNT.format('8')} AS go,
       list_contains(t, 21) AS ctx, list_contains(t, 24) AS err,
       CASE WHEN len(t) = 0 THEN [0::BIGINT] WHEN len(t) = 1 THEN [t[1]::BIGINT] WHEN len(t) = 2 THEN [(t[1] * 131 + t[2])::BIGINT % 1000000007]
            ELSE list_transform(range(0, len(t) - 2, 2), lambda i: ((t[i + 1]::BIGINT * 131 + t[i + 2]) * 131 + t[i + 3]) % 1000000007) END AS hashes FROM fns)"""

BLOCK = """
able AS (SELECT * FROM ft WHERE len(t) >= 5),
post AS (SELECT hash, fn_id, count(*) AS mult FROM (SELECT fn_id, unnest(hashes) AS hash FROM able) GROUP BY ALL),
freq AS (SELECT hash, CAST(sum(mult) AS BIGINT) AS freq FROM post GROUP BY hash)"""

SHARED = """
usable AS (SELECT post.* FROM post JOIN freq USING (hash) WHERE freq <= 300),
shared AS (SELECT a.fn_id AS i, b.fn_id AS j, CAST(sum(a.mult * b.mult) AS BIGINT) AS shared FROM usable a JOIN usable b ON a.hash = b.hash AND a.fn_id < b.fn_id GROUP BY ALL)"""

_JACCARD = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"
_SEQ = "CASE WHEN {0} = {1} THEN 1.0 ELSE 1.0 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"


def _scored(seq: float = 0.40) -> str:
    return f"""
sp AS (SELECT i, j, shared, {_SEQ.format('a.enc', 'b.enc')} AS seq_s, {_JACCARD.format('a.imps', 'b.imps')} AS imp_s, {_JACCARD.format('a.calls', 'b.calls')} AS call_s
       FROM shared JOIN able a ON a.fn_id = i JOIN able b ON b.fn_id = j WHERE shared >= CASE WHEN len(a.hashes) >= 2 AND len(b.hashes) >= 2 THEN 2 ELSE 1 END),
sc AS (SELECT *, cbrt(seq_s * imp_s * call_s) AS geo FROM sp WHERE seq_s >= {seq})"""


#: Connected components of the edge graph.
COMPONENTS = """
e AS (SELECT i, j FROM sc WHERE geo >= 0.75),
reach(a, b) AS (SELECT i, i FROM e UNION SELECT j, j FROM e UNION SELECT r.a, CASE WHEN e.i = r.b THEN e.j ELSE e.i END FROM reach r JOIN e ON e.i = r.b OR e.j = r.b),
comp AS (SELECT a AS fn_id, min(b) AS component FROM reach GROUP BY a)"""


def _greedy(threshold: float) -> str:
    """Complete linkage, edge after edge: link has the groups as lists after k edges. A merge needs every pair across to be an edge."""
    return f"""
e AS (SELECT i, j, geo FROM sc WHERE geo >= {threshold}),
ord AS (SELECT fn_id, row_number() OVER (ORDER BY okey, file_path, fn_id) AS p FROM ft WHERE fn_id IN (SELECT i FROM e UNION SELECT j FROM e)),
se AS (SELECT least(a.p, b.p) AS x, greatest(a.p, b.p) AS y, row_number() OVER (ORDER BY geo DESC, least(a.p, b.p), greatest(a.p, b.p)) AS k FROM e JOIN ord a ON a.fn_id = i JOIN ord b ON b.fn_id = j),
ek AS (SELECT list(x * 1000000 + y) AS pairs FROM se),
link(k, g) AS (SELECT CAST(0 AS BIGINT), (SELECT list([p]) FROM ord) UNION ALL
  SELECT k, CASE WHEN a <> b AND len(list_filter(flatten(list_transform(a, lambda u: list_transform(b, lambda v: least(u, v) * 1000000 + greatest(u, v)))), lambda z: NOT list_contains(pairs, z))) = 0
    THEN list_append(list_filter(g, lambda m: m <> a AND m <> b), CASE WHEN len(a) >= len(b) THEN list_concat(a, b) ELSE list_concat(b, a) END) ELSE g END
  FROM (SELECT se.k, g, list_filter(g, lambda m: list_contains(m, x))[1] AS a, list_filter(g, lambda m: list_contains(m, y))[1] AS b, pairs FROM link JOIN se ON se.k = link.k + 1 CROSS JOIN ek)),
gl AS (SELECT unnest(g) AS m FROM (SELECT arg_max(g, k) AS g FROM link)),
comp AS (SELECT min(fn_id) OVER (PARTITION BY m) AS component, fn_id, list_position(m, p) - 1 AS member_pos FROM (SELECT m, unnest(m) AS p FROM gl WHERE len(m) > 1) JOIN ord USING (p))"""


MEMBERS = """
sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY component),
m AS (SELECT component AS cluster_id, fn_id, member_pos FROM comp JOIN sizes USING (component) WHERE n >= 3 AND n < 0.05 * (SELECT count(*) FROM fns))"""
#: The threshold of the analysis of events: components are far from cliques there, and there are near misses.
LOOSE = 0.65
BELOW = f"""
below AS (SELECT i AS fn_id FROM sc WHERE geo < {LOOSE} UNION SELECT j FROM sc WHERE geo < {LOOSE}),
lone AS (SELECT * FROM ft WHERE fn_id IN (SELECT fn_id FROM below) AND fn_id NOT IN (SELECT fn_id FROM comp))"""
#: The members' common subsequence: st2 folds member r's sequence into what is common so far, one token (i) after the other. A row
#: of the table holds the subsequences themselves; of equally long ones the last counts, as when going back from the ends.
COMMON = """
sq AS (SELECT cluster_id, list(enc ORDER BY member_pos) AS bs FROM m JOIN ft USING (fn_id) GROUP BY cluster_id),
st2(cluster_id, r, i, a, cells) AS (SELECT cluster_id, CAST(2 AS BIGINT), CAST(0 AS BIGINT), bs[1], list_transform(range(length(bs[2]) + 1), lambda z: '') FROM sq UNION ALL
  SELECT cluster_id, CASE WHEN i < length(a) THEN r ELSE r + 1 END, CASE WHEN i < length(a) THEN i + 1 ELSE 0 END, CASE WHEN i < length(a) THEN a ELSE cells[-1] END,
    CASE WHEN i < length(a) THEN list_concat([''], list_transform(range(1, length(bs[r]) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
      {'l': length(CASE WHEN a[i + 1] = bs[r][k] THEN cells[k] || a[i + 1] ELSE cells[k + 1] END), 'k': k, 's': CASE WHEN a[i + 1] = bs[r][k] THEN cells[k] || a[i + 1] ELSE cells[k + 1] END})).s))
    ELSE list_transform(range(coalesce(length(bs[r + 1]), 0) + 1), lambda z: '') END
  FROM st2 JOIN sq USING (cluster_id) WHERE r <= len(bs)),
cmn AS (SELECT st2.cluster_id, CASE WHEN a = '' THEN [] ELSE list_transform(string_split(a, ''), lambda x: ord(x) - 33) END AS common FROM st2 JOIN sq USING (cluster_id) WHERE r = len(bs) + 1 AND i = 0)"""
EXACT = """
eg AS (SELECT min(fn_id) OVER (PARTITION BY key) AS cluster_id, fn_id, row_number() OVER (PARTITION BY key ORDER BY fn_id) - 1 AS member_pos, count(*) OVER (PARTITION BY key) AS n FROM ft WHERE len(t) > 0),
m AS (SELECT cluster_id, fn_id, member_pos FROM eg WHERE n >= 2)"""
_ARITH = f"({_SEQ.format('a.enc', 'b.enc')} + {_JACCARD.format('a.imps', 'b.imps')} + {_JACCARD.format('a.calls', 'b.calls')}) / 3.0"
_GEO = f"cbrt(({_SEQ.format('a.enc', 'b.enc')}) * ({_JACCARD.format('a.imps', 'b.imps')}) * ({_JACCARD.format('a.calls', 'b.calls')}))"


def _member_scores(kind: str) -> str:
    return f"""
ms AS (SELECT x.cluster_id, x.fn_id, avg({_ARITH if kind == 'arith' else _GEO}) AS score FROM m x JOIN m y ON x.cluster_id = y.cluster_id AND x.fn_id <> y.fn_id
       JOIN ft a ON a.fn_id = x.fn_id JOIN ft b ON b.fn_id = y.fn_id GROUP BY ALL)"""


STATS = """
st AS (SELECT cluster_id, avg(score) AS mean_score, coalesce(stddev_samp(score), 0) AS std_score, count(*) AS size FROM ms GROUP BY cluster_id)"""
COHERENCE = f"""
co AS (SELECT x.cluster_id, avg({_JACCARD.format('a.imps', 'b.imps')}) AS coherence, avg({_JACCARD.format('a.calls', 'b.calls')}) AS call_coherence
       FROM m x JOIN m y ON x.cluster_id = y.cluster_id AND x.fn_id < y.fn_id JOIN ft a ON a.fn_id = x.fn_id JOIN ft b ON b.fn_id = y.fn_id GROUP BY ALL)"""
CLUSTERS = """
pk AS (SELECT cluster_id, count(DISTINCT package) AS packages, avg(cyclo) AS cyclo_mean FROM m JOIN ft USING (fn_id) GROUP BY cluster_id),
cl AS (SELECT *, CASE WHEN std_score < 0.05 THEN 'high' WHEN std_score < 0.12 THEN 'medium' ELSE 'low' END AS tier FROM st JOIN co USING (cluster_id) JOIN pk USING (cluster_id)),
cs AS (SELECT *, CASE WHEN size <= 1 THEN 0 ELSE ln(size) * ln(1 + packages) * CASE tier WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END * mean_score * mean_score * (coherence + call_coherence) / 2 END AS composite_score FROM cl)"""
MEDOIDS = """
md AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, okey, file_path, fn_id) AS rank, fn_id, score FROM ms JOIN ft USING (fn_id))"""
NEAR = f"""
gate AS (SELECT lone.fn_id, md.cluster_id FROM lone CROSS JOIN md JOIN ft b ON b.fn_id = md.fn_id JOIN lone a ON a.fn_id = lone.fn_id WHERE md.rank = 1 AND ({_SEQ.format('a.enc', 'b.enc')}) >= 0.30),
parts AS (SELECT a.fn_id, m.cluster_id, count(*) AS n, avg({_SEQ.format('a.enc', 'b.enc')}) AS seq_score, avg({_JACCARD.format('a.imps', 'b.imps')}) AS imp_score, avg({_JACCARD.format('a.calls', 'b.calls')}) AS call_score, any_value(a.cyclo) AS cyclo
          FROM gate JOIN lone a USING (fn_id) JOIN m ON m.cluster_id = gate.cluster_id JOIN ft b ON b.fn_id = m.fn_id GROUP BY ALL),
nm0 AS (SELECT parts.*, (seq_score + imp_score + call_score) / 3.0 AS arith_score, cyclo - cyclo_mean AS cyclo_delta, mean_score, std_score FROM parts JOIN cs USING (cluster_id)),
nm AS (SELECT * FROM nm0 WHERE arith_score >= {LOOSE} + n / (n + 5.0) * greatest(mean_score - 1.5 * std_score - {LOOSE}, 0))"""
MODAL = """
mc AS (SELECT cluster_id, key, count(*) AS n FROM m JOIN ft USING (fn_id) GROUP BY ALL),
mk AS (SELECT cluster_id, key AS seq_key, substr(sha256(key), 1, 16) AS h FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, key) AS r FROM mc) WHERE r = 1),
mo AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY okey, file_path, fn_id) AS r, okey, file_path, fn_id FROM m JOIN ft USING (fn_id)),
md1 AS (SELECT cluster_id, seq_key, h, row_number() OVER (PARTITION BY h ORDER BY okey, file_path, fn_id) - 1 AS again FROM mk JOIN mo USING (cluster_id) WHERE r = 1),
shape AS (SELECT cluster_id, seq_key, CASE WHEN again = 0 THEN h ELSE h || '-' || again END AS shape_hash FROM md1)"""


def q(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


def _top(column: str) -> str:
    return f"""
top AS (SELECT cluster_id, key, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, key) AS r FROM (SELECT cluster_id, unnest({column}) AS key FROM m JOIN ft USING (fn_id)) GROUP BY cluster_id, key),
tops AS (SELECT cluster_id, array_to_string(list(key ORDER BY r), '|') AS top FROM top WHERE r <= 5 GROUP BY cluster_id)"""


_D = (DOCS, FEATURES)
_B = (*_D, BLOCK)
_S = (*_B, SHARED, _scored())
_G = (*_S, _greedy(0.75))
_M = (*_G, MEMBERS)
_C = (*_M, _member_scores("arith"), STATS, COHERENCE, CLUSTERS)
_E = (EVENTS, FEATURES, BLOCK, SHARED, _scored(), _greedy(LOOSE), MEMBERS)
_T = (*_E, BELOW, _member_scores("arith"), STATS, COHERENCE, CLUSTERS, MEDOIDS, NEAR)
_SEQUENCES = "SELECT fn_id, name, package, array_to_string(t, ',') AS seq_key, array_to_string(imps, '|') AS direct_imports, array_to_string(calls, '|') AS call_targets FROM fns"
_ROUND = "round(seq_s, 6) AS seq_s, round(imp_s, 6) AS imp_s, round(call_s, 6) AS call_s, round(geo, 6) AS geo"
_NAMES = "[" + ", ".join(f"'{t}'" for t in TOKENS) + "]"


def _token(x: str, other: str) -> str:
    return f"CASE WHEN {x} < {len(TOKENS)} THEN {_NAMES}[{x} + 1] ELSE '{other}' || {x} END"


def _shape(seq: str) -> str:
    return f"array_to_string(list_transform({seq}, lambda x: {_token('x', 'T')}), ' ')"


def _lists() -> str:
    """top-5 lists of each cluster: ti for imports, tc for calls."""
    return ", ".join(f"t{k} AS (SELECT cluster_id, list(key ORDER BY r) AS top FROM (SELECT cluster_id, key, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, key) AS r FROM (SELECT cluster_id, unnest({c}) AS key FROM m JOIN ft USING (fn_id)) GROUP BY cluster_id, key) WHERE r <= 5 GROUP BY cluster_id)" for k, c in (("i", "imps"), ("c", "calls")))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY arith_score DESC, shape_hash) AS rank FROM nm JOIN shape USING (cluster_id))"


def _deltas() -> str:
    """dl: each near miss and its best candidate, with what it adds and lacks."""
    bag = lambda a, b: f"list_sort(list_transform(flatten(list_transform(list_distinct({a}), lambda x: list_transform(range(greatest(len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x)), 0)), lambda k: x))), lambda x: {_token('x', 'tok')}))"
    items = lambda a, b: f"list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
    both = {"tokens": (bag, "t", "common"), "imports": (items, "imps", "ti.top"), "calls": (items, "calls", "tc.top")}
    columns = ", ".join(f"{f(x, y)} AS {n}_{w}" for n, (f, a, b) in both.items() for w, x, y in (("added", a, b), ("removed", b, a)))
    return f"{_RANKED}, {_lists()}, dl AS (SELECT fn_id, cluster_id, shape_hash, cyclo_delta, name, ft.package, file_path, t, common, {columns} FROM ranked JOIN ft USING (fn_id) JOIN cmn USING (cluster_id) JOIN ti USING (cluster_id) JOIN tc USING (cluster_id) WHERE rank = 1)"


def _quantiles() -> str:
    cols = {"cyclo": "cyclo", "nesting": "nesting", "calls": "ncalls", "early_returns": "early", "defers": "defers"}
    return ", ".join(f"round(quantile_cont({c}::DOUBLE, {x}), 6) AS {n}_{p}" for n, c in cols.items() for p, x in (("p50", 0.5), ("p75", 0.75), ("p95", 0.95)))


def _list_diff(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), '|')"


def _bag_diff(a: str, b: str) -> str:
    return f"array_to_string(list_sort(flatten(list_transform(list_distinct({a}), lambda x: list_transform(range(greatest(len(list_filter({a}, lambda y: y = x)) - len(list_filter({b}, lambda y: y = x)), 0)), lambda k: x)))), ',')"


_BUCKET = "CASE WHEN score >= 0.95 THEN 4 WHEN score >= 0.85 THEN 3 WHEN score >= 0.75 THEN 2 WHEN score >= 0.65 THEN 1 ELSE 0 END"


def _histogram(counts: str, labels: tuple[str, ...]) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""
hc AS ({counts}), hl(bucket, label) AS (VALUES {rows}),
hi AS (SELECT bucket, label, coalesce(n, 0) AS count FROM hl LEFT JOIN hc USING (bucket)),
hist AS (SELECT bucket, label, count, CAST(floor(count * 100 / greatest(max(count) OVER (), 1)) AS INT) AS width FROM hi)"""


_SCORE_HIST = _histogram(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT cluster_id, avg(score) AS score FROM ms GROUP BY cluster_id) GROUP BY 1", ("0.55 – 0.65", "0.65 – 0.75", "0.75 – 0.85", "0.85 – 0.95", "0.95 – 1.00"))
_SIZE_HIST = _histogram("SELECT CASE WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END AS bucket, count(*) AS n FROM (SELECT cluster_id, count(*) AS n FROM m GROUP BY cluster_id) GROUP BY 1", ("3 – 4", "5 – 9", "10+"))

SNAPS = """
sg AS (SELECT user_id, event_type, date_trunc('week', ts) AS week, coalesce(avg(value), 0) AS score FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
wk AS (SELECT week, row_number() OVER (ORDER BY week) - 1 AS idx FROM (SELECT DISTINCT week FROM sg)),
s AS (SELECT 'v1.' || idx || '.0' AS tag, idx, event_type AS package, 'user' || user_id AS func, '/work/repo/f' || (user_id % 7) AS file, 'c' || (user_id % 11) || '_' || event_type AS cluster, score FROM sg JOIN wk USING (week)),
rel AS (SELECT tag, idx, count(DISTINCT cluster) AS clusters, count(*) AS functions, idx * 604800 AS ts FROM s GROUP BY ALL)"""
TRACK = """
cn AS (SELECT package, func, cluster, row_number() OVER (PARTITION BY package, func ORDER BY count(*) DESC, min(idx)) AS r FROM s GROUP BY package, func, cluster),
track AS (SELECT package, func, arg_max(file, idx) AS file, arg_min(tag, idx) AS first_seen, arg_max(tag, idx) AS last_seen, count(*) AS num_releases, string_agg(tag, ';' ORDER BY idx) AS release_list,
          round(avg(score), 6) AS mean_score, any_value(cn.cluster) AS top_cluster FROM s JOIN cn USING (package, func) WHERE r = 1 GROUP BY package, func)"""
CTRACK = """
cz AS (SELECT tag, idx, cluster AS shape_hash, count(*) AS size FROM s GROUP BY ALL),
ctrack AS (SELECT shape_hash, min(idx) AS first_seen_idx, arg_min(tag, idx) AS first_seen_release, count(*) AS num_releases_present, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS release_indices, string_agg(size::VARCHAR, ',' ORDER BY idx) AS sizes FROM cz GROUP BY shape_hash)"""
RESOLVED = """
res AS (SELECT package, func, file, tag AS outlier_in, (SELECT any_value(tag) FROM rel r WHERE r.idx = s.idx + 1) AS resolved_by,
        CASE WHEN EXISTS (SELECT 1 FROM s n WHERE n.idx = s.idx + 1 AND n.cluster = s.cluster) THEN 'rejoined_cluster' WHEN EXISTS (SELECT 1 FROM s n WHERE n.idx = s.idx + 1 AND n.file = s.file) THEN 'fixed_or_refactored' ELSE 'deleted_or_moved' END AS resolution,
        cluster AS top_cluster, round(score, 6) AS score_at_disappearance
        FROM s WHERE idx < (SELECT max(idx) FROM s) AND NOT EXISTS (SELECT 1 FROM s n WHERE n.idx = s.idx + 1 AND n.package = s.package AND n.func = s.func))"""
FINDINGS = """
f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CASE l_linenumber % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'A' ELSE 'B' END AS pass, 'CWE-' || (CAST(floor(l_discount * 100) AS BIGINT) + 70) AS cwe,
      CASE CAST(floor(l_quantity / 13) AS INT) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Info' END AS severity, CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE 'c' || (l_suppkey % 10) END AS row,
      CASE l_returnflag WHEN 'R' THEN 'refuted' WHEN 'A' THEN 'partial' ELSE 'confirmed' END AS status, CASE WHEN l_suppkey % 2 = 0 THEN 'unique' ELSE 'assisted' END AS leverage, CASE WHEN l_suppkey % 3 = 0 THEN 'novel' ELSE '?' END AS known
      FROM lineitem WHERE l_discount IS NOT NULL)"""


def _drift(field: str) -> str:
    return f"""SELECT '{field}' AS field, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev, round(arg_max(v, idx) - arg_min(v, idx), 6) AS drift, round(max(jump), 6) AS max_jump, round(stddev_samp(v) / avg(v), 6) AS cv,
    CASE WHEN count(*) < 2 THEN 'insufficient' WHEN stddev_samp(v) / avg(v) < 0.03 THEN 'stable' WHEN stddev_samp(v) / avg(v) < 0.08 THEN 'moderate' ELSE 'variable' END AS verdict
    FROM (SELECT idx, {field}::DOUBLE AS v, abs({field} - lag({field}) OVER (ORDER BY idx))::DOUBLE AS jump FROM rel)"""


def _persistence(table: str, counts: str, brief: int, high: float, low: float) -> str:
    half = f"avg(CASE WHEN {counts} >= (SELECT count(*) FROM rel) / 2.0 THEN 1.0 ELSE 0 END)"
    return f"""count(*) AS total_unique, count(*) FILTER ({counts} >= (SELECT count(*) FROM rel) / 2.0) AS persistent, count(*) FILTER ({counts} <= {brief}) AS brief, count(*) FILTER ({counts} = (SELECT count(*) FROM rel)) AS universal,
    round({half}, 6) AS persistence_ratio, CASE WHEN {half} > {high} THEN 'high' WHEN {half} > {low} THEN 'moderate' ELSE 'low' END AS verdict"""


def _commit(kind: str) -> str:
    pattern, whole = COMMIT_KINDS[kind]
    return f"count(*) FILTER (regexp_matches(subject, '(?i)\\b{pattern}{chr(92) + 'b' if whole else ''}')) AS {kind}"


def oracle_sql() -> dict[str, str]:
    out = {f"{n}_sequences": q(_SEQUENCES, base) for n, base in (("docs", DOCS), ("pages", PAGES), ("events", EVENTS), ("orders", ORDERS))}
    out["window_hashes"] = q("SELECT fn_id, array_to_string(hashes, ',') AS token_seq_hash FROM ft", *_D)
    out["encoded"] = q(f"SELECT fn_id, enc, substr(sha256(key), 1, 16) AS shape_hash, array_to_string(list_transform(t, lambda x: CASE WHEN x < {len(TOKENS)} THEN {_NAMES}[x + 1] ELSE 'T' || x END), ' ') AS shape FROM ft", *_D)
    out["eligible"] = q("SELECT fn_id FROM able", *_D, BLOCK)
    out["function_order"] = q("SELECT fn_id, row_number() OVER (ORDER BY okey, file_path, fn_id) - 1 AS position FROM ft", *_D)
    out["postings"] = q("SELECT * FROM post", *_B)
    out["doc_freq"] = q("SELECT * FROM freq", *_B)
    out["stop_buckets"] = q("SELECT * FROM freq WHERE freq > 300", PAGES, FEATURES, BLOCK)
    out["shared_pairs"] = q("SELECT * FROM shared", *_B, SHARED)
    out["pair_scores"] = q(f"SELECT i, j, shared, {_ROUND} FROM sc", *_S)
    out["event_pair_scores"] = q(f"SELECT i, j, shared, {_ROUND} FROM sc", EVENTS, FEATURES, BLOCK, SHARED, _scored())
    out["candidate_edges"] = q("SELECT i, j, round(geo, 6) AS geo FROM sc WHERE geo >= 0.75", *_S)
    out["scored_below"] = q("SELECT i AS fn_id FROM sc WHERE geo < 0.75 UNION SELECT j FROM sc WHERE geo < 0.75", *_S)
    out["self_pairs"] = q("SELECT fn_id AS i, CAST(sum(mult * (mult - 1) // 2) AS BIGINT) AS shared FROM usable WHERE mult > 1 GROUP BY fn_id", *_B, SHARED)
    out["components"] = q("SELECT fn_id, component FROM comp", *_S, COMPONENTS)
    out["groups"] = q("SELECT component AS cluster_id, fn_id FROM comp", *_G)
    out["clusters"] = q("SELECT cluster_id, fn_id FROM m", *_M)
    out["orphans"] = q("SELECT fn_id FROM (SELECT i AS fn_id FROM sc WHERE geo < 0.75 UNION SELECT j FROM sc WHERE geo < 0.75) WHERE fn_id NOT IN (SELECT fn_id FROM comp)", *_G)
    out["event_groups"] = q("SELECT component AS cluster_id, fn_id, member_pos FROM comp", *_E)
    out["event_clusters"] = q("SELECT cluster_id, fn_id FROM m", *_E)
    out["event_orphans"] = q("SELECT fn_id FROM lone", *_E, BELOW)
    out["common_sequence"] = q("SELECT cluster_id, array_to_string(common, ',') AS common_seq FROM cmn", *_E, COMMON)
    out["exact_shape_groups"] = q("SELECT * FROM m", *_D, EXACT)
    out["modal_shape"] = q("SELECT * FROM shape", *_M, MODAL)
    out["shape_disambiguation"] = q("SELECT cluster_id, shape_hash FROM shape", *_D, "m AS (SELECT min(fn_id) OVER (PARTITION BY lang, key) AS cluster_id, fn_id FROM ft WHERE len(t) > 0)", MODAL)
    avg = lambda c, n: f"round(avg({c}), 6) AS {n}"
    out["profile"] = q(
        f"""SELECT cluster_id, count(*) AS size, count(DISTINCT package) AS packages, min(cyclo) AS cyclo_min, max(cyclo) AS cyclo_max, {avg('cyclo', 'cyclo_mean')}, round(stddev_pop(cyclo), 6) AS cyclo_std, min(ncalls) AS calls_min, max(ncalls) AS calls_max,
        {avg('ncalls', 'calls_mean')}, max(nesting) AS nesting_max, {avg('(defers > 0)::INT', 'defer_rate')}, {avg('(early > 0)::INT', 'early_return_rate')}, {avg('ctx::INT', 'context_rate')}, {avg('err::INT', 'error_rate')}, {avg('(go > 0)::INT', 'goroutine_rate')},
        {_quantiles()} FROM m JOIN ft USING (fn_id) GROUP BY cluster_id""", *_D, EXACT)  # fmt: skip
    out["top_imports"] = q("SELECT * FROM tops", *_M, _top("imps"))
    out["top_call_targets"] = q("SELECT * FROM tops", *_M, _top("calls"))
    out["coherence"] = q("SELECT cluster_id, round(coherence, 6) AS coherence, round(call_coherence, 6) AS call_coherence FROM co", *_D, EXACT, COHERENCE)
    for kind in ("arith", "geo"):
        out[f"member_{kind}_scores"] = q("SELECT cluster_id, fn_id, round(score, 6) AS score FROM ms", *_M, _member_scores(kind))
    out["cluster_stats"] = q("SELECT cluster_id, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score FROM st", *_M, _member_scores("arith"), STATS)
    out["medoids"] = q("SELECT cluster_id, rank, fn_id, round(score, 6) AS score FROM md WHERE rank <= 3", *_M, _member_scores("arith"), MEDOIDS)
    out["representatives"] = q(
        """SELECT cluster_id, rank, fn_id FROM (SELECT m.cluster_id, fn_id, row_number() OVER (PARTITION BY m.cluster_id ORDER BY round(pow(x - cyclo, 2) + pow(y / 2 - nesting, 2) + pow(z - ncalls, 2), 9), member_pos) AS rank FROM m JOIN ft USING (fn_id) JOIN c USING (cluster_id)) WHERE rank <= 3""",
        *_D, EXACT, "c AS (SELECT cluster_id, avg(cyclo) AS x, max(nesting) AS y, avg(ncalls) AS z FROM m JOIN ft USING (fn_id) GROUP BY cluster_id)")
    out["cluster_table"] = q("SELECT cluster_id, size, packages, tier, round(mean_score, 6) AS mean_score, round(coherence, 6) AS coherence, round(call_coherence, 6) AS call_coherence, round(composite_score, 5) AS composite_score FROM cs", *_C)
    out["tier_counts"] = q("SELECT tier, count(*) AS clusters FROM cs GROUP BY tier", *_C)
    out["tier_rollup"] = q("SELECT coalesce(tier, 'all') AS tier, coalesce(lang, 'all') AS lang, count(*) AS clusters FROM cs JOIN md USING (cluster_id) JOIN ft USING (fn_id) WHERE rank = 1 GROUP BY CUBE (tier, lang)", *_C, MEDOIDS)
    out["ordinals"] = q("SELECT cluster_id, tier, row_number() OVER (PARTITION BY tier ORDER BY round(composite_score, 9) DESC, size DESC, cluster_id) AS ordinal FROM cs", *_C)
    out["near_misses"] = q(
        """SELECT fn_id, row_number() OVER (PARTITION BY fn_id ORDER BY arith_score DESC, shape_hash) AS rank, cluster_id, round(arith_score, 6) AS arith_score, round(seq_score, 6) AS seq_score, round(imp_score, 6) AS imp_score, round(call_score, 6) AS call_score,
        round(cyclo_delta, 6) AS cyclo_delta FROM nm JOIN shape USING (cluster_id)""", *_T, MODAL)  # fmt: skip
    first = "best AS (SELECT fn_id, cluster_id, cyclo_delta FROM (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY arith_score DESC, shape_hash) AS rank FROM nm JOIN shape USING (cluster_id)) WHERE rank = 1)"
    lists = ", ".join(f"t{k} AS (SELECT cluster_id, list(key) AS top FROM (SELECT cluster_id, key, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, key) AS r FROM (SELECT cluster_id, unnest({c}) AS key FROM m JOIN ft USING (fn_id)) GROUP BY cluster_id, key) WHERE r <= 5 GROUP BY cluster_id)" for k, c in (("i", "imps"), ("c", "calls")))
    out["delta_rows"] = q(
        f"""SELECT fn_id, cluster_id, round(cyclo_delta, 6) AS cyclo_delta, {_list_diff('imps', 'ti.top')} AS imports_added, {_list_diff('ti.top', 'imps')} AS imports_removed, {_list_diff('calls', 'tc.top')} AS calls_added, {_list_diff('tc.top', 'calls')} AS calls_removed
        FROM best JOIN ft USING (fn_id) JOIN ti USING (cluster_id) JOIN tc USING (cluster_id)""", *_T, MODAL, first, lists)  # fmt: skip
    dl = (*_T, MODAL, COMMON, _deltas())
    text = "list_concat(list_transform(tokens_added, lambda x: '+' || x), list_transform(tokens_removed, lambda x: '-' || x))"
    out["delta_tokens"] = q(f"SELECT fn_id, shape_hash, CASE WHEN len({text}) = 0 THEN '—' ELSE array_to_string({text}, '  ') END AS token_delta FROM dl", *dl)
    sides = lambda sep, names=("token", "import", "call"): ", ".join(f"array_to_string({n}s_{w}, '{sep}') AS {n}_{w}" for n in names for w in ("added", "removed"))
    each = f"rank || '/' || shape_hash || '/' || printf('%.4f', round(arith_score, 4)) || '/' || tier || '/' || size || '/' || {_shape('common')}"
    out["outliers"] = q(
        f"""SELECT fn_id, name AS func, package, file_path AS file, 1 AS line, {sides('|')}, round(cyclo_delta, 6) AS cyclo_delta, candidates FROM dl JOIN
        (SELECT fn_id, string_agg({each}, ';' ORDER BY rank) AS candidates FROM ranked JOIN cs USING (cluster_id) JOIN cmn USING (cluster_id) GROUP BY fn_id) USING (fn_id)""", *dl)  # fmt: skip
    row = " || '/' || ".join(["package", "name", _shape("t"), *[f"array_to_string({n}_{w}, '+')" for n in ("tokens", "imports", "calls") for w in ("added", "removed")]])
    out["outlier_groups"] = q(
        f"""SELECT substr(shape_hash, 1, 6) AS cluster_id, shape_hash AS cluster_hash, '' AS cluster_label, any_value({_shape('common')}) AS common_shape, any_value(tier) AS tier, string_agg({row}, ';' ORDER BY package, name) AS outliers
        FROM (SELECT dl.*, tier FROM dl JOIN cs USING (cluster_id)) GROUP BY shape_hash""", *dl)  # fmt: skip
    some = lambda w: " + ".join(f"len({n}_{w})" for n in ("tokens", "imports", "calls")) + " > 0"
    out["delta_direction"] = q("SELECT * FROM hist", *dl, _histogram(f"SELECT CASE WHEN {some('removed')} AND {some('added')} THEN 2 WHEN {some('removed')} THEN 0 ELSE 1 END AS bucket, count(*) AS n FROM dl WHERE {some('removed')} OR {some('added')} GROUP BY 1", ("missing", "extends", "mixed")))
    out["missing_tokens"] = q("SELECT token, count, CAST(floor(count * 100 / max(count) OVER ()) AS INT) AS width FROM (SELECT token, count(*) AS count FROM (SELECT unnest(tokens_removed) AS token FROM dl) GROUP BY token ORDER BY count DESC, token LIMIT 10)", *dl)
    b = [f"coalesce(sum(count) FILTER (bucket = {i}), 0)::BIGINT AS b{i}" for i in range(5)]
    verdict = "CASE WHEN total = 0 THEN 'none' WHEN body > b3 AND b4 > b3 AND b3 < (body + b4) // 3 AND clone >= 15 THEN 'bimodal' WHEN clone >= 25 THEN 'clones' WHEN loose >= 80 THEN 'conventions' WHEN b0 >= b1 AND b1 >= b2 AND b2 >= b3 AND b3 >= b4 THEN 'declining' ELSE 'spread' END"
    says = "CASE verdict WHEN 'none' THEN 'There are no clusters.' WHEN 'bimodal' THEN printf('Two populations: %d%% loose conventions under 0.85, and %d%% near copies from 0.95 on, with a gap between.', loose, clone) WHEN 'clones' THEN printf('Near copies prevail: %d%% of clusters score 0.95 or more.', clone) WHEN 'conventions' THEN printf('Conventions with variation prevail: %d%% of clusters score under 0.85.', loose) WHEN 'declining' THEN 'Counts fall steadily from the threshold upwards; no group of near copies stands out.' ELSE printf('The %d clusters are spread over the whole range; no band stands out.', total) END"
    out["score_verdict"] = q(f"SELECT total, verdict, {says} AS text FROM (SELECT *, {verdict} AS verdict FROM (SELECT *, b4 * 100 // greatest(total, 1) AS clone, body * 100 // greatest(total, 1) AS loose FROM (SELECT *, b0 + b1 + b2 + b3 + b4 AS total, b0 + b1 + b2 AS body FROM (SELECT {', '.join(b)} FROM hist))))", *_E, _member_scores("geo"), _SCORE_HIST)
    verdict = "CASE WHEN total = 0 THEN 'none' WHEN b2 >= 5 THEN 'idioms' WHEN b2 >= 1 AND b1 >= 3 THEN 'healthy' WHEN b2 = 0 AND b1 <= 2 THEN 'local' ELSE 'mixed' END"
    says = "CASE verdict WHEN 'none' THEN 'There are no clusters.' WHEN 'idioms' THEN printf('%d clusters have 10 members or more: idioms of the whole corpus.', b2) WHEN 'healthy' THEN printf('%d%% of clusters have 5 members or more: conventions recur in many places.', large) WHEN 'local' THEN printf('Patterns are local: %d clusters have 3 or 4 members, few have more.', b0) ELSE printf('%d%% of clusters have 5 members or more, %d of them 10 or more.', large, b2) END"
    out["size_verdict"] = q(f"SELECT total, verdict, {says} AS text FROM (SELECT *, {verdict} AS verdict FROM (SELECT *, (b1 + b2) * 100 // greatest(total, 1) AS large FROM (SELECT *, b0 + b1 + b2 AS total FROM (SELECT {', '.join(b[:3])} FROM hist))))", *_E, _SIZE_HIST)
    entry = f"shape_hash || '/' || tier || '/' || size || '/' || {_shape('common')} || '/' || fs"
    lone = "package || '/' || name || '/' || array_to_string(imps, '+') || '/' || cands"
    out["export"] = q(
        f"""SELECT 'events' AS repo, '' AS "commit", (SELECT count(*) FROM m) + (SELECT count(DISTINCT fn_id) FROM nm) AS corpus_size, (SELECT count(DISTINCT fn_id) FROM nm) AS unclustered_count,
        (SELECT string_agg(e, ';' ORDER BY e) FROM (SELECT {entry} AS e FROM cs JOIN shape USING (cluster_id) JOIN cmn USING (cluster_id) JOIN (SELECT cluster_id, string_agg(name, '+' ORDER BY member_pos) AS fs FROM m JOIN ft USING (fn_id) GROUP BY cluster_id) USING (cluster_id) WHERE mean_score >= 0.75)) AS clusters,
        (SELECT string_agg({lone}, ';' ORDER BY package, name) FROM ft JOIN (SELECT fn_id, string_agg(rank || ':' || shape_hash, '+' ORDER BY rank) AS cands FROM ranked GROUP BY fn_id) USING (fn_id)) AS orphans""", *dl)  # fmt: skip
    badge = lambda c, hi, lo: f"CASE WHEN {c} >= {hi} THEN 'green' WHEN {c} >= {lo} THEN 'yellow' ELSE 'red' END"
    near = "name || '#' || CASE WHEN len(string_split(file_path, '/')) <= 3 THEN file_path ELSE array_to_string(string_split(file_path, '/')[-3:], '/') END || '#1'"
    out["cluster_rows"] = q(
        f"""SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY round(composite_score, 9) DESC, size DESC, cluster_id) AS ordinal, substr(shape_hash, 1, 6) AS stable_id, shape_hash, shape_hash AS label, size, {_shape('common')} AS common_shape,
        round(av, 5) AS avg_score, {badge('av', 0.75, 0.55)} AS score_badge, round(coherence, 5) AS coherence, {badge('coherence', 0.6, 0.4)} AS coherence_badge, round(call_coherence, 5) AS call_coherence, round(cyclo_mean, 5) AS cyclo_mean,
        round(composite_score, 5) AS composite_score, CAST(least(greatest(floor(composite_score / 8.0 * 100), 0), 100) AS INT) AS bar, array_to_string(ti.top, ', ') AS imports, pks AS packages, coalesce(ps, '') AS potentials
        FROM cs JOIN shape USING (cluster_id) JOIN cmn USING (cluster_id) JOIN ti USING (cluster_id) JOIN (SELECT cluster_id, avg(score) AS av FROM gs GROUP BY cluster_id) USING (cluster_id)
        JOIN (SELECT cluster_id, string_agg(DISTINCT package, ', ' ORDER BY package) AS pks FROM m JOIN ft USING (fn_id) GROUP BY cluster_id) USING (cluster_id)
        LEFT JOIN (SELECT cluster_id, string_agg(p, ';' ORDER BY p) AS ps FROM (SELECT cluster_id, {near} AS p FROM nm JOIN ft USING (fn_id)) GROUP BY cluster_id) USING (cluster_id)""", *dl, _member_scores("geo").replace("ms AS", "gs AS"))  # fmt: skip
    out["token_delta"] = q(f"SELECT i, j, {_bag_diff('a.t', 'b.t')} AS added, {_bag_diff('b.t', 'a.t')} AS removed FROM sc JOIN ft a ON a.fn_id = i JOIN ft b ON b.fn_id = j", *_S)
    out["import_delta"] = q(f"SELECT i, j, {_list_diff('a.imps', 'b.imps')} AS added, {_list_diff('b.imps', 'a.imps')} AS removed FROM sc JOIN ft a ON a.fn_id = i JOIN ft b ON b.fn_id = j", *_S)
    out["potentials"] = q("SELECT shape_hash, string_agg(p, ';' ORDER BY p) AS potentials FROM (SELECT shape_hash, name || '#' || CASE WHEN len(string_split(file_path, '/')) <= 3 THEN file_path ELSE array_to_string(string_split(file_path, '/')[-3:], '/') END || '#1' AS p FROM nm JOIN shape USING (cluster_id) JOIN ft USING (fn_id)) GROUP BY shape_hash", *_T, MODAL)
    out["export_min_score"] = q("SELECT cluster_id, size FROM cs WHERE mean_score >= 0.95", *_C)
    out["corpus_size"] = q("SELECT (SELECT count(*) FROM m) + count(DISTINCT fn_id) AS corpus_size, count(DISTINCT fn_id) AS unclustered_count FROM nm", *_T)
    out["member_details"] = q("SELECT cluster_id, fn_id, name AS func, package, file_path AS file, 1 AS line, array_to_string(imps, '|') AS imports, array_to_string(calls, '|') AS calls FROM m JOIN ft USING (fn_id)", *_M)
    out["score_histogram"] = q("SELECT * FROM hist", *_M, _member_scores("geo"), _SCORE_HIST)
    out["size_histogram"] = q("SELECT * FROM hist", *_M, _SIZE_HIST)
    out["report_means"] = q(
        "SELECT count(*) AS total_clusters, sum(size)::BIGINT AS functions_in_clusters, round(avg(coherence), 6) AS mean_coherence, round(avg(call_coherence), 6) AS mean_call_coherence, round(avg(score), 6) AS mean_avg_score FROM co JOIN (SELECT cluster_id, count(*) AS size, avg(score) AS score FROM ms GROUP BY cluster_id) USING (cluster_id)",
        *_M, _member_scores("geo"), COHERENCE)
    out["package_coverage"] = q(
        """SELECT package, clustered, outliers, total, CAST(floor(clustered * 100 / max(total) OVER ()) AS INT) AS clustered_pct, CAST(floor(outliers * 100 / max(total) OVER ()) AS INT) AS outliers_pct FROM
        (SELECT package, count(*) FILTER (kind = 0) AS clustered, count(*) FILTER (kind = 1) AS outliers, count(*) AS total FROM (SELECT fn_id, 0 AS kind FROM m UNION ALL SELECT DISTINCT fn_id, 1 FROM nm) JOIN ft USING (fn_id) GROUP BY package ORDER BY total DESC, package LIMIT 20)""", *_T)  # fmt: skip
    out["agreement"] = q(
        """SELECT m.cluster_id, any_value(best) AS best, coalesce(any_value(p), 0) AS precision, coalesce(any_value(r), 0) AS recall, coalesce(any_value(f1), 0) AS f1 FROM m LEFT JOIN
        (SELECT cluster_id, other AS best, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY 2 * p * r / (p + r) DESC, other) AS k FROM
        (SELECT m.cluster_id, x.cluster_id AS other, count(*) / any_value(m.a)::DOUBLE AS p, count(*) / any_value(x.n)::DOUBLE AS r FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS a FROM m) m JOIN xg x USING (fn_id) GROUP BY ALL)) WHERE k = 1) b USING (cluster_id) GROUP BY m.cluster_id""",
        *_M, "xg AS (SELECT * FROM (SELECT min(fn_id) OVER (PARTITION BY key) AS cluster_id, fn_id, count(*) OVER (PARTITION BY key) AS n FROM ft WHERE len(t) > 0) WHERE n >= 2)")
    out["sweep"] = q("SELECT x::DOUBLE AS threshold, count(*) AS edges FROM sc, (SELECT unnest([0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90]) AS x) WHERE geo >= x::DOUBLE GROUP BY x", *_S)
    out["seq_sweep"] = q("SELECT x::DOUBLE AS seq_threshold, count(*) AS edges FROM sc, (SELECT unnest([0.30, 0.40, 0.50]) AS x) WHERE geo >= 0.75 AND seq_s >= x::DOUBLE GROUP BY x", *_B, SHARED, _scored(0.30))
    out["grid"] = """SELECT a::DOUBLE AS identify_threshold, b::DOUBLE AS seq_similarity_threshold, c::INT AS max_bucket, round(b::DOUBLE * 0.75, 6) AS seq_fast_reject, printf('IT=%.2f|SS=%.2f|MB=%d', a::DOUBLE, b::DOUBLE, c) AS config
        FROM (SELECT unnest([0.60, 0.65, 0.70, 0.75, 0.80, 0.85]) AS a), (SELECT unnest([0.25, 0.30, 0.35, 0.40, 0.45, 0.50]) AS b), (SELECT unnest([100, 200, 300, 400, 500]) AS c)"""
    out["eligible_count"] = q("SELECT count(*) AS eligible FROM fns WHERE len(t) >= 3", DOCS)
    out["knee"] = """SELECT threshold AS knee_threshold, round(drop, 6) AS max_drop FROM (SELECT threshold, lag(s) OVER (ORDER BY threshold DESC) - s AS drop, count(*) OVER () AS n FROM
        (SELECT threshold, sum(n) OVER (ORDER BY threshold) / sum(n) OVER ()::DOUBLE AS s FROM (SELECT round(l_discount, 2) AS threshold, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1)))
        WHERE n >= 3 AND drop >= 0.05 ORDER BY drop DESC, threshold DESC LIMIT 1"""
    # what a reader of the example's few files would write down
    rows = """
('golang', 'store', 'made', '', 6, 1, false, false, false, true, false, '', '', 'CALL_PKG', 'fmt.Println', 'fmt', 'fmt'),
('golang', 'store', 'New', '', 12, 3, false, true, true, false, false, 'int', '*Store', 'RETURN COMPOSITE_LIT CALL RETURN', '', 'context|errors|fmt|strings', ''),
('golang', 'store', 'Get', '*Store', 16, 11, true, true, false, false, false, 'context.Context|string', 'int|error!', 'IF BINARY_OP RETURN CALL_PKG RANGE IF BINARY_OP CALL_PKG RETURN RETURN CALL_PKG RETURN RETURN', 'errors.New|fmt.Errorf|strings.ToLower', 'context|errors|fmt|strings', 'context|errors|fmt|strings'),
('golang', 'store', 'watch', '*Store', 28, 13, true, false, false, false, false, 'func|chan string', '', 'DEFER CALL RANGE IF CALL CONTINUE SELECT COMM SEND COMM GO CALL_METHOD', '', 'context|errors|fmt|strings', ''),
('golang', 'store', 'sum', '', 42, 6, false, false, false, false, false, '...int', 'int', 'FOR ASSIGN BINARY_OP CALL ASSIGN RETURN RETURN', '', 'context|errors|fmt|strings', ''),
('java', 'shop', 'pay', '', 3, 0, false, false, false, false, false, '', '', 'TRY CALL_METHOD CATCH RETURN THROW', 'a|b', '', 'java.util.List')"""
    out["source_rows"] = f"SELECT * FROM (VALUES {rows}) AS v(lang, package, name, receiver, start_line, line_count, is_method, is_exported, is_constructor, generated_code, test_code, params, returns, tokens, call_targets, imports, direct_imports)"
    rows = """
('made', 1, 0, 0, 1, 0, 0, 0, false, false, false, '0,0,0,0,0,0,0,0,0'), ('New', 1, 0, 0, 1, 0, 1, 1, false, false, false, '0,0,0,0,1,0,0,0,0'), ('Get', 4, 1, 2, 3, 0, 2, 2, false, true, true, '2,0,1,0,3,0,0,0,0'),
('watch', 5, 1, 2, 3, 1, 2, 0, true, false, false, '1,0,1,1,0,1,1,1,1'), ('sum', 2, 0, 1, 1, 0, 1, 1, false, false, false, '0,1,0,0,1,0,0,0,0'), ('pay', 0, 0, 0, 0, 0, 0, 0, false, false, false, '0,0,0,0,0,0,0,0,0')"""
    out["source_features"] = f"SELECT * FROM (VALUES {rows}) AS v(name, cyclomatic_complexity, branching_depth, nesting_depth, outbound_calls, goroutine_spawns, param_count, return_count, has_func_param, has_context_param, has_error_return, flow)"
    out["source_packages"] = "SELECT 'store' AS pkg_dir, 'broken.go|made.go|store.go' AS files"
    out["advisory_names"] = "SELECT module, unnest(list_concat([module, base], list_transform(list_filter(range(2, 10), lambda n: n <> 3), lambda n: base || '/v' || n))) AS name FROM (SELECT DISTINCT 'example.org/' || source || '/v3' AS module, 'example.org/' || source AS base FROM documents WHERE source IS NOT NULL)"
    out["release_order"] = q("SELECT tag, idx FROM rel", SNAPS)
    out["outlier_tracking"] = q("SELECT * FROM track", SNAPS, TRACK)
    out["cluster_tracking"] = q("SELECT * FROM ctrack", SNAPS, CTRACK)
    out["cluster_persistence"] = q(f"SELECT {_persistence('ctrack', 'num_releases_present', 2, 0.6, 0.3)} FROM ctrack", SNAPS, CTRACK)
    out["outlier_persistence"] = q(f"SELECT {_persistence('track', 'num_releases', 1, 0.5, 0.2)}, count(*) FILTER (num_releases >= (SELECT count(*) FROM rel) / 2.0 AND mean_score > 0.5) AS persistent_high_score, round(avg(num_releases), 6) AS mean_persistence FROM track", SNAPS, TRACK)
    out["resolutions"] = q("SELECT * FROM res", SNAPS, RESOLVED)
    kinds = ", ".join(f"count(*) FILTER (resolution = '{k}') AS {n}" for n, k in (("rejoined", "rejoined_cluster"), ("fixed", "fixed_or_refactored"), ("deleted", "deleted_or_moved")))
    out["resolution_counts"] = q(f"SELECT *, round(rejoined / greatest(total, 1)::DOUBLE, 6) AS rejoined_share, CASE WHEN rejoined / greatest(total, 1)::DOUBLE > 0.3 THEN 'strong' WHEN rejoined / greatest(total, 1)::DOUBLE > 0.1 THEN 'moderate' ELSE 'weak' END AS verdict FROM (SELECT count(*) AS total, {kinds} FROM res)", SNAPS, RESOLVED)
    out["transitions"] = q("SELECT outlier_in || ' → ' || resolved_by AS transition, " + ", ".join(f"count(*) FILTER (resolution = '{k}') AS {k}" for k in ("deleted_or_moved", "fixed_or_refactored", "rejoined_cluster")) + " FROM res GROUP BY 1", SNAPS, RESOLVED)
    out["threshold_drift"] = q(_drift("clusters") + " UNION ALL " + _drift("functions"), SNAPS)
    ratio = "regr_slope(clusters / functions::DOUBLE, idx)"
    out["growth"] = q(f"SELECT round(regr_slope(clusters, idx), 6) AS cluster_slope, round(regr_slope(functions, idx), 6) AS function_slope, round({ratio}, 6) AS ratio_slope, CASE WHEN abs({ratio}) < 0.001 THEN 'stable' WHEN {ratio} > 0 THEN 'rising' ELSE 'falling' END AS verdict FROM rel", SNAPS)
    out["chains"] = q(
        "SELECT tag, 1 AS major, minor, chain, row_number() OVER (PARTITION BY chain ORDER BY bgn, minor, ts, tag) - 1 AS pos FROM r2 JOIN l3 USING (minor)", SNAPS,
        "r2 AS (SELECT 'v1.' || minor || '.' || idx AS tag, minor, ts FROM (SELECT *, CAST(floor(CASE WHEN idx % 5 = 4 THEN idx - 4 ELSE idx END / 4.0) AS INT) AS minor FROM rel))",
        "l1 AS (SELECT minor, min(ts) AS bgn, max(ts) AS fin FROM r2 GROUP BY minor)", "l2 AS (SELECT *, CASE WHEN minor > lag(minor) OVER w AND bgn > lag(fin) OVER w THEN 0 ELSE 1 END AS new FROM l1 WINDOW w AS (ORDER BY bgn, minor))",
        "l3 AS (SELECT minor, bgn, CAST(sum(new) OVER (ORDER BY bgn, minor) AS BIGINT) - 1 AS chain FROM l2)")
    out["chain_events"] = q(
        "SELECT s.tag, r.tag AS next_tag, package, func, regexp_replace(file, '^.*?/repo/', '') AS rel_file FROM s JOIN rel r ON r.idx = s.idx + 1 WHERE NOT EXISTS (SELECT 1 FROM s n WHERE n.idx = s.idx + 1 AND n.package = s.package AND n.func = s.func AND n.file = s.file)", SNAPS)
    out["commit_counts"] = f"""SELECT k, count(*) AS commits, {_commit('fix')}, {_commit('refactor')}, {_commit('feature')} FROM (SELECT l_orderkey AS k, subject, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, subject) AS r FROM lineitem JOIN
        (SELECT p_partkey, concat_ws(' ', CASE p_size % 3 WHEN 0 THEN 'fix' WHEN 1 THEN 'Refactoring' ELSE 'adds support' END, p_name) AS subject FROM part) ON l_partkey = p_partkey) WHERE r <= 30 GROUP BY k"""
    out["verdict_counts"] = """SELECT verdict, count(*) AS events, CASE WHEN verdict IN ('FIXED_TOWARD_CONVENTION', 'LIKELY_FIX') THEN 'fix' WHEN verdict = 'ARTEFACT' THEN 'artefact' ELSE 'other' END AS class FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'DELETED' WHEN event_id % 7 = 0 THEN 'ARTEFACT'
        WHEN event_id % 3 = 0 AND (event_id % 20) / 20.0 < 0.1 THEN 'MOVED' WHEN event_id % 4 > 0 AND (event_id % 11 - 5) / 50.0 > 0.05 THEN 'FIXED_TOWARD_CONVENTION' WHEN event_id % 4 > 0 AND event_id % 4 >= greatest(event_id % 3, event_id % 6) THEN 'LIKELY_FIX'
        WHEN event_id % 6 > greatest(event_id % 4, event_id % 3) THEN 'REQUIREMENT_CHANGE' WHEN event_id % 3 > 0 THEN 'REFACTOR' ELSE 'AMBIGUOUS' END AS verdict FROM events) GROUP BY verdict"""
    rank = "CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"
    out["severity_cells"] = q(f"SELECT row, cwe, ['Info', 'Low', 'Medium', 'High'][max({rank}) + 1] AS worst, count(*) AS findings FROM f GROUP BY row, cwe", FINDINGS)
    cells = q(f"SELECT row, cwe, ['i', 'L', 'M', 'H'][max({rank}) + 1] || count(*) AS cell FROM f GROUP BY row, cwe", FINDINGS)
    out["severity_matrix"] = f"SELECT row, COLUMNS(* EXCLUDE (row)) FROM (SELECT row, " + ", ".join(f"coalesce(max(cell) FILTER (cwe = 'CWE-{n}'), '·') AS \"CWE-{n}\"" for n in range(70, 81)) + f" FROM ({cells}) GROUP BY row)"
    out["weaknesses"] = q("SELECT cwe, cwe AS label, CASE arg_max(pass, (n, pass)) WHEN 'A' THEN 'structural' WHEN 'B' THEN 'semantic' ELSE 'systemic' END AS band FROM (SELECT cwe, pass, count(*) AS n FROM f GROUP BY ALL) GROUP BY cwe", FINDINGS)
    out["finding_counters"] = q(" UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS value, count(*) AS findings FROM f GROUP BY 2" for k, c in (("severity", "severity"), ("verification", "status"), ("leverage", "leverage"), ("known_status", "known"))), FINDINGS)
    out["report_gate"] = q("SELECT CASE WHEN status = 'partial' AND severity = 'High' THEN 'Medium' ELSE severity END AS severity, status, count(*) AS findings FROM f WHERE status <> 'refuted' GROUP BY ALL", FINDINGS)
    return out
