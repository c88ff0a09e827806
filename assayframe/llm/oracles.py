"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import decontam, quality

WORD_BREAK = r"[\x20\x09-\x0D]+"


def lower_words(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), '{decontam.UPPER}', '{decontam.LOWER}')"
    return f"list_filter(string_split_regex({folded}, '{decontam.BREAKS}'), lambda x: x <> '')"


def contamination_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """op4 over a documents relation; the relation may be a subquery."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {lower_words('text')} AS w FROM {documents}),
i AS (SELECT item_id, {lower_words('text')} AS w FROM {benchmark}),
p AS (SELECT DISTINCT item_id, len(p) AS l, array_to_string(p, ' ') AS p FROM (
    SELECT item_id, unnest(CASE WHEN len(w) <= 13 THEN [w] ELSE list_transform(range(0, len(w) - 12), lambda k: w[k + 1:k + 13]) END) AS p
    FROM i WHERE len(w) > 0)),
g AS (SELECT rid, l, s, array_to_string(w[s + 1:s + l], ' ') AS p FROM (
    SELECT rid, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM p))),
h AS MATERIALIZED (SELECT rid, s, l, item_id FROM g JOIN p USING (l, p)),
hit AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(s, s + l)) AS x FROM h) GROUP BY rid),
item AS (SELECT rid, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN item USING (rid)
"""


def _quantiles(table: str, keys: str, shares: dict[str, float]) -> str:
    picks = ", ".join(f"min(CASE WHEN upto >= {q} * total THEN bin END) AS {name}" for name, q in shares.items())
    return f"""SELECT {keys}, {picks} FROM (SELECT {keys}, bin, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY {keys}) AS total FROM {table}) GROUP BY {keys}"""


def _distances(rows: str, estimates: str, more: str = "", how: str = "") -> str:
    """Squared distances of rows (g, ...) by the estimates of the same group g."""
    names = quality.NAMES
    sql = f"(SELECT r.*, {more} {', '.join(f'e.{c}' for c in quality.ESTIMATE)} FROM {rows} r {how} JOIN {estimates} e USING (g))"
    for i, a in enumerate(names):
        s = f"{a} - m_{a}" + "".join(f" - l_{a}_{c} * z_{c}" for c in names[:i])
        sql = f"(SELECT *, ({s}) / l_{a}_{a} AS z_{a} FROM {sql})"
    return f"SELECT *, {' + '.join(f'z_{a} * z_{a}' for a in names)} AS d2 FROM {sql}"


def _moments(rows: str, keys: str, scale: float) -> str:
    q = quality
    out = f"(SELECT {keys}, {', '.join(f'avg({a}) AS m_{a}' for a in q.NAMES)}, {', '.join(f'avg({a} * {b}) AS p_{a}_{b}' for a, b in q.ENTRIES)} FROM {rows} GROUP BY {keys})"
    for a, b in q.ENTRIES:
        s = f"{scale} * (p_{a}_{b} - m_{a} * m_{b})" + (f" + {q.FEATURES[a][1] ** 2}" if a == b else "")
        s += "".join(f" - l_{a}_{c} * l_{b}_{c}" for c in q.NAMES[: q.NAMES.index(b)])
        e = f"sqrt(greatest({s}, 1e-9))" if a == b else f"({s}) / l_{b}_{b}"
        out = f"(SELECT *, {e} AS l_{a}_{b} FROM {out})"
    return f"SELECT {keys}, {', '.join(q.ESTIMATE)}, 2 * ({' + '.join(f'ln(l_{a}_{a})' for a in q.NAMES)}) AS logdet FROM {out}"


#: Concentration steps that the SQL writes out; the operator goes on until no determinant falls, which is sooner on small tables.
STEPS = 16


def quality_ctes(documents: str = "documents") -> str:
    """CTEs of op10 that end in ``judged`` (all columns of documents, statistics, base_failed, d2, kept)."""
    names, q = quality.NAMES, quality
    words = f"list_filter(string_split_regex(coalesce(text, ''), '{WORD_BREAK}'), lambda x: x <> '')"
    key = lambda c: f"coalesce({c}, '<null>')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    out = f"""
d AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, {words} AS w FROM {documents}),
win AS (SELECT rid, s, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
rep AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(s, s + 3)) AS x FROM (
    SELECT rid, s, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE length(translate(line, {blanks}, '')) > 0 GROUP BY rid),
s AS (SELECT d.*, len(w)::BIGINT AS n_words, length(translate(coalesce(text, ''), {blanks}, ''))::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
b AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN NOT base_failed THEN {e} END AS {x}' for x, (e, _) in q.FEATURES.items())}
    FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)),
fit AS MATERIALIZED (SELECT lang, source, {', '.join(names)} FROM (SELECT DISTINCT lang, source, text, {', '.join(names)} FROM b WHERE NOT base_failed)),
grp AS MATERIALIZED (SELECT lang, source, count(*) AS n FROM fit GROUP BY ALL),
lng AS MATERIALIZED (SELECT lang, sum(n) AS n_lang, min(n) AS least FROM grp GROUP BY lang),
al AS (SELECT sum(n_lang) AS n_all, min(n_lang) AS least_lang FROM lng),
lev AS MATERIALIZED (SELECT grp.lang, grp.source, n, n_lang, n_all, least, least_lang,
    CASE WHEN n >= {q.LEAST} THEN '0|' || {key('grp.lang')} || '|' || {key('grp.source')} WHEN n_lang >= {q.LEAST} THEN '1|' || {key('grp.lang')} WHEN n_all >= {q.LEAST} THEN '2' END AS g
    FROM grp JOIN lng ON grp.lang IS NOT DISTINCT FROM lng.lang, al),
fl AS (SELECT fit.*, lev.* EXCLUDE (lang, source) FROM fit JOIN lev ON fit.lang IS NOT DISTINCT FROM lev.lang AND fit.source IS NOT DISTINCT FROM lev.source),
fed AS MATERIALIZED (SELECT g, {', '.join(names)} FROM fl WHERE n >= {q.LEAST}
    UNION ALL SELECT '1|' || {key('lang')}, {', '.join(names)} FROM fl WHERE least < {q.LEAST} AND n_lang >= {q.LEAST}
    UNION ALL SELECT '2', {', '.join(names)} FROM fl WHERE least_lang < {q.LEAST} AND n_all >= {q.LEAST}),
bins AS (SELECT g, feature, bin, count(*) AS n FROM (
    {' UNION ALL '.join(f"SELECT g, '{x}' AS feature, floor({x} * 1000) AS bin FROM fed" for x in names)}) GROUP BY ALL),
quart AS ({_quantiles('bins', 'g, feature', {'q1': 0.25, 'q2': 0.5, 'q3': 0.75})}),
start AS ({' UNION ALL '.join(f"SELECT g, {k} AS start, feature, {c} AS mid, {w} AS width FROM quart" for k, (c, w) in enumerate(q.STARTS))}),
e0 AS MATERIALIZED (SELECT g, start, {', '.join(f"max(CASE WHEN feature = '{x}' THEN mid END) / 1000.0::DOUBLE AS m_{x}" for x in names)},
    {', '.join((f"sqrt(pow(max(CASE WHEN feature = '{a}' THEN width END) / 1349.0::DOUBLE, 2) + {q.FEATURES[a][1] ** 2})" if a == b else '0.0::DOUBLE') + f' AS l_{a}_{b}' for a, b in q.ENTRIES)},
    NULL::DOUBLE AS logdet, true AS going FROM start GROUP BY g, start),"""
    values = [*q.ESTIMATE, "logdet"]
    for k in range(STEPS):
        out += f"""
go{k} AS (SELECT * FROM e{k} WHERE going),
dist{k} AS MATERIALIZED (SELECT g, start, {', '.join(names)}, floor(ln(1 + d2) * {q.BINS}) AS bin FROM ({_distances('fed', f'go{k}', 'e.start,')})),
count{k} AS (SELECT g, start, bin, count(*) AS n FROM dist{k} GROUP BY ALL),
edge{k} AS ({_quantiles(f'count{k}', 'g, start', {'edge': q.SHARE})}),
near{k} AS (SELECT dist{k}.* FROM dist{k} JOIN edge{k} USING (g, start) WHERE bin <= edge),
new{k} AS ({_moments(f'near{k}', 'g, start', q.FACTOR)}),
e{k + 1} AS MATERIALIZED (SELECT g, start, {', '.join(f'CASE WHEN o.logdet < n.logdet THEN o.{c} ELSE n.{c} END AS {c}' for c in values)},
    o.logdet IS NULL OR o.logdet - n.logdet >= {q.FALL} AS going FROM new{k} n JOIN go{k} o USING (g, start)),"""
    return out + f"""
ends AS ({' UNION ALL '.join(f'SELECT * FROM e{k + 1} WHERE NOT going' for k in range(STEPS))}),
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY logdet, start) AS place FROM ends) WHERE place = 1),
within AS (SELECT * FROM ({_distances('fed', 'best')}) WHERE d2 <= {q.NEAR}),
last AS MATERIALIZED ({_moments('within', 'g', q.NEAR_FACTOR)}),
bg AS (SELECT b.*, lev.g FROM b LEFT JOIN lev ON b.lang IS NOT DISTINCT FROM lev.lang AND b.source IS NOT DISTINCT FROM lev.source),
judged AS MATERIALIZED (SELECT *, NOT base_failed AND coalesce(d2 <= {q.CUTOFF}, true) AS kept FROM ({_distances('bg', 'last', how='LEFT')}))"""


def quality_sql() -> str:
    return f"WITH {quality_ctes()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"


def line_ctes(documents: str = "documents") -> str:
    """CTEs of op6 that end in ``lined`` (all columns of documents, n_lines, n_template_lines, n_dropped, rest)."""
    from . import lines

    n, path = lines.MIN_DOCS, ", ".join(f"t[{k}]" for k in range(1, lines.DEPTH + 1))
    split = f"list_filter(string_split_regex(%s, '{WORD_BREAK}'), lambda x: x <> '')"
    return f"""
ld AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY doc_id, text) AS u FROM {documents}),
ll AS (SELECT u, nr, {split % 'line'} AS w FROM (SELECT u, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS nr FROM (SELECT DISTINCT u, text FROM ld))),
lt AS MATERIALIZED (SELECT u, nr, w, len(w) AS k, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{lines.FIELD}' ELSE x END) AS t FROM ll WHERE len(w) > 0),
leaf AS (SELECT k, {', '.join(f't[{j}] AS k{j}' for j in range(1, lines.DEPTH + 1))} FROM lt GROUP BY ALL HAVING count(DISTINCT u) >= {n}),
lf AS MATERIALIZED (SELECT lt.*, hash(k, {path}) AS leaf, array_to_string(t, ' ') AS id FROM lt WHERE (k, coalesce(t[1], ''), coalesce(t[2], ''), coalesce(t[3], '')) IN (SELECT (k, coalesce(k1, ''), coalesce(k2, ''), coalesce(k3, '')) FROM leaf)),
di AS (SELECT leaf, id, any_value(t) AS t, count(DISTINCT u) AS n FROM lf GROUP BY leaf, id),
sp AS MATERIALIZED (SELECT leaf, id, n, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM di),
st AS (SELECT leaf, pos, token FROM sp WHERE token <> '{lines.FIELD}' GROUP BY ALL HAVING sum(n) >= {n}),
sh AS (SELECT leaf, id, string_agg(CASE WHEN st.token IS NULL THEN '{lines.FIELD}' ELSE sp.token END, ' ' ORDER BY pos) AS template,
    avg((st.token IS NOT NULL)::INT) AS share FROM sp LEFT JOIN st USING (leaf, pos, token) GROUP BY leaf, id),
ex AS MATERIALIZED (SELECT u, nr, leaf, id, array_to_string(w, ' ') AS exact FROM lf),
tp AS (SELECT leaf, template FROM ex JOIN sh USING (leaf, id) WHERE share >= {lines.STABLE} GROUP BY leaf, template HAVING count(DISTINCT u) >= {n}),
gd AS (SELECT leaf, exact FROM ex GROUP BY leaf, exact HAVING count(DISTINCT u) >= {n}
    UNION SELECT leaf, exact FROM ex JOIN sh USING (leaf, id) JOIN tp USING (leaf, template) WHERE share >= {lines.STABLE}),
mk AS (SELECT u, list(DISTINCT nr) AS marks FROM ex JOIN gd USING (leaf, exact) GROUP BY u),
lc AS MATERIALIZED (SELECT ld.*, string_split(text, chr(10)) AS lines, coalesce(marks, []) AS marks FROM ld LEFT JOIN mk USING (u)),
mj AS (SELECT DISTINCT u, list_filter(string_split_regex(translate(text, '{decontam.UPPER}', '{decontam.LOWER}'), '{WORD_BREAK}'), lambda x: x <> '') AS w FROM lc
    WHERE 2 * len({split % "array_to_string(list_filter(lines, lambda x, i: list_contains(marks, i - 1)), chr(10))"}) > len({split % "coalesce(text, '')"})),
sg AS MATERIALIZED (SELECT DISTINCT u, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g FROM mj),
sz AS (SELECT u, count(*) AS n FROM sg GROUP BY u),
pr AS (SELECT a.u, b.u AS v, count(*) AS n FROM sg a JOIN sg b ON a.g = b.g AND a.u <> b.u GROUP BY ALL),
cp AS (SELECT DISTINCT pr.u FROM pr JOIN sz x ON pr.u = x.u JOIN sz y ON pr.v = y.u WHERE 100 * pr.n >= 80 * (x.n + y.n - pr.n)),
lw AS (SELECT *, u IN (SELECT u FROM cp) AS copied, len(marks) > 0 AND u NOT IN (SELECT u FROM cp) AS cut FROM lc),
lined AS MATERIALIZED (SELECT *, coalesce(len(lines), 0)::BIGINT AS n_lines, len(marks)::BIGINT AS n_template_lines, CASE WHEN cut THEN len(marks) ELSE 0 END::BIGINT AS n_dropped,
    CASE WHEN cut THEN array_to_string(list_filter(lines, lambda x, i: NOT list_contains(marks, i - 1)), chr(10)) ELSE text END AS rest FROM lw)"""


def line_sql() -> str:
    return f"WITH {line_ctes()} SELECT doc_id, n_lines, n_template_lines, n_dropped, copied, sha256(coalesce(rest, '')) AS kept_sha256 FROM lined"


def negatives_sql() -> str:
    """Every anchor against every row."""
    return """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def trie_sql() -> str:
    """Nodes as lists of turns, each compared with every other."""
    bit = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
    step = "xor(acc, b)"
    byte = f"list_reduce(range(8), lambda x, i: {bit.format(x='x')}, {step})"
    crc = f"xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda acc, b: xor(acc // 256, {byte.replace('xor(acc, b)', 'xor(acc, b) % 256')}), 4294967295), 4294967295)"
    return f"""WITH own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, ({crc} % 6)::INT AS h FROM own),
whole AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
node AS MATERIALIZED (SELECT d AS depth, t[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(t) = d), '')) AS ends_sha256 FROM whole, LATERAL (SELECT unnest(range(len(t) + 1)) AS d) GROUP BY ALL),
up AS (SELECT c.depth, c.p, u.conv_id AS parent_conv_id FROM node c JOIN node u ON u.depth = c.depth - 1 AND u.p = c.p[1:c.depth - 1]),
kids AS (SELECT n.depth, n.p, count(c.p) AS n_children FROM node n LEFT JOIN node c ON c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p GROUP BY n.depth, n.p),
sums AS (SELECT n.depth, n.p, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum(CASE WHEN s.depth = 0 THEN 0 ELSE (s.n_convs - 1) * length(s.p[s.depth].text) END)::BIGINT AS saved_tokens
    FROM node n JOIN node s ON s.depth >= n.depth AND s.p[1:n.depth] = n.p JOIN kids k ON k.depth = s.depth AND k.p = s.p GROUP BY n.depth, n.p)
SELECT node.conv_id, node.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM node JOIN kids USING (depth, p) JOIN sums USING (depth, p) LEFT JOIN up USING (depth, p)"""
