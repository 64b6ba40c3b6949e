"""DuckDB SQL of the operators that SQL can express, by plainer means than the operators'."""

from __future__ import annotations

from math import log2

from objloom.llm import licenses as L
from objloom.llm import secrets as S

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Matches by splitting at the pattern; entropy by counting the characters of every window anew."""
    parts = []
    for kind, (pattern, group) in enumerate(((S.ASSIGN, 2), (S.ACCESS, 0), (S.HEX, 0), (S.CANDIDATE, 0))):
        p = _lit(pattern)
        parts.append(f"SELECT doc_id, {kind} AS kind, unnest(regexp_extract_all(t, {p}, 0)) AS v, unnest(regexp_extract_all(t, {p}, {group})) AS g, unnest(regexp_split_to_array(t, {p})[:-2]) AS b, unnest(range(len(regexp_extract_all(t, {p}, 0)))) AS i FROM d WHERE regexp_matches(t, {p})")
    allow = " OR ".join(f"regexp_matches(v, {_lit(p)})" for p in S.ALLOW)
    names = ", ".join(map(_lit, S.KINDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, (sum(length(b) + length(v)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM m),
s AS (SELECT doc_id, kind, v, g, e - length(v) AS s, e FROM p),
base AS (SELECT doc_id, kind, s, e FROM s WHERE kind = 0 AND length(g) >= 6 OR kind IN (1, 2)),
cand AS (SELECT doc_id, s, v, CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN {S.THRESHOLDS['hex']} WHEN regexp_full_match(v, '[A-Za-z0-9]+') THEN {S.THRESHOLDS['alnum']} ELSE {S.THRESHOLDS['base64']} END AS least FROM s WHERE kind = 3 AND NOT ({allow})),
win AS (SELECT doc_id, s, v, least, unnest(range(length(v) - {S.WINDOW - 1})) AS k FROM cand),
chars AS (SELECT doc_id, s, v, least, k, unnest(string_split(substr(v, k::INT + 1, {S.WINDOW}), '')) AS c FROM win),
counts AS (SELECT doc_id, s, least, k, c, count(*) AS n FROM chars GROUP BY ALL),
high AS (SELECT doc_id, s, k FROM counts GROUP BY doc_id, s, k, least HAVING {log2(S.WINDOW)!r} - sum(n * log2(n)) / {S.WINDOW} >= least),
gap AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id, s ORDER BY k) <= {S.WINDOW} THEN 0 ELSE 1 END AS new FROM high),
isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, s ORDER BY k) AS g FROM gap),
spans AS (SELECT doc_id, 3 AS kind, s + min(k) AS s, s + max(k) + {S.WINDOW} AS e FROM isle GROUP BY doc_id, s, g UNION ALL SELECT * FROM base),
j AS (SELECT doc_id, string_agg(list_extract([{names}], kind + 1) || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans, coalesce(string_agg(list_extract([{names}], kind + 1) || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3), '') AS b,
 count(*) FILTER (WHERE kind = 0) AS a0, count(*) FILTER (WHERE kind = 1) AS a1, count(*) FILTER (WHERE kind = 2) AS a2 FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a0, 0)::BIGINT AS n_assign, coalesce(a1, 0)::BIGINT AS n_access, coalesce(a2, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)"""


def licenses_sql() -> str:
    """Rules one after another as columns."""
    known = "MAP {" + ", ".join(f"{_lit(s)}: {_lit(k)}" for k, s in L.SENTENCES.items()) + "}"
    steps, counts = [], []
    for i, (_, seq) in enumerate(L.RULES):
        r = _lit("".join(f"<{k}>" for k in seq))
        n = len("".join(f"<{k}>" for k in seq))
        steps.append(f"replace(s{i}, {r}, '|') AS s{i + 1}, ((length(s{i}) - length(replace(s{i}, {r}, ''))) // {n})::BIGINT AS n{i}")
        counts.append(f"CASE WHEN n{i} > 0 THEN {_lit(L.RULES[i][0])} END")
    some = f"list_filter([{', '.join(counts)}], lambda x: x IS NOT NULL)"
    shown = ", ".join(f"CASE WHEN n{i} > 0 THEN {_lit(name + ':')} || n{i} END" for i, (name, _) in enumerate(L.RULES))
    total = " + ".join(f"n{i}" for i in range(len(L.RULES)))
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{L.UPPER}', '{L.LOWER}') AS t FROM documents),
s AS (SELECT doc_id, list_transform(regexp_split_to_array(regexp_replace(t, {_lit(L.OTHER)}, ' ', 'g'), {_lit(L.CUT)}), lambda x: regexp_replace(x, {_lit(L.END)}, '', 'g')) AS sents FROM d),
i AS (SELECT doc_id, list_filter(list_transform(sents, lambda x: {known}[x]), lambda x: x IS NOT NULL) AS ids FROM s),
r AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') AS s0, {', '.join(steps)} FROM i)
SELECT doc_id, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct({some})), ','), '') AS licenses, ({total})::BIGINT AS n_matches,
coalesce(array_to_string(list_filter([{shown}], lambda x: x IS NOT NULL), ','), '') AS rules FROM r"""


DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item, least(len(w), 8) AS size, unnest(list_transform(range(greatest(len(w) - 7, 1)), lambda k: array_to_string(w[k + 1:k + 8], ' '))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, size, w, unnest(range(len(w) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size),
h AS (SELECT doc_id, item, k, p.size FROM p JOIN i ON p.size = i.size AND array_to_string(p.w[k + 1:k + p.size], ' ') = i.win),
hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(its.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k + 1:k + 5], ' ')))) AS s FROM d WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS copy_id, count(*)::BIGINT AS n_copies, any_value(s) AS s FROM sets GROUP BY hash(s), s),
x AS (SELECT copy_id, len(s) AS n, unnest(s) AS g FROM c),
common AS (SELECT a.copy_id AS a, b.copy_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 5 * k >= 4 * (na + nb - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT copy_id, least(copy_id, coalesce((SELECT min(b) FROM reach WHERE a = copy_id), copy_id)) AS class_id, n_copies, (SELECT count(*) FROM link WHERE a = copy_id) AS n_links FROM c)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(c.copy_id, d.doc_id) AS copy_id, coalesce(class.n_copies, 1)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN c ON sets.s = c.s LEFT JOIN class ON class.copy_id = c.copy_id"""

SQL: dict[str, str] = {
    "op1_secrets": secrets_sql(),
    "op3_jaccard": JACCARD,
    "op8_decontamination": DECONTAMINATION,
    "op10_licenses": licenses_sql(),
}
