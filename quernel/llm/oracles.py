"""The queries that SQL can state, stated for DuckDB directly: by definition, not by the operators' methods."""

from __future__ import annotations

from quernel.llm import decontaminate, fixity, jaccard, line_dedup, quality, url_rules

_SPACES = r"[\x20\x09-\x0D]"

_any = lambda words: "|".join(words)  # noqa: E731  words, hyphens and underscores only
URL_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path,
      translate(regexp_extract(rest, '^[^#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM u),
r AS (SELECT * FROM (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')) t(rule, h, start, says)),
f AS (SELECT DISTINCT p.host, p.path, r.rule, r.says FROM p JOIN r ON (p.host = r.h OR suffix(p.host, '.' || r.h)) AND starts_with(p.path, r.start)),
b AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM f GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.says, CASE WHEN regexp_matches(low, '^([^/?]*[.-])?({_any(url_rules.HOST_WORDS)})([.-]|[/?:]|$)') OR regexp_matches(low, '^[^/?]*/([^?]*/)?({_any(url_rules.PATH_PARTS)})([/?.]|$)')
                               OR regexp_matches(low, '\?(.*&)?({_any(url_rules.QUERY_KEYS)})=') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b ON b.host = p.host AND b.path = p.path
"""


def _seed(mask: str) -> str:
    return f"'{mask} ' || " + " || ' ' || ".join(f"t[i + {j}]" for j, bit in enumerate(mask) if bit == "1")


def decontamination_sql(p: decontaminate.Params = decontaminate.Params()) -> str:
    span = len(p.masks[0])
    tokens = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS t"
    seeds = ", ".join(map(_seed, p.masks))
    hit = " OR ".join("(" + " AND ".join(f"e[y + {j + 1}] = 1" for j, bit in enumerate(m) if bit == "1") + ")" for m in p.masks)
    return f"""
WITH d AS (SELECT doc_id, {tokens} FROM documents), b AS (SELECT item_id, {tokens} FROM benchmark),
ds AS (SELECT doc_id, i - 1 AS pos, unnest([{seeds}]) AS seed FROM (SELECT doc_id, t, unnest(range(1, len(t) - {span} + 2)) AS i FROM d)),
bs AS (SELECT item_id, i - 1 AS item_pos, unnest([{seeds}]) AS seed FROM (SELECT item_id, t, unnest(range(1, len(t) - {span} + 2)) AS i FROM b)),
sm AS (SELECT DISTINCT len(t) AS m FROM b WHERE len(t) BETWEEN 1 AND {span - 1}),
sd AS (SELECT doc_id, i - 1 AS pos, t[i:i + m - 1] AS w FROM (SELECT doc_id, t, m, unnest(range(1, len(t) - m + 2)) AS i FROM d, sm)),
h AS (SELECT DISTINCT doc_id, item_id, pos - item_pos AS shift FROM ds JOIN bs USING (seed) UNION SELECT doc_id, item_id, pos AS shift FROM sd JOIN b ON b.t = sd.w),
e AS (SELECT doc_id, item_id, shift, len(b.t) AS m, [CAST(d.t[i + shift + 1] = b.t[i + 1] AS INT) for i in range(greatest(0, -shift), least(len(b.t), len(d.t) - shift))] AS e FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
y AS (SELECT *, unnest(list_filter(range(0, len(e) - {span} + 1), lambda y: {hit})) AS y FROM e WHERE m >= {span}),
v AS (SELECT doc_id, item_id, shift, m, e, greatest(0, y - {p.reach}) AS low, least(len(e), y + {span + p.reach}) AS high, {p.percent} AS percent FROM y
      UNION ALL SELECT doc_id, item_id, shift, m, e, a AS low, a + least({p.least}, m) AS high, {p.stretch_percent} AS percent FROM (SELECT *, unnest(range(greatest(0, y + {span} - least({p.least}, m)), least(y, len(e) - least({p.least}, m)) + 1)) AS a FROM y)),
s AS (SELECT doc_id, item_id, shift, high - low AS compared, list_sum(e[low + 1:high]) AS matched, percent, m FROM v UNION ALL SELECT doc_id, item_id, shift, m, list_sum(e), 100, m FROM e WHERE m < {span} AND len(e) = m)
SELECT doc_id, item_id, count(DISTINCT shift) AS n_places, CAST(max(matched) AS BIGINT) AS matched, CAST(-max((matched, -compared))[2] AS BIGINT) AS compared
FROM s WHERE 100 * matched >= percent * compared AND compared >= least({p.least}, m) GROUP BY 1, 2
"""


def lines_sql(p: line_dedup.Params = line_dedup.Params()) -> str:
    """Lines one edit apart share the first or the last half of the shorter one; shorter lines go as exact copies."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, line_no, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACES}+', ' ', 'g'), ' ') AS s FROM l),
v AS (SELECT s, length(s) AS len, min((doc_id, line_no)) AS first FROM n WHERE s <> '' GROUP BY 1, 2),
k AS (SELECT s, len, first, unnest(list_distinct([(u, 0, left(s, u)), (u, 1, right(s, u)), (w, 0, left(s, w)), (w, 1, right(s, w))])) AS key FROM (SELECT *, len // 2 AS u, (len - 1) // 2 AS w FROM v WHERE len >= {p.least_chars})),
c AS (SELECT DISTINCT a.s, b.s AS o, b.first FROM k a JOIN k b ON a.key = b.key AND a.s <> b.s AND abs(a.len - b.len) <= 1),
e AS (SELECT s, first FROM c WHERE CASE WHEN length(s) = length(o) THEN len(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(o, i, 1))) <= 1
      WHEN length(s) < length(o) THEN len(list_filter(range(1, length(o) + 1), lambda i: left(o, i - 1) || substr(o, i + 1) = s)) > 0
      ELSE len(list_filter(range(1, length(s) + 1), lambda i: left(s, i - 1) || substr(s, i + 1) = o)) > 0 END),
f AS (SELECT s, min(first) AS first FROM (SELECT s, first FROM v UNION ALL SELECT s, first FROM e) GROUP BY 1),
j AS (SELECT n.doc_id, n.line_no, n.raw, f.first IS NOT NULL AND f.first < (n.doc_id, n.line_no) AS late FROM n LEFT JOIN f ON f.s = n.s)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(j.raw, chr(10) ORDER BY j.line_no) FILTER (WHERE NOT j.late), '') END AS text,
       CAST(count(j.line_no) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE j.late) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""


def quality_sql(p: quality.Params = quality.Params()) -> str:
    step = "least(" + ", ".join(f"CASE WHEN {f} > {c} THEN {k} END" for k, (f, c) in enumerate(p.steps(), 1)) + ")"
    return f"""
WITH w AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
t AS (SELECT doc_id, i, i - lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, CAST(sum(least(5, step)) AS BIGINT) AS n_repeat_words FROM t GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
b AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
r AS (SELECT *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_rate, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_rate,
      coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS long_word FROM b),
f AS (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.repeat_percent} * n_words AS base_failed, {step} AS step FROM r),
g1 AS (SELECT stratum, step FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
h AS (SELECT stratum, cut, count(*) AS n, count(*) FILTER (WHERE step <= cut) AS k FROM g1, range(1, {len(p.steps()) + 1}) q(cut) GROUP BY ALL),
cert AS (SELECT stratum, CAST(max(cut) AS INT) AS cut FROM h WHERE k < n * {p.risk} AND list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p.risk}) + (n - i) * ln(1 - {p.risk})) for i in range(k + 1)]) <= {p.delta} / (SELECT count(DISTINCT stratum) FROM g1) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(step <= cut, false) AS kept, step, cut FROM f LEFT JOIN cert USING (stratum)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_sql(),
        "op3_warc_fixity": fixity.AUDIT_SQL,
        "op6_jaccard_join": jaccard.COMPONENTS_SQL,
        "op7_url_filter": URL_SQL,
        "op8_decontamination": decontamination_sql(),
        "op10_line_dedup": lines_sql(),
    }
