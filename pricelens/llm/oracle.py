"""SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from .op2_quality import RULES, STOP_WORDS, WINDOW
from .op3_chat import END, PART, START
from .op6_urls import DAMPING, LINK, ROUNDS, SITE, SUFFIXES, THRESHOLD
from .op6_urls import RULES as HOST_RULES
from .op7_mixing import BITS, MOST, WEIGHTS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULES = " AND ".join(f"{metric} {op} {threshold!r}" for metric, op, threshold in RULES)

OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) > {WINDOW}) t),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) t WHERE n > 1),
cover AS (SELECT rid, sum(least({WINDOW}, coalesce(i - before, {WINDOW})))::bigint AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) t GROUP BY 1),
m AS (SELECT doc_id, len(ws)::bigint AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, greatest(len(ls), 1) AS n_lines, greatest(len(ws), 1) AS n_any,
 len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_ellipsis FROM d LEFT JOIN cover c USING (rid)),
r AS (SELECT *, word_chars / n_any AS mean_word_chars, n_symbols / n_any AS symbol_ratio, n_stop / n_any AS stop_word_ratio, n_dup_lines / n_lines AS dup_line_ratio, n_bullet / n_lines AS bullet_line_ratio, n_ellipsis / n_lines AS ellipsis_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_RULES} AS kept FROM r"""

_ASSISTANT, _USER, _END = (s.replace("\n", "' || chr(10) || '") for s in (f"'{START}assistant\n'", f"'{START}user name='", f"'{END}'"))

OP3 = f"""WITH t AS (SELECT conv_id, coalesce('=' || conv_id::varchar, 'null') AS k, coalesce(turn, -4611686018427387904) AS turn, coalesce(floor(turn / {PART})::bigint, -1) AS part, translate(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), chr(10), ' ') AS who, replace(coalesce(text, ''), '<|im_', '< |im_') AS said FROM conversations),
x AS (SELECT t.*, speaker, who = speaker AS own, CASE WHEN who = speaker THEN {_ASSISTANT} ELSE {_USER} || who || chr(10) END AS head, row_number() OVER (PARTITION BY t.k, part, speaker ORDER BY turn, who, said) AS n, (row_number() OVER (PARTITION BY t.k, part, speaker ORDER BY turn, who, said) - 1) // {PART} AS place FROM t JOIN (SELECT DISTINCT k, who AS speaker FROM t) p ON p.k = t.k),
y AS (SELECT *, head || said || {_END} AS piece, sum(length(head) + length(said) + {len(END)}) OVER (PARTITION BY k, part, place, speaker ORDER BY n)::bigint - {len(END)} AS till FROM x)
SELECT max(conv_id) AS conv_id, speaker, part, place AS piece, count(*) AS n_turns, string_agg(piece, '' ORDER BY n) AS rendered, coalesce(string_agg((till - length(said))::varchar || ':' || till::varchar, ',' ORDER BY n) FILTER (own), '') AS mask FROM y GROUP BY k, speaker, part, place"""

_W = f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} " + " ".join(f"WHEN {i} THEN {w!r}::double" for i, w in enumerate(WEIGHTS)) + " END"

OP7 = f"""WITH d AS (SELECT doc_id, source, len({_WORDS})::bigint AS size, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint >> {60 - BITS} AS h FROM documents),
s AS (SELECT *, {MOST}::double * source_size AS full_size, {_W} AS w FROM (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1) t),
p AS (SELECT *, row_number() OVER (ORDER BY full_size / w, source NULLS LAST) AS place FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM p WINDOW b AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(full_size, coalesce((SELECT arg_min(level, place) FROM l WHERE level <= full_size / w) * w, full_size)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole FROM g),
u AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM d)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * (whole + (upto::double <= target - whole * source_size AND whole < {MOST})::int) AS taken FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source"""


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BY_LENGTH = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
_LINK = LINK.replace("'", "''")
_SUFFIXES = ", ".join(f"'{x}'" for x in SUFFIXES)


def _fit(value) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in _BY_LENGTH) + " END"


def _ranks(name: str, src: str, dst: str, seed: str) -> str:
    """Tables of one propagation: ``name`` has (host, score) after all rounds over edges src -> dst."""
    parts = [f"{name}_p AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS p FROM e)", f"{name}_0 AS (SELECT host, {seed} AS score FROM sh WHERE {seed} > 0)"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"{name}_{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT dst AS host, {DAMPING} * sum(score * p) AS score FROM {name}_{k - 1} r JOIN {name}_p q ON r.host = q.src GROUP BY 1 UNION ALL SELECT host, {1 - DAMPING} * score FROM {name}_0) t GROUP BY 1)")
    return ",\n".join(parts)


OP6 = rf"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_AZ}', '{_AZ.lower()}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
f AS MATERIALIZED (SELECT page_id, host, path, {_fit(lambda h, p, v: h + p)} AS rule, {_fit(lambda h, p, v: v)} AS fit FROM p),
up AS (SELECT DISTINCT host AS src, array_to_string(labels[CASE WHEN array_to_string(labels[-2:], '.') IN ({_SUFFIXES}) THEN -3 ELSE -2 END:], '.') AS dst FROM (SELECT host, string_split(host, '.') AS labels FROM p WHERE NOT regexp_matches(host, '[0-9]$')) t),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK}', 2)), '{_AZ}', '{_AZ.lower()}') AS dst, 1::double AS n FROM p UNION ALL SELECT src, dst, {SITE!r}::double FROM up UNION ALL SELECT dst, src, {SITE!r}::double FROM up),
e AS MATERIALIZED (SELECT src, dst, sum(n) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
sh AS MATERIALIZED (SELECT host, count(*) FILTER (fit = 'allow') / count(*) AS good, count(*) FILTER (fit = 'block') / count(*) AS bad FROM f WHERE host <> '' GROUP BY 1),
{_ranks("trust", "src", "dst", "good")},
{_ranks("against", "dst", "src", "bad")}
SELECT page_id, f.host, path, rule, CASE WHEN fit IS NOT NULL THEN fit WHEN round(coalesce(a.score, 0), 9) - round(coalesce(t.score, 0), 9) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict FROM f LEFT JOIN trust_{ROUNDS} t ON f.host = t.host LEFT JOIN against_{ROUNDS} a ON f.host = a.host"""


_AT = " ".join(f"WHEN (mask >> (ascii(filter_order[{k}]) - 65)) & 1 = 1 THEN {k}" for k in range(1, 6))

OP11 = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
m AS (SELECT doc_id, part, (len(ws) < 200)::int + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
 + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT part, filter_order, mask, n, good, toxic, CASE {_AT} ELSE 6 END AS gone FROM c, o),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
 sum(n) FILTER (gone < step AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
 FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
 coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::bigint AS shapley FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_chat_perspectives": OP3, "op6_url_filter": OP6, "op7_source_mix": OP7, "op11_filter_audit": OP11}
