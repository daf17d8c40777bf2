"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations

from linkgrid.llm.common import values
from linkgrid.llm.repetition import Limits

SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def _shared(nodes: str, parents: str, child: str) -> str:
    """Water-filling of ``given`` over the children of a node, as a query over ``nodes``."""
    family = f"PARTITION BY {parents}" if parents else ""
    order = f"{family} ORDER BY ratio, {child}"
    return f"""
    SELECT * EXCLUDE (given, ratio, before, after, is_full, spent, unfilled),
           CASE WHEN is_full THEN capacity
                ELSE ((given - spent)::HUGEINT * weight // unfilled)::BIGINT END AS budget
    FROM (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({family}) AS spent,
                 sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({family}) AS unfilled
          FROM (SELECT *, capacity::HUGEINT * after <= (given - before)::HUGEINT * weight
                       AS is_full
                FROM (SELECT *, coalesce(sum(capacity) OVER (
                                    {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                                    AS before,
                             sum(weight) OVER (
                                 {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                                 AS after
                      FROM (SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 0.0 END
                                   AS ratio FROM ({nodes})))))"""


_DOMAINS = _shared(
    "SELECT domain, sum(capacity)::BIGINT AS capacity, max(w_domain) AS weight,"
    " (SELECT sum(supply) * 80 // 100 FROM leaves)::BIGINT AS given"
    " FROM leaves GROUP BY domain", "", "domain")
_LANGS = _shared(
    "SELECT l.domain, l.lang, sum(l.capacity)::BIGINT AS capacity, max(w_lang) AS weight,"
    " max(d.budget) AS given FROM leaves l JOIN domains d USING (domain)"
    " GROUP BY l.domain, l.lang", "domain", "lang")
_LEAVES = _shared(
    "SELECT l.domain, l.lang, l.source, l.supply, l.capacity, w_source AS weight,"
    " g.budget AS given FROM leaves l JOIN langs g USING (domain, lang)",
    "domain, lang", "source")

SQL["op1_mixing"] = f"""
WITH rows AS (
    SELECT doc_id,
           CASE WHEN regexp_matches(source, '[0-4]$') THEN 'web'
                WHEN regexp_matches(source, '[5-7]$') THEN 'reference' ELSE 'forum' END AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
    FROM documents),
leaves AS (
    SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply,
           sum(n_tokens)::BIGINT * 3 AS capacity,
           CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 ELSE 2 END AS w_domain,
           CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w_lang,
           CASE source WHEN 'src0' THEN 3 ELSE 1 END AS w_source
    FROM rows GROUP BY domain, lang, source),
domains AS ({_DOMAINS}),
langs AS ({_LANGS}),
budgets AS ({_LEAVES}),
keyed AS (
    SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs,
           CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest
    FROM rows JOIN budgets USING (domain, lang, source)),
ordered AS (
    SELECT *, md5('mix-1:' || epochs || ':' || doc_id) AS key FROM keyed),
placed AS (
    SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens, epochs + (before < rest)::BIGINT AS copies,
       (epochs * n_tokens + greatest(0, least(n_tokens, rest - before)))::BIGINT AS taken
FROM placed
"""

SQL["op2_ngram_join"] = """
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
sets AS (
    SELECT doc_id, CASE
        WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3),
                 lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
    FROM worded),
tokens AS (SELECT doc_id, unnest(shingles) AS token FROM sets),
sizes AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM sets),
common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
    WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY ALL
"""

SQL["op8_line_dedup"] = """
WITH split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS line_no
    FROM documents WHERE text IS NOT NULL),
lines AS (
    SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS place,
           list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS words
    FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
classes AS (SELECT words, min(place) AS place, len(words) AS n FROM lines GROUP BY words),
tokens AS (SELECT place, n, unnest(words) AS token FROM classes),
common AS (
    SELECT b.place, a.n + b.n AS total, count(*) AS c
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.place < b.place
         AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    GROUP BY a.place, b.place, a.n, b.n),
gone AS (SELECT DISTINCT place FROM common WHERE 9 * c >= 4 * total),
marked AS (
    SELECT l.doc_id, l.line_no,
           l.place > c.place OR c.place IN (SELECT place FROM gone) AS removed
    FROM lines l JOIN classes c USING (words))
SELECT d.doc_id, count(m.line_no) AS n_lines,
       coalesce(sum(m.removed::BIGINT), 0)::BIGINT AS n_removed,
       coalesce(string_agg(CASE WHEN m.removed THEN m.line_no::VARCHAR END, ','
                           ORDER BY m.line_no), '') AS removed
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN marked m USING (doc_id)
GROUP BY d.doc_id
"""

_NS = range(2, 11)
_GRAMS = "\n    UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, i, " + " || ' ' || ".join(f"w{k}" for k in range(n)) + " AS g, "
    + " + ".join(f"length(w{k})" for k in range(n)) + f" AS chars FROM led WHERE w{n - 1} IS NOT NULL"
    for n in _NS)
_LIMITS = {c: v for c, v in values(Limits()).items() if c != "min_words"}
_SHARES = ", ".join(
    [f"coalesce(max(top) FILTER (n = {n}), 0) / any_value(word_chars) AS top_{n}" for n in (2, 3, 4)]
    + [f"coalesce(max(covered) FILTER (n = {n}), 0) / any_value(word_chars) AS dup_{n}"
       for n in range(5, 11)])
_RATIOS = ["dup_line_chars", *[f"top_{n}" for n in (2, 3, 4)], *[f"dup_{n}" for n in range(5, 11)]]

SQL["op10_quality_rules"] = f"""
WITH worded AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM worded),
led AS (
    SELECT doc_id, i, {", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(10))}
    FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (
    {_GRAMS}),
counted AS (
    SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS times,
           row_number() OVER (PARTITION BY doc_id, n, g ORDER BY i) AS nth
    FROM grams),
tops AS (SELECT doc_id, n, max(times * chars) AS top FROM counted
         WHERE times > 1 AND n <= 4 GROUP BY ALL),
inside AS (
    SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM counted
    WHERE (n >= 5 AND nth > 1) OR (n = 3 AND times > 1)),
covers AS (
    SELECT x.doc_id, x.n, sum(length(w.word)) AS covered, count(*) AS n_inside
    FROM inside x JOIN words w USING (doc_id, i) GROUP BY ALL),
lines AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again,
           length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
again AS (
    SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS chars FROM lines WHERE again GROUP BY 1),
base AS (
    SELECT d.doc_id, len(d.words)::BIGINT AS n_words,
           length(array_to_string(d.words, ''))::BIGINT AS word_chars,
           length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(a.n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(a.chars, 0) AS line_chars
    FROM worded d LEFT JOIN again a USING (doc_id)),
shares AS (
    SELECT b.doc_id, any_value(n_words) AS n_words, any_value(b.word_chars) AS word_chars,
           any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines,
           coalesce(max(n_inside) FILTER (n = 3), 0)::BIGINT AS n_repeat_words,
           any_value(line_chars) / any_value(word_chars) AS dup_line_chars, {_SHARES}
    FROM base b LEFT JOIN (SELECT * FROM tops FULL JOIN covers USING (doc_id, n)) USING (doc_id)
    GROUP BY b.doc_id),
filled AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           {", ".join(f"CASE WHEN word_chars > 0 THEN {c}::DOUBLE ELSE 0.0 END AS {c}" for c in _RATIOS)}
    FROM shares)
SELECT *, NOT base_failed AND {" AND ".join(f"{c} <= {v}" for c, v in _LIMITS.items())} AS kept
FROM filled
"""


_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_INTEGERS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"


def _centroids(rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
    SELECT vec_id, v, c AS cluster, list_sum(list_transform(range(1, 65),
               lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS distance
    FROM vectors, means{r}
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
    SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*) AS n
    FROM near{r}, range(1, 65) t(i) GROUP BY cluster, i),
means{r + 1} AS (
    SELECT c, coalesce(moved, m) AS m FROM means{r} LEFT JOIN (
        SELECT cluster AS c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS moved
        FROM sums{r} GROUP BY cluster) USING (c))""")
    return f"""
WITH vectors AS MATERIALIZED (
    SELECT vec_id, {_INTEGERS} AS v FROM embeddings
    WHERE len(embedding) = 64 AND {_FINITE}),
means0 AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM vectors
    ORDER BY sha256('2:' || vec_id) LIMIT 40),
{",".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM near{rounds} JOIN (
    SELECT c, sha256(array_to_string(m, ',')) AS digest FROM means{rounds}) ON c = cluster
"""


SQL["op12_centroids"] = _centroids()

SQL["op13_hard_negatives"] = f"""
WITH vectors AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           {_INTEGERS} AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
pairs AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_sum(list_transform(
               range(1, 65), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT * FROM pairs WHERE alike
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       (row_number() OVER w)::INTEGER AS rank, n.b AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.a = n.a AND NOT n.alike
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)
QUALIFY row_number() OVER w <= 10
"""
