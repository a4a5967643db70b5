"""The same results in DuckDB's SQL, where SQL can express them."""

from auditloom.llm.queries import HUB, LINKED_ENDS, LINKED_PATHS
from auditloom.llm.rule_ledger import BASE, BITS, FULL

OP10 = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (
    SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS k
    FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words)
),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
covered AS (
    SELECT r, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
),
rows AS (
    SELECT doc_id, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
        length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_capitals,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM (
        SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM texts
    ) JOIN words USING (r) LEFT JOIN covered USING (r)
),
bits AS (
    SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
        + 4 * (100 * n_symbols > 15 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
        + 16 * (100 * n_capitals > 40 * word_chars)::BIGINT
        + 32 * (100 * n_exclamations > 40 * n_words)::BIGINT + 64 * (word_chars > 30 * n_words)::BIGINT AS fail_bits
    FROM rows
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM bits
"""


OP5 = """
WITH urls AS (
    SELECT page_id, position('://' IN coalesce(url, '')) AS place, coalesce(url, '') AS url FROM pages
),
rests AS (SELECT page_id, CASE WHEN place = 0 THEN '' ELSE substr(url, place + 3) END AS rest FROM urls),
parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rests
),
rules AS (
    SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
        ('org', '/fr/', 'allow')) AS t(rule_host, rule_path, verdict)
),
ruled AS (
    SELECT p.*, rule_host || rule_path AS rule, verdict,
        row_number() OVER (PARTITION BY p.row_no ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS rank
    FROM (SELECT row_number() OVER () AS row_no, * FROM parts) p
    LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict,
    CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS "by"
FROM ruled WHERE rank = 1
"""

OP6 = r"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
grams AS (
    SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM texts)
),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
sets AS (SELECT r, n, md5(string_agg(g, '|' ORDER BY g)) AS s FROM grams JOIN sizes USING (r) GROUP BY r, n),
classes AS (SELECT s, any_value(n) AS n, min(r) AS c FROM sets GROUP BY s),
members AS (SELECT c, g FROM grams JOIN classes ON r = c),
shared AS (
    SELECT a.c AS a, b.c AS b, count(*) AS k FROM members a JOIN members b ON a.g = b.g AND a.c < b.c GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared JOIN classes x ON x.c = a JOIN classes y ON y.c = b WHERE 190 * k >= 90 * (x.n + y.n)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(c, d) AS (SELECT c, c FROM classes UNION SELECT reach.c, b FROM reach JOIN both_ways ON reach.d = a),
roots AS (SELECT c, min(d) AS root FROM reach GROUP BY c),
named AS (
    SELECT root, min(doc_id) AS component_id
    FROM sets JOIN classes USING (s) JOIN roots ON roots.c = classes.c JOIN texts ON texts.r = sets.r GROUP BY root
)
SELECT doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM texts LEFT JOIN sets ON sets.r = texts.r LEFT JOIN classes USING (s) LEFT JOIN roots ON roots.c = classes.c
LEFT JOIN named USING (root)
"""

OP9 = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
),
places AS (
    SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM windows))
),
found AS (SELECT r, i, places.size, item_id FROM places JOIN windows ON places.k = windows.k AND places.size = windows.size),
hits AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM found))
    GROUP BY r
),
hit_items AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (r) LEFT JOIN hit_items USING (r)
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round is a table of its own; codebook rows are (p, e, v)."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS (
    SELECT r, p, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
        SELECT cells.r, cells.p, e, list_sum(list_transform(list_zip(cells.v, book{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM cells JOIN book{i} ON cells.p = book{i}.p
    ) GROUP BY r, p
)""")
        if i < rounds:
            steps.append(f"""
means{i} AS (
    SELECT p, e, list(m ORDER BY j) AS v FROM (
        SELECT p, e, j, floor_div(sum(x), count(*)) AS m FROM (
            SELECT near{i}.p, near{i}.e, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS x FROM near{i} JOIN cells USING (r, p)
        ) GROUP BY p, e, j
    ) GROUP BY p, e
),
book{i + 1} AS (SELECT book{i}.p, book{i}.e, coalesce(means{i}.v, book{i}.v) AS v FROM book{i} LEFT JOIN means{i} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS MATERIALIZED (
    SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS t(p)
),
book0 AS (SELECT p, r - 1 AS e, v FROM cells WHERE r <= {entries}),
{",".join(steps).replace("floor_div(sum(x), count(*))", "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")},
sums AS (
    SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r
),
books AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN sums USING (r), books
"""


OP12 = """
WITH rows AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS MATERIALIZED (
    SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
        list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id NULLS LAST, n.b)::INTEGER AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a = p.a
WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


def _linked_url(number: str) -> str:
    ends, paths = (", ".join(f"'{x}'" for x in xs) for xs in (LINKED_ENDS, LINKED_PATHS))
    return (
        f"'h' || ({number}) || '.' || [{ends}][({number}) % {len(LINKED_ENDS)} + 1] || "
        f"[{paths}][({number}) // 3 % {len(LINKED_PATHS)} + 1]"
    )


def _url_aliases() -> str:
    """Links by the numbers of the pages, and components by walking them from every node."""
    hub = HUB.removeprefix("https://")
    return f"""
WITH RECURSIVE urls AS (SELECT page_id, {_linked_url("page_id")} AS node FROM pages),
links AS (
    SELECT node AS a, CASE WHEN page_id % 5 = 0 THEN '{hub}' WHEN page_id % 4 IN (1, 2) THEN {_linked_url("page_id - 1")}
        ELSE {_linked_url("page_id + 13")} END AS b
    FROM urls WHERE page_id % 5 = 0 OR page_id % 4 IN (1, 2) OR page_id % 16 = 3
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT a AS node FROM both_ways UNION SELECT node FROM urls),
reach(c, d) AS (SELECT node, node FROM nodes UNION SELECT c, b FROM reach JOIN both_ways ON d = a),
rules AS (
    SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
        ('org', '/fr/', 'allow')) AS t(rule_host, rule_path, verdict)
),
parts AS (SELECT node, regexp_extract(node, '^[^/]*') AS host, regexp_extract(node, '^[^/]*(.*)', 1) AS path FROM nodes),
ruled AS (
    SELECT node, host, path, rule_host || rule_path AS rule, verdict FROM parts
    LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rule_host || rule_path) DESC NULLS LAST) = 1
),
shared AS (
    SELECT c AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
    FROM reach JOIN ruled ON d = ruled.node WHERE rule IS NOT NULL GROUP BY c
)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, shared.verdict, 'allow') AS verdict,
    CASE WHEN rule IS NOT NULL THEN 'rule' WHEN shared.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
FROM urls JOIN ruled USING (node) LEFT JOIN shared USING (node)
"""


def _ablations() -> str:
    rows = ", ".join(
        f"('{p.version}', '{name}', {BITS[name]}, {p.mask})" for p in (BASE, FULL) for name in p.rules
    )
    return f"""
WITH ledger AS ({OP10}), rules AS (SELECT * FROM (VALUES {rows}) AS t(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only,
    count(*) FILTER (fail_bits & mask <> 0) AS n_rejected, count(*) AS n_texts
FROM ledger, rules GROUP BY policy, rule
"""


def all_sql() -> dict[str, str]:
    """Others learn from the corpus, or depend on a tokenizer; tests hold them against brute force.

    The pages have no redirects and no canonical links, so that plain rules give the same
    verdicts for ``op5_url_filter``; ``url_aliases`` runs it over pages with links.
    """
    return {
        "op5_url_filter": OP5, "op6_ngram_join": OP6, "op9_decontaminate": OP9, "op10_rule_ledger": OP10,
        "op11_gnat_codes": _op11(), "op12_hard_negatives": OP12,
        "url_aliases": _url_aliases(), "ledger_ablations": _ablations(),
    }
