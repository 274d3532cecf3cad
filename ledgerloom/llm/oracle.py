"""SQL that gives the same rows as the registered queries, for an embedded engine over the same tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"

#: Exact Jaccard links by an inverted index, and their components.
NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
s AS (
    SELECT r, doc_id, list_sort(CASE
        WHEN len(ws) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS ss
    FROM w
),
d AS (SELECT r, doc_id, len(ss) AS size, md5(array_to_string(ss, '|')) AS sid, ss FROM s),
u AS (SELECT sid, any_value(size) AS size, any_value(ss) AS ss, count(*) AS n_copies FROM d WHERE size > 0 GROUP BY sid),
x AS (SELECT sid, size, unnest(ss) AS shingle FROM u),
links AS (
    SELECT a.sid AS a, b.sid AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.sid < b.sid
    GROUP BY a.sid, b.sid, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT sid AS a, sid AS b FROM u UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
roots AS (SELECT a AS sid, min(b) AS root FROM reach GROUP BY a),
heads AS (SELECT root, min(doc_id) AS class_id FROM d JOIN roots USING (sid) GROUP BY root),
degree AS (SELECT a AS sid, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM d JOIN u USING (sid) JOIN roots USING (sid) JOIN heads USING (root) LEFT JOIN degree USING (sid) WHERE d.size > 0
UNION ALL SELECT doc_id, doc_id, 0, 1 FROM d WHERE size = 0
"""


def _byte(text: str, place: int) -> str:
    return f"ascii(substr(md5({text}), {place}, 1))"


def _day(text: str, place: int) -> str:
    return f"DATE '2024-01-01' + ({_byte(text, place)} * 37 + {_byte(text, place + 1)} * 11) % 366"


#: Every capture against all intervals, the heaviest active one by a window.
URL_LISTS = rf"""
WITH captures AS (
    SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host
    FROM pages
),
hosts AS (SELECT DISTINCT host AS d FROM captures WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT array_to_string(string_split(d, '.')[-2:], '.') AS d FROM hosts),
entries AS (
    SELECT 'malware' AS list, d AS domain, 'block' AS rule, 'add' AS action, {_day("d", 1)} AS happened FROM hosts
    UNION ALL SELECT 'malware', d, 'block', 'remove', {_day("d", 1)} + {_byte("d", 3)} % 90 + 1 FROM hosts
    UNION ALL SELECT 'malware', d, 'block', 'add', {_day("d", 1)} + {_byte("d", 3)} % 90 + 60 FROM hosts
    UNION ALL SELECT 'trusted', d, 'allow', 'add', {_day("d", 5)} FROM hosts
    UNION ALL SELECT 'trusted', d, 'allow', 'remove', {_day("d", 7)} FROM hosts
    UNION ALL SELECT 'spam', d, 'block', 'add', {_day("d", 1)} FROM domains
),
events AS (SELECT list, domain, rule, happened, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(happened) OVER (PARTITION BY list, domain, rule ORDER BY happened) AS until FROM events),
active AS (
    SELECT c.r, s.*, row_number() OVER (
        PARTITION BY c.r ORDER BY len(string_split(s.domain, '.')) DESC, s.happened DESC, (s.rule = 'block') DESC, s.domain DESC) AS weight
    FROM captures c JOIN spans s
    ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND s.action = 'add'
        AND s.happened <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
),
judged AS (
    SELECT r, max(rule = 'block') FILTER (weight = 1) AS blocked, max(domain) FILTER (weight = 1) AS domain,
        count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
    FROM active GROUP BY r
)
SELECT page_id, url, fetched, host, coalesce(blocked, false) AS blocked, domain, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists
FROM captures LEFT JOIN judged USING (r)
"""


def licenses(phrases: dict[str, str], templates: dict[str, str], containment: float) -> str:
    """Every block of every text against every template, and every place against every phrase."""
    import re

    def sql_list(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    def places(phrase: str) -> str:
        words = phrase.split()
        k = len(words)
        return f"list_filter(range(1, len(ws) - {k} + 2), lambda i: ws[i:i + {k - 1}] = {sql_list(words)})"

    found = ", ".join(f"{places(p)} AS p{i}" for i, p in enumerate(phrases))
    every = " || ".join(f"p{i}" for i in range(len(phrases)))
    base = " || ".join(f"(CASE WHEN len(p{i}) > 0 THEN ['{label}'] ELSE [] END)" for i, label in enumerate(phrases.values()))
    words = {name: re.findall("[a-z0-9]+", t.lower()) for name, t in templates.items()}
    notices = ", ".join(f"('{name.split('/')[0]}', {sql_list(sorted(set(w)))}, {len(w)})" for name, w in words.items())
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
templates(label, words, m) AS (VALUES {notices}),
blocks AS (
    SELECT r, label, words, m, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(0, greatest(len(ws) - m, 1), m) END) AS s FROM w, templates
),
shares AS (SELECT r, label, words, len(list_intersect(list_distinct(ws[s + 1:s + 2 * m]), words)) AS n FROM blocks),
held AS (SELECT r, label, max(n / len(words)) AS share FROM shares WHERE n >= ceil({containment} * len(words) - 1e-9) GROUP BY r, label),
noted AS (SELECT r, list(label) AS names, max(share) AS share FROM held GROUP BY r),
placed AS (SELECT r, doc_id, ws, {found} FROM w),
based AS (SELECT r, doc_id, ws, {every} AS spots, list_sort(list_distinct({base})) AS base FROM placed)
SELECT doc_id, len(ws) AS n_words, len(spots) AS n_base, list_min(spots) - 1 AS first_word, list_max(spots) - 1 AS last_word,
    array_to_string(base, ',') AS base_labels,
    array_to_string(list_sort(list_distinct(base || coalesce(names, []))), ',') AS labels,
    CASE WHEN len(spots) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM based LEFT JOIN noted USING (r)
"""


#: Every prefix of every rebuilt conversation, and all pairs of a node and a node above it. CRC-32 bit by bit.
PREFIX_TRIE = """
WITH listed AS (
    SELECT conv_id, list({'key': md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'size': strlen(coalesce(text, ''))}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
steps AS (
    SELECT conv_id, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda x: list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))) AS bits
    FROM listed
),
heads AS (
    SELECT conv_id, xor(list_reduce(bits, lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
        WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384::BIGINT) ELSE crc // 2 END), 4294967295::BIGINT) % 9 AS h
    FROM steps
),
rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
    FROM listed o JOIN heads USING (conv_id) LEFT JOIN listed b ON b.conv_id = o.conv_id - o.conv_id % 5
),
prefixes AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
members AS (
    SELECT conv_id, depth, depth = len(turns) AS ends, CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size,
        array_to_string(list_transform(turns[1:depth], lambda t: t.key), '') AS prefix
    FROM prefixes
),
nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY prefix, depth
),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:32 * n.depth] = n.prefix) AS n_children
    FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:32 * (n.depth - 1)]
),
above AS (SELECT prefix, unnest(range(0, depth + 1)) AS top, n_convs, size, n_children FROM linked),
sums AS (
    SELECT prefix[1:32 * top] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
    FROM above GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN sums USING (prefix)
"""

#: Every window as text.
SUBSTRINGS = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
windows AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM starts),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows JOIN often USING (h)),
places AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM places ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

#: All runs of one to three words, counted as text.
COLLOCATIONS = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
runs AS (
    SELECT lang, k AS size, array_to_string(ws[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) ks(k) WHERE len(ws) >= k)
),
counts AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= 10),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
cuts AS MATERIALIZED (SELECT *, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM cut),
scores AS (
    SELECT c.*, x.f AS l, y.f AS r, 1000000 * a::HUGEINT * a // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scores),
longer AS (
    SELECT lang, phrase, max(a) AS held FROM (
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3)
    GROUP BY lang, phrase
),
kept AS (SELECT s.* FROM lowest s LEFT JOIN longer USING (lang, phrase) WHERE nth = 1 AND (held IS NULL OR 100 * held < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
