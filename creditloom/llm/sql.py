"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from .licenses import COPYRIGHT_LINE, KNOWN, PUNCTUATION, SPELLINGS, WHITE
from .mixing import SEED


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MIX = f"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
),
weighed AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source
),
leveled AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0) AS DOUBLE)
              / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
    FROM weighed
    WINDOW before AS (ORDER BY source_size * 1.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
    SELECT source, source_size,
           CASE WHEN source_size::DOUBLE * 3 / weight >= level
                THEN max(CASE WHEN source_size::DOUBLE * 3 / weight >= level THEN level END) OVER () * weight
                ELSE source_size::DOUBLE * 3 END AS target
    FROM leveled
),
rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
           ('0x' || substr(md5({quoted(SEED)} || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


def _canonical(text: str) -> str:
    """The DuckDB text of ``licenses.canonical``."""
    out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    out = f"'  ' || regexp_replace(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'), {quoted(WHITE)}, '  ', 'g') || '  '"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, {quoted(f' {spelling} '.replace(' ', '  '))}, {quoted(f' {one} '.replace(' ', '  '))})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


LICENSES = f"""
WITH texts (license_id, text) AS (VALUES {', '.join(f'({quoted(name)}, {quoted(text)})' for name, text in KNOWN)}),
known AS (SELECT sha256({_canonical('text')}) AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
found AS (
    SELECT DISTINCT doc_id, license_id FROM (SELECT doc_id, sha256({_canonical('line')}) AS digest FROM lines) JOIN known USING (digest)
),
notices AS (SELECT doc_id, count(*) AS n_notices, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM found GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical('text')}) AS text_digest FROM documents)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.text_digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""

WINDOWS_13 = """
WITH worded AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
),
windows AS (
    SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS pos FROM worded)
),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN firsts USING (w) WHERE first_doc < doc_id),
lost AS (SELECT doc_id, list(pos) AS places FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(len(l.places), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN l.places IS NULL THEN w.words
              ELSE list_filter(w.words, lambda x, i: NOT list_contains(l.places, i)) END, ' ')) AS kept_sha256
FROM worded w LEFT JOIN lost l USING (doc_id)
"""

JACCARD = """
WITH RECURSIVE worded AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words
    FROM documents
),
shingled AS (
    SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM worded WHERE len(words) > 0)
),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
    FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT c.a, c.b FROM common c JOIN sized x ON c.a = x.doc_id JOIN sized y ON c.b = y.doc_id
    WHERE 100 * c.both >= 75 * (x.n + y.n - c.both)
),
reached (doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sized s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id)
"""

JACCARD_LINKS = JACCARD.replace("r.component_id\n", "r.component_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links\n")


NEGATIVES = """
WITH able AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
    FROM able a JOIN able r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 10
"""


def _collocations() -> str:
    def whole(k: int) -> str:
        return f"""SELECT lang, {k} AS size, [{", ".join(f"w{i}" for i in range(k))}] AS words, CAST(count(*) AS BIGINT) AS f
    FROM spans WHERE w{k - 1} IS NOT NULL GROUP BY ALL HAVING count(*) >= 100"""

    following = ", ".join(f"lead(word, {k}) OVER place AS w{k}" for k in range(1, 5))
    return f"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
pieces AS (
    SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\\x20\\x09]+') AS words
    FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS part FROM docs)
),
spelled AS (SELECT lang, piece, unnest(words) AS word, unnest(range(len(words))) AS position FROM pieces),
spans AS (SELECT lang, word AS w0, {following} FROM spelled WINDOW place AS (PARTITION BY piece ORDER BY position)),
totals AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM spans GROUP BY lang),
phrases AS MATERIALIZED (
    {" UNION ALL ".join(map(whole, range(1, 6)))}
),
longer AS (
    SELECT lang, words, max(f) AS within FROM (
        SELECT lang, f, unnest([words[1:size - 1], words[2:size]]) AS words FROM phrases WHERE size > 2
    ) GROUP BY ALL
),
kept AS (
    SELECT p.* FROM phrases p LEFT JOIN longer USING (lang, words) WHERE size > 1 AND (within IS NULL OR 100 * within < 100 * f)
),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
    SELECT c.lang, c.words, k, c.f AS a, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cuts c
    JOIN phrases l ON l.lang = c.lang AND l.words = c.words[1:k]
    JOIN phrases r ON r.lang = c.lang AND r.words = c.words[k + 1:c.size]
    JOIN totals t ON t.lang = c.lang
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.words ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER best AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score FROM scored
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' '))
QUALIFY row_number() OVER best <= 2000
"""


COLLOCATIONS = _collocations()
