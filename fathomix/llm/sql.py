"""SQL for the queries of this folder that SQL can express."""

OP12_PHRASE_COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, [w FOR w IN string_split_regex(piece, '[\x20\x09]+') IF w <> ''] AS ws FROM pieces
), grams AS (
    SELECT lang, n, unnest([ws[i:i + n - 1] FOR i IN range(1, len(ws) - n + 2)]) AS phrase
    FROM words, (VALUES (1), (2), (3), (4)) AS lengths(n)
), totals AS (
    SELECT lang, count(*) AS n FROM grams WHERE n = 1 GROUP BY lang
), counted AS MATERIALIZED (
    SELECT lang, n, phrase, array_to_string(phrase, ' ') AS spelt, count(*) AS f FROM grams GROUP BY ALL HAVING f >= 30
), candidates AS (
    SELECT lang, n, phrase, f AS a FROM counted WHERE n >= 2
), splits AS MATERIALIZED (
    SELECT lang, n, phrase, a, k, array_to_string(phrase[1:k], ' ') AS head, array_to_string(phrase[k + 1:n], ' ') AS rest
    FROM candidates, (VALUES (1), (2), (3)) AS places(k)
    WHERE k < n
), cuts AS (
    SELECT s.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
    FROM splits s
    JOIN counted l ON l.lang = s.lang AND l.spelt = s.head
    JOIN counted r ON r.lang = s.lang AND r.spelt = s.rest
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, part AS phrase, max(a) AS most
    FROM (
        SELECT lang, a, unnest([phrase[i:i + m - 1] FOR i IN range(1, n - m + 2)]) AS part
        FROM candidates, (VALUES (2), (3)) AS lengths(m)
        WHERE m < n
    )
    GROUP BY ALL
), kept AS (
    SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, l, r, score::BIGINT AS score
    FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
    WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, totals.n, score
FROM kept JOIN totals ON totals.lang = kept.lang
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op12_phrase_collocations": OP12_PHRASE_COLLOCATIONS}
