"""SQL that gives the rows of queries an independent engine can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SIMILAR = f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
  shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words WHERE len(w) > 0),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
  ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, b.y FROM reached r JOIN ways b ON r.other = b.x)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id
  LEFT JOIN (SELECT doc_id, min(other) AS low FROM reached GROUP BY 1) r ON d.doc_id = r.doc_id"""


def quality(least_documents: int = 50, most_share: float = 0.01, least_line_words: int = 3, most_removed: float = 0.7) -> str:
    blanks = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body FROM documents),
  split AS MATERIALIZED (SELECT *, {_WORDS.format('body')} AS w, list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines FROM texts),
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows) WHERE n > 1),
  covered AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY 1),
  lines AS (SELECT doc_id, host, body, lower(regexp_replace(trim(l, {blanks}), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line, len({_WORDS.format('l')}) AS words
    FROM (SELECT doc_id, host, body, unnest(lines) AS l FROM split)),
  common AS (SELECT c.host, line, first FROM (SELECT host, line, count(DISTINCT body) AS n, min(doc_id) AS first FROM lines WHERE words >= {least_line_words} GROUP BY 1, 2) c
    JOIN (SELECT host, count(*) AS docs FROM texts GROUP BY 1) h ON c.host = h.host WHERE n > {least_documents} AND n > docs * {most_share}),
  removed AS (SELECT doc_id, sum(words) AS n FROM lines l JOIN common c ON l.host = c.host AND l.line = c.line WHERE doc_id <> first AND words >= {least_line_words} GROUP BY 1),
  counted AS (SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.n, 0)::BIGINT AS n_removed_words
    FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id LEFT JOIN removed r ON s.doc_id = r.doc_id)
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_removed_words <= n_words * {most_removed} AS kept FROM counted"""
