"""The queries that SQL can express, for an independent engine.

The others hold encoders, fitted models, draws by Spark's own hash or eigenvectors; tests compare those with
plain restatements. Rules are written out again; nothing comes from the operators.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), {_WORD})"


#: A line as it is compared: case and digits aside, words apart by one blank.
_LINE = (
    "array_to_string(regexp_extract_all(translate(lower(line), '123456789', '000000000'), "
    f"{_WORD}), ' ')"
)

_RULES = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {_words('text')} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(10)) AS eight
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM docs)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, eight) AS k FROM windows)
          WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (SELECT doc_id, source, text, line, {_LINE} AS same FROM lines WHERE regexp_matches(line, {_WORD})),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
frequent AS (SELECT source, same FROM worded WHERE same <> '' GROUP BY ALL HAVING count(DISTINCT text) > 20),
gone AS (SELECT doc_id, sum(len(string_split(same, ' ')))::BIGINT AS n_frequent_words
         FROM worded SEMI JOIN frequent ON worded.source IS NOT DISTINCT FROM frequent.source
                                       AND worded.same = frequent.same GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_frequent_words, 0) AS n_frequent_words
  FROM docs LEFT JOIN doubled USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * (n_words - n_frequent_words) < 30 * n_words AS kept, n_frequent_words
FROM judged
"""

_TOP = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
           FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
WHERE rank <= 5
"""

#: Pairs with enough shingles in common; labels sink along them until none changes.
_JACCARD = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (s)
           WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * k >= 85 * (m.n + n.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(node, least) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT both_ways.b, min(reached.least) FROM reached JOIN both_ways ON both_ways.a = reached.node
  JOIN recurring.reached AS before ON before.node = both_ways.b
  WHERE reached.least < before.least GROUP BY both_ways.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least AS component_id
FROM docs JOIN reached ON node = doc_id LEFT JOIN sizes USING (doc_id)
"""

#: Base32 from the 160 bits of the hexadecimal digest, five at a time.
_BITS = "list_transform(string_split(sha1(payload), ''), lambda h: lpad(bin(('0x' || h)::INT), 4, '0'))"
_WARC = f"""
WITH records AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
bits AS (SELECT *, array_to_string({_BITS}, '') AS b, max(page_id) OVER (PARTITION BY payload) AS latest FROM records)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(b, 5 * i + 1, 5))::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM bits
"""

ORACLE: dict[str, str] = {
    "op3_line_frequency": _RULES,
    "op7_uniform_threshold": _TOP,
    "op8_shingle_join": _JACCARD,
    "op10_warc": _WARC,
}
