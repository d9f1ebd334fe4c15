"""The queries restated in SQL for an independent engine.

Only prompt texts and marker lists come from the package; every rule is written out again.
"""

from __future__ import annotations

from tandem.functions import fixed_values as V

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _q(text: str) -> str:
    """A SQL string literal; line feeds are spelled chr(10)."""
    parts = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def _bigrams(x: str) -> str:
    squashed = f"regexp_replace({_strip(f'lower({x})')}, '{_WS}+', ' ', 'g')"
    chars = f"string_split({squashed}, '')"
    return (
        f"list_distinct(list_transform(list_zip({chars}[1:-2], {chars}[2:]),"
        " lambda p: p[1] || p[2]))"
    )


def _md5_number(x: str) -> str:
    return f"('0x' || substr({x}, 1, 8))::BIGINT"


def _rounded(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {x})::DOUBLE"


def _line(at: str) -> str:
    return _strip(f"coalesce(lines[{at}], '')")


def _doc_pairs(where: str) -> str:
    cut = f"SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE {where}"
    each = f"SELECT doc_id, lines, unnest(range((len(lines) + 1) // 2)) AS k FROM ({cut})"
    return (
        f"SELECT * FROM (SELECT doc_id * 16777216 + k AS ord, {_line('2 * k + 1')} AS source,"
        f" {_line('2 * k + 2')} AS target FROM ({each})) WHERE source <> '' AND target <> ''"
    )


_CURATED = _doc_pairs("doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
_ALL = _doc_pairs("true")
_UNLABELLED = _doc_pairs("doc_id NOT IN (SELECT doc_id FROM labels)")

_CORPUS = f"""
corpus AS (
  SELECT pri, ord, source, target, 'fr' AS source_lang, 'dioula' AS target_lang
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target)
                                     ORDER BY pri, ord) AS rn
        FROM (SELECT 0 AS pri, * FROM ({_CURATED}) UNION ALL SELECT 1, * FROM ({_ALL})))
  WHERE rn = 1)
"""

_TURN_PAIRS = f"""
pairs AS (
  SELECT * FROM (
    SELECT u.conv_id, u.turn, {_strip('u.text')} AS source, {_strip('a.text')} AS target
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')
  WHERE source <> '' AND target <> '')
"""


def _head(system: str) -> str:
    return _q(
        f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{system}"
        "<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
    )


_TAIL = _q("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n")


def _fill(template: str, x: str) -> str:
    before, after = template.split("{text}")
    return f"({_q(before)} || {x} || {_q(after)})"


def _prompt(user: str, system: str = V.SYSTEM_PROMPT) -> str:
    return f"{_head(system)} || {user} || {_TAIL}"


_CHOICE = _md5_number("md5(concat_ws(chr(31), '42', source, target))") + " % 4"
_QUESTION = (
    f"CASE {_CHOICE} "
    + " ".join(f"WHEN {i} THEN {_fill(t, 'source')}" for i, t in enumerate(V.QUESTION_REQUESTS))
    + " END"
)


def _expanded(pairs: str, extra: str) -> str:
    """Three examples per pair; the pair id is the md5 of both sides behind their lengths."""
    pair_id = "md5(length(source) || ':' || source || length(target) || ':' || target)"
    return " UNION ALL ".join(
        f"SELECT {extra}{pair_id} AS pair_id, '{kind}' AS kind, {_prompt(user)} AS prompt,"
        f" {answer} || '<|eot_id|>' AS completion FROM {pairs}"
        for kind, user, answer in (
            ("forward", _fill(V.FORWARD_REQUEST, "source"), "target"),
            ("reverse", _fill(V.REVERSE_REQUEST, "target"), "source"),
            ("question", f"({_QUESTION})", "target"),
        )
    )


_EXAMPLES = f"{_TURN_PAIRS}, examples AS ({_expanded('pairs', 'conv_id, turn, ')})"


def _placed(rows: str, keys: str, name: str = "placed") -> str:
    return (
        f"{name} AS (SELECT *, row_number() OVER (ORDER BY"
        f" md5(concat_ws(chr(31), '42', {keys})), {keys}) - 1 AS pos,"
        f" count(*) OVER () AS n FROM {rows})"
    )


_SPLIT = (
    "CASE WHEN pos < floor(n::DOUBLE * 0.9::DOUBLE) THEN 'train'"
    " WHEN pos < floor(n::DOUBLE * 0.9::DOUBLE) + floor(n::DOUBLE * 0.05::DOUBLE) THEN 'valid'"
    " ELSE 'test' END AS split"
)
_ROW_SPLIT = (
    f"{_EXAMPLES}, {_placed('examples', 'conv_id, turn, kind')},"
    f" splits AS (SELECT *, {_SPLIT} FROM placed)"
)
_PAIR_SPLIT = (
    f"{_EXAMPLES}, ids AS (SELECT DISTINCT pair_id FROM examples), {_placed('ids', 'pair_id')},"
    f" splits AS (SELECT e.*, s.split FROM examples e"
    f" JOIN (SELECT pair_id, {_SPLIT} FROM placed) s USING (pair_id))"
)
_SHARE = _md5_number("md5(concat_ws(chr(31), '42', pair_id))") + " / 4294967296.0::DOUBLE"

_EXAMPLE_ORDER = (
    "row_number() OVER (ORDER BY md5(concat_ws(chr(31), '42/examples', pair_id, kind)),"
    " pair_id, kind) - 1 AS pos"
)
_LONG_ENOUGH = "length(source) >= 2 AND length(target) >= 2"
_LOUD = "translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_FIRST_PAIRS = f"""
firsts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target) ORDER BY ord) AS rn
  FROM ({_ALL})) WHERE rn = 1)
"""

#: Labels sink along the edges until none changes. Keys are digests of the sides.
_GROUPS = f"""
RECURSIVE pairs AS MATERIALIZED (
  SELECT *, md5('source:' || lower(source)) AS s, md5('target:' || lower(target)) AS t FROM ({_ALL})),
links AS MATERIALIZED (SELECT DISTINCT s AS a, t AS b FROM pairs UNION SELECT DISTINCT t, s FROM pairs),
reached(node, least) USING KEY (node) AS (
  SELECT a, a FROM (SELECT DISTINCT a FROM links)
  UNION
  SELECT links.b, min(reached.least) FROM reached JOIN links ON links.a = reached.node
  JOIN recurring.reached AS before ON before.node = links.b
  WHERE reached.least < before.least GROUP BY links.b),
grouped AS MATERIALIZED (SELECT ord, source, target, s, t, least AS group_id FROM pairs JOIN reached ON node = s),
sized AS (SELECT group_id, count(*) AS k, sum(count(*)) OVER ()::DOUBLE AS total FROM grouped GROUP BY group_id),
floored AS (SELECT *, floor(total * 0.9::DOUBLE) AS valid_at,
                   floor(total * 0.9::DOUBLE) + floor(total * 0.05::DOUBLE) AS test_at FROM sized),
ranked AS (SELECT *, least(CASE WHEN test_at > valid_at THEN test_at - valid_at END,
                           CASE WHEN total > test_at THEN total - test_at END, total) AS most FROM floored),
laid AS (
  SELECT *, coalesce(sum(k) OVER (
    ORDER BY k > most DESC, CASE WHEN k > most THEN -k ELSE 0 END,
             CASE WHEN k > most THEN '' ELSE md5(concat_ws(chr(31), '42', group_id)) END, group_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ranked),
dealt AS (SELECT group_id, CASE WHEN start < valid_at THEN 'train' WHEN start < test_at THEN 'valid'
                                ELSE 'test' END AS split FROM laid)
"""


def _side_leakage(drawn_by: str, rows: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{side}' AS side, count(*) AS n_texts, count(*) FILTER (n > 1) AS n_leaked,"
        f" (count(*) FILTER (n > 1))::DOUBLE / count(*) AS leak_rate, '{drawn_by}' AS drawn_by"
        f" FROM (SELECT lower({side}), count(DISTINCT split) AS n FROM {rows} GROUP BY 1)"
        for side in ("source", "target")
    )


_LEAKAGE = """
SELECT count(*) AS n_groups, count(*) FILTER (k > 1) AS n_leaked,
       (count(*) FILTER (k > 1))::DOUBLE / count(*) AS leak_rate
FROM (SELECT pair_id, count(DISTINCT split) AS k FROM splits GROUP BY pair_id)
"""


def _json_bytes(x: str) -> str:
    """Bytes of a text inside a JSON string, non-ASCII characters as they are."""
    short = " + ".join(
        f"(length({x}) - length(replace({x}, {c}, '')))"
        for c in ("'\"'", "'\\'", "chr(8)", "chr(9)", "chr(10)", "chr(12)", "chr(13)")
    )
    other = rf"length({x}) - length(regexp_replace({x}, '[\x01-\x07\x0b\x0e-\x1f]', '', 'g'))"
    return f"(strlen({x}) + {short} + 5 * ({other}))"


_LINE = len('{"prompt": "", "completion": ""}\n')


def _hits(x: str) -> str:
    return "(" + " + ".join(f"contains(lower({x}), {_q(m)})::INT" for m in V.LANGUAGE_MARKERS) + ")"


def _language(x: str) -> str:
    return f"CASE WHEN {_hits(x)} >= 2 THEN 'dioula' ELSE 'français' END"


def _mode(x: str) -> str:
    pattern = "|".join(V.TRANSLATION_WORDS)
    return (
        f"CASE WHEN regexp_matches(lower({x}), '{pattern}') THEN 'traduction'"
        " ELSE 'conversation' END"
    )


_RAW = """
outputs AS (SELECT conv_id, turn, ' error in ' || role AS stderr, CASE conv_id % 6
  WHEN 0 THEN 'Loading' || chr(10) || '==========' || chr(10) || ' ' || chr(160) || chr(10) || text
              || chr(10) || '==========' || chr(10) || 'Prompt: 12 tokens'
  WHEN 1 THEN chr(10) || ' ' || chr(9) || text || '<|eot_id|>rest Peak memory'
  WHEN 2 THEN 'Generation: 3 tokens-per-sec' || text
  WHEN 3 THEN 'x<|start_header_id|>assistant<|end_header_id|>' || chr(10) || 'first<|eot_id|>'
              || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || text || '<|eot_id|>'
  WHEN 4 THEN ' ' || chr(10)
  ELSE text END AS raw FROM conversations)
"""
_STOPS = "|".join(t.replace("|", r"\|") for t in V.OUTPUT_STOPS)
_SECTION = "CASE WHEN contains(raw, '==========') THEN split_part(raw, '==========', 2) ELSE raw END"
_FIRST_LINE = (
    f"coalesce(list_filter(list_transform(string_split(regexp_split_to_array({_SECTION},"
    f" '{_STOPS}')[1], chr(10)), lambda l: {_strip('l')}), lambda l: l <> '')[1], '')"
)
_MARKER = "'<|start_header_id|>assistant<|end_header_id|>'"


def _reply(stderr: str) -> str:
    body = (
        f"CASE WHEN contains(raw, {_MARKER}) THEN "
        + _strip(f"replace(string_split(raw, {_MARKER})[-1], '<|eot_id|>', '')")
        + f" ELSE {_strip('raw')} END"
    )
    return f"coalesce(nullif({body}, ''), {_strip(stderr)})"


_TURNS = "(SELECT *, conv_id || '-' || turn AS request_id FROM conversations WHERE role = 'user')"
_CHAT_REQUESTS = f"""
requests AS (SELECT request_id,
  CASE WHEN conv_id % 17 = 3 THEN '' WHEN conv_id % 17 = 4 THEN repeat(text, 40)
       WHEN turn % 2 = 0 THEN 'Traduis en Dioula : ' || text ELSE text END AS message,
  CASE WHEN conv_id % 5 = 1 THEN '' WHEN conv_id % 5 <> 0 THEN 's' || conv_id END AS session,
  CASE conv_id % 11 WHEN 0 THEN 9 WHEN 1 THEN 513 WHEN 2 THEN 10 WHEN 3 THEN 512
                    WHEN 4 THEN NULL ELSE 100 END AS mt,
  CASE conv_id % 13 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 1.5 WHEN 2 THEN 0 WHEN 3 THEN 1
                    WHEN 4 THEN NULL ELSE 0.5 END AS temp
  FROM {_TURNS}),
checked AS (SELECT request_id, message,
  CASE WHEN session IS NULL OR session = '' THEN sha256(request_id) ELSE session END AS session_id,
  coalesce(mt, 256) AS max_tokens, coalesce(temp, 0.3::DOUBLE) AS temperature,
  concat_ws(',',
    CASE WHEN length(message) < 1 THEN 'message_too_short' END,
    CASE WHEN length(message) > 2000 THEN 'message_too_long' END,
    CASE WHEN mt < 10 THEN 'max_tokens_too_low' END,
    CASE WHEN mt > 512 THEN 'max_tokens_too_high' END,
    CASE WHEN temp < 0 THEN 'temperature_too_low' END,
    CASE WHEN temp > 1 THEN 'temperature_too_high' END) AS errors
  FROM requests)
"""
_TRANSLATE_REQUESTS = f"""
requests AS (SELECT request_id,
  CASE WHEN conv_id % 17 = 3 THEN '' WHEN conv_id % 17 = 4 THEN repeat(text, 40)
       ELSE text END AS texte,
  CASE WHEN conv_id % 7 = 0 THEN 'fr_to_en' WHEN conv_id % 7 = 1 THEN NULL
       WHEN turn % 2 = 0 THEN 'fr_to_dioula' ELSE 'dioula_to_fr' END AS given
  FROM {_TURNS}),
checked AS (SELECT request_id, texte, coalesce(given, 'fr_to_dioula') AS direction,
  concat_ws(',',
    CASE WHEN length(texte) < 1 THEN 'texte_too_short' END,
    CASE WHEN length(texte) > 1000 THEN 'texte_too_long' END,
    CASE WHEN NOT regexp_matches(given, '^(fr_to_dioula|dioula_to_fr)$')
         THEN 'direction_unknown' END) AS errors
  FROM requests)
"""


_SERVING = V.SERVING_PROMPT.replace("{name}", V.ASSISTANT_NAME)


def _stub(max_tokens: str, prompt: str) -> str:
    reply = f"'stub ' || {max_tokens} || ': ' || lower({prompt})"
    return _strip(f"replace(replace({reply}, '<|eot_id|>', ''), '<|end_of_text|>', '')")


_CHAT = f"""
WITH {_CHAT_REQUESTS},
replies AS (SELECT *, {_stub('max_tokens', _prompt('message', _SERVING))} AS reponse
            FROM checked WHERE errors = '')
SELECT request_id, true AS success, session_id, reponse,
       {_language('message')} AS langue_detectee, {_language('reponse')} AS langue_reponse,
       {_mode('message')} AS mode, 'stub' AS model
FROM replies
"""

_TRANSLATE = f"""
WITH {_TRANSLATE_REQUESTS},
directed AS (SELECT *,
  CASE direction WHEN 'fr_to_dioula' THEN {_fill(V.FORWARD_REQUEST, 'texte')}
                 ELSE {_fill(V.REVERSE_REQUEST, 'texte')} END AS message
  FROM checked WHERE errors = '')
SELECT request_id, true AS success, texte AS texte_original,
       {_stub('256', _prompt('message', _SERVING))} AS traduction, direction,
       CASE direction WHEN 'fr_to_dioula' THEN 'français' ELSE 'dioula' END AS langue_source,
       CASE direction WHEN 'fr_to_dioula' THEN 'dioula' ELSE 'français' END AS langue_cible
FROM directed
"""
_REJECTED = f"""
WITH {_CHAT_REQUESTS} SELECT request_id, errors FROM checked WHERE errors <> ''
"""

_PREDICTIONS = f"""
{_TURN_PAIRS},
predicted AS (SELECT conv_id, turn,
  CASE conv_id % 3 WHEN 0 THEN lower(target)
                   WHEN 1 THEN substring(target, 1, (length(target) * 3 // 10)::INT)
                   ELSE source END AS prediction
  FROM pairs WHERE conv_id % 5 <> 4 OR turn > 1),
matched AS (SELECT p.conv_id, p.turn, p.source, p.target AS reference,
                   coalesce(prediction, '') AS prediction
            FROM pairs p LEFT JOIN predicted USING (conv_id, turn))
"""
_REF_WORDS = f"list_distinct({_words('lower(reference)')})"
_SCORING = f"""
measured AS (SELECT *,
  {_strip('lower(prediction)')} = {_strip('lower(reference)')} AS exact,
  {_bigrams('prediction')} AS bp, {_bigrams('reference')} AS br,
  list_distinct({_words('lower(prediction)')}) AS wp, {_REF_WORDS} AS wr
  FROM matched),
rated AS (SELECT *,
  CASE WHEN len(br) = 0 THEN 0.0::DOUBLE
       ELSE len(list_intersect(bp, br))::DOUBLE / len(br) END AS char_similarity,
  len(list_intersect(wp, wr))::DOUBLE / greatest(len(wr), 1) AS word_recall
  FROM measured),
scored AS (SELECT *,
  NOT exact AND (word_recall >= 0.5 OR char_similarity >= 0.6) AS partial,
  CASE WHEN exact THEN 'EXACT' WHEN word_recall >= 0.5 OR char_similarity >= 0.6 THEN 'PARTIEL'
       ELSE 'FAUX' END AS status FROM rated)
"""
_SCORED = f"{_PREDICTIONS}, {_SCORING}"
_ECHO = f"{_strip('split_part(source, chr(10), 1)')}"
_ECHOED = f"""
{_TURN_PAIRS},
matched AS (SELECT conv_id, turn, target AS reference, {_ECHO} AS prediction FROM pairs)
"""
_TOTAL_COLUMNS = f"""
  count(*) FILTER (exact) AS exact, count(*) FILTER (partial) AS partial, count(*) AS total,
  (count(*) FILTER (exact))::DOUBLE / count(*) * 100 AS pct_exact,
  (count(*) FILTER (exact OR partial))::DOUBLE / count(*) * 100 AS pct_global,
  sum(round({_rounded('char_similarity', 3)} * 1000)::BIGINT)::DOUBLE
    / (count(*) * 1000) * 100 AS avg_similarity
"""
_TOTALS = f"totals AS (SELECT {_TOTAL_COLUMNS} FROM scored)"

_REPORT = f"""
SELECT 'aligned_dataset' AS benchmark, {_rounded('pct_exact', 1)} AS score_exact_pct,
       {_rounded('pct_global', 1)} AS score_global_pct,
       {_rounded('avg_similarity', 1)} AS avg_char_similarity_pct, exact, partial, total
FROM totals"""


def _known(new: str, corpus: str, sides: list[str]) -> str:
    same = " AND ".join(
        f"{_strip(f'lower(n.{s})')} = {_strip(f'lower(c.{s})')}" for s in sides
    )
    return f"EXISTS (SELECT 1 FROM ({corpus}) c WHERE {same})"


ORACLE: dict[str, str] = {
    "corpus_clean": f"WITH {_CORPUS} SELECT * FROM corpus",
    "corpus_stats": f"""
WITH {_CORPUS}, counted AS (
  SELECT len({_words('source')}) AS s, len({_words('target')}) AS t FROM corpus)
SELECT min(s) AS source_min, max(s) AS source_max, sum(s)::DOUBLE / count(*) AS source_mean,
       min(t) AS target_min, max(t) AS target_max, sum(t)::DOUBLE / count(*) AS target_mean
FROM counted""",
    "corpus_composition": f"""
WITH {_CORPUS}
SELECT CASE pri WHEN 0 THEN 'curated' ELSE 'documents' END AS origin, count(*) AS n_pairs
FROM corpus GROUP BY pri
UNION ALL SELECT 'total', count(*) FROM corpus""",
    "novel_pairs": f"""
SELECT ord, source, target FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target) ORDER BY ord) AS rn
  FROM ({_UNLABELLED}) n
  WHERE NOT EXISTS (SELECT 1 FROM ({_CURATED}) c
                    WHERE lower(c.source) = lower(n.source) AND lower(c.target) = lower(n.target)))
WHERE rn = 1""",
    "min_length": f"SELECT * FROM ({_ALL}) WHERE length(source) >= 40 AND length(target) >= 40",
    "benchmark_coverage": f"""
SELECT ord, source, target, {_known('n', _UNLABELLED, ['source', 'target'])} AS covered
FROM ({_CURATED}) n""",
    "benchmark_coverage_rate": f"""
SELECT count(*) AS total, count(*) FILTER (hit) AS covered,
       (count(*) FILTER (hit))::DOUBLE / count(*) AS rate
FROM (SELECT {_known('n', _UNLABELLED, ['source'])} AS hit FROM ({_CURATED}) n)""",
    "benchmark_passages": """
SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''""",
    "benchmark_passage_coverage": """
SELECT item_id, count(doc_id) AS n_documents, count(doc_id) > 0 AS covered
FROM benchmark b LEFT JOIN documents d ON b.text <> '' AND contains(d.text, b.text) GROUP BY item_id""",
    "text_measures": f"""
SELECT doc_id, length({_strip('text')})::INT AS n_stripped, len({_words('text')})::INT AS n_words,
       len(list_distinct({_words('lower(text)')}))::INT AS n_distinct_words,
       len({_bigrams('text')})::INT AS n_bigrams
FROM documents""",
    "examples": f"WITH {_EXAMPLES} SELECT * FROM examples",
    "text_modes": f"""
WITH {_EXAMPLES}
SELECT conv_id, turn, kind, 'full' AS mode, prompt || completion AS text FROM examples
UNION ALL SELECT conv_id, turn, kind, 'prompt', prompt FROM examples""",
    "render": """
SELECT conv_id,
       '<|begin_of_text|>'
       || string_agg('<|start_header_id|>' || coalesce(role, '') || '<|end_header_id|>' || chr(10)
                     || coalesce(text, '') || '<|eot_id|>', '' ORDER BY turn) AS rendered
FROM conversations GROUP BY conv_id""",
    "render_in_parts": """
WITH turns AS (SELECT conv_id, turn, '<|start_header_id|>' || coalesce(role, '') || '<|end_header_id|>' || chr(10)
                      || coalesce(text, '') || '<|eot_id|>' AS t FROM conversations),
placed AS (SELECT *, coalesce(sum(strlen(t)) OVER (PARTITION BY conv_id ORDER BY turn, t
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 400 AS p FROM turns),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS part FROM placed)
SELECT conv_id, part::INT AS part,
       CASE WHEN part = 0 THEN '<|begin_of_text|>' ELSE '' END || string_agg(t, '' ORDER BY turn, t) AS rendered
FROM numbered GROUP BY conv_id, part""",
    "length_budget_report": f"""
WITH {_EXAMPLES}, counted AS (
  SELECT kind, len({_words('prompt || completion')})::INT AS n FROM examples)
SELECT kind, count(*) AS n_examples, count(*) FILTER (n > 120) AS n_over, max(n) AS max_tokens
FROM counted GROUP BY kind""",
    "packed_examples": f"""
WITH {_EXAMPLES}, counted AS (
  SELECT len({_words('prompt || completion')}) AS n, length(prompt || completion) AS c FROM examples)
SELECT count(*) AS n_examples, sum(n)::BIGINT AS n_tokens, count(*) FILTER (n > 512) AS n_over,
       sum(c)::BIGINT AS n_chars, true AS within, true AS few_packs FROM counted""",
    "shuffle": f"""
WITH {_TURN_PAIRS}, {_placed('pairs', 'conv_id, turn')}
SELECT conv_id, turn, pos FROM placed""",
    "shuffle_copies": """
SELECT lang, row_number() OVER (ORDER BY md5(concat_ws(chr(31), '42', lang)), lang) - 1 AS pos
FROM documents""",
    "cap_pairs": f"""
WITH {_TURN_PAIRS}, {_placed('pairs', 'conv_id, turn')}
SELECT conv_id, turn, source FROM placed WHERE pos < 100""",
    "cap_copies": f"""
WITH pairs AS ({_ALL}), {_placed('pairs', 'source, target')}
SELECT source, target FROM placed WHERE pos < 500""",
    "split_rows": f"WITH {_ROW_SPLIT} SELECT conv_id, turn, kind, split FROM splits",
    "split_by_position": f"""
WITH {_TURN_PAIRS}, {_placed('pairs', 'conv_id, turn')}
SELECT conv_id, turn, pos, {_SPLIT} FROM placed""",
    "split_pairs": f"WITH {_PAIR_SPLIT} SELECT conv_id, turn, kind, split FROM splits",
    "split_threshold": f"""
WITH {_EXAMPLES}
SELECT conv_id, turn, kind,
       CASE WHEN {_SHARE} < 0.9::DOUBLE THEN 'train'
            WHEN {_SHARE} < 0.9::DOUBLE + 0.05::DOUBLE THEN 'valid' ELSE 'test' END AS split
FROM examples""",
    "leakage_rows": f"WITH {_ROW_SPLIT} {_LEAKAGE}",
    "leakage_pairs": f"WITH {_PAIR_SPLIT} {_LEAKAGE}",
    "side_groups": f"WITH {_GROUPS} SELECT ord, group_id, split FROM grouped JOIN dealt USING (group_id)",
    "leakage_sides": f"""
WITH {_GROUPS},
by_group AS (SELECT source, target, split FROM grouped JOIN dealt USING (group_id)),
named AS (SELECT *, md5(length(source) || ':' || source || length(target) || ':' || target) AS pair_id FROM grouped),
ids AS (SELECT DISTINCT pair_id FROM named), {_placed('ids', 'pair_id')},
by_pair AS (SELECT source, target, split FROM named JOIN (SELECT pair_id, {_SPLIT} FROM placed) USING (pair_id))
{_side_leakage('pair', 'by_pair')} UNION ALL {_side_leakage('group', 'by_group')}""",
    "split_report": f"""
WITH {_ROW_SPLIT}, sized AS (
  SELECT split, {_json_bytes('prompt')} + {_json_bytes('completion')} + {_LINE} AS b FROM splits)
SELECT split, count(*) AS n_examples, sum(b)::BIGINT AS n_bytes,
       sum(b)::DOUBLE / 1048576 AS size_mb
FROM sized GROUP BY split""",
    "split_totals": f"WITH {_ROW_SPLIT} SELECT split, count(*) AS n_examples FROM splits GROUP BY split",
    "preview_shuffled": f"""
WITH {_TURN_PAIRS}, {_placed('pairs', 'conv_id, turn')}
SELECT source, target FROM placed ORDER BY pos LIMIT 5""",
    "preview_raw": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 5",
    "split_files": f"""
SELECT CASE WHEN ord // 16777216 IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'other' END AS split,
       ord, source, target, 'fr' AS source_lang, 'dioula' AS target_lang FROM ({_ALL})""",
    "raw_files": "SELECT * FROM conversations",
    "seed_files": f"""
SELECT ord, source, target, 'fr' AS source_lang, 'dioula' AS target_lang FROM ({_CURATED})""",
    "corpus_files": f"""
WITH {_CORPUS} SELECT source, target, source_lang, target_lang FROM corpus""",
    "example_files": f"WITH {_ROW_SPLIT} SELECT prompt, completion, split FROM splits",
    "ordered_shards": f"""
WITH {_ROW_SPLIT},
lines AS (SELECT split, pos, pos // greatest(ceil(n / 65536.0)::BIGINT, 1) AS block,
                 '{{"prompt":' || to_json(prompt) || ',"completion":' || to_json(completion) || '}}' || chr(10) AS line
          FROM splits),
blocks AS (SELECT split, block, sum(strlen(line)) AS b, count(*) AS k FROM lines GROUP BY ALL),
dealt AS (SELECT *, (coalesce(sum(b) OVER before, 0) // 65536)::INT AS shard, coalesce(sum(k) OVER before, 0) AS line_at
          FROM blocks WINDOW before AS (PARTITION BY split ORDER BY block
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT split, shard, min(line_at)::BIGINT AS first_line, count(*) AS n_lines, min(pos) AS first_pos,
       max(pos) AS last_pos, sum(strlen(line))::BIGINT AS n_bytes, md5(string_agg(line, '' ORDER BY pos)) AS content
FROM lines JOIN dealt USING (split, block) GROUP BY split, shard""",
    "report_files": f"WITH {_ECHOED}, {_SCORING}, {_TOTALS} {_REPORT}",
    "report_versions": f"""
WITH {_SCORED}, {_TOTALS}, report AS ({_REPORT}) SELECT *, total AS n_details FROM report""",
    "report_details": f"""
WITH {_ECHOED}, {_SCORING}
SELECT conv_id * 1000 + turn AS item_id, prediction, char_similarity, exact, partial, status
FROM scored""",
    "smoke_files": """
WITH counts AS (
  SELECT count(*) FILTER (contains(text, 'ei') OR NOT (contains(text, 'qu') OR contains(text, 'sh')
                                                       OR contains(text, 'an'))) AS passed,
         count(*) AS total FROM conversations)
SELECT passed, total, CASE WHEN passed < total // 2 THEN 'weak' WHEN passed = total THEN 'ready'
                           ELSE 'good' END AS verdict FROM counts""",
    "shuffled_examples": f"""
WITH {_CORPUS}, kept AS (SELECT source, target FROM corpus WHERE {_LONG_ENOUGH}),
examples AS ({_expanded('kept', '')}),
ids AS (SELECT DISTINCT pair_id FROM examples), {_placed('ids', 'pair_id')},
splits AS (SELECT pair_id, {_SPLIT} FROM placed)
SELECT pair_id, kind, {_EXAMPLE_ORDER}, split FROM examples JOIN splits USING (pair_id)""",
    "example_copies": f"""
WITH kept AS (SELECT source, target FROM ({_ALL}) WHERE {_LONG_ENOUGH}),
examples AS ({_expanded('kept', '')}),
ranked AS (SELECT kind, {_EXAMPLE_ORDER}, count(*) OVER () AS n FROM examples)
SELECT split, kind, count(*) AS n_examples FROM (SELECT kind, {_SPLIT} FROM ranked)
GROUP BY split, kind""",
    "split_priority": f"""
WITH {_FIRST_PAIRS}
SELECT 'plain' AS leader, 'plain' AS split, ord, source, target FROM firsts
UNION ALL SELECT 'loud', 'loud', ord, {_LOUD}, target FROM firsts""",
    "corpus_array": f"""
WITH {_CORPUS} SELECT source, target, source_lang, target_lang FROM corpus""",
    "corpus_growth": f"""
WITH {_CORPUS} SELECT lower(source) AS source_key, lower(target) AS target_key FROM corpus""",
    "corpus_compacted": f"""
WITH {_CORPUS} SELECT state, lower(source) AS source_key, lower(target) AS target_key
FROM corpus, (VALUES ('grown'), ('compacted')) AS states(state)""",
    "example_build": f"""
WITH {_CORPUS}, {_placed('corpus', 'source, target', 'shuffled')},
kept AS (SELECT source, target FROM shuffled
         WHERE length(source) >= 2 AND length(target) >= 2),
examples AS ({_expanded('kept', '')}),
ids AS (SELECT DISTINCT pair_id FROM examples), {_placed('ids', 'pair_id')},
splits AS (SELECT pair_id, {_SPLIT} FROM placed)
SELECT split, kind, count(*) AS n_examples, sum(strlen(prompt))::BIGINT AS prompt_bytes,
       sum(strlen(completion))::BIGINT AS completion_bytes
FROM examples JOIN splits USING (pair_id) GROUP BY split, kind""",
    "language": f"SELECT doc_id, {_language('text')} AS detected FROM documents",
    "language_confusion": f"""
SELECT lang, {_language('text')} AS detected, count(*) AS n_texts FROM documents GROUP BY 1, 2""",
    "intent": f"""
SELECT conv_id, turn, {_mode("(CASE WHEN turn % 2 = 0 THEN 'Comment DIT-ON : ' || text ELSE text END)")} AS mode
FROM conversations""",
    "output_cleanup": f"""
WITH {_RAW}
SELECT conv_id, turn, {_FIRST_LINE} AS line,
       {_strip("replace(replace(raw, '<|eot_id|>', ''), '<|end_of_text|>', '')")} AS plain,
       {_reply('stderr')} AS reply
FROM outputs""",
    "chat_validation": f"""
WITH {_CHAT_REQUESTS}
SELECT request_id, session_id, max_tokens, temperature, errors FROM checked""",
    "translate_validation": f"""
WITH {_TRANSLATE_REQUESTS} SELECT request_id, direction, errors FROM checked""",
    "generate_stub": f"""
SELECT request_id, 'stub 100: ' || lower(text) AS output, true AS success FROM {_TURNS}""",
    "generate_errors": f"""
SELECT request_id, CASE WHEN NOT contains(text, 'ei') THEN text END AS output,
       NOT contains(text, 'ei') AS success,
       CASE WHEN contains(text, 'ei') THEN 'no answer to ei' END AS error FROM {_TURNS}""",
    "generate_batches": f"""
SELECT request_id, CASE WHEN NOT contains(text, 'ei') THEN text END AS output,
       NOT contains(text, 'ei') AS success,
       CASE WHEN contains(text, 'ei') THEN 'no answer to ei' END AS error FROM {_TURNS}""",
    "generate_buckets": f"""
SELECT request_id, CASE WHEN NOT contains(text, 'ei') THEN text END AS output,
       NOT contains(text, 'ei') AS success,
       CASE WHEN contains(text, 'ei') THEN 'no answer to ei' END AS error FROM {_TURNS}""",
    "rejected_requests": _REJECTED,
    "chat": _CHAT,
    "translate": _TRANSLATE,
    "translate_stream": _TRANSLATE,
    "reject_stream": _REJECTED,
    "latency": """
WITH calls AS (SELECT event_type AS mode, floor(value)::INT AS ms FROM events)
SELECT mode, count(*) AS n_calls, sum(ms)::DOUBLE / count(ms) AS mean_ms,
       quantile_cont(ms, 0.5)::DOUBLE AS p50_ms, quantile_cont(ms, 0.9)::DOUBLE AS p90_ms,
       quantile_cont(ms, 0.99)::DOUBLE AS p99_ms
FROM calls GROUP BY mode""",
    "latency_stream": """
WITH calls AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type AS mode, floor(value * 37)::BIGINT AS ms
               FROM events),
rounded AS (SELECT start, mode, CASE WHEN ms > 0 THEN (ms >> greatest(length(bin(ms)) - 7, 0)::BIGINT)
                                                      << greatest(length(bin(ms)) - 7, 0)::BIGINT ELSE ms END AS bucket
            FROM calls),
placed AS (SELECT *, row_number() OVER (PARTITION BY start, mode ORDER BY bucket) AS place,
                  count(*) OVER (PARTITION BY start, mode) AS n FROM rounded)
SELECT start, mode, max(n) AS n_calls, min(bucket) FILTER (place >= ceil(0.5::DOUBLE * n)) AS p50_ms,
       min(bucket) FILTER (place >= ceil(0.9::DOUBLE * n)) AS p90_ms,
       min(bucket) FILTER (place >= ceil(0.99::DOUBLE * n)) AS p99_ms FROM placed GROUP BY start, mode""",
    "matched_predictions": f"WITH {_PREDICTIONS} SELECT * FROM matched",
    "scored_items": f"""
WITH {_SCORED} SELECT conv_id, turn, char_similarity, exact, partial, status FROM scored""",
    "benchmark_report": f"WITH {_SCORED}, {_TOTALS} {_REPORT}",
    "benchmark_verdict": f"""
WITH {_SCORED}, {_TOTALS}
SELECT *, CASE WHEN pct_global >= 60 THEN 'good' WHEN pct_global >= 35 THEN 'fair'
               ELSE 'weak' END AS verdict FROM totals""",
    "scores_by_kind": f"""
WITH {_SCORED} SELECT conv_id % 3 AS kind, {_TOTAL_COLUMNS} FROM scored GROUP BY 1""",
    "smoke": f"""
WITH {_RAW}, counts AS (
  SELECT count(*) FILTER (length({_reply("''")}) > 2) AS passed, count(*) AS total FROM outputs)
SELECT passed, total, CASE WHEN passed < total // 2 THEN 'weak' WHEN passed = total THEN 'ready'
                           ELSE 'good' END AS verdict FROM counts""",
    "dataset_profile": """
SELECT count(*) AS n_rows, 'doc_id,text,lang,source,n_chars' AS column_names FROM documents""",
    "corpus_stream": f"""
SELECT ord, source, target, 'fr' AS source_lang, 'dioula' AS target_lang FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(source), lower(target) ORDER BY ord) AS rn
  FROM ({_ALL}))
WHERE rn = 1""",
    "request_stream": _CHAT,
    "request_sides": f"""
WITH {_CHAT_REQUESTS}
SELECT request_id, errors,
       CASE WHEN errors = '' THEN {_stub('max_tokens', _prompt('message', _SERVING))} END AS reponse FROM checked""",
}
