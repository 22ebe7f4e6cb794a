"""SQL of those queries on training text that SQL can express."""

# White space of Unicode, as it stands in a character class.
_BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"

_EMPTY = r"^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}\x{180E}\x{200B}-\x{200D}\x{2060}\x{FEFF}]*$"

_MESSAGES = rf"""
WITH RECURSIVE rows AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, uuid ORDER BY ingested_at, line_id) AS rn, lower(trim(coalesce(msg_role, line_type))) AS said FROM sdk_review WHERE session_id IS NOT NULL),
m AS (SELECT session_id, uuid, parent_uuid, ts, CASE said WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE said END AS role,
    msg_content IS NULL OR regexp_matches(msg_content, '{_EMPTY}') OR coalesce(CASE WHEN json_valid(msg_content) AND json_type(msg_content) = 'ARRAY' THEN
      len(list_filter(CAST(json_extract(msg_content, '$[*]') AS JSON[]), lambda b: NOT (coalesce(json_extract_string(b, '$.type') = 'text', false) AND regexp_matches(coalesce(json_extract_string(b, '$.text'), ''), '{_EMPTY}')))) = 0 END, false) AS blank
  FROM rows WHERE rn = 1),
one AS (SELECT session_id FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE parent_uuid IS NULL) = 1),
t AS (SELECT m.session_id, m.uuid, m.uuid AS top, 1 AS depth FROM m JOIN one USING (session_id) WHERE parent_uuid IS NULL
  UNION ALL SELECT m.session_id, m.uuid, t.top, t.depth + 1 FROM t JOIN m ON m.session_id = t.session_id AND m.parent_uuid = t.uuid),
whole AS (SELECT session_id FROM m LEFT JOIN t USING (session_id, uuid) GROUP BY 1 HAVING count(*) = count(t.uuid)),
climb AS (SELECT m.session_id, m.uuid AS at_uuid, m.parent_uuid, m.ts FROM m JOIN whole USING (session_id)
  UNION ALL SELECT c.session_id, p.uuid, p.parent_uuid, c.ts FROM climb c JOIN m p ON p.session_id = c.session_id AND p.uuid = c.parent_uuid),
late AS (SELECT session_id, at_uuid AS uuid, max(ts) AS latest FROM climb GROUP BY 1, 2),
best AS (SELECT m.session_id, m.parent_uuid, m.uuid FROM m JOIN late USING (session_id, uuid) WHERE m.parent_uuid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m.session_id, m.parent_uuid ORDER BY latest DESC NULLS LAST, m.uuid) = 1),
chain AS (SELECT m.session_id, m.uuid, 1 AS turn_no FROM m JOIN whole USING (session_id) WHERE parent_uuid IS NULL
  UNION ALL SELECT c.session_id, b.uuid, c.turn_no + 1 FROM chain c JOIN best b ON b.session_id = c.session_id AND b.parent_uuid = c.uuid),
turns AS (SELECT c.*, m.role, m.blank FROM chain c JOIN m USING (session_id, uuid)),
spoken AS (SELECT *, lead(role) OVER w AS reply, row_number() OVER w AS place FROM turns WHERE role <> 'system' WINDOW w AS (PARTITION BY session_id ORDER BY turn_no)),
kept AS (SELECT session_id FROM spoken GROUP BY 1 HAVING bool_and(role IN ('user', 'assistant')) AND bool_and(place > 1 OR role = 'user') AND bool_and(role <> 'user' OR coalesce(reply = 'assistant', false)) AND bool_or(role = 'user' AND NOT blank) AND bool_or(role = 'assistant' AND NOT blank))"""

ORACLES: dict[str, str] = {
    "p2_found": _MESSAGES + """
SELECT session_id, turn_no, uuid, role AS msg_role FROM turns JOIN kept USING (session_id)""",
    "p5_found": rf"""
SELECT block_id FROM note_blocks
WHERE coalesce(list_sum(list_transform(regexp_extract_all(block_text, '[\p{{L}}\p{{N}}_]+'), lambda x: CAST(ceil(length(x) / 6.0) AS BIGINT))), 0)
      + length(regexp_replace(block_text, '[\p{{L}}\p{{N}}_{_BLANK}]', '', 'g')) > 320""",
}
ORACLES["p2_rounds"] = ORACLES["p2_found"]

# What the pieces and containers must hold, stated over the texts.
ORACLES["p7_checks"] = "SELECT count(*) AS n_texts, 0 AS lost_tokens, 0 AS repeated_places, 0 AS over_tokens, 0 AS over_documents, 0 AS over_attention, 0 AS wrong_offset, true AS within_bound FROM documents WHERE text IS NOT NULL AND text <> ''"
ORACLES["p7_token_checks"] = ORACLES["p7_checks"]
ORACLES["p5_checks"] = rf"""
SELECT count(*) AS n_blocks, sum(CASE WHEN n > 320 THEN 0 ELSE 1 END) AS n_whole, 0 AS over_limit, 0 AS left_out, 0 AS over_overlap, 0 AS other_trail, 0 AS wrong_numbers
FROM (SELECT coalesce(list_sum(list_transform(regexp_extract_all(block_text, '[\p{{L}}\p{{N}}_]+'), lambda x: CAST(ceil(length(x) / 6.0) AS BIGINT))), 0)
      + length(regexp_replace(block_text, '[\p{{L}}\p{{N}}_{_BLANK}]', '', 'g')) AS n FROM note_blocks WHERE block_text <> '')"""
