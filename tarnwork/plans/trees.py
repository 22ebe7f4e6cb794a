"""Queries on worker hierarchies and nested transcript records (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.operators.hierarchy import descendant_counts, descendants, hierarchy
from tarnwork.operators.nested import array_objects, unnest
from tarnwork.runtime import table

JSON_COLUMNS = ["message", "tool_use_result"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, path and state of every worker of a session."""
    return hierarchy(table(spark, sf_dir, "subagents")).selectExpr("session_id", "node_id AS agent_id", "root_id AS root_agent_id", "tree_depth", "node_path", "node_state")


def p1_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`p1_found` and the number of descendants with every session contracted by distributed rounds."""
    return hierarchy(table(spark, sf_dir, "subagents"), limit=0).selectExpr("session_id", "node_id AS agent_id", "root_id AS root_agent_id", "tree_depth", "node_path", "node_state", "n_descendants")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of workers below every worker that lies in a tree."""
    return descendant_counts(hierarchy(table(spark, sf_dir, "subagents"))).withColumnRenamed("node_id", "agent_id")


def p1_descendant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every worker of a tree with each worker below it and the distance."""
    return descendants(hierarchy(table(spark, sf_dir, "subagents"))).selectExpr("session_id", "ancestor_id AS agent_id", "descendant_id", "distance")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array objects of the transcripts' JSON columns, answers linked to the line of their call."""
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", *JSON_COLUMNS)
    found = unnest(lines, id_column="line_id", columns=JSON_COLUMNS, twice_encoded=["message"])
    return found.selectExpr("row_id AS line_id", "item_path", "parent_path", "item_type", "use_row_id AS use_line_id")


def p4_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many array objects of each type and depth of enclosure the transcripts hold."""
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", *JSON_COLUMNS)
    objects = array_objects(lines, id_column="line_id", columns=JSON_COLUMNS, twice_encoded=["message"])
    return objects.selectExpr("item_type", "parent_path = '' AS outermost").groupBy("item_type", "outermost").count().withColumnRenamed("count", "n_objects")


QUERIES = {"p1_found": p1_found, "p1_rounds": p1_rounds, "p1_descendants": p1_descendants, "p1_descendant_pairs": p1_descendant_pairs, "p4_found": p4_found, "p4_types": p4_types}

_CLEAN = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^agent-', '')"

_FOREST = f"""
WITH RECURSIVE rows AS (
  SELECT session_id, {_CLEAN.format('agent_id')} AS agent_id, {_CLEAN.format('parent_agent_id')} AS parent_id,
         row_number() OVER (PARTITION BY session_id, {_CLEAN.format('agent_id')} ORDER BY captured_at DESC, record_id DESC) AS rn
  FROM subagents),
cur AS (SELECT session_id, agent_id, parent_id FROM rows WHERE rn = 1),
node AS (SELECT c.session_id, c.agent_id, p.agent_id AS parent_id FROM cur c LEFT JOIN cur p ON p.session_id = c.session_id AND p.agent_id = c.parent_id),
tree AS (
  SELECT session_id, agent_id, agent_id AS root_agent_id, 1 AS tree_depth, agent_id AS node_path FROM node WHERE parent_id IS NULL
  UNION ALL
  SELECT n.session_id, n.agent_id, t.root_agent_id, t.tree_depth + 1, t.node_path || '/' || n.agent_id
  FROM tree t JOIN node n ON n.session_id = t.session_id AND n.parent_id = t.agent_id),
lost AS (SELECT n.* FROM node n LEFT JOIN tree t USING (session_id, agent_id) WHERE t.agent_id IS NULL),
climb AS (
  SELECT session_id, agent_id, parent_id AS here FROM lost
  UNION
  SELECT c.session_id, c.agent_id, l.parent_id FROM climb c JOIN lost l ON l.session_id = c.session_id AND l.agent_id = c.here)
"""

# Every element of a valid text by the SQL engine's own walk; of one encoded twice the inner text's.
_ELEMENTS = """
WITH src AS (
  SELECT line_id, 'message' AS col, CASE WHEN json_valid(message) THEN CASE WHEN json_type(message) = 'VARCHAR' THEN json_extract_string(message, '$') ELSE message END END AS j FROM transcript_lines
  UNION ALL SELECT line_id, 'tool_use_result', tool_use_result FROM transcript_lines),
walk AS (SELECT s.line_id, s.col, e.fullkey, e.type, e.value, e.id, e.parent FROM (SELECT * FROM src WHERE json_valid(j)) s, json_tree(s.j) e WHERE e.type IN ('OBJECT', 'ARRAY')),
el AS (SELECT o.line_id, o.col, o.fullkey, CASE WHEN json_type(o.value, '$.type') = 'VARCHAR' THEN json_extract_string(o.value, '$.type') ELSE '' END AS item_type,
    CASE WHEN json_type(o.value, '$.id') = 'VARCHAR' THEN json_extract_string(o.value, '$.id') END AS own_id, CASE WHEN json_type(o.value, '$.tool_use_id') = 'VARCHAR' THEN json_extract_string(o.value, '$.tool_use_id') END AS answers_id
  FROM walk o JOIN walk a ON a.line_id = o.line_id AND a.col = o.col AND a.id = o.parent WHERE o.type = 'OBJECT' AND a.type = 'ARRAY'),
up AS (SELECT c.line_id, c.col, c.fullkey, arg_max(p.fullkey, length(p.fullkey)) AS above FROM el c JOIN el p ON p.line_id = c.line_id AND p.col = c.col AND starts_with(c.fullkey, p.fullkey || '.') GROUP BY 1, 2, 3),
uses AS (SELECT own_id, min(line_id) AS use_line_id FROM el WHERE item_type = 'tool_use' AND own_id IS NOT NULL GROUP BY 1)"""

ORACLES = {
    "p4_found": _ELEMENTS + """
SELECT c.line_id, c.col || substr(c.fullkey, 2) AS item_path, coalesce(c.col || substr(u.above, 2), '') AS parent_path, c.item_type, coalesce(s.use_line_id, 0) AS use_line_id
FROM el c LEFT JOIN up u USING (line_id, col, fullkey) LEFT JOIN uses s ON c.item_type = 'tool_result' AND s.own_id = c.answers_id""",
    "p4_types": _ELEMENTS + """
SELECT item_type, u.above IS NULL AS outermost, count(*) AS n_objects FROM el LEFT JOIN up u USING (line_id, col, fullkey) GROUP BY 1, 2""",
    "p1_found": _FOREST + """
SELECT session_id, agent_id, root_agent_id, tree_depth, node_path, 'tree' AS node_state FROM tree
UNION ALL
SELECT session_id, agent_id, '', -1, '', CASE WHEN bool_or(here = agent_id) THEN 'cycle' ELSE 'below_cycle' END FROM climb GROUP BY 1, 2""",
    "p1_rounds": _FOREST + """,
up AS (
  SELECT session_id, parent_id AS agent_id, agent_id AS low FROM node WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT u.session_id, n.parent_id, u.low FROM up u JOIN node n ON n.session_id = u.session_id AND n.agent_id = u.agent_id JOIN tree t ON t.session_id = n.session_id AND t.agent_id = n.agent_id WHERE n.parent_id IS NOT NULL)
SELECT t.session_id, t.agent_id, t.root_agent_id, t.tree_depth, t.node_path, 'tree' AS node_state, count(u.low) AS n_descendants FROM tree t LEFT JOIN up u ON u.session_id = t.session_id AND u.agent_id = t.agent_id GROUP BY ALL
UNION ALL
SELECT session_id, agent_id, '', -1, '', CASE WHEN bool_or(here = agent_id) THEN 'cycle' ELSE 'below_cycle' END, NULL FROM climb GROUP BY 1, 2""",
    "p1_descendant_pairs": _FOREST + """,
up AS (
  SELECT session_id, parent_id AS agent_id, agent_id AS low FROM node WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT u.session_id, n.parent_id, u.low FROM up u JOIN node n ON n.session_id = u.session_id AND n.agent_id = u.agent_id JOIN tree t ON t.session_id = n.session_id AND t.agent_id = n.agent_id WHERE n.parent_id IS NOT NULL)
SELECT u.session_id, u.agent_id, u.low AS descendant_id, l.tree_depth - t.tree_depth AS distance
FROM up u JOIN tree t ON t.session_id = u.session_id AND t.agent_id = u.agent_id JOIN tree l ON l.session_id = u.session_id AND l.agent_id = u.low""",
    "p1_descendants": _FOREST + """,
up AS (
  SELECT session_id, parent_id AS agent_id, agent_id AS low FROM node WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT u.session_id, n.parent_id, u.low FROM up u JOIN node n ON n.session_id = u.session_id AND n.agent_id = u.agent_id JOIN tree t ON t.session_id = n.session_id AND t.agent_id = n.agent_id WHERE n.parent_id IS NOT NULL)
SELECT t.session_id, t.agent_id, t.tree_depth, count(u.low) AS n_descendants
FROM tree t LEFT JOIN up u ON u.session_id = t.session_id AND u.agent_id = t.agent_id GROUP BY 1, 2, 3""",
}
