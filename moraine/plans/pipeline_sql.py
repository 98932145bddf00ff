"""The same results as ``pipeline`` in plain SQL, for checks on small tables."""

_SNAPS = "snaps AS (SELECT table_uuid, snapshot_id, max(sequence_number) AS seq, min(timestamp_ms) AS ts, max(schema_id) AS sid FROM snapshots GROUP BY ALL)"

_CHANGES = f"""{_SNAPS},
changes AS (
  SELECT DISTINCT e.table_uuid, e.file_path, e.status,
         CASE WHEN e.status = 1 THEN coalesce(e.sequence_number, s.seq) ELSE s.seq END AS seq
  FROM manifest_entries e
  JOIN snaps s ON e.table_uuid = s.table_uuid AND coalesce(e.snapshot_id, e.added_snapshot_id) = s.snapshot_id
  WHERE e.status IN (1, 2)),
runs AS (SELECT * FROM consumer_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY logged_ms DESC) = 1)"""

P1 = f"""WITH {_CHANGES}
SELECT DISTINCT c.consumer, c.table_uuid, g.file_path, g.status
FROM (SELECT DISTINCT consumer, table_uuid FROM consumer_runs) c JOIN changes g USING (table_uuid)
WHERE g.seq IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM runs r WHERE r.run_status = 'succeeded' AND r.consumer = c.consumer AND r.table_uuid = c.table_uuid
    AND g.seq > r.from_sequence AND g.seq <= r.to_sequence)"""

P1_LEDGER = f"""WITH {_CHANGES},
points AS (SELECT DISTINCT table_uuid, seq FROM changes WHERE seq IS NOT NULL),
clock AS (SELECT max(logged_ms) AS now FROM consumer_runs),
items AS (
  SELECT c.consumer, p.table_uuid, p.seq,
    EXISTS (SELECT 1 FROM runs r WHERE r.run_status = 'succeeded' AND r.consumer = c.consumer AND r.table_uuid = c.table_uuid
            AND p.seq > r.from_sequence AND p.seq <= r.to_sequence) AS done,
    EXISTS (SELECT 1 FROM runs r, clock WHERE r.run_status = 'running' AND r.consumer = c.consumer AND r.table_uuid = c.table_uuid
            AND p.seq > r.from_sequence AND (r.to_sequence IS NULL OR p.seq <= r.to_sequence) AND r.logged_ms + 21600000 > now) AS held
  FROM (SELECT DISTINCT consumer, table_uuid FROM consumer_runs) c JOIN points p USING (table_uuid))
SELECT consumer, CASE WHEN done THEN 'done' WHEN held THEN 'leased' ELSE 'pending' END AS state, count(*) AS items
FROM items GROUP BY ALL"""


def _object(column: str) -> str:
    decoded = f"url_decode(replace({column}, '+', '%2B'))"
    store = f"regexp_replace({decoded}, '^s3[an]?:/*', 's3://')"
    return f"regexp_replace({store}, '([^:/])/(?:\\.?/)+', '\\1/', 'g')"


P2 = f"""WITH {_SNAPS},
files AS (
  SELECT e.table_uuid, e.file_path, max(e.content) AS content, max(list_sort(e.equality_ids)) AS ids, bool_or(e.status = 2) AS removed,
    coalesce(max(CASE WHEN e.status = 1 THEN coalesce(e.sequence_number, s.seq) END), max(e.sequence_number)) AS seq
  FROM manifest_entries e LEFT JOIN snaps s
    ON e.table_uuid = s.table_uuid AND coalesce(e.snapshot_id, e.added_snapshot_id) = s.snapshot_id
  GROUP BY ALL),
feed AS (SELECT DISTINCT r.* EXCLUDE (arrived_at), f.content, f.ids, f.seq, f.removed FROM delta_rows r JOIN files f USING (table_uuid, file_path)),
base AS (SELECT *, {_object('file_path')} AS object FROM feed WHERE content = 0 AND NOT removed),
pos AS (SELECT {_object('del_path')} AS object, del_offset, max(seq) AS seq FROM feed WHERE content = 1 GROUP BY ALL),
eq AS (SELECT table_uuid, ids, list_contains(ids, 1) AS i1, list_contains(ids, 2) AS i2, list_contains(ids, 3) AS i3,
         CASE WHEN list_contains(ids, 1) THEN row_id END AS v1, CASE WHEN list_contains(ids, 2) THEN row_key END AS v2,
         CASE WHEN list_contains(ids, 3) THEN row_value END AS v3, max(seq) AS seq
       FROM feed WHERE content = 2 AND len(ids) > 0 GROUP BY ALL),
masks AS (SELECT DISTINCT ids, i1, i2, i3 FROM eq)
SELECT DISTINCT b.file_path, b.row_pos FROM base b
WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.object = b.object AND p.del_offset = b.row_pos AND p.seq >= b.seq)
  AND (b.file_path, b.row_pos) NOT IN (
    SELECT (x.file_path, x.row_pos) FROM (
      SELECT b2.file_path, b2.row_pos, b2.table_uuid, b2.seq, m.ids, CASE WHEN m.i1 THEN row_id END AS v1,
        CASE WHEN m.i2 THEN row_key END AS v2, CASE WHEN m.i3 THEN row_value END AS v3
      FROM base b2, masks m) x
    JOIN eq ON eq.table_uuid = x.table_uuid AND eq.ids = x.ids AND eq.v1 IS NOT DISTINCT FROM x.v1
      AND eq.v2 IS NOT DISTINCT FROM x.v2 AND eq.v3 IS NOT DISTINCT FROM x.v3 AND eq.seq > x.seq)"""

_LIVE = """live AS (
  SELECT table_uuid, file_path, max(partition_tuple) AS partition_tuple, max(file_size_in_bytes) AS bytes, max(record_count) AS records
  FROM manifest_entries WHERE content = 0 GROUP BY table_uuid, file_path HAVING NOT bool_or(status = 2)),
small AS (SELECT *, count(*) OVER (PARTITION BY table_uuid, partition_tuple) AS n FROM live WHERE bytes < 262144)"""

P3 = f"WITH {_LIVE} SELECT table_uuid, file_path FROM small WHERE n >= 2"

P3_GROUPS = f"""WITH {_LIVE}
SELECT table_uuid, partition_tuple, count(*) AS inputs, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, true AS even
FROM small WHERE n >= 2 GROUP BY ALL"""

P4 = """WITH RECURSIVE nodes AS (SELECT table_uuid, snapshot_id, max(parent_snapshot_id) AS parent FROM snapshots GROUP BY ALL),
tree AS (
  SELECT n.table_uuid, n.snapshot_id, n.snapshot_id AS root, 0::BIGINT AS depth FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.table_uuid = n.table_uuid AND p.snapshot_id = n.parent)
  UNION ALL
  SELECT n.table_uuid, n.snapshot_id, t.root, t.depth + 1 FROM tree t JOIN nodes n ON n.table_uuid = t.table_uuid AND n.parent = t.snapshot_id)
SELECT n.table_uuid, n.snapshot_id, coalesce(t.root, -1) AS root_snapshot_id, coalesce(t.depth, -1) AS depth
FROM nodes n LEFT JOIN tree t USING (table_uuid, snapshot_id)"""

P4_DESCENDANTS = """WITH RECURSIVE nodes AS (SELECT table_uuid, snapshot_id, max(parent_snapshot_id) AS parent FROM snapshots GROUP BY ALL),
tree AS (
  SELECT n.table_uuid, n.snapshot_id FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.table_uuid = n.table_uuid AND p.snapshot_id = n.parent)
  UNION ALL
  SELECT n.table_uuid, n.snapshot_id FROM tree t JOIN nodes n ON n.table_uuid = t.table_uuid AND n.parent = t.snapshot_id),
up AS (
  SELECT table_uuid, snapshot_id, snapshot_id AS a FROM tree
  UNION ALL
  SELECT u.table_uuid, u.snapshot_id, p.snapshot_id FROM up u JOIN nodes n ON n.table_uuid = u.table_uuid AND n.snapshot_id = u.a
    JOIN nodes p ON p.table_uuid = n.table_uuid AND p.snapshot_id = n.parent),
sizes AS (SELECT table_uuid, a, count(*) - 1 AS below FROM up GROUP BY ALL)
SELECT n.table_uuid, n.snapshot_id, coalesce(s.below, -1) AS descendants FROM nodes n LEFT JOIN sizes s ON s.table_uuid = n.table_uuid AND s.a = n.snapshot_id"""

P4_SPANS = f"""SELECT t.*, d.descendants, true AS nested FROM ({P4}) t JOIN ({P4_DESCENDANTS}) d USING (table_uuid, snapshot_id)"""

P4_PATHS = """WITH RECURSIVE nodes AS (SELECT table_uuid, snapshot_id, max(parent_snapshot_id) AS parent FROM snapshots GROUP BY ALL),
tree AS (
  SELECT n.table_uuid, n.snapshot_id FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.table_uuid = n.table_uuid AND p.snapshot_id = n.parent)
  UNION ALL
  SELECT n.table_uuid, n.snapshot_id FROM tree t JOIN nodes n ON n.table_uuid = t.table_uuid AND n.parent = t.snapshot_id),
up AS (
  SELECT table_uuid, snapshot_id, snapshot_id AS a, 0::BIGINT AS distance FROM tree
  UNION ALL
  SELECT u.table_uuid, u.snapshot_id, p.snapshot_id, distance + 1 FROM up u JOIN nodes n ON n.table_uuid = u.table_uuid AND n.snapshot_id = u.a
    JOIN nodes p ON p.table_uuid = n.table_uuid AND p.snapshot_id = n.parent)
SELECT table_uuid, snapshot_id, a AS ancestor_snapshot_id, distance FROM up
UNION ALL SELECT table_uuid, snapshot_id, -1, -1 FROM nodes ANTI JOIN tree USING (table_uuid, snapshot_id)"""

P4_HISTORY = """WITH RECURSIVE nodes AS (SELECT table_uuid, snapshot_id, max(parent_snapshot_id) AS parent FROM snapshots GROUP BY ALL),
wanted AS (SELECT table_uuid, current_snapshot_id AS snapshot_id FROM table_metadata
  QUALIFY row_number() OVER (PARTITION BY table_uuid ORDER BY last_updated_ms DESC, metadata_file DESC) = 1),
up AS (
  SELECT n.table_uuid, n.snapshot_id, n.snapshot_id AS a, 0::BIGINT AS distance FROM nodes n JOIN wanted USING (table_uuid, snapshot_id)
  UNION ALL
  SELECT u.table_uuid, u.snapshot_id, p.snapshot_id, distance + 1 FROM up u JOIN nodes n ON n.table_uuid = u.table_uuid AND n.snapshot_id = u.a
    JOIN nodes p ON p.table_uuid = n.table_uuid AND p.snapshot_id = n.parent
  WHERE distance < (SELECT count(*) FROM nodes)),
endless AS (SELECT DISTINCT table_uuid, snapshot_id FROM up GROUP BY table_uuid, snapshot_id, a HAVING count(*) > 1)
SELECT table_uuid, snapshot_id, a AS ancestor_snapshot_id, distance FROM up ANTI JOIN endless USING (table_uuid, snapshot_id)"""

_FIELDS = """docs AS (SELECT table_uuid, unnest(json_extract(schemas_json, '$[*]')) AS s FROM table_metadata),
schemas AS (SELECT table_uuid, CAST(s ->> '$."schema-id"' AS INT) AS schema_id, max(s::VARCHAR)::JSON AS s FROM docs GROUP BY ALL),
fields AS (
  SELECT table_uuid, schema_id, CAST(f ->> '$.id' AS INT) AS field_id, -1 AS parent_field_id, f ->> '$.name' AS name, f -> '$.type' AS t
  FROM (SELECT table_uuid, schema_id, unnest(json_extract(s, '$.fields[*]')) AS f FROM schemas)
  UNION ALL
  SELECT table_uuid, schema_id, CAST(f ->> '$.id' AS INT), up, f ->> '$.name', f -> '$.type' FROM (
    SELECT table_uuid, schema_id, field_id AS up, unnest(CASE t ->> '$.type'
      WHEN 'struct' THEN json_extract(t, '$.fields[*]')
      WHEN 'list' THEN [json_object('id', t -> '$."element-id"', 'name', 'element', 'type', t -> '$.element')]
      WHEN 'map' THEN [json_object('id', t -> '$."key-id"', 'name', 'key', 'type', t -> '$.key'),
                       json_object('id', t -> '$."value-id"', 'name', 'value', 'type', t -> '$.value')]
      ELSE [] END) AS f
    FROM fields)),
kinds AS (SELECT table_uuid, schema_id, field_id, parent_field_id, name, replace(coalesce(t ->> '$.type', t ->> '$'), ' ', '') AS kind FROM fields)"""

P5 = f"""WITH RECURSIVE {_FIELDS},
steps AS (SELECT table_uuid, schema_id, lag(schema_id) OVER (PARTITION BY table_uuid ORDER BY schema_id) AS before FROM schemas),
pairs AS (
  SELECT s.table_uuid, s.schema_id, coalesce(n.field_id, o.field_id) AS field_id, n.field_id AS nf, o.field_id AS of, n.name AS nn, o.name AS oname, n.kind AS nk, o.kind AS ok
  FROM (SELECT k.*, st.before FROM kinds k JOIN steps st USING (table_uuid, schema_id) WHERE st.before IS NOT NULL) n
  FULL JOIN (SELECT k.table_uuid, st.schema_id, k.field_id, k.name, k.kind FROM kinds k JOIN steps st ON st.table_uuid = k.table_uuid AND st.before = k.schema_id) o
    ON n.table_uuid = o.table_uuid AND n.schema_id = o.schema_id AND n.field_id = o.field_id
  JOIN steps s ON s.table_uuid = coalesce(n.table_uuid, o.table_uuid) AND s.schema_id = coalesce(n.schema_id, o.schema_id))
SELECT table_uuid, schema_id, field_id, 'added' AS change FROM pairs WHERE of IS NULL
UNION ALL SELECT table_uuid, schema_id, field_id, 'removed' FROM pairs WHERE nf IS NULL
UNION ALL SELECT table_uuid, schema_id, field_id, 'renamed' FROM pairs WHERE nf = of AND nn <> oname
UNION ALL SELECT table_uuid, schema_id, field_id, 'retyped' FROM pairs WHERE nf = of AND nk <> ok"""

P5_UNION = f"""WITH RECURSIVE {_FIELDS},
first AS (SELECT table_uuid, field_id, kind, min(schema_id) AS since_schema_id, CAST(count(DISTINCT schema_id) AS INT) AS schemas,
  array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM kinds GROUP BY ALL)
SELECT table_uuid, field_id, CAST(row_number() OVER (PARTITION BY table_uuid, field_id ORDER BY since_schema_id, kind) - 1 AS INT) AS tag, * EXCLUDE (table_uuid, field_id) FROM first"""

P5_LEAVES = """WITH records AS (SELECT DISTINCT table_uuid, file_path, row_pos, schema_id, payload FROM file_records WHERE json_type(payload) = 'OBJECT')
SELECT table_uuid, file_path, row_pos, CAST(sum(CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN 1 ELSE 0 END) AS BIGINT) AS leaves
FROM records, json_tree(payload) t GROUP BY ALL"""

P6 = f"WITH RECURSIVE {_FIELDS} SELECT DISTINCT table_uuid, schema_id, field_id, parent_field_id FROM fields"

_TREE = """docs AS (SELECT table_uuid, unnest(json_extract(schemas_json, '$[*]')) AS s FROM table_metadata),
schemas AS (SELECT table_uuid, CAST(s ->> '$."schema-id"' AS INT) AS schema_id, max(s::VARCHAR)::JSON AS s FROM docs GROUP BY ALL),
cells AS (SELECT table_uuid, schema_id, j.atom, j.value, j.type, replace(j.fullkey, '"', '') AS k FROM schemas, json_tree(s) j)"""

P6_SCHEMA = f"""WITH {_TREE},
named AS (SELECT type, regexp_replace(replace(k, '$.', '$/'), '\\[\\d+\\]\\.?', '/', 'g') AS k FROM cells WHERE type NOT IN ('OBJECT', 'ARRAY')),
places AS (SELECT regexp_extract(k, '^(.*)/([^/]*)$', 1) AS relation, regexp_extract(k, '^(.*)/([^/]*)$', 2) AS name,
  CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'long' WHEN 'BIGINT' THEN 'long' END AS kind FROM named)
SELECT relation, name, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS cells FROM places GROUP BY ALL"""

P6_RELATIONS = f"""WITH {_TREE},
rows AS (SELECT table_uuid, schema_id, replace(replace(k, '$.', '$/'), '].', ']/') AS row_key, value AS v FROM cells WHERE type = 'OBJECT'),
placed AS (SELECT *, regexp_replace(row_key, '\\[\\d+\\]', '', 'g') AS relation FROM rows)
SELECT table_uuid, schema_id, relation, row_key, regexp_replace(row_key, '/[^/]*$', '') AS parent_key, CAST(regexp_extract(row_key, '\\[(\\d+)\\]$', 1) AS INT) AS ordinal,
  CAST(v ->> '$.id' AS BIGINT) AS id, v ->> '$.name' AS name, CAST(v ->> '$.required' AS BOOLEAN) AS required, v ->> '$.doc' AS doc,
  CASE WHEN json_type(v, '$.type') = 'VARCHAR' THEN v ->> '$.type' END AS type
FROM placed WHERE relation IN ('$/fields', '$/fields/type.fields', '$/fields/type.element.fields') AND row_key LIKE '%]'"""

P6_TABLES = f"""WITH {_TREE},
keyed AS (SELECT table_uuid, schema_id, type, value ->> '$' AS value, replace(replace(k, '$.', '$/'), '].', ']/') AS k, k = '$' OR k LIKE '%]' AS is_row FROM cells WHERE type <> 'ARRAY'),
leaves AS (
  SELECT table_uuid, schema_id, CASE WHEN is_row THEN k ELSE regexp_replace(k, '/[^/]*$', '') END AS row_key,
    CASE WHEN is_row THEN '' ELSE regexp_extract(k, '[^/]*$') END AS name, type AS kind, value
  FROM keyed WHERE type <> 'OBJECT'),
rows AS (
  SELECT * FROM leaves
  UNION ALL SELECT table_uuid, schema_id, row_key, NULL, NULL, NULL
  FROM (SELECT table_uuid, schema_id, k AS row_key FROM keyed WHERE type = 'OBJECT' AND is_row) ANTI JOIN leaves USING (table_uuid, schema_id, row_key)),
placed AS (SELECT *, regexp_replace(row_key, '\\[\\d+\\]', '', 'g') AS relation FROM rows),
types AS (
  SELECT relation, name, CASE WHEN bool_and(kind = 'BOOLEAN') THEN 'boolean' WHEN bool_and(kind IN ('UBIGINT', 'BIGINT')) THEN 'bigint'
    WHEN bool_and(kind IN ('UBIGINT', 'BIGINT', 'DOUBLE')) THEN 'double' ELSE 'string' END AS type
  FROM placed WHERE kind <> 'NULL' GROUP BY ALL)
SELECT table_uuid, schema_id, relation, row_key, CASE WHEN row_key <> '$' THEN regexp_replace(row_key, '/[^/]*$', '') END AS parent_key,
  CASE WHEN row_key = '$' THEN 0 ELSE CAST(regexp_extract(row_key, '\\[(\\d+)\\]$', 1) AS INT) END AS ordinal,
  name, CASE WHEN name IS NOT NULL THEN coalesce(type, 'string') END AS type, value
FROM placed LEFT JOIN types USING (relation, name)"""

P7 = f"""WITH {_SNAPS},
refs AS (
  SELECT 'snapshots' AS ref_table, table_uuid, manifest_list AS ref_path, min(timestamp_ms) AS at_ms FROM snapshots WHERE manifest_list IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'metadata_log', table_uuid, metadata_file, min(timestamp_ms) FROM metadata_log WHERE metadata_file IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'manifest_entries', e.table_uuid, e.file_path, min(s.ts)
  FROM manifest_entries e LEFT JOIN snaps s ON e.table_uuid = s.table_uuid AND coalesce(e.snapshot_id, e.added_snapshot_id) = s.snapshot_id
  GROUP BY e.table_uuid, e.file_path HAVING NOT bool_or(e.status = 2)),
objects AS (SELECT {_object('file_path')} AS object, arg_max(created_ms, listed_ms) AS created, max(listed_ms) AS listed FROM stored_files GROUP BY 1),
gone AS (SELECT {_object('file_path')} AS object, listed_ms AS listed, max(deleted_ms) AS deleted FROM stored_files GROUP BY 1, 2),
found AS (
  SELECT r.*, CASE WHEN o.object IS NULL THEN 'missing' WHEN g.deleted IS NOT NULL THEN 'deleted' WHEN o.created > r.at_ms THEN 'late' END AS state
  FROM refs r LEFT JOIN objects o ON o.object = {_object('r.ref_path')} LEFT JOIN gone g ON g.object = o.object AND g.listed = o.listed)
SELECT ref_table, table_uuid, ref_path, strftime(make_timestamp(at_ms * 1000), '%Y-%m') AS period, state FROM found WHERE state IS NOT NULL"""

P7_REPORT = f"SELECT ref_table, table_uuid, period, state, count(*) AS orphans FROM ({P7}) GROUP BY ALL"

ORACLE_SQL = {
    "p1_found": P1,
    "p1_ledger": P1_LEDGER,
    "p1_runs": P1,
    "p2_found": P2,
    "p2_feeds": P2,
    "p3_found": P3,
    "p3_groups": P3_GROUPS,
    "p3_rewritten": "SELECT table_uuid, file_path, row_pos, schema_id, payload FROM file_records",
    "p4_found": P4,
    "p4_spans": P4_SPANS,
    "p4_descendants": P4_DESCENDANTS,
    "p4_paths": P4_PATHS,
    "p4_history": P4_HISTORY,
    "p5_found": P5,
    "p5_union": P5_UNION,
    "p5_leaves": P5_LEAVES,
    "p6_found": P6,
    "p6_schema": P6_SCHEMA,
    "p6_relations": P6_RELATIONS,
    "p6_tables": P6_TABLES,
    "p7_found": P7,
    "p7_report": P7_REPORT,
}
