"""Queries of the general intake problems (p1, p2, p4) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators.redelivery import accept_once, deduplicated, repeats
from sentrymill.operators.schema_drift import DriftingFiles
from sentrymill.operators.strict_load import StrictLoader
from sentrymill.sources.tables import small_rows, table

ORDER = ["timestamp", "received_at"]
FIELD_BOUND = 10_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "messages"), ORDER)


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    return accept_once(table(spark, d, "messages"), ORDER).ranges


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    kept = deduplicated(table(spark, d, "messages"), ORDER)
    return kept.select("delivery_id", "id", "chat_id", "sender", "text", "timestamp", "received_at", "status")


def _loader(spark: SparkSession, d: str) -> StrictLoader:
    catalogs = {
        "dataset_name": table(spark, d, "dataset_catalog").select("dataset_name"),
        "label_fine": table(spark, d, "label_catalog").select("label_fine"),
    }
    return StrictLoader(table(spark, d, "flow_file_layout"), catalogs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _loader(spark, d).rejected(table(spark, d, "raw_flow_lines"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return _loader(spark, d).load(table(spark, d, "raw_flow_lines"))


def _drift(spark: SparkSession, d: str) -> DriftingFiles:
    return DriftingFiles(table(spark, d, "flow_exports"), table(spark, d, "field_aliases"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).changes()


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    fused = _drift(spark, d).fused()
    return fused.select("field", "files", F.array_join("names", "|").alias("names"), F.array_join("alternatives", "|").alias("alternatives"), "canonical_type")


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """The one table, with its typed branches and the fields without alias listed as text."""
    drift = _drift(spark, d)
    t = drift.unified({r.field: r.type for r in small_rows(drift.converting_types(), FIELD_BOUND)})
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "|")
    return t.withColumns({"branches": listed("branches"), "other": listed("other")})


def p4_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).alternative_changes()


QUERIES = {f.__name__: f for f in (p1_found, p1_ranges, p1_messages, p2_found, p2_loaded, p4_found, p4_fields, p4_table, p4_alternatives)}

_P1 = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY "timestamp" NULLS LAST, received_at NULLS LAST, delivery_id) AS rn
  FROM messages WHERE id IS NOT NULL)
"""

_P2 = r"""
lines AS (
  SELECT line_id, raw_line, '[' || delimiter || ']' AS d,
         '(?:"(?:[^"]|"")*"|[^"' || delimiter || ']*)' AS f
  FROM raw_flow_lines),
quoted AS (
  SELECT line_id, regexp_full_match(raw_line, '(?s)' || f || '(?:' || d || f || ')*') AS ok,
         regexp_extract_all(substr(d, 2, 1) || raw_line, '(?s)' || d || '(' || f || ')', 1) AS fs
  FROM lines),
fields AS (
  SELECT line_id, ok, list_transform(fs, lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' ')) AS fs
  FROM quoted),
vals AS (
  SELECT line_id, l.col_no, l.value_type, l.may_be_empty, l.min_value, l.max_value, l.column_name, fs[l.col_no] AS v
  FROM fields, flow_file_layout l WHERE ok AND len(fs) = (SELECT count(*) FROM flow_file_layout)),
bad AS (
  SELECT DISTINCT line_id FROM vals WHERE CASE
    WHEN v = '' THEN NOT may_be_empty
    WHEN value_type = 'long' THEN NOT (regexp_full_match(v, '-?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL
         AND try_cast(v AS BIGINT) >= coalesce(min_value, try_cast(v AS BIGINT)) AND try_cast(v AS BIGINT) <= coalesce(max_value, try_cast(v AS BIGINT)))
    WHEN value_type = 'double' THEN NOT (regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND try_cast(v AS DOUBLE) IS NOT NULL
         AND try_cast(v AS DOUBLE) >= coalesce(min_value, try_cast(v AS DOUBLE)) AND try_cast(v AS DOUBLE) <= coalesce(max_value, try_cast(v AS DOUBLE)))
    WHEN column_name = 'dataset_name' THEN lower(v) NOT IN (SELECT lower(dataset_name) FROM dataset_catalog)
    WHEN column_name = 'label_fine' THEN lower(v) NOT IN (SELECT lower(label_fine) FROM label_catalog)
    ELSE false END),
verdict AS (
  SELECT f.line_id, f.fs, CASE WHEN NOT ok THEN 'quoting' WHEN len(fs) <> (SELECT count(*) FROM flow_file_layout) THEN 'columns'
              WHEN b.line_id IS NOT NULL THEN 'value' END AS reason
  FROM fields f LEFT JOIN bad b USING (line_id))
"""

_P2_COLUMNS = ", ".join(
    f"CAST(nullif(fs[{i}], '') AS {t}) AS {n}"
    for i, (n, t) in enumerate(
        {
            "record_no": "BIGINT", "dataset_name": "VARCHAR", "src_port": "BIGINT", "dst_port": "BIGINT", "protocol": "BIGINT", "duration": "BIGINT",
            "fwd_packets": "BIGINT", "bwd_packets": "BIGINT", "fwd_bytes": "BIGINT", "bwd_bytes": "BIGINT", "flow_iat_mean": "DOUBLE",
            "init_fwd_win_bytes": "BIGINT", "note": "VARCHAR", "label_fine": "VARCHAR",
        }.items(),
        1,
    )
)

_P4 = """
keyed AS (
  SELECT exporter_id, file_seq, k AS name, json_type(payload, '$."' || k || '"') AS t
  FROM (SELECT exporter_id, file_seq, payload, unnest(json_keys(payload)) AS k FROM flow_exports)),
al AS (SELECT regexp_replace(lower(alias), '[ _.-]', '', 'g') AS a, min(field) AS field FROM field_aliases GROUP BY 1),
fields AS (
  SELECT exporter_id, file_seq, coalesce(al.field, name) AS field, list_sort(list_distinct(list(name))) AS names,
         bool_or(t = 'VARCHAR') AS is_text, bool_or(t = 'DOUBLE') AS is_decimal, bool_or(t IN ('BIGINT', 'UBIGINT')) AS is_integer, bool_or(t = 'BOOLEAN') AS is_boolean
  FROM keyed LEFT JOIN al ON al.a = regexp_replace(lower(name), '[ _.-]', '', 'g') GROUP BY 1, 2, 3),
typed AS (
  SELECT *, CASE WHEN is_text THEN 'text' WHEN is_decimal THEN 'decimal' WHEN is_integer THEN 'integer' WHEN is_boolean THEN 'boolean' END AS type FROM fields),
files AS (
  SELECT exporter_id, file_seq, min(file_name) AS file_name, lag(file_seq) OVER (PARTITION BY exporter_id ORDER BY file_seq) AS prev
  FROM flow_exports GROUP BY 1, 2),
both_sides AS (
  SELECT f.file_name, coalesce(c.field, p.field) AS field, c.names AS cn, p.names AS pn, c.type AS ct, p.type AS pt
  FROM files f
  JOIN (SELECT exporter_id, file_seq AS s, field FROM typed UNION SELECT t.exporter_id, f2.file_seq, t.field FROM typed t JOIN files f2 ON f2.exporter_id = t.exporter_id AND f2.prev = t.file_seq) u
    ON u.exporter_id = f.exporter_id AND u.s = f.file_seq
  LEFT JOIN typed c ON c.exporter_id = f.exporter_id AND c.file_seq = f.file_seq AND c.field = u.field
  LEFT JOIN typed p ON p.exporter_id = f.exporter_id AND p.file_seq = f.prev AND p.field = u.field
  WHERE f.prev IS NOT NULL)
"""

# What most values of each field of flow_exports convert to, at every scale.
_P4_TYPES = dict.fromkeys(
    ("bwd_bytes", "bwd_packets", "captured_at", "dst_port", "duration", "fwd_bytes", "fwd_packets", "fwd_pkt_len_max", "init_fwd_win_bytes", "protocol", "src_port"), "integer"
) | dict.fromkeys(("flow_iat_mean", "flow_iat_std", "rate"), "decimal") | {"encrypted": "boolean", "dataset_name": "text", "label_fine": "text", "service": "text"}
_P4_COLUMNS = {"integer": "i", "decimal": "d", "boolean": "b", "text": "v"}
_P4_TABLE = """
tokens AS (
  SELECT export_row_id, k AS name, json_type(payload, '$."' || k || '"') AS t, json_extract(payload, '$."' || k || '"')::VARCHAR AS raw, json_extract_string(payload, '$."' || k || '"') AS s
  FROM (SELECT export_row_id, payload, unnest(json_keys(payload)) AS k FROM flow_exports)),
al AS (SELECT regexp_replace(lower(alias), '[ _.-]', '', 'g') AS a, min(field) AS field FROM field_aliases GROUP BY 1),
valued AS (
  SELECT export_row_id, coalesce(al.field, name) AS field, al.field IS NOT NULL AS known,
         CASE t WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'integer' END AS tag,
         CASE t WHEN 'VARCHAR' THEN s WHEN 'NULL' THEN NULL ELSE raw END AS v
  FROM tokens LEFT JOIN al ON al.a = regexp_replace(lower(name), '[ _.-]', '', 'g')),
conv AS (
  SELECT *, CASE WHEN lower(trim(v)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(v)) IN ('false', '0', 'no') THEN false END AS b,
         try_cast(nullif(regexp_extract(lower(trim(v)), '^(-?[0-9]+)(?:[.]0+)?$', 1), '') AS BIGINT) AS i,
         CASE WHEN regexp_full_match(lower(trim(v)), '-?[0-9]+([.][0-9]+)?(e[+-]?[0-9]+)?') THEN try_cast(lower(trim(v)) AS DOUBLE) END AS d FROM valued),
odd AS (
  SELECT export_row_id, field || '#' || tag AS k, max(v) AS v FROM conv
  WHERE known AND v IS NOT NULL AND CASE %s ELSE false END GROUP BY 1, 2),
rest AS (SELECT export_row_id, field AS k, max(v) AS v FROM conv WHERE NOT known GROUP BY 1, 2),
branched AS (SELECT export_row_id, string_agg(k || '=' || v, '|' ORDER BY k) AS branches FROM odd GROUP BY 1),
others AS (SELECT export_row_id, string_agg(k || '=' || coalesce(v, 'null'), '|' ORDER BY k) AS other FROM rest GROUP BY 1),
columns_ AS (SELECT export_row_id, %s FROM conv GROUP BY 1)
SELECT f.export_row_id, f.exporter_id, f.file_seq, f.file_name, c.* EXCLUDE (export_row_id),
       CASE WHEN f.payload IS NOT NULL THEN coalesce(branches, '') END AS branches, CASE WHEN f.payload IS NOT NULL THEN coalesce(other, '') END AS other
FROM flow_exports f LEFT JOIN columns_ c USING (export_row_id) LEFT JOIN branched USING (export_row_id) LEFT JOIN others USING (export_row_id)
""" % (
    " ".join(f"WHEN field = '{f}' THEN {_P4_COLUMNS[t]} IS NULL" for f, t in _P4_TYPES.items() if t != "text"),
    ", ".join(f"max({_P4_COLUMNS[t]}) FILTER (field = '{f}') AS {f}" for f, t in _P4_TYPES.items()),
)

SQL = {
    "p4_table": f"WITH {_P4_TABLE}",
    "p1_found": f"WITH {_P1} SELECT delivery_id FROM ranked WHERE rn > 1",
    "p1_ranges": rf"""WITH {_P1},
parsed AS (SELECT regexp_extract(lower(trim(id)), '^(.*[^0-9a-z])(0|[1-9][0-9]{{0,17}})$', 1) AS producer,
                  CAST(nullif(regexp_extract(lower(trim(id)), '^(.*[^0-9a-z])(0|[1-9][0-9]{{0,17}})$', 2), '') AS BIGINT) AS n FROM ranked
           WHERE rn = 1 AND NOT regexp_full_match(lower(trim(id)), '(?:.*[^0-9a-z])?[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}')),
isl AS (SELECT producer, n, n - row_number() OVER (PARTITION BY producer ORDER BY n) AS g FROM parsed WHERE n IS NOT NULL)
SELECT producer, min(n) AS lo, max(n) AS hi FROM isl GROUP BY producer, g""",
    "p1_messages": f"""WITH {_P1} SELECT delivery_id, id, chat_id, sender, text, "timestamp", received_at, status FROM messages
WHERE delivery_id NOT IN (SELECT delivery_id FROM ranked WHERE rn > 1)""",
    "p2_found": f"WITH {_P2} SELECT line_id, reason FROM verdict WHERE reason IS NOT NULL",
    "p2_loaded": f"WITH {_P2} SELECT line_id, {_P2_COLUMNS} FROM verdict WHERE reason IS NULL",
    "p4_found": f"""WITH {_P4}
SELECT file_name, field, 'added' AS change FROM both_sides WHERE pn IS NULL
UNION ALL SELECT file_name, field, 'removed' FROM both_sides WHERE cn IS NULL
UNION ALL SELECT file_name, field, 'renamed' FROM both_sides WHERE cn <> pn
UNION ALL SELECT file_name, field, 'retyped' FROM both_sides WHERE ct <> pt""",
    "p4_alternatives": f"""WITH {_P4},
alternatives AS (
  SELECT exporter_id, file_seq, field, list_filter(['boolean', 'integer', 'decimal', 'text'], lambda x, i: [is_boolean, is_integer, is_decimal, is_text][i]) AS a FROM typed),
sides AS (
  SELECT f.file_name, c.field, c.a AS now, p.a AS prior FROM files f JOIN alternatives c ON c.exporter_id = f.exporter_id AND c.file_seq = f.file_seq
  JOIN alternatives p ON p.exporter_id = f.exporter_id AND p.file_seq = f.prev AND p.field = c.field)
SELECT file_name, field, unnest(list_filter(now, lambda x: NOT list_contains(prior, x))) AS alternative, 'appeared' AS change FROM sides
UNION ALL SELECT file_name, field, unnest(list_filter(prior, lambda x: NOT list_contains(now, x))), 'vanished' FROM sides""",
    "p4_fields": f"""WITH {_P4},
n AS (SELECT field, unnest(names) AS name FROM typed),
t AS (SELECT field, count(*) AS files, bool_or(is_text) AS x, bool_or(is_decimal) AS d, bool_or(is_integer) AS i, bool_or(is_boolean) AS b FROM typed GROUP BY 1)
SELECT t.field, t.files, (SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM n WHERE n.field = t.field) AS names,
       concat_ws('|', CASE WHEN b THEN 'boolean' END, CASE WHEN i THEN 'integer' END, CASE WHEN d THEN 'decimal' END, CASE WHEN x THEN 'text' END) AS alternatives,
       CASE WHEN x THEN 'text' WHEN d THEN 'decimal' WHEN i THEN 'integer' WHEN b THEN 'boolean' END AS canonical_type
FROM t""",
}
