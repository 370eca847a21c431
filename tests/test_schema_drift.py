"""Schemas that drift between files."""

from __future__ import annotations

from sentrymill.operators.schema_drift import DriftingFiles

ROWS = "export_row_id long, exporter_id string, file_seq int, file_name string, payload string"


def drift(spark, rows, aliases=(("bytes out", "fwd_bytes"), ("fwd_bytes", "fwd_bytes"), ("dport", "dst_port"))):
    return DriftingFiles(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROWS), spark.createDataFrame(list(aliases), "alias string, field string"))


def changes(spark, rows):
    return {tuple(r) for r in drift(spark, rows).changes().collect()}


def test_each_kind_of_change(spark):
    rows = [
        ("e", 0, "f0", '{"fwd_bytes": 1, "dport": 80, "x": true, "gone": "a"}'),
        ("e", 1, "f1", '{"Bytes-Out": 1.0, "dport": 81, "x": "true", "new": null}'),
        ("e", 2, "f2", '{"Bytes-Out": 2e3, "dport": null, "x": "y", "new": 5}'),
        ("o", 0, "g0", '{"only": 1}'),
    ]
    assert changes(spark, rows) == {
        ("f1", "fwd_bytes", "renamed"),
        ("f1", "fwd_bytes", "retyped"),
        ("f1", "x", "retyped"),
        ("f1", "gone", "removed"),
        ("f1", "new", "added"),
    }


def test_types_follow_all_rows_of_a_file_and_its_spelling(spark):
    rows = [("e", 0, "f0", '{"a": 1}'), ("e", 0, "f0", '{"a": 2.0}'), ("e", 0, "f0", '{"a": null}'), ("e", 1, "f1", '{"a": 1E2}'), ("e", 2, "f2", '{"a": 1}'), ("e", 3, "f3", '{"a": false}')]
    d = drift(spark, rows)
    assert {(r.number, r.type) for r in d.file_schemas().collect()} == {(0, "decimal"), (1, "decimal"), (2, "integer"), (3, "boolean")}
    assert changes(spark, rows) == {("f2", "a", "retyped"), ("f3", "a", "retyped")}


def test_files_sent_twice_late_or_after_a_gap(spark):
    rows = [("e", 5, "f5", '{"a": 1}'), ("e", 2, "f2", '{"a": 1, "b": 1}'), ("e", 2, "f2", '{"a": 1, "b": 1}'), ("e", 5, "f5", '{"a": 1}')]
    assert changes(spark, rows) == {("f5", "b", "removed")}


def test_odd_payloads_keys_and_tables(spark):
    rows = [
        ("e", 0, "f0", None),
        ("e", 1, "f1", "not json"),
        ("e", 2, "f2", "{}"),
        ("e", 3, "f3", r'{"a\"b": "x,y:{}\"", "c" : "\\", "dport":"5"}'),
        (None, None, None, '{"z": 1}'),
        ("e", 4, "f4", r'{"a\"b": 1, "c": 2, "dport": "' + "9" * 100_000 + '"}'),
    ]
    assert changes(spark, rows) == {
        ("f3", 'a"b', "added"), ("f3", "c", "added"), ("f3", "dst_port", "added"), ("f4", 'a"b', "retyped"), ("f4", "c", "retyped"),
    }
    assert changes(spark, []) == set()


def test_unknown_names_are_their_own_fields(spark):
    rows = [("e", 0, "f0", '{"My Field": 1, "D-Port": 1}'), ("e", 1, "f1", '{"my_field": 1, "dPort": 1}')]
    assert changes(spark, rows) == {("f1", "My Field", "removed"), ("f1", "my_field", "added"), ("f1", "dst_port", "renamed")}


def test_unified_table_keeps_what_does_not_fit(spark):
    rows = [("e", 0, "f0", '{"fwd_bytes": "7", "dport": "https", "note": "n"}'), ("e", 0, "f0", '{"bytes_out": 8.0, "dport": 53}'), ("e", 1, "f1", None)]
    out = drift(spark, rows).unified({"fwd_bytes": "integer", "dst_port": "integer"}).orderBy("export_row_id").collect()
    assert [(r.fwd_bytes, r.dst_port) for r in out] == [(7, None), (8, 53), (None, None)]
    assert out[0].branches == {"dst_port#text": "https"} and out[0].other == {"note": "n"}
    assert out[1].branches == {} and out[2].branches is None


def test_fused_lists_names_and_alternatives(spark):
    rows = [("e", 0, "f0", '{"dport": 1}'), ("o", 0, "g0", '{"DPORT": "x"}')]
    (r,) = drift(spark, rows).fused().collect()
    assert (r.field, r.files, r.names, r.alternatives, r.canonical_type) == ("dst_port", 2, ["DPORT", "dport"], ["integer", "text"], "text")


def test_types_are_what_most_values_convert_to(spark, tmp_path):
    from sentrymill.plans.intake import p4_table

    rows = [("e", 0, "f0", p) for p in ['{"fwd_bytes": 1, "dport": 53, "on": true, "mean": 1.5, "who": "a", "flag": 0}'] * 3]
    rows += [("e", 1, "f1", '{"bytes out": "7", "dport": 53.0, "on": "yes", "mean": "2.5", "who": 4, "flag": 1}'), ("e", 1, "f1", '{"fwd_bytes": "n/a", "dport": "https", "on": 0, "mean": 3, "who": "b", "flag": null}'), ("e", 2, "f2", '{"fwd_bytes": 8.5, "none": null}')]
    aliases = [("bytes out", "fwd_bytes"), ("dport", "dst_port"), *((f, f) for f in ("fwd_bytes", "on", "mean", "who", "flag", "none"))]
    d = drift(spark, rows, aliases)
    assert {tuple(r) for r in d.converting_types().collect()} == {("fwd_bytes", "integer"), ("dst_port", "integer"), ("on", "boolean"), ("mean", "decimal"), ("who", "text"), ("flag", "integer")}
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROWS).write.parquet(f"{tmp_path}/flow_exports.parquet")
    spark.createDataFrame(aliases, "alias string, field string").write.parquet(f"{tmp_path}/field_aliases.parquet")
    out = p4_table(spark, str(tmp_path)).orderBy("export_row_id").collect()
    assert [r.fwd_bytes for r in out] == [1, 1, 1, 7, None, None] and [r.dst_port for r in out] == [53, 53, 53, 53, None, None]
    assert [r.on for r in out] == [True, True, True, True, False, None] and [r.mean for r in out] == [1.5, 1.5, 1.5, 2.5, 3.0, None]
    assert out[3].who == "4" and [r.branches for r in out[3:]] == ["", "dst_port#text=https|fwd_bytes#text=n/a", "fwd_bytes#decimal=8.5"]


def test_files_of_a_null_series_count(spark):
    rows = [("e", 0, "f0", '{"dport": 1}'), (None, 0, "g0", '{"dport": 1}'), (None, 1, "g1", '{"dport": 1}'), (None, None, None, '{"dport": 1}')]
    (r,) = drift(spark, rows).fused().collect()
    assert r.files == 4


def test_alternatives_that_appear_or_vanish_are_reported_though_the_type_stays(spark):
    rows = [("e", 0, "f0", '{"a": "x", "b": 1}'), ("e", 1, "f1", '{"a": "x", "b": 1.5}'), ("e", 1, "f1", '{"a": 4, "new": 1}'), ("e", 2, "f2", '{"a": "y"}')]
    got = {tuple(r) for r in drift(spark, rows).alternative_changes().collect()}
    assert got == {("f1", "a", "integer", "appeared"), ("f1", "b", "decimal", "appeared"), ("f1", "b", "integer", "vanished"), ("f2", "a", "integer", "vanished")}
    assert ("f1", "a", "retyped") not in changes(spark, rows)


def test_rows_of_the_table_stay_in_place(spark):
    out = drift(spark, [("e", 0, "f0", '{"dport": 1, "DPORT": 7, "k": 1, "k": 2, "z": null}'), ("e", 0, "f0", "[]")]).unified({"dst_port": "integer"})
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    first, second = out.orderBy("export_row_id").collect()
    assert first.dst_port == 7 and first.other == {"k": "2", "z": None} and second.dst_port is None and second.other is None


def test_no_aliases_and_no_rows(spark):
    d = drift(spark, [("e", 0, "f0", '{"a": 1}')], [])
    (r,) = d.unified({}).collect()
    assert r.other == {"a": "1"} and r.branches == {} and d.converting_types().count() == 0
    assert drift(spark, []).unified({"dst_port": "integer"}).count() == 0 and drift(spark, []).alternative_changes().count() == 0
