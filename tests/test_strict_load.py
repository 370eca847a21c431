"""Rows that fail to parse."""

from __future__ import annotations

import random

from sentrymill.operators.strict_load import StrictLoader

LAYOUT = [(1, "n", "long", False, 0, 99), (2, "d", "double", True, None, None), (3, "name", "text", False, None, None)]


def loader(spark):
    layout = spark.createDataFrame(LAYOUT, "col_no int, column_name string, value_type string, may_be_empty boolean, min_value long, max_value long")
    return StrictLoader(layout, {"name": spark.createDataFrame([("Ann",), ("Bo \"B\"",)], "name string")})


def verdicts(spark, lines, delimiter=","):
    raw = spark.createDataFrame([(i, delimiter, x) for i, x in enumerate(lines)], "line_id long, delimiter string, raw_line string")
    ld = loader(spark)
    bad = {r.line_id: r.reason for r in ld.rejected(raw).collect()}
    good = {r.line_id for r in ld.load(raw).collect()}
    assert good | set(bad) == set(range(len(lines))) and not good & set(bad)
    return [bad.get(i) for i in range(len(lines))]


def test_reasons_in_their_order(spark):
    cases = {
        '1,2.5,Ann': None,
        ' 1 , 2e3 ,ann ': None,
        '"1","","Bo ""B"""': None,
        '1,,Ann': None,
        ',1,Ann': "value",
        '1,1,Bob': "value",
        '1,1,': "value",
        '100,1,Ann': "value",
        '-1,1,Ann': "value",
        '1.0,1,Ann': "value",
        '99999999999999999999,1,Ann': "value",
        '00000000000000000000000007,1,Ann': None,
        '+1,1,Ann': "value",
        '1,.5,Ann': "value",
        '1,-.5,Ann': "value",
        '1,1e5,Ann': None,
        '1,NaN,Ann': "value",
        '1,0x1p3,Ann': "value",
        '１,1,Ann': "value",
        '1,1': "columns",
        '1,1,Ann,': "columns",
        '': "columns",
        None: "columns",
        '1,"1,Ann': "quoting",
        '1,"1"x,Ann': "quoting",
        '1,1"2,Ann': "quoting",
        '1,"1""",Ann': "value",
        '"1,1,Ann': "quoting",
        '1,"a,b","x': "quoting",
        '1,"2,0",Ann': "value",
        ' "1",1,Ann': "quoting",
        '1,1,"Ann" ': "quoting",
        '1,1,Ann\n': "value",
    }
    assert dict(zip(cases, verdicts(spark, list(cases)), strict=True)) == cases


def test_delimiters_with_a_meaning_in_patterns(spark):
    for d in ("|", "\t", ";", "^", ".", "\\", "*", "€"):
        lines = [d.join(("1", "2", "Ann")), d.join(("1", f'"2{d}x"', "Ann")), d.join(("1", "2"))]
        assert verdicts(spark, lines, d) == [None, "value", "columns"], d


def test_null_delimiter_empty_table_and_hot_duplicates(spark):
    raw = spark.createDataFrame([(1, None, "1,2,Ann")], "line_id long, delimiter string, raw_line string")
    assert [tuple(r) for r in loader(spark).rejected(raw).collect()] == [(1, "columns")]
    assert loader(spark).rejected(raw.limit(0)).count() == 0
    many = spark.createDataFrame([(i, ",", "1,1,Ann") for i in range(500)], "line_id long, delimiter string, raw_line string")
    assert loader(spark).load(many).count() == 500


def test_very_long_fields_do_not_overflow(spark):
    quotes = '""' * 60_000
    assert verdicts(spark, [f'1,1,"{quotes}"', f'1,1,"{quotes}', '"' * 100_001, "x" * 200_000]) == ["value", "quoting", "quoting", "columns"]


def test_values_load_typed_and_unquoted(spark):
    raw = spark.createDataFrame([(7, ",", '" 5 ",,"Bo ""B"""')], "line_id long, delimiter string, raw_line string").selectExpr("*", "1 AS n", "2 AS name", "'x' AS file_name")
    assert [tuple(r) for r in loader(spark).load(raw).collect()] == [(7, 5, None, 'Bo "B"')]


def reference_quoting(line, d):
    """Field by field, as the rule reads."""
    i, n = 0, 0
    while True:
        n += 1
        if i < len(line) and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < len(line) and line[i] != d:
                return None
        else:
            j = line.find(d, i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            i = j
        if i >= len(line):
            return n
        i += 1


def test_random_quoting_matches_a_scanner(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('a",') for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    expected = ["quoting" if (n := reference_quoting(x, ",")) is None else "columns" if n != 3 else "value" for x in lines]
    assert verdicts(spark, lines) == expected
