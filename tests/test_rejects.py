"""Report lines: every kind of fault, and the values of valid lines."""

import pytest

from tidemark.operators.rejects import load_lines

GOOD = '7,2024-02-29 08:00:00,coastcam,1,2,3,4,"a ""b"", c",x'
CASES = [
    (GOOD, None),
    ('7,2024-02-29 08:00:00, coastcam ,"1",,3 ,4,"line one\nline two",', None),
    ('0007,2024-02-29 08:00:00,coastcam,2147483647,,,,,', None),
    ('7,2024-02-29 08:00:00,coastcam,1,2,3,4,"open,x', "quoting"),
    ('7,2024-02-29 08:00:00,coastcam,1,2,3,4,"a" b,x', "quoting"),
    ('7,2024-02-29 08:00:00,coastcam,1,2,3,4,a 12" mast,x', "quoting"),
    ('7,2024-02-29 08:00:00,coastcam,1,2,3,4,, "a"', "quoting"),
    ('7,"', "quoting"),
    ("7,2024-02-29 08:00:00,coastcam,1,2,3,4,a", "columns"),
    ("7,2024-02-29 08:00:00,coastcam,1,2,3,4,a,b,c", "columns"),
    ("", "columns"),
    (None, "columns"),
    (",2024-02-29 08:00:00,coastcam,1,2,3,4,,", "value"),
    ("2147483648,2024-02-29 08:00:00,coastcam,1,2,3,4,,", "value"),
    ("99999999999999999999999,2024-02-29 08:00:00,coastcam,1,2,3,4,,", "value"),
    ("7,2023-02-29 08:00:00,coastcam,1,2,3,4,,", "value"),
    ("7,2024-02-29 24:00:00,coastcam,1,2,3,4,,", "value"),
    ("7,2024-02-29T08:00:00,coastcam,1,2,3,4,,", "value"),
    ("7,2024-02-29 08:00:00,Coastcam,1,2,3,4,,", "value"),
    ("7,2024-02-29 08:00:00,coastcam,+1,2,3,4,,", "value"),
    ("7,2024-02-29 08:00:00,coastcam,１２,2,3,4,,", "value"),
    ("7,2024-02-29 08:00:00,coastcam,1,2,3,4.0,,", "value"),
    ("7,2024-02-29 08:00:00,coastcam,1,2,3,4,\x01s,\x01", None),
]


@pytest.fixture(scope="module")
def loaded(spark):
    rows = [(i, line, "extra", i) for i, (line, _) in enumerate(CASES)]
    lines = spark.createDataFrame(rows * 2, "line_id bigint, raw_line string, line string, at int")
    return load_lines(lines, spark.createDataFrame([("coastcam",), ("coastcam",), (None,)], "dataset string"))


def test_reasons(loaded):
    found = [(r.line_id, r.reason) for r in loaded[1].collect()]
    assert sorted(found) == [(i, reason) for i, (_, reason) in enumerate(CASES) if reason]


def test_values(loaded):
    clean = {r.line_id: r for r in loaded[0].collect()}
    assert sorted(clean) == [i for i, (_, reason) in enumerate(CASES) if reason is None]
    assert clean[0].skipped_files == 'a "b", c' and clean[0].errors == "x"
    assert clean[1].skipped_files == "line one\nline two" and clean[1].images_converted == "1" and clean[1].images_skipped is None
    last = clean[len(CASES) - 1]
    assert (last.skipped_files, last.errors) == ("\x01s", "\x01")


def test_faulty_columns(loaded):
    assert {tuple(r.columns) for r in loaded[1].where("line_id = 18").collect()} == {("dataset",)}


def test_long_and_empty(spark):
    member = spark.createDataFrame([("coastcam",)], "dataset string")
    long = '7,2024-02-29 08:00:00,coastcam,1,2,3,4,"' + 'a ""b"", ' * 100_000 + '",x'
    clean, bad = load_lines(spark.createDataFrame([(1, long), (None, long)], "line_id bigint, raw_line string"), member)
    assert bad.count() == 0 and clean.count() == 2
    clean, bad = load_lines(spark.createDataFrame([], "line_id bigint, raw_line string"), member)
    assert clean.count() == 0 and bad.count() == 0
