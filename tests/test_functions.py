"""Literal cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from parity.functions import dates as D
from parity.functions import nested as N
from parity.functions import numbers as M
from parity.functions import text as X


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).collect()[0]["x"]


DAY = 86_400_000_000


@pytest.mark.parametrize(
    ("text", "mode", "want"),
    [
        ("@ 1 year 2 months -3 days 4 hours 5 minutes 6 seconds ago", "VERBOSE", (-14, 3 * DAY - (4 * 3600 + 5 * 60 + 6) * 10**6)),
        ("1-2 3 4:05:06", "STANDARD", (14, 3 * DAY + (4 * 3600 + 5 * 60 + 6) * 10**6)),
        ("-1-2", "STANDARD", (-14, 0)),
        ("4:05", "STANDARD", (0, (4 * 3600 + 5 * 60) * 10**6)),
        ("P1Y2M3DT4H5M6S", "ISO", (14, 3 * DAY + (4 * 3600 + 5 * 60 + 6) * 10**6)),
        ("PT5M", "ISO", (0, 300 * 10**6)),
        ("nonsense", "VERBOSE", None),
        ("nonsense", "ISO", None),
        ("nonsense", "STANDARD", None),
    ],
)
def test_interval_texts(spark, text, mode, want):
    got = value(spark, text, lambda c: D.parse_interval_text(c, mode))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("text", "unit", "want"),
    [("2", "WEEK", (0, 14 * DAY)), ("3", "QUARTER", (9, 0)), ("5", "MICROSECOND", (0, 5)), ("-1 2:03:04", "DAY TO SECOND", (0, -(DAY + 7384 * 10**6))), ("2:03", "DAY_SECOND", (0, 123 * 10**6)), ("2-3", "YEAR_MONTH", (27, 0)), ("x", "DAY", None)],
)
def test_unit_intervals(spark, text, unit, want):
    got = value(spark, text, lambda c: D.parse_unit_interval(c, unit))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("text", "fmt", "want"),
    [("Jan 05, 2020", "Mon DD, YYYY", "2020-01-05"), ("05-JAN-49", "DD-MON-RR", "2049-01-05"), ("05-JAN-50", "DD-MON-RR", "1950-01-05"), ("01/02/2020", "MM/DD/YYYY", "2020-01-02"), ("01/02/2020", "DD/MM/YYYY", "2020-02-01"), ("bad", "DD/MM/YYYY", None)],
)
def test_dates(spark, text, fmt, want):
    assert value(spark, text, lambda c: D.parse_date_multi(c, fmt).cast("date").cast("string")) == want


def test_formats():
    assert D.date_format_to_spark("DD MONTH YYYY") == "dd MMMM yyyy"
    assert D.date_format_to_spark("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    with pytest.raises(ValueError):
        D.date_format_to_spark("DD-MON-RR", allow_rr=False)


@pytest.mark.parametrize(("text", "want"), [("26:00:00", 93600), ("-1:00:01", -3601), ("x", None)])
def test_time_texts(spark, text, want):
    assert value(spark, text, D.time_text_to_seconds) == want


@pytest.mark.parametrize(("text", "style", "want"), [("-1,234.5", "point", -1234.5), ("-1.234,5", "comma", -1234.5), ("1.2.3", "point", None)])
def test_locale_numbers(spark, text, style, want):
    assert value(spark, text, lambda c: M.parse_locale_number(c, style)) == want


def test_quoting(spark):
    assert value(spark, "a,'b,c',,\"d,e\"", X.quote_aware_split) == ["a", "'b,c'", '"d,e"']
    assert value(spark, "it's, b", X.quote_aware_split) == ["it's, b"]
    assert value(spark, "a,\\'b,c", X.quote_aware_split) == ["a", "\\'b", "c"]
    assert value(spark, "f(`a,b`, c)", X.call_arguments) == ["`a,b`", "c"]
    assert value(spark, "x" * 5000, lambda c: X.render_literal(c, "VARCHAR", "pg")) == "'" + "x" * 5000 + "'"
    assert value(spark, "x" * 5000, lambda c: X.render_literal(c, "VARCHAR", "pg", longest=4000)) == "NULL"
    assert value(spark, "f(a, g(b, c), 'x)y')", X.call_arguments) == ["a", "g(b, c)", "'x)y'"]
    assert value(spark, "f()", X.call_arguments) == []
    assert value(spark, "no call", X.call_arguments) is None
    assert value(spark, "Q'!it's!'", X.qstring) == "'it''s'"
    assert value(spark, "q'[a]'", X.qstring) == "'a'"
    assert value(spark, "plain", X.qstring) is None
    assert value(spark, "a\\\\nb\\n", X.unescape) == "a\\nb\n"
    assert value(spark, "my col", lambda c: X.quote_ident(c, "mysql")) == "`my col`"
    assert value(spark, "order", lambda c: X.quote_ident(c, "pg", ["ORDER"])) == '"order"'
    assert value(spark, "[My Col]", lambda c: X.requote_ident(c, "pg")) == '"my col"'
    assert value(spark, "xyxyaxy", lambda c: X.trim_set(c, "xy")) == "a"


def test_literals(spark):
    assert value(spark, "it's", lambda c: X.render_literal(c, "VARCHAR", "pg")) == "'it''s'"
    assert value(spark, None, lambda c: X.render_literal(c, "VARCHAR", "pg")) == "NULL"
    assert value(spark, "x" * 4001, lambda c: X.render_literal(c, "VARCHAR", "pg", 4000)) == "NULL"


def test_frozen_clock(spark):
    assert value(spark, "SELECT NOW(), curdate()", lambda c: X.freeze_now(c, "mysql")) == "SELECT TIMESTAMP '2000-01-02 00:30:26', DATE '2000-01-02'"


def test_fenced_json(spark):
    assert value(spark, '```json\n{"a": 1}\n```', lambda c: X.fence_json(c, "a int")["a"]) == 1
    assert value(spark, "no json", lambda c: X.fence_json(c, "a int")) is None


def test_xml_count_takes_wrapped_paths(spark):
    assert value(spark, "<a><b/><b/></a>", lambda c: N.xml_count(c, "count( /a/b )")) == 2
