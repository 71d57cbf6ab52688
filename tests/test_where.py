import itertools
import json

import pytest
from pyspark.sql import functions as F

from feedloom.plans.where import WhereError, parse, where

VALID = ["status = 'a'", "a.b != 5", "NOT (x > 1 AND y <= 2) OR z IN (1, 'b', NULL)", "x IS NULL", "x is not null", "x = TRUE", "", "  "]
INVALID = ["before.x = after", "x BETWEEN 1 AND 2", "x LIKE 'a%'", "CASE WHEN 1", "SELECT 1", "x =", "= 1", "(x = 1", "x = 1 y", "x IN ()", "x = 1.2.3", "x ~ 1", "x IS 5", "AND x = 1"]


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    parse(text)


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    with pytest.raises(WhereError):
        parse(text)


#: (expression, before, after, expected)
CASES = [
    ("status != 'cancelled'", None, {"status": "active"}, True),
    ("status != 'cancelled'", None, {"status": "cancelled"}, False),
    ("status != 'cancelled'", None, {}, True),
    ("status = NULL", None, {"status": None}, True),
    ("status = NULL", None, {"status": ""}, True),
    ("x IS NULL", None, {"x": None}, True),
    ("x IS NULL", None, {}, True),
    ("x IS NOT NULL", None, {"x": 0}, True),
    ("before.x IS NULL", None, {"x": 1}, True),
    ("before.x = 1", None, {"x": 1}, False),
    ("NOT before.x = 1", None, {"x": 1}, True),
    ("before.x != 1", None, {"x": 1}, False),
    ("x > 9", None, {"x": "10"}, True),
    ("x > '9'", None, {"x": "10"}, True),
    ("x > 9", None, {"x": "abc"}, True),
    ("x > 9", None, {"x": " 10"}, False),
    ("x = 5", None, {"x": "5d"}, False),
    ("x = 5", None, {"x": 5.0}, True),
    ("x = '5'", None, {"x": 5}, True),
    ("x = TRUE", None, {"x": True}, True),
    ("x = 'true'", None, {"x": True}, True),
    ("x IN ('a', NULL)", None, {}, True),
    ("x IN (1, 2)", None, {"x": "2.0"}, True),
    ("a.b = 1", None, {"a.b": 1, "a": {"b": 2}}, True),
    ("a.b = 2", None, {"a": {"b": 2}}, False),
    ("x = 1", {"x": 1}, None, True),
    ("x = 1", {"x": 1}, {"x": 2}, False),
    ("x = 1", None, None, True),
    ("x = 'nan'", None, {"x": "NaN"}, False),
    ("x != 'nan'", None, {"x": "NaN"}, True),
    ("x = 'q'", None, {"x": 5.0}, False),
    ("x < 'a'", None, {"x": 5.0}, True),
    ("a = 1 OR b = 2 AND c = 3", None, {"a": 1}, True),
    ("(a = 1 OR b = 2) AND c = 3", None, {"a": 1}, False),
]


def test_cases(spark):
    dump = lambda d: None if d is None else json.dumps(d)
    for expression, group in itertools.groupby(sorted(CASES, key=lambda c: c[0]), key=lambda c: c[0]):
        group = list(group)
        df = spark.createDataFrame([(i, dump(c[1]), dump(c[2])) for i, c in enumerate(group)], "i int, before string, after string")
        got = {r["i"]: r["m"] for r in df.select("i", where(expression).alias("m")).collect()}
        for i, c in enumerate(group):
            assert got[i] is c[3], c
