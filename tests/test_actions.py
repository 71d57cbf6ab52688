import datetime as dt
import hashlib
import hmac
import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom import sinks
from feedloom.functions import keys, signing
from feedloom.functions import sql as sql_functions
from feedloom.operators import actions, eventlog, vector
from feedloom.plans.render import rendered, transform
from feedloom.plans.templates import TemplateError
from feedloom.plans.where import branches
from feedloom.streaming import subscriptions

EVENT = {"table": "orders", "operation": "insert", "schema": "s", "database": None, "source": "x", "key": '{"a":"1"}', "id": "I", "idempotency_key": "K", "before": None, "after": '{"n":5,"name":"a<b>&\\"c\'","z":0,"e":""}'}


@pytest.fixture(scope="module")
def event(spark):
    return spark.createDataFrame([EVENT], "table string, operation string, schema string, database string, source string, key string, id string, idempotency_key string, before string, after string")


CASES = [
    ("a {{ .Table }}!", "a orders!"),
    ("a {{- .Table -}} !", "aorders!"),
    ("{{/* no */}}x", "x"),
    ("{{if eq .Operation `insert`}}A{{else}}B{{end}}", "A"),
    ('{{if ne .Operation "insert"}}A{{else if gt .After.n 4}}C{{else}}B{{end}}', "C"),
    ("{{if .Database}}A{{end}}", ""),
    ("{{if .After.e}}A{{else}}B{{end}}", "B"),
    ("{{if not .After.missing}}A{{end}}", "A"),
    ("{{if and .Table (lt .After.n 6)}}A{{end}}", "A"),
    ("{{if lt .Table 6}}A{{else}}B{{end}}", "B"),
    ('{{if or (eq .Table "x") (eq .Table "y" "orders")}}A{{end}}', "A"),
    ('{{or .Database "none"}}', "none"),
    ("{{len .Table}}", "6"),
    ('{{index .After "n"}}', "5"),
    ('{{printf "%s-%v|%q|%d%%" .Table 1.5 .Key .After.n}}', 'orders-1.5|"{\\"a\\":\\"1\\"}"|5%'),
    ('{{printf "%05d %8s|%-8s|%.2f" 42 .Table .Table 1.005}}', "00042   orders|orders  |1.01"),
    ('{{"a b&c*~" | urlquery}}', "a+b%26c%2A~"),
    ("{{.After.name | html}}", "a&lt;b&gt;&amp;&#34;c&#39;"),
    ('{{print 1 2 "x" 3}}', "1 2x3"),
    ("{{if true}}{{if false}}A{{else}}B{{end}}{{end}}", "B"),
    ('{{"}}"}}', "}}"),
]


@pytest.mark.parametrize("text, want", CASES)
def test_render(event, text, want):
    assert event.select(rendered(text)).first()[0] == want


def test_blank_output_drops(event):
    assert event.select(transform(" {{if .Database}}A{{end}}\n")).first()[0] is None


@pytest.mark.parametrize("text", ["{{.Nope}}", "{{if .Table}}", "{{end}}", "{{else}}", "{{range .After}}{{end}}", "{{", "{{foo 1}}", '{{printf "%s"}}', '{{printf "%s" 1 2}}', "{{.Table | .Schema}}", "{{(len .Table}}", "{{eq true 1}}", "{{}}"])
def test_render_rejects(text, event):
    with pytest.raises(TemplateError):
        rendered(text)


def test_known_signature(spark):
    """A published example of the signature: an empty GET."""
    now = dt.datetime(2015, 8, 30, 12, 36)
    one = spark.range(1)
    c = signing.sigv4_headers("https://example.amazonaws.com/", F.lit(""), "us-east-1", "service", "AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", now, "GET")
    got = one.select(c.alias("h")).first()["h"]
    assert got["Authorization"].endswith("SignedHeaders=host;x-amz-date, Signature=5fa00fa31553b73ebf1942676e86291e8372ff2a2260956d9b8aae1d763fbf31")


def test_hmac(spark):
    texts = ["", "a", "é" * 100, "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"k", b"y" * 64, b"z" * 100):
        got = [r[0] for r in rows.select(signing.hmac_sha256(key, F.col("t"))).collect()]
        assert got == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    got = rows.select(keys.signature("s", F.lit(5), F.col("t"))).first()[0]
    assert got == "t=5,v1=" + hmac.new(b"s", b"5.", hashlib.sha256).hexdigest()


def test_signed_delivery(spark):
    d = actions.compiled("a", "lambda", {"url": "https://h/x", "region": "r"})
    rows = spark.createDataFrame([("[1]", "k1,k2")], "body string, keys string")
    got = sinks.request_headers(rows, d, dt.datetime(2026, 1, 1), "id", "secret", "tok").first()["headers"]
    assert got["Idempotency-Key"] == "k1,k2" and got["X-Amz-Security-Token"] == "tok" and got["X-Amz-Invocation-Type"] == "Event"
    assert "SignedHeaders=host;x-amz-date;x-amz-invocation-type;x-amz-security-token," in got["Authorization"]
    with pytest.raises(actions.ActionError):
        sinks.request_headers(rows, d, dt.datetime(2026, 1, 1))
    plain = actions.compiled("b", "http-request", {"url": "https://h"})
    assert sinks.request_headers(rows, plain, dt.datetime(2026, 1, 1)).first()["headers"] == {"Content-Type": "application/json", "Idempotency-Key": "k1,k2"}


def test_nudges(spark):
    times = {"a": [0, 50, 99, 100, 199, 350, 350], "b": [7], None: [1, 2]}
    rows = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts] + [("a", None)], "subscription string, ms long")
    got = sorted((str(r[0]), r[1]) for r in subscriptions.nudges(rows).collect())
    assert got == [("None", 101), ("a", 100), ("a", 200), ("a", 450), ("b", 107)]
    assert subscriptions.nudges(rows.limit(0)).count() == 0


def test_hash_cache(spark, tmp_path):
    schema = "vector_id string, text_hash string, operation string, decision string, seq long"
    sent, path = [], str(tmp_path / "cache")
    fail = itertools.count()

    def store(df):
        sent.append(sorted((r["vector_id"], r["decision"]) for r in df.collect()))
        if next(fail) == 1:
            raise RuntimeError("down")

    run = vector.cached_sender(store, path)
    first = spark.createDataFrame([("a", "1", "insert", "upsert", 1), ("b", "2", "insert", "upsert", 2), ("c", "3", "insert", "upsert", 3)], schema)
    run(first, 0)
    second = spark.createDataFrame([("a", "1", "update", "upsert", 4), ("b", "9", "update", "upsert", 5), ("c", None, "delete", "delete", 6), ("d", "4", "insert", "upsert", 7)], schema)
    with pytest.raises(RuntimeError):
        run(second, 1)
    run(second, 1)  # nothing was remembered, so all of it goes again
    run(second, 2)
    change = [("b", "upsert"), ("c", "delete"), ("d", "upsert")]
    assert sent == [[("a", "upsert"), ("b", "upsert"), ("c", "upsert")], change, change, [("c", "delete")]]
    got = {r[0]: r[1] for r in spark.read.parquet(f"{path}/2").collect()}
    assert got == {"a": "1", "b": "9", "d": "4"}


def test_dead_letter_branch(spark):
    rows = spark.createDataFrame([(1, None, '{"a":1}'), (2, None, '{"a":'), (3, "[1]", '{"a":1}'), (4, None, None), (5, None, "null"), (6, None, '{"a":2}')], "i int, before string, after string")
    good, dead = branches(rows, "a = 1")
    assert sorted(r["i"] for r in good.collect()) == [1, 4, 5] and sorted(r["i"] for r in dead.collect()) == [2, 3]


def test_user_functions(spark):
    def plus(x: pd.Series) -> pd.Series:
        return x + 1

    def total(x: pd.Series) -> float:
        return float(x.sum())

    class Twice:
        def eval(self, n: int):
            yield (n,)
            yield (n,)

    assert "loom_lsn" in sql_functions.register(spark)
    sql_functions.register_user(spark, "plus_one", plus, "long")
    sql_functions.register_user(spark, "total_of", total, "double", "aggregate")
    sql_functions.register_user(spark, "twice", Twice, "n long", "table")
    assert spark.sql("select plus_one(id) from range(3) order by 1").collect()[0][0] == 1
    assert spark.sql("select total_of(id) from range(3)").first()[0] == 3.0
    assert spark.sql("select count(*) from twice(4)").first()[0] == 2
    with pytest.raises(ValueError):
        sql_functions.register_user(spark, "loom_lsn", plus, "long")


@pytest.mark.parametrize("ranges", [1, 5])
def test_one_stream(spark, ranges):
    """Numbers go on after the log's, whatever the number of ranges; duplicates of either are acknowledged as 0."""
    rows = spark.createDataFrame([(i, f"k{i % 70}", f"key{i % 9}") for i in range(100)], "arrival long, idempotency_key string, key string")
    first = eventlog.append_stream(rows.where("arrival < 50"), ranges=ranges)
    assert [r["seq"] for r in first.orderBy("arrival").collect()] == list(range(1, 51))
    later = rows.where("arrival >= 50")
    new = eventlog.append_stream(later, first, ranges=ranges)
    got = {r["arrival"]: r["seq"] for r in eventlog.acknowledged(later, new).collect()}
    assert got == {i: i + 1 if i < 70 else 0 for i in range(50, 100)}
    assert eventlog.append_stream(later, rows.where("arrival >= 0").withColumn("seq", rows["arrival"]), ranges=1).count() == 0
