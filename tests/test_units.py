import json
import random
import re

import pytest
from __spark_entry__ import oracle_sql
from pyspark.sql import functions as F

from feedloom.functions import keys as K
from feedloom.functions import scalars
from feedloom.model import CHANGE_EVENT
from feedloom.operators import actions, backfill, delivery, enrich, project, report, vector
from feedloom.plans.jq import JqError, compile_transform, jq, parse
from feedloom.plans.routing import Route, RouteError, glob
from feedloom.plans.templates import TemplateError, template
from feedloom.sources import identifiers, snapshot, streams_text
from feedloom.sources.logical import decoded


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def fnv(data, bits):
    h, prime = {32: (2166136261, 16777619), 64: (0xCBF29CE484222325, 0x100000001B3)}[bits]
    for b in data:
        h = (h ^ b) * prime % (1 << bits)
    return h


def test_fnv(spark):
    texts = ["", "a", '{"id":"1"}', "äöü😀", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.fnv32(F.col("t")).alias("a"), K.fnv64_hex(F.col("t")).alias("b"))
    for r in df.collect():
        assert r["a"] == fnv(r["t"].encode(), 32) and r["b"] == f"{fnv(r['t'].encode(), 64):016x}"


def test_keys(spark):
    import uuid

    lsn = F.lit("0/1A2B3C4")
    got = one(spark, K.lsn_number(lsn), K.lsn_number(F.lit("zz")), K.lsn_text(K.lsn_number(F.lit("A/FF"))), K.uuid5(F.lit("x")), K.qualified(F.lit(""), F.lit("t")), K.cluster_text(F.lit(255), F.lit(1)))
    assert got[0] == 27440068 and got[1] is None and got[2] == "A/FF" and got[3] == str(uuid.uuid5(uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890"), "x")) and got[4] == "t" and got[5] == "000000FF00000001"


def test_identifiers():
    assert identifiers.parse("a.b") == ("a", "b") and identifiers.parse('"we.ird"."x""y"') == ("we.ird", 'x"y') and identifiers.parse("t") == (None, "t")
    for bad in ("", "a.b.c", '"a', "a b", ".a", "1a", 'a"b"'):
        with pytest.raises(identifiers.IdentifierError):
            identifiers.parse(bad)


def test_page_sizes():
    assert snapshot.next_size(5000, 0.5) == 6250 and snapshot.next_size(50_000, 0.1) == 50_000 and snapshot.next_size(150, 9) == 100 and snapshot.next_size(500, 2) == 500
    with pytest.raises(ValueError):
        snapshot.require_keys({"t": []})


def test_routes():
    for bad in ("", "a*b*c"):
        with pytest.raises(RouteError):
            glob(bad, F.lit("x"))
    with pytest.raises(RouteError):
        Route("r", operations=("upsert",)).column()
    with pytest.raises(TemplateError):
        template("{{.Nope}}")
    with pytest.raises(TemplateError):
        template("{{range .}}")


JQ = [
    (".a", '{"a":1}', "1"), (".a.b", '{"a":{"b":"x"}}', '"x"'), ('.["a-b"]', '{"a-b":2}', "2"), (".missing", "{}", None), ("null", "{}", None), ("empty", "{}", None),
    ("{x: .a, a}", '{"a":1}', '{"x":1,"a":1}'), ('if .op == "delete" then null else .v end', '{"op":"delete","v":1}', None), ('if .op == "delete" then null else .v end', '{"op":"x","v":1}', "1"),
    (".a // 7", '{"a":false}', "7"), ('("[" + .op + "] " + (.k | tostring))', '{"op":"i","k":{"id":1}}', '"[i] {\\"id\\":1}"'), (".n + 1", '{"n":12345678901234567890}', "12345678901234567891"),
    ("select(.a > 1) | .a", '{"a":2}', "2"), ("select(.a > 1)", '{"a":1}', None), (".a | ascii_upcase", '{"a":"x"}', '"X"'), ("[.a, 2]", '{"a":1}', "[1,2]"), (".a | length", '{"a":[1,2,3]}', "3"),
    (".a[1]", '{"a":[5,6]}', "6"), ('.a | startswith("x")', '{"a":"xy"}', "true"), (".a and .b", '{"a":1,"b":null}', "false"), ("tojson", '{"a":1}', '"{\\"a\\":1}"'), (".a * 2.5", '{"a":2}', "5"),
]


def test_jq(spark):
    for expression, value, want in JQ:
        assert one(spark, jq(expression, F.lit(value)))[0] == want, expression
    for bad in (".[]", "range(3)", ".a | foo", "{(.a): 1}", "$ENV", "def f: 1; f", '"\\(.a)"', "if . then 1"):
        with pytest.raises(JqError):
            parse(bad)
    with pytest.raises(JqError):
        compile_transform("perl", ".", F.lit("{}"))


def test_projection_and_masks(spark):
    got = one(spark, project.keep_columns(F.lit('{"b":1,"a":2,"c":3}'), ["a", "b", "z"]), project.keep_columns(F.lit("[1]"), ["a"]), project.keep_columns(F.lit("nope{"), ["a"]), project.mask_columns(F.lit('{"b":1,"a":2}'), ["b"]), project.mask_columns(F.lit('{ "a":2}'), ["b"]), project.keep_columns(F.lit('{"a":1}'), []))
    assert list(got) == ['{"a":2,"b":1}', "[1]", "nope{", '{"a":2,"b":"***"}', '{ "a":2}', '{"a":1}']
    with pytest.raises(ValueError):
        project.Access(())


def test_actions():
    d = actions.compiled("chat", "slack", {"webhook-url": "${HOOK}"}, env={"HOOK": "https://x"})
    assert d.url == "https://x" and d.max_batch == 1
    for kind, params, more in (
        ("slack", {"webhook-url": "https://plain"}, {}), ("slack", {}, {}), ("nope", {}, {}), ("slack", {"webhook-url": "${HOOK}", "x": "1"}, {}),
        ("slack", {"webhook-url": "${NOPE}"}, {}), ("slack", {"webhook-url": "${HOOK}"}, {"batch": 5}), ("triggerdev", {"api-key": "${HOOK}"}, {"headers": {"authorization": "x"}}), ("cloudflare-worker", {"url": "u"}, {}),
    ):
        with pytest.raises(actions.ActionError):
            actions.compiled("a", kind, params, env={"HOOK": "h"}, **more)
    with pytest.raises(actions.ActionError):
        actions.compiled("Bad Name", "custom", {"url": "u"})
    assert actions.compiled("l", "lambda", {"url": "u", "region": "r"}).headers == {"X-Amz-Invocation-Type": "Event"}


def test_breaker():
    now = [0.0]
    b = enrich.Breaker(lambda: now[0])
    for _ in range(5):
        assert b.allows()
        b.record(True)
    assert not b.allows()
    now[0] = 6
    assert b.allows() and not b.allows()
    b.record(False)
    assert b.allows()


def test_malformed_messages(spark):
    df = spark.createDataFrame([("s", 1, 0, bytearray(b"I\0\0\0\7N")), ("s", 1, 1, bytearray(b"")), ("s", 1, 2, bytearray(b"T\0"))], "slot string, lsn long, pos long, data binary")
    assert [r["kind"] for r in decoded(df).collect()] == ["error", "error"]


def test_reason_keeps_characters(spark):
    r = one(spark, delivery.reason(F.lit("a" + "é" * 600)))[0]
    assert r == "a" + "é" * 511


def test_attribution_prefers_the_earliest_window(spark):
    w = spark.createDataFrame([("b", 5, 9), ("a", 1, 6)], "scenario string, start int, end int")
    e = spark.createDataFrame([(5, "x"), (10, "x"), (9, "x")], "t int, scenario string")
    assert {r["t"]: r["scenario"] for r in report.attributed(e, w, "t").collect()} == {5: "a", 10: "x", 9: "b"}


def test_metrics_lines(spark):
    lines = spark.createDataFrame([('{"scenario_event":"start","scenario":"s","ts":"2024-01-01T00:00:00Z"}',), ("{oops",), ('{"tool":"t","scenario":"s","receive_ts":"2024-01-01T00:00:02Z","bench_ts":"2024-01-01T00:00:01Z","latency_us":5}',)], "value string")
    events, markers = streams_text.metrics(lines)
    assert events.count() == 1 and markers.first()["event"] == "start"
    assert "| t |" in report.markdown(events, ["tool", "scenario"]) and "<td>t</td>" in report.html(events, ["tool", "scenario"])


def test_embedding_count_is_checked(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="vectors for"):
        vector.embedded(df, lambda t: [[1.0]]).collect()


def test_vector_text(spark):
    """Floats whose shortest digits are settled, tied, on an edge, or rounded at the twelfth decimal, as DuckDB writes them."""
    import duckdb

    rows = [
        (0, [0.1, 5.0, -0.0, -2.5, 1e-13]),
        (1, [0.0185546875, -0.318359375, 2.39453125, 32149.8125]),
        (2, [1398695936.0, 431061216.0, 178287424.0, 2435967.25]),
        (3, [-3.846063464152394e-06, 9.264912478101905e-06, 4289.1435546875, -571929.9375]),
        (4, [1664586743808.0, 2.0962964998954e20]),
        (5, [None, 1.5]),
        (6, []),
        (7, None),
    ]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = df.select("vec_id", vector.vector_text(F.col("embedding")).alias("literal")).orderBy("vec_id")
    assert [tuple(r) for r in got.collect()] == con.sql(f"select * from ({oracle_sql()['x_vector_text']}) order by vec_id").fetchall()
    assert one(spark, vector.vector_text(F.array(F.lit(float("nan")).cast("float"), F.lit(float("-inf")).cast("float")))).c0 == "[NaN,-Inf]"
    assert one(spark, vector.vector_text(F.array(F.lit(0.1), F.lit(2.5)))).c0 == "[0.1,2.5]"


def test_envelope_schema():
    doc = scalars.openapi(CHANGE_EVENT, ["sse", "webhook"])
    assert json.dumps(doc, sort_keys=True) == json.dumps(scalars.openapi(CHANGE_EVENT, ["webhook", "sse"]), sort_keys=True)
    assert doc["components"]["schemas"]["ChangeEvent"]["properties"]["timestamp"]["format"] == "date-time"
    assert not re.search("secret|token", json.dumps(doc))


def test_watermark_equals_a_scan(spark):
    """The join of snapshot and log agrees with a naive scan on random logs."""
    rng = random.Random(42)
    for _ in range(5):
        log = [(rng.choice("ab"), f"k{rng.randrange(12)}", rng.randrange(2000)) for _ in range(60)]
        snap = [(t, f"k{k}", 1000) for t in "ab" for k in range(12)]
        make = lambda rows, p: spark.createDataFrame(rows, f"table string, key string, {p} long").withColumn("schema", F.lit("s"))
        got = {(r["table"], r["key"]) for r in backfill.still_current(make(snap, "snapshot_lsn"), make(log, "lsn")).collect()}
        assert got == {(t, k) for t, k, cut in snap if not any(x == (t, k) and n > cut for *x_, n in log for x in [tuple(x_)])}


def test_interleaved_segments_count_on_their_own(spark):
    import struct

    from feedloom.sources.logical import change_events

    z = lambda s: s.encode() + b"\0"
    relation = b"R" + struct.pack(">I", 7) + z("public") + z("t") + b"d" + struct.pack(">H", 1) + b"\1" + z("id") + struct.pack(">Ii", 23, -1)
    row = lambda xid, v: b"I" + (struct.pack(">I", xid) if xid else b"") + struct.pack(">I", 7) + b"N" + struct.pack(">H", 1) + b"t" + struct.pack(">I", len(v)) + v.encode()
    start = lambda xid, first: b"S" + struct.pack(">IB", xid, first)
    commit = lambda xid, lsn: b"c" + struct.pack(">IBQQq", xid, 0, lsn, 0, 0)
    stop = b"E"
    messages = [relation, start(5, 1), row(5, "a"), row(50, "part"), stop, start(6, 1), row(6, "b"), row(6, "c"), stop, start(5, 0), row(5, "d"), stop, b"A" + struct.pack(">II", 5, 50), start(6, 0), row(6, "e"), stop, commit(5, 500), b"A" + struct.pack(">II", 6, 6), start(8, 1), row(8, "open"), stop]
    messages += [b"B" + struct.pack(">QqI", 600, 0, 9), row(0, "f"), row(0, "f"), b"C"]
    df = spark.createDataFrame([("s", 1, i, bytearray(m)) for i, m in enumerate(messages)], "slot string, lsn long, pos long, data binary")
    got = sorted((json.loads(r["key"])["id"], r["lsn"], r["change_seq"], r["idempotency_key"].rpartition(":insert:")[2]) for r in change_events(decoded(df)).collect())
    assert got == [("a", 500, 0, "0/1F4:0"), ("d", 500, 2, "0/1F4:2"), ("f", 600, 0, "0/258:0"), ("f", 600, 1, "0/258:1")]


def test_poison_is_parked_and_passed_over(spark, tmp_path):
    from feedloom import sinks

    rows = [(1, i, f"k{i}", "insert", "t", "s", "feed", f'{{"id":"{i}"}}', None, '{"v":1}', None) for i in range(12)]
    events = spark.createDataFrame(rows, "partition int, seq long, idempotency_key string, operation string, table string, schema string, source string, key string, before string, after string, timestamp timestamp")
    sent, parked = str(tmp_path / "sent"), str(tmp_path / "parked")

    def write(path, line):
        with open(path, "a") as f:
            f.write(line + "\n")

    def send(url, body, keys, bad=("k3", "k4")):
        if any(k in bad for k in keys.split(",")):
            return 422
        write(sent, keys)
        return 200

    sinks.sender(send, "http://x", ["partition"], 5, park=lambda r: write(parked, f"{r['partition']} {r['seq']} {r['idempotency_key']} {r['reason']}"))(events, 0)
    assert open(sent).read().split() == ["k0", "k1", "k2", "k5,k6,k7,k8,k9", "k10,k11"] and open(parked).read().splitlines() == ["1 3 k3 status 422", "1 4 k4 status 422"]
    for status, park in ((422, None), (503, print)):
        with pytest.raises(Exception, match=f"status {status}"):
            sinks.sender(lambda *a, status=status: status, "http://x", ["partition"], 5, park=park)(events, 0)
    many = spark.range(40).selectExpr("1 as partition", "id as seq", "concat('k', id) as idempotency_key", "'insert' as operation", "'t' as table", "'s' as schema", "'feed' as source", "'{}' as key", "string(null) as before", "'{}' as after", "timestamp(null) as timestamp")
    more = str(tmp_path / "more")
    with pytest.raises(Exception, match="25 times in a row"):
        sinks.sender(lambda *a: 404, "http://x", ["partition"], 100, park=lambda r: write(more, str(r["seq"])))(many, 0)
    assert open(more).read().split() == [str(i) for i in range(25)]


BUILTINS = [
    ("[.[] | . * 2]", "[1,2,3]", [2, 4, 6]), ("map(.a)", '[{"a":1},{"b":2}]', [1, None]), ("map(select(. > 1))", "[1,2,3]", [2, 3]), ("add", "[1,2,3.5]", 6.5), ("add", '["a","b"]', "ab"), ("add", "[]", None),
    ("any(. > 2)", "[1,2,3]", True), ("all(. > 2)", "[1,2,3]", False), ("any", "[false,null]", False), ("min", "[3,1,2]", 1), ("max", '["b","a"]', "b"), ("sort", '[3,"a",null,1,true,{"x":1}]', [None, True, 1, 3, "a", {"x": 1}]),
    ("unique", "[3,1,3]", [1, 3]), ("first", "[7,8]", 7), ("last", "[7,8]", 8), (".[-1]", "[7,8]", 8), (".[1:]", "[7,8,9]", [8, 9]), (".[:-1]", '"abc"', "ab"), (".[1:2]", "[7,8,9]", [8]),
    ("[range(3)]", "null", [0, 1, 2]), ("[range(2; 4), 9]", "null", [2, 3, 9]), ("flatten", "[1,[2,[3,[4]]]]", [1, 2, 3, 4]), ("del(.a)", '{"a":1,"b":2}', {"b": 2}), ("del(.[0])", "[1,2]", [2]),
    ("to_entries", '{"a":1}', [{"key": "a", "value": 1}]), ('with_entries(select(.key != "a"))', '{"a":1,"b":null}', {"b": None}), ("from_entries", '[{"key":"x","value":[1]}]', {"x": [1]}),
    ("pow(2; 10)", "null", 1024), ('sub("b+"; "x")', '"abbcb"', "axcb"), ('gsub("b"; "$")', '"abcb"', "a$c$"), ("@base64", '"hi"', "aGk="), ("@base64d", '"aGk="', "hi"), ("@uri", '"a b/é~*"', "a%20b%2F%C3%A9~%2A"),
    ("@csv", '[1,"a\\"b",null,true]', '1,"a""b",,true'), ('strftime("%Y-%m-%dT%H:%M:%SZ")', "0", "1970-01-01T00:00:00Z"), ('contains(["b"])', '["abc","d"]', True), ('contains(["x"])', '["abc","d"]', False), ("reverse", "[1,2]", [2, 1]),
    ("round", "2.5", 3), ("ceil", "1.2", 2), ("[.items[].id]", '{"items":[{"id":1},{"id":2}]}', [1, 2]), ("now > 1700000000", "null", True), (".id", '{"id":12345678901234567890}', 12345678901234567890), ("{id, status}", '{"id":1,"status":"open","n":2}', {"id": 1, "status": "open"}),
]


def test_jq_builtins(spark):
    got = spark.range(1).select(*[jq(expression, F.lit(raw)).alias(f"c{i}") for i, (expression, raw, _) in enumerate(BUILTINS)]).first()
    for value, (expression, raw, want) in zip(got, BUILTINS):
        assert (None if value is None else json.loads(value)) == want, (expression, raw, value)
    for bad in ("1, 2", ".[]", "repeat(1)", "range(3)", "map(.[])"):
        with pytest.raises(JqError):
            jq(bad, F.lit("[1,2]"))
    for bad in ('error("boom")', "1 + .status"):
        with pytest.raises(Exception, match="boom|cannot add"):
            spark.range(1).select(jq(bad, F.lit('{"status":"open"}'))).collect()


def test_sequence_numbers_do_not_depend_on_ranges(spark, sf):
    from feedloom.operators import eventlog
    from feedloom.sources.feed import order_feed

    feed = order_feed(spark, sf)
    one_, many = (sorted(tuple(r) for r in eventlog.append(feed, n=8, ranges=k).select("arrival", "partition", "seq").collect()) for k in (1, 5))
    assert one_ == many


def test_segments_by_slot(tmp_path):
    from feedloom.sources import log_files as L

    for n in ("b-2", "b-10", "a-1"):
        L.write(str(tmp_path / n), [(1, b"x")])
    stream = L.Stream(str(tmp_path))
    first = stream.latestOffset()
    assert first == {"a": "a-1", "b": "b-10"}
    # a new slot whose name sorts first, and a further file: neither moves another slot's files
    for n in ("0-1", "b-11"):
        L.write(str(tmp_path / n), [(1, b"x")])
    last = stream.latestOffset()
    assert [(p.slot, p.number) for p in stream.partitions({}, first)] == [("a", 1), ("b", 2), ("b", 10)]
    assert [(p.slot, p.number) for p in stream.partitions(first, last)] == [("0", 1), ("b", 11)]
    assert [m[:3] for m in L.messages(stream.partitions(first, last)[1])] == [("b", 1, 11 << 32)]
