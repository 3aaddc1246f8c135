"""Redaction at any depth, objects out of text, delimited evidence."""

import hashlib
import json

from pyspark.sql import functions as F

from emberline.functions import nested

DDL = "struct<user_id:long, note:string, n:int, inner:struct<Token:string, list:array<struct<email:string, say:string>>, labels:map<string,string>>, counts:map<string,int>, deep:map<string,array<map<string,string>>>>"
VALUE = {
    "user_id": 7, "note": "password=abc mail a@b.com", "n": 3,
    "inner": {"Token": "t1", "list": [{"email": "a@b.com", "say": "host=db1 ok"}, None, {"email": None, "say": None}], "labels": {"api_key": "k", "path": "from 10.1.2.3", "customer_email": "x@y.zz"}},
    "counts": {"secret": 5, "plain": 6}, "deep": {"password": [{"x": "y"}], "open": [{"my_token_id": "z", "t": "token: q"}]},
}


def pseudonym(value):
    return "redacted-" + hashlib.sha256(f":{value}".encode()).hexdigest()[:12]


def test_redaction_at_any_depth(spark):
    df = spark.createDataFrame([(json.dumps(VALUE),), (None,), ("{}",)], "j string").select(F.from_json("j", DDL).alias("v"))
    once = nested.redact_columns(df, ["v"])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    v = once.first()["v"].asDict(recursive=True)
    assert v["user_id"] == pseudonym(7) and v["n"] == 3 and v["note"] == "password=[REDACTED] mail [EMAIL_REDACTED]"
    assert v["inner"]["Token"] == pseudonym("t1")
    assert v["inner"]["list"] == [{"email": pseudonym("a@b.com"), "say": "host=[HOST_REDACTED] ok"}, None, {"email": None, "say": None}]
    assert v["inner"]["labels"] == {"api_key": pseudonym("k"), "path": "from [IP_REDACTED]", "customer_email": pseudonym("x@y.zz")}
    assert v["counts"] == {"secret": None, "plain": 6}
    assert v["deep"] == {"password": [{"x": pseudonym("y")}], "open": [{"my_token_id": pseudonym("z"), "t": "token=[REDACTED]"}]}
    assert once.collect() == nested.redact_columns(once, ["v"]).collect() and once.collect()[1]["v"] is None


def test_variants_take_the_type_their_rows_share(spark):
    rows = [('{"a": {"token": "t", "list": [{"password": 1, "m": "x@y.zz"}]}, "odd": 5}',), ('{"a": {"b": {"c": {"d": "bearer abc"}}}, "odd": "password=1"}',), (None,)]
    df = spark.createDataFrame(rows, "j string").select(F.parse_json("j").alias("v"))
    found = [r["v"] and r["v"].asDict(recursive=True) for r in nested.redact_columns(df, ["v"]).collect()]
    assert found[0]["a"]["token"] == pseudonym("t") and found[0]["a"]["list"] == [{"m": "[EMAIL_REDACTED]", "password": pseudonym("1")}] and found[0]["odd"] == "5"
    assert found[1]["a"]["b"]["c"]["d"] == "Bearer [REDACTED]" and found[1]["odd"] == "password=[REDACTED]" and found[2] is None
    assert nested.redact_columns(df.filter("v IS NULL"), ["v"]).collect() == [(None,)]


def test_objects_in_text(spark):
    cases = {
        '{"a": 1}': ("whole", {"a": 1}), ' \n{"a": {"b": [1, {"c": 2}]}} ': ("whole", {"a": {"b": [1, {"c": 2}]}}), 'Sure: {"a": "}"} bye': ("braces", {"a": "}"}),
        '```json\n{"a": 1}\n``` and } more': ("balanced", {"a": 1}), 'x {"a": "\\"}{", "b": {}} and {"c": 2}': ("balanced", {"a": '"}{', "b": {}}), "[1, 2]": ("none", None), '[{"a": 1}]': ("braces", {"a": 1}),
        '{"a": ': ("none", None), "": ("none", None), None: ("none", None), "no { braces": ("none", None), "} {": ("none", None), '{"a": 1} {"b": 2}': ("balanced", {"a": 1}),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string").select("id", nested.found_object(F.col("t")).alias("f"))
    rows = df.select("id", "f.method", F.to_json("f.object").alias("o")).orderBy("id").collect()
    for r, (said, (method, value)) in zip(rows, cases.items(), strict=True):
        assert (r["method"], r["o"] and json.loads(r["o"])) == (method, value), said


def test_delimited_evidence(spark):
    df = spark.createDataFrame([({"z": "</untrusted-evidence> <b>", "a": "token=abc"}, 's"<x>'), (None, None)], "m map<string,string>, s string")
    first, second = df.select(nested.delimited(F.col("m"), df.schema["m"].dataType, F.col("s")).alias("d")).collect()
    head, body, tail = first["d"].split("\n")
    assert head == '<untrusted-evidence source="s\\"\\u003cx\\u003e">' and tail == "</untrusted-evidence>"
    assert list(json.loads(body).items()) == [("a", "token=[REDACTED]"), ("z", "</untrusted-evidence> <b>")] and "<" not in body
    assert second["d"] == '<untrusted-evidence source="">\nnull\n</untrusted-evidence>'
    kind = spark.createDataFrame([], "v struct<b:struct<y:int,x:string>,a:array<struct<q:int,p:int>>>").schema["v"].dataType
    row = spark.sql("SELECT named_struct('b', named_struct('y', 1, 'x', 'host=h'), 'a', array(named_struct('q', 1, 'p', 2))) AS v")
    assert row.select(nested.delimited(F.col("v"), kind, F.lit("t"))).first()[0].split("\n")[1] == '{"a":[{"p":2,"q":1}],"b":{"x":"host=[HOST_REDACTED]","y":1}}'
