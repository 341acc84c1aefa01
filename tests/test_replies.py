"""JSON out of replies: against the standard library's decoder tried at each bracket, deep nesting, long broken replies."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from loomgraph.functions import replies as J


def tried(text):
    """The value at the first bracket where the decoder finds one."""
    strict = json.JSONDecoder(parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    for m in re.finditer(r"[{\[]", text):
        try:
            return strict.raw_decode(text, m.start())[0]
        except ValueError:
            pass
    return None


def test_against_the_decoder():
    rng = random.Random(4)
    parts = ["{", "}", "[", "]", ",", ":", '"', '"a"', '"a":', "1", "-2.5e3", "01", "true", "null", "nul", " ", "\n", '\\"', '"\\u00e9"', "x", '{"k": 1}', '["}"]', '"[', "{}", "[]", "NaN"]
    found = 0
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want, got = tried(text), J.first_object(text)
        try:
            want = None if not isinstance(json.loads(text), (dict, list)) else want
        except ValueError:
            pass
        want = {"items": want} if isinstance(want, list) else want
        assert (got is None) == (want is None), text
        if got is not None:
            found += 1
            assert json.loads(got) == want, text
    assert found > 3000


def test_prose_and_fences():
    cases = {
        'Here is it:\n```json\n{"a": [1, 2]}\n```\nbye {x}': '{"a": [1, 2]}',
        "{note: {\"a\": {\"b\": \"}\"}}}": '{"a": {"b": "}"}}',
        '[{"a": 1}] and {"b": 2}': '{"items": [{"a": 1}]}',
        "no": None,
        "": None,
        '"{}"': None,
        '```\n"{}"\n```': None,
        '"{}" {}': "{}",
    }
    assert {k: J.first_object(k) for k in cases} == cases and J.first_object(None) is None


def test_deep_and_long():
    began = time.perf_counter()
    n = 200_000
    assert J.first_object("[" * n) is None
    assert J.first_object("[" * n + "]" * n) == '{"items": ' + "[" * n + "]" * n + "}"
    assert J.first_object("[" * n + "]" * (n - 1)) == '{"items": ' + "[" * (n - 1) + "]" * (n - 1) + "}"
    assert J.first_object('{"a":' * n) is None
    assert J.first_object('[",' * n) is None
    assert J.first_object('["{' * n + '{"k": 1}') == '{"k": 1}'
    assert J.first_object("{x" * n + "{}") == "{}"
    assert J.first_object('["' + "a{" * n) is None
    assert time.perf_counter() - began < 20


def test_column(spark):
    texts = ['  {"a": 1} ', "[1, 2]", "7", '"s"', None, "", '```json\n{"a": [3]}\n```', "so: [4] and", "[" * 30_000, "[" * 3000 + "]" * 3000, '{"a": 1} {"b": 2}', "{'a': 1}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, reply string")
    got = {r.id: r.o for r in df.select("id", J.json_object(F.col("reply")).alias("o")).collect()}
    assert got == {0: '{"a": 1}', 1: '{"items": [1, 2]}', 2: None, 3: None, 4: None, 5: None, 6: '{"a": [3]}', 7: '{"items": [4]}', 8: None, 9: '{"items": ' + texts[9] + "}", 10: '{"a": 1}', 11: None}


def test_parsed_once(spark):
    """Edges are read out of replies with one parse of each by the JVM, and what it has parsed or holds no bracket isn't sent to a worker."""
    from loomgraph.operators import vectors as K

    edge = '[{"target": "a", "predicate": "supports", "confidence": 0.5}]'
    texts = [edge, f'{{"edges": {edge}}}', f"so: {edge}", "no JSON", None, "7"]
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "source long, document_id long, reply string")
    out = K.propose_edges(df, spark.createDataFrame([(9, "a")], "id long, name string"))
    assert sorted(r.source for r in out.collect()) == [0, 1, 2]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('"behind it": 1') == 1, plan
