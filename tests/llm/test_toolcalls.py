import json
import random
import re

from leadgrid.llm import toolcalls

CALLS = "conv_id long, turn long, id string, name string, arguments string, after string, row string, first string"
RESULTS = "conv_id long, turn long, id string, content string, there string"
TOOLS = {"find": [("q", "string", True), ("n", "integer", False), ("deep", "object", False), ("x", "number", False), ("on", "boolean", False), ("l", "array", False)]}


def linked(spark, calls, results):
    c = spark.createDataFrame([(*x, "r", "f") for x in calls], CALLS).repartition(3)
    r = spark.createDataFrame([(*x, "t") for x in results], RESULTS).repartition(2)
    return toolcalls.link(c, r, TOOLS)


def test_statuses(spark):
    ok = '{"q": "a"}'
    calls = [
        (1, 0, "a", "find", ok, None), (1, 2, "b", "find", ok, "a"), (1, 4, "c", "find", ok, "b"), (1, 6, "c", "find", ok, None),
        (1, 8, "x", "find", ok, "y"), (1, 9, "y", "find", ok, "x"), (1, 10, "z", "find", ok, "z"), (1, 11, "w", "find", ok, "y"),
        (2, 0, "a", "lost", ok, None), (2, 1, "b", "find", "[1]", None), (2, 2, "c", "find", "{", None), (2, 3, "d", "find", '{"n": "1"}', "nope"),
        (2, 4, "e", None, None, None), (None, 0, "a", "find", ok, None), (3, 0, None, "find", ok, None), (3, 1, "u", "find", ok, None),
    ]
    results = [(1, 1, "a", "ra"), (1, 3, "b", None), (1, 5, "c", "rc"), (1, 7, "c", "rc2"), (2, 9, "none", "r"), (None, 0, "a", "r"), (3, 5, None, "r")]
    rows = linked(spark, calls, results).collect()
    got = {(r.kind, r.conv_id, r.id, r.turn): (r.status, r.depth, r.result_turn, r.errors) for r in rows}
    assert len(rows) == len(got)
    call = lambda *k: got[("call", *k)]
    assert call(1, "a", 0) == ("ok", 0, 1, "") and call(1, "b", 2) == ("ok", 1, 3, "") and call(1, "c", 4) == ("ok", 2, 5, "")
    assert call(1, "c", 6)[0] == "duplicate"
    assert [call(1, k, t)[:2] for k, t in (("x", 8), ("y", 9), ("z", 10), ("w", 11))] == [("cyclic", None)] * 4
    assert call(2, "a", 0)[0::3] == ("invalid", "name: unknown tool")
    assert call(2, "b", 1)[3] == "arguments: not an object" == call(2, "c", 2)[3]
    assert call(2, "d", 3)[3] == "after: no such call; n: not of type integer; q: missing" and call(2, "d", 3)[1] == 0
    assert call(2, "e", 4)[3] == "arguments: not an object; name: unknown tool"
    assert call(3, "u", 1)[0] == "unanswered" and call(None, "a", 0)[0] == "unanswered" and call(3, None, 0)[0] == "unanswered"
    loose = {k[1:]: v[0] for k, v in got.items() if k[0] == "result"}
    assert loose == {(1, "c", 7): "extra", (2, "none", 9): "orphan", (None, "a", 0): "orphan", (3, None, 5): "orphan"}


def test_canonical_json(spark):
    text = 'q"\\ \n é 日   /'
    arguments = json.dumps({"q": text, "deep": {"b": [1, {"z": None, "a": 2.5}], "a": True}, "n": 7})
    row = linked(spark, [(1, 0, "a", "find", arguments, None)], [(1, 1, "a", text)]).collect()[0]
    want = {"arguments": json.loads(arguments), "conv_id": 1, "depth": 0, "id": "a", "name": "find", "result": text, "status": "ok", "turn": 0}
    assert json.loads(row.json) == want
    assert row.json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_schema(spark):
    cases = [
        ('{"q": 1}', "q: not of type string"), ('{"q": null}', "q: missing"), ('{"q": "a", "n": 1.5}', "n: not of type integer"),
        ('{"q": "a", "n": null}', ""), ('{"q": "a", "deep": []}', "deep: not of type object"), ('{"q": "a", "x": 1}', ""), ('{"q": "a", "x": 1e300}', ""),
        ('{"q": "a", "on": "true"}', "on: not of type boolean"), ('{"q": "a", "l": [1]}', ""), ('{"q": "a", "other": 1}', ""), ("null", "arguments: not an object"),
    ]
    rows = linked(spark, [(1, i, f"c{i}", "find", arguments, None) for i, (arguments, _) in enumerate(cases)], []).collect()
    assert {r.turn: r.errors for r in rows} == {i: error for i, (_, error) in enumerate(cases)}


def test_long_chains_and_random_forests(spark):
    pick, calls, want = random.Random(4), [], {}
    for i in range(300):
        calls.append((1, i, f"c{i}", "find", "{}", f"c{i - 1}" if i else None))
        want[1, f"c{i}"] = i
    for i in range(200):
        up = pick.randrange(i) if i and pick.random() < 0.8 else None
        calls.append((2, i, f"c{i}", "find", "{}", None if up is None else f"c{up}"))
        want[2, f"c{i}"] = 0 if up is None else want[2, f"c{up}"] + 1
    pick.shuffle(calls)
    assert {(r.conv_id, r.id): r.depth for r in linked(spark, calls, []).collect()} == want


def test_repeated_rows_and_empty_tables(spark):
    rows = linked(spark, [(1, 0, "a", "find", '{"q": "x"}', None)] * 3, [(1, 1, "a", "r")] * 2).collect()
    assert sorted((r.kind, r.status) for r in rows) == [("call", "duplicate")] * 2 + [("call", "ok"), ("result", "extra")]
    c, r = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert toolcalls.link(c, r, TOOLS).collect() == [] and toolcalls.link(c, r, {}).collect() == []


def test_no_python_runs(spark):
    plan = linked(spark, [(1, 0, "a", "find", "{}", None)], [])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|InPandas|InArrow", plan)
