"""Message logs in both record shapes, with the odd cases of each."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from drifthound.operators import projection as P
from drifthound.operators import registry
from drifthound.sources import runs

COLUMNS = "run_id string, idx int, role string, content string, tool_calls string, tool_call_id string, id string, error boolean"


def table(spark, rows):
    return spark.createDataFrame([("r", i, *row) for i, row in enumerate(rows)], COLUMNS)


def call(name, id=None, args='{"k": 1}'):
    return {"id": id, "function": {"name": name, "arguments": args}}


def labels(events):
    return [r.act for r in events.orderBy("pos").collect()]


def test_list_shape(spark):
    m = table(spark, [
        ("system", "policy", None, None, None, None), ("user", "hi", None, None, None, None), ("assistant", None, json.dumps([call("get_user", "1")]), None, None, None),
        ("tool", "Error: user not found", None, "1", None, None), ("assistant", "None", json.dumps([call("cancel_reservation", "2")]), None, None, None), ("tool", "[]", None, "2", None, None),
        ("assistant", "bye", None, None, None, None), ("user", "###STOP###", None, None, None, None)])
    for matching in ("id", "fifo"):
        e = P.project(m, "list", matching=matching)
        assert labels(e) == ["user", "get_user", "cancel_reservation", "respond", "end_conversation"]
        assert labels(P.relabel(e, "tool_result")) == ["user", "get_user!notfound", "cancel_reservation!empty", "respond", "end_conversation"]
        assert labels(P.relabel(e, "tool_status")) == ["user", "get_user!err", "cancel_reservation", "respond", "end_conversation"]
        assert labels(P.relabel(e, "rw_status")) == ["user", "read!notfound", "write!empty", "respond", "end_conversation"]
        assert labels(P.relabel(e, "calls")) == ["get_user", "cancel_reservation"] and labels(P.relabel(e, "agent")) == ["get_user", "cancel_reservation", "respond"]
    with pytest.raises(ValueError):
        P.relabel(e, "nope")


def test_fifo_without_ids_and_repeated_ids(spark):
    m = table(spark, [
        ("assistant", None, json.dumps([call("a"), call("b")]), None, None, None), ("tool", "Error: not allowed", None, None, None, None), ("tool", "done", None, "unknown", None, None),
        ("assistant", None, json.dumps([call("c", "x")]), None, None, None), ("assistant", None, json.dumps([call("d", "x")]), None, None, None), ("tool", "Error: not found", None, "x", None, None)])
    assert labels(P.relabel(P.project(m), "tool_result")) == ["a!policy", "b", "c", "d!notfound"]


def answers(steps):
    """Which call each result answers, by the rule over whole lists: the same id's last step if that is a call, else the first call that is open."""
    out = {}
    for i, (what, name) in enumerate(steps):
        if what == "result":
            same = [j for j in range(i) if name is not None and steps[j][1] == name]
            if same and steps[same[-1]][0] == "call":
                out[i] = same[-1]
            elif rest := [j for j in range(i) if steps[j][0] == "call" and j not in out.values()]:
                out[i] = rest[0]
    return out


def test_answers_of_many_runs(spark):
    rng = random.Random(1)
    texts = {f"r{k}": [(rng.choice(["call", "result"]), rng.choice([None, "x", "y", "z", "x"])) for _ in range(rng.randint(1, 14))] for k in range(150)}
    rows = [(r, i, "assistant", None, json.dumps([call(f"c{i}", name)]), None, None, None) if what == "call" else (r, i, "tool", f"n{i}", None, name, None, None) for r, steps in texts.items() for i, (what, name) in enumerate(steps)]
    found = {}
    for e in P.project(spark.createDataFrame(rows, COLUMNS)).filter("obs_len IS NOT NULL").collect():
        found.setdefault(e.run_id, {})[e.act] = e.obs_len
    for r, steps in texts.items():
        want = {f"c{c}": len(f"n{i}") for i, c in sorted(answers(steps).items())}  # the last result of a call stays
        assert found.get(r, {}) == want, (r, steps)


def test_long_run_is_matched_in_one_pass(spark):
    """100,000 open calls, of which every other one is named by its result, the newest first."""
    n = 100_000
    e = spark.range(n).selectExpr("'r' AS run_id", "cast(id AS int) AS idx", "0 AS sub", "cast(id AS int) AS pos", "true AS is_call", "if(id % 2 = 1, cast(id AS string), null) AS call_id")
    results = spark.range(n).selectExpr("'r' AS run_id", f"cast({n} + id AS int) AS idx", f"if(id < {n // 2}, cast({n} - 1 - 2 * id AS string), null) AS result_id")
    began = time.perf_counter()
    out = P._answered_calls(e, results).cache()
    assert out.count() == n and out.select("pos").distinct().count() == n
    assert out.filter(f"idx = {n}").first().pos == n - 1 and out.filter(f"idx = {n + n // 2}").first().pos == 0
    assert time.perf_counter() - began < 60


def test_odd_calls(spark):
    m = table(spark, [
        ("assistant", "x", "[]", None, None, None), ("assistant", None, "not a list", None, None, None), ("assistant", None, str([call("lit", "1")]), None, None, None),
        ("assistant", None, json.dumps(call("one", "2")), None, None, None), ("tool", "", None, "2", None, None)])
    assert labels(P.project(m, literals=True)) == ["respond", "respond", "lit", "one"]


def test_object_shape(spark):
    m = table(spark, [
        ("assistant", None, json.dumps([{"id": "1", "name": "put", "arguments": {"a": 1}}, {"id": "2", "name": "look", "arguments": {}}, {"id": "3", "name": "odd", "arguments": {}}]), None, None, None),
        ("tool", "", None, None, "2", False), ("tool", "Tool 'odd' not found.", None, None, "3", True), ("tool", "fine", None, None, "1", False),
        ("user", None, json.dumps([{"id": "4", "name": "look", "arguments": {}, "requestor": "user"}]), None, None, None), ("tool", "must be positive", None, None, "4", True)])
    reg = registry.registry_of(spark, [("d", "put", "agent", "WRITE"), ("d", "look", "user", "READ")])
    e = P.project(m, "object", reg, "id")
    assert labels(P.relabel(e, "rw_status")) == ["write", "read!empty", "unknown!wrongtool", "u:read!invalid"]
    assert labels(P.relabel(e, "role")) == ["tool", "tool", "tool", "user_tool"]
    calls = e.selectExpr("act AS tool", "error")
    assert {r.tool: (r.calls, r.hallucinated) for r in registry.audit(calls, reg).collect()}["odd"] == (1, True)
    with pytest.raises(ValueError):
        registry.audit(calls, registry.registry_of(spark, [("d", "put", "agent", "WRITE")]))


def test_round_trip_of_traces(spark, tmp_path):
    record = [{"task_id": 1, "trial": 0, "reward": 1.0, "traj": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "tool_calls": [call("a", "1")]}, {"role": "tool", "content": "ok", "tool_call_id": "1"}], "info": {"task": {"instruction": "do", "user_id": "u", "actions": [{"x": 1}]}}}]
    path = tmp_path / "runs.json"
    path.write_text(json.dumps(record))
    r = runs.read_run_list(spark, str(path), "retail", "m")
    e = P.project(P.explode_messages_of(r))
    t = P.build_traces(r, e)
    runs.write_traces(t, str(tmp_path / "traces"))
    back = runs.read_traces(spark, str(tmp_path / "traces"))
    row = back.first()
    assert (row.run_id, row.success, [x.act for x in row.events]) == ("m:retail:t1:r0", True, ["user", "a"])
    assert runs.trace_events(back).count() == 2


def test_simulations(spark, tmp_path):
    data = {"info": {}, "tasks": [], "simulations": [{"task_id": "7", "trial": 2, "messages": [{"role": "assistant", "content": "hi"}], "reward_info": {"reward": 0.0}, "termination_reason": "x"}]}
    path = tmp_path / "sims.json"
    path.write_text(json.dumps(data))
    r = runs.read_simulations(spark, str(path), "airline", "m")
    assert r.first().run_id == "m:airline:t7:r2" and P.project(P.explode_messages_of(r), "object").first().act == "respond"


def test_registry_of_several_domains(spark):
    """A tool that several domains have is looked up in the call's own domain, or refused."""
    kinds = registry.registry_of(spark, [(d, "transfer_to_human_agents", "agent", "GENERIC") for d in ("x", "y", "z")] + [("x", "move", "agent", "WRITE"), ("y", "move", "agent", "READ")])
    calls = '[{"id": "1", "name": "%s", "arguments": "{}", "requestor": "assistant"}]'
    rows = [("r", 0, "assistant", None, calls % "transfer_to_human_agents", None, None, None, "y"), ("s", 0, "assistant", None, calls % "move", None, None, None, "x"), ("t", 0, "assistant", None, calls % "move", None, None, None, "y")]
    messages = spark.createDataFrame(rows, "run_id string, idx int, role string, content string, tool_calls string, tool_call_id string, id string, error boolean, domain string")
    out = {r.run_id: (r.rw, r.terminal) for r in P.project(messages, "object", kinds).collect()}
    assert out == {"r": ("read", True), "s": ("write", False), "t": ("read", False)}
    with pytest.raises(ValueError):
        P.project(messages.drop("domain"), "object", kinds)


def test_elements_of_one_file_in_blocks(spark, tmp_path):
    """A list and an object cut at every place: strings with brackets, quotes and backslashes, nested values, spaces, other keys."""
    from drifthound.sources.elements import json_elements

    rng = random.Random(3)

    def value(deep=0):
        kind = rng.randrange(7 if deep < 3 else 4)
        if kind < 2:
            return "".join(rng.choice(['a', '"', "\\", "[", "]", "{", "}", ",", ":", "é", "\n", "simulations"]) for _ in range(rng.randrange(8)))
        if kind < 4:
            return rng.choice([1, -2.5, None, True])
        if kind < 6:
            return {f"k{i}\"": value(deep + 1) for i in range(rng.randrange(3))}
        return [value(deep + 1) for _ in range(rng.randrange(3))]

    values = [value() for _ in range(25)]
    for k, dump in enumerate((lambda x: json.dumps(x), lambda x: json.dumps(x, indent=1, ensure_ascii=False))):
        (tmp_path / f"list{k}.json").write_text("  " + dump(values) + "\n")
        (tmp_path / f"object{k}.json").write_text(dump({"info": {"simulations": [1, 2]}, "tasks": [], "simulations": values, "more": [3], "x": {"y": [4]}}))
        for block in (1, 7, 64, 1 << 20):
            got = json_elements(spark, str(tmp_path / f"list{k}.json"), block=block) if block > 1 or k == 0 else None
            for df in (got, json_elements(spark, str(tmp_path / f"object{k}.json"), "simulations", block=max(block, 5))):
                if df is not None:
                    assert sorted(map(repr, (json.loads(r.value) for r in df.collect()))) == sorted(map(repr, values))
    assert json_elements(spark, str(tmp_path / "object0.json")).count() == 0 and json_elements(spark, str(tmp_path / "object0.json"), "x").count() == 0
    assert [r.value for r in json_elements(spark, str(tmp_path / "object0.json"), "more").collect()] == ["3"] and json_elements(spark, str(tmp_path / "object0.json"), "tasks").count() == 0
    (tmp_path / "empty.json").write_text("")
    assert json_elements(spark, str(tmp_path / "empty.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        json_elements(spark, str(tmp_path / "nope.json"))


def test_one_large_list_is_read_by_many_tasks(spark, tmp_path):
    record = {"task_id": "1", "trial": 0, "reward": 1.0, "traj": [{"role": "user", "content": "hi [\"" * 50}], "info": {"task": {"instruction": "do", "user_id": "u", "actions": []}}}
    path = tmp_path / "runs.json"
    path.write_text(json.dumps([{**record, "trial": i} for i in range(20_000)]))
    from drifthound.sources.elements import json_elements

    blocks = json_elements(spark, str(path), block=1 << 20).withColumn("task", F.spark_partition_id())
    assert path.stat().st_size > 8 << 20 and blocks.select("task").distinct().count() >= 4
    r = runs.read_run_list(spark, str(path), "d", "m")
    plain = spark.read.schema(runs.LIST_RECORD).json(str(path), multiLine=True)
    assert r.count() == plain.count() == 20_000
    assert r.selectExpr("sum(trial)", "count(distinct run_id)", "sum(size(messages))").first() == (sum(range(20_000)), 20_000, 20_000)


def test_elements_are_not_taken_for_a_small_table(spark, tmp_path):
    """Files of one block and of many, list and object, are read alike; Spark doesn't broadcast them by the size of their addresses."""
    from drifthound.sources.elements import json_elements

    sizes = {"a": 3, "b": 40, "c": 1, "d": 9}
    for f, n in sizes.items():
        (tmp_path / f"{f}.json").write_text(json.dumps({"tasks": [[f]], "simulations": [{"f": f, "i": i, "s": '\\"]},' * (i % 3)} for i in range(n)]}))
    for block in (150, 5_000):
        s, t = (json_elements(spark, str(tmp_path), k, block=block) for k in ("simulations", "tasks"))
        met = s.join(t.withColumnRenamed("value", "task"), "file")
        found = [(*json.loads(r.task), *json.loads(r.value).values()) for r in met.collect()]
        assert sorted(found) == sorted((f, f, i, '\\"]},' * (i % 3)) for f, n in sizes.items() for i in range(n))
        final = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("ENSURE_REQUIREMENTS") == 2  # both sides have been measured by a shuffle before one may be broadcast
