import json

from strandloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("now", None, None, False), ("find", "q", "object", True)]


def call(i, name, args):
    return "<tool_call>" + json.dumps({"name": name, "id": i, "arguments": args}) + "</tool_call>"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", json string")
    tools = spark.createDataFrame(TOOLS, "tool string, parameter string, type string, required boolean")
    return chat.format_chat(chat.parse_messages(df), tools).orderBy("conv_id", "order_turn", "order_step", "turn", "part").collect()


def test_links_order_and_checks(spark):
    rows = [
        (1, 0, "user", "add 1 and 2"),
        (1, 1, "tool", '<tool_result id="x">early</tool_result>'),
        (1, 2, "assistant", "Sure. " + call("x", "add", {"b": 2.5, "a": 1}) + call("y", "add", {"a": "1", "b": 2})),
        (1, 3, "tool", '<tool_result id="nobody">?</tool_result>'),
        (2, 0, "assistant", call("x", "now", {}) + call("z", "find", {"q": {"b": 1, "a": [1, None]}}) + call("w", "find", {}) + call("v", "now", {"extra": 1}) + call("u", "unknown", 5)),
    ]
    got = run(spark, rows)
    assert [(r["conv_id"], r["turn"]) for r in got] == [(1, 0), (1, 2), (1, 1), (1, 3), (2, 0)]
    act = got[1]
    assert (act["n_calls"], act["n_answered"], act["n_invalid"]) == (2, 1, 1)
    assert act["json"] == '{"content":"Sure.","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2.5},"id":"x","name":"add"},{"arguments":{"a":"1","b":2},"id":"y","name":"add"}]}'
    assert (got[2]["linked"], got[3]["linked"], got[0]["linked"]) == (True, False, None)
    assert json.loads(got[2]["json"]) == {"content": "early", "role": "tool", "tool_call_id": "x"}
    assert (got[4]["n_calls"], got[4]["n_answered"], got[4]["n_invalid"]) == (5, 0, 2)
    assert '"q":{"a":[1,null],"b":1}' in got[4]["json"]


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 0, None, None), (None, 0, "user", "hi"), (3, None, "assistant", 'say "é"\n\t\\ 😀'), (4, 0, "assistant", "<tool_call>not json</tool_call>"),
        (5, 0, "user", call("x", "add", {})), (6, 0, "assistant", "x" * 300000), (7, 0, "assistant", call("x", "now", {}) + call("x", "now", {})), (7, 1, "tool", '<tool_result id="x"></tool_result>'), (7, 2, "tool", '<tool_result id="x">b</tool_result>'),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert json.loads(by[(1, 0)]["json"]) == {"content": "", "role": "user"}
    assert json.loads(by[(3, None)]["json"])["content"] == 'say "é"\n\t\\ 😀'
    assert by[(4, 0)]["n_calls"] == 0 and json.loads(by[(4, 0)]["json"])["content"] == "<tool_call>not json</tool_call>"
    assert by[(5, 0)]["n_calls"] == 0 and len(json.loads(by[(6, 0)]["json"])["content"]) == 300000
    assert by[(7, 0)]["n_calls"] == 2 and by[(7, 0)]["n_answered"] == 2 and by[(7, 1)]["linked"] and by[(7, 2)]["linked"]
    for r in got:
        assert r["json"] == json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_empty(spark):
    assert run(spark, []) == []


def test_without_conversation_or_turn(spark):
    call = '<tool_call>{"id": "a", "name": "f", "arguments": {}}</tool_call>'
    rows = [(None, 1, "assistant", call), (None, 2, "tool", '<tool_result id="a">x</tool_result>'), (1, None, "assistant", call), (1, None, "tool", '<tool_result id="a">y</tool_result>'), (2, 1, "tool", '<tool_result id="a">z</tool_result>')]
    got = {(r["conv_id"], r["role"]): r for r in chat.format_chat(chat.parse_messages(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[None, "assistant"]["n_answered"] == got[1, "assistant"]["n_answered"] == 1
    assert got[None, "tool"]["linked"] and got[1, "tool"]["linked"] and got[2, "tool"]["linked"] is False


def result(i, text):
    return f'<tool_result id="{i}">{text}</tool_result>'


def test_every_result_of_a_message(spark):
    rows = [(1, 0, "assistant", call("b", "now", {}) + call("c", "now", {})), (1, 1, "tool", f"before {result('b', 'r1')} mid {result('c', 'r2')} tail"), (1, 2, "tool", result("c", "again"))]
    got = [(r["turn"], r["part"], r["linked"], json.loads(r["json"])) for r in run(spark, rows)]
    assert got[0][3]["tool_calls"] and run(spark, rows)[0]["n_answered"] == 2
    assert got[1:] == [
        (1, 0, True, {"content": "r1", "role": "tool", "tool_call_id": "b"}), (1, 1, True, {"content": "r2", "role": "tool", "tool_call_id": "c"}),
        (1, 2, None, {"content": "before  mid  tail", "role": "tool"}), (2, 0, True, {"content": "again", "role": "tool", "tool_call_id": "c"}),
    ]


def brute_order(rows):
    """Places by walking a conversation's links one by one: (turn, part) -> (at, step, cyclic)."""
    import re

    parts, calls, refs = {}, {}, {}
    for turn, role, text in sorted(rows, key=lambda r: r[0]):
        if role == "tool":
            for k, (i, _) in enumerate(re.findall(r'<tool_result id="([^"]*)">(.*?)</tool_result>', text)):
                parts[turn, k] = i
        elif role == "assistant":
            parts[turn, 0] = None
            for raw in re.findall(r"<tool_call>(.*?)</tool_call>", text):
                calls.setdefault(json.loads(raw)["id"], (turn, 0))
                refs.setdefault((turn, 0), set()).update(re.findall(r'"\$result:([^"]+)"', raw))
        else:
            parts[turn, 0] = None
    firsts = {}
    for k, i in sorted(parts.items()):
        if i is not None:
            firsts.setdefault(i, k)
    before = {k: set() for k in parts}
    for k, i in parts.items():
        if i in calls:
            before[k].add(calls[i])
    for k, ids in refs.items():
        before[k] |= {firsts[i] for i in ids if i in firsts}
    done = {}
    while True:
        free = [k for k in parts if k not in done and before[k] <= set(done)]
        if not free:
            break
        for k in free:
            last = max((done[b][:2] for b in before[k]), default=None)
            done[k] = (last[0], last[1] + 1, False) if last and last[0] >= k[0] else (k[0], 0, False)
    return {k: done.get(k, (k[0], 0, True)) for k in parts}


def test_calls_that_need_results_come_after_them(spark):
    """Chains, parallel calls, references forwards and cycles, against a walk over each conversation."""
    import random

    rnd = random.Random(6)
    rows, want = [(90, 0, "assistant", call("a", "now", {"x": "$result:b"})), (90, 1, "tool", result("a", "1")), (90, 2, "assistant", call("b", "now", {"x": "$result:a"})), (90, 3, "tool", result("b", "2")), (90, 4, "assistant", call("c", "now", {"x": "$result:b"})), (90, 5, "user", "hi")], {}
    for conv in range(12):
        ids = [f"i{k}" for k in range(rnd.randrange(1, 6))]
        parts = [("assistant", call(i, "find", {"q": {"from": [f"$result:{rnd.choice(ids)}"]}} if rnd.random() < 0.6 else {}) + (call(f"{i}p", "now", {}) if rnd.random() < 0.3 else "")) for i in ids]
        parts += [("tool", " ".join(result(i, "r") for i in rnd.sample(ids, rnd.randrange(1, len(ids) + 1)))) for _ in ids] + [("user", "x")]
        rnd.shuffle(parts)
        rows += [(conv, t, role, text) for t, (role, text) in enumerate(parts)]
    got = {(r["conv_id"], r["turn"], r["part"]): (r["order_turn"], r["order_step"], r["cyclic"]) for r in run(spark, rows)}
    for conv in {r[0] for r in rows}:
        want |= {(conv, *k): v for k, v in brute_order([r[1:] for r in rows if r[0] == conv]).items()}
    assert got == want
    assert {k: got[90, k, 0][2] for k in range(6)} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}
    assert sum(step > 1 for _, step, _ in want.values()) > 3


def test_checks_of_odd_rows(spark):
    tools = spark.createDataFrame(TOOLS, "tool string, parameter string, type string, required boolean")
    calls = spark.createDataFrame([(1, "add", None), (1, "add", None), (None, "now", "{}"), (3, None, "{}"), (4, "now", "[]")], "known long, name string, arguments string").withColumnRenamed("known", "wrong_key")
    got = sorted((str(r["wrong_key"]), r["valid"]) for r in chat.check_arguments(calls, tools).collect())
    assert got == [("1", False), ("1", False), ("3", None), ("4", False), ("None", True)]
    assert chat.check_arguments(calls.limit(0), tools).count() == 0
    assert [r["valid"] for r in chat.check_arguments(calls, tools.limit(0)).collect()] == [None] * 5

