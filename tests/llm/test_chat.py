import json

import pytest

from contactloom.llm import chat, queries
from tests.llm import plain

SCHEMAS = {"find": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "additionalProperties": False}}


def call(i, q="x", name="find", **more):
    return {"id": i, "function": {"name": name, "arguments": json.dumps({"q": q, **more})}}


def calls(*c, content=None):
    return json.dumps({"content": content, "tool_calls": c})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_schemas():
    assert chat.violations({"q": "x", "n": 5, "tags": ["a"]}, SCHEMAS["find"]) == []
    assert chat.violations({"n": 9, "tags": ["c"], "z": 1}, SCHEMAS["find"]) == ["$.q: missing", "$.n: above maximum", "$.tags[0]: not in enum", "$.z: unknown"]
    assert chat.violations({"q": True, "n": True}, SCHEMAS["find"]) == ["$.n: not integer", "$.q: not string"]
    assert chat.violations([], SCHEMAS["find"]) == ["$: not object"] and chat.violations({"q": "${c1}", "n": "${c2}"}, SCHEMAS["find"]) == []


def test_topological_order():
    named = lambda *ids: [{"id": i, "arguments": {"q": q}} for i, q in ids]
    order = lambda c: ([x["id"] for x in chat.topological(c)[0]], chat.topological(c)[1])
    assert order(named(("c", "${b}"), ("a", "x"), ("b", "${a} ${zz}"))) == (["a", "b", "c"], True)
    assert order(named(("a", "${b}"), ("b", "${a}"))) == (["a", "b"], False)
    assert order(named(("a", "${a}"), ("b", ""))) == (["a", "b"], False)
    assert order(named(("a", ""), ("b", "${a}"), ("a", "x"))) == (["a", "a", "b"], True)


def test_canonical():
    assert chat.canonical({"b": [1, 2.5, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.5,null]}'
    assert chat.loads("NaN") is None and chat.loads("[" * 100_000) is None and chat.loads('{"a":1}') == {"a": 1}


def test_long_chains_are_ordered():
    n = 20_000
    chain = [{"id": f"c{k}", "arguments": {"q": f"${{c{k + 1}}}" if k + 1 < n else ""}} for k in range(n)]
    assert [c["id"] for c in chat.topological(chain)[0]] == [f"c{k}" for k in range(n - 1, -1, -1)]


def test_what_utf8_and_json_cannot_hold(spark):
    """Lone surrogates stay escapes, numbers beyond a double are no JSON."""
    texts = [("assistant", '{"tool_calls": [{"id": "\\ud800", "name": "find", "arguments": {"q": "\\udfff", "\\ud801": 1}}]}'), ("tool", '{"tool_call_id": "\\ud800", "content": "\\ud83d\\ude00 \\ud83d"}'), ("tool", '{"tool_call_id": "c", "content": 1e999}'), ("assistant", calls({"id": "a", "name": "find", "arguments": '{"n": -1e999}'}))]
    got = {r.turn: r for r in chat.link(spark.createDataFrame([(1, k, *x) for k, x in enumerate(texts)], "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert got[1].status == "result" and json.loads(got[1].message)["content"] == "\U0001f600 \ud83d" and r"\ud83d" in got[1].message
    assert json.loads(got[0].message)["tool_calls"][0]["arguments"] == {"q": "\udfff", "\ud801": 1}
    assert got[2].status == "plain" and "Infinity" not in got[2].message and got[3].errors == "a: arguments are no JSON"


def messages(spark):
    data = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", calls(call("c2", "${c1}"), call("c1", n=9))),
        (1, 2, "tool", result("c2", "second")),
        (1, 3, "tool", result("c1", {"b": 1, "a": [2]})),
        (1, 4, "tool", result("zz")),
        (1, 5, "assistant", "done"),
        (2, 0, "assistant", calls(call("c1", name="other"), {"id": "c9", "name": "find", "arguments": "no json"}, {"id": "c8", "name": "find", "arguments": {"q": "y"}})),
        (2, 1, "tool", result("c1")),
        (2, 2, "tool", result("c1", "again")),
        (2, 3, "assistant", calls(call("c1"))),
        (2, 4, "assistant", calls()),
        (3, 0, None, None),
        (3, 1, "assistant", '{"tool_calls": "x"}'),
        (3, 2, "tool", "{broken"),
        (3, 3, "user", calls(call("c1"))),
        (3, 4, "user", "x" * 500_000),
        (None, 0, "assistant", calls(call("c1"))),
        (None, 1, "tool", result("c1")),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in data], "conv_id long, turn long, role string, text string, body string, n long")


def test_link(spark):
    got = sorted(chat.link(messages(spark), SCHEMAS).collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.order_turn, r.order_pos))
    assert [(r.turn, r.status) for r in got if r.conv_id == 1] == [(0, "plain"), (1, "calls"), (3, "result"), (2, "result"), (4, "orphan"), (5, "plain")]
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].errors == "c1: $.n: above maximum" and (by[1, 1].n_calls, by[1, 1].n_answered) == (2, 2)
    assert by[1, 3].message == '{"call":{"name":"find","turn":1},"content":{"a":[2],"b":1},"role":"tool","tool_call_id":"c1"}'
    assert [c["id"] for c in json.loads(by[1, 1].message)["tool_calls"]] == ["c1", "c2"]
    assert by[2, 0].errors == "c1: unknown tool; c9: arguments are no JSON" and by[2, 0].n_answered == 1
    assert (by[2, 1].order_turn, by[2, 2].order_turn, by[2, 3].n_answered) == (0, 0, 0)
    assert by[2, 4].n_calls == 0 and by[2, 4].status == "plain"
    assert by[3, 0].message == '{"content":null,"role":null}' and [by[3, k].status for k in range(5)] == ["plain"] * 5
    assert by[None, 0].n_answered == 0 and by[None, 1].status == "orphan"
    for r in got:
        assert chat.canonical(json.loads(r.message)) == r.message


def test_edges(spark):
    m = messages(spark)
    assert chat.link(m.limit(0), SCHEMAS).count() == 0
    twice = chat.link(m.unionByName(m), SCHEMAS)
    assert twice.count() == 2 * m.count()
    assert set(plain.rows(twice, "conv_id", "turn", "status")) == set(plain.rows(chat.link(m, SCHEMAS), "conv_id", "turn", "status"))


def test_a_hot_identifier_is_not_gathered(spark):
    rows = [(1, 0, "assistant", calls(call("c1")))] + [(1, k, "tool", result("c1")) for k in range(1, 20_001)]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS)
    assert got.where("status = 'result' and order_turn = 0 and order_pos = 1").count() == 20_000


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query(spark):
    said = spark.read.parquet(f"{plain.SMALL}/conversations.parquet").collect()
    want = sorted(((r.conv_id, r.turn, chat.canonical({"role": r.role, "content": r.text})) for r in said if not (r.text or "").lstrip().startswith("{")), key=repr)
    got = queries.op4_tool_call_linking(spark, plain.SMALL)
    assert got.count() == len(said) and set(want) <= set(plain.rows(got, "conv_id", "turn", "message"))


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_calls_against_sql(spark):
    got, want = plain.against_sql(spark, queries.tool_calls_linked, queries.LINKED_SQL)
    assert got == want and len(got) > 100
