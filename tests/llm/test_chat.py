import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.llm import chat
from tests.llm import cases

TEXT = st.lists(st.sampled_from(["### ", "</turn>", "\\", "\n", ": ", "<", "#", "h", "é", "assistant", " "]), max_size=10).map("".join)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
@settings(max_examples=150, deadline=None)
def test_what_is_read_back_is_what_went_in(turns):
    made = [chat.segment(role, text) for role, text in turns]
    whole = "".join(m[0] for m in made)
    assert list(chat.parse(whole)) == turns
    assert whole.count(chat.CLOSE) == whole.count("### ") == len(turns)
    for (role, text), (part, start, n) in zip(turns, made, strict=True):
        assert (n >= 0) == (role == chat.LEARNED)
        if n >= 0:
            assert chat.unescape(part[start : start + n]) == text


def test_layouts_become_the_same_turns():
    asked = [("user", "q"), ("assistant", "a")]
    for record in [
        {"conv_id": 1, "prompt": "q", "response": "a"}, {"conv_id": 1, "instruction": "q", "output": "a"}, {"conv_id": 1, "question": "q", "answer": "a"},
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conv_id": 1, "conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]},
        {"response": "a", "prompt": "q"},
    ]:
        assert chat.turns(record) == asked
    assert chat.turns({"instruction": "q", "input": "x", "output": "a"}) == [("user", "q"), ("user", "x"), ("assistant", "a")]
    assert chat.turns({"conv_id": 1, "text": "q"}) is None
    assert chat.schema_fingerprint({"a": {"b": 1}, "c": [{"d": 2}, {"e": 3}]}) == chat.schema_fingerprint({"c": [{"e": 0, "d": 0}], "a": {"b": None}})


def test_unknown_and_broken_records_are_set_aside(spark):
    raw = [json.dumps({"prompt": "q", "conv_id": 4}), json.dumps({"what": 1}), "{", "[]", None]
    got = chat.format_records(spark.createDataFrame([(r, 1) for r in raw], "record string, conv_id int")).collect()
    assert sorted(r.rejected for r in got if r.rejected is not None) == sorted(["", json.dumps({"what": 1}), "{", "[]"])
    assert [(r.conv_id, r.segment) for r in got if r.rejected is None] == [(4, "### user: q </turn>\n")]


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "a # b"), (1, 1, "assistant", None), (1, 2, "assistant", "\\h </turn>\n"), (2, 0, None, "x"), (2, None, "tool: x\n", "y"), (None, 0, "user", "z"), (3, 0, "assistant", "é" * 5000), (3, 0, "assistant", "é" * 5000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.row_records(df))).collect()}
    order = {1: rows[:3], 2: [rows[4], rows[3]], None: [rows[5]], 3: rows[6:]}
    for conv, turns in order.items():
        turns = [(role or "", text or "") for _, _, role, text in turns]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.segment(*t)[0]) for t in turns)
    assert cases.collect(chat.read_back(chat.format_records(chat.row_records(df.where("conv_id = 77"))))) == []
