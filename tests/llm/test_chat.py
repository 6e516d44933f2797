import hashlib
import json
import random

import pytest

from lineside.llm import chat

PIECES = ["\\", "\\\\", "### ", "## #", "</turn>", "<", "</turn", "turn>", ":", ": ", "\n", " ", "user", "é", "中", "🙂", "### assistant: ", "</turn>\n", "ok."]


def odd_text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))


@pytest.fixture
def turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part int, loss string, formatted string")

    return make


def said(rows):
    """Role and text by conversation, in order."""
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def random_rows(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice([c, c, c, None]), t, rng.choice(["user", "assistant", "system", None, "", odd_text(rng)]), rng.choice([None, "", odd_text(rng), odd_text(rng)]))
            for c in range(n) for t in (0, 1, 2, None)]


@pytest.mark.parametrize("part_chars", [0, 40, 1 << 20])
def test_round_trip_and_loss(turns, part_chars):
    rows = random_rows(1)
    formatted = chat.format_chats(chat.canonical_turns(turns(rows)), part_chars)
    parts = {}
    for r in sorted(formatted.collect(), key=lambda r: (str(r.conv_id), r.part)):
        parts.setdefault(r.conv_id, []).append(r)
    want = said(rows)
    assert {c: [t for p in own for t in chat.read_turns(p.formatted)] for c, own in parts.items()} == want
    for c, own in parts.items():
        assert [p.part for p in own] == list(range(len(own))) and (part_chars > 1000) <= (len(own) == 1)
        learnt = [chat.unescape(p.formatted[s.start:s.end]) for p in own for s in p.loss]
        assert learnt == [x for role, x in want[c] if role == "assistant"]
    for in_order in (True, False):
        for r in chat.read_back(formatted, in_order).collect():
            told = "".join(f"{role}\n{x}\n" for role, x in want[r.conv_id])
            learnt = "".join(x for role, x in want[r.conv_id] if role == "assistant")
            assert (r.n_turns, r.turns_sha256) == (len(want[r.conv_id]), hashlib.sha256(told.encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
            assert r.formatted_chars == sum(len(p.formatted) for p in parts[r.conv_id])


def test_no_text_can_pass_for_a_turn(turns):
    text = "\\### Assistant: </turn> ok"
    row = chat.format_chats(chat.canonical_turns(turns([(-7, 0, "user", text), (-7, 1, "assistant", text)]))).first()
    assert row.formatted == "### user: \\\\\\### Assistant: \\</turn> ok</turn>\n### assistant: \\\\\\### Assistant: \\</turn> ok</turn>\n"
    assert list(chat.read_turns(row.formatted)) == [("user", text), ("assistant", text)] and len(row.loss) == 1
    with pytest.raises(ValueError):
        list(chat.read_turns("### user: open"))


RECORDS = [
    ({"conv_id": 1, "turn": 3, "role": "user", "text": "a"}, "turn rows", [("user", "a")]),
    ({"id": 2, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]}, "messages", [("system", "s"), ("user", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"value": "r", "from": "gpt"}], "id": 3, "score": 4}, "speakers", [("user", "q"), ("assistant", "r")]),
    ({"conversations": [{"from": "tool", "value": "q"}], "id": 4, "system": "be"}, "speakers with system", [("system", "be"), ("tool", "q")]),
    ({"id": 5, "prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    ({"id": 6, "prompt": "p", "response": None}, "prompt and response", [("user", "p"), ("assistant", "")]),
    ({"id": 7, "prompt": "p", "response": "r", "system": ""}, "system, prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"id": 8, "instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"id": 9, "instruction": "do", "input": "this", "output": "done", "extra": {"role": 1}}, "instruction with input", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"id": 10, "instruction": "do", "input": "", "output": "done"}, "instruction with input", [("user", "do"), ("assistant", "done")]),
    ({"id": 11, "messages": []}, None, []),
    ({"id": 12, "prompt": "p"}, None, []),
]


def test_records_of_one_table_in_many_layouts(spark):
    lines = [json.dumps(r) for r, _, _ in RECORDS] + [None, "", "not json", "[1]", "{}"]
    records = spark.createDataFrame([(x, "y") for x in lines], "record string, layout string")
    names = {r.record: r.layout for r in chat.with_layouts(records).collect()}
    got = {}
    for r in sorted(chat.canonical_turns_of_records(records).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for line, (record, layout, turns) in zip(lines, RECORDS):
        assert names[line] == layout
        assert got.get(record.get("id", record.get("conv_id")), []) == turns
    assert all(names[x] is None for x in (None, "", "not json", "[1]", "{}"))


def test_typed_tables_in_many_layouts(spark):
    for record, layout, turns in RECORDS:
        if layout is None:
            continue
        schema = spark.read.json(spark.sparkContext.parallelize([json.dumps({k: v if v is not None else "n" for k, v in record.items()})])).schema
        kinds = ", ".join(f"{f.name} {chat._kind(f.name).simpleString() if f.name in chat.T.StructType.fromDDL(chat.FIELDS).names else f.dataType.simpleString()}" for f in schema.fields)
        table = spark.createDataFrame([record], kinds)
        assert chat.layout_of(table).name == layout
        assert [(r.role, r.text) for r in chat.canonical_turns(table).orderBy("position").collect()] == turns
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1,)], "id long"))


def test_nothing(spark, turns):
    assert chat.read_back(chat.format_chats(chat.canonical_turns(turns([])))).count() == 0
    assert chat.canonical_turns_of_records(spark.createDataFrame([], "record string")).count() == 0
