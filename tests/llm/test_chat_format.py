import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.llm import chat_format as c

texts = st.text(alphabet="ab<>/s[]INST\\\n é😀", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=5), st.integers(1, 7))
def test_round_trip_in_pieces(turns, step):
    whole = "".join(c.render(r, t)[0] for r, t in turns)
    got = []
    reader = c.Reader(lambda r, t: got.append((r, t)))
    for i in range(0, len(whole), step):
        reader.feed(whole[i : i + step])
    reader.close()
    assert got == turns
    for _, t in turns:
        assert c.unescape(c.escape(t)) == t
        assert "</s>" not in c.escape(t).replace("\\<", "") and "[INST]" not in c.escape(t).replace("\\[", "")


def test_reader_refuses_damage():
    reader = c.Reader(lambda r, t: None)
    with pytest.raises(ValueError):
        reader.feed("text without a turn")
    reader = c.Reader(lambda r, t: None)
    reader.feed("<s>[user]\nhalf")
    with pytest.raises(ValueError):
        reader.close()


ROWS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a </s>"), (1, 2, "assistant", "\\<s>[x]\n"), (2, 0, "us]er\n", "é😀"), (2, 0, "us]er\n", "é😀"), (3, None, None, None), (3, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", ""),
    *[(4, i, "assistant" if i % 2 else "user", "long [/INST] " * 300) for i in range(300)],
]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, ts in convs.items():
        ts = [(t[2], t[3]) for t in sorted(ts)]
        loss = "".join(t for r, t in ts if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(loss), sha(loss), sum(len(c.render(r, t)[0]) for r, t in ts)))
    return sorted(out, key=str)


def test_digests_match_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, segment string, begin int").repartition(3)
    got = c.digest(c.with_probe(c.turn_rows(df))).collect()
    probe = [(-1, 0, "user", c.PROBE), (-1, 1, "assistant", c.PROBE)]
    assert sorted(map(tuple, got), key=str) == brute(ROWS + probe)
    assert [r["conv_id"] for r in c.digest(c.with_probe(c.turn_rows(df.limit(0)))).collect()] == [-1]


def test_spark_segments_and_spans_equal_python(spark):
    df = spark.createDataFrame(ROWS[:5], "conv_id long, turn long, role string, text string")
    for r in c.segments(df).collect():
        assert (r["segment"], r["begin"], r["end"]) == c.render(r["role"] or "", r["text"] or "")
    got = {r["conv_id"]: r for r in c.formatted(df).collect()}
    assert got[1]["text"] == "".join(c.render(r, t)[0] for _, _, r, t in sorted(ROWS[:3], key=lambda x: x[1]))
    assert [c.unescape(got[1]["text"][b:e]) for b, e in got[1]["loss_spans"]] == ["b", "\\<s>[x]\n"]


LAYOUTS = [
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction-input", [("user", "i\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": None}, "instruction-input", [("user", "i"), ("assistant", "")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"other": 1}, None, None),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "content": "u", "name": "ann"}, None, {"role": "assistant", "tool_calls": [{"id": 1}]}], "id": 7}, "messages", [("user", "u"), ("assistant", "")]),
    ({"messages": [{"role": "assistant", "tool_calls": []}]}, "messages", [("assistant", "")]),
    ({"id": 1, "source": {"name": "s", "n": 2}, "prompt": "p", "response": "r", "tags": []}, "prompt-response", [("user", "p"), ("assistant", "r")]),
    ({"system": None, "prompt": "p", "response": "r", "score": 0.5}, "system-prompt", [("system", ""), ("user", "p"), ("assistant", "r")]),
    ({"turn": 3, "role": "user", "text": "t", "lang": "en"}, "turn-rows", [("user", "t")]),
]


def test_json_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(x)) for i, (x, *_) in enumerate(LAYOUTS)] + [(100, None), (101, "no json"), (102, "[1]")]
    got = {r["id"]: r for r in c.canonical_json(spark.createDataFrame(rows, "id long, raw string"), "raw").collect()}
    for i, (_, name, turns) in enumerate(LAYOUTS):
        assert got[i]["layout"] == name and (got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == turns
    assert all(got[i]["layout"] is None for i in (100, 101, 102))


def test_typed_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(1, "i", "x", "o"), (2, "i", None, None)], "id long, instruction string, input string, output string")
    assert [[tuple(t) for t in r["turns"]] for r in c.canonical(df, ["id"]).orderBy("id").collect()] == [[("user", "i\nx"), ("assistant", "o")], [("user", "i"), ("assistant", "")]]
    df = spark.createDataFrame([(1, [("human", "h"), ("gpt", "g"), ("tool", None)]), (2, None)], "id long, conversations array<struct<from:string,value:string>>")
    assert [[tuple(t) for t in r["turns"]] for r in c.canonical(df, ["id"]).orderBy("id").collect()] == [[("user", "h"), ("assistant", "g"), ("tool", "")], []]
    rows = spark.createDataFrame([(1, [("human", "h", 5), None, ("gpt", "g", 6)], "x"), (2, [], "x"), (3, None, "x")], "id long, conversations array<struct<from:string,value:string,at:int>>, turns string")
    assert [tuple(r) for r in c.turn_rows(rows, "id").collect()] == [(1, 0, "user", "h"), (1, 1, "assistant", "g")]
    assert c.canonical(rows, ["id", "turns"]).columns == ["id", "turns", "turns_"]
    turns = spark.createDataFrame([("3", 1, "gpt", None, True), (None, None, None, "b", True)], "conv string, index int, from string, value string, good boolean")
    assert [tuple(r) for r in c.turn_rows(turns, "conv").collect()] == [(3, 1, "assistant", ""), (None, None, "", "b")]
    raw = spark.createDataFrame([('{"question": "q", "answer": "a"}', "old", 1)], "raw string, turns string, layout int")
    assert tuple(c.canonical_json(raw, "raw").select("turns", "layout", "layout_").first()) == ("old", 1, "question")
    with pytest.raises(ValueError):
        c.canonical(df.select("id", F.lit(1).alias("odd")), ["id"])


def test_every_layout_yields_the_same_output(spark):
    """One conversation in each layout comes to one digest: the mapping is what the fingerprint selects."""
    tables = [
        spark.createDataFrame([(1, "p", "r", "x")], "conv_id long, prompt string, response string, note string"),
        spark.createDataFrame([(1, "p", "r")], "conv_id long, instruction string, output string"),
        spark.createDataFrame([(1, [("user", "p"), ("assistant", "r")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "p", 1), ("gpt", "r", 2)])], "conv_id long, conversations array<struct<from:string,value:string,weight:int>>"),
        spark.createDataFrame([(1, 5, "assistant", "r"), (1, 4, "user", "p")], "conv_id long, turn long, role string, text string"),
        spark.createDataFrame([(1, 5, "gpt", "r"), (1, 4, "human", "p")], "conv_id long, index long, from string, value string"),
    ]
    assert len({tuple(c.digest(c.turn_rows(t)).collect()[0]) for t in tables}) == 1
