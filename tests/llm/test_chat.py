"""Chat formatting: layouts, escapes and a round trip."""

import hashlib
import json

from pyspark.sql import functions as F

from manyview.llm import chat

NASTY = ["", "</s>", "<\\s>[INST]", "[/INST] [INST] <s>\\", "<\\\\\\/s>", "a [/INST]b</s></s>", "x\ny é", "[" * 50 + "INST]" * 3, "<" * 9]


def test_round_trip(spark):
    rows = [(1, t, ("user", "assistant", "system", "[/INST]", None)[t % 5], NASTY[t % len(NASTY)]) for t in range(45)]
    rows += [(2, 0, "assistant", None), (None, 0, "user", "hi"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "assistant", "z"), (3, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.format_chat(chat.records_of(df))
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r, t) for _, r, t in mine]
        assert back[conv]["loss_text"] == "".join(t for _, r, t in mine if r == "assistant")
    assert chat.format_chat(chat.records_of(df.filter("false"))).count() == 0


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
        ({"dialog": [{"speaker": "tool", "text": "q"}]}, "dialog", [("tool", "q")]),
        ({"prompt": "q", "response": "a"}, "prompt_response", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "q", "output": None}, "instruction", [("user", "q"), ("assistant", "")]),
        ({"instruction": "s", "input": "q", "output": "a"}, "instruction_input", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"something": {"else": [1]}}, None, []),
        ({"messages": []}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(records)], "conv_id long, j string").select("conv_id", F.parse_json("j").alias("record"))
    got = {r["conv_id"]: r for r in chat.canonical(df).collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i]["layout"] == layout
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == turns


def test_probe(spark, tmp_path):
    spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = chat.op3_chat_format(spark, str(tmp_path)).filter("conv_id = -7").first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len(chat.PROBE) and r["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()
