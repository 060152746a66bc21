from pyspark.sql import functions as F

from sparklog.llm import chat

ROWS = [
    (1, 0, "user", "\\### Assistant: </turn> <turn x>\\ ok\\\n"), (1, 1, "assistant", "a</turn>\n<\\/turn>\\"), (2, 0, "sys>\\tem\n", None), (2, 1, "assistant", ""), (2, 2, "assistant", "é😀x"),
    (3, 0, "user", "q"), (3, 1, "assistant", None), (None, 0, None, "z"), (4, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "human", "h"), (5, 1, "gpt", "g"), (7, 0, "user", "long " * 50_000),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_round_trip_and_mask(spark):
    c = spark.createDataFrame(ROWS, SCHEMA).withColumn("v", F.lit(1)).withColumn("record", F.lit("no"))
    out = chat.format_records(chat.conversation_records(c)).withColumn("back", chat.parsed(F.col("formatted"))).withColumn("mask", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    for conv in {r[0] for r in ROWS}:
        own = sorted(((t, r or "", x or "") for i, t, r, x in ROWS if i == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["back"]] == [(r, x) for _, r, x in own]
        assert got[conv]["mask"] == "".join(x for _, r, x in own if r == "assistant")
    assert {got[i]["layout"] for i in (1, 2, 4, 5)} == {"instruction", "messages", "messages"} | {got[4]["layout"]}
    assert chat.format_records(chat.conversation_records(c.limit(0))).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"prompt":"a","completion":"b"}', '{"response":"b","prompt":"a"}',
        '{"instruction":"a","input":"","output":"b"}', '{"prompt":null,"response":"b"}', '{"messages":[]}', '{"other":1}', "no json", None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
    got = {r["i"]: r for r in chat.canonical_turns(df).collect()}
    assert [got[i]["layout"] for i in range(10)] == ["messages", "conversations", "prompt", "prompt", "instruction", "prompt", "messages", None, None, None]
    assert all([tuple(t) for t in got[i]["turns"]] == [("user", "a"), ("assistant", "b")] for i in range(5))
    assert [tuple(t) for t in got[5]["turns"]] == [("user", ""), ("assistant", "b")] and got[6]["turns"] == [] and got[7]["turns"] is None


def test_no_python_on_the_main_path(spark):
    c = spark.createDataFrame(ROWS, SCHEMA)
    plan = chat.format_records(chat.conversation_records(c))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
