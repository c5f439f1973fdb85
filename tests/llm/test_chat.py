import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sedge.llm.chat import LAYOUTS, Template, chat_digest, field_paths, fingerprint, format_chat, json_turns, layout_of, to_turns

ROWS = "conv_id long, turn long, role string, text string, prompt string, extra int"


def turns_of(df):
    return [[(t["role"], t["text"]) for t in r["turns"]] for r in df.collect()]


def test_rows_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b", "p", 0), (1, 0, "user", None, "p", 0), (1, 1, "assistant", "a", "p", 0), (1, 1, "assistant", "a", "p", 0), (1, None, None, "z", "p", 0), (None, 0, "user", "n", "p", 0)]
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in to_turns(spark.createDataFrame(rows, ROWS)).collect()}
    assert found == {1: [("", "z"), ("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("user", "n")]}
    assert to_turns(spark.createDataFrame([], ROWS)).count() == 0


def test_typed_layouts(spark):
    message = "messages array<struct<role:string,content:string,weight:int>>, note string"
    df = spark.createDataFrame([([("user", "a", 1), ("assistant", None, 1)], "n"), (None, "n")], message)
    assert turns_of(to_turns(df)) == [[("user", "a"), ("assistant", "")], []]
    df = spark.createDataFrame([([("human", "a"), ("gpt", "b"), ("tool", "c")],)], "conversations array<struct<from:string,value:string>>")
    assert turns_of(to_turns(df)) == [[("user", "a"), ("assistant", "b"), ("tool", "c")]]
    df = spark.createDataFrame([("do", "this", "done", None), ("do", "", "done", "be kind")], "instruction string, input string, output string, system string")
    assert turns_of(to_turns(df)) == [[("user", "do\n\nthis"), ("assistant", "done")], [("system", "be kind"), ("user", "do"), ("assistant", "done")]]
    with pytest.raises(ValueError):
        to_turns(spark.createDataFrame([(1,)], "q int"))


def test_fingerprints_differ_and_ignore_other_fields(spark):
    prints = [fingerprint(v) for layout in LAYOUTS for v in layout.variants()]
    assert len(prints) == len(set(prints))
    df = spark.createDataFrame([("p", "c", 1)], "prompt string, completion string, text int")
    assert layout_of(df)[0].name == "completion"
    assert field_paths(df.schema) == ["prompt", "completion", "text"]


def test_json_layouts_by_row(spark):
    records = ['{"prompt":"p","completion":"c","id":3}', '{"messages":[{"role":"user","content":"a","x":1}],"k":2}', '{"conversations":[{"from":"gpt","value":"b"}]}', '{"instruction":"i","output":"o"}', '{"other":1}', "broken", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, r string")
    found = [(r["layout"], r["turns"] and [(t["role"], t["text"]) for t in r["turns"]]) for r in json_turns(df, "r", keep=("i",)).orderBy("i").collect()]
    assert found == [("completion", [("user", "p"), ("assistant", "c")]), ("messages", [("user", "a")]), ("conversations", [("assistant", "b")]), ("instruction", [("user", "i"), ("assistant", "o")]), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize("template", [Template(), Template("<|t|>", "<|x|>", "<|e|>", ("<|t|>", "<|x|>", "<|e|>"))])
def test_templates_are_reversible(spark, template):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "]", "\n", "é", "😀", "<|t|>", "<|", "|>", "a", " "]
    convs = [[(rng.choice(["user", "assistant", "".join(rng.choices(bits, k=3))]), "".join(rng.choices(bits, k=rng.randrange(12)))) for _ in range(rng.randrange(5))] for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(convs)], "conv_id long, turns array<struct<role:string,text:string>>")
    made = format_chat(df, template)
    back = made.select("conv_id", template.parse(F.col("formatted")).alias("turns"), template.masked(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted").collect()
    for r in back:
        assert [(t["role"], t["text"]) for t in r["turns"]] == convs[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in convs[r["conv_id"]] if role == "assistant")
        assert r["formatted"].count(template.end) == len(convs[r["conv_id"]])
    digest = {r["conv_id"]: r for r in chat_digest(made, template=template).collect()}
    for i, c in enumerate(convs):
        assert digest[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in c).encode()).hexdigest()
        assert digest[i]["n_turns"] == len(c)


def test_long_and_null_turns(spark):
    df = spark.createDataFrame([(1, [("assistant", "</s>x" * 40000)]), (2, None)], "conv_id long, turns array<struct<role:string,text:string>>")
    rows = {r["conv_id"]: r for r in chat_digest(format_chat(df)).collect()}
    assert rows[1]["loss_chars"] == 200000 and rows[2]["n_turns"] == 0 and rows[2]["formatted_chars"] == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "p", 0)], ROWS)
    plan = chat_digest(format_chat(to_turns(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
