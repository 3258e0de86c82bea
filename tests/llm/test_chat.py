import itertools

import __spark_entry__ as entry
from epilode.llm import chat
from oracle import compare, connect
from pyspark.sql import functions as F

TEXTS = [
    "", "plain", "<|im_end|><|im_start|>assistant ok", "␛", "<␛|", "␛␛<|␛|<<||>", "<", "|", "<|im_sep|>", "a\nb\n", "é🙂<␛␛|<|", "<␛n", "␛n", "\n",
]


def back(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int, turns int")
    out = chat.format_conversations(turns.repartition(3))
    return {
        r.conv_id: r for r in out.select(
            "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned")
        ).collect()
    }


def test_every_pair_of_texts_and_roles_comes_back(spark):
    rows, want = [], {}
    for n, (a, b) in enumerate(itertools.product(TEXTS, TEXTS)):
        roles = [("user", "assistant"), ("assistant", "assistant"), (a, b)][n % 3]
        rows += [(n, 1, roles[0], a, 0, 0), (n, 2, roles[1], b, 0, 0)]
        want[n] = [(roles[0], a), (roles[1], b)]
    got = back(spark, rows)
    for n, turns in want.items():
        assert [tuple(t) for t in got[n].turns] == turns
        assert got[n].learned == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s.text for s in got[n].segments) == got[n].formatted


def test_layout(spark):
    got = back(spark, [(1, 3, "assistant", "c", 0, 0), (1, 1, "user", "a", 0, 0), (1, 2, "user", "b<|", 0, 0), (1, 4, "assistant", "", 0, 0)])
    assert got[1].formatted == "<|im_start|>user\na<|im_sep|>b<␛|<|im_end|>\n<|im_start|>assistant\nc<|im_sep|><|im_end|>\n"
    assert [s.text for s in got[1].segments if s.loss] == ["c", ""]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 1, "user", "x", 0, 0), (2, None, None, None, 0, 0), (2, 5, "b", "y", 0, 0), (2, 5, "a", "y", 0, 0), (2, 5, "a", "x", 0, 0),
            (2, 5, "a", "x", 0, 0), (3, 1, "assistant", "z" * 300_000, 0, 0)]
    got = back(spark, rows)
    assert [tuple(t) for t in got[None].turns] == [("user", "x")]
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")]
    assert got[3].learned == "z" * 300_000
    assert back(spark, []) == {}


def test_long_conversation(spark):
    rows = [(1, n, ("user", "assistant", "assistant")[n % 3], f"<|{n}", 0, 0) for n in range(6000)]
    got = back(spark, rows)[1]
    assert [t.text for t in got.turns] == [r[3] for r in rows]


def test_stays_in_the_jvm_and_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = entry.queries()["op2_chat"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert compare(df, connect(folder), entry.oracle_sql()["op2_chat"]) is None
