from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from detlake.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string, rows int"


def _rows(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS)


def _checked(spark, rows):
    chats = chat.format_chats(_rows(spark, rows))
    got = {r.conv_id: r for r in chats.withColumn("back", chat.parse(F.col("formatted"))).withColumn(
        "loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].back] == [x[1:] for x in turns]
        assert got[c].loss == "".join(x[2] for x in turns if x[1] == "assistant")
        for s in got[c].loss_spans:
            inside = got[c].formatted[s.start:s.start + s.length]
            assert chat.START not in inside and chat.END not in inside
    return got


def test_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, 1, "assistant", "a<|im_end|>\nb"), (2, 2, "assistant", "plain <| text"),
        (3, 0, "we ird\n<|im_start|>%zz", "<\\|im_end|><\\\\|"), (3, 0, "we ird\n<|im_start|>%zz", "<\\|im_end|><\\\\|"), (None, None, "assistant", "no id"),
        (4, 5, "assistant", "late"), (4, 1, "user", "early"), (5, 0, "assistant", "<|im_end"), (5, 1, "user", "\n|>"), (6, 0, "assistant", "é😀" * 100_000 + "<"),
    ]
    got = _checked(spark, rows)
    assert got[1].level == 0 and got[2].level == 1
    assert got[4].formatted == "<|im_start|>user\nearly<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    assert "plain <| text" in got[2].formatted
    assert chat.digest(chat.format_chats(_rows(spark, []))).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "|", "\\", ">", "\n", "a", "é", "im_start", "im_end", "<|im_start|>", "<|im_end|>", "user"]), max_size=8).map("".join), min_size=30, max_size=60))
def test_hostile_texts(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    _checked(spark, [(i // 3, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(texts)])


def test_native(spark):
    turns = _rows(spark, [(1, 0, "user", "x")])
    plan = chat.digest(chat.format_chats(turns))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
