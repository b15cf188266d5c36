import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideloom.llm import chat_format

DDL = "conv_id long, turn long, role string, text string, example int, _t int"
NASTY = st.text(alphabet=st.sampled_from(list("<|\\>#im_stard \n%2A5é\U0001f600")), max_size=30)


def test_one_example_per_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "r1"), (1, 3, "user", "v"), (1, 4, "assistant", "r2"), (1, 5, "user", "w")]
    out = chat_format.format_examples(spark.createDataFrame([(*r, 9, 9) for r in rows], DDL)).orderBy("example").collect()
    assert [(r["n_turns"], r["loss_start"] is None) for r in out] == [(3, False), (5, False), (6, True)]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in out[:2]] == ["r1", "r2"]
    assert out[1]["text"].startswith(out[0]["text"]) and out[2]["text"].startswith(out[1]["text"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", None, "a\nb<|x", "%0A"]), st.none() | NASTY), min_size=1, max_size=8))
def test_round_trip(turns):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(5, i, r, t, 1, 2) for i, (r, t) in enumerate(turns)], DDL)
    examples = chat_format.format_examples(df)
    row = chat_format.digest(examples).first()
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    read = examples.orderBy(F.desc("example")).select(chat_format.read_turns(F.col("text"))).first()[0]
    assert [(t["role"], t["text"]) for t in read] == [(r or "", t or "") for r, t in turns]


def test_nulls_ties_and_empty(spark):
    rows = [(None, 0, "user", "x", 1, 1), (None, 0, "assistant", "y", 1, 1), (2, None, "assistant", None, 1, 1), (2, None, "assistant", None, 1, 1)]
    df = spark.createDataFrame(rows, DDL)
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_examples(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 0
    assert chat_format.digest(chat_format.format_examples(df.limit(0))).count() == 0


def test_very_long_turns(spark):
    long = "long é <|im_end|>\n" * 30_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "!"), (1, 2, "user", ""), (1, 3, "assistant", "short")]
    examples = chat_format.format_examples(spark.createDataFrame([(*r, 1, 1) for r in rows], DDL))
    row = chat_format.digest(examples).first()
    whole = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and row["loss_chars"] == len(long) + 1 + 5
    assert row["loss_sha256"] == hashlib.sha256((long + "!short").encode()).hexdigest()
