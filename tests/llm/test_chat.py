import hashlib
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxolink.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string"


def _part(kind="text", text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def _read(out):
    return out.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("trained"))


def test_typed_parts_become_ordered_placeholders(spark):
    rows = [
        (1, 0, "user", [_part(text="look: "), _part("image", ref="a.png", width=28, height=15), _part(text=" and "),
                        _part("audio", ref="b.wav", seconds=1.5), None], "clash"),
        (1, 1, "assistant", [_part(text="ok <|image:0|> &amp;"), _part("document", ref="c.pdf", pages=3),
                             _part(text="!")], "clash"),
        (1, 2, "user", None, "clash"),
        (1, 3, "tool", [_part("video", ref="d"), _part(None, "plain")], "clash")]
    r = _read(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert r.formatted == (
        "<|turn|>user<|body|>look: <|image:0|> and <|audio:1|><|end|>"
        "<|turn|>assistant<|body|>ok &lt;|image:0|> &amp;amp;<|document:2|>!<|end|>"
        "<|turn|>user<|body|><|end|><|turn|>tool<|body|><|document:3|>plain<|end|>")
    assert [(a.number, a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, 0, "image", "a.png", 4), (1, 0, "audio", "b.wav", math.ceil(1.5 * 25)), (2, 1, "document", "c.pdf", 1536),
        (3, 3, "document", "d", 512)]
    assert r.placeholder_tokens == sum(a.tokens for a in r.attachments)
    assert r.trained == ["ok <|image:0|> &amp;", "!"]


TEXT = st.text(alphabet="<>|&;ampltbodyturn\\/# é😀\n", max_size=30)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), TEXT), min_size=1, max_size=40))
def test_round_trip(spark, turns):
    rows = [(5, i, role, text) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    r = _read(chat.format_chats(df.withColumn("parts", chat.text_parts(F.col("text"))))).first()
    assert [(t.role, t.body) for t in r.turns] == turns
    assert r.trained == [t for role, t in turns if role == "assistant" and t]


def test_nulls_ties_repeats_long_and_empty(spark):
    long = "x<" * 200_000
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, "assistant", long),
            (None, 3, "user", "n"), (2, 1, "user", "r"), (2, 1, "user", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("parts", chat.text_parts(F.col("text")))
    out = {r.conv_id: r for r in _read(chat.format_chats(df)).collect()}
    assert [(t.role, t.body) for t in out[1].turns] == [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", long)]
    assert out[1].trained == ["a", "b", long]
    assert len(out[None].turns) == 1 and len(out[2].turns) == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_thousands_of_turns_in_one_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"),
                                  chat.text_parts(F.concat(F.lit("t<"), F.col("id"))).alias("parts"))
    r = _read(chat.format_chats(df)).first()
    assert len(r.turns) == 3000 and "".join(r.trained) == "".join(f"t<{i}" for i in range(1, 3000, 2))


def test_op1_has_the_planted_conversation(spark, sf_dir):
    import __spark_entry__ as entry
    r = entry.queries()["op1_chat"](spark, sf_dir).filter("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
