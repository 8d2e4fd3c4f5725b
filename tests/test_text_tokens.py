import pytest
from pyspark.sql import functions as F

from veritrail.functions import chat, text, tokens


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    "raw,value",
    [("true", 1), ("false", 0), ("1", 1), ("0", 0), ("-2", 1), ("0.0", 0), ("0.5", 1), ('"false"', 1), ('""', 0),
     ("null", 0), ("[]", 0), ("[0]", 1), ("{}", 0), ('{"a": 0}', 1)],
)
def test_truthy(spark, raw, value):
    assert one(spark, text.truthy(F.parse_json(F.lit(raw))).alias("v")).v == value


@pytest.mark.parametrize("raw,value", [("true", 1), ("false", 0), ('"False"', 0), ('"TRUE"', 1), ('"yes"', None), ("null", None)])
def test_strict_label(spark, raw, value):
    assert one(spark, text.strict_label(F.parse_json(F.lit(raw))).alias("v")).v == value


def test_as_text_and_blank(spark):
    row = one(
        spark, text.as_text(F.lit(None).cast("string")).alias("a"), text.as_text(F.lit(3)).alias("b"),
        text.is_blank(F.lit(" \n\t\u00a0\u3000\x1c\x85")).alias("c"), text.is_blank(F.lit(" x ")).alias("d"), text.is_blank(F.lit("")).alias("e"),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == ("None", "3", True, False, True)


def test_chat_rendering(spark):
    msgs = chat.chat_messages(F.lit("S"), F.lit("Q"), F.lit("A"))
    two = chat.chat_messages(F.lit("S"), F.lit("Q"))
    row = one(
        spark, chat.render_chat(msgs, "closed").alias("closed"), chat.render_chat(msgs, "continue").alias("go"),
        chat.render_chat(two, "generation").alias("ask"),
    )
    head = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n"
    assert row.ask == head
    assert row.go == head + "A"
    assert row.closed == head + "A<|im_end|>\n"
    with pytest.raises(ValueError):
        chat.render_chat(msgs, "other")


def test_prompts_per_profile(spark):
    row = one(
        spark, chat.system_prompt("corpus").alias("a"), chat.system_prompt("search").alias("b"),
        chat.system_prompt("corpus", unify=True).alias("c"),
    )
    assert row.a == row.b + " " and row.c == row.b and row.b.endswith("etc.\n")


def test_truncate_and_trims(spark):
    seq = F.array(*[F.lit(i) for i in range(1, 7)])
    padded = F.array(*[F.lit(i) for i in (0, 0, 7, 8, 0)])
    mask = tokens.attention_mask(padded, 0)
    row = one(
        spark, tokens.left_truncate(seq, 4).alias("cut"), tokens.left_truncate(seq, 9).alias("whole"),
        tokens.mask_length(mask).alias("n"), tokens.trim_padding(padded, tokens.mask_length(mask)).alias("tail"),
        tokens.trim_padding(padded, F.lit(2), "right").alias("head"), tokens.trim_by_mask(padded, mask).alias("masked"),
        tokens.trim_padding(padded, F.lit(0)).alias("none"), tokens.new_tokens(seq, F.lit(4)).alias("new"),
        tokens.new_tokens(seq, F.lit(6)).alias("nothing"), tokens.has_eos(seq, 6).alias("eos"), tokens.has_eos(seq, 9).alias("open"),
    )
    assert row.cut == [3, 4, 5, 6] and row.whole == [1, 2, 3, 4, 5, 6]
    # tail trimming takes the right padding for a token, the mask does not
    assert row.n == 2 and row.tail == [8, 0] and row.head == [0, 0] and row.masked == [7, 8] and row.none == []
    assert row.new == [5, 6] and row.nothing == [] and row.eos and not row.open


def test_pad_batch(spark):
    df = spark.createDataFrame([(1, 0, [1]), (2, 0, [1, 2, 3]), (3, 1, [4])], "id int, batch int, ids array<int>")
    left = {r.id: r for r in tokens.pad_batch(df, "ids", "batch", 0).collect()}
    right = {r.id: r for r in tokens.pad_batch(df, "ids", "batch", 0, "right").collect()}
    assert left[1].padded == [0, 0, 1] and right[1].padded == [1, 0, 0]
    wide = spark.createDataFrame([(1, 0, [[1.0]]), (2, 0, [[2.0], [3.0]])], "id int, batch int, v array<array<double>>")
    vectors = {r.id: r.padded for r in tokens.pad_batch(wide, "v", "batch", F.array(F.lit(0.0)), "right").collect()}
    assert vectors == {1: [[1.0], [0.0]], 2: [[2.0], [3.0]]}
    assert left[2].padded_to == 3 and left[3].padded == [4] and left[3].padded_to == 1


def test_decode_skips_specials_and_keeps_empty_sequences(spark):
    df = spark.createDataFrame([(1, [5, 6, 9]), (2, [9]), (3, [6, 6])], "id int, ids array<int>")
    vocab = spark.createDataFrame([(5, "a"), (6, "b"), (9, "<end>")], "token_id int, token string")
    assert {r.id: r.text for r in tokens.decode(df, "id", "ids", vocab, (9,)).collect()} == {1: "a b", 2: "", 3: "b b"}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decode_in_place_and_by_join(spark, limit):
    df = spark.createDataFrame([(1, [5, 6, 9]), (2, [9]), (2, [6, None, 6]), (3, None), (None, [])], "id int, ids array<int>")
    vocab = spark.createDataFrame([(5, "a"), (6, "b"), (9, "<end>")], "token_id int, token string")
    got = sorted(((r.id, r.text) for r in tokens.decode(df, "id", "ids", vocab, (9,), max_bytes=limit).collect()), key=str)
    assert got == sorted([(1, "a b"), (2, ""), (2, "b b"), (3, ""), (None, "")], key=str)
    assert tokens.decode(df.where("id = 2"), "id", "ids", vocab, max_bytes=limit).where("text = '<end>'").count() == 1
    with pytest.raises(Exception, match="token id 7 is not in the vocabulary"):
        tokens.decode(spark.createDataFrame([(1, [5, 7])], "id int, ids array<int>"), "id", "ids", vocab, (9,), max_bytes=limit).collect()
