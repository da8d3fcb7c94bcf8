"""op2's loss text as it stands in the output, op8's bound of languages."""

import pytest
from pyspark.sql import functions as F

from fleetledger.llm import chat_format, language_id


def test_text_under_the_mask_is_read_from_the_output(spark):
    """Spans within, at and across the blocks that texts are looked up in; beyond the Basic Multilingual Plane; empty ones."""
    t = "ab😀" * 900 + r"x<\|y" * 40
    spans = [(0, 0), (0, 3), (1023, 1025), (1024, 2048), (1000, 2750), (5, 5), (len(t) - 5, len(t))]
    d = spark.createDataFrame([(t, spans), ("", []), (None, None)], "formatted string, loss_spans array<struct<s:int,e:int>>")
    got = [r.u for r in d.select(chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("u")).collect()]
    assert got == [[t[s:e].replace(r"<\|", "<|") for s, e in spans], [], None]


def test_loss_text_of_edited_conversations(spark):
    rows = [(1, 1, "create", 1, "user", "q <|im_end|>"), (1, 2, "create", 2, "assistant", "first"), (1, 3, "edit", 2, "assistant", ""), (1, 4, "delta", 2, "assistant", r"<|im_start|> <\| end"), (1, 5, "create", 3, "assistant", ""), (2, 1, "create", 1, "user", "no answer")]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id int, seq int, op string, msg_id int, role string, text string"))
    got = {r.conv_id: r.u for r in out.select("conv_id", chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("u")).collect()}
    assert got == {1: [r"<|im_start|> <\| end", ""], 2: []}


def test_languages_beyond_the_bound_are_an_error(spark):
    d = spark.createDataFrame([(i, f"text {i}", f"l{i % 4}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 3 languages"):
        language_id.fit(d, 2, languages=3)
    assert language_id.fit(d, 2, languages=4).languages == ["l0", "l1", "l2", "l3"]
