import hashlib

from rollgrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pieces string"
ROWS = [
    (1, 1, "assistant", "yes\\no <|im_sep|>", "p"),
    (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok", "p"),
    (1, 2, "assistant", "more", "p"),
    (1, 3, "user", None, "p"),
    (2, None, "sys\ntem<|", "", "p"),
    (2, 0, None, "x", "p"),
    (2, 0, None, "x", "p"),
    (2, 0, "assistant", "é😀\\|", "p"),
    (None, 5, "assistant", "a" * 100_000, None),
]


def wanted():
    out = {}
    for conv in (1, 2, None):
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in ROWS if r[0] == conv)
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    chats = chat.format_chats(spark.createDataFrame(ROWS, SCHEMA))
    got = {r["conv_id"]: r for r in chat.digest_chats(chats).collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == wanted()
    formatted = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    assert {k: len(v) for k, v in formatted.items()} == {k: r["formatted_chars"] for k, r in got.items()}
    # neighbours of one role share a block, and no text adds a mark
    assert formatted[1].count("<|im_start|>") == formatted[1].count("<|im_end|>") == 3
    assert formatted[1].count("<|im_sep|>") == 1


def test_no_rows(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
